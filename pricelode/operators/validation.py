"""Reject reasons, splits, duplicates and their counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.operators.history import first_by


def first_reason(rules: Iterable[tuple[str, Column]]) -> Column:
    """The name of the first rule that fails a row; null if none does."""
    return F.coalesce(*(F.when(test, F.lit(name)) for name, test in rules))


def all_reasons(rules: Iterable[tuple[str, Column]]) -> Column:
    """The names of all rules that fail a row, joined by "|"; '' if none does."""
    return F.concat_ws("|", *(F.when(test, F.lit(name)) for name, test in rules))


def split(df: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows without and with a reason."""
    bad = F.coalesce(F.col(reason), F.lit("")) != ""
    return df.where(~bad).drop(reason), df.where(bad)


def duplicate_classes(df: DataFrame, gtin: str, product_key: str, price: str) -> DataFrame:
    """Per GTIN: rows, products, prices, and unique, benign (one product and price) or conflict."""
    found = df.groupBy(gtin).agg(F.count("*").alias("n_rows"), F.count_distinct(product_key).alias("n_products"), F.count_distinct(price).alias("n_prices"))
    kind = F.when(F.col("n_rows") == 1, F.lit("unique")).when((F.col("n_products") == 1) & (F.col("n_prices") == 1), F.lit("benign")).otherwise(F.lit("conflict"))
    return found.withColumn("kind", kind)


def reject_duplicates(df: DataFrame, gtin: str, product_key: str, price: str, newest: list[Column]) -> DataFrame:
    """``df`` with ``reject_reason``: of benign duplicates all but the newest, of conflicting ones
    all. Groups are judged by their aggregates, which meet the rows in a join that Spark can
    split where one code is hot; only rows of benign duplicates are put in order."""
    code, same = F.coalesce(gtin, F.lit("")).alias("_g"), lambda c: F.min(c) == F.max(c)
    kind = F.when(F.count("*") == 1, "unique").when(same(product_key) & same(price), "benign").otherwise("conflict")  # duplicate_classes without its counts
    judged = df.groupBy(code).agg(kind.alias("_kind"))
    joined = df.withColumn("_g", code).join(judged, "_g")
    reason = F.when(F.col("_kind") == "conflict", F.lit("conflicting_duplicate_ean"))
    benign = joined.where(F.col("_kind") == "benign")
    place = F.row_number().over(Window.partitionBy("_g").orderBy(*newest))
    older = F.when(place > 1, F.lit("duplicate_same_product_same_price"))
    out = joined.where(F.col("_kind") != "benign").withColumn("reject_reason", reason).unionByName(benign.withColumn("reject_reason", older))
    return out.drop("_g", "_kind")


def conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one value: their count and the values, sorted and joined by "|"."""
    # Distinct pairs first, on all machines; only keys with a conflict have their values listed.
    pairs = df.select(*keys, F.col(value).cast("string").alias("_v")).where(F.col("_v").isNotNull()).distinct()
    found = pairs.groupBy(*keys).agg(F.count("*").cast("int").alias("n_values")).where(F.col("n_values") > 1)
    listed = pairs.join(found, keys).groupBy(*keys).agg(F.any_value("n_values").alias("n_values"), F.array_join(F.array_sort(F.collect_list("_v")), "|").alias("conflicting_values"))
    return listed


def best_quality(df: DataFrame, keys: list[str], columns: list[str], order: list[Column]) -> DataFrame:
    """Per key the row with the most non-blank ``columns``; ties by ``order``."""
    filled = F.lit(0)
    for c in columns:
        filled = filled + F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "", 1).otherwise(0)
    return first_by(df.withColumn("_filled", filled), keys, [F.desc("_filled"), *order]).drop("_filled")


def import_stats(df: DataFrame, reason: str, new: Column, changed: Column) -> DataFrame:
    """One row: rows read, accepted, rejected, new, changed, unchanged."""
    bad = F.coalesce(F.col(reason), F.lit("")) != ""
    count = lambda test: F.coalesce(F.count_if(test), F.lit(0))
    return df.agg(
        F.count("*").alias("rows_read"), count(~bad).alias("accepted"), count(bad).alias("rejected"), count(~bad & new).alias("new_rows"), count(~bad & ~new & changed).alias("changed"),
        count(~bad & ~new & ~changed).alias("unchanged"),
    )


def reason_counts(df: DataFrame, reason: str) -> DataFrame:
    return df.groupBy(reason).agg(F.count("*").alias("n"))


def prepare_upload(sets: dict[str, tuple[DataFrame, list[tuple[str, Column]]]]) -> tuple[dict[str, tuple[DataFrame, DataFrame]], DataFrame]:
    """({set: (validated, rejected)}, preflight report) of sets of rows with their rules. The report has a row per set and
    reason ('' for the rows that pass): dataset, rejection_reason, n."""
    pairs, report = {}, None
    for name, (rows, rules) in sets.items():
        judged = rows.withColumn("rejection_reason", all_reasons(rules))
        pairs[name] = split(judged, "rejection_reason")
        counts = judged.groupBy("rejection_reason").agg(F.count("*").alias("n")).select(F.lit(name).alias("dataset"), "rejection_reason", "n")
        report = counts if report is None else report.unionByName(counts)
    return pairs, report


def run_metrics(rows: DataFrame, shop: str, reason: str, uploaded: Column) -> DataFrame:
    """Per shop: rows read, accepted and rejected, uploads that went well or failed (null: none was tried), and the share that was rejected."""
    bad = F.coalesce(F.col(reason), F.lit("")) != ""
    return rows.groupBy(shop).agg(
        F.count("*").alias("rows_read"), F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("rejected"), F.count_if(~bad & F.coalesce(uploaded, F.lit(False))).alias("upload_ok"),
        F.count_if(~bad & ~F.coalesce(uploaded, F.lit(True))).alias("upload_failed"),
    ).withColumn("reject_share", F.col("rejected") / F.col("rows_read"))


def finish_runs(log: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """The run log with the results of its runs (one row each): what a result says replaces what the log said; other runs stay."""
    values = [c for c in results.columns if c != key]
    joined = log.join(results.select(key, *(F.col(c).alias(f"_{c}") for c in values)), key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in values else F.col(c) for c in log.columns))
