"""Joins that need more than a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.operators.history import first_by


def or_join(left: DataFrame, right: DataFrame, pairs: list[tuple[Column, Column]], left_id: str, right_id: str) -> DataFrame:
    """Pairs of ids where any of the equalities holds, each once: one hash join for each, in place of a nested loop over all pairs.
    A join leaves out what an earlier one finds, so pairs of ids that one row has need no search for repeats, which would hold and shuffle the
    result; only pairs with an id of several rows go through ``distinct``."""

    def keyed(rows: DataFrame, name: str, side: int) -> DataFrame:
        marks = "lr"[side]
        own = rows.select(F.col(name).alias(f"_{marks}"), *(p[side].alias(f"_{marks}{i}") for i, p in enumerate(pairs)))
        return own.withColumn(f"_{marks}_many", F.count("*").over(Window.partitionBy(f"_{marks}")) > 1)

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        found = None
        for i in range(len(pairs)):
            some = a.join(b, F.col(f"_l{i}") == F.col(f"_r{i}"))
            for j in range(i):
                some = some.where(~F.coalesce(F.col(f"_l{j}") == F.col(f"_r{j}"), F.lit(False)))
            some = some.select("_l", "_r")
            found = some if found is None else found.union(some)
        return found

    a, b = keyed(left, left_id, 0), keyed(right, right_id, 1)
    once = joined(a.where("NOT _l_many"), b.where("NOT _r_many"))
    repeated = joined(a.where("_l_many"), b).union(joined(a.where("NOT _l_many"), b.where("_r_many"))).distinct()
    return once.union(repeated).toDF(left_id, right_id)


def or_anti(left: DataFrame, right: DataFrame, pairs: list[tuple[Column, Column]]) -> DataFrame:
    """Left rows for which none of the equalities holds: one anti join after the other."""
    for a, b in pairs:
        left = left.withColumn("_k", a).join(right.select(b.alias("_k")), "_k", "left_anti").drop("_k")
    return left


def by_normalized(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, how: str = "inner") -> DataFrame:
    """A hash join on an expression of the keys; the key stays as ``join_key``."""
    return left.withColumn("join_key", left_key).join(right.withColumn("join_key", right_key), "join_key", how)


def latest_before(rows: DataFrame, history: DataFrame, keys: list[str], ts: str, columns: list[str], order: list[str]) -> DataFrame:
    """``rows`` with the latest history row of their key (null where there is none)."""
    latest = first_by(history, keys, [F.desc(ts), *(F.asc(c) for c in order)])
    return rows.join(latest.select(*keys, F.col(ts).alias(f"latest_{ts}"), *(F.col(c).alias(f"latest_{c}") for c in columns)), keys, "left")


def match_cardinality(left: DataFrame, right: DataFrame, key: str, right_id: str) -> DataFrame:
    """``left`` with the number of distinct matches, the match if there is exactly one, and unmatched, matched or ambiguous."""
    found = right.groupBy(key).agg(F.count_distinct(right_id).alias("n"), F.min(right_id).alias("_only"))
    joined = left.join(found, key, "left").withColumn("n_matches", F.coalesce("n", F.lit(0)))
    kind = F.when(F.col("n_matches") == 0, F.lit("unmatched")).when(F.col("n_matches") == 1, F.lit("matched")).otherwise(F.lit("ambiguous"))
    return joined.withColumn("match", kind).withColumn("matched_id", F.when(F.col("n_matches") == 1, F.col("_only"))).drop("n", "_only")


def alias_join(left: DataFrame, names: DataFrame, left_name: Column, aliases: Column, name_id: str) -> DataFrame:
    """``left`` with the id that one of a name's aliases leads to; of several, the smallest."""
    expanded = names.select(F.explode(F.array_distinct(aliases)).alias("_alias"), name_id).groupBy("_alias").agg(F.min(name_id).alias(name_id))
    return left.withColumn("_alias", left_name).join(expanded, "_alias", "left").drop("_alias")


def semi_topk(left: DataFrame, key: str, ranked: DataFrame, order: list[Column], most: int) -> DataFrame:
    """Left rows whose key is among the first ``most`` of ``ranked``."""
    return left.join(ranked.orderBy(*order).limit(most).select(key), key, "left_semi")


def known_targets(listing: DataFrame, targets: DataFrame, key: str, order: list[Column], fill: list[str]) -> DataFrame:
    """The first listing row of each key that is a target; blanks of ``fill`` come from the target."""
    first = first_by(listing, [key], order)
    joined = first.alias("n").join(targets.alias("o"), key)
    return joined.select(*(F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}")).alias(c) if c in fill else F.col(c if c == key else f"n.{c}") for c in listing.columns))


def resolve_ids(rows: DataFrame, lookup: DataFrame, key: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the id that the lookup gives them, and the rows that it can't resolve."""
    joined = rows.join(lookup.select(key, target), key, "left")
    return joined.where(F.col(target).isNotNull()), joined.where(F.col(target).isNull()).drop(target)


def resolve_all(rows: DataFrame, lookup: DataFrame, key: str, target: str) -> DataFrame:
    """Rows with the id that the lookup gives them. A row that it can't resolve fails the job, which names its key:
    the check is part of the join's own pass, whether or not a reader wants the id."""
    joined = rows.join(lookup.select(key, target), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no {target} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return joined.where(F.col(target).isNotNull() | missing.cast("boolean"))
