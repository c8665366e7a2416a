"""Merging new rows into current tables, by declared policy per column, as pure joins.

Parquet knows no MERGE: each function returns the new table, which the caller writes in
place of the old one (one writer at a time)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What becomes of a column when a key is on both sides.
KEEP, REPLACE, NONBLANK, LEAST, GREATEST, NEW = "keep", "replace", "nonblank", "least", "greatest", "new"


def _merged(policy: str, old: Column, new: Column) -> Column:
    if policy == KEEP:  # what is known stays
        return F.coalesce(old, new)
    if policy == REPLACE:  # a new value wins unless it is null
        return F.coalesce(new, old)
    if policy == NONBLANK:  # a new value wins unless it is null or empty
        return F.coalesce(F.nullif(new, F.lit("")), old)
    if policy == LEAST:
        return F.least(old, new)
    if policy == GREATEST:
        return F.greatest(old, new)
    raise ValueError(f"unknown policy {policy}")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], policies: dict[str, str]) -> DataFrame:
    """All keys of both sides. ``policies`` names every other column; with ``NEW`` the
    incoming side wins whatever it holds, blank or null, where it has the key. Keys are
    unique on either side, and null keys match nothing."""
    there = F.col("_new").isNotNull()
    joined = current.alias("o").join(incoming.withColumn("_new", F.lit(True)).alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full")
    columns = [F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys]
    for name, policy in policies.items():
        old, new = (F.col(f"{side}.{name}") for side in "on")
        columns.append((F.when(there, new).otherwise(old) if policy == NEW else _merged(policy, old, new)).alias(name))
    return joined.select(*columns)


def update_from(current: DataFrame, incoming: DataFrame, keys: list[str], policies: dict[str, str]) -> DataFrame:
    """As ``upsert``, for the keys of ``current`` only; its columns keep their order."""
    joined = current.alias("o").join(incoming.alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "left")
    return joined.select(*(_merged(policies[c], F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) if c in policies else F.col(f"o.{c}") for c in current.columns))


def fill_missing(current: DataFrame, incoming: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``current`` with the blanks of ``columns`` filled from the incoming rows: what is known stays."""
    joined = current.alias("o").join(incoming.alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "left")
    known = lambda side, c: F.nullif(F.trim(F.col(f"{side}.{c}")), F.lit(""))
    return joined.select(*(F.coalesce(known("o", c), known("n", c)).alias(c) if c in columns else F.col(f"o.{c}") for c in current.columns))


def delete_using(current: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` without the rows whose keys ``doomed`` has; null keys match nothing."""
    return current.join(doomed.select(*keys), keys, "left_anti")


def missing_rows(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The incoming rows whose key the current table lacks."""
    return incoming.join(current.select(*keys), keys, "left_anti")


def append_absent(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return current.unionByName(missing_rows(current, incoming, keys), allowMissingColumns=True)


def retained(table: DataFrame, loaded_at: str, as_of: Column, days: int) -> DataFrame:
    """The rows loaded in the last ``days`` days; rows without a time stay."""
    return table.where(F.col(loaded_at).isNull() | (F.col(loaded_at) >= as_of - F.make_interval(days=F.lit(days))))


def preview(current: DataFrame, changed: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """What writing ``changed`` over ``current`` would change: key, column, old and new value."""
    joined = changed.alias("n").join(current.alias("o"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "left")
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"o.{c}").cast("string").alias("old"), F.col(f"n.{c}").cast("string").alias("new")) for c in columns))
    rows = joined.select(*(F.col(f"n.{k}").alias(k) for k in keys), F.explode(each).alias("x"))
    return rows.select(*keys, "x.column", "x.old", "x.new").where(~F.col("old").eqNullSafe(F.col("new")))
