"""Writing results: rejects, summaries, exports and logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_rejects(rejects: DataFrame, path: str, reason: str = "reject_reason", raw: str = "raw") -> None:
    """Rejected rows as CSV: the reason and every key of the raw rows, sorted. The keys are the feed's columns: few."""
    keys = sorted(r.k for r in rejects.select(F.explode(F.map_keys(raw)).alias("k")).distinct().collect())
    columns = [F.col(raw)[k].alias(k) for k in keys if k != reason]
    rejects.select(F.col(reason).alias("reason"), *columns).write.mode("overwrite").option("header", True).csv(path)


def write_summary(stats: DataFrame, path: str) -> None:
    """A one-row table as JSON."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def write_sorted_csv(df: DataFrame, path: str, order: list[str]) -> None:
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_current(df: DataFrame, path: str, partition: str | None = None) -> None:
    """A table in place of the old one, which ``df`` may read; with ``partition``, only the partitions that ``df`` has
    (Spark's committer puts those in place at the end). The whole table is written beside its place and moved there
    when all is written: a job that fails leaves the old one. Between the two renames there is no table; ``versions`` keeps
    tables that are read all the time."""
    if partition:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        return
    draft, old = (f"{path.rstrip('/')}.{uuid.uuid4().hex}.{x}" for x in ("new", "old"))
    df.write.parquet(draft)
    files, (at, new, gone) = _store(df, path, draft, old)
    there = files.exists(at)
    if there:
        files.rename(at, gone)
    if not files.rename(new, at):
        if there:
            files.rename(gone, at)
        raise OSError(f"{draft} could not be moved to {path}")
    files.delete(gone, True)


def _store(df: DataFrame, *paths: str) -> tuple:
    """The file system of some paths, and the paths for it."""
    context = df.sparkSession.sparkContext
    made = [context._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return made[0].getFileSystem(context._jsc.hadoopConfiguration()), made


def export_view(df: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns of a view, in this order, as CSV with a header."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_upload(pairs: dict[str, tuple[DataFrame, DataFrame]], report: DataFrame, path: str) -> None:
    """Validated and rejected rows of each set as CSV, and the preflight report as JSON."""
    for name, sides in pairs.items():
        for side, rows in zip(("validated", "rejected"), sides, strict=True):
            rows.write.mode("overwrite").option("header", True).csv(f"{path}/{name}_{side}")
    report.coalesce(1).write.mode("overwrite").json(f"{path}/preflight_report")


def write_counted(df: DataFrame, path: str, counters: dict[str, Column], keep: Column | None = None, mode: str = "append") -> dict[str, object]:
    """Write the rows that ``keep`` takes (null: not) as Parquet, and give aggregates over all rows, which come out of the
    same job: the input is read once. What a task counted twice because it ran twice counts once."""
    seen = Observation()
    counted = df.observe(seen, *(c.alias(name) for name, c in counters.items()))
    (counted if keep is None else counted.where(keep)).write.mode(mode).parquet(path)
    return seen.get
