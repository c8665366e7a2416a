"""Current tables whose merges exchange only what comes in.

A table is a folder of versions and a small file ``current`` that names the one that counts. A version is Parquet,
bucketed and sorted by the keys, so a merge brings the incoming rows to the buckets and leaves the table's own rows
where they are. A merge writes a version beside the others and then replaces ``current``, which is one rename: readers
see the old table or the new one, and a job that dies before it leaves the old. One writer at a time."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.operators import merge as merges


def _hadoop(spark: SparkSession, path: str) -> tuple[Any, Any, Any]:
    """JVM packages, a path and its file system."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return hadoop, at, at.getFileSystem(context._jsc.hadoopConfiguration())


def _name_current(spark: SparkSession, path: str, described: dict[str, Any]) -> None:
    """Replace the pointer: written under another name, then renamed over the old one."""
    context = spark.sparkContext
    hadoop, at, files = _hadoop(spark, f"{path}/current")
    draft = hadoop.Path(f"{path}/_current-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(described).encode()))
    out.close()
    options = context._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(files.getUri(), context._jsc.hadoopConfiguration()).rename(files.makeQualified(draft), files.makeQualified(at), options)


def _described(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(f"{path}/current", wholetext=True).first().value)


def _write(df: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    version = f"version_{uuid.uuid4().hex}"
    df.write.option("path", f"{path}/{version}").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(version)
    schema = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)
    _name_current(df.sparkSession, path, {"version": version, "keys": keys, "buckets": buckets, "schema": schema})


def create(df: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """A table from rows with unique ``keys``, as many tasks as ``buckets``: choose these by the size that the table will have."""
    _write(df.repartition(buckets, *keys), path.rstrip("/"), keys, buckets)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The version that counts now, with its buckets, in whatever session."""
    path = path.rstrip("/")
    now = _described(spark, path)
    if not spark.catalog.tableExists(now["version"]):
        keys = ", ".join(f"`{k}`" for k in now["keys"])
        spark.sql(f"CREATE TABLE {now['version']} ({now['schema']}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {now['buckets']} BUCKETS LOCATION '{path}/{now['version']}'")
    return spark.table(now["version"])


def merged(spark: SparkSession, path: str, incoming: DataFrame, policies: dict[str, str]) -> DataFrame:
    """The table with incoming rows merged by ``policies`` (see ``merge.upsert``): only these are exchanged, to the table's buckets."""
    now = _described(spark, path.rstrip("/"))
    current = read(spark, path)
    placed = incoming.select(*(F.col(k).cast(current.schema[k].dataType).alias(k) for k in now["keys"]), *(F.col(c).cast(current.schema[c].dataType).alias(c) for c in policies))
    return merges.upsert(current, placed.repartition(now["buckets"], *now["keys"]), now["keys"], policies).select(*current.columns)


def merge(spark: SparkSession, path: str, incoming: DataFrame, policies: dict[str, str]) -> None:
    now = _described(spark, path.rstrip("/"))
    _write(merged(spark, path, incoming, policies), path.rstrip("/"), now["keys"], now["buckets"])


def drop_old(spark: SparkSession, path: str) -> int:
    """Delete the versions that don't count, left by merges or by jobs that died; how many. No reader may be at work on them."""
    path = path.rstrip("/")
    now = _described(spark, path)["version"]
    _, at, files = _hadoop(spark, path)
    old = [s.getPath() for s in files.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("version_") and s.getPath().getName() != now]
    for p in old:
        spark.sql(f"DROP TABLE IF EXISTS {p.getName()}")
        files.delete(p, True)
    return len(old)
