"""Streaming forms of the price history. An extension: batch results define what is right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricelode.functions.dates import SHOP_ZONE
from pricelode.operators.history import first_by, history_to_append


def daily_buckets(observed: DataFrame, key: str, ts: str, price: str, in_stock: Column, late: str = "2 days") -> DataFrame:
    """Per key and local day of a stream: lowest price in stock, rows, last time. ``ts`` is UTC;
    days that the watermark has passed are final."""
    local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), SHOP_ZONE)
    day = F.window(F.col("_local"), "1 day")
    return observed.withColumn("_local", local).withWatermark("_local", late).groupBy(key, day).agg(
        F.min(F.when(in_stock, F.col(price))).alias("lowest_price"), F.count("*").alias("n"), F.max(ts).alias("last_seen")
    ).withColumn("day", F.to_date("window.start")).drop("window")


def capture_changes(observed: DataFrame, history_path: str, checkpoint: str, keys: list[str], ts: str, values: list[str]) -> StreamingQuery:
    """Appends to the history table what each micro-batch says that is new. The latest row of every key is a table
    of its own beside the history (``_latest``, one version a batch; the last two are kept), so that a batch reads
    one row a key and not the history, however long that grows. Each batch writes its own partition of both, so a
    batch that is run again replaces what it wrote."""
    latest_path = f"{history_path.rstrip('/')}_latest"

    def write(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        newest = first_by(batch, keys, [F.desc(ts), *(F.asc(v) for v in values)])
        before = f"{latest_path}/batch={number - 1}"
        known = spark.read.schema(batch.schema).parquet(before) if _exists(spark, before) else spark.createDataFrame([], batch.schema)
        fresh = history_to_append(known, newest, keys, ts, values)
        fresh.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(history_path)
        # what was captured last of each key: a row that said nothing new is not in the history either
        now = fresh.unionByName(known.join(fresh.select(*keys), keys, "left_anti"))
        now.write.mode("overwrite").parquet(f"{latest_path}/batch={number}")
        _delete(spark, f"{latest_path}/batch={number - 2}")

    return observed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _path(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    files, at = _path(spark, path)
    return files.exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    files, at = _path(spark, path)
    files.delete(at, True)
