"""Files and streams as queries: tables go out through the sinks, and come back through the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.operators import validation
from pricelode.plans.catalogue import query
from pricelode.plans.tables import table, work_folder
from pricelode.sources import feeds, sinks
from pricelode.streaming import changes, state


@query("SELECT p_name AS title, p_brand AS artist, CAST(p_partkey AS VARCHAR) AS ean, '' AS missing FROM part")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Sorted CSV files, read back with the columns that are asked for."""
    path = work_folder(spark, "csv")
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("ean"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"))
    sinks.write_sorted_csv(rows, path, ["artist", "title", "ean"])
    return feeds.read_csv(spark, path, ["title", "artist", "ean", "missing"])


@query("""WITH p AS (SELECT *, CASE WHEN p_size > 45 THEN 'bad_size' WHEN p_retailprice > 1500 THEN 'invalid_price' END AS reason FROM part)
SELECT reason, CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_size AS VARCHAR) AS p_size, p_type FROM p WHERE reason IS NOT NULL""")
def rejects_file(spark: SparkSession, d: str) -> DataFrame:
    """Rejected rows with their raw columns, as a file and back."""
    path = work_folder(spark, "rejects")
    rules = [("bad_size", F.col("p_size") > 45), ("invalid_price", F.col("p_retailprice") > 1500)]
    raw = F.create_map(*(x for c in ("p_partkey", "p_size", "p_type") for x in (F.lit(c), F.col(c).cast("string"))))
    _, bad = validation.split(table(spark, d, "part").withColumn("raw", raw).withColumn("reject_reason", validation.first_reason(rules)), "reject_reason")
    sinks.write_rejects(bad, path)
    return feeds.read_csv(spark, path)


@query("SELECT c_custkey, c_acctbal + 100 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_acctbal + 100 FROM customer WHERE c_custkey % 3 = 1")
def table_swap(spark: SparkSession, d: str) -> DataFrame:
    """A table replaced by a query over itself."""
    path = work_folder(spark, "current")
    sinks.write_current(table(spark, d, "customer").select("c_custkey", "c_acctbal"), path)
    sinks.write_current(spark.read.parquet(path).where("c_custkey % 3 < 2").select("c_custkey", (F.col("c_acctbal") + 100).alias("c_acctbal")), path)
    return spark.read.parquet(path)


@query("SELECT o_orderstatus AS status, 2 * count(*) AS n FROM orders GROUP BY 1")
def log_appends(spark: SparkSession, d: str) -> DataFrame:
    path = work_folder(spark, "log")
    for _ in range(2):
        sinks.append_log(table(spark, d, "orders").select("o_orderstatus"), path)
    return spark.read.parquet(path).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Amsterdam' AS DATE) AS day, min(value) FILTER (event_type <> 'error') AS lowest_price, count(*) AS n, max(ts) AS last_seen FROM events GROUP BY 1, 2""")
def stream_daily_history(spark: SparkSession, d: str) -> DataFrame:
    """The daily price history of a stream of events, up to its end."""
    out = work_folder(spark, "stream")
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    daily = changes.daily_buckets(stream, "user_id", "ts", "value", F.col("event_type") != "error")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/table")  # noqa: E731, ARG005
    daily.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/table")


@query("SELECT user_id, ts, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value, event_type) = 1")
def stream_changes(spark: SparkSession, d: str) -> DataFrame:
    """What change capture appends for the first batch of a stream: the newest event of each user."""
    out = work_folder(spark, "changes")
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select("user_id", "ts", "event_type", "value")
    changes.capture_changes(stream, f"{out}/history", f"{out}/checkpoint", ["user_id"], "ts", ["value", "event_type"]).awaitTermination()
    return spark.read.parquet(f"{out}/history").drop("batch")


@query("""WITH e AS (SELECT DISTINCT user_id, ts, event_type, value FROM events), l AS (SELECT *, lag(ts) OVER w AS old_ts, lag(event_type) OVER w AS old_type, lag(value) OVER w AS old_value FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type NULLS FIRST, value NULLS FIRST))
SELECT user_id, ts, event_type, value FROM l WHERE old_ts IS NULL OR CAST(ts AS DATE) <> CAST(old_ts AS DATE) OR event_type IS DISTINCT FROM old_type OR value IS DISTINCT FROM old_value""")
def stream_new_observations(spark: SparkSession, d: str) -> DataFrame:
    """What all events say that is new, captured in three micro-batches by three runs: the last observation of each user is in the state store between them.
    The second run repeats all rows of the first."""
    out = work_folder(spark, "state")
    events = table(spark, d, "events").select("user_id", "ts", "event_type", "value")
    low, high = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    step = (high - low) / 3
    spans = [(low, low + step), (low, low + 2 * step), (low + 2 * step, None)]
    for start, stop in spans:
        some = events.where(F.col("ts") >= F.lit(start))
        (some if stop is None else some.where(F.col("ts") < F.lit(stop))).write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{out}/in")
        state.append_changes(stream, f"{out}/history", f"{out}/checkpoint", ["user_id"], "ts", ["event_type", "value"]).awaitTermination()
    return spark.read.parquet(f"{out}/history")
