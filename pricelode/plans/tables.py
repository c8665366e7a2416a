"""The test tables in the roles of the price library: part is the product, supplier the shop,
lineitem the price observations, orders and customer the queue."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" of all queries.
AS_OF = "1998-08-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, for Python: whole pages travel there, so rows and bytes of an Arrow batch are bounded for the session (Spark reads these limits when a plan
    runs). Else a batch has 10,000 pages, however long they are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return table(spark, sf_dir, "pages")


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``; in local mode (tests), where
    that may be unset, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="pricelode-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product, shop, price, in_stock, seen"""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product"), F.col("l_suppkey").alias("shop"), F.col("l_extendedprice").alias("price"), (F.col("l_linestatus") == "O").alias("in_stock"),
        F.col("l_shipdate").alias("seen"),
    )


#: The same for DuckDB, as a CTE.
OBS = "obs AS (SELECT l_partkey AS product, l_suppkey AS shop, l_extendedprice AS price, l_linestatus = 'O' AS in_stock, l_shipdate AS seen FROM lineitem)"

#: The latest observation of a product and shop; ties by the lowest price, then in stock.
LATEST = [F.desc, "seen"], [F.asc, "price"], [F.desc, "in_stock"]
LATEST_SQL = "latest AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY product, shop ORDER BY seen DESC, price, in_stock DESC) = 1)"


def latest_order() -> list[Column]:
    return [how(c) for how, c in LATEST]
