"""Reading shop feeds: CSV and JSON files, with their columns checked.

All columns are read as text; mappings give them types. Delimiters are sniffed from the head
of one file; nothing else of a file passes through the driver."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pricelode.operators.history import first_by
from pricelode.sources.feed_files import best_delimiter

def text_schema(columns: list[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def sniff_delimiter(spark: SparkSession, path: str, lines: int = 5) -> str:
    """The delimiter that the first lines have most often, and each equally often if possible (of a folder in one dialect; ``feed_files`` sniffs each file)."""
    head = [r.value for r in spark.read.text(path).limit(lines).collect() if r.value]
    return best_delimiter(head)


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, delimiter: str | None = ",", breaks_in_cells: bool = True) -> DataFrame:
    """A CSV with a header, as text; a byte order mark in the header is dropped. Where no cell holds a line
    break, ``breaks_in_cells=False`` lets many tasks share a large file. With
    ``columns``, exactly these in this order: missing ones are '' and others go. A missing
    file is an empty table if ``columns`` are given."""
    try:
        found = spark.read.options(header=True, sep=delimiter or sniff_delimiter(spark, path), multiLine=breaks_in_cells, escape='"', encoding="UTF-8").csv(path)
    except AnalysisException as e:
        if columns is None or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], text_schema(columns))
    found = found.toDF(*(c.lstrip("﻿") for c in found.columns))
    if columns is None:
        return found
    return found.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in found.columns else F.lit("").alias(c) for c in columns))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The rows of CSV files with ``source_file`` and ``line_number`` (the first row is line 2). One task reads a
    file, in order, and may read several: a row's number is its place behind the first row of its file, which
    one aggregate finds for all files."""
    rows = read_csv(spark, path).withColumn("source_file", F.input_file_name()).withColumn("_id", F.monotonically_increasing_id())
    first = rows.groupBy("source_file").agg(F.min("_id").alias("_first"))
    numbered = rows.join(first, "source_file").withColumn("line_number", F.col("_id") - F.col("_first") + 2).drop("_id", "_first")
    return numbered.sortWithinPartitions("source_file", "line_number")


#: Canonical columns of marketplace files, whose own separator is ~. Fixed values.
MARKETPLACE = ("timestamp", "master_id", "url", "artist", "title", "year", "price_raw", "price_eur", "ean")


def converted_marketplace(spark: SparkSession, path: str) -> DataFrame:
    """A ~-separated file in canonical columns, trimmed; what the file lacks is ''."""
    return read_csv(spark, path, list(MARKETPLACE), delimiter="~").select(*(F.trim(c).alias(c) for c in MARKETPLACE))


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def validated(df: DataFrame, required: list[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"the source lacks {', '.join(missing)}")
    return df


def newest_file(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The path of the file last modified whose name matches; of equal times the last name."""
    try:
        files = spark.read.format("binaryFile").load(folder).select("path", "modificationTime")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    found = files.where(name.rlike(pattern)).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()
    return found["path"]


def with_captured_at(df: DataFrame, column: str | None = None) -> DataFrame:
    """``captured_at`` from a column, else the time at which the row's file was last modified."""
    modified = F.col("_metadata.file_modification_time")
    return df.withColumn("captured_at", modified if column is None else F.coalesce(F.col(column).try_cast("timestamp"), modified))


def keyed(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key: the last by ``order``; rows without a key go."""
    return first_by(df.where(F.coalesce(F.trim(F.col(key)), F.lit("")) != ""), [key], order)


def token_list(spark: SparkSession, path: str) -> DataFrame:
    """``token`` and ``position`` of the distinct words of text files, split at blanks, commas and semicolons."""
    words = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"[\s,;]+")).alias("at", "token"))
    first = first_by(words.where("token <> ''"), ["token"], [F.asc("file"), F.asc("at")])
    return first.select("token", F.struct("file", "at").alias("position"))


PRODUCT_JSON = "id bigint, title string, vendor string, handle string, variants array<struct<id: bigint, title: string, sku: string, barcode: string, price: bigint, compare_at_price: bigint, available: boolean>>"


def product_variants(payloads: DataFrame, column: str) -> DataFrame:
    """A row per variant of product JSON texts; prices are in cents; an unreadable text gives no rows."""
    parsed = payloads.withColumn("_p", F.from_json(column, PRODUCT_JSON))
    rows = parsed.select(*payloads.columns, "_p.title", "_p.vendor", "_p.handle", F.explode("_p.variants").alias("v"))
    return rows.select(
        *payloads.columns, "title", "vendor", "handle", F.col("v.id").alias("variant_id"), F.col("v.title").alias("variant_title"), "v.sku", "v.barcode", (F.col("v.price") / 100).alias("price"),
        (F.col("v.compare_at_price") / 100).alias("list_price"), "v.available",
    )


RELEASE_JSON = "releases array<struct<id: string, title: string, barcode: string, score: double, status: string, date: string, country: string, `artist-credit`: array<struct<name: string, joinphrase: string, artist: struct<name: string>>>>>"


def releases(payloads: DataFrame, column: str, most: int = 10) -> DataFrame:
    """A row per release of search results, the first ``most`` of each, with the artists' names joined."""
    rows = payloads.withColumn("_r", F.slice(F.from_json(column, RELEASE_JSON)["releases"], 1, most)).select(*payloads.columns, F.posexplode("_r").alias("position", "r"))
    name = F.transform(F.coalesce(F.col("r.artist-credit"), F.array()), lambda a: F.concat(F.coalesce(F.nullif(a["name"], F.lit("")), a["artist"]["name"], F.lit("")), F.coalesce(a["joinphrase"], F.lit(""))))
    return rows.select(*payloads.columns, "position", F.col("r.id").alias("release_id"), "r.title", "r.barcode", "r.score", "r.status", "r.date", "r.country", F.trim(F.array_join(name, "")).alias("artist"))


def bundles(spark: SparkSession, path: str, most: int = 20) -> DataFrame:
    """Export manifests, newest first."""
    schema = "selected_shops array<string>, bundle_dir string, outputs map<string, string>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select("*", F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("manifest"))
    return rows.orderBy(F.desc("modified"), F.desc("manifest")).limit(most)


def bundles_of(manifests: DataFrame, shops: list[str]) -> DataFrame:
    """The manifests whose shops are exactly these, in whatever order."""
    return manifests.where(F.array_sort(F.array_distinct("selected_shops")) == F.array(*map(F.lit, sorted(set(shops)))))
