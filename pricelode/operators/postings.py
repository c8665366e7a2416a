"""Substring search by postings of grams.

``build`` writes two tables below a folder: ``postings`` (gram, block, products: the sorted numbers of a block's products that
have the gram; in folders by a hash of the gram) and ``rows`` (the searched rows, in folders by block). A block is a range of ``BLOCK`` product
numbers, so no posting is longer than that, however frequent its gram is. ``candidates`` reads only the postings of the query's grams, intersects them
within each block, the rarest first, and then only the rows of blocks that have candidates; they are a superset of the matches,
for the caller to verify. Grams have 1 to 3 characters: a query of one or two characters looks itself up.

Defined cases: a null field counts as empty; an empty query has no candidates; case and characters are compared as they are (give
fields in the form in which they are verified); an empty table gives no candidates; product numbers are unique, whole and not null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 65_536
GRAM = 3
#: Folders of postings. Each holds the grams of one hash value.
FOLDERS = 64
#: Grams are cut from so many pieces of a block on their own.
PIECES = 16
#: Up to so many blocks of rows are named in the filter of the scan; beyond that they are joined.
NAMED = 1000


def grams_of(query: str) -> list[str]:
    """The grams that any text with ``query`` in it has."""
    size = min(GRAM, len(query))
    return sorted({query[i : i + size] for i in range(len(query) - size + 1)}) if query else []


def _grams(field: Column) -> Column:
    """All different grams of 1 to GRAM characters of a text."""

    def of_size(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(field) - (n - 1)), lambda i: F.substring(field, i, F.lit(n)))
        return F.when(F.length(field) >= n, cut).otherwise(F.array().cast("array<string>"))

    each = [of_size(n) for n in range(1, GRAM + 1)]
    return F.array_distinct(F.concat(*each))


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def _pairs(rows: DataFrame, product: str, fields: list[Column], block: int) -> DataFrame:
    """(product, block, gram) of all rows. A file of a few MB, one task, may hold millions of them, so pieces of blocks are dealt out before grams are cut. Texts are
    columns of their own first, else each gram would make them again; a text within one before it has no grams of its own."""
    dealt = rows.repartition("block", F.floor(F.col(product) / max(1, block // PIECES)))
    names = [f"_text{i}" for i in range(len(fields))]
    texts = dealt.select(F.col(product).cast("long").alias("product"), "block", *(F.coalesce(f, F.lit("")).alias(n) for f, n in zip(fields, names, strict=True)))
    own = [_grams(F.col(names[0]))]
    for i, name in enumerate(names[1:], 1):
        within = reduce(Column.__or__, (F.contains(F.col(x), F.col(name)) for x in names[:i]))
        own.append(F.when(~within, _grams(F.col(name))).otherwise(F.array().cast("array<string>")))
    return texts.select("product", "block", F.explode(F.array_distinct(F.concat(*own))).alias("gram"))


def build(products: DataFrame, path: str, product: str, fields: list[Column], block: int = BLOCK) -> None:
    """Write the index of ``fields`` (texts) of the products."""
    number = F.floor(F.col(product) / block).cast("long")
    rows = products.withColumn("block", number)
    rows.repartition("block").write.partitionBy("block").parquet(f"{path}/rows")
    lists = _pairs(rows, product, fields, block).groupBy("gram", "block").agg(F.array_sort(F.collect_list("product")).alias("products"))
    # A task has whole folders; the grams of a file are in order, so that its statistics leave most of it out.
    ordered = lists.withColumn("folder", _folder(F.col("gram"))).repartition("folder").sortWithinPartitions("folder", "gram", "block")
    ordered.write.partitionBy("folder").parquet(f"{path}/postings")


def postings(spark: SparkSession, path: str, query: str) -> DataFrame:
    """The postings of the query's grams: folders and files without them are not read."""
    grams = grams_of(query)
    folders = [r.f for r in spark.createDataFrame([(g,) for g in grams], "g string").select(_folder(F.col("g")).alias("f")).distinct().collect()] if grams else []
    return spark.read.parquet(f"{path}/postings").where(F.col("folder").isin(folders) & F.col("gram").isin(grams))


def numbers(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(block, product) of the products that have all grams of the query. One row for each gram of a block meets; blocks that lack one go."""
    lists = F.array_sort(F.collect_list(F.struct(F.size("products").alias("n"), "gram", "products")))
    met = postings(spark, path, query).groupBy("block").agg(lists.alias("lists")).where(F.size("lists") == len(grams_of(query)))
    shared = F.aggregate("lists", F.col("lists")[0]["products"], lambda found, x: F.when(F.size(found) > 0, F.array_intersect(found, x["products"])).otherwise(found))
    return met.select("block", F.explode(shared).alias("product"))


def candidates(spark: SparkSession, path: str, product: str, query: str) -> DataFrame:
    """The rows that may have ``query`` in one of the fields, as they were given to ``build``."""
    found = numbers(spark, path, query)
    rows = spark.read.parquet(f"{path}/rows")
    blocks = [r.block for r in found.select("block").distinct().limit(NAMED + 1).collect()]
    if len(blocks) <= NAMED:
        rows = rows.where(F.col("block").isin(blocks))
    kept = rows.join(found.withColumnRenamed("product", "_product"), (rows["block"] == found["block"]) & (rows[product] == F.col("_product")), "left_semi")
    return kept.drop("block")
