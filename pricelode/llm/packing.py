"""Packing: optimal length buckets and token-budget batches.

The lengths of all documents form one histogram. A dynamic program over it chooses at most
``buckets`` upper bounds that minimise the padding of every document to its bucket's
bound. A batch holds ``budget // bound`` documents of one bucket (at least one), so no text
is cut. Documents of a bucket are numbered through without gathering a bucket in one task:
they are dealt by hash of id, length and place in the table into cells of bounded size, cells get offsets from
their counts, and a document's number is its offset plus its rank in the cell.

Defined cases: a null or empty text has length 0 and is packed like others; a text longer than the budget
is a batch of its own; ties, repeated rows and null ids are packed one by one, and spread over cells as others
are; an empty table gives an empty result. Columns of the input other than id and text are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.llm.common import written

BUCKETS = 16
BUDGET = 65_536
#: Documents of a cell, about; also the cells whose counts one task adds up.
CELL = 50_000


class Bounds(NamedTuple):
    upper: list[int]  # ascending; the last is the longest length
    padding: int  # of all documents, in tokens


def choose_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> Bounds:
    """At most ``buckets`` upper bounds, out of the ascending ``lengths``, of least padding."""
    if not len(lengths):
        return Bounds([], 0)
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    real = int((lengths * counts).sum())
    m = len(lengths)
    before = np.r_[0, np.cumsum(counts)]
    # cost[j]: padded tokens of the first j lengths in k buckets
    cost = np.r_[0, lengths * before[1:]]
    origin = [np.zeros(m + 1, np.int64)]
    for _ in range(1, min(buckets, m)):
        cost, back = _one_more(cost, lengths, before)
        origin.append(back)
    upper, j = [], m
    for back in reversed(origin):
        if j == 0:
            break
        upper.append(int(lengths[j - 1]))
        j = int(back[j])
    return Bounds(sorted(upper), int(cost[m]) - real)


def _one_more(cost: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cost with one bucket more, and where that bucket begins. The best beginning never
    falls as j grows (padding is a Monge cost), so the middle of a range of j bounds those of
    both halves; all ranges of a level are worked out at once, in m log m steps altogether."""
    m = len(lengths)
    new, back = cost.copy(), np.zeros(m + 1, np.int64)
    a, b, low, high = (np.array([x]) for x in (1, m, 0, m - 1))
    while len(a):
        j = (a + b) // 2
        size = np.minimum(high, j - 1) - low + 1
        start = np.cumsum(size) - size
        i = np.repeat(low - start, size) + np.arange(size.sum())
        tried = cost[i] + np.repeat(lengths[j - 1], size) * (np.repeat(before[j], size) - before[i])
        new[j] = np.minimum.reduceat(tried, start)
        hit = np.flatnonzero(tried == np.repeat(new[j], size))
        back[j] = best = i[hit[np.searchsorted(hit, start)]]
        a, b, low, high = np.r_[a, j + 1], np.r_[j - 1, b], np.r_[low, best], np.r_[best, high]
        some = a <= b
        a, b, low, high = a[some], b[some], low[some], high[some]
    return new, back


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pack(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``lengths`` (doc_id, n_tokens; a written table, which is read more than once) with bucket,
    bucket_len, padding, batch_id (text, unique over buckets) and position in the batch."""
    histogram = lengths.groupBy("n_tokens").count().toPandas().sort_values("n_tokens")
    total = int(histogram["count"].sum()) if len(histogram) else 0
    bounds = choose_bounds(histogram["n_tokens"].to_numpy(), histogram["count"].to_numpy(), buckets)
    upper = bounds.upper or [0]
    bucket = F.lit(len(upper) - 1)
    for k in range(len(upper) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= upper[k], F.lit(k)).otherwise(bucket)
    bound = F.element_at(F.array(*(F.lit(x).cast("long") for x in upper)), F.col("bucket") + 1)
    cells = max(1, -(-total // CELL))
    placed = lengths.withColumn("bucket", bucket).withColumn("bucket_len", bound)
    # A written table has its files' rows in order: a row's name there is its own, even if its id is not.
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("doc_id", "n_tokens", file, row), F.lit(cells)).cast("int"))
    counts = placed.groupBy("bucket", "cell").agg(F.count("*").alias("n"))
    counts = counts.withColumn("block", F.floor(F.col("cell") / 1000))
    # offsets of cells: sums in blocks of 1,000 cells, then over the blocks of a bucket
    blocks = counts.groupBy("bucket", "block").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("bucket", "block").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, ["bucket", "block"])
    offsets = offsets.select("bucket", "cell", (F.col("base") + F.col("inner")).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("bucket", "cell").orderBy("doc_id", "n_tokens"))
    numbered = placed.withColumn("rank", rank).join(offsets, ["bucket", "cell"])
    number = F.col("offset") + F.col("rank") - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    numbered = numbered.withColumn("number", number).withColumn("room", room)
    return numbered.select(
        "doc_id", "n_tokens", "bucket", "bucket_len", (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        F.concat_ws("-", "bucket", F.floor(F.col("number") / F.col("room"))).alias("batch_id"), F.pmod("number", "room").cast("int").alias("position"),
    )


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per document, with the batch that it belongs to. ``length`` is any expression
    of the tokens of a document; by default its words."""
    tokens = word_count(F.col(text)) if length is None else length
    lengths = docs.select(F.col(doc_id).alias("doc_id"), tokens.cast("long").alias("n_tokens"))
    return pack(written(lengths, "lengths"), buckets, budget)
