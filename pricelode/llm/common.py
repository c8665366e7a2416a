"""Helpers shared by the corpus operators: the shared folder, Arrow slices, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark hands to Python at once. Texts may be long, so this is well below Spark's default.
BATCH_ROWS = 4000
BATCH_BYTES = "8m"
#: Bytes of text that a task works on at once (a longer text is a slice of its own).
SLICE_BYTES = 4 << 20
#: Written files that one task reads back, about.
FILES_OF_TASK = 8

_own_dir: str | None = None


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``,
    or, where that is unset in local mode (tests), below a temporary folder."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="pricelode-")
        base = _own_dir
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    # with its scheme, so that tasks open the same store whatever the cluster's default is
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    place = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return f"{place.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here,
    and a lost executor costs no more than the tasks that it ran."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for the small tables of iterations."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        shared_dir(df.sparkSession, "checkpoint")
    return df.checkpoint(eager=True)


#: A key is hot if it has over 1 / HOT_SHARE of the rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 256
HOT_ROWS = 64


def hot_limit(rows: int) -> int:
    return max(HOT_ROWS, rows // HOT_SHARE)


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The left join of ``left`` (written or checkpointed: it is read three times) with the one row that
    ``right`` (the same) has for a key at most. Rows of hot keys meet theirs by broadcast, which is
    HOT_SHARE rows at most whatever the size; all others by a join that shuffles."""
    counts = left.groupBy(key).count()
    hot = checkpointed(counts.where(F.col("count") > hot_limit(left.count())).select(key))
    if hot.isEmpty():
        return left.join(right, key, "left")
    found = right.join(F.broadcast(hot), key)
    own = F.broadcast(hot.join(F.broadcast(found), key, "left"))
    return left.join(own, key).unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key, "left"))


def smallest_hashes(df: DataFrame, rows: int, salt: int, *keys: str) -> DataFrame:
    """At most ``rows`` rows: those with the smallest hash of their keys. All but about that
    many are filtered away first, so that not every task sends its own ``rows``."""
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(salt), *keys), 1)
    total = df.count()
    if total > 2 * rows:
        share = (rows + 6 * rows**0.5) / total  # six standard deviations of room
        df = df.where(hashed < int(share * 2**63))
    return df.orderBy(hashed, *keys).limit(rows)


def files_dealt(files: DataFrame, path: str = "path") -> DataFrame:
    """A manifest (it is counted first) dealt to tasks, about FILES_OF_TASK files each. The
    number is given, since Spark would join partitions of such small rows into one task."""
    n, least = files.count(), int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(max(1, min(n, max(least, n // FILES_OF_TASK))), path)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch, since whole texts travel in them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A contiguous string array without nulls (a null text is an empty one)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def offsets_of(array: pa.Array) -> np.ndarray:
    return np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, array.offset * 4)


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all strings, one after the other, and each one's offset in them."""
    offsets = offsets_of(array) if len(array) else np.zeros(1, np.int32)
    data = array.buffers()[2] if len(array) else None
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of ``text``; its nulls become empty."""
    if not batch.num_rows:
        return
    at = batch.schema.get_field_index(text)
    column = strings(batch.column(at))
    batch = batch.set_column(at, text, column)
    ends = offsets_of(column).astype(np.int64)
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


#: space, \t, \n, \v, \f, \r: words are the runs of all other bytes
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words(NamedTuple):
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts, as codes into a dictionary."""

    codes: np.ndarray  # of each word, all texts one after the other
    first: np.ndarray  # text i has the words first[i]:first[i + 1]
    names: pa.Array  # binary; names[code]


def words(texts: pa.Array, lower: bool = False) -> Words:
    flat = word_array(texts, lower)
    coded = flat[0].dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False), flat[1], coded.dictionary)


def word_array(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts as one binary array, and where each text's words begin."""
    raw, ends = bytes_of(texts)
    if lower:
        raw = _LOWER[raw]
    solid = ~_BLANK[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = ends[:-1][ends[:-1] < len(raw)]
    begins[inner] = solid[inner]  # a text's first byte begins a word even after a solid byte
    starts = np.flatnonzero(begins)
    packed = raw[solid]
    place = np.cumsum(solid, dtype=np.int32)
    at = np.empty(len(starts) + 1, np.int32)
    at[:-1] = place[starts] - 1
    at[-1] = len(packed)
    flat = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(packed)])
    return flat, np.searchsorted(starts, ends)


def doc_of(first: np.ndarray) -> np.ndarray:
    """For each word, the number of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
