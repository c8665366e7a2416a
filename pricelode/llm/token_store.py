"""Token-ID output: one wavelet matrix file per shard.

Documents are dealt by ranges of doc_id, sorted, encoded, and written in shards of at most
``SHARD_TOKENS`` ids (a longer document is a shard of its own). A shard file holds a header,
the documents' ids and token counts, and the ids as a wavelet matrix: one bit-plane per bit
of the largest id, most significant first, each stably sorted by the bits above it, with the
number of ones before every ``RANK_STEP`` bits. Planes are zstandard-compressed one by one.
From one file, ``WaveletShard`` answers access, rank (counting), select (occurrences) and
decodes all ids. Shards are named by the attempt that wrote them and listed in a manifest,
a Parquet table, so a retried task leaves no doubt which files count.

Encoding: a text is cut where the byte-level pre-tokenizer cuts too, whatever stands around
(``chunk_begins``); distinct chunks are encoded once, by the tokenizers library, and their
ids gathered. Texts with the special token's string go through the library whole.

Defined cases: a null or empty text has only the end id; a very long text is encoded whole and is a shard of
its own; a null id sorts first; equal ids (ties) stand in the order in which they were read; repeated
rows are written one by one, by several tasks if there are many; an id may hold any characters; an empty table gives no shards and an empty result; other
columns are ignored.
"""

from __future__ import annotations

import io
import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelode.llm.common import bytes_of, files_dealt, shared_dir, slices, small_batches, strings, written
from pricelode.llm.files import open_file, write_file

END_ID = 2
SHARD_TOKENS = 1 << 21
RANK_STEP = 512
MAGIC = b"PLWM0002"
#: Chunks that a worker process remembers (twice that at most).
CHUNKS = 350_000
#: Bytes of text cut at once: the more, the fewer chunks are looked up twice.
CUT_BYTES = 8 << 20

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[list(b".,!?*#$%&;:|")] = True
_ASCII_SOLID = np.zeros(256, bool)
_ASCII_SOLID[0x21:0x7F] = True
#: First bytes of characters none of which is a blank.
_SOLID_LEAD = _ASCII_SOLID.copy()
_SOLID_LEAD[[*range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True


def chunk_begins(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where texts can be cut and each chunk encoded alone: at a text's begin, before a
    blank between two solid characters, and between an ASCII letter and a sign. There the
    pre-tokenizer cuts too, whatever else a text holds."""
    begins = np.zeros(len(raw) + 1, bool)
    if len(raw) > 2:
        before = _ASCII_SOLID[raw]
        before[1:] |= raw[:-1] == 0xC3  # the last byte of a Latin-1 letter
        begins[1:-2] = (raw[1:-1] == 0x20) & before[:-2] & _SOLID_LEAD[raw[2:]]
        begins[1:-1] |= _SIGN[raw[1:]] & _ASCII_LETTER[raw[:-1]]
    begins[ends[:-1]] = True
    return begins[:-1]


class Memory:
    """A dictionary of two generations: what a full generation knew is kept until the next
    is full, and moves over when asked for."""

    def __init__(self, size: int) -> None:
        self.size, self.new, self.old = size, {}, {}

    def get(self, key: bytes) -> bytes | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: bytes, value: bytes) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


class ChunkEncoder:
    """Ids of whole texts, through the library, chunk by chunk."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Memory(CHUNKS)

    def ids_of(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of distinct chunks, as little-endian 32-bit words."""
        get = self.known.get
        out = [get(c) for c in chunks]
        new = [i for i, ids in enumerate(out) if ids is None]
        found = self.tokenizer.encode_batch_fast([chunks[i].decode() for i in new], add_special_tokens=False)
        for i, x in zip(new, found, strict=True):
            out[i] = array("I", x.ids).tobytes()
            self.known.put(chunks[i], out[i])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32), and where each text's begin."""
        raw, ends = bytes_of(texts)
        begins = chunk_begins(raw, ends)
        for s in self.special:  # such a text is one chunk
            for i in np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False)):
                begins[ends[i] + 1 : ends[i + 1]] = False
        starts = np.flatnonzero(begins)
        first = np.searchsorted(starts, ends)
        at = np.r_[starts, len(raw)].astype(np.int32)
        flat = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = flat.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        made = self.ids_of(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, made), np.int64, len(made)) // 4
        pool = np.frombuffer(b"".join(made), np.uint32)
        counts = size[code]
        stop = np.cumsum(counts)
        total = int(stop[-1]) if len(stop) else 0
        shift = (np.cumsum(size) - size)[code] - (stop - counts)
        ids = pool[np.repeat(shift, counts) + np.arange(total)]
        return ids, np.r_[0, stop][first]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> ChunkEncoder:
    """One encoder for all tasks of a worker process."""
    return ChunkEncoder(path)


def wavelet_planes(ids: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(bits, zeros) of each plane, most significant first."""
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    row = ids.astype(np.uint16 if width <= 16 else np.uint32)
    for k in range(width - 1, -1, -1):
        bits = ((row >> k) & 1).astype(bool)
        yield bits, len(bits) - int(np.count_nonzero(bits))
        row = np.concatenate([row[~bits], row[bits]])


def pack_shard(doc_ids: list, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard file: documents (ids as a JSON list of texts, null for null), ``ends`` of their tokens, planes."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    out = io.BytesIO()
    planes = list(wavelet_planes(ids))
    table = json.dumps([None if d is None else str(d) for d in doc_ids]).encode()
    out.write(MAGIC + struct.pack("<QQI", len(doc_ids), len(ids), len(planes)))
    for raw in (table, np.asarray(ends, "<i8").tobytes()):
        block = squeeze(raw)
        out.write(struct.pack("<Q", len(block)) + block)
    for bits, zeros in planes:
        steps = np.add.reduceat(bits, np.arange(0, len(bits), RANK_STEP), dtype=np.uint32) if len(bits) else np.zeros(0, np.uint32)
        ranks = np.r_[0, np.cumsum(steps)].astype("<u4")
        block = squeeze(np.packbits(bits, bitorder="little").tobytes())
        ranked = squeeze(ranks.tobytes())
        out.write(struct.pack("<QQQ", zeros, len(block), len(ranked)) + block + ranked)
    return out.getvalue()


class WaveletShard:
    """A shard read back, with its planes as packed bits."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != MAGIC:
            raise ValueError("not a shard file")
        self.n_docs, self.n_tokens, n_planes = struct.unpack_from("<QQI", raw, 8)
        at = 28
        blocks = []
        for _ in range(2):
            (size,) = struct.unpack_from("<Q", raw, at)
            blocks.append(zstandard.decompress(raw[at + 8 : at + 8 + size]))
            at += 8 + size
        self.doc_ids = json.loads(blocks[0])
        self.ends = np.frombuffer(blocks[1], "<i8")
        self.zeros, self.bits, self.ranks = [], [], []
        for _ in range(n_planes):
            zeros, a, b = struct.unpack_from("<QQQ", raw, at)
            at += 24
            packed = np.frombuffer(zstandard.decompress(raw[at : at + a]), np.uint8)
            self.bits.append(packed)
            self.ranks.append(np.frombuffer(zstandard.decompress(raw[at + a : at + a + b]), "<u4"))
            self.zeros.append(zeros)
            at += a + b

    def _bit(self, plane: int, i: int) -> int:
        return int(self.bits[plane][i >> 3] >> (i & 7)) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones before position i of a plane."""
        step = i // RANK_STEP
        begin = step * RANK_STEP // 8
        whole = self.bits[plane][begin : i >> 3]
        last = int(self.bits[plane][i >> 3]) & ((1 << (i & 7)) - 1) if i & 7 else 0
        return int(self.ranks[plane][step]) + int(np.bitwise_count(whole).sum()) + last.bit_count()

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for plane in range(len(self.bits)):
            bit = self._bit(plane, i)
            value = value << 1 | bit
            ones = self._ones(plane, i)
            i = self.zeros[plane] + ones if bit else i - ones
        return value

    def rank(self, token: int, i: int) -> int:
        """Occurrences of an id before position i."""
        if token >> len(self.bits):
            return 0
        begin, end = 0, i
        for plane in range(len(self.bits)):
            a, b = self._ones(plane, begin), self._ones(plane, end)
            begin, end = (self.zeros[plane] + a, self.zeros[plane] + b) if token >> (len(self.bits) - 1 - plane) & 1 else (begin - a, end - b)
        return end - begin

    def count(self, token: int) -> int:
        return self.rank(token, self.n_tokens)

    def select(self, token: int, k: int) -> int:
        """The position of occurrence k (from 0) of an id."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        begin = 0
        for plane in range(len(self.bits)):
            ones = self._ones(plane, begin)
            begin = self.zeros[plane] + ones if token >> (len(self.bits) - 1 - plane) & 1 else begin - ones
        at = begin + k
        for plane in range(len(self.bits) - 1, -1, -1):
            bit = token >> (len(self.bits) - 1 - plane) & 1
            at = self._find(plane, at - self.zeros[plane] if bit else at, bit)
        return at

    def _find(self, plane: int, k: int, bit: int) -> int:
        """The position of the k-th bit of a kind in a plane."""
        ranks = self.ranks[plane].astype(np.int64)
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * RANK_STEP, self.n_tokens) - ranks
        step = int(np.searchsorted(before, k, side="right")) - 1
        begin = step * RANK_STEP
        some = np.unpackbits(self.bits[plane][begin // 8 : begin // 8 + RANK_STEP // 8], bitorder="little")[: self.n_tokens - begin]
        return begin + int(np.flatnonzero(some == bit)[k - before[step]])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def all_ids(self) -> np.ndarray:
        """All ids (uint32) in order, from the last plane up."""
        row = np.zeros(self.n_tokens, np.uint32 if len(self.bits) > 16 else np.uint16)
        for plane in range(len(self.bits) - 1, -1, -1):
            bits = np.unpackbits(self.bits[plane], count=self.n_tokens, bitorder="little").astype(bool)
            upper = np.empty_like(row)
            upper[~bits] = row[: self.zeros[plane]]
            upper[bits] = row[self.zeros[plane] :] | (1 << (len(self.bits) - 1 - plane))
            row = upper
        return row.astype(np.uint32)


def write_shards(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shard files; returns their manifest: part, shard, path, n_docs, n_tokens."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or shared_dir(spark, "tokens")
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    # A row's number parts repeated and null ids, so that no task gets all of them.
    ranged = narrow.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, attempt = encoder_of(tokenizer_path), uuid.uuid4().hex
        held_docs: list = []
        held_ids: list[np.ndarray] = []
        held_ends: list[int] = []
        size = part = shard = 0

        def flush() -> pa.RecordBatch:
            nonlocal size, shard
            path = f"{folder}/{part:06d}-{shard:06d}-{attempt}.plwm"
            ids = np.concatenate([*held_ids, np.zeros(0, np.uint32)])
            write_file(path, pack_shard(held_docs, np.array(held_ends), ids))
            row = [[part], [shard], [path], [len(held_docs)], [len(ids)]]
            held_docs.clear(), held_ids.clear(), held_ends.clear()
            size, shard = 0, shard + 1
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["part", "shard", "path", "n_docs", "n_tokens"])

        for batch in batches:
            for piece in slices(batch, "text", CUT_BYTES):
                part = piece.column(2)[0].as_py()
                ids, first = encoder.encode(strings(piece.column(1)))
                for i, d in enumerate(piece.column(0).to_pylist()):
                    own = np.append(ids[first[i] : first[i + 1]], np.uint32(END_ID))
                    if held_docs and size + len(own) > shard_tokens:
                        yield flush()
                    held_docs.append(d)
                    held_ids.append(own)
                    size += len(own)
                    held_ends.append(size)
        if held_docs:
            yield flush()

    manifest = ranged.mapInArrow(write, "part int, shard int, path string, n_docs long, n_tokens long")
    return written(manifest, "manifest")


#: Shards whose sizes one task adds up.
SHARD_BLOCK = 1000


def read_shards(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone; ``start``
    counts the ids of all documents before it, over all shards."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.floor(F.col("part") / SHARD_BLOCK))
    blocks = parts.groupBy("block").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, "block")
    own = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("own", F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).join(parts.select("part", "inner", "base"), "part")
    placed = placed.select("path", (F.col("base") + F.col("inner") + F.col("own")).alias("start"))
    placed = files_dealt(placed)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = WaveletShard(open_file(path))
                raw = shard.all_ids().astype("<u4").tobytes()
                ends = shard.ends.tolist()
                begins = [0, *ends[:-1]]
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.string()), pa.array(np.array(begins, np.int64) + start), pa.array(np.array(ends, np.int64) - np.array(begins, np.int64)), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    found = placed.mapInArrow(read, "doc_id string, start long, n_tokens long, ids_crc32 long")
    return found.withColumn("doc_id", F.col("doc_id").cast(id_type))


def token_store(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes all documents and reads them back: doc_id, start, n_tokens, ids_crc32."""
    manifest = write_shards(docs, tokenizer_path, doc_id, text)
    return read_shards(manifest, docs.schema[doc_id].dataType.simpleString())
