"""Exact duplicates by deterministic block naming.

A text, lower-cased A-Z, is cut into blocks of ``BLOCK`` bytes (the last one shorter; an empty text is one empty
block). All different blocks are sorted and numbered: a block's number is its name. Then the names at
places 2i and 2i + 1 of a text form a pair (a last name without a partner pairs with none), all different pairs are
sorted and numbered, and so on, until each text has one name. Texts of as many blocks have equal names
if and only if they are equal, so (blocks, name) is an identity without collisions.

Blocks are shuffled once. Each task sends a block once, so a block that a third of the texts share
arrives once from each task. Texts refer to their blocks by a 128-bit key; while the sorted blocks are numbered,
blocks of equal keys are compared byte by byte, and if any differ, everything is done again with keys of another seed. So
equal keys are proven to be equal blocks of this table. Texts that are done leave the rounds: each round
has half the rows of the one before it at most. Hot blocks, pairs and texts meet their names by broadcast (``spread_join``).

Defined cases: a null text counts as empty; a very long text has more blocks, and a round more for each doubling; of equal texts the row with the
largest id stays (null ids are smallest; of equal ids, one row); a repeated row is a row of its own group; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode.llm.common import checkpointed, slices, small_batches, spread_join, written

#: Bytes of a block.
BLOCK = 8192
#: A task forgets the blocks that it has sent when they reach so many bytes.
REMEMBERED = 64 << 20
SEEDS = 8
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def block_key(block: bytes, seed: int) -> bytes:
    return xxhash.xxh3_128_digest(block, seed)


def _blocks(text: str, size: int) -> tuple[bytes, list[bytes]]:
    low = text.encode().translate(_LOWER)
    return low, [low[i : i + size] for i in range(0, len(low), size)] or [b""]


def block_refs(docs: DataFrame, doc_id: str, text: str, size: int, seed: int) -> DataFrame:
    """(row, doc_id, text_sha256, keys): the keys of each row's blocks, in order."""
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                digests, keys = [], []
                for x in part.column(2).to_pylist():
                    low, cut = _blocks(x, size)
                    digests.append(hashlib.sha256(low).hexdigest())
                    keys.append([block_key(b, seed) for b in cut])
                made = [pa.array(digests, pa.string()), pa.array(keys, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], ["row", "doc_id", "text_sha256", "keys"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(make, f"row long, doc_id {kind}, text_sha256 string, keys array<binary>")


def block_names(docs: DataFrame, text: str, size: int, seed: int) -> DataFrame:
    """(key, same, name) of all different blocks, numbered in the order of their keys within each partition
    and of the partitions; ``same`` is false if another block has that key."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, bytes] = {}
        held = 0
        for batch in batches:
            for part in slices(batch, "text"):
                keys, blocks = [], []
                for x in part.column(0).to_pylist():
                    for block in _blocks(x, size)[1]:
                        key = block_key(block, seed)
                        if sent.get(key) != block:
                            sent[key] = block
                            held += len(block) + 100
                            keys.append(key)
                            blocks.append(block)
                if held > REMEMBERED:
                    sent, held = {}, 0
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(blocks, pa.binary())], ["key", "block"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, bytes | None] = (None, None)
        for batch in batches:
            keys, same = [], []
            for key, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (key, block) != last:
                    keys.append(key)
                    same.append(key != last[0])
                    last = (key, block)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(same, pa.bool_())], ["key", "same"])

    sent = docs.select(F.col(text).alias("text")).mapInArrow(send, "key binary, block binary")
    in_order = sent.repartition("key").sortWithinPartitions("key", "block")
    return in_order.mapInArrow(once, "key binary, same boolean").withColumn("name", F.monotonically_increasing_id())


def dense(names: DataFrame) -> DataFrame:
    """``names`` (written) with numbers without gaps, in the order of those that it has."""
    part = F.shiftright("name", 33)
    sizes = names.groupBy(part.alias("part")).agg((F.max(F.col("name").bitwiseAND(F.lit((1 << 33) - 1))) + 1).alias("n")).orderBy("part").collect()
    before, starts = 0, []  # one row for each partition
    for r in sizes:
        starts.append((r["part"], before))
        before += r["n"]
    starts = F.broadcast(names.sparkSession.createDataFrame(starts, "part long, before long"))
    numbered = names.join(starts, part == starts["part"])
    return numbered.withColumn("name", F.col("before") + F.col("name").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "before")


def text_names(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = BLOCK) -> DataFrame:
    """(row, doc_id, text_sha256, blocks, name): one row for each row; (blocks, name) is the identity of its text."""
    small_batches(docs.sparkSession)
    for seed in range(SEEDS):
        names = written(block_names(docs, text, size, seed), "block-names")
        if names.where(~F.col("same")).isEmpty():
            break
    else:
        raise RuntimeError(f"different blocks share a key for each of {SEEDS} seeds")
    refs = written(block_refs(docs, doc_id, text, size, seed), "block-refs")
    names = written(dense(names.select("key", "name")), "names")
    places = written(refs.select("row", F.size("keys").alias("left"), F.posexplode("keys").alias("at", "key")), "places")
    named = spread_join(places, names, "key").select("row", "left", "at", "name")
    done: DataFrame | None = None
    while True:
        named = written(named, "named")
        single = named.where("left = 1").select("row", "name")
        done = single if done is None else done.unionByName(single)
        rest = named.where("left > 1")
        if rest.isEmpty():
            break
        half = rest.groupBy("row", F.shiftright("at", 1).alias("at")).agg(
            F.first("left").alias("left"), F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("first"), F.max(F.when(F.col("at") % 2 == 1, F.col("name"))).alias("second")
        )
        # the halves of a key: both names, -1 for none
        half = written(half.select("row", F.shiftright(F.col("left") + 1, 1).alias("left"), "at", F.struct("first", F.coalesce("second", F.lit(-1)).alias("second")).alias("pair")), "pairs")
        pairs = half.select("pair").distinct().sortWithinPartitions("pair").withColumn("name", F.monotonically_increasing_id())
        pairs = written(dense(written(pairs, "pair-names")), "names")
        named = spread_join(half, pairs, "pair").select("row", "left", "at", "name")
    whole = written(done, "text-names")
    return refs.select("row", "doc_id", "text_sha256", F.size("keys").alias("blocks")).join(whole, "row")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (the id of the row that stays of its equal texts), group_size, kept,
    text_sha256, and the identity (blocks, name)."""
    rows = written(text_names(docs, doc_id, text, size).withColumn("identity", F.struct("blocks", "name")), "identities")
    groups = checkpointed(rows.groupBy("identity").agg(F.max(F.struct("doc_id", (-F.col("row")).alias("back"))).alias("stays"), F.count("*").alias("group_size")))
    kept = -F.col("row") == F.col("stays.back")
    return spread_join(rows, groups, "identity").select("doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "blocks", "name")


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the largest id."""
    own = [f"_own_{i}" for i in range(len(docs.columns))]
    table = written(docs.toDF(*own).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    t, key = (own[docs.columns.index(x)] for x in (text, doc_id))
    groups = exact_groups(table.select(F.struct(F.col(key).alias("id"), (-F.col("_row")).alias("back")).alias("who"), t), "who", t, size)
    stay = groups.where("kept").select((-F.col("doc_id.back")).alias("_row"))
    return table.join(stay, "_row", "left_semi").select(*own).toDF(*docs.columns)
