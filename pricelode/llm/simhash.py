"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint is the 64-bit majority of the XXH64 hashes of a text's word shingles. Two
fingerprints link at ``tau`` or fewer differing bits. All such links are found so: the
bits are put in ``m`` groups, correlated bits together; group ``i`` gets a threshold
``t_i >= -1``, with ``sum(t_i) = tau - m + 1``, so every linked pair differs in at most
``t_i`` bits of some group (-1: the group is never looked at). A dynamic program over the
estimated candidates and rows chooses ``m`` and the thresholds. Fingerprints are then
filed under each group's bits, visit the values within ``t_i``, and are verified.

Equal fingerprints are one node. Inside a bucket a breadth-first walk gives a spanning
forest of its links, never all pairs; buckets over ``BLOCK`` nodes are dealt out as pairs of
blocks. Components come from iterated star contraction, each round checkpointed; hubs (nodes with over
1 / HOT_SHARE of the edges) meet their edges by broadcast, and so do fingerprints and components that many documents share.

Defined cases: a null or empty text, or one without words, has fingerprint zero, which
links like any other; a very long text is hashed whole; ties go to the smallest id; a repeated row is a node of its own id; rows with a null id keep
their fingerprint and component but can't name a component that has an id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode.llm.common import checkpointed, hot_limit, slices, small_batches, spread_join, word_array, written

BITS = 64
SEED = 42
SHINGLE = 4
TAU = 4
#: Fingerprints of a bucket that one block holds.
BLOCK = 2048
#: What a shuffled row costs, in comparisons of two fingerprints.
ROW_COST = 400.0
MAX_RADIUS = 2


#: A byte's bits, each in a byte of its own: sums of up to 255 of these don't overflow.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0].copy()
_SUMMED = 255


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per run ``first[i]:first[i + 1]`` of hashes, the bits set in over half of them. Bits are counted
    eight at a time, in pieces of _SUMMED hashes, and then over the pieces."""
    size = np.diff(first)
    out = np.zeros(len(size), np.uint64)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    pieces = -(-size[some] // _SUMMED)
    begin = np.cumsum(pieces) - pieces
    starts = np.repeat(first[:-1][some], pieces) + _SUMMED * (np.arange(pieces.sum()) - np.repeat(begin, pieces))
    lanes = _SPREAD[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
    counts = np.add.reduceat(lanes, starts, axis=0).view(np.uint8)
    sums = np.add.reduceat(counts, begin, axis=0, dtype=np.int64)
    set_bits = (2 * sums > size[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(set_bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint (uint64) of each text."""
    made, runs = shingle_hashes(texts, shingle)
    return majority(made, runs)


_P1, _P2, _P3, _P4, _P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Longer strings are hashed one by one.
LONG_BYTES = 512
#: Spans hashed at once, so that they stay in the processor's cache.
AT_ONCE = 32_768


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _stirred(lane: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _rotated(lane + word * _P2, 31) * _P1


def hash_spans(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of raw[begin:end] for each span. Spans with the same number of whole 8-byte words are hashed
    together, a word at a time; long ones by the library."""
    out = np.empty(len(begin), np.uint64)
    size = end - begin
    long = np.flatnonzero(size > LONG_BYTES)
    if len(long):
        whole = raw.tobytes()
        out[long] = [xxhash.xxh64_intdigest(whole[i:j], seed) for i, j in zip(begin[long].tolist(), end[long].tolist(), strict=True)]
    words = np.where(size > LONG_BYTES, -1, size >> 3)
    padded = np.zeros(len(raw) + 8, np.uint8)  # a span's last, partial word may reach behind the end
    padded[: len(raw)] = raw
    order = np.argsort(words, kind="stable")
    cuts = np.searchsorted(words[order], np.arange(LONG_BYTES // 8 + 2))
    with np.errstate(over="ignore"):
        for n in range(LONG_BYTES // 8 + 1):
            for at in range(cuts[n], cuts[n + 1], AT_ONCE):
                rows = order[at : min(at + AT_ONCE, cuts[n + 1])]
                out[rows] = _hash_alike(padded, begin[rows], size[rows], n, np.uint64(seed))
    return out


def _hash_alike(padded: np.ndarray, begin: np.ndarray, size: np.ndarray, n: int, seed: np.uint64) -> np.ndarray:
    """XXH64 of spans that all have ``n`` whole words."""
    word = np.lib.stride_tricks.sliding_window_view(padded, 8 * (n + 1))[begin].view("<u8")
    if n >= 4:
        lanes = [np.full(len(begin), x) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
        for k in range(0, n - n % 4, 4):
            lanes = [_stirred(lane, word[:, k + i]) for i, lane in enumerate(lanes)]
        h = _rotated(lanes[0], 1) + _rotated(lanes[1], 7) + _rotated(lanes[2], 12) + _rotated(lanes[3], 18)
        for lane in lanes:
            h = (h ^ _stirred(np.zeros_like(lane), lane)) * _P1 + _P4
    else:
        h = np.full(len(begin), seed + _P5)
    h = h + size.astype(np.uint64)
    for k in range(n - n % 4, n):
        h = _rotated(h ^ _stirred(np.zeros_like(h), word[:, k]), 27) * _P1 + _P4
    last, left = word[:, n], (size & 7).astype(np.int64)
    four = left >= 4
    h = np.where(four, _rotated(h ^ ((last & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3, h)
    last = np.where(four, last >> np.uint64(32), last)
    for k in range(3):
        byte = (last >> np.uint64(8 * k)) & np.uint64(0xFF)
        h = np.where((left & 3) > k, _rotated(h ^ (byte * _P5), 11) * _P1, h)
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def shingle_hashes(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle, and where each text's shingles begin."""
    return shingle_hashes_of(texts, (shingle,))[0]


def shingle_hashes_of(texts: pa.Array, shingles: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same for several lengths of shingles; the texts are cut into words once."""
    flat, first = word_array(texts, lower=True)
    at = np.frombuffer(flat.buffers()[1], np.int32)
    raw = np.frombuffer(flat.buffers()[2], np.uint8) if flat.buffers()[2] else np.zeros(0, np.uint8)
    n = len(at) - 1
    spaced = np.full(len(raw) + n, 0x20, np.uint8)  # each word with a blank behind it
    spaced[np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(at))] = raw
    begin = at[:-1].astype(np.int64) + np.arange(n)
    end = at[1:].astype(np.int64) + np.arange(n)
    count = np.diff(first)
    out = []
    for shingle in shingles:
        own = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
        runs = np.zeros(len(count) + 1, np.int64)
        np.cumsum(own, out=runs[1:])
        lead = np.repeat(first[:-1] - runs[:-1], own) + np.arange(runs[-1])
        last = np.minimum(lead + shingle - 1, np.repeat(first[1:] - 1, own))
        out.append((hash_spans(spaced, begin[lead], end[last]), runs))
    return out


def fingerprint_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) of each row."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fps = fingerprints(part.column(1), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], ["doc_id", "fp"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(make, f"doc_id {kind}, fp long")


class Plan(NamedTuple):
    """Groups of bits and their thresholds."""

    groups: list[list[int]]
    radius: list[int]


def bit_sums(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have both bit i and bit j, over all of them.
    Every task sends one row for each bit, whatever it has read."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(x), 1 << 16):
                bits = np.unpackbits(x[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(BITS, dtype=np.int32)), pa.array([n] * BITS, pa.int64()), pa.array(list(both), pa.list_(pa.float64()))],
                ["bit", "n", "both"],
            )

    sums = [F.sum(F.col("both")[j]).alias(f"b{j}") for j in range(BITS)]
    rows = fps.select("fp").mapInArrow(add, "bit int, n long, both array<double>").groupBy("bit").agg(F.sum("n").alias("n"), *sums).collect()
    both = np.zeros((BITS, BITS))
    for r in rows:
        both[r["bit"]] = [r[f"b{j}"] for j in range(BITS)]
    return (rows[0]["n"] if rows else 0), both


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of nearly equal size; each starts with a free bit and takes the bits
    that correlate most with it."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov) / np.outer(scale, scale)
    free, groups = list(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        group = [free.pop(0)]
        while len(group) < size:
            best = max(free, key=lambda j: (corr[j, group].sum(), -j))
            free.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def plan_search(n: int, both: np.ndarray, tau: int = TAU) -> Plan:
    """The number of groups, and by dynamic programming their thresholds, of least
    estimated cost: candidates (pairs of bits that agree, as all fingerprints have them)
    and rows that visit buckets."""
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    best: tuple[float, Plan] | None = None
    for m in range(2, tau + 2):
        groups, total = group_bits(n, both, m), tau - m + 1
        costs = []
        for g in groups:
            chance = np.array([1.0])
            for q in differ[g]:
                chance = np.convolve(chance, [1 - q, q])
            within, visits, cost = np.cumsum(chance), 1.0, {-1: 0.0}
            for t in range(MAX_RADIUS + 1):
                visits += (len(g) if t == 1 else len(g) * (len(g) - 1) / 2 if t == 2 else 0) / 2
                cost[t] = n * ROW_COST * visits + n * n / 2 * within[t] * visits
            costs.append(cost)
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for so_far, (c, chosen) in reach.items():
                for t, more in cost.items():
                    if (s := so_far + t) not in step or c + more < step[s][0]:
                        step[s] = (c + more, [*chosen, t])
            reach = step
        if total in reach and (best is None or reach[total][0] < best[0]):
            best = (reach[total][0], Plan(groups, reach[total][1]))
    return best[1]


def _variants(values: np.ndarray, width: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, value) of the larger values within ``radius`` bits: of two values that are so
    near, the smaller visits the larger."""
    for a in range(width):
        one = values ^ np.int64(1 << a)
        if radius >= 1:
            rows = np.flatnonzero(one > values)
            yield rows, one[rows]
        if radius >= 2:
            for b in range(a):
                two = one ^ np.int64(1 << b)
                rows = np.flatnonzero(two > values)
                yield rows, two[rows]


def visits(nodes: DataFrame, plan: Plan) -> DataFrame:
    """Rows (part, value, node, fp, sketch, home): each node at its own value of each group,
    and, with home false, at the values that it visits."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "value", "node", "fp", "sketch", "home"]

        def rows(part: int, value: np.ndarray, own: pa.RecordBatch, home: bool) -> pa.RecordBatch:
            n = own.num_rows
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(value), *own.columns, pa.array(np.full(n, home))], names)

        for batch in batches:
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for part, (group, radius) in enumerate(zip(plan.groups, plan.radius, strict=True)):
                if radius < 0:
                    continue
                value = np.zeros(len(fp), np.int64)
                for k, bit in enumerate(group):
                    value |= ((fp >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
                yield rows(part, value, batch, True)
                for at, other in _variants(value, len(group), radius):
                    if len(at):
                        yield rows(part, other, batch.take(pa.array(at)), False)

    return nodes.select("node", "fp", "sketch").mapInArrow(deal, "part int, value long, node long, fp long, sketch binary, home boolean")


class Limits(NamedTuple):
    """Most differing bits of linked fingerprints, and of their sketches if there are any."""

    tau: int
    sketch: int


class Nodes(NamedTuple):
    node: np.ndarray
    fp: np.ndarray
    sketch: np.ndarray  # (nodes, words)
    home: np.ndarray

    def at(self, rows) -> Nodes:
        return Nodes(*(x[rows] for x in self))

    def linked(self, a: np.ndarray, b: np.ndarray, limits: Limits) -> np.ndarray:
        """Which of the pairs (a[i], b[i]) of rows are links."""
        hit = np.bitwise_count(self.fp[a] ^ self.fp[b]) <= limits.tau
        if self.sketch.shape[1]:
            k = np.flatnonzero(hit)
            hit[k] = np.bitwise_count(self.sketch[a[k]] ^ self.sketch[b[k]]).sum(axis=1) <= limits.sketch
        return hit


def spanning_forest(nodes: Nodes, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, member) that join each component of the links among ``nodes``."""
    rest, roots, members = np.unique(nodes.node, return_index=True)[1], [], []
    while len(rest) > 1:
        root, front, rest = nodes.node[rest[0]], rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for at in range(0, len(front), 128):
                todo = np.flatnonzero(~near)
                if not len(todo):
                    break
                some = front[at : at + 128]
                i, j = np.nonzero(np.bitwise_count(nodes.fp[some, None] ^ nodes.fp[rest[todo]][None, :]) <= limits.tau)
                if nodes.sketch.shape[1] and len(i):
                    hit = np.zeros(len(i), bool)
                    for k in range(0, len(i), 1 << 18):
                        pair = slice(k, k + (1 << 18))
                        hit[pair] = nodes.linked(some[i[pair]], rest[todo[j[pair]]], limits)
                    j = j[hit]
                near[todo[j]] = True
            front, rest = rest[near], rest[~near]
            roots.append(np.full(len(front), root))
            members.append(nodes.node[front])
    none = np.zeros(0, np.int64)
    return np.concatenate(roots or [none]), np.concatenate(members or [none])


#: Runs of up to so many rows are compared pair by pair.
FEW = 32


def _links_of_sorted(group: np.ndarray, nodes: Nodes, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal ``group``: small runs by shifted comparison, others by walks."""
    n = len(group)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[starts, n])
    a, b = [], []
    left = np.flatnonzero(np.repeat((size > 1) & (size <= FEW), size))
    end = np.repeat(starts + size, size)
    shift = 1
    while len(left):
        left = left[left + shift < end[left]]
        pair = left[(nodes.home[left] | nodes.home[left + shift]) & (nodes.node[left] != nodes.node[left + shift])]
        pair = pair[nodes.linked(pair, pair + shift, limits)]
        a.append(nodes.node[pair])
        b.append(nodes.node[pair + shift])
        shift += 1
    for k in np.flatnonzero(size > FEW):
        run = slice(starts[k], starts[k] + size[k])
        if nodes.home[run].any():
            root, member = spanning_forest(nodes.at(run), limits)
            a.append(root)
            b.append(member)
    none = np.zeros(0, np.int64)
    return np.concatenate([*a, none]), np.concatenate([*b, none])


def links(nodes: DataFrame, limits: Limits, plan: Plan | None = None) -> DataFrame:
    """Edges (a, b), a < b, between nodes (columns node, fp, sketch; each node once) that
    connect everything within ``limits``. An empty or null sketch isn't compared."""
    return _found(visits(nodes, plan or plan_search(*bit_sums(nodes), limits.tau)), limits).select("a", "b").distinct()


def _found(visited: DataFrame, limits: Limits) -> DataFrame:
    """Edges (a, b) of the visits."""

    def edges(table: pa.Table) -> pa.RecordBatch:
        node, fp, sketch, home = nodes_of(table, limits.sketch > 0)
        x, y = _links_of_sorted(run_numbers(table), Nodes(node, fp, sketch, home), limits)
        once = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(once[:, k])) for k in (0, 1)], ["a", "b"])

    return of_buckets(visited, edges, "a long, b long")


def nodes_of(table: pa.Table, with_sketch: bool) -> Nodes:
    """The rows of buckets as arrays; a sketch is a row of 64-bit words."""
    node, fp, home = (table.column(k).to_numpy() for k in ("node", "fp", "home"))
    wide = b"".join(table.column("sketch").to_pylist()) if with_sketch else b""
    sketch = np.frombuffer(wide, np.uint64).reshape(len(node), -1) if wide else np.zeros((len(node), 0), np.uint64)
    return Nodes(node, fp.view(np.uint64), sketch, home)


def run_numbers(table: pa.Table) -> np.ndarray:
    """For each row the number of its bucket; rows are in order of their buckets."""
    change = np.zeros(max(len(table) - 1, 0), bool)
    for k in ("cell", "part", "value"):
        column = table.column(k).to_numpy()
        change |= column[1:] != column[:-1]
    return np.r_[0, np.cumsum(change)]


def of_buckets(visited: DataFrame, find: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``find`` over the rows of whole buckets (part, value); buckets over BLOCK rows are dealt as pairs of blocks, each a
    bucket of its own (cell)."""
    heavy = visited.groupBy("part", "value").count().where(F.col("count") > BLOCK)
    heavy = heavy.withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    # One row for BLOCK visits at most; Spark broadcasts it where it is small enough.
    dealt = visited.join(heavy, ["part", "value"], "left").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, F.col("mine")) * F.col("blocks") + F.greatest(o, F.col("mine")))
    )
    dealt = dealt.withColumn("cell", F.explode(pairs)).select(F.xxhash64("part", "value", "cell").alias("cell"), "part", "value", "node", "fp", "sketch", "home")
    dealt = dealt.repartition("cell").sortWithinPartitions("cell", "part", "value")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of a bucket that may go on in the next batch
        key: tuple | None = None
        whole = lambda rows: find(pa.Table.from_batches(rows).combine_chunks())
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            cut = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1]))
            if held and key != tuple(c[0] for c in cols):
                yield whole(held)
                held = []
            last = int(cut[-1]) + 1 if len(cut) else 0
            if last:
                yield whole([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
            key = tuple(c[-1] for c in cols)
        if held:
            yield whole(held)

    return dealt.mapInArrow(scan, schema)


#: Rows of a task in the rounds of components; small graphs have few tasks and files.
TASK_ROWS = 50_000


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (of about so many rows) in tasks of TASK_ROWS or more."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its
    component. Alternating large and small stars until all edges lie in stars that share no node."""
    edges = checkpointed(edges.select("a", "b").where(F.col("a") != F.col("b")))
    total = edges.count()
    edges = few_tasks(edges, total)
    while True:
        for large in (True, False):
            both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            if not large:
                both = both.where(F.col("b") < F.col("a"))
            least = checkpointed(few_tasks(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("least"), F.count("*").alias("n")), total))
            hub = F.col("n") > hot_limit(2 * total)
            hubs = F.broadcast(least.where(hub).drop("n"))  # HOT_SHARE rows at most, whatever the size
            rest = both.join(hubs, "a", "left_anti").join(least.where(~hub).drop("n"), "a")
            moved = both.join(hubs, "a").unionByName(rest)
            if large:
                made = moved.where(F.col("b") > F.col("a")).select("b", "least")
            else:
                made = moved.where(F.col("b") != F.col("least")).select("b", "least").union(least.select("a", "least"))
            edges = made.toDF("x", "y").where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = checkpointed(few_tasks(edges, total))
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("root"), F.lit(0).alias("leaf")).union(edges.select("b", F.lit(0), F.lit(1)))
        seen = ends.groupBy("node").agg(F.max("root").alias("root"), F.sum("leaf").alias("leaf"))
        total, tied = seen.agg(F.coalesce(F.sum("leaf"), F.lit(0)), F.count_if(F.col("root") + F.col("leaf") > 1)).first()
        if not tied:
            break
    pairs = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return pairs.groupBy("node").agg(F.min("root").alias("root")).union(edges.select(F.col("a"), F.col("a")).distinct())


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, tau: int = TAU) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id that its links reach."""
    table = written(fingerprint_table(docs, doc_id, text, shingle), "fingerprints")
    nodes = written(table.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    graph = nodes.select(F.col("fp").alias("node"), "fp", F.lit(None).cast("binary").alias("sketch"))
    roots = checkpointed(components(links(graph, Limits(tau, 0))))
    named = nodes.join(roots, nodes["fp"] == roots["node"]).groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = spread_join(roots, checkpointed(named), "root").select(F.col("node").alias("fp"), "component_id")
    whole = written(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id")), "whole")
    return spread_join(table, whole, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
