"""Near-duplicates: texts whose sets of five-word shingles have a Jaccard similarity of ``SIMILARITY`` or more.

One rule decides every link: the exact similarity of both sets (of 64-bit hashes). Candidates come from
``BANDS`` bands of smallest hashes: whatever the edits are, (1 - 0.8 ** 3) ** 24 = 0.000003 % of the pairs at 0.8 share none; and from the
SimHash search (fingerprints of word pairs that differ in at most ``PROBE_TAU`` bits, by the generalised pigeonhole principle). The probe is as narrow as in
``simhash``: a wide one has buckets of few bits, whose comparisons grow with the square of the nodes. Sketches of 256 bits
only reject early: at the similarity asked for, the bits that differ are expected to be some 39, and pairs over
``most_bits`` (five standard deviations more) aren't looked at.

Equal sets are one node. No bucket gives all its pairs:

1. Each bucket proposes a spanning forest of its candidates, parent and child. Children's sets go to their parent's
   (a parent of very many has copies, one for ``CHUNK`` children) and are compared; proposals that hold are links, and give components.
2. Where a proposal failed, a node may be near another one of its bucket. The components that hold an end of such a proposal go through their buckets again,
   and only candidates of different components count. What these connect is a cluster of doubts; each set goes to its cluster
   once (clusters over ``CHUNK`` are dealt as pairs of blocks), and all its candidates of different components are compared until they are connected.

Links of both steps give the final components. So every candidate is compared, or its two nodes are already connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode.llm.common import checkpointed, slices, small_batches, spread_join, word_array, written
from pricelode.llm.simhash import SEED, TAU, Nodes, Plan, bit_sums, components, hash_spans, majority, nodes_of, of_buckets, plan_search, run_numbers, visits

SHINGLE = 5
SIMILARITY = 0.8
PROBE_SHINGLE = 2
PROBE_TAU = TAU
SKETCH_WORDS = 4
BANDS, BAND_ROWS = 24, 3
FIRST_BAND = 1000
#: Sets of so few shingles have sketches that say less; they are allowed as many bits as FEW_BITS.
FEW_SHINGLES = 20
FEW_BITS = 96
#: Buckets of so many rows are walked; smaller ones are compared by shifts.
FEW = 32
#: Sets that meet in a task at once.
CHUNK = 512


#: Factors of a shingle's words by their places.
_PLACES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


def word_shingles(texts: pa.Array, shingles: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of shingles a 64-bit hash of every shingle, and where each text's begin (a text with fewer words has one, of all of them). Words are
    hashed once each; a shingle adds up the hashes of its words, each times the factor of its place."""
    flat, first = word_array(texts, lower=True)
    at = np.frombuffer(flat.buffers()[1], np.int32).astype(np.int64)
    raw = np.frombuffer(flat.buffers()[2], np.uint8) if flat.buffers()[2] else np.zeros(0, np.uint8)
    word, count, out = hash_spans(raw, at[:-1], at[1:]), np.diff(first), []
    for shingle in shingles:
        own = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
        runs = np.zeros(len(count) + 1, np.int64)
        np.cumsum(own, out=runs[1:])
        lead = np.repeat(first[:-1] - runs[:-1], own) + np.arange(runs[-1])
        made = word[lead] * _PLACES[0]
        few = np.flatnonzero(np.repeat(count < shingle, own))
        left = np.repeat(count, own)[few]
        for k in range(1, shingle):
            # a short text's place behind its last word adds nothing
            more = word[np.minimum(lead + k, len(word) - 1)] * _PLACES[k]
            more[few[left <= k]] = 0
            made += more
        made = (made ^ (made >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        out.append((made ^ (made >> np.uint64(32)), runs))
    return out


def shingle_sets(made: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of each run, sorted, one run after the other, and where each begins."""
    sets = [np.unique(made[i:j]) for i, j in zip(runs[:-1], runs[1:], strict=True)]
    ends = np.cumsum([0, *map(len, sets)])
    return (np.concatenate(sets) if sets else made), ends


def sketches(made: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """For each set a fingerprint of 64 * SKETCH_WORDS bits. Its hashes are remixed for each further 64 bits."""
    out = np.empty((len(runs) - 1, SKETCH_WORDS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SKETCH_WORDS):
            mixed = (made ^ (made >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            made = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) + np.uint64(0x9E3779B97F4A7C15)
            out[:, k] = majority(made, runs)
    return out


def band_values(made: np.ndarray, runs: np.ndarray) -> list[list[int]]:
    """For each set a value of each band of smallest hashes; none for an empty set."""
    some = np.flatnonzero(np.diff(runs))
    out: list[list[int]] = [[] for _ in range(len(runs) - 1)]
    if not len(some):
        return out
    rng, begin = np.random.default_rng(SEED), runs[:-1][some]
    values, mixed = np.zeros((len(some), BANDS), np.uint64), np.empty_like(made)
    with np.errstate(over="ignore"):
        for k in range(BANDS * BAND_ROWS):
            factor, offset = rng.integers(0, 1 << 64, 2, np.uint64)
            np.multiply(made, factor | np.uint64(1), out=mixed)
            np.add(mixed, offset, out=mixed)
            least = np.minimum.reduceat(mixed, begin)
            own = values[:, k // BAND_ROWS]
            own ^= least
            own *= np.uint64(0xBF58476D1CE4E5B9)
            own ^= own >> np.uint64(31)
    for i, v in zip(some.tolist(), values.view(np.int64).tolist(), strict=True):
        out[i] = v
    return out


def most_bits(similarity: float) -> int:
    """Differing bits of two sketches that a pair of this similarity passes once in some millions: the expected number (an angle's
    share of pi; the angle is widest for sets of the same size) and five standard deviations."""
    bits = 64 * SKETCH_WORDS
    share = np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi
    return int(bits * share + 5 * np.sqrt(bits * share * (1 - share)) + 1)


def banded(nodes: DataFrame) -> DataFrame:
    """Rows like those of ``visits``: each node (with ``bands``) at those values of its bands that other
    nodes have too; the sketches join them only then. Their fingerprints are 0, so that they pass the probe."""
    lean = nodes.select("node", F.posexplode("bands").alias("part", "value"))
    shared = lean.groupBy("part", "value").count().where(F.col("count") > 1).drop("count")
    rows = lean.join(shared, ["part", "value"], "left_semi").join(nodes.select("node", "sketch"), "node")
    return rows.select((F.col("part") + FIRST_BAND).alias("part"), "value", "node", F.lit(0).cast("long").alias("fp"), "sketch", F.lit(True).alias("home"))


def _candidates(nodes: Nodes, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of rows may be near: by fingerprint, size and sketch, and not of one component. A row's words
    are its sketch, the size of its set, and its component (in the second step)."""
    hit = np.bitwise_count(nodes.fp[a] ^ nodes.fp[b]) <= PROBE_TAU
    hit &= nodes.node[a] != nodes.node[b]
    k = np.flatnonzero(hit)
    x, y = nodes.sketch[a[k]], nodes.sketch[b[k]]
    least, most = np.minimum(x[:, SKETCH_WORDS], y[:, SKETCH_WORDS]), np.maximum(x[:, SKETCH_WORDS], y[:, SKETCH_WORDS])
    fine = least >= similarity * most  # a larger set can't be near enough
    bits = np.bitwise_count(x[:, :SKETCH_WORDS] ^ y[:, :SKETCH_WORDS]).sum(axis=1)
    fine &= bits <= np.where(least > FEW_SHINGLES, most_bits(similarity), FEW_BITS)
    if x.shape[1] > SKETCH_WORDS + 1:
        fine &= x[:, SKETCH_WORDS + 1] != y[:, SKETCH_WORDS + 1]
    hit[k] = fine
    return hit


class Union:
    """Connected rows."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, i: int) -> int:
        while (j := self.up.get(i, i)) != i:
            self.up[i] = self.up.get(j, j)
            i = j
        return i

    def join(self, i: int, j: int) -> bool:
        """False if they were connected before."""
        i, j = self.top(i), self.top(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _walk(nodes: Nodes, rows: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """A spanning forest (parent, child) of the candidates among ``rows``, breadth first, so that the smallest node is the parent of all
    that it may be near."""
    rest = rows[np.argsort(nodes.node[rows], kind="stable")]
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            parent = np.full(len(rest), -1)
            for x in front.tolist():
                free = np.flatnonzero(parent < 0)
                if not len(free):
                    break
                hit = _candidates(nodes, np.full(len(free), x), rest[free], similarity)
                parent[free[hit]] = x
            taken = parent >= 0
            yield from zip(parent[taken].tolist(), rest[taken].tolist(), strict=True)
            front, rest = rest[taken], rest[~taken]


#: Rows that are compared with all others of a bucket at once.
AT_ONCE = 128


def _met(fp: np.ndarray) -> np.ndarray:
    """Which fingerprints have another one within PROBE_TAU bits. Most of a large bucket have none, and aren't walked from. A row that another one has met
    before its turn isn't compared with all once more, so equal ones cost little."""
    met, passed = np.zeros(len(fp), bool), np.zeros(0, np.int64)
    for at in range(0, len(fp), AT_ONCE):
        block = np.arange(at, min(at + AT_ONCE, len(fp)))
        todo, others = block[~met[block]], np.r_[passed, np.arange(at, len(fp))]
        near = np.bitwise_count(fp[todo, None] ^ fp[others]) <= PROBE_TAU
        near &= todo[:, None] != others
        passed = np.r_[passed, block[met[block]]]
        met[todo] |= near.any(axis=1)
        met[others[near.any(axis=0)]] = True
    return met


def forest(group: np.ndarray, nodes: Nodes, similarity: float) -> Iterator[tuple[int, int]]:
    """Rows (parent, child) of a spanning forest of the candidates in each run of equal ``group``."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[starts, len(group)])
    end = np.repeat(starts + size, size)
    left, shift, joined = np.flatnonzero(np.repeat((size > 1) & (size <= FEW), size)), 1, Union()
    while len(left):
        left = left[left + shift < end[left]]
        pair = left[nodes.home[left] | nodes.home[left + shift]]
        pair = pair[_candidates(nodes, pair, pair + shift, similarity)]
        for i in pair.tolist():
            if joined.join(i, i + shift):
                yield i, i + shift
        shift += 1
    for k in np.flatnonzero(size > FEW):
        run = np.arange(starts[k], starts[k] + size[k])
        if nodes.home[run].any():
            yield from _walk(nodes, run[_met(nodes.fp[run])], similarity)


def proposals(visited: DataFrame, similarity: float) -> DataFrame:
    """Different edges (a, b), a < b, of the forests of all buckets."""

    def edges(table: pa.Table) -> pa.RecordBatch:
        nodes = nodes_of(table, True)
        pairs = np.array(list(forest(run_numbers(table), nodes, similarity)), np.int64).reshape(-1, 2)
        ends = np.sort(nodes.node[pairs], axis=1) if len(pairs) else pairs
        ends = np.unique(ends, axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, k])) for k in (0, 1)], ["a", "b"])

    return of_buckets(visited, edges, "a long, b long").distinct()


def near(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Is the Jaccard similarity of two sorted sets high enough?"""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) or not len(x):
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    shared = int((x[at] == y).sum())
    return shared >= similarity * (len(x) + len(y) - shared)


def _sets(column: pa.Array) -> list[np.ndarray]:
    values, ends = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]
    return [values[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def sets_of(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, items): the sorted shingle hashes of the ``wanted`` (node, _row; written) of the ``table`` (_row, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                made, runs = shingle_sets(*word_shingles(part.column(1), (SHINGLE,))[0])
                lists = pa.ListArray.from_arrays(pa.array(runs.astype(np.int32)), pa.array(made.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["node", "items"])

    return table.join(wanted, "_row").select("node", "text").mapInArrow(make, "node long, items array<long>")


def near_children(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those edges (a, b; written) whose sets (written) are near. Sets of b go to those of a."""
    counts = edges.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = written(spread_join(edges, written(counts, "parents"), "a").select("a", F.pmod(F.xxhash64("b"), "chunks").cast("int").alias("chunk"), "b"), "children")
    parents = spread_join(written(dealt.select("a", "chunk").distinct(), "chunks"), sets.toDF("a", "items"), "a").select("a", "chunk", F.lit(None).cast("long").alias("b"), "items")
    children = dealt.join(sets.toDF("b", "items"), "b").select("a", "chunk", "b", "items")
    met = parents.union(children).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.asc_nulls_first("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            links = []
            a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for x, y, items in zip(a, b, _sets(batch.column(3)), strict=True):
                if y is None:
                    own = items.copy()
                elif near(own, items, similarity):
                    links.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return met.mapInArrow(compare, "a long, b long")


def near_in_clusters(members: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the roots of members (cluster, node, root, sketch, items; written) of a cluster that connect all its candidates that are near."""
    counts = members.groupBy("cluster").count().where(F.col("count") > CHUNK).select("cluster", F.ceil(F.col("count") / CHUNK).cast("int").alias("blocks"))
    dealt = members.join(counts, "cluster", "left").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, F.col("mine")) * F.col("blocks") + F.greatest(o, F.col("mine")))
    )
    met = dealt.withColumn("cell", F.explode(pairs)).select("cluster", "cell", "root", "node", "sketch", "items").repartition("cluster", "cell").sortWithinPartitions("cluster", "cell", "root", "node")

    def linked(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        """rows: (root, node, sketch, items)"""
        n = len(rows)
        words = np.frombuffer(b"".join(r[2] for r in rows), np.uint64).reshape(n, -1)
        nodes, joined = Nodes(np.array([r[1] for r in rows]), np.zeros(n, np.uint64), words, np.ones(n, bool)), Union()
        for i in range(n - 1):
            later = np.arange(i + 1, n)
            for j in later[_candidates(nodes, np.full(len(later), i), later, similarity)].tolist():
                if joined.top(rows[i][0]) != joined.top(rows[j][0]) and near(rows[i][3], rows[j][3], similarity):
                    joined.join(rows[i][0], rows[j][0])
                    yield rows[i][0], rows[j][0]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last: tuple | None = None

        def links(rows: list[tuple]) -> pa.RecordBatch:
            found = list(linked(rows)) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for cluster, cell, root, node, sketch, items in zip(*columns, _sets(batch.column(5)), strict=True):
                if (cluster, cell) != last:
                    yield links(held)
                    held, last = [], (cluster, cell)
                held.append((root, node, sketch, items.copy()))
        yield links(held)

    return met.mapInArrow(compare, "a long, b long")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest id
    (a null id is the largest; of equal ids, any one row).

    Texts link if their sets of five-word shingles (of a text with fewer words, all of them) have a Jaccard similarity of
    ``similarity`` or more, and groups are what links connect. A null text is an empty one; a text without words links to others like it."""
    small_batches(docs.sparkSession)
    own = [f"_own_{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*own).withColumn("_row", F.monotonically_increasing_id())
    t, key = (own[docs.columns.index(x)] for x in (text, doc_id))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, t):
                texts = part.column(part.schema.get_field_index(t))
                some, probe = word_shingles(texts, (SHINGLE, PROBE_SHINGLE))
                made, runs = shingle_sets(*some)
                words = np.c_[sketches(made, runs), np.diff(runs).astype(np.uint64)]
                more = [
                    pa.array(majority(*probe).view(np.int64)), pa.array([x.tobytes() for x in words], pa.binary()), pa.array(band_values(made, runs), pa.list_(pa.int64())),
                    pa.array([xxhash.xxh3_128_digest(made[i:j].tobytes()) for i, j in zip(runs[:-1], runs[1:], strict=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "_fp", "_sketch", "_bands", "_set"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields)
    table = written(inner.mapInArrow(make, f"{fields}, _fp long, _sketch binary, _bands array<long>, _set binary"), "near")
    who = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("_row").alias("row"))
    same = table.groupBy("_set").agg(F.min(F.struct(who.alias("who"), F.col("_fp").alias("fp"), F.col("_sketch").alias("sketch"), F.col("_bands").alias("bands"))).alias("first"))
    # Numbers, not hashes, name the nodes. They are fixed once written.
    nodes = written(same.select("first.*").withColumn("node", F.monotonically_increasing_id()), "nodes")
    plan = plan_search(*bit_sums(nodes), PROBE_TAU)
    edges = written(proposals(visits(nodes, plan).union(banded(nodes)), similarity), "edges")
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    wanted = written(nodes.join(ends, "node").select("node", F.col("who.row").alias("_row")), "wanted")
    sets = written(sets_of(table.select("_row", F.col(t).alias("text")), wanted), "shingles")
    links = written(near_children(edges, sets, similarity), "links")
    roots = checkpointed(components(links))
    if edges.count() > links.count():
        more = _second_step(nodes, plan, edges, roots, sets, similarity)
        if not more.isEmpty():
            tops = written(components(more), "tops")
            every = roots.union(tops.select("root", "root")).union(tops.select("node", "node")).groupBy("node").agg(F.min("root").alias("root"))
            roots = spread_join(written(every, "roots"), tops.toDF("root", "top"), "root").select("node", F.coalesce("top", "root").alias("root"))
    first = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("who").alias("who"))
    stay = first.select(F.col("who.row").alias("_row"))
    return table.join(stay, "_row", "left_semi").select(*own).toDF(*docs.columns)


def _second_step(nodes: DataFrame, plan: Plan, edges: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between components (by their roots), from candidates of different components. Two such candidates of a bucket are joined by proposals, one of
    which leaves the component of either: so both components hold an end of a proposal that failed."""
    rooted = edges
    for end in ("a", "b"):
        rooted = written(spread_join(rooted, roots.toDF(end, f"root_{end}"), end).withColumn(f"root_{end}", F.coalesce(f"root_{end}", end)), f"rooted-{end}")
    failed = rooted.where("root_a <> root_b")
    if failed.isEmpty():
        return failed.select("a", "b")
    unsettled = written(failed.select(F.col("root_a").alias("root")).union(failed.select("root_b")).distinct().withColumn("open", F.lit(True)), "unsettled")
    ends = rooted.select(F.col("a").alias("node"), F.col("root_a").alias("root")).union(rooted.select("b", "root_b")).distinct()
    doubtful = spread_join(written(ends, "ends"), unsettled, "root").where("open").select("node", "root")
    component = F.unhex(F.lpad(F.hex("root"), 16, "0"))  # one more word of the sketch; only equality counts
    again = written(nodes.join(doubtful, "node").withColumn("sketch", F.concat("sketch", component)).select("node", "fp", "sketch", "bands", "root"), "doubtful")
    doubts = written(proposals(visits(again, plan).union(banded(again)), similarity), "doubts")
    if doubts.isEmpty():
        return doubts
    clusters = checkpointed(components(doubts)).withColumnRenamed("root", "cluster")
    members = clusters.join(again.select("node", "sketch", "root"), "node").join(sets, "node").select("cluster", "node", "root", "sketch", "items")
    return written(near_in_clusters(written(members, "members"), similarity), "more-links")
