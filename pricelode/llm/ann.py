"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

A tree of unit centroids is fitted to a bounded sample (the ``FIT_ROWS`` vectors with the smallest
hash of their id, or four for each leaf where there are over ``MOST_LEAVES``: 8 times the root of the number of vectors); its leaves split all vectors. A query walks the tree with a priority
queue, nearest node first (a node is compared with the query when its parent is taken), and visits as many leaves as calibration asks for: for
``CALIBRATION`` queries the true neighbours are found over all vectors, and visits widen until
``TARGET`` of these lie in visited leaves.

A query whose visited leaves hold too few vectors goes on until they hold enough.

Equal vectors are one point that keeps its smallest ids, as many as a result can hold; so a
vector that a third of the rows share is compared once. Neighbouring leaves form shards of about BLOCK points, as many
shards as the points need; a leaf with more is cut into blocks. A query goes to the shards of the leaves that it visits, and
to no others; its unit of work compares a block of points with up to QUERY_BLOCK queries and
gives one row for each; these are merged at the end. So what is shuffled follows the leaves
visited. Scores are cosines in double precision, of the original vectors.

Defined cases: vectors that are null, zero, of another length than the most frequent one,
or hold a null or non-finite component take no part, as query or candidate; a query with
fewer candidates gets them all; ties go to the smaller id; repeated ids are separate rows
(a query never finds its own id); long vectors are compared whole; null ids take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.llm.common import smallest_hashes, spread_join, written

NEIGHBOURS = 5
FIT_ROWS = 20_000
BRANCHES = 8
#: Vectors of a leaf, about, up to so many leaves; from there on leaves and their vectors both grow as the root of the table.
LEAF_ROWS = 200
MOST_LEAVES = 4096
SAMPLED = 4
CALIBRATION = 96
TARGET = 0.97
#: Points and queries of a unit of work, about, and queries that it scores at once.
BLOCK = 2048
QUERY_BLOCK = 8192
STEP = 256


class Tree(NamedTuple):
    """Nodes in order of creation; node 0 is the root."""

    centroids: np.ndarray  # (nodes, dimensions), of length 1
    children: list[list[int]]
    leaf: np.ndarray  # a leaf's number, -1 for inner nodes

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector, by the nearest child at every level."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            best = (x[rows] @ self.centroids[kids].T).argmax(axis=1)
            todo += [(kid, rows[best == k]) for k, kid in enumerate(kids) if (best == k).any()]
        return out

    def visits(self, query: np.ndarray, most: int, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``most`` leaves, best bin first (the queue holds every branch not taken), and more
        while these hold fewer than ``least`` ids (``held``: of each leaf)."""
        return self.walk(query, most, held, least)[0]

    def walk(self, query: np.ndarray, most: int, held: np.ndarray | None = None, least: int = 0) -> tuple[list[int], int]:
        """These leaves, and the nodes that were compared with the query: the children of nodes that were taken, no others."""
        queue, found, ids, scored = [(0.0, 0)], [], 0, 0
        while queue and (len(found) < most or ids < least):
            _, node = heapq.heappop(queue)
            while self.children[node]:
                kids = self.children[node]
                near = self.centroids[kids] @ query
                scored += len(kids)
                first = int(near.argmax())
                for k, kid in enumerate(kids):
                    if k != first:
                        heapq.heappush(queue, (-float(near[k]), kid))
                node = kids[first]
            found.append(int(self.leaf[node]))
            ids += int(held[found[-1]]) if held is not None else least
        return found, scored


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; the label of each row."""
    centres = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), np.int64)
    for _ in range(12):
        label = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        fresh = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
        if np.allclose(fresh, centres):
            break
        centres = fresh
    return label


def leaves_for(total: int) -> int:
    """Leaves of a tree over so many vectors: the tree is small enough for one machine at any size of the table."""
    return max(1, min(total // LEAF_ROWS, max(MOST_LEAVES, 2 * math.isqrt(total))))


def fit_tree(sample: np.ndarray, total: int, seed: int = 7) -> Tree:
    """A tree over a sample of ``total`` unit vectors, with leaves of about LEAF_ROWS of them;
    a leaf keeps four or more of the sample's."""
    leaves = leaves_for(total)
    least = max(SAMPLED, len(sample) // leaves)
    rng = np.random.default_rng(seed)
    centroids, children, rows = [], [], [np.arange(len(sample))]
    at = 0
    while at < len(rows):
        x = sample[rows[at]]
        mean = x.mean(axis=0) if len(x) else np.zeros(sample.shape[1])
        centroids.append(mean / max(np.linalg.norm(mean), 1e-12))
        children.append([])
        if len(x) > least:
            label = _kmeans(x, min(BRANCHES, max(2, len(x) // least), len(x)), rng)
            groups = [rows[at][label == k] for k in np.unique(label)]
            if len(groups) > 1:
                children[at] = list(range(len(rows), len(rows) + len(groups)))
                rows += groups
        at += 1
    leaf = np.full(len(rows), -1, np.int32)
    ends = [i for i, c in enumerate(children) if not c]
    leaf[ends] = np.arange(len(ends))
    return Tree(np.array(centroids).reshape(len(rows), -1), children, leaf)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as (rows, dimensions) of float64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of the largest or smallest floats stay finite and above zero
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def best_of(a: np.ndarray, b: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of ``a`` (unit vectors) its number, and the rows of ``b`` that could be among its ``k``
    nearest, with their cosines. A product of matrices finds them; each cosine is then summed by itself, so that
    equal pairs of vectors get equal scores in whatever block they meet."""
    for at in range(0, len(a), STEP):
        near = a[at : at + STEP] @ b.T
        kth = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -np.inf)
        rows, cols = np.nonzero(near >= kth[:, None] - 1e-9)
        score = np.concatenate([(a[at + rows[i : i + 65_536]] * b[cols[i : i + 65_536]]).sum(axis=1) for i in range(0, len(rows), 65_536)])
        cut = np.searchsorted(rows, np.arange(len(near) + 1))
        for i in range(len(near)):
            own = slice(cut[i], cut[i + 1])
            yield at + i, cols[own], score[own]


def shards_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each leaf, by the points that leaves have, and the blocks of each shard."""
    shard, held, out = 0, 0, np.zeros(len(sizes), np.int32)
    for leaf, n in enumerate(sizes.tolist()):
        if held and held + n > BLOCK:
            shard, held = shard + 1, 0
        out[leaf] = shard
        held += n
    return out, np.maximum(1, -(-np.bincount(out, sizes).astype(np.int64) // BLOCK))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    own = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    size = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    fit = own.where((F.size("v") == (size["n"] if size else 0)) & (F.size("v") > 0) & ~F.exists("v", bad))
    return fit.where(F.exists("v", lambda x: x != 0))


def _sample(points: DataFrame, rows: int, salt: int, key: str = "least_id") -> np.ndarray:
    """The vectors of ``rows`` points with the smallest hash of their id."""
    found = smallest_hashes(points.select(key, "v"), rows, salt, key).select("v").toArrow()
    return _matrix(found.column(0).combine_chunks()) if found.num_rows else np.zeros((0, 1))


def _needed_visits(points: DataFrame, tree: Tree, queries: np.ndarray, k: int, target: float) -> int:
    """Leaf visits after which ``target`` of the queries' true neighbours, over all points,
    lie in visited leaves."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: list[pd.DataFrame] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, x = batch.column(0).to_numpy(), unit(_matrix(batch.column(1)))
            near = unit(queries) @ x.T
            top = np.argsort(-near, axis=1)[:, : k + 1]
            q = np.repeat(np.arange(len(queries)), top.shape[1])
            keep.append(pd.DataFrame({"q": q.astype(np.int32), "leaf": leaf[top.ravel()], "score": near[q, top.ravel()]}))
            keep = [pd.concat(keep).sort_values("score", ascending=False).groupby("q").head(k + 1)]
        for f in keep:
            yield pa.RecordBatch.from_pandas(f, preserve_index=False)

    found = points.select("leaf", "v").mapInArrow(best, "q int, leaf int, score double")
    # the query itself is the nearest: places 2 to k + 1 are its neighbours
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    true = found.withColumn("place", place).where((F.col("place") > 1) & (F.col("place") <= k + 1)).select("q", "leaf").toPandas()
    if not len(true):
        return tree.leaves
    rank = {}
    for q in range(len(queries)):
        rank[q] = {leaf: i + 1 for i, leaf in enumerate(tree.visits(unit(queries[q : q + 1])[0], tree.leaves))}
    need = np.sort([rank[q][leaf] for q, leaf in zip(true["q"], true["leaf"], strict=True)])
    return int(need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)])


def nearest(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = NEIGHBOURS, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row where ``is_query``
    (an expression of ``vec_id``) holds; and how many leaves it visited, of how many, and how many nodes it was compared with."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    # A point keeps the k + 1 smallest ids of its vector: one may be the query's own.
    order = Window.partitionBy("v").orderBy("vec_id")
    ids = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    points = ids.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("least_id", F.col("ids")[0])
    points = written(points, "points")
    total = points.count()
    schema = "query_id long, rank int, vec_id long, score double, visited int, leaves int, compared int"
    if not total:
        return spark.createDataFrame([], schema)
    tree = fit_tree(unit(_sample(points, max(FIT_ROWS, SAMPLED * leaves_for(total)), 1)), total)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.assign(unit(_matrix(batch.column(0))))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], ["leaf", *batch.schema.names])

    points = written(points.select("v", "ids", "least_id").mapInArrow(place, "leaf int, v array<double>, ids array<long>, least_id long"), "leaves")
    visits = min(tree.leaves, max(1, _needed_visits(points, tree, _sample(points, CALIBRATION, 2), k, target)))

    # One row for each leaf of the tree.
    counts = points.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect()
    size, held = np.zeros(tree.leaves, np.int64), np.zeros(tree.leaves, np.int64)
    for r in counts:
        size[r["leaf"]], held[r["leaf"]] = r["n"], r["ids"]
    shard_of, blocks = shards_of(size)

    asked = written(rows.where(is_query), "asked")
    distinct = written(asked.groupBy("v").agg(F.min("vec_id").alias("query")), "queries")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, shard, lists, visited, compared = [], [], [], [], []
            for i, x in enumerate(unit(_matrix(batch.column(0))) if batch.num_rows else []):
                taken, scored = tree.walk(x, visits, held, k + 1)
                leaves = np.sort(taken)
                own = shard_of[leaves]
                for s in np.unique(own):
                    rows.append(i)
                    shard.append(s)
                    lists.append(leaves[own == s])
                    visited.append(len(leaves))
                    compared.append(scored)
            if rows:
                at = pa.array(rows)
                columns = [pa.array(shard, pa.int32()), batch.column(1).take(at), batch.column(0).take(at), pa.array(lists, pa.list_(pa.int32())), pa.array(visited, pa.int32()), pa.array(compared, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "query", "v", "leaves", "visited", "compared"])

    walks = written(distinct.select("v", "query").mapInArrow(walk, "shard int, query long, v array<double>, leaves array<int>, visited int, compared int"), "walks")
    waiting = {r["shard"]: r["n"] for r in walks.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # no more rows than leaves
    plan = [(leaf, int(s), int(blocks[s]), -(-waiting[int(s)] // QUERY_BLOCK)) for leaf, s in enumerate(shard_of) if int(s) in waiting]
    plan = spark.createDataFrame(plan, "leaf int, shard int, blocks int, shares int")
    hashed = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = walks.join(F.broadcast(plan.drop("leaf").distinct()), "shard").withColumn("share", hashed("query", "shares")).withColumn("block", every("blocks"))
    right = points.join(F.broadcast(plan), "leaf").withColumn("block", hashed("least_id", "blocks")).withColumn("share", every("shares"))
    best = pa.list_(pa.struct([("minus", pa.float64()), ("vec_id", pa.int64())]))

    def meet(key: tuple, queries: pa.Table, block: pa.Table) -> pa.Table:
        if not queries.num_rows or not block.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "found": pa.array([], best), "visited": pa.array([], pa.int32()), "compared": pa.array([], pa.int32())})
        block = block.sort_by("least_id")
        x, y = (unit(_matrix(t.column("v").combine_chunks())) for t in (queries, block))
        leaf, ids = block.column("leaf").to_numpy(), block.column("ids").to_pylist()
        lists = queries.column("leaves").combine_chunks()
        asking = np.repeat(np.arange(len(x)), np.diff(lists.offsets.to_numpy()))
        wanted = lists.flatten().to_numpy()
        found: list[list] = [[] for _ in range(len(x))]
        for number in np.unique(leaf):
            some, here = asking[wanted == number], np.flatnonzero(leaf == number)
            # one of the k + 1 points may be the query's own
            for i, near, score in best_of(x[some], y[here], k + 1):
                found[some[i]] += [(-s, v) for p, s in zip(near.tolist(), score.tolist(), strict=True) for v in ids[here[p]]]
        top = [[{"minus": m, "vec_id": v} for m, v in sorted(f)[: k + 1]] for f in found]
        return pa.table({"query": queries.column("query"), "found": pa.array(top, best), "visited": queries.column("visited"), "compared": queries.column("compared")})

    keys = ["shard", "block", "share"]
    met = left.select(*keys, "query", "v", "leaves", "visited", "compared").groupBy(*keys).cogroup(right.select(*keys, "v", "ids", "least_id", "leaf").groupBy(*keys))
    met = met.applyInArrow(meet, "query long, found array<struct<minus: double, vec_id: long>>, visited int, compared int")
    lists = met.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found"), F.max("visited").alias("visited"), F.max("compared").alias("compared"))
    named = written(lists.join(distinct, "query").select("v", "found", "visited", "compared"), "found")
    # every asking row gets its vector's list without itself
    each = spread_join(asked, named, "v").select("vec_id", "visited", "compared", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("vec_id")), 1, k).alias("found"))
    flat = each.select(F.col("vec_id").cast("long").alias("query_id"), "visited", "compared", F.posexplode("found").alias("at", "x"))
    return flat.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"), "visited", F.lit(tree.leaves).cast("int").alias("leaves"), "compared"
    )
