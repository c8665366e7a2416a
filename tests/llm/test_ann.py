import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelode.llm import ann, queries


def brute(ids, x, query, k=5):
    u = ann.unit(x)
    score = (u * u[query]).sum(axis=1)
    return sorted(((-round(s, 12), i) for s, i in zip(score, ids, strict=True) if i != ids[query]))[:k]


def test_recall_on_the_whole_table(spark):
    d = "/root/testdata/sf0.1"
    own = spark.read.parquet(f"{d}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(own.embedding).astype(float), own.vec_id.tolist()
    rows = queries.QUERIES["op2_ann_tree"](spark, d).collect()
    assert len(rows) == 5 * sum(i % 50 == 0 for i in ids)
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append(r)
    hits = 0
    for q, got in found.items():
        got.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        u = ann.unit(x)
        assert np.allclose([r.score for r in got], [u[ids.index(r.vec_id)] @ u[ids.index(q)] for r in got], atol=1e-12)
        hits += len({r.vec_id for r in got} & {i for _, i in brute(ids, x, ids.index(q))})
    assert hits / len(rows) >= 0.9


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(1, 40)]
    rows += [(100 + i, [1.0, 2.0, 3.0]) for i in range(30)] + [(150, [2.0, 4.0, 6.0]), (0, [1.0, 2.0, 3.0])]
    rows += [(200, None), (250, [0.0, 0.0, 0.0]), (300, [1.0, None, 1.0]), (350, [float("nan"), 1.0, 1.0]), (400, [float("inf"), 1.0, 1.0]), (450, [1.0]), (None, [1.0, 1.0, 1.0]), (500, [])]
    rows += [(550, [1e-38, 0.0, 0.0]), (600, [3e38, 3e38, 1.0])]
    return spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, v string")


def test_odd_vectors(odd):
    rows = ann.nearest(odd, F.col("vec_id") % 50 == 0, target=1.0).collect()
    own = [(r.vec_id, r.embedding) for r in odd.collect() if r.vec_id is not None and r.embedding and len(r.embedding) == 3 and None not in r.embedding]
    own = sorted((i, np.array(e, float)) for i, e in own if np.isfinite(e).all() and any(e))
    ids, x = [i for i, _ in own], np.stack([e for _, e in own])
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((-round(r.score, 12), r.vec_id))
    assert set(got) == {0, 100, 150, 550, 600}
    for q, found in got.items():
        want = brute(ids, x, ids.index(q))
        assert [s for s, _ in found] == pytest.approx([s for s, _ in want], abs=1e-11)
    assert [i for _, i in got[0]] == [100, 101, 102, 103, 104] and [i for _, i in got[100]][:2] == [0, 101]


def test_few_and_no_vectors(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1)]
    assert ann.nearest(two.limit(0), F.lit(True)).count() == 0


def test_visits_cover_all_leaves():
    rng = np.random.default_rng(2)
    x = ann.unit(rng.normal(size=(2000, 8)))
    tree = ann.fit_tree(x, 20_000)
    assert sorted(tree.visits(x[0], tree.leaves)) == list(range(tree.leaves)) and tree.leaves > 20
    assert len(set(tree.assign(x))) == tree.leaves


def test_only_children_of_taken_nodes_are_compared():
    rng = np.random.default_rng(2)
    x = ann.unit(rng.normal(size=(4000, 8)))
    tree = ann.fit_tree(x, 200_000)
    nodes = len(tree.children)
    for q in x[:20]:
        found, scored = tree.walk(q, 3)
        near, queue, taken, plain = tree.centroids @ q, [0], [], set()
        while len(taken) < 3:  # the same with every node's nearness known, and a plain list for the queue
            node = max(queue, key=lambda n: near[n])
            queue.remove(node)
            while tree.children[node]:
                plain.update(tree.children[node])
                first = max(tree.children[node], key=lambda n: near[n])
                queue += [n for n in tree.children[node] if n != first]
                node = first
            taken.append(int(tree.leaf[node]))
        assert found == taken and scored == len(plain) < 0.2 * nodes
    assert tree.walk(x[0], tree.leaves)[1] == nodes - 1


def test_clustered_vectors_visit_few_leaves(spark):
    """200,000 vectors in clusters: recall against brute force, and the share of leaves that were visited."""
    import pandas as pd

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(2000, 16))
    x = (centres[rng.integers(0, 2000, 200_000)] + 0.3 * rng.normal(size=(200_000, 16))).astype(np.float32)
    vectors = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(200_000), "embedding": x.tolist()}), "vec_id long, embedding array<float>").repartition(8)
    rows = ann.nearest(vectors, F.col("vec_id") % 50 == 0).toPandas()
    assert rows.groupby("query_id").size().tolist() == [5] * 4000
    assert rows.leaves.min() > 500 and rows.visited.max() < 0.1 * rows.leaves.min() and rows.compared.max() < 0.16 * rows.leaves.min()
    u = ann.unit(x.astype(float))
    hits = 0
    found = {q: set(part.vec_id) for q, part in rows.groupby("query_id")}
    for at in range(0, 200_000, 25_000):
        own = np.arange(at, at + 25_000, 50)
        score = u[own] @ u.T
        score[np.arange(len(own)), own] = -2
        for q, best in zip(own.tolist(), np.argpartition(-score, 5, axis=1)[:, :5].tolist(), strict=True):
            hits += len(found[q] & set(best))
    assert hits >= 0.9 * len(rows)


def test_a_query_in_a_tiny_leaf_gets_all_its_neighbours(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (np.array([1.0, 0, 0, 0]) + 1e-4 * rng.normal(size=4)).tolist()) for i in range(1, 3000)] + [(0, [0.0, 0.0, 0.0, -1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [r["rank"] for r in ann.nearest(vectors, F.col("vec_id") == 0, target=0.01).collect()] == [1, 2, 3, 4, 5]


def test_a_vector_of_many_rows_answers_each(spark):
    vectors = spark.range(4000).selectExpr("id vec_id", "if(id % 3 = 0, array(1d, 2d), array(cast(id as double), 1d)) embedding")
    rows = ann.nearest(vectors, F.col("vec_id") % 3 == 0).toPandas()
    assert rows.groupby("query_id").size().tolist() == [5] * 1334
    same = rows[rows.query_id == 3]
    assert same.sort_values("rank").vec_id.tolist() == [0, 6, 9, 12, 15]


def test_shards_hold_about_a_block(monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 8192)  # the sizes below are made for it
    sizes = np.array([5000, 5000, 100, 30_000, 0, 8000, 10])
    shard, blocks = ann.shards_of(sizes)
    assert shard.tolist() == sorted(shard.tolist()) and shard[0] != shard[1] == shard[2] != shard[3]
    total = np.bincount(shard, sizes)
    assert all(t <= ann.BLOCK * b for t, b in zip(total, blocks, strict=True))


def test_leaves_grow_as_the_root_of_the_table():
    assert [ann.leaves_for(n) for n in (0, 100, 51_282, 819_200, 4_000_000, 100_000_000, 10**10)] == [1, 1, 256, 4096, 4096, 20_000, 200_000]
