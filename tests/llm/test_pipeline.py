import random
import re
from collections import Counter

import pytest

import corpus_pipeline

DIR = "/root/testdata/sf0.001"


def shingle_sets(texts):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set()))
    return out


def groups(texts, similarity=0.8):
    """For each text the first one that links of exact Jaccard similarity connect it to, over all pairs that share a shingle."""
    sets, place, shared = shingle_sets(texts), {}, Counter()
    for k, own in enumerate(sets):
        for s in own or {None}:  # texts without words share that
            place.setdefault(s, []).append(k)
    for own in place.values():
        shared.update((a, b) for i, a in enumerate(own) for b in own[i + 1 :])
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for (a, b), n in shared.items():
        if n >= similarity * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return [top(k) for k in range(len(texts))]


def test_stages_narrow_the_corpus(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR).cache()
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.run(spark, DIR).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_exact_copies_leave_one(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, DIR).collect()}
    texts = [r.text for r in docs.collect() if r.doc_id in kept]
    assert len(texts) == len(set(texts))


def test_odd_rows_pass_each_stage(cases, no_docs, spark):
    for docs in (cases, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, DIR).count() <= docs.count()


def test_stages_equal_brute_force(spark):
    """Each stage on its own input: rules by the SQL of their query, near-duplicates by all
    pairs, packing by the budget of every batch; the classifier by the labels it keeps."""
    import duckdb
    import numpy as np

    from pricelode.llm import queries

    inputs, outputs = {}, {}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs.toPandas()
        docs = stage(spark, docs, "/root/testdata/sf0.01").cache()
        outputs[name] = docs.toPandas()

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().set_index("doc_id").quality
    kept = set(outputs["quality classifier"].doc_id)
    assert np.mean([(d in kept) == (labels[d] == 1) for d in labels.index]) > 0.97

    duck = duckdb.connect()
    duck.register("documents", inputs["quality rules"])
    want = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({queries.ORACLES['op1_quality_rules']}) WHERE kept").fetchall()}
    assert set(outputs["quality rules"].doc_id) == want

    rows = inputs["near-duplicates"].sort_values("doc_id")
    root = np.array(groups(rows.text))
    assert set(outputs["near-duplicates"].doc_id) == set(rows.doc_id.to_numpy()[root == np.arange(len(rows))])

    packed = outputs["packing"]
    assert sorted(packed.doc_id) == sorted(outputs["near-duplicates"].doc_id)
    batches = packed.groupby("batch_id")
    assert ((batches.bucket_len.max() * batches.size() <= 65_536) | (batches.size() == 1)).all()


def test_one_contiguous_edit_is_found(spark):
    """Pairs with a Jaccard similarity of 0.8 and more by one appended or replaced block."""
    import numpy as np

    from pricelode.llm import near_copies

    rng, rows, want = np.random.default_rng(7), [], set()
    shingles = lambda words: {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    for k in range(300):
        words = [f"w{x}" for x in rng.integers(0, 50_000, 260)]
        if k % 2:
            other = [*words, *(f"w{x}" for x in rng.integers(0, 50_000, 62))]
        else:
            at = int(rng.integers(5, 200))
            other = [*words[:at], *(f"w{x}" for x in rng.integers(0, 50_000, 22)), *words[at + 22 :]]
        a, b = shingles(words), shingles(other)
        assert 0.8 <= len(a & b) / len(a | b) < 0.83
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        want.add(2 * k)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in near_copies.drop_near_copies(docs).collect()} == want


def test_near_duplicates_against_exact_shingles(spark):
    """The first text of each group of all pairs stays, and no other."""
    from pricelode.llm import near_copies

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.toPandas().sort_values("doc_id")
    want = [d for k, (d, r) in enumerate(zip(rows.doc_id, groups(rows.text), strict=True)) if k == r]
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == want and len(want) < len(rows) - 50


@pytest.mark.parametrize("chunk", [3, 512])
def test_pairs_around_the_limit(spark, monkeypatch, chunk):
    """Clusters of texts with similarities around 0.8, chains of them, repeated lines and short texts: whether parents and clusters are dealt out or not."""
    from pricelode.llm import near_copies

    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    rng, texts = random.Random(2), []
    for c in range(12):
        base = [f"c{c}w{i}" for i in range(rng.choice([5, 7, 9, 14, 40, 120, 300]))]
        for _ in range(25):
            words = base.copy()
            for _ in range(rng.randint(1, max(1, len(base) // 40))):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 3)] = [f"x{rng.randrange(4)}" for _ in range(rng.randint(0, 2))]
            texts.append(" ".join(words) + (" " + " ".join(base[:20])) * rng.choice([0, 0, 0, 40]))
    texts += ["", " \n", "one", "one", "One two", "one two three"]
    rng.shuffle(texts)
    root = groups(texts)
    assert 20 < len(set(root)) < len(texts) - 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect())
    assert found == sorted(set(root))


def test_a_bucket_of_doubts_gives_few_rows():
    """500 sketches that all may be near each other: a forest has 499 edges, not 124,750 pairs."""
    import numpy as np

    from pricelode.llm import near_copies
    from pricelode.llm.simhash import Nodes

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, 256)
    bits = (base ^ (rng.random((500, 256)) < 0.12)).astype(np.uint8)
    words = np.c_[np.packbits(bits, axis=1).view(np.uint64), np.full(500, 300, np.uint64)]
    nodes = Nodes(np.arange(500), np.zeros(500, np.uint64), words, np.ones(500, bool))
    edges = list(near_copies.forest(np.zeros(500, np.int64), nodes, 0.8))
    assert len(edges) == 499 and len({c for _, c in edges}) == 499


def test_hubs_and_hot_texts(spark):
    """100,000 equal rows and a hub of 3,000 near ones leave one each."""
    from pyspark.sql import functions as F

    from pricelode.llm import near_copies, simhash

    rng = random.Random(1)
    base = [f"b{i}" for i in range(400)]
    near = []
    for i in range(3000):
        words = base.copy()
        words[rng.randrange(400)] = f"x{i}"
        near.append((200_000 + i, " ".join(words)))
    same = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit(" ".join(f"c{i}" for i in range(40))).alias("text"))
    docs = same.union(spark.createDataFrame(near, "doc_id long, text string")).repartition(4)
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == [0, 200_000]
    found = simhash.simhash_components(docs)
    assert found.count() == 103_000 and found.where("doc_id < 100000").select("component_id").distinct().collect()[0].component_id == 0
