from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelode.llm.packing import choose_bounds, pack_documents


@pytest.mark.parametrize("seed", range(6))
def test_bounds_are_optimal(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.choice(60, 8, replace=False))
    counts = rng.integers(1, 50, 8)
    for k in (1, 2, 3, 8, 12):
        best = min(
            sum(c * (min(u for u in (*some, lengths[-1]) if u >= n) - n) for n, c in zip(lengths, counts, strict=True))
            for some in combinations(lengths[:-1], min(k, 8) - 1)
        )
        bounds = choose_bounds(lengths, counts, k)
        assert bounds.padding == best and len(bounds.upper) <= k and bounds.upper[-1] == lengths[-1]


def test_twenty_thousand_lengths_fill_all_buckets():
    lengths = np.arange(0, 20_000)
    bounds = choose_bounds(lengths, np.ones(20_000, int), 8)
    assert bounds.upper[-1] == 19_999 and len(bounds.upper) == 8


def test_batches_hold_their_budget(documents, cases, no_docs):
    for docs in (documents, cases, documents.union(documents)):
        rows = pack_documents(docs.withColumn("bucket", F.lit("clash")), budget=4096, buckets=5).toPandas()
        assert len(rows) == docs.count()
        assert (rows.n_tokens <= rows.bucket_len).all() and (rows.padding == rows.bucket_len - rows.n_tokens).all()
        for (bucket, size), part in rows.groupby(["bucket", "bucket_len"]):
            room = max(1, 4096 // max(1, size))
            filled = part.groupby("batch_id").size()
            assert filled.max() <= room and len(filled) == -(-len(part) // room)
            assert not part.duplicated(["batch_id", "position"]).any() and part.position.max() < room
    assert pack_documents(no_docs).count() == 0


def test_null_text_has_no_words(cases):
    found = {r.doc_id: r.n_tokens for r in pack_documents(cases).collect()}
    assert found[1] == found[2] == found[3] == 0 and found[4] == 80_000


def test_many_lengths_have_least_padding():
    """Over 4,096 different lengths, against the quadratic program."""
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.choice(30_000, 5000, replace=False))
    counts = rng.integers(1, 50, 5000)
    before = np.r_[0, np.cumsum(counts)]
    cost = np.r_[0, lengths * before[1:]]
    for _ in range(4):
        cost = np.array([0] + [(cost[:j] + lengths[j - 1] * (before[j] - before[:j])).min() for j in range(1, 5001)])
    bounds = choose_bounds(lengths, counts, 5)
    assert bounds.padding == cost[-1] - (lengths * counts).sum() and set(bounds.upper) <= set(lengths.tolist())
    upper = np.array(bounds.upper)
    assert (counts * (upper[np.searchsorted(upper, lengths)] - lengths)).sum() == bounds.padding


def test_twelve_thousand_lengths_have_least_padding():
    """Against the plain program over all pairs of bounds."""
    rng = np.random.default_rng(8)
    lengths = np.sort(rng.choice(60_000, 12_000, replace=False))
    counts = rng.integers(1, 50, 12_000)
    before = np.r_[0, np.cumsum(counts)]
    cost = np.r_[0, lengths * before[1:]]
    for _ in range(3):
        cost = np.array([0] + [(cost[:j] + lengths[j - 1] * (before[j] - before[:j])).min() for j in range(1, 12_001)])
    assert choose_bounds(lengths, counts, 4).padding == cost[-1] - (lengths * counts).sum()


def test_repeated_and_null_ids_share_no_cell(spark, monkeypatch):
    from pricelode.llm import packing

    monkeypatch.setattr(packing, "CELL", 100)
    docs = spark.range(6000).selectExpr("if(id % 2 = 0, 7, null) doc_id", "'one two three' text")
    rows = pack_documents(docs, budget=30).toPandas()
    assert len(rows) == 6000 and not rows.duplicated(["batch_id", "position"]).any()
    assert rows.groupby("batch_id").size().tolist() == [10] * 600


def test_a_text_over_all_slices(spark):
    """Its words are counted to the last one, and it has a batch of its own."""
    docs = spark.createDataFrame([(1, "harbour lamp\t" * 450_000 + "end"), (2, "two words"), (3, None)], "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r for r in pack_documents(docs, buckets=2).collect()}
    assert (rows[1].n_tokens, rows[2].n_tokens, rows[3].n_tokens) == (900_001, 2, 0)
    assert rows[1].batch_id not in (rows[2].batch_id, rows[3].batch_id)
