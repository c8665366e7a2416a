import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pricelode.llm.near_copies import drop_near_copies
from pricelode.llm.simhash import BITS, Limits, fingerprints, links, plan_search, simhash_components


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, tau):
    """{fp: smallest fp reached}"""
    left, root = set(fps), {}
    while left:
        start = min(left)
        todo, left = [start], left - {start}
        while todo:
            f = todo.pop()
            root[f] = start
            near = {g for g in left if (f ^ g).bit_count() <= tau}
            left -= near
            todo += near
    return root


def test_fingerprints_equal_brute_force(cases):
    texts = [r.text or "" for r in cases.collect()]
    assert fingerprints(pa.array(texts)).tolist() == [brute_fingerprint(t) for t in texts]


def test_components_of_odd_documents(cases, no_docs):
    rows = simhash_components(cases).collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in cases.collect()}
    root = brute_components(set(fps.values()), 4)
    least = {}
    for d, f in fps.items():
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    assert len(rows) == cases.count()
    for r in rows:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}"
        assert r.component_id == least.get(root[fps[r.doc_id]])
    assert simhash_components(no_docs).count() == 0


@pytest.mark.parametrize("tau", [2, 4, 8])
def test_links_connect_all_that_is_near(spark, tau):
    rng = random.Random(tau)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        for _ in range(4):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, tau)))
            fps.add(f)
    hub = rng.getrandbits(64)
    fps |= {hub ^ 1 << a ^ 1 << b for a in range(64) for b in range(a)}  # a bucket over the size of a block
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f, f, None) for f in signed], "node long, fp long, sketch binary")
    made = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in links(nodes, Limits(tau, 0)).collect()]
    parent = {f: f for f in fps}

    def top(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in made:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    assert {f: top(f) for f in fps} == brute_components(fps, tau)


def test_thresholds_obey_the_pigeonhole():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (5000, BITS)).astype(float)
    bits[:, 1] = bits[:, 0]
    for n in (5000, 10**7, 10**9):
        plan = plan_search(n, bits.T @ bits * (n / 5000), 4)
        assert sum(plan.radius) == 4 - len(plan.groups) + 1 and sorted(b for g in plan.groups for b in g) == list(range(BITS))
        assert any({0, 1} <= set(g) for g in plan.groups)  # correlated bits share a group


def test_one_of_each_group_stays(spark, cases, no_docs):
    rng = random.Random(3)
    base = [f"t{rng.randrange(4000)}" for _ in range(300)]
    near = base.copy()
    near[100:103] = ["x", "y", "z"]
    other = [f"t{rng.randrange(4000)}" for _ in range(300)]
    rows = [(3, " ".join(base)), (1, " ".join(base)), (2, " ".join(near)), (4, " ".join(other)), (1, " ".join(base)), (None, " ".join(base)), (9, "")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, fp string")
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 9]
    assert sorted(str(r.doc_id) for r in drop_near_copies(cases).collect()) == ["1", "10", "4", "5", "7", "8", "9", "None"]
    assert drop_near_copies(no_docs).count() == 0


def test_hashes_equal_the_library():
    from pricelode.llm.simhash import hash_spans

    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 9000).astype(np.uint8)
    size = np.r_[np.arange(600), rng.integers(0, 90, 2000), np.arange(40)]
    begin = np.r_[rng.integers(0, 8000, 2600), 9000 - np.arange(40)]
    end = np.minimum(begin + size, 9000)
    want = [xxhash.xxh64_intdigest(raw[i:j].tobytes(), 42) for i, j in zip(begin, end, strict=True)]
    assert hash_spans(raw, begin, end).tolist() == want
    assert hash_spans(raw[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_a_text_over_all_slices(spark):
    """9 MB beside short texts, and a run of far more hashes than are summed at once."""
    long = "some words of a long text and more " * 260_000
    docs = spark.createDataFrame([(1, "short text"), (2, long), (3, None)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.fingerprint for r in simhash_components(docs).collect()}
    assert got == {i: f"{brute_fingerprint(t):016x}" for i, t in ((1, "short text"), (2, long), (3, None))}
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == [1, 2, 3]
