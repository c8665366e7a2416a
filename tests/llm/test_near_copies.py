import math
import random

import numpy as np
import pyarrow as pa

from pricelode.llm import near_copies
from pricelode.llm.simhash import BITS, Nodes, plan_search


def work(n):
    """Shuffled rows and compared fingerprints a node of the probe's plan, at n nodes whose bits are independent."""
    both = np.full((BITS, BITS), n / 4)
    np.fill_diagonal(both, n / 2)
    plan = plan_search(n, both, near_copies.PROBE_TAU)
    rows = [sum(math.comb(len(g), k) for k in range(r + 1)) for g, r in zip(plan.groups, plan.radius, strict=True) if r >= 0]
    return sum(rows), sum(x * n / 2 ** len(g) for x, g in zip(rows, (g for g, r in zip(plan.groups, plan.radius, strict=True) if r >= 0), strict=True))


def test_the_probe_at_six_gb_works_about_as_at_a_tenth():
    """A row costs as much as 400 comparisons. From 50,000 nodes (0.1 GB) to 3,000,000 (6 GB) a node's work is no multiple of
    some size; with fingerprints of 10 differing bits it was 42 times as much."""
    small, large = (400 * rows + compared for rows, compared in (work(50_000), work(3_000_000)))
    assert large < 3 * small


def test_bands_alone_find_what_a_narrow_probe_leaves_out():
    """A pair of exactly the similarity asked for shares a band but for one in ten million."""
    assert (1 - near_copies.SIMILARITY**near_copies.BAND_ROWS) ** near_copies.BANDS < 1e-7
    rng, missed = np.random.default_rng(5), 0
    for _ in range(400):
        words = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
        a, b = np.sort(words[:809]), np.sort(np.r_[words[:719], words[809:899]])  # 719 of 899 are shared
        assert 0.799 < len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < 0.801
        x, y = near_copies.band_values(np.r_[a, b], np.array([0, 809, 1618]))
        missed += not any(u == v for u, v in zip(x, y, strict=True))
    assert not missed


def test_shingles_of_hashed_words():
    """Shingles have equal hashes if, and only if, they have equal words at equal places; a short text is one shingle of its own."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "B", "bb", "ab", "é", "a" * 9, "x" * 700]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 6, 7, 40, 400, 1, 2, 3, 4)] + ["", "a", "A  a", "a a a", "aa"]
    made = {}
    for width in (2, 5):
        hashes, runs = near_copies.word_shingles(pa.array(texts), (width,))[0]
        for k, t in enumerate(texts):
            words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split()
            want = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)] or ([tuple(words)] if words else [])
            own = hashes[runs[k] : runs[k + 1]].tolist()
            assert len(own) == len(want)
            for s, h in zip(want, own, strict=True):
                assert made.setdefault((len(s) if len(s) < width else width, s), h) == h
    assert len(set(made.values())) == len({s for _, s in made})
    assert [len(x) for x in near_copies.word_shingles(pa.array([], pa.string()), (5,))[0]] == [0, 1]


def test_large_buckets_leave_out_no_candidate():
    """A bucket over FEW of far fingerprints, among them groups of near ones: the forest connects what all pairs connect."""
    rng = np.random.default_rng(9)
    fp = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for k in range(0, 120, 3):  # three within four bits, the last by way of the second
        fp[k + 1] = fp[k] ^ np.uint64(0b1111 << (k % 50))
        fp[k + 2] = fp[k + 1] ^ np.uint64(0b1111 << (k % 50 + 5))
    sketch = np.c_[np.zeros((300, near_copies.SKETCH_WORDS), np.uint64), np.full(300, 100, np.uint64)]
    order = rng.permutation(300)
    nodes = Nodes(order, fp[order], sketch, np.ones(300, bool))
    found = {frozenset(map(int, nodes.node[list(e)])) for e in near_copies.forest(np.zeros(300, np.int64), nodes, 0.8)}
    assert found == {frozenset((k + i, k + i + 1)) for k in range(0, 120, 3) for i in (0, 1)}
    assert near_copies._met(nodes.fp).sum() == 120


def test_who_has_met_whom():
    """Fingerprints in any order, with equal ones: as all pairs say."""
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 127, 128, 129, 700):
        for bits in (5, 12, 20):
            fp = rng.integers(0, 1 << bits, n, dtype=np.uint64) * np.uint64(0x9249249249249249)
            far = np.bitwise_count(fp[:, None] ^ fp) > near_copies.PROBE_TAU
            np.fill_diagonal(far, True)
            assert (near_copies._met(fp) == ~far.all(axis=1)).all()
