"""Spelling variants against plain Python over all pairs."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from pricelode.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lowered(run):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in run)


def struck(doc_id, run):
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run


def counted(rows):
    every = Counter(struck(d, lowered(run)) for d, text in rows for run in RUN.findall(text or ""))
    return {w: n for w, n in every.items() if len(w) >= 5 and n >= 3}


def near(x, y):
    if len(x) < len(y):
        x, y = y, x
    if x == y or len(x) - len(y) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    return any(x[:i] + x[i + 1 :] == y for i in range(len(x)))


def brute(rows):
    n = counted(rows)
    found = {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        found[w] = (len(others), best if best and n[best] >= 2 * n[w] else None)
    out = set()
    for w, (k, form) in found.items():
        root = w
        while found[root][1]:
            root = found[root][1]
        out.add((w, n[w], k, form, n[form] if form else None, root))
    return out


def got(docs, **more):
    rows = spelling.spelling_variants(docs, **more).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len(rows) == len({r.word for r in rows})
    return {tuple(r) for r in rows}


def test_odd_documents(cases, no_docs):
    rows = [(r.doc_id, r.text) for r in cases.collect()]
    assert got(cases) == brute(rows) and brute(rows)
    assert got(no_docs) == set()


def letters(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("most", [20, 100_000])
def test_words_of_few_letters(spark, most):
    """Words of few letters, so that blocks are large, halves repeat and an edit can stand in several places; whether Spark or a task halves the blocks."""
    rng = random.Random(4)
    words = {letters(rng, "abé", rng.randint(4, 9)) for _ in range(900)} | {"a" * k for k in range(4, 15)} | {letters(rng, "xy", 150) for _ in range(3)}
    long = min(w for w in words if len(w) == 150)
    words |= {long[:70] + long[71:], long + "z", "z" + long, long[:149] + "É"}
    words = sorted(words)
    weight = {w: rng.choice([1, 2, 4, 9, 20]) for w in words}
    texts = [" ".join(w for w in words for _ in range(weight[w]) if rng.random() < 0.8) for _ in range(6)]
    rows = [*enumerate(texts), (None, " ".join(words[:50]))]
    want = brute(rows)
    assert any(w != root and form != root for w, _, _, form, _, root in want if form) and max(k for _, _, k, *_ in want) > 10
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    assert got(docs, most=most) == want


def test_counts_of_runs():
    """Runs end at other letters, digits and signs; upper-case accents stay; words of over LONG_WORD bytes."""
    texts = ["Straße straße STRASSE ÉTÉS étés naïveté", "Ÿx ÿabcdefg x×y÷zzzz ŁódźŁaaaaa", "B" * 100 + " " + "é" * 90, "", " ", "12345 don't o'clock"] * 40
    ids = [str(i) for i in range(len(texts))]
    every = Counter(struck(d, lowered(run)) for d, t in zip(ids, texts, strict=True) for run in RUN.findall(t))
    assert spelling.slice_counts(ids, pa.array(texts)) == {w: n for w, n in every.items() if len(w) >= 5}


def test_no_block_that_can_be_halved_is_large(spark):
    rng = random.Random(5)
    words = list({letters(rng, "ab", 12) for _ in range(900)})
    frame = spark.createDataFrame([(i, w, 3) for i, w in enumerate(words)], "id long, word string, n long")
    sizes = spelling.blocks(frame, 4).groupBy(*spelling.BLOCK).count().collect()
    assert max(r["count"] for r in sizes) <= 4 and any(r.a and r.b for r in sizes)


def test_chains_lead_to_the_last_form(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(21)] + [(f"v{i}", "w0") for i in range(3000)]
    found = {r.word: r.root for r in spelling.roots(spelling.written(spark.createDataFrame(forms, "word string, form string"), "forms")).collect()}
    assert len(found) == 3021 and set(found.values()) == {"w21"}


def test_equals_sql(compare):
    compare(queries.QUERIES["op11_spelling_variants"], queries.ORACLES["op11_spelling_variants"])
