import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pricelode.llm import gam, queries, toxicity


def held_out_accuracy(rows, labels, name):
    known = {r.doc_id: r[name] for r in labels.collect()}
    held = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and known.get(r.doc_id) is not None]
    return np.mean([a == b for a, b in held]), len(held)


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op9_quality_gam"](spark, d).collect()
    accuracy, n = held_out_accuracy(rows, spark.read.parquet(f"{d}/labels.parquet"), "quality")
    assert len(rows) == 1000 and n > 80 and accuracy > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op10_toxicity"](spark, d).collect()
    accuracy, n = held_out_accuracy(rows, spark.read.parquet(f"{d}/labels.parquet"), "toxic")
    assert len(rows) == 1000 and n > 50 and accuracy > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_odd_documents_get_scores(cases, no_docs, labels):
    for scores in (gam.quality_scores, toxicity.toxicity_scores):
        rows = scores(cases, labels).collect()
        assert len(rows) == cases.count() and all(0 <= r.score <= 1 for r in rows)
        assert {r.held_out for r in rows if r.doc_id is None} == {False}
        assert scores(no_docs, labels).count() == 0
        assert scores(cases, labels.limit(0)).count() == cases.count()


def test_without_labels_scores_are_even(cases, labels):
    assert {r.score for r in gam.quality_scores(cases, labels.where("quality = 1")).collect()} == {0.5}


def test_the_stage_keeps_columns(documents, spark):
    wide = documents.withColumn("score", documents.doc_id).withColumn("_score", documents.lang)
    kept = gam.keep_quality(wide, documents, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    assert kept.columns == wide.columns and 0 < kept.count() < wide.count()


def test_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam.fit(x[:2000], y[:2000])
    assert ((model.scores(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.85 and (1, 0) in model.pairs


def test_features_stay_finite():
    x = gam.features(pa.array(["", " ", "x", "\n\n", "a" * 100_000, "é " * 10]))
    assert x.shape == (6, len(gam.FEATURES)) and np.isfinite(x).all()


def test_folding_keeps_positions():
    for text in ("ІDIOT", "1d10t", "st@pid", "$cum", "ＭＯＲＯＮ", "İx", "plain 5 $$$ !"):
        assert len(toxicity.fold(text)) == len(text)
    assert [toxicity.fold(x) for x in ("1d10t", "іdіоt", "ＭＯＲＯＮ")] == ["idiot", "idiot", "moron"]


def test_terms_boundaries_and_exceptions():
    lexicon = toxicity.Lexicon({"moron": (2.0, True), "idiot": (3.0, False), "trash": (1.0, True)}, toxicity.EXCEPTIONS, (0, 1, 1))
    found = toxicity.automaton(lexicon)
    weight = lambda t: toxicity.matched_weight(toxicity.fold(t), found)
    assert weight("you moron!") == 2.0 and weight("oxymoron") == 0 and weight("moronic") == 0
    assert weight("IDIOTIC 1d10t") == 6.0 and weight("the trash can") == 0 and weight("trash") == 1.0 and weight("") == 0


def test_learned_terms():
    counts = {"veju": (40, 0), "vejux": (20, 0), "vejuy": (20, 0), "scum": (50, 1), "scum ": (49, 1), "them": (100, 900), "rare": (2, 0)}
    assert {t: w for t, (_, w) in toxicity.choose_terms(counts, 100, 900).items()} == {"veju": False, "scum": True}


@pytest.mark.parametrize(
    "text", ["MORON", "m0r0n", "mórón", "mor\u200bon", "m o r o n", "m.o.r.o.n", "mоrоn", "ＭＯＲＯＮ", "𝐦𝐨𝐫𝐨𝐧", "ⓜⓞⓡⓞⓝ", "ᴍᴏʀᴏɴ", "mørøn", "mo\u0301ron", "m\u00adoron", "you a m o r o n"]
)
def test_each_disguise_is_folded(text):
    found = toxicity.automaton(toxicity.Lexicon({"moron": (2.0, True)}, toxicity.EXCEPTIONS, (0, 1, 1)))
    assert toxicity.text_weight(f"well {text} said", found) == 2.0


def test_exceptions_are_whole_phrases():
    found = toxicity.automaton(toxicity.Lexicon({"trash": (1.0, False), "ass": (2.0, True)}, toxicity.EXCEPTIONS, (0, 1, 1)))
    weight = lambda t: toxicity.text_weight(t, found)
    assert weight("the trash can, two trash cans") == 0 and weight("you trash cannot talk") == 1.0 and weight("my trash canary") == 1.0
    assert weight("an ass") == 2.0 and weight("a class") == 0


def brute_weight(folded, lexicon):
    """Every term and exception looked for at every place."""
    letter = lambda i: 0 <= i < len(folded) and folded[i].isalnum()
    hidden, spans = [], []
    for i in range(len(folded)):
        for phrase in map(toxicity.fold, lexicon.exceptions):
            end = i + len(phrase)
            if folded.startswith(phrase, i) and not letter(i - 1) and (not letter(end) or (folded[end] == "s" and not letter(end + 1))):
                hidden.append((i, end - 1))
        for term, (weight, whole) in lexicon.terms.items():
            end = i + len(term)
            if folded.startswith(term, i) and not letter(i - 1) and not (whole and letter(end)):
                spans.append((i, end - 1, weight))
    left = sorted(s for s in spans if not any(a <= s[1] and s[0] <= b for a, b in hidden))
    total, groups = 0.0, []
    for s in left:  # spans that overlap form a group; its heaviest counts
        if groups and s[0] <= groups[-1][0]:
            groups[-1] = (max(groups[-1][0], s[1]), max(groups[-1][1], s[2]))
        else:
            groups.append((s[1], s[2]))
    return total + sum(w for _, w in groups)


def test_matching_equals_brute_force(spark):
    rng = random.Random(2)
    terms = {"trash": (1.0, False), "trash c": (2.5, False), "moron": (2.0, True), "clown": (1.5, False), "own": (0.5, False), "ass": (3.0, True), "scum": (2.0, False)}
    lexicon = toxicity.Lexicon(terms, toxicity.EXCEPTIONS, (-1.0, 1.0, 0.5))
    found = toxicity.automaton(lexicon)
    parts = ["trash", " can", "cans", " ", "moron", "oxy", "clown", " fish", "class ", "ass", "scum", " of the pond", "pond ", "s", "x", "not ", "own"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    for t in texts:
        assert toxicity.matched_weight(t, found) == pytest.approx(brute_weight(t, lexicon)), t
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.toxicity_scores(docs, None, lexicon=lexicon).collect():
        weight = brute_weight(toxicity.fold(texts[r.doc_id]), lexicon)
        density = 100 * weight / (texts[r.doc_id].count(" ") + 1 + 20)
        assert r.score == pytest.approx(1 / (1 + math.exp(1 - math.log1p(weight) - 0.5 * math.log1p(density))))


def test_ten_megabytes_take_seconds():
    found = toxicity.automaton(toxicity.Lexicon({"trash": (1.0, False)}, toxicity.EXCEPTIONS, (0, 1, 1)))
    text = "the trash can and the trash, " * 350_000
    began = time.perf_counter()
    assert toxicity.text_weight(text, found) == 350_000.0
    assert time.perf_counter() - began < 60


def test_all_learned_terms_are_taken(spark):
    """Three-letter words too, and as many as there are."""
    rng = random.Random(4)
    bad = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnprst"]
    texts = [" ".join(["some plain text of the day", *(rng.sample(bad, 20) if i % 2 else [])]) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, toxic int")
    assert set(bad) <= set(toxicity.learn(docs, labels).terms)


def test_quality_equals_a_loop_over_tables(spark):
    """Scores by a plain walk through the lookup tables; features by their definitions."""
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{x}.parquet") for x in ("documents", "labels"))
    model = gam.train(docs, labels)
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r.score for r in gam.quality_scores(docs, labels).collect()}
    for i, text in rows.items():
        raw, words = text.encode(), re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
        n, size = max(len(words), 1), max(len(raw), 1)
        share = lambda chars: sum(b in chars for b in raw) / size  # noqa: B023, E731
        blank = share(b" \t\n\v\f\r")
        x = [
            math.log1p(len(raw)), math.log1p(len(words)), min(size * (1 - blank) / n, 100), share(bytes(range(65, 91))), share(b"0123456789"), share(b",;:'\"()?-"), share(b"#*$%&<>@^~=+_\\/{}[]"),
            share(b"!"), share(b"|"), blank, share(bytes(range(0xC0, 0x100))), raw.count(b"\n") / n, len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
            math.log1p(max(map(len, words), default=0)), share(b"."),
        ]
        logit = model.base
        for f, v in enumerate(x):
            logit += model.tables[f][sum(c <= v + 1e-12 for c in model.cuts[f])]
        for (f, g), table in zip(model.pairs, model.pair_tables, strict=True):
            logit += table[sum(c <= x[f] + 1e-12 for c in model.pair_cuts[f])][sum(c <= x[g] + 1e-12 for c in model.pair_cuts[g])]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-min(max(logit, -30), 30))), abs=1e-9), i


def test_accuracy_at_the_figure_of_the_readme(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    for name, column, bar in (("op9_quality_gam", "quality", 0.99), ("op10_toxicity", "toxic", 0.98)):
        accuracy, n = held_out_accuracy(queries.QUERIES[name](spark, d).collect(), labels, column)
        assert n > 400 and accuracy >= bar


def test_a_text_over_all_slices_is_scored_whole(spark, documents, labels):
    """Good prose with six million characters of junk behind it scores as the whole text does, not as its beginning."""
    good = documents.where("doc_id < 40").select("text").first().text
    texts = [good + " #$%& 0000 |<>|" * 400_000, good, "#$%& 0000 |<>| " * 400_000]
    docs = spark.createDataFrame(list(enumerate(texts, 10_000)), "doc_id long, text string").coalesce(1)
    model = gam.train(documents, labels)
    got = [r._score for r in gam.scored(docs, model).orderBy("doc_id").collect()]
    assert got == pytest.approx([model.scores(gam.features(pa.array([t])))[0] for t in texts])
    whole, begin = gam.features(pa.array(texts[:1]))[0], gam.features(pa.array(texts[1:2]))[0]
    assert (whole != begin).sum() > 5
