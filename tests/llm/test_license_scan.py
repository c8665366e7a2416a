import random

import pytest

import pricelode.llm.license_scan as license_scan_module
from pricelode.llm.license_scan import TEMPLATES, align, differences, identify, license_scan, scan, words_of


def test_every_wording_names_its_license():
    for name, (_, texts) in TEMPLATES.items():
        for text in texts:
            found = identify(text)
            assert (found.license, found.verdict) == (name, "exact"), text


@pytest.mark.parametrize(
    ("block", "license", "verdict"),
    [
        ("Released under the terms of the MIT License.", "MIT", "variant"),
        ("Licensed under the Apache License, Version 1.1.", "Apache-2.0", "unconfirmed"),
        ("Copyright 2020 by Nobody. All rights reserved.", "all-rights-reserved", "exact"),
        ("licensed under cc by-nc 4.0", "CC-BY-NC-4.0", "exact"),
    ],
)
def test_blocks(block, license, verdict):
    found = identify(block)
    assert (found.license, found.verdict) == (license, verdict)


def test_a_plain_mention_is_no_license():
    assert identify("the plumber showed a licence from the town").verdict == "unconfirmed"


def test_differences_are_words():
    missing, added, shown = differences(words_of("Licensed under the Apache License, Version 1.1."), words_of("Licensed under the Apache License, Version 2.0."))
    assert (missing, added, shown) == (1, 1, ["-[2.0]+[1.1]"])


def test_wrapped_paragraphs_and_long_lines():
    text = TEMPLATES["MIT-text"][1][0]
    words, lines = text.split(), []
    for i in range(0, len(words), 10):
        lines.append(" ".join(words[i : i + 10]))
    found = scan("Title\n\n" + "\n".join(lines) + "\n\nOther text.")
    assert [(f.license, f.verdict) for _, _, f in found] == [("MIT-text", "exact")]
    long = "Some words here. " * 40 + "Licensed under CC BY 4.0. " + "More words follow. " * 40
    [(at, block, f)] = scan(long)
    assert f.license == "CC-BY-4.0" and long[at : at + len(block)] == block


def test_rows(spark, cases, no_docs):
    rows = [(1, "prose\nReleased under the MIT License.\nprose"), (2, None), (3, "nothing"), (1, "prose\nReleased under the MIT License.\nprose")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, license string")
    found = license_scan(docs).collect()
    assert [(r.doc_id, r.offset, r.license, r.verdict, r.saved > 0) for r in found] == [(1, 6, "MIT", "exact", True)] * 2
    assert license_scan(cases).count() == license_scan(no_docs).count() == 0


def test_every_wording_comes_out_of_the_scan(spark):
    texts = [(name, t) for name, (_, some) in TEMPLATES.items() for t in some]
    more = ["Available under Apache 2.0", "GPLv3 or later", "CC0", "Under MIT terms"]
    rows = [(i, f"prose\n{t}\nprose") for i, t in enumerate([*(t for _, t in texts), *more])]
    found = license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == {i for i, _ in rows}
    exact = {(r.doc_id, r.license) for r in found if r.verdict == "exact"}
    assert {(i, name) for i, (name, _) in enumerate(texts)} <= exact


def wrapped(text, width):
    lines, line = [], ""
    for w in text.split():
        if line and len(line) + len(w) >= width:
            lines.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return "\n".join([*lines, line])


@pytest.mark.parametrize("width", [40, 60, 140, 10_000])
def test_lines_and_paragraphs_of_any_width(width):
    for name in ("MIT-text", "ISC-text", "BSD-3-Clause-text", "Zlib-text", "Apache-2.0"):
        text = wrapped(TEMPLATES[name][1][-1], width)
        for lead in ("", "filler words of a line without any blank line behind it\n" * 42, "many filler words " * 500):
            found = scan(lead + text + "\nmore words of the same paragraph" * 30)
            assert [(f.license, f.verdict) for _, _, f in found] == [(name, "exact")]


def test_every_license_of_a_line_is_named():
    found = scan("Released under the MIT License. Licensed under CC BY 4.0. SPDX-License-Identifier: GPL-2.0-only")
    assert [(f.license, f.verdict) for _, _, f in found] == [("MIT", "exact"), ("CC-BY-4.0", "exact"), ("GPL-2.0", "exact")]


def plain_cost(block, wording, at):
    """The least cost of all spans that hold a word, by a plain dynamic program for each begin."""
    best = None
    for begin in range(at + 1):
        row = [2 * i for i in range(len(wording) + 1)]
        for end, word in enumerate(block[begin:], begin + 1):
            new = [row[0] + 1]
            for i, w in enumerate(wording, 1):
                new.append(min(new[-1] + 2, row[i] + 1, row[i - 1] + 2 * (w != word)))
            row = new
            if end > at and (best is None or row[-1] < best):
                best = row[-1]
    return best


def test_alignments_cost_least():
    rng = random.Random(5)
    for _ in range(150):
        words = [rng.choice("abcde") for _ in range(rng.randint(1, 14))]
        wording = tuple(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
        at = rng.randrange(len(words))
        m = align(tuple(words), wording, at)
        assert m.begin <= at < m.end
        replaced = m.missing + m.added - (m.end - m.begin - (len(wording) - m.missing))  # words that stand for a missing one
        assert m.end - m.begin == len(wording) - m.missing + m.added and replaced == m.missing
        pairs = sum(min(len(a.split()), len(b.split())) for a, b in (x[2:-1].split("]+[") for x in m.shown))
        assert plain_cost(words, wording, at) <= 2 * m.missing + m.added
        assert 2 * m.missing + m.added - pairs <= plain_cost(words, wording, at)


def test_equals_alignments_of_all_wordings(spark):
    """Without blocks, compression and its share: every wording held against the whole text at every cue."""
    rng = random.Random(11)
    filler = "harbour lamp of the quiet river an open license plate copyright office and permission slips under version 2 apache people".split()
    some = [(n, t) for n, (_, ts) in TEMPLATES.items() for t in ts if len(t) < 700]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 3)):
            words = rng.choice(some)[1].split()
            for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = [rng.choice(filler) for _ in range(rng.randint(0, 2))]
            parts += [" ".join(rng.choice(filler) for _ in range(rng.randint(2, 60))), wrapped(" ".join(words), rng.choice((30, 80, 500)))]
        texts.append(rng.choice(("\n", ". ", " ")).join(parts))
    known = license_scan_module.wordings()[0]
    want = {}
    for i, text in enumerate(texts):
        words = words_of(text)
        starts = [m.start() for m in license_scan_module._WORD.finditer(text)]
        hits = set()
        for c in license_scan_module._CUE.finditer(text):
            at = max(k for k, s in enumerate(starts) if s <= c.start())
            for k, w in enumerate(known):
                m = align(words, w.words, at, w.keys)
                if m.verdict != "unconfirmed":
                    hits.add((-m.worth(w), m.missing + m.added, -len(w.words), k, m.begin, m.end, m.keys, m.verdict))
        chosen = []
        for h in sorted(hits):
            lic = known[h[3]].license
            if not any(h[4] < o[5] and o[4] < h[5] and (known[o[3]].license == lic or all(o[4] <= p < o[5] for p in h[6])) for o in chosen):
                chosen.append(h)
        want[i] = sorted((starts[h[4]], known[h[3]].license, h[7]) for h in chosen)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {i: [] for i in want}
    for r in license_scan(docs).collect():
        if r.verdict != "unconfirmed":
            got[r.doc_id].append((r.offset, r.license, r.verdict))
    assert {i: sorted(v) for i, v in got.items()} == want
    assert sum(map(len, want.values())) > 60


def test_many_cues_in_a_long_text():
    text = "the licence of a copyright holder, says nobody. " * 3000 + "Released under the MIT License."
    found = scan(text)
    assert [(f.license, f.verdict) for _, _, f in found if f.verdict != "unconfirmed"] == [("MIT", "exact")]


def test_a_text_over_all_slices(spark):
    long = "harbour lamp of the quiet river " * 290_000
    docs = spark.createDataFrame([(1, f"{long}\nReleased under the MIT License.\n{long}"), (2, None)], "doc_id long, text string").coalesce(1)
    [r] = license_scan(docs).collect()
    assert (r.doc_id, r.offset, r.license, r.verdict) == (1, len(long) + 1, "MIT", "exact")
