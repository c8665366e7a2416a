import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pricelode.llm import queries
from pricelode.llm.quality_rules import keep_good, quality_rules, text_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


@given(st.lists(st.text(alphabet="ab #\n\té", max_size=60), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_counts_equal_brute_force(texts):
    got = text_counts(pa.array(texts))
    assert [tuple(int(c[i]) for c in got) for i in range(len(texts))] == [brute(t) for t in texts]


def test_rows_of_the_odd_documents(cases):
    rows = quality_rules(cases).collect()
    assert len(rows) == cases.count()
    texts = defaultdict(set)
    for r in cases.collect():
        texts[r.doc_id].add(brute(r.text))
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in texts[r.doc_id]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_a_bad_host_loses_its_good_documents(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, "short", "bad") for i in range(200)] + [(200, good, "bad")] + [(1000 + i, f"{good} {i}", f"host{i % 9}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality_rules(docs).where("kept").collect()}
    assert kept == {1000 + i for i in range(300)}
    assert {r.doc_id for r in keep_good(docs).collect()} == kept


def test_a_small_host_is_shrunk_to_the_corpus(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(0, "short", "tiny"), (1, good, "tiny")] + [(10 + i, f"{good} {i}" if i % 20 else "short", f"host{i % 5}") for i in range(2000)]
    found = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id < 2").collect()}
    assert found[1].kept and not found[0].kept
    assert found[1].host_rate < 0.5  # the raw rate is one half


def test_the_stage_keeps_columns_and_rows(cases, no_docs):
    kept = keep_good(cases, host_limit=1.0)
    assert kept.columns == cases.columns
    assert {r.doc_id for r in kept.collect()} == {4}
    assert keep_good(cases).count() == 0  # most of its host fails
    assert keep_good(no_docs).count() == 0 and quality_rules(no_docs).count() == 0


def test_query_equals_sql(compare):
    compare(queries.QUERIES["op1_quality_rules"], queries.ORACLES["op1_quality_rules"])


def test_code_points_not_bytes():
    assert text_counts(pa.array(["é你 a"])).word_chars.tolist() == [3]
    assert np.all(text_counts(pa.array(["", " "])).n_words == 0)


def test_many_rejected_hosts_take_no_texts_along(spark, cases, monkeypatch):
    """The way of many rejected hosts gives what the broadcast gives, null hosts and repeated rows included."""
    from pricelode.llm import quality_rules as module

    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i % 50, "short", "bad") for i in range(100)] + [(7, good, "bad")] + [(i % 40, "short", None) for i in range(80)] + [(500, good, None)] + [(1000 + i, f"{good} {i}", f"host{i % 9}") for i in range(300)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, _row string")
    want = sorted(map(str, keep_good(docs).collect()))
    monkeypatch.setattr(module, "BROADCAST_HOSTS", 0)
    kept = keep_good(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == want and len(want) == 300


def test_a_text_over_all_slices(spark):
    """9 MB: its counts follow from how it is made."""
    line = "seven words # stand on this line"
    docs = spark.createDataFrame([(1, "\n".join([line] * 280_000), "h"), (2, "x", "h")], "doc_id long, text string, source string").coalesce(1)
    r = quality_rules(docs).where("doc_id = 1").first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (1_960_000, 280_000 * 26, 280_000, 279_999, 1_960_000)
