import base64
import hashlib
import random

import pytest

from pricelode.llm import queries, warc

BIG = "<p>x</p>" * 200_000


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (5, "https://www.b.example.com/x?q=1#top", "same"), (2, "http://a.example.com", "same"), (9, None, None), (4, "not a url\r\nat all", ""), (7, "http://a.example.com/é", BIG),
        (8, "http://user:pw@a.example.com:8080/z", "same"), (3, "http://a.example.com/", "ünï"), (3, "http://a.example.com/", "ünï"), (None, "http://c.example.com", "alone"),
        (None, "http://c.example.com", "same"),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, key string").repartition(3)


def test_pages_come_back(pages):
    rows = warc.archive_pages(pages).collect()
    want = {}
    for r in pages.collect():
        raw = (r.html or "").encode()
        want.setdefault((r.page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode()), []).append(r)
    assert len(rows) == 10
    got = {(r.page_id, r.payload_bytes, r.payload_digest): (r.record_type, r.refers_to) for r in rows}
    assert got.keys() == want.keys()
    kinds = {(k[0], k[1]): v for k, v in got.items()}
    assert kinds[2, 4] == ("response", None) and kinds[5, 4] == kinds[8, 4] == kinds[None, 4] == ("revisit", 2)
    assert kinds[4, 0] == ("response", None) and kinds[9, 0] == ("revisit", 4)
    assert kinds[3, 5] == ("response", None) and kinds[None, 5] == ("response", None) and kinds[7, len(BIG)][0] == "response"


def test_index_is_in_global_order(pages):
    rows = sorted(warc.archive_pages(pages).collect(), key=lambda r: (r.part, r.place))
    keys = [(r.url_key, r.captured_at) for r in rows]
    assert keys == sorted(keys)
    assert {r.url_key for r in rows} >= {"com,example,b)/x?q=1", "com,example,a)/", "com,example,a)/z", ""}


def test_records_are_read_by_offset(pages):
    from pricelode.llm.files import read_range

    for r in warc.archive_pages(pages).where("record_type = 'response'").collect():
        found = warc.parse(next(warc.members(read_range(r.archive, r.offset, r.length)))[2])
        assert found["size"] == r.payload_bytes and found["digest"] == r.payload_digest


def test_damage_is_found():
    raw = warc.record(1, "http://a", 0, b"payload", None, False, "a)/")
    content = next(warc.members(raw))[2]
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(content.replace(b"payload", b"pAyload"))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(raw[:-20]))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(20), i) for i in range(rng.randrange(30))) for _ in range(k)]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_empty_table(pages):
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_query_equals_sql(compare):
    compare(queries.QUERIES["op4_warc"], queries.ORACLES["op4_warc"])


@pytest.mark.parametrize("kind", ["long", "string"])
def test_many_repeats_give_the_same(pages, monkeypatch, kind):
    some = pages.withColumn("page_id", pages.page_id.cast(kind))
    rows = lambda: sorted(str(r) for r in warc.archive_pages(some).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = rows()
    monkeypatch.setattr(warc, "BROADCAST_REPEATS", 0)
    assert rows() == want


def test_many_repeats_leave_payloads_in_place(spark, monkeypatch):
    """A third of all rows has one payload, a third comes in pairs; the plan of the writer has no exchange."""
    monkeypatch.setattr(warc, "BROADCAST_REPEATS", 10)
    texts = ["hot", *(f"pair {k}" for k in range(300)), *(f"own {k}" for k in range(600))]
    rows = [(i, f"http://h{i % 7}.example/{i}", texts[0] if i % 3 == 0 else texts[1 + i // 3 % 300] if i % 3 == 1 else texts[301 + i // 3]) for i in range(1800)]
    plans, plain = [], warc.written
    monkeypatch.setattr(warc, "written", lambda df, label: (plans.append((label, df._jdf.queryExecution().executedPlan().toString())), plain(df, label))[1])
    found = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    first = {}
    for i, _, text in rows:
        first.setdefault(text, i)
    assert {r.page_id: (r.record_type, r.refers_to) for r in found} == {i: ("response", None) if first[t] == i else ("revisit", first[t]) for i, _, t in rows}
    assert "Exchange" not in dict(plans)["archives"]


def test_ids_of_any_text(spark):
    ids = ["a\nb", "", "100%", "%0A", "x\r\ny: z", " blank ", None, "7"]
    rows = [(i, f"http://h.example/{k % 3}", "same" if k % 2 else f"own {k}") for k, i in enumerate(ids)]
    found = warc.archive_pages(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert sorted(map(str, (r.page_id for r in found))) == sorted(map(str, ids))
    # equal payloads: "", "%0A", " blank " and "7"; the smallest is ""
    assert {r.page_id: r.refers_to for r in found if r.record_type == "revisit"} == {"%0A": "", " blank ": "", "7": ""}


def test_a_payload_over_all_slices(spark):
    long = "<p>" + "y" * (9 << 20)
    [r] = warc.archive_pages(spark.createDataFrame([(1, "http://a", long)], "page_id long, url string, html string")).collect()
    assert r.payload_bytes == len(long) and r.payload_digest == warc.digest32(long.encode())
