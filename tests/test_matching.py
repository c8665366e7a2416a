"""Queries that SQL can't express, against plain Python over the whole table."""

import pytest
from tables import DATA

from pricelode.functions import scoring
from pricelode.plans import catalogue

catalogue.load()


def longest(a, b):
    """The longest common block, the first in a, then in b: (begin in a, begin in b, length)."""
    best = (0, 0, 0)
    row = [0] * (len(b) + 1)
    for i in range(len(a)):
        new = [0] * (len(b) + 1)
        for j in range(len(b)):
            if a[i] == b[j]:
                new[j + 1] = row[j] + 1
                if new[j + 1] > best[2]:
                    best = (i - new[j + 1] + 1, j - new[j + 1] + 1, new[j + 1])
        row = new
    return best


def matched(a, b):
    if not a or not b:
        return 0
    i, j, n = longest(a, b)
    return n + matched(a[:i], b[:j]) + matched(a[i + n :], b[j + n :]) if n else 0


def ratio(a, b):
    a, b = (" ".join((x or "").split()) for x in (a, b))
    return 2 * matched(a, b) / (len(a) + len(b)) if a and b else 0.0


def parts(spark):
    return spark.read.parquet(str(DATA / "sf0.001" / "part.parquet")).collect()


def test_similarity_of_all_parts(spark):
    got = {r.p_partkey: r.ratio for r in catalogue.QUERIES["similarity"](spark, str(DATA / "sf0.001")).collect()}
    rows = parts(spark)
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.p_partkey] == pytest.approx(ratio(r.p_name, r.p_type), abs=1e-6)


def test_release_matches_of_all_parts(spark):
    """Every release of every product scored by the rules; the best by total, then by id."""
    from pyspark.sql import functions as F

    rows = parts(spark)
    releases = []
    for r in rows:
        own = {"title": r.p_name, "artist": r.p_brand, "barcode": str(r.p_partkey) if r.p_partkey % 3 == 0 else ""}
        if r.p_partkey % 7:
            releases.append((r.p_partkey, f"a{r.p_partkey}", own))
        releases.append((r.p_partkey + 1, f"ba{r.p_partkey}", own))
    known = {r.p_partkey: r for r in rows}
    flat = [(p, i, o["barcode"], ratio(known[p].p_name, o["title"]), ratio(known[p].p_brand, o["artist"])) for p, i, o in releases if p in known]
    df = spark.createDataFrame(flat, "product long, id string, barcode string, t double, a double")
    total = scoring.release_score(F.col("barcode"), F.col("product").cast("string"), F.lit(90.0), F.col("t"), F.col("a"), F.lit("Official"))
    scored = {}
    for r in df.select("product", "id", total.alias("s")).collect():
        scored.setdefault(r.product, []).append((-float(r.s), r.id))
    got = {r["product"]: r for r in catalogue.QUERIES["release_match"](spark, str(DATA / "sf0.001")).collect()}
    assert set(got) == set(known)
    for p in known:
        best = sorted(scored.get(p, []))
        if not best:
            assert got[p].decision == "no_match"
            continue
        assert got[p].release_id == best[0][1] and float(got[p].total) == pytest.approx(-best[0][0], abs=1e-6)
        assert got[p].second_score is None if len(best) == 1 else float(got[p].second_score) == pytest.approx(-best[1][0], abs=1e-6)
