"""The index against a scan of all products."""

import random

import pytest
from pyspark.sql import functions as F

from pricelode.operators import postings, ranking


@pytest.fixture(scope="module")
def products(spark):
    rng = random.Random(8)
    words = ["Blue", "blue-ish", "É", "Ünder", "a", "%", "x_y", "  two   blanks ", "ab", "abc", "abcd", "100%", ""]
    rows = [(i * 7, rng.choice([None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 3)))]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))), None, "LP") for i in range(400)]
    return spark.createDataFrame(rows, "product long, artist string, title string, gtin string, format string").repartition(3)


@pytest.mark.parametrize("block", [50, postings.BLOCK])
def test_search_equals_a_scan(spark, products, tmp_path, block):
    index = str(tmp_path / "index")
    postings.build(products, index, "product", ranking.search_fields(), block)
    for query in ("blue", "Blue É", "a", "ab", "abcd", "%", "x_y", "100%", "h a", "two blanks", "zzz", "bluebird"):
        want = sorted(r["product"] for r in ranking.matching(products, query).collect())
        assert sorted(r["product"] for r in ranking.indexed_matching(spark, index, query).collect()) == want
    assert postings.candidates(spark, index, "product", "").count() == 0


def test_only_the_grams_of_the_query_are_read(spark, products, tmp_path):
    index = str(tmp_path / "index")
    postings.build(products, index, "product", [F.lower("title")], 50)
    found = postings.postings(spark, index, "abcd")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "folder#" in plan and "PartitionFilters: [folder" in plan.replace("isnotnull(folder", "folder") or "PartitionFilters" in plan
    assert "In(gram, [abc,bcd])" in plan and {r.gram for r in found.select("gram").distinct().collect()} == {"abc", "bcd"}
    assert max(len(r.products) for r in found.collect()) <= 50 and all(r.products == sorted(r.products) for r in found.collect())
    rows = postings.candidates(spark, index, "product", "abcd")
    assert "PartitionFilters" in rows._jdf.queryExecution().executedPlan().toString()


def test_no_products(spark, products, tmp_path):
    postings.build(products.limit(0), str(tmp_path / "none"), "product", [F.col("title")])
    assert postings.grams_of("ab") == ["ab"] and postings.grams_of("abab") == ["aba", "bab"] and postings.grams_of("") == []


def test_grams_are_cut_by_pieces_of_blocks(spark, products):
    """Not in the tasks of the scan, of which a small file has one for all products."""
    rows = products.coalesce(1).withColumn("block", F.floor(F.col("product") / 4000).cast("long"))
    dealt = postings._pairs(rows, "product", ranking.search_fields(), 4000)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("hashpartitioning(block") and "FLOOR" in plan[plan.index("hashpartitioning(block") :]
    want = {(p, g) for p, texts in ((r["product"], r[1:]) for r in products.select("product", *ranking.search_fields()).collect()) for t in texts for n in (1, 2, 3) for g in (t[i : i + n] for i in range(len(t) - n + 1))}
    got = [(r["product"], r.gram) for r in dealt.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_texts_are_made_once(spark, products):
    """Not again for each gram that is cut from them."""
    rows = products.withColumn("block", F.lit(0).cast("long"))
    plan = postings._pairs(rows, "product", ranking.search_fields(), 4000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(concat_ws( , artist") == 1
