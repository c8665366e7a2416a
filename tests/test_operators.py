import datetime
import random

import pytest
from pyspark.sql import functions as F

from pricelode.functions import text
from pricelode.operators import history, joins, merge, queueing, ranking, validation

T = datetime.datetime


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_history_says_only_what_is_new(spark):
    old = spark.createDataFrame([(1, T(2024, 1, 1, 8), 10.0, None), (2, T(2024, 1, 1, 8), 10.0, "x")], "k int, ts timestamp_ntz, p double, a string")
    new = spark.createDataFrame([(1, T(2024, 1, 1, 9), 10.0, None), (2, T(2024, 1, 1, 9), 10.0, None), (3, T(2024, 1, 1), 1.0, "x")], old.schema)
    assert rows(history.history_to_append(old, new, ["k"], "ts", ["p", "a"]), "k") == [(2,), (3,)]
    next_day = new.withColumn("ts", F.expr("ts + interval 1 day"))
    assert rows(history.history_to_append(old, next_day, ["k"], "ts", ["p", "a"]), "k") == [(1,), (2,), (3,)]


def test_a_day_without_stock_has_a_row(spark):
    df = spark.createDataFrame([(1, T(2024, 1, 1), 5.0, 7, False)], "k int, ts timestamp_ntz, p double, s int, ok boolean")
    assert rows(history.daily_history(df, ["k"], "ts", "p", "s", F.col("ok")), "lowest_price", "shops_in_stock") == [(None, 0)]


def test_policies(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, n int")
    new = spark.createDataFrame([(2, "", 5), (3, "c", None)], old.schema)
    get = lambda **p: rows(merge.upsert(old, new, ["k"], p), "k", "s", "n")
    assert get(s=merge.KEEP, n=merge.GREATEST) == [(1, "a", 1), (2, "b", 5), (3, "c", None)]
    assert get(s=merge.NONBLANK, n=merge.LEAST) == [(1, "a", 1), (2, "b", 2), (3, "c", None)]
    assert get(s=merge.NEW, n=merge.REPLACE)[1] == (2, "", 5)
    with pytest.raises(ValueError, match="unknown policy"):
        get(s="x", n=merge.KEEP)
    assert rows(merge.append_absent(old, new, ["k"]), "k") == [(1,), (2,), (3,)]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "g", "a", 5.0), (2, "g", "a", 5.0), (3, "h", "a", 5.0), (4, "h", "a", 6.0), (5, "i", "a", 1.0)], "id int, gtin string, key string, price double")
    found = validation.reject_duplicates(df, "gtin", "key", "price", [F.desc("id")])
    assert {r.id: r.reject_reason for r in found.collect()} == {1: "duplicate_same_product_same_price", 2: None, 3: "conflicting_duplicate_ean", 4: "conflicting_duplicate_ean", 5: None}


def test_reasons(spark):
    rules = [("missing_shop", F.col("s") == ""), ("invalid_price", F.col("p").isNull())]
    df = spark.createDataFrame([("", None), ("x", 1.0)], "s string, p double").select(validation.all_reasons(rules).alias("a"), validation.first_reason(rules).alias("f"))
    assert df.collect() == [("missing_shop|invalid_price", "missing_shop"), ("", None)]


def test_rotation(spark):
    items = spark.range(5)
    batch, cursor = queueing.round_robin(items, "id", 2, 4)
    assert [r.id for r in batch.orderBy("turn").collect()] == [4, 0] and cursor == 1
    assert queueing.round_robin(items, "id", 0, 4)[0].count() == 0 and queueing.round_robin(items.limit(0), "id", 3, 4)[0].count() == 0


def test_priority_room_that_is_full_leaves_none(spark):
    taken = queueing.priority_round_robin(spark.range(10), "id", F.col("id") < 3, 3, (0, 0))
    assert sorted(r.id for r in taken.collect()) == [0, 1, 2]


def test_or_join_finds_each_pair_once(spark):
    a = spark.createDataFrame([(1, "x", "p"), (2, "y", "q")], "a int, u string, v string")
    b = spark.createDataFrame([(7, "x", "p"), (8, "z", "q"), (9, None, None)], "b int, s string, t string")
    assert rows(joins.or_join(a, b, [(F.col("u"), F.col("s")), (F.col("v"), F.col("t"))], "a", "b"), "a", "b") == [(1, 7), (2, 8)]
    assert rows(joins.or_anti(b, a, [(F.col("s"), F.col("u")), (F.col("t"), F.col("v"))]), "b") == [(9,)]


def test_or_join_is_no_nested_loop(spark):
    found = joins.or_join(spark.range(9).withColumnRenamed("id", "a"), spark.range(9).withColumnRenamed("id", "b"), [(F.col("a"), F.col("b")), (F.col("a") % 3, F.col("b") % 4)], "a", "b")
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_ids_that_resolve(spark):
    good, bad = joins.resolve_ids(spark.createDataFrame([("a",), ("b",)], "ean string"), spark.createDataFrame([("a", 1)], "ean string, product int"), "ean", "product")
    assert rows(good, "ean", "product") == [("a", 1)] and rows(bad, "ean") == [("b",)]


def test_claimed_jobs_leave_the_queue(spark):
    queue = spark.createDataFrame([(1, 5, "queued"), (2, 9, "queued"), (3, 9, "done")], "job int, priority int, state string").withColumn("at", F.lit(None).cast("timestamp"))
    claimed, after = queueing.claim(queue, "job", "state", F.col("state") == "queued", queueing.claim_order("priority", "at", "job"), 1, "w", F.current_timestamp())
    assert rows(claimed, "job") == [(2,)] and rows(after, "job", "state") == [(1, "queued"), (2, "processing"), (3, "done")]


def test_facets_and_suggestions(spark):
    products = spark.createDataFrame([(1, "LOW", "Hey What", None, "LP"), (2, "Low", "Low Life", None, "LP"), (3, "Slow", "Lowest", None, "cd")], "product int, artist string, title string, gtin string, format string")
    assert rows(ranking.artist_facets(products, "low"), "key", "n", "score") == [("low", 2, 1000), ("slow", 1, 250)]
    assert [r.label for r in ranking.suggestions(products, "low", 3).collect()][:2] == ["LOW", "Low Life"]


def test_filters_reach_the_scan(spark):
    from tables import DATA

    from pricelode.plans.price_queries import retention

    plan = retention(spark, str(DATA / "sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "l_comment" not in plan


def test_unresolved_codes_fail_the_job(spark):
    lookup = spark.createDataFrame([("a", 1), ("c", 2)], "ean string, product int")
    rows = lambda *codes: spark.createDataFrame([(c,) for c in codes], "ean string")
    assert sorted(r.product for r in joins.resolve_all(rows("a", "a", "c"), lookup, "ean", "product").collect()) == [1, 1, 2]
    assert joins.resolve_all(rows("a").limit(0), lookup, "ean", "product").count() == 0
    for codes, said in ((("a", "b"), "no product for ean b"), (("a", None), "no product for ean null")):
        with pytest.raises(Exception, match=said):
            joins.resolve_all(rows(*codes), lookup, "ean", "product").count()


def test_a_third_text_for_search(spark):
    some = spark.createDataFrame([("A  B", None, "1"), (None, None, None), ("", " ", "")], "artist string, title string, ean string")
    cols = [F.col(c) for c in some.columns]
    got = some.select(text.search_text(*cols).alias("a"), text.plain_search_text(*cols).alias("b"), text.staged_search_text(*cols).alias("c")).collect()
    assert [tuple(r) for r in got] == [("a b 1", "A  B 1", "a  b 1"), ("", None, ""), ("", None, "")]


def test_shops_are_counted_without_copies_of_rows(spark):
    offers = spark.createDataFrame(
        [(1, 7, 5.0, T(2024, 1, 9), True), (1, 7, 4.0, T(2024, 1, 1), True), (1, 8, 5.0, T(2024, 1, 10), True), (1, None, 3.0, T(2024, 1, 9), True), (1, 9, 1.0, T(2024, 1, 9), False), (2, 7, None, None, None)],
        "product int, shop int, price double, seen timestamp_ntz, in_stock boolean",
    )
    found = history.best_prices(offers, "product", "shop", "price", "seen", F.col("in_stock"), F.lit("2024-01-10").cast("timestamp_ntz"))
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, 3.0, 2, 3, T(2024, 1, 9)), (2, None, 0, 1, None)]


def test_duplicates_with_nulls(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 1), ("a", 1, 2.0, 2), ("b", 1, 2.0, 1), ("b", 1, 3.0, 2), ("c", 1, None, 1), ("c", 1, None, 2), (None, 1, 1.0, 1), ("d", 1, 2.0, 1), ("d", None, 2.0, 2)], "g string, k int, p double, at int")
    found = validation.reject_duplicates(df, "g", "k", "p", [F.desc("at")])
    old = "duplicate_same_product_same_price"
    got = {(r.g, r.at): r.reject_reason for r in found.collect()}
    clash = "conflicting_duplicate_ean"
    assert got == {("a", 1): old, ("a", 2): None, ("b", 1): clash, ("b", 2): clash, ("c", 1): clash, ("c", 2): clash, (None, 1): None, ("d", 1): old, ("d", 2): None}


def test_or_join_holds_no_result_for_repeats(spark):
    """rows of ids of one row aren't searched for repeats, and ids of several rows still give each pair once."""
    rng = random.Random(3)
    side = lambda n, ids: [(None if rng.random() < 0.05 else rng.randrange(ids), rng.choice([None, 0.0, -0.0, 1.0, 2.0]), rng.choice([None, "a", "b", "c"])) for _ in range(n)]
    one, two = side(60, 40), side(50, 30)
    a, b = spark.createDataFrame(one, "a int, u double, v string"), spark.createDataFrame(two, "b int, s double, t string")
    got = [(r.a, r.b) for r in joins.or_join(a, b, [(F.col("u"), F.col("s")), (F.col("v"), F.col("t"))], "a", "b").collect()]
    want = {(x[0], y[0]) for x in one for y in two if (x[1] is not None and x[1] == y[1]) or (x[2] is not None and x[2] == y[2])}
    assert len(got) == len(set(got)) and set(got) == want
    found = joins.or_join(a, b, [(F.col("u"), F.col("s")), (F.col("v"), F.col("t"))], "a", "b")
    assert not found._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")  # distinct over the pairs of repeated ids, not over all
