"""Change capture with state: several runs against the whole input at once."""

import datetime as dt

from pyspark.sql import Row
from pyspark.sql import functions as F

from pricelode.operators import history
from pricelode.streaming import state

SCHEMA = "k string, ts timestamp_ntz, price double, note string"
DAY = dt.datetime(2024, 5, 1)


def at(hours):
    return DAY + dt.timedelta(hours=hours)


def runs(spark, path, parts):
    for part in parts:
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/in")
        state.append_changes(stream, f"{path}/out", f"{path}/checkpoint", ["k"], "ts", ["price", "note"]).awaitTermination()
    return sorted((tuple(r) for r in spark.read.parquet(f"{path}/out").collect()), key=str)


def test_runs_go_on_from_the_state(spark, tmp_path):
    first = [("a", at(1), 5.0, None), ("a", at(2), 5.0, None), ("b", at(1), None, "x"), (None, at(1), 1.0, "n"), ("c", None, 1.0, "no time")]
    second = [("a", at(3), 5.0, None), ("a", at(4), 6.0, None), ("b", at(2), None, "x"), ("b", at(3), None, None), (None, at(2), 1.0, "n")]
    late = [("a", at(2.5), 99.0, None), ("a", at(4), 6.0, None), ("b", at(1), None, "x"), ("d", at(1), 2.0, "d")]  # late, repeated, repeated, a new key
    last = [("a", at(5), 6.0, None), ("a", at(30), 6.0, None), ("a", at(30), 6.0, None), ("d", at(2), 2.0, "e")]
    got = runs(spark, str(tmp_path), [first, second, late, last])
    want = [
        ("a", at(1), 5.0, None), ("a", at(4), 6.0, None), ("a", at(30), 6.0, None), ("b", at(1), None, "x"), ("b", at(3), None, None), (None, at(1), 1.0, "n"), ("d", at(1), 2.0, "d"), ("d", at(2), 2.0, "e"),
    ]
    assert got == sorted(want, key=str)


def test_bitmaps_add_up(spark):
    """Shops of several buckets, days and products, null shops; totals from days equal distinct counts."""
    rows = [(i % 3, at(i % 70), float(i % 7), None if i % 11 == 0 else (i * 37) % 90_000, i % 4 != 0) for i in range(3000)]
    observed = spark.createDataFrame(rows, "product int, ts timestamp_ntz, price double, shop long, stock boolean")
    daily = history.daily_shop_bitmaps(observed, ["product"], "ts", "price", "shop", F.col("stock"))
    assert daily.select("bucket").distinct().count() == 3
    got = {r["product"]: (r.lowest_price, r.shops_in_stock, r.all_shops, r.last_seen) for r in history.rolled_up(daily, [F.col("product")]).collect()}
    for p in range(3):
        own = [r for r in rows if r[0] == p]
        assert got[p] == (min(r[2] for r in own if r[4]), len({r[3] for r in own if r[4] and r[3] is not None}), len({r[3] for r in own if r[3] is not None}), max(r[1] for r in own))
    plan = history.rolled_up(daily, [F.col("product")])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    by_day = {(r["product"], r.day): r.shops_in_stock for r in history.rolled_up(daily, [F.col("product"), F.col("day")]).collect()}
    want = {(r["product"], r.day): r.shops_in_stock for r in history.daily_history(observed, ["product"], "ts", "price", "shop", F.col("stock")).collect()}
    assert by_day == want


def test_bitmaps_of_sparse_days_are_small(spark):
    """a day of one shop takes a few bytes, not two bitmaps of 4 kB, and nothing is sorted to bring bitmaps together."""
    observed = spark.createDataFrame([(i, at(i), 1.0, i * 64, True) for i in range(50)] + [(0, at(0), 1.0, 63, False)], "product int, ts timestamp_ntz, price double, shop long, stock boolean")
    daily = history.daily_shop_bitmaps(observed, ["product"], "ts", "price", "shop", F.col("stock"))
    assert dict(daily.dtypes)["in_stock"] == dict(daily.dtypes)["shops"] == "bigint"
    found = history.rolled_up(daily, [F.col("product")])
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["product"]: (r.shops_in_stock, r.all_shops) for r in found.collect()} == {i: (1, 2 if i == 0 else 1) for i in range(50)}


def test_months_of_bitmaps(spark):
    """months from days by hash, with days of one shop in different months and buckets."""
    rows = [(i % 2, at(i * 24), float(i), (i * 700) % 70_000 if i % 9 else None, i % 3 != 0) for i in range(90)]
    observed = spark.createDataFrame(rows, "product int, ts timestamp_ntz, price double, shop long, stock boolean")
    monthly = history.rolled_up(history.daily_shop_bitmaps(observed, ["product"], "ts", "price", "shop", F.col("stock")), [F.col("product"), F.trunc("day", "month").alias("month")])
    assert "SortAggregate" not in monthly._jdf.queryExecution().executedPlan().toString()
    day = history.local_day(F.col("ts"), history.SHOP_ZONE)
    want = observed.groupBy("product", F.trunc(day, "month").alias("month")).agg(
        F.min(F.when(F.col("stock"), F.col("price"))), F.count_distinct(F.when(F.col("stock"), F.col("shop"))), F.count_distinct("shop"), F.max("ts")
    )
    assert sorted(map(tuple, monthly.collect())) == sorted(map(tuple, want.collect()))


def test_a_key_costs_its_rows_and_no_frame():
    """the processor takes plain rows, so that a key of few rows builds no pandas frame, and asks the store once."""

    class Last:
        asked, told = 0, None

        def get(self):
            self.asked += 1
            return self.told

        def update(self, told):
            self.told = told

    processor = state.NewObservations("ts", ["price", "note"])
    processor.last = Last()
    send = lambda *rows: [tuple(r) for r in processor.handleInputRows(("a",), iter([Row(k="a", ts=t, price=p, note=n) for t, p, n in rows]), None)]
    assert send((at(2), 5.0, None), (at(1), 5.0, None), (None, 1.0, "no time"), (at(3), 6.0, "x")) == [("a", at(1), 5.0, None), ("a", at(3), 6.0, "x")]
    assert processor.last.asked == 1 and send((at(3), 6.0, "x"), (at(2), 9.0, None)) == [] and send((at(30), 6.0, "x")) == [("a", at(30), 6.0, "x")]


def test_bitmaps_meet_before_they_are_aggregated(spark):
    """rows are dealt out first, so no task of a scan fills a table of days or months (of which there are nearly as many as observations), and months take one exchange."""
    observed = spark.createDataFrame([(i % 9, at(i), 1.0, i % 200, True) for i in range(400)], "product int, ts timestamp_ntz, price double, shop long, stock boolean")
    daily = history.daily_shop_bitmaps(observed, ["product"], "ts", "price", "shop", F.col("stock"))
    stored = spark.createDataFrame([(0, at(0).date(), 1, 0, 1, 1, 1.0, at(0))], daily.schema)
    rolled = history.rolled_up(stored, [F.col("product"), F.trunc("day", "month").alias("month")])
    for found in (daily, rolled):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan[plan.index("Exchange hashpartitioning") :]
