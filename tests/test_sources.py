import json

import pytest
from pyspark.sql import functions as F

from pricelode.sources import feeds, sinks
from pricelode.sources.shops import CANONICAL, FEEDS, imported
from pricelode.streaming import changes

def as_of():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")


def test_csv_with_mark_and_missing_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿title;ean\nx;1\n\"two\nlines\";\n", encoding="utf-8")
    path = str(tmp_path / "a.csv")
    assert feeds.sniff_delimiter(spark, path) == ";"
    found = feeds.read_csv(spark, path, ["ean", "title", "price"], delimiter=None)
    assert [tuple(r) for r in found.collect()] == [("1", "x", ""), ("", "two\nlines", "")]
    assert [r.line_number for r in feeds.numbered_lines(spark, path).collect()] == [2, 3]
    assert feeds.read_csv(spark, str(tmp_path / "none.csv"), ["a"]).count() == 0
    with pytest.raises(ValueError, match="lacks"):
        feeds.validated(found, ["url"])


def test_newest_file_and_tokens(spark, tmp_path):
    import os

    for name, age in (("x_final.csv", 100), ("y_final.csv", 50), ("z.csv", 1)):
        (tmp_path / name).write_text("1, 2;1\n3")
        os.utime(tmp_path / name, (1_700_000_000 - age, 1_700_000_000 - age))
    assert feeds.newest_file(spark, str(tmp_path), "_final.csv$").endswith("y_final.csv")
    assert feeds.newest_file(spark, str(tmp_path / "none"), "x") is None
    assert [r.token for r in feeds.token_list(spark, str(tmp_path / "z.csv")).orderBy("position").collect()] == ["1", "2", "3"]
    stamped = feeds.with_captured_at(spark.read.option("header", True).csv(str(tmp_path / "z.csv")))
    assert stamped.first().captured_at.year == 2023


def test_json_sources(spark, tmp_path):
    product = {"id": 1, "title": "T", "vendor": "V", "handle": "h", "variants": [{"id": 5, "title": "LP", "sku": "s", "barcode": "4006381333931", "price": 1999, "available": True}]}
    df = spark.createDataFrame([(1, json.dumps(product)), (2, "{bad")], "k int, j string")
    assert [(r.k, r.variant_id, r.price) for r in feeds.product_variants(df, "j").collect()] == [(1, 5, 19.99)]
    found = {"releases": [{"id": "r", "title": "T", "score": 90, "artist-credit": [{"name": "A", "joinphrase": " & "}, {"artist": {"name": "B"}}]}]}
    assert [r.artist for r in feeds.releases(spark.createDataFrame([(json.dumps(found),)], "j string"), "j").collect()] == ["A & B"]
    (tmp_path / "m.json").write_text(json.dumps({"selected_shops": ["b", "a"], "bundle_dir": "d", "outputs": {"products_master": "p"}}))
    manifests = feeds.bundles(spark, str(tmp_path / "m.json"))
    assert feeds.bundles_of(manifests, ["a", "b"]).count() == 1 and feeds.bundles_of(manifests, ["a"]).count() == 0


def test_import_of_a_feed(spark, tmp_path):
    columns = "title string, price string, url string, scraped_at string, ean string, artist string, format string"
    rows = [
        ("Low - Hey What", "€ 19,99", "u1", "2024-01-01", "4006381333931", None, "LP"), ("Low - Hey What", "19.99", "u2", "2024-02-01", "4006381333931", None, "LP"), ("", "1", "u", None, "12345678", None, None),
        ("A - B", "x", "u3", None, "12345670", None, None), ("C - D", "5", "u4", None, "87654325", None, "CD"), ("E - F (2e hands)", "5", "u5", None, "11111111", None, "LP"),
        ("G - H", "5", "u6", "", "22222222", None, "LP"), ("G - I", "6", "u7", "", "22222222", None, "LP"),
    ]
    good, bad = imported(spark.createDataFrame(rows, columns), FEEDS["template"], as_of())
    assert set(CANONICAL) < set(good.columns)
    assert [(r.artist, r.title, str(r.price), r.product_url) for r in good.collect()] == [("Low", "Hey What", "19.99", "u2")]
    assert sorted(r.reject_reason for r in bad.collect()) == [
        "conflicting_duplicate_ean", "conflicting_duplicate_ean", "duplicate_same_product_same_price", "hidden_format", "invalid_price", "missing_title", "second_hand",
    ]
    sinks.write_rejects(bad, str(tmp_path / "rejects"))
    back = spark.read.option("header", True).csv(str(tmp_path / "rejects"))
    assert back.columns == ["reason", "artist", "ean", "format", "price", "scraped_at", "title", "url"] and back.count() == 7


@pytest.mark.parametrize("name", sorted(FEEDS))
def test_every_feed_maps(spark, name):
    feed = FEEDS[name]
    columns = sorted({*feed.required, feed.title, feed.price, feed.url, feed.ean})
    good, bad = imported(spark.createDataFrame([tuple("" for _ in columns)], ", ".join(f"{c} string" for c in columns)), feed, as_of())
    assert good.count() == 0 and bad.count() == 1


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "ts", "value", "event_type")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = changes.daily_buckets(stream, "user_id", "ts", "value", F.col("event_type") != "error", "100 days").writeStream.format("memory").queryName("buckets").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    from pricelode.operators.history import daily_history

    batch = daily_history(events, ["user_id"], "ts", "value", "event_type", F.col("event_type") != "error")
    key = lambda df: sorted((r.user_id, r.day, r.lowest_price is None, r.lowest_price, r.last_seen) for r in df.collect())
    assert key(spark.table("buckets")) == key(batch)


def test_change_capture_appends_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 08:00:00", 5.0), (2, "2024-01-01 08:00:00", 6.0)], "k int, t string, p double").select("k", F.col("t").cast("timestamp").alias("ts"), "p")
    run = lambda: changes.capture_changes(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "h"), str(tmp_path / "c"), ["k"], "ts", ["p"]).awaitTermination()
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    run()
    rows.withColumn("p", F.when(F.col("k") == 1, 5.0).otherwise(7.0)).withColumn("ts", F.expr("ts + interval 1 hour")).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted((r.k, r.p) for r in spark.read.parquet(str(tmp_path / "h")).collect()) == [(1, 5.0), (2, 6.0), (2, 7.0)]


def test_sinks_write_what_they_are_given(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", 1), ("c", None)], "k string, v int")
    sinks.write_summary(rows.limit(1), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().v == 2
    sinks.write_sorted_csv(rows, str(tmp_path / "csv"), ["k"])
    assert [r.k for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == ["a", "b", "c"]
    for _ in range(2):
        sinks.append_log(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6
    sinks.export_view(rows, str(tmp_path / "view"), ["v", "k"])
    assert spark.read.option("header", True).csv(str(tmp_path / "view")).columns == ["v", "k"]


def test_a_table_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_current(spark.range(3), path)
    sinks.write_current(spark.read.parquet(path).where("id > 0"), path)  # it may read what it replaces
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        sinks.write_current(spark.range(1).selectExpr("1 div id as id"), path)
    assert spark.read.parquet(path).count() == 2
    parts = str(tmp_path / "p")
    sinks.write_current(spark.range(4).selectExpr("id", "id % 2 as day"), parts, "day")
    sinks.write_current(spark.createDataFrame([(9, 1)], "id long, day long"), parts, "day")
    assert sorted(r.id for r in spark.read.parquet(parts).collect()) == [0, 2, 9]


def test_upload_files(spark, tmp_path):
    from pricelode.operators.validation import prepare_upload

    rows = spark.createDataFrame([(1, 5.0), (2, -1.0)], "k int, price double")
    pairs, report = prepare_upload({"products": (rows, [("invalid_price", F.col("price") <= 0)])})
    sinks.write_upload(pairs, report, str(tmp_path))
    read = lambda x: [r.k for r in spark.read.option("header", True).csv(str(tmp_path / x)).collect()]
    assert read("products_validated") == ["1"] and read("products_rejected") == ["2"]
    assert sorted((r.dataset, r.rejection_reason, r.n) for r in spark.read.json(str(tmp_path / "preflight_report")).collect()) == [("products", "", 1), ("products", "invalid_price", 1)]


def test_marketplace_files_are_converted(spark, tmp_path):
    (tmp_path / "m.csv").write_text("title~url~ean~price_eur\n A ~u~1~€ 1,50\n", encoding="utf-8")
    [r] = feeds.converted_marketplace(spark, str(tmp_path / "m.csv")).collect()
    assert (r.title, r.price_eur, r.artist) == ("A", "€ 1,50", "")


def test_lines_of_several_files(spark, tmp_path):
    for name, n in (("a", 3), ("b", 5)):
        (tmp_path / f"{name}.csv").write_text("x\n" + "\n".join(f"{name}{i}" for i in range(n)), encoding="utf-8")
    found = {r.x: r.line_number for r in feeds.numbered_lines(spark, str(tmp_path)).collect()}
    assert found == {f"{name}{i}": i + 2 for name, n in (("a", 3), ("b", 5)) for i in range(n)}


def test_one_row_a_key(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (" ", 3), (None, 4)], "k string, n int")
    assert [(r.k, r.n) for r in feeds.keyed(rows, "k", [F.desc("n")]).collect()] == [("a", 2)]


def test_change_capture_reads_one_row_a_key(spark, tmp_path):
    """Ten batches: the history grows, the latest table has one row for each key, two versions at most."""
    schema, got = "k int, ts timestamp, p double", []
    for i in range(6):
        price = 5.0 + i // 2
        spark.createDataFrame([(1, price), (2, 1.0)], "k int, p double").selectExpr("k", f"timestamp'2024-01-01 {i:02}:00:00' as ts", "p").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changes.capture_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "h"), str(tmp_path / "c"), ["k"], "ts", ["p"]).awaitTermination()
    got = sorted((r.k, r.p) for r in spark.read.parquet(str(tmp_path / "h")).collect())
    assert got == [(1, 5.0), (1, 6.0), (1, 7.0), (2, 1.0)]
    assert len([x for x in (tmp_path / "h_latest").iterdir() if x.name.startswith("batch=")]) == 2
    assert spark.read.parquet(str(tmp_path / "h_latest" / "batch=5")).count() == 2
