"""Prefix rules, counters, SQL functions and label order: cases that the tables lack."""

from pyspark.sql import functions as F

from pricelode.functions import ids, registered, text
from pricelode.operators import prefix_rules
from pricelode.sources import sinks


def test_rules_of_robots_lines(spark):
    lines = ["Disallow: /before", "# x", "User-agent: *", "Disallow: /a # all", "Allow: /a/b", "Disallow:", "user-agent: PriceBot", "disallow: /own", "User-agent: other", "Disallow: /", "nonsense", None]
    df = spark.createDataFrame([("h", i, x) for i, x in enumerate(lines)], "host string, at int, line string")
    rules = prefix_rules.rules_of(df, "host", "line", "at", "pricebot/1.0")
    assert sorted(tuple(r) for r in rules.collect()) == [("h", "/a", False), ("h", "/a/b", True), ("h", "/own", False)]
    urls = ["http://h/a/x", "http://h/a/bc?q", "http://h/A", "https://h/own", "http://h", "http://g/a", None, "http://h/a/x"]
    found = prefix_rules.allowed(spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, host int"), "url", rules)
    assert found.columns == ["url", "host", "allowed"]
    assert [r.allowed for r in found.orderBy("host").collect()] == [False, True, True, False, True, True, True, False]
    assert prefix_rules.allowed(spark.createDataFrame([("http://h/a",)], "url string"), "url", rules.limit(0)).first().allowed
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_rules_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    word = lambda n: "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, n)))
    rules = [(f"h{rng.randint(0, 3)}", word(4), rng.random() < 0.4) for _ in range(60)]
    urls = [(i, f"http://h{rng.randint(0, 4)}{word(7)}") for i in range(500)]
    found = prefix_rules.allowed(spark.createDataFrame(urls, "id int, url string"), "url", spark.createDataFrame(rules, "host string, prefix string, allow boolean"))
    for r in found.collect():
        host, path = r.url[7:9], r.url[9:]
        hit = {allow for h, p, allow in rules if h == host and path.startswith(p)}
        assert r.allowed == (True in hit or not hit), r


def test_counters_come_out_of_the_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "v int, why string")
    counted = sinks.write_counted(df, str(tmp_path / "t"), {"n": F.count("*"), "bad": F.count("why"), "most": F.max("v")}, F.col("v") > 1)
    assert counted == {"n": 3, "bad": 2, "most": 2} and spark.read.parquet(str(tmp_path / "t")).count() == 1
    assert sinks.write_counted(df.limit(0), str(tmp_path / "t"), {"n": F.count("*")}) == {"n": 0}


def test_sql_functions_equal_columns(spark):
    codes = ["4006381333931", " 12345678x", "12345678901", "", None, "1 2", "12345678901234", "400638133393.0"]
    spark.createDataFrame([(c,) for c in codes], "c string").createOrReplaceTempView("codes_for_sql")
    assert registered.register(spark) == ["normalize_ean", "gtin_14"]
    found = spark.sql("SELECT c, normalize_ean(c) AS e, gtin_14(c) AS g FROM codes_for_sql")
    plain = "Python" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.withColumn("want", ids.ean(F.col("c"), decimal_tail=False)).collect()
    assert plain and [r.e for r in rows] == [r.want for r in rows] and [r.g for r in rows] == [r.want.rjust(14, "0") if r.want else None for r in rows]


def test_dutch_order(spark):
    labels = ["zoë", "Ézra", "ezel", "EZRA", "Zoe", "ij", "appel", "Österreich", "oost"]
    df = spark.createDataFrame([(x,) for x in labels], "x string")
    found = [r.x for r in df.orderBy(text.dutch(F.col("x")), F.col("x")).collect()]
    assert found == ["appel", "ezel", "EZRA", "Ézra", "ij", "oost", "Österreich", "Zoe", "zoë"]
