"""Folders of feeds, merges in place, counters of writes, SQL functions, rules over URLs and label order as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.functions import registered, text
from pricelode.functions.urls import part
from pricelode.operators import merge, prefix_rules
from pricelode.plans.catalogue import query
from pricelode.plans.tables import AS_OF, table, work_folder
from pricelode.sources import feed_files, feeds, sinks, versions


@query("""SELECT p_partkey % 4 AS dialect, CAST(p_partkey AS VARCHAR) AS ean, p_name || CASE WHEN p_size > 25 THEN ';,~"' ELSE '' END AS title, CASE WHEN p_partkey % 4 < 2 THEN CAST(p_size AS VARCHAR) ELSE '' END AS size,
count(*) OVER (PARTITION BY p_partkey % 4) AS n_rows FROM part""")
def feed_folder(spark: SparkSession, d: str) -> DataFrame:
    """A folder with the parts in four dialects, one with byte order marks and two without sizes, read in one scan. Rows of a
    folder are counted by the last line numbers of its files."""
    path = work_folder(spark, "feeds")
    parts = table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("ean"), F.concat("p_name", F.when(F.col("p_size") > 25, F.lit(';,~"')).otherwise(F.lit(""))).alias("title"), F.col("p_size").cast("string").alias("size"), (F.col("p_partkey") % 4).alias("dialect"),
    )
    headers = [("﻿ean", "title", "size"), ("title", "size", "ean"), ("ean", "title"), ("title", "ean")]
    for k, (delimiter, header) in enumerate(zip((",", ";", "\t", "|"), headers, strict=True)):
        some = parts.where(F.col("dialect") == k).select(*(F.col(c.lstrip("﻿")).alias(c) for c in header))
        some.write.options(header=True, sep=delimiter, escape='"').csv(f"{path}/{k}")
    found = feed_files.read_folder(spark, path, ["ean", "title", "size"], required=["ean", "title"])
    found = found.withColumn("dialect", F.regexp_extract("source_file", "([0-3])/[^/]*$", 1).cast("long"))
    lines = found.groupBy("dialect", "source_file").agg(F.max("line_number").alias("last")).groupBy("dialect").agg(F.sum(F.col("last") - 1).alias("n_rows"))
    return found.join(F.broadcast(lines), "dialect").select("dialect", "ean", "title", "size", "n_rows")  # four rows


@query("""WITH o AS (SELECT o_custkey AS k, max(o_totalprice) AS price, max(o_orderdate) AS seen FROM orders GROUP BY 1 UNION ALL SELECT c_custkey + 10000000, c_acctbal, NULL FROM customer WHERE c_custkey % 10 = 0),
c AS (SELECT c_custkey AS k, c_acctbal AS price, c_mktsegment AS segment FROM customer)
SELECT coalesce(o.k, c.k) AS k, greatest(c.price, o.price) AS price, o.seen, c.segment FROM c FULL JOIN o ON c.k = o.k""")
def merge_in_place(spark: SparkSession, d: str) -> DataFrame:
    """Customers in buckets, into which their orders are merged and then new customers: the table's rows are never exchanged."""
    path = work_folder(spark, "merged")
    kinds = dict(table(spark, d, "orders").dtypes)
    current = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("price"), F.lit(None).cast(kinds["o_orderdate"]).alias("seen"), F.col("c_mktsegment").alias("segment"))
    versions.create(current, path, ["k"], 8)
    by_customer = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("price"), F.max("o_orderdate").alias("seen"), F.lit(None).cast("string").alias("segment"))
    policies = {"price": merge.GREATEST, "seen": merge.REPLACE, "segment": merge.KEEP}
    versions.merge(spark, path, by_customer, policies)
    fresh = table(spark, d, "customer").where("c_custkey % 10 = 0").select((F.col("c_custkey") + 10_000_000).alias("k"), F.col("c_acctbal").alias("price"), F.lit(None).cast(kinds["o_orderdate"]).alias("seen"), F.lit(None).cast("string").alias("segment"))
    versions.merge(spark, path, fresh, policies)
    versions.drop_old(spark, path)
    return versions.read(spark, path)


@query("""WITH l AS (SELECT *, l_quantity > 45 AS too_many, l_discount > 0.08 AS too_cheap FROM lineitem)
SELECT count(*) AS processed, count(*) FILTER (too_many) AS too_many, count(*) FILTER (too_cheap AND NOT too_many) AS too_cheap, max(l_extendedprice) AS highest, count(*) FILTER (NOT too_many AND NOT too_cheap) AS written FROM l""")
def counted_write(spark: SparkSession, d: str) -> DataFrame:
    """A run's counters out of the job that writes its rows, as its entry in the log; ``written`` counts what is there."""
    path = work_folder(spark, "counted")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", (F.col("l_quantity") > 45).alias("too_many"), (F.col("l_discount") > 0.08).alias("too_cheap"))
    counters = {"processed": F.count("*"), "too_many": F.count_if("too_many"), "too_cheap": F.count_if(F.col("too_cheap") & ~F.col("too_many")), "highest": F.max("l_extendedprice")}
    counted = sinks.write_counted(rows, f"{path}/rows", counters, ~F.col("too_many") & ~F.col("too_cheap"))
    sinks.append_log(spark.createDataFrame([tuple(counted[c] for c in counters)], "processed long, too_many long, too_cheap long, highest double"), f"{path}/log")
    return spark.read.parquet(f"{path}/log").crossJoin(spark.read.parquet(f"{path}/rows").agg(F.count("*").alias("written")))  # one row each


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE left(CAST(c_custkey * 7919000001 AS VARCHAR), 7 + CAST(c_custkey % 9 AS INT)) || ' ean' END AS raw FROM customer),
n AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS code FROM c), e AS (SELECT *, CASE WHEN length(code) = 11 THEN '0' || code WHEN length(code) IN (8, 12, 13, 14) THEN code END AS ean FROM n)
SELECT c_custkey, ean, lpad(ean, 14, '0') AS gtin FROM e""")
def sql_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Product codes made of keys, read by the functions that SQL users call."""
    registered.register(spark)
    raw = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.left((F.col("c_custkey") * 7919000001).cast("string"), (7 + F.col("c_custkey") % 9).cast("int")), F.lit(" ean")))
    table(spark, d, "customer").select("c_custkey", raw.alias("raw")).createOrReplaceTempView("raw_codes")
    return spark.sql("SELECT c_custkey, normalize_ean(raw) AS ean, gtin_14(raw) AS gtin FROM raw_codes")


@query(f"""SELECT CAST(row_number() OVER (ORDER BY priority DESC NULLS LAST, requested_at, job) AS INT) AS place, job, priority, requested_at FROM (
SELECT o_orderkey AS job, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey % 7 AS INT) END AS priority, CAST(o_orderdate AS TIMESTAMP) AS requested_at, o_orderstatus AS s, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 365 DAY AS again FROM orders)
WHERE s = 'O' OR (s = 'P' AND again <= TIMESTAMP '{AS_OF}') QUALIFY place <= 250""")
def sql_claims(spark: SparkSession, d: str) -> DataFrame:
    """The next jobs of a queue, by a table function."""
    day = F.col("o_orderdate").cast("timestamp_ntz")
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "retry_later").otherwise("done")
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.when(F.col("o_orderkey") % 7 > 0, (F.col("o_orderkey") % 7).cast("int")).alias("priority"), day.alias("requested_at"), state.alias("state"), (day + F.make_dt_interval(days=F.lit(365))).alias("next_attempt_at"))
    jobs.createOrReplaceTempView("claimable_jobs")
    registered.register_claims(spark, "claimable_jobs")
    return spark.sql(f"SELECT * FROM claim_next(250, TIMESTAMP_NTZ '{AS_OF}')")


@query(r"""WITH p AS (SELECT page_id, url, regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) AS host, regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path0 FROM pages),
q AS (SELECT *, CASE WHEN path0 = '' THEN '/' ELSE path0 END AS path FROM p),
r AS (SELECT DISTINCT host, left(path, 4) AS prefix, false AS allow FROM q WHERE page_id % 3 = 0 UNION ALL SELECT DISTINCT host, left(path, 5), true FROM q WHERE page_id % 5 = 0)
SELECT page_id, url, NOT EXISTS (SELECT 1 FROM r WHERE r.host = q.host AND NOT allow AND starts_with(q.path, prefix)) OR EXISTS (SELECT 1 FROM r WHERE r.host = q.host AND allow AND starts_with(q.path, prefix)) AS allowed FROM q""")
def page_rules(spark: SparkSession, d: str) -> DataFrame:
    """Which pages may be fetched, by rules that robots lines of their hosts give: some pages' paths are disallowed, longer prefixes of some allowed."""
    pages = table(spark, d, "pages").select("page_id", "url")
    host, path = part(F.col("url"), "host").alias("host"), prefix_rules.path_of(F.col("url"))
    line = lambda at, text: F.struct(F.lit(at).alias("at"), text.alias("line"))
    banned = pages.where("page_id % 3 = 0").select(host, line(1, F.concat(F.lit("Disallow: "), F.left(path, F.lit(4)), F.lit(" # no"))).alias("l"))
    free = pages.where("page_id % 5 = 0").select(host, line(2, F.concat(F.lit("allow:"), F.left(path, F.lit(5)))).alias("l"))
    heads = pages.select(host).distinct().select("host", F.explode(F.array(line(0, F.lit("User-agent: *")), line(3, F.lit("User-agent: other")), line(4, F.lit("Disallow: /")))).alias("l"))
    lines = reduce(DataFrame.union, [banned, free, heads]).distinct().select("host", "l.at", "l.line")
    return prefix_rules.allowed(pages, "url", prefix_rules.rules_of(lines, "host", "line", "at", "pricelode"))


@query("""WITH l AS (SELECT DISTINCT p_brand AS brand, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, 'e', 'é') WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, 'i', 'ï') ELSE p_name END AS label FROM part)
SELECT brand, label, CAST(rank() OVER (PARTITION BY brand ORDER BY strip_accents(lower(label)) COLLATE nl) AS INT) AS place FROM l""")
def dutch_label_order(spark: SparkSession, d: str) -> DataFrame:
    """Labels of each brand in Dutch order: accents and case don't count, so labels that differ in nothing else share a place."""
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    label = F.when(k == 0, F.replace(name, F.lit("e"), F.lit("é"))).when(k == 1, F.upper(name)).when(k == 2, F.replace(name, F.lit("i"), F.lit("ï"))).otherwise(name)
    labels = table(spark, d, "part").select(F.col("p_brand").alias("brand"), label.alias("label")).distinct()
    return labels.withColumn("place", F.rank().over(Window.partitionBy("brand").orderBy(text.dutch(F.col("label")))))


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS title, p_brand AS vendor, CAST(round(p_retailprice * 100) AS BIGINT) AS cents, p_size AS n FROM part),
v AS (SELECT k, title, vendor, unnest(range(0, n % 3)) AS i, cents, n FROM p WHERE k % 10 > 0)
SELECT k, title, vendor, k * 10 + i AS variant_id, 'V' || i AS variant_title, (cents + i) / 100 AS price, CASE WHEN i = 1 THEN (cents + 500) / 100 END AS list_price, n > 25 AS available FROM v""")
def json_variants(spark: SparkSession, d: str) -> DataFrame:
    """Product JSON made of the parts, with up to two variants; one text in ten can't be read."""
    k, cents = F.col("p_partkey"), F.round(F.col("p_retailprice") * 100).cast("long")
    variant = lambda i: F.struct(
        (k * 10 + i).alias("id"), F.concat(F.lit("V"), i.cast("string")).alias("title"), (cents + i).alias("price"), F.when(i == 1, cents + 500).alias("compare_at_price"), (F.col("p_size") > 25).alias("available")
    )
    variants = F.slice(F.transform(F.array(F.lit(0), F.lit(1)), variant), F.lit(1), F.col("p_size") % 3)
    whole = F.to_json(F.struct(k.alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("vendor"), variants.alias("variants")))
    payloads = table(spark, d, "part").select(k.alias("k"), F.when(k % 10 == 0, F.left(whole, F.lit(30))).otherwise(whole).alias("payload"))
    return feeds.product_variants(payloads, "payload").select("k", "title", "vendor", "variant_id", "variant_title", "price", "list_price", "available")


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS part, l_suppkey AS shop FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, part, shop) - 1 AS position FROM l)
SELECT k, CAST(position AS INT) AS position, 'r' || part AS release_id, 'A' || part || ' & B' || shop AS artist FROM r WHERE position < 3""")
def json_releases(spark: SparkSession, d: str) -> DataFrame:
    """Search results made of the lines of each order: their first three releases, with the artists' names joined."""
    credit = F.array(
        F.struct(F.concat(F.lit("A"), F.col("l_partkey").cast("string")).alias("name"), F.lit(" & ").alias("joinphrase"), F.lit(None).cast("struct<name: string>").alias("artist")),
        F.struct(F.lit("").alias("name"), F.lit(None).cast("string").alias("joinphrase"), F.struct(F.concat(F.lit("B"), F.col("l_suppkey").cast("string")).alias("name")).alias("artist")),
    )
    release = F.struct(F.concat(F.lit("r"), F.col("l_partkey").cast("string")).alias("id"), credit.alias("artist-credit"))
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("shop"), release.alias("release"))
    results = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    payloads = results.select("k", F.to_json(F.struct(F.transform("lines", lambda x: x["release"]).alias("releases"))).alias("payload"))
    return feeds.releases(payloads, "payload", most=3).select("k", "position", "release_id", "artist")


@query("""WITH c AS (SELECT c_custkey AS k, c_mktsegment AS segment, c_acctbal AS balance FROM customer)
SELECT CAST(max(k) AS VARCHAR) AS last, segment, CAST(max_by(balance, k) AS DOUBLE) AS balance, true AS stamped FROM c GROUP BY segment""")
def newest_feed(spark: SparkSession, d: str) -> DataFrame:
    """An export, found by its newest file; its rows take the time of their file, and each segment keeps its last."""
    path = work_folder(spark, "exports")
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("string").alias("balance"))
    sinks.export_view(rows.withColumn("hidden", F.lit("x")), path, ["k", "segment", "balance"])
    folder = feeds.newest_file(spark, path, r"\.csv$").rsplit("/", 1)[0]
    found = feeds.with_captured_at(feeds.validated(feeds.read_csv(spark, folder), ["k", "segment"]))
    last = feeds.keyed(found, "segment", [F.desc(F.col("k").cast("long"))])
    return last.select(F.col("k").alias("last"), "segment", F.col("balance").cast("double").alias("balance"), (F.col("captured_at") > F.lit("2000-01-01").cast("timestamp")).alias("stamped"))


@query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part")
def token_file(spark: SparkSession, d: str) -> DataFrame:
    """The distinct words of text files that hold the names of parts, split by blanks, commas and semicolons."""
    path = work_folder(spark, "tokens")
    k = F.col("p_partkey") % 3
    table(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.when(k == 0, F.lit(" , ")).when(k == 1, F.lit(";")).otherwise(F.lit(" "))).alias("value")).write.text(path)
    return feeds.token_list(spark, path).select("token")


@query("SELECT s_suppkey AS run, CAST(s_suppkey % 4 AS INT) AS shops FROM supplier WHERE s_suppkey % 4 = 2")
def bundle_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Manifests of one export for each supplier: those that cover exactly two given shops, in whatever order they name them."""
    path = work_folder(spark, "manifests")
    named = F.array(F.lit("b"), F.lit("a"), F.lit("c"))
    shops = F.slice(F.when(F.col("s_suppkey") % 8 < 4, named).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c"))), F.lit(1), (F.col("s_suppkey") % 4).cast("int"))
    rows = table(spark, d, "supplier").select(shops.alias("selected_shops"), F.col("s_suppkey").cast("string").alias("bundle_dir"), F.create_map(F.lit("n"), F.col("s_name")).alias("outputs"))
    rows.write.json(path)
    found = feeds.bundles_of(spark.read.schema("selected_shops array<string>, bundle_dir string, outputs map<string, string>").json(path), ["a", "b"])
    return found.select(F.col("bundle_dir").cast("long").alias("run"), F.size("selected_shops").alias("shops"))
