"""Release matching, EAN back-fill, seeds and requests by code as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.operators import matching
from pricelode.plans.catalogue import query
from pricelode.plans.tables import AS_OF, OBS, as_of, observations, table


@query(None)
def release_match(spark: SparkSession, d: str) -> DataFrame:
    """Parts against their own and their neighbour's name as releases; the similarity has no SQL twin."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("product"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"), F.col("p_partkey").cast("string").alias("ean"))
    own = p.select("product", F.concat(F.lit("a"), "ean").alias("release_id"), "title", "artist", F.when(F.col("product") % 3 == 0, F.col("ean")).otherwise("").alias("barcode"), F.lit(90.0).alias("score"), F.lit("Official").alias("status"))
    other = own.withColumn("product", F.col("product") + 1).withColumn("release_id", F.concat(F.lit("b"), "release_id"))
    return matching.match_releases(p, own.where("product % 7 <> 0").union(other))


_ROWS = """rows AS (SELECT page_id AS row, CASE page_id % 10 WHEN 0 THEN '' WHEN 1 THEN 'Closed' ELSE 'Shop' || page_id % 3 END AS shop, CASE WHEN page_id % 13 = 0 THEN '' ELSE 'https://x.nl/p' || page_id % 90 END AS url,
  CASE page_id % 6 WHEN 0 THEN '6.02E+11' WHEN 1 THEN 'abc' WHEN 2 THEN '12345' ELSE CAST(4000000000000 + page_id % 90 + CASE WHEN page_id % 17 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS ean FROM pages),
j AS (SELECT row, lower(shop) AS shop, url, ean, CASE WHEN shop = '' THEN 'missing_shop' WHEN shop = 'Closed' THEN 'excluded_shop' WHEN url = '' THEN 'missing_or_invalid_url' WHEN ean = '6.02E+11' THEN 'scientific_notation'
  WHEN ean = 'abc' THEN 'non_numeric_ean' WHEN ean = '12345' THEN 'invalid_ean_length_5' END AS reason FROM rows),
g AS (SELECT *, min(ean) OVER k <> max(ean) OVER k AS clash, row_number() OVER (PARTITION BY shop, url ORDER BY row) AS rn FROM j WHERE reason IS NULL WINDOW k AS (PARTITION BY shop, url))"""


def _backfill(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, s = F.col("page_id"), lambda x: x.cast("string")
    shop = F.when(k % 10 == 0, "").when(k % 10 == 1, "Closed").otherwise(F.concat(F.lit("Shop"), s(k % 3)))
    code = F.when(k % 6 == 0, "6.02E+11").when(k % 6 == 1, "abc").when(k % 6 == 2, "12345").otherwise(s(F.lit(4000000000000) + k % 90 + F.when(k % 17 == 0, 1).otherwise(0)))
    url = F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("HTTPS://X.nl//p"), s(k % 90), F.lit("/?a=1")))
    return matching.clean_backfill(table(spark, d, "pages").select(k.alias("row"), shop.alias("shop"), url.alias("url"), code.alias("ean")), ["closed"])


@query(f"WITH {_ROWS} SELECT reason, count(*) AS n FROM (SELECT reason FROM j WHERE reason IS NOT NULL UNION ALL SELECT CASE WHEN clash THEN 'conflict' ELSE 'clean' END FROM g WHERE rn = 1) GROUP BY 1")
def backfill_clean(spark: SparkSession, d: str) -> DataFrame:
    clean, clashing, bad = _backfill(spark, d)
    kinds = bad.select("reason").union(clashing.select(F.lit("conflict"))).union(clean.select(F.lit("clean")))
    return kinds.groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {_ROWS}, o AS (SELECT 'shop' || s AS shop, 'https://x.nl/p' || i AS url, i + CASE WHEN i % 5 = 0 THEN s ELSE 0 END AS product, CASE i % 4 WHEN 0 THEN CAST(4000000000000 + i AS VARCHAR) WHEN 1 THEN '4000000000999' ELSE '' END AS ean FROM (SELECT p_partkey AS i FROM part WHERE p_partkey % 7 <> 6) a, range(3) b(s)),
x AS (SELECT shop, url, count(DISTINCT product) AS n, min(product) AS p FROM o GROUP BY 1, 2), c AS (SELECT product, max(nullif(ean, '')) AS old FROM o GROUP BY 1)
SELECT row, g.ean, coalesce(n, 0) AS n_matches, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' WHEN old IS NULL THEN 'update' WHEN lpad(old, 14, '0') = lpad(g.ean, 14, '0') THEN 'already_set' ELSE 'conflict' END AS action
FROM g LEFT JOIN x ON x.shop = g.shop AND x.url = g.url LEFT JOIN c ON c.product = x.p AND n = 1 WHERE rn = 1 AND NOT clash""")
def backfill_plan(spark: SparkSession, d: str) -> DataFrame:
    """The plan of codes against the offers of three shops for most parts."""
    i, s, t = F.col("i"), F.col("s"), lambda x: x.cast("string")
    grid = table(spark, d, "part").where("p_partkey % 7 <> 6").select(F.col("p_partkey").alias("i"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("s"))
    code = F.when(i % 4 == 0, t(F.lit(4000000000000) + i)).when(i % 4 == 1, "4000000000999").otherwise("")
    offers = grid.select(F.concat(F.lit("Shop"), t(s)).alias("shop"), F.concat(F.lit("https://x.nl/p"), t(i)).alias("url"), (i + F.when(i % 5 == 0, s).otherwise(0)).alias("product"), code.alias("ean"))
    return matching.plan_backfill(_backfill(spark, d)[0], offers).select("row", "ean", "n_matches", "action")


@query("""WITH f AS (SELECT c_custkey, max(o_orderdate) AS seen, '' AS name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderdate < DATE '1995-01-01' GROUP BY 1),
t AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '1994-01-01' END AS seen, c_name AS name FROM customer WHERE c_custkey % 3 <> 0)
SELECT coalesce(f.c_custkey, t.c_custkey) AS c_custkey, greatest(f.seen, t.seen) AS seen, t.name FROM f FULL JOIN t ON f.c_custkey = t.c_custkey""")
def seed_union(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    old = table(spark, d, "orders").where(F.col("o_orderdate") < "1995-01-01").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("seen"))
    known = c.where("c_custkey % 3 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lit("1994-01-01").cast("timestamp_ntz")).alias("seen"), F.col("c_name").alias("name"))
    return matching.combine_seeds(old.join(c.select("c_custkey"), "c_custkey", "left_semi").withColumn("name", F.lit("")), known, "c_custkey", "seen")


@query("""WITH q AS (SELECT p_partkey AS job, p_size AS priority, CASE WHEN p_partkey % 4 = 0 THEN 'processing' ELSE 'done' END AS state, 1 AS request_count FROM part WHERE p_partkey % 2 = 0), a AS (SELECT DISTINCT l_partkey AS job FROM lineitem WHERE l_suppkey = 3)
SELECT coalesce(q.job, a.job) AS job, CASE WHEN a.job IS NULL THEN priority ELSE greatest(priority, 30) END AS priority, CASE WHEN a.job IS NULL OR state = 'processing' THEN state ELSE 'queued' END AS state,
  CAST(coalesce(request_count, 0) + CASE WHEN a.job IS NULL THEN 0 ELSE 1 END AS BIGINT) AS request_count FROM q FULL JOIN a ON q.job = a.job""")
def enqueue_by_ean(spark: SparkSession, d: str) -> DataFrame:
    p, code = table(spark, d, "part"), lambda k: (F.lit(400000000000) + F.col(k)).cast("string")
    queue = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("job"), F.col("p_size").alias("priority"), F.when(F.col("p_partkey") % 4 == 0, "processing").otherwise("done").alias("state"), F.lit(1).alias("request_count"))
    asked = table(spark, d, "lineitem").where("l_suppkey = 3").select(F.concat(F.lit("0"), code("l_partkey")).alias("ean"))
    return matching.enqueue_by_code(queue, p.select(F.col("p_partkey").alias("job"), code("p_partkey").alias("ean")), asked, 30)[0]


@query(f"WITH {OBS}, c AS (SELECT product FROM obs WHERE shop % 5 = 0 GROUP BY 1 HAVING max(seen) >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) SELECT p_partkey AS product, p_size FROM part WHERE p_partkey NOT IN (SELECT product FROM c)")
def stale_cache(spark: SparkSession, d: str) -> DataFrame:
    cache = observations(spark, d).where("shop % 5 = 0").groupBy("product").agg(F.max("seen").alias("checked"))
    return matching.uncached(table(spark, d, "part").select(F.col("p_partkey").alias("product"), "p_size"), cache, "product", "checked", as_of(), 30)


@query(f"WITH {OBS} SELECT product, max(shop % 50) + count(*) * 5 + 10 AS priority FROM obs GROUP BY 1")
def queue_priority(spark: SparkSession, d: str) -> DataFrame:
    return matching.offer_priority(observations(spark, d), "product", F.col("shop") % 50)


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.095)")
def referenced_products(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    return matching.within_keys(table(spark, d, "part"), "p_partkey", rows.where("l_quantity > 49"), rows.where("l_discount > 0.095")).select("p_partkey", "p_name")
