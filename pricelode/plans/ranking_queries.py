"""Search, suggestions, top lists and queues as queries. Parts stand for products (brand and
name for artist and title), orders for queue items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.operators import history, postings, queueing, ranking
from pricelode.plans.catalogue import ORACLES, query
from pricelode.plans.price_queries import latest
from pricelode.plans.tables import AS_OF, LATEST_SQL, OBS, as_of, observations, table, work_folder

QUERY = "brand#1"

_BEST_SQL = f"""{OBS}, {LATEST_SQL}, f AS (SELECT *, in_stock AND seen >= TIMESTAMP '{AS_OF}' - INTERVAL 8760 HOUR AS fresh FROM latest),
best AS (SELECT product, min(price) FILTER (fresh) AS low, count(DISTINCT shop) FILTER (fresh) AS fresh_n, count(DISTINCT shop) AS all_n FROM f GROUP BY 1),
prod AS (SELECT p_partkey AS product, p_brand AS artist, p_name AS title, CASE WHEN p_size % 10 = 0 THEN 'CD' ELSE 'Vinyl' END AS format, lower(trim(p_brand)) AS a, lower(trim(p_name)) AS t, lower(trim(p_brand)) || ' ' || lower(trim(p_name)) AS b FROM part)"""


def _best(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    found = history.best_prices(latest(spark, d, of), "product", "shop", "price", "seen", F.col("in_stock"), as_of(), hours=8760)
    return found.drop("best_price_last_seen_at")


def _products(spark: SparkSession, d: str) -> DataFrame:
    form = F.when(F.col("p_size") % 10 == 0, "CD").otherwise("Vinyl")
    return table(spark, d, "part").select(F.col("p_partkey").alias("product"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("gtin"), form.alias("format"))


_SCORE = " + ".join(
    f"CASE WHEN {test} THEN {w} ELSE 0 END"
    for test, w in [
        ("b = q", 1200), ("t = q", 1000), ("a = q", 900), ("starts_with(b, q)", 600), ("starts_with(t, q)", 500), ("starts_with(a, q)", 450), ("contains(b, q)", 250), ("contains(t, q)", 220),
        ("contains(a, q)", 200), ("contains(b, q)", 180), ("low IS NOT NULL", 40), ("low < 20", 15),
    ]
)
_SCORE += " + CASE WHEN contains(t, q) THEN 30 WHEN contains(a, q) THEN 25 WHEN contains(b, q) THEN 15 ELSE 0 END + least(coalesce(fresh_n, 0), 5) * 20 + least(coalesce(all_n, 0), 5) * 8"


@query(f"""WITH {_BEST_SQL}, s AS (SELECT product, artist, title, CAST({_SCORE} AS INT) AS score, low AS price, coalesce(fresh_n, 0) AS found_in
  FROM (SELECT *, '{QUERY}' AS q FROM prod) LEFT JOIN best USING (product) WHERE format <> 'CD' AND contains(b, q))
SELECT * FROM s WHERE score > 0 AND found_in > 0 ORDER BY score DESC, price ASC NULLS LAST, found_in DESC, artist, product LIMIT 24""")
def search_rank(spark: SparkSession, d: str) -> DataFrame:
    found = ranking.matching(_products(spark, d), QUERY)  # only their offers are priced
    return ranking.search(found, _best(spark, d, found), QUERY)


@query(f"""WITH {_BEST_SQL}, q AS (SELECT *, 'brand#2' AS q FROM prod WHERE format <> 'CD'),
ar AS (SELECT a, CASE WHEN a = q THEN 0 WHEN starts_with(a, q) THEN 1 WHEN contains(a, q) THEN 2 ELSE 9 END AS bucket,
  CASE WHEN a = q THEN 3000 WHEN starts_with(a, q || ' ') THEN 2600 WHEN starts_with(a, q) THEN 2400 WHEN contains(a, ' ' || q) THEN 1600 WHEN contains(a, q) THEN 1400 ELSE 0 END AS score, artist FROM q),
ga AS (SELECT 'artist' AS kind, min(artist) AS label, '' AS sublabel, min(bucket) AS bucket, max(score) AS score FROM ar WHERE bucket <= 2 GROUP BY a),
al AS (SELECT a, t, artist, title, CASE WHEN t = q OR b = q THEN 0 WHEN starts_with(t, q) OR starts_with(b, q) THEN 1 WHEN contains(b, q) THEN 2 ELSE 9 END AS bucket,
  CASE WHEN t = q THEN 3200 WHEN b = q THEN 3100 WHEN starts_with(t, q) THEN 2700 WHEN starts_with(b, q) THEN 2550 WHEN contains(t, q) THEN 1750 WHEN contains(b, q) THEN 1600 ELSE 0 END AS score FROM q),
gb AS (SELECT 'album' AS kind, min(title) AS label, min(artist) AS sublabel, min(bucket) AS bucket, max(score) AS score FROM al WHERE bucket <= 2 GROUP BY a, t)
SELECT * FROM (SELECT * FROM ga UNION ALL SELECT * FROM gb) ORDER BY bucket, score DESC, kind DESC, strip_accents(lower(label)) COLLATE nl, label, sublabel LIMIT 3""")
def suggest_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranking.suggestions(_products(spark, d), "brand#2", 3)


def _index(spark: SparkSession, d: str) -> str:
    path = work_folder(spark, "postings")
    postings.build(_products(spark, d), path, "product", ranking.search_fields())
    return path


@query(ORACLES["search_rank"])
def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """The search by postings of grams."""
    found = ranking.indexed_matching(spark, _index(spark, d), QUERY)
    return ranking.search(found, _best(spark, d, found), QUERY)


@query(ORACLES["suggest_rank"])
def indexed_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return ranking.suggestions(ranking.indexed_matching(spark, _index(spark, d), "brand#2"), "brand#2", 3)


@query("SELECT p_partkey AS product, p_brand AS artist, p_name AS title FROM part WHERE p_size % 10 <> 0 AND contains(lower(p_brand || ' ' || p_name), '5 ')")
def indexed_short_search(spark: SparkSession, d: str) -> DataFrame:
    """A query of two characters over the border of two fields."""
    path = _index(spark, d)
    rows = postings.candidates(spark, path, "product", "5 ").where((F.col("format") != "CD") & F.lower(F.concat_ws(" ", "artist", "title")).contains("5 "))
    return rows.select("product", "artist", "title")


@query("SELECT lower(trim(p_brand)) AS key, min(p_brand) AS artist, count(*) AS n, max(CASE WHEN lower(p_brand) = 'brand#12' THEN 1000 WHEN starts_with(lower(p_brand), 'brand#12') THEN 800 ELSE 0 END) AS score FROM part GROUP BY 1")
def artist_facets(spark: SparkSession, d: str) -> DataFrame:
    return ranking.artist_facets(_products(spark, d), "brand#12")


@query(f"""WITH {_BEST_SQL}, top AS (SELECT * FROM best ORDER BY all_n DESC, low ASC NULLS LAST, product LIMIT 100)
SELECT product, low AS lowest_fresh_price, fresh_n AS fresh_instock_shop_count, all_n AS total_active_shop_count FROM top WHERE low IS NOT NULL AND low < 40000 ORDER BY all_n DESC, low, product LIMIT 25""")
def top_n_shops(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc("total_active_shop_count"), F.asc_nulls_last("lowest_fresh_price"), F.asc("product")]
    return ranking.top_then_filter(_best(spark, d), order, 100, F.col("lowest_fresh_price").isNotNull() & (F.col("lowest_fresh_price") < 40000), 25)


@query("WITH t AS (SELECT o_orderkey, o_orderdate, o_totalprice, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50) SELECT * FROM t WHERE o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 8")
def new_releases(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    return ranking.newest(rows, "o_orderdate", 50, F.col("o_orderstatus") != "P", 8, "o_orderkey")


@query(f"""WITH {OBS}, {LATEST_SQL} SELECT product, row_number() OVER (PARTITION BY product ORDER BY in_stock DESC, price, seen DESC, shop) - 1 AS position, shop, price, seen AS last_seen FROM latest""")
def offers_nested(spark: SparkSession, d: str) -> DataFrame:
    nested = ranking.nested_offers(latest(spark, d), "product", "shop", "price", "seen", F.col("in_stock"))
    return nested.select("product", F.posexplode("offers").alias("position", "o")).select("product", F.col("position").cast("long"), "o.shop", "o.price", "o.last_seen")


@query(f"""WITH {OBS}, {LATEST_SQL} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY product ORDER BY seen DESC, shop) AS INT) AS rank FROM latest) WHERE rank <= 3""")
def top_n_per_group(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_n(latest(spark, d), ["product"], [F.desc("seen"), F.asc("shop")], 3)


@query(f"""WITH {OBS}, c AS (SELECT product, shop, max(CASE WHEN price < 2000 THEN 90 ELSE 100 END + shop % 7 * 4) AS score FROM obs GROUP BY 1, 2),
r AS (SELECT *, lead(score) OVER w AS second_score, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY product ORDER BY score DESC, shop))
SELECT product, shop, score, second_score, CASE WHEN score >= 115 AND (second_score IS NULL OR score - second_score >= 12) THEN 'matched' WHEN score >= 100 THEN 'ambiguous' ELSE 'no_match' END AS decision FROM r WHERE rn = 1""")
def margin_decision(spark: SparkSession, d: str) -> DataFrame:
    score = F.when(F.col("price") < 2000, 90).otherwise(100) + F.col("shop") % 7 * 4
    return ranking.decide(observations(spark, d).groupBy("product", "shop").agg(F.max(score).alias("score")), "product", "score", [F.asc("shop")])


_QUEUE_SQL = "queue AS (SELECT o_orderkey AS job, o_custkey AS owner, 6 - CAST(o_orderpriority[1] AS INT) AS priority, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'done' ELSE 'processing' END AS state, o_orderdate AS requested_at FROM orders)"


def _queue(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "done").otherwise("processing")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("owner"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), state.alias("state"), F.col("o_orderdate").alias("requested_at")
    )


@query(f"WITH {_QUEUE_SQL} SELECT owner, max(requested_at) AS last_seen, count(DISTINCT priority) AS n FROM queue WHERE state = 'queued' OR (state = 'done' AND requested_at < DATE '1994-01-01') GROUP BY 1 ORDER BY last_seen DESC, n DESC, owner LIMIT 200")
def eligible_queue(spark: SparkSession, d: str) -> DataFrame:
    eligible = (F.col("state") == "queued") | ((F.col("state") == "done") & (F.col("requested_at") < "1994-01-01"))
    found = _queue(spark, d).where(eligible).groupBy("owner").agg(F.max("requested_at").alias("last_seen"), F.count_distinct("priority").alias("n"))
    return found.orderBy(F.desc("last_seen"), F.desc("n"), "owner").limit(200)


@query(f"""WITH {_QUEUE_SQL}, c AS (SELECT job FROM queue WHERE state = 'queued' ORDER BY priority DESC, requested_at, job LIMIT 40)
SELECT job, owner, priority, CASE WHEN c.job IS NOT NULL THEN 'processing' ELSE state END AS state, requested_at, CASE WHEN c.job IS NOT NULL THEN 'w1' END AS claimed_by, CASE WHEN c.job IS NOT NULL THEN TIMESTAMP '{AS_OF}' END AS claimed_at
FROM queue LEFT JOIN c USING (job)""")
def claim_order(spark: SparkSession, d: str) -> DataFrame:
    _, after = queueing.claim(_queue(spark, d), "job", "state", F.col("state") == "queued", queueing.claim_order("priority", "requested_at", "job"), 40, "w1", as_of())
    return after


@query(f"""WITH {_QUEUE_SQL}, q AS (SELECT owner, max(priority) AS priority, arg_max(state, job) AS state, count(*) AS request_count FROM queue WHERE owner % 3 <> 0 GROUP BY 1),
r AS (SELECT c_custkey AS owner, c_nationkey AS priority FROM customer WHERE c_custkey % 2 = 0), a AS (SELECT owner, max(priority) AS p, count(*) AS n FROM r GROUP BY 1)
SELECT owner, greatest(priority, p) AS priority, CASE WHEN n IS NULL THEN state WHEN state = 'processing' THEN 'processing' ELSE 'queued' END AS state, coalesce(request_count, 0) + coalesce(n, 0) AS request_count FROM q FULL JOIN a USING (owner)""")
def enqueue_merge(spark: SparkSession, d: str) -> DataFrame:
    queue = _queue(spark, d).where("owner % 3 <> 0").groupBy("owner").agg(F.max("priority").alias("priority"), F.max_by("state", "job").alias("state"), F.count("*").alias("request_count"))
    requests = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("owner"), F.col("c_nationkey").alias("priority"))
    return queueing.enqueue(queue, requests, "owner")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '1998-01-01') ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def fill_queue(spark: SparkSession, d: str) -> DataFrame:
    recent = table(spark, d, "orders").where(F.col("o_orderdate") >= "1998-01-01").select(F.col("o_custkey").alias("c_custkey"))
    rest = table(spark, d, "customer").select("c_custkey", "c_acctbal").join(recent, "c_custkey", "left_anti")
    return rest.orderBy(F.desc("c_acctbal"), "c_custkey").limit(100)


@query(f"""WITH j AS (SELECT o_orderkey AS job, CAST(o_orderkey % 9 AS INT) AS attempts, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus = 'F' END AS ok, o_orderkey % 11 = 0 AS permanent, o_orderkey % 5 = 0 AS none FROM orders),
n AS (SELECT *, attempts + CASE WHEN none THEN 0 ELSE 1 END AS a FROM j), s AS (SELECT *, CASE WHEN none THEN 'processing' WHEN ok THEN 'done' WHEN permanent OR a >= 8 THEN 'failed' ELSE 'retry_later' END AS state FROM n)
SELECT job, state, CAST(a AS INT) AS attempts, CASE WHEN state = 'retry_later' THEN TIMESTAMP '{AS_OF}' + to_minutes(CAST(least(1440, 10 * pow(2, a - 1)) AS BIGINT)) END AS next_attempt_at FROM s""")
def retry_transition(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    queue = o.select(k.alias("job"), F.lit("processing").alias("state"), (k % 9).cast("int").alias("attempts"), F.lit(None).cast("timestamp_ntz").alias("next_attempt_at"))
    results = o.where(k % 5 != 0).select(k.alias("job"), (F.col("o_orderstatus") == "F").alias("ok"), (k % 11 == 0).alias("permanent"))
    return queueing.finish(queue, results, "job", as_of())


_TURNS = "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS position, count(*) OVER () AS n FROM customer"


@query(f"SELECT c_custkey, (position - 140 % n + n) % n AS turn FROM ({_TURNS}) WHERE (position - 140 % n + n) % n < 60")
def round_robin_batch(spark: SparkSession, d: str) -> DataFrame:
    batch, _ = queueing.round_robin(table(spark, d, "customer").select("c_custkey"), "c_custkey", 60, 140)
    return batch.select("c_custkey", "turn")


@query("""WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS p, count(*) OVER () AS n FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000),
b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS p, count(*) OVER () AS n FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_acctbal > 5000)),
m AS (SELECT least(90, (SELECT count(*) FROM a)) AS m)
SELECT c_custkey, (p - 3 % n + n) % n AS turn FROM a, m WHERE (p - 3 % n + n) % n < m UNION ALL SELECT c_custkey, (p - 7 % n + n) % n + m FROM b, m WHERE (p - 7 % n + n) % n < 90 - m""")
def priority_round_robin(spark: SparkSession, d: str) -> DataFrame:
    first = (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 5000)
    return queueing.priority_round_robin(table(spark, d, "customer"), "c_custkey", first, 90, (3, 7)).select("c_custkey", "turn")


@query("WITH s AS (SELECT c_custkey, max(o_orderdate) AS seen FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate < DATE '1993-01-01' GROUP BY 1) SELECT * FROM s ORDER BY seen ASC NULLS FIRST, c_custkey LIMIT 150")
def stale_first(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where(F.col("o_orderdate") < "1993-01-01").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("seen"))
    return queueing.stalest(table(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left"), "seen", "c_custkey", 150)


@query(f"WITH {_QUEUE_SQL} SELECT state, count(*) AS n, count(*) FILTER (priority >= 4) AS n_attempted, count(*) FILTER (requested_at < DATE '1995-01-01') AS n_waiting FROM queue GROUP BY 1")
def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    return queueing.status_rollup(_queue(spark, d), "state", F.col("priority") >= 4, F.col("requested_at") < "1995-01-01")


@query("""WITH c AS (SELECT l_partkey AS product, l_suppkey AS shop, CAST(l_quantity AS INT) AS rank, l_returnflag = 'R' AS is_primary, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber * 100 END AS width, CASE WHEN l_linestatus = 'F' THEN 'published' ELSE 'pending' END AS status FROM lineitem)
SELECT product, shop, max(rank) AS rank, bool_or(is_primary) AS is_primary, min(width) AS width, CASE WHEN bool_or(status = 'published') THEN 'published' ELSE 'pending' END AS status FROM c GROUP BY 1, 2""")
def candidate_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("product"), F.col("l_suppkey").alias("shop"), F.col("l_quantity").cast("int").alias("rank"), (F.col("l_returnflag") == "R").alias("is_primary"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") * 100).alias("width"), F.lit(None).cast("int").alias("height"),
        F.when(F.col("l_linestatus") == "F", "published").otherwise("pending").alias("status"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")).otherwise(F.lit(99)).alias("seen_at"),
    )
    return queueing.merge_candidates(rows, ["product", "shop"]).drop("height")
