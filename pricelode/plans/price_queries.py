"""Histories, latest offers, merges and joins over price observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.functions import dates, ids, text
from pricelode.operators import history, joins, merge
from pricelode.plans.catalogue import query
from pricelode.plans.tables import AS_OF, LATEST_SQL, OBS, as_of, latest_order, observations, table, work_folder


def latest(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    """The latest offers; with ``of``, of these products alone."""
    rows = observations(spark, d)
    if of is not None:
        rows = rows.join(of.select("product"), "product", "left_semi")
    return history.first_by(rows, ["product", "shop"], latest_order())


@query("""
SELECT user_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Amsterdam' AS DATE) AS day,
  min(value) FILTER (event_type <> 'error') AS lowest_price, count(DISTINCT event_type) FILTER (event_type <> 'error') AS shops_in_stock, max(ts) AS last_seen
FROM events GROUP BY 1, 2""")
def daily_price_history(spark: SparkSession, d: str) -> DataFrame:
    return history.daily_history(table(spark, d, "events"), ["user_id"], "ts", "value", "event_type", F.col("event_type") != "error")


@query(f"WITH {OBS} SELECT product, CAST((seen AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Amsterdam' AS DATE) AS day, min(price) FILTER (in_stock) AS lowest_price, "
       "count(DISTINCT shop) FILTER (in_stock) AS shops_in_stock, max(seen) AS last_seen FROM obs GROUP BY 1, 2")  # fmt: skip
def daily_offer_history(spark: SparkSession, d: str) -> DataFrame:
    return history.daily_history(observations(spark, d), ["product"], "seen", "price", "shop", F.col("in_stock"))


@query(f"WITH {OBS}, {LATEST_SQL} SELECT * FROM latest")
def latest_offer(spark: SparkSession, d: str) -> DataFrame:
    return latest(spark, d)


@query(f"""WITH {OBS}, {LATEST_SQL}, f AS (SELECT *, in_stock AND seen >= TIMESTAMP '{AS_OF}' - INTERVAL 720 HOUR AS fresh FROM latest)
SELECT product, min(price) FILTER (fresh) AS lowest_fresh_price, count(DISTINCT shop) FILTER (fresh) AS fresh_instock_shop_count,
  count(DISTINCT shop) AS total_active_shop_count, arg_min(seen, (price, -epoch_us(seen))) FILTER (fresh) AS best_price_last_seen_at
FROM f GROUP BY product""")
def best_price_summary(spark: SparkSession, d: str) -> DataFrame:
    return history.best_prices(latest(spark, d), "product", "shop", "price", "seen", F.col("in_stock"), as_of(), hours=720)


def _daily_bitmaps(spark: SparkSession, d: str) -> DataFrame:
    path = work_folder(spark, "bitmaps")
    history.daily_shop_bitmaps(observations(spark, d), ["product"], "seen", "price", "shop", F.col("in_stock")).write.parquet(path)
    return spark.read.parquet(path)


@query(f"""WITH {OBS} SELECT product, min(price) FILTER (in_stock) AS lowest_price, count(DISTINCT shop) FILTER (in_stock) AS shops_in_stock, count(DISTINCT shop) AS all_shops, max(seen) AS last_seen FROM obs GROUP BY 1""")
def bitmap_product_totals(spark: SparkSession, d: str) -> DataFrame:
    """Exact distinct shops of each product from daily bitmaps; observations are read once, for the days."""
    return history.rolled_up(_daily_bitmaps(spark, d), [F.col("product")])


@query(f"""WITH {OBS}, p AS (SELECT *, CAST((seen AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Amsterdam' AS DATE) AS day FROM obs)
SELECT product, CAST(date_trunc('month', day) AS DATE) AS month, min(price) FILTER (in_stock) AS lowest_price, count(DISTINCT shop) FILTER (in_stock) AS shops_in_stock, count(DISTINCT shop) AS all_shops, max(seen) AS last_seen FROM p GROUP BY 1, 2""")
def bitmap_monthly_history(spark: SparkSession, d: str) -> DataFrame:
    return history.rolled_up(_daily_bitmaps(spark, d), [F.col("product"), F.trunc("day", "month").alias("month")])


@query(f"""WITH {OBS}, l AS (SELECT *, lag(price) OVER w AS old_price, row_number() OVER w AS rn FROM obs WINDOW w AS (PARTITION BY product, shop ORDER BY seen, price, in_stock))
SELECT product, shop, price, in_stock, seen, old_price FROM l WHERE rn > 1 AND price IS DISTINCT FROM old_price""")
def price_changes(spark: SparkSession, d: str) -> DataFrame:
    return history.changes(observations(spark, d), ["product", "shop"], ["seen", "price", "in_stock"], "price")


@query(f"""WITH {OBS}, o AS (SELECT product, min(price) AS v FROM obs WHERE seen < DATE '1995-06-01' GROUP BY 1), n AS (SELECT product, min(price) AS v FROM obs WHERE seen >= DATE '1996-06-01' GROUP BY 1)
SELECT product, CASE WHEN o.v IS NULL THEN 'new' WHEN n.v IS NULL THEN 'gone' ELSE 'changed' END AS change_type, o.v AS old, n.v AS new
FROM o FULL JOIN n USING (product) WHERE o.v IS DISTINCT FROM n.v""")
def snapshot_changes(spark: SparkSession, d: str) -> DataFrame:
    obs = observations(spark, d)
    low = lambda test: obs.where(test).groupBy("product").agg(F.min("price").alias("v"))
    return history.snapshot_changes(low(F.col("seen") < "1995-06-01"), low(F.col("seen") >= "1996-06-01"), "product", "v")


@query(f"""WITH {OBS}, old AS (SELECT product, shop, seen AS ts, price AS p, in_stock AS s FROM obs WHERE seen < DATE '1997-01-01'
  QUALIFY row_number() OVER (PARTITION BY product, shop ORDER BY seen DESC, price, in_stock) = 1),
inc AS (SELECT * FROM obs WHERE seen >= DATE '1997-01-01' QUALIFY row_number() OVER (PARTITION BY product, shop ORDER BY seen DESC, price, in_stock DESC) = 1)
SELECT product, shop, price, in_stock, seen FROM inc LEFT JOIN old USING (product, shop)
WHERE ts IS NULL OR ts::DATE <> seen::DATE OR price IS DISTINCT FROM p OR in_stock IS DISTINCT FROM s""")
def history_append(spark: SparkSession, d: str) -> DataFrame:
    obs = observations(spark, d)
    incoming = history.first_by(obs.where(F.col("seen") >= "1997-01-01"), ["product", "shop"], latest_order())
    return history.history_to_append(obs.where(F.col("seen") < "1997-01-01"), incoming, ["product", "shop"], "seen", ["price", "in_stock"])


@query(f"""WITH {OBS}, p AS (SELECT product, seen::DATE AS day, min(price) AS price FROM obs GROUP BY 1, 2)
SELECT product, day, price FROM (SELECT *, max(day) OVER (PARTITION BY product) AS last FROM p) WHERE day >= last - 89""")
def trailing_window(spark: SparkSession, d: str) -> DataFrame:
    points = observations(spark, d).groupBy("product", F.to_date("seen").alias("day")).agg(F.min("price").alias("price"))
    return history.trailing(points, ["product"], "day", 90)


@query(f"""WITH {OBS}, p AS (SELECT product, seen::DATE AS day, min(price) AS price FROM obs GROUP BY 1, 2), t AS (SELECT *, max(day) OVER (PARTITION BY product) AS last FROM p),
x AS (SELECT product, min(price) AS low, max(price) AS high, arg_max(price, day) AS current FROM t WHERE day >= last - 364 GROUP BY 1) SELECT *, current = low AS is_low FROM x""")
def period_low_flag(spark: SparkSession, d: str) -> DataFrame:
    points = observations(spark, d).groupBy("product", F.to_date("seen").alias("day")).agg(F.min("price").alias("price"))
    return history.period_lows(points, ["product"], "day", "price", 365)


_OLD_NEW = f"""WITH {OBS}, old AS (SELECT product, min(price) AS price, min(seen) AS first_seen, max(seen) AS last_seen, CASE WHEN product % 3 = 0 THEN '' ELSE 'old' END AS note FROM obs WHERE shop % 2 = 0 GROUP BY product),
new AS (SELECT product, max(price) AS price, min(seen) AS first_seen, max(seen) AS last_seen, CASE WHEN product % 5 = 0 THEN '' WHEN product % 7 = 0 THEN NULL ELSE 'new' END AS note FROM obs WHERE shop % 3 = 0 GROUP BY product)"""


def _old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    obs = observations(spark, d)
    seen = [F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen")]
    old = obs.where("shop % 2 = 0").groupBy("product").agg(F.min("price").alias("price"), *seen).withColumn("note", F.when(F.col("product") % 3 == 0, "").otherwise("old"))
    new = obs.where("shop % 3 = 0").groupBy("product").agg(F.max("price").alias("price"), *seen)
    return old, new.withColumn("note", F.when(F.col("product") % 5 == 0, "").when(F.col("product") % 7 == 0, None).otherwise("new"))


@query(f"{_OLD_NEW} SELECT product, coalesce(o.price, n.price) AS price, coalesce(o.first_seen, n.first_seen) AS first_seen, coalesce(o.last_seen, n.last_seen) AS last_seen, coalesce(o.note, n.note) AS note FROM old o FULL JOIN new n USING (product)")
def upsert_keep_existing(spark: SparkSession, d: str) -> DataFrame:
    return merge.upsert(*_old_new(spark, d), ["product"], dict.fromkeys(("price", "first_seen", "last_seen", "note"), merge.KEEP))


@query(f"{_OLD_NEW} SELECT product, coalesce(n.price, o.price) AS price, coalesce(o.first_seen, n.first_seen) AS first_seen, coalesce(n.last_seen, o.last_seen) AS last_seen, coalesce(n.note, o.note) AS note FROM old o FULL JOIN new n USING (product)")
def upsert_overwrite(spark: SparkSession, d: str) -> DataFrame:
    return merge.upsert(*_old_new(spark, d), ["product"], {"price": merge.REPLACE, "first_seen": merge.KEEP, "last_seen": merge.REPLACE, "note": merge.REPLACE})


@query(f"{_OLD_NEW} SELECT product, coalesce(n.price, o.price) AS price, least(o.first_seen, n.first_seen) AS first_seen, greatest(o.last_seen, n.last_seen) AS last_seen, coalesce(nullif(n.note, ''), o.note) AS note FROM old o FULL JOIN new n USING (product)")
def upsert_seen_bounds(spark: SparkSession, d: str) -> DataFrame:
    return merge.upsert(*_old_new(spark, d), ["product"], {"price": merge.REPLACE, "first_seen": merge.LEAST, "last_seen": merge.GREATEST, "note": merge.NONBLANK})


@query(f"{_OLD_NEW} SELECT product, CASE WHEN n.product IS NULL THEN o.price ELSE n.price END AS price, CASE WHEN n.product IS NULL THEN o.note ELSE n.note END AS note FROM old o FULL JOIN new n USING (product)")
def full_outer_merge(spark: SparkSession, d: str) -> DataFrame:
    return merge.upsert(*_old_new(spark, d), ["product"], {"price": merge.NEW, "note": merge.NEW})


@query(f"{_OLD_NEW} SELECT o.product, coalesce(n.price, o.price) AS price, o.first_seen, o.last_seen, coalesce(nullif(n.note, ''), o.note) AS note FROM old o LEFT JOIN new n USING (product)")
def conditional_overwrite(spark: SparkSession, d: str) -> DataFrame:
    return merge.update_from(*_old_new(spark, d), ["product"], {"price": merge.REPLACE, "note": merge.NONBLANK})


@query(f"{_OLD_NEW} SELECT o.product, o.price, o.first_seen, o.last_seen, coalesce(nullif(o.note, ''), n.note) AS note FROM old o LEFT JOIN new n USING (product)")
def fill_missing_only(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(spark, d)
    return merge.update_from(old.withColumn("note", text.blank_to_null(F.col("note"))), new, ["product"], {"note": merge.KEEP})


@query(f"{_OLD_NEW} SELECT n.* FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.product = n.product AND o.product % 4 <> 0)")
def insert_missing(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(spark, d)
    return merge.missing_rows(old.where("product % 4 <> 0"), new, ["product"])


@query(f"""WITH {OBS}, h AS (SELECT DISTINCT product, shop, price, seen FROM obs WHERE shop % 2 = 0), i AS (SELECT DISTINCT product, shop, price, seen FROM obs WHERE shop % 4 <> 2)
SELECT * FROM h UNION ALL SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.product = i.product AND h.shop = i.shop AND h.price = i.price AND h.seen = i.seen)""")
def append_if_absent(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d).select("product", "shop", "price", "seen")
    keys = ["product", "shop", "price", "seen"]
    return merge.append_absent(rows.where("shop % 2 = 0").distinct(), rows.where("shop % 4 <> 2").distinct(), keys)


@query(f"WITH {OBS} SELECT * FROM obs WHERE seen >= TIMESTAMP '{AS_OF}' - INTERVAL 180 DAY")
def retention(spark: SparkSession, d: str) -> DataFrame:
    return merge.retained(observations(spark, d), "seen", as_of(), 180)


@query(f"""{_OLD_NEW}, m AS (SELECT o.product, o.price AS op, coalesce(n.price, o.price) AS np, o.note AS o_note, coalesce(nullif(n.note, ''), o.note) AS n_note FROM old o LEFT JOIN new n USING (product))
SELECT product, 'note' AS "column", o_note AS old, n_note AS new FROM m WHERE o_note IS DISTINCT FROM n_note""")
def change_preview(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(spark, d)
    return merge.preview(old, merge.update_from(old, new, ["product"], {"note": merge.NONBLANK}), ["product"], ["note"])


@query("""
SELECT s_suppkey, c_custkey FROM supplier, customer WHERE s_nationkey * 1000 + s_suppkey % 40 = c_nationkey * 1000 + c_custkey % 40
UNION SELECT s_suppkey, c_custkey FROM supplier, customer WHERE lower(substr(s_name, 10)) = lower(substr(c_name, 10))""")
def or_join_rewrite(spark: SparkSession, d: str) -> DataFrame:
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    place = lambda n, k: F.col(n) * 1000 + F.col(k) % 40
    name = lambda x: F.lower(F.substring(x, 10, 100))
    return joins.or_join(s, c, [(place("s_nationkey", "s_suppkey"), place("c_nationkey", "c_custkey")), (name("s_name"), name("c_name"))], "s_suppkey", "c_custkey")


@query("""
SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey * 100 + s_suppkey % 50 = c_nationkey * 100 + c_custkey % 50)""")
def or_anti_join(spark: SparkSession, d: str) -> DataFrame:
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    return joins.or_anti(c, s, [(F.col("c_custkey"), F.col("s_suppkey")), (F.col("c_nationkey") * 100 + F.col("c_custkey") % 50, F.col("s_nationkey") * 100 + F.col("s_suppkey") % 50)]).select("c_custkey")


_EAN = "CAST(20000000000 + {k} * 7919 AS VARCHAR)"


@query(f"""
WITH a AS (SELECT p_partkey, lpad('0' || {_EAN.format(k='p_partkey')}, 14, '0') AS join_key FROM part), b AS (SELECT DISTINCT l_partkey AS k, lpad('0' || {_EAN.format(k='l_partkey')}, 14, '0') AS join_key FROM lineitem WHERE l_partkey % 3 = 0)
SELECT join_key, p_partkey, k FROM a JOIN b USING (join_key)""")
def normalized_key_join(spark: SparkSession, d: str) -> DataFrame:
    code = lambda k: (F.lit(20000000000) + F.col(k) * 7919).cast("string")
    a = table(spark, d, "part").select("p_partkey")
    b = table(spark, d, "lineitem").where("l_partkey % 3 = 0").select(F.col("l_partkey").alias("k")).distinct()
    spaced = F.concat(F.lit(" "), code("k"), F.lit(".0"))
    return joins.by_normalized(a, b, ids.gtin14(code("p_partkey")), ids.gtin14(spaced)).select("join_key", "p_partkey", "k")


@query(f"""WITH {OBS}, l AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY product ORDER BY seen DESC, price, shop) = 1)
SELECT p_partkey AS product, seen AS latest_seen, price AS latest_price, shop AS latest_shop FROM part LEFT JOIN l ON l.product = p_partkey""")
def lateral_latest(spark: SparkSession, d: str) -> DataFrame:
    products = table(spark, d, "part").select(F.col("p_partkey").alias("product"))
    return joins.latest_before(products, observations(spark, d), ["product"], "seen", ["price", "shop"], ["price", "shop"])


_URL = "lower(regexp_extract(url, '^https?://([^/?#]*)', 1))"


@query(f"""WITH p AS (SELECT page_id, {_URL} AS host FROM pages), n AS (SELECT host, count(DISTINCT page_id) AS n, min(page_id) AS m FROM p WHERE page_id % 2 = 0 GROUP BY 1)
SELECT page_id, p.host, coalesce(n, 0) AS n_matches, CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS match, CASE WHEN n = 1 THEN m END AS matched_id
FROM p LEFT JOIN n USING (host)""")
def url_match_cardinality(spark: SparkSession, d: str) -> DataFrame:
    from pricelode.functions import urls

    p = table(spark, d, "pages").select("page_id", F.lower(urls.part(F.col("url"), "host")).alias("host"))
    return joins.match_cardinality(p, p.where("page_id % 2 = 0"), "host", "page_id")


@query("""WITH a AS (SELECT unnest([lower(n_name), lower(substr(n_name, 1, 3)), 'nation ' || n_nationkey]) AS alias, n_nationkey FROM nation), f AS (SELECT alias, min(n_nationkey) AS n_nationkey FROM a GROUP BY 1),
s AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'nation ' || s_nationkey WHEN 1 THEN 'nowhere' ELSE lower(n_name) END AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT s_suppkey, name, f.n_nationkey FROM s LEFT JOIN f ON alias = name""")
def alias_expand_join(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    label = lambda k: F.concat(F.lit("nation "), F.col(k).cast("string"))
    s = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    s = s.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, label("s_nationkey")).when(F.col("s_suppkey") % 3 == 1, "nowhere").otherwise(F.lower("n_name")).alias("name"))
    return joins.alias_join(s, n, F.col("name"), F.array(F.lower("n_name"), F.lower(F.substring("n_name", 1, 3)), label("n_nationkey")), "n_nationkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50)")
def semi_topk(spark: SparkSession, d: str) -> DataFrame:
    ranked = table(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.semi_topk(rows, "l_partkey", ranked, [F.desc("p_retailprice"), F.asc("l_partkey")], 50).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"""WITH {OBS}, l AS (SELECT product, CASE WHEN shop % 3 = 0 THEN '' ELSE 'shop ' || shop END AS label, price FROM obs QUALIFY row_number() OVER (PARTITION BY product ORDER BY seen, price, shop) = 1)
SELECT product, coalesce(nullif(label, ''), p_name) AS label, price FROM l JOIN part ON p_partkey = product WHERE p_size > 20""")
def known_target_join(spark: SparkSession, d: str) -> DataFrame:
    listing = observations(spark, d).withColumn("label", F.when(F.col("shop") % 3 == 0, "").otherwise(F.concat(F.lit("shop "), F.col("shop").cast("string"))))
    targets = table(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("product"), F.col("p_name").alias("label"))
    return joins.known_targets(listing, targets, "product", [F.asc("seen"), F.asc("price"), F.asc("shop")], ["label"]).select("product", "label", "price")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag <> 'N')")
def pending_enrichment(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    return merge.missing_rows(done, table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])


@query("SELECT p_brand, n_name, r_name, count(*) AS offers, min(l_extendedprice) AS lowest FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2, 3")
def snowflake_join(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    places = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")  # five regions
    shops = t("supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")  # 25 nations
    rows = t("lineitem").select("l_partkey", "l_suppkey", "l_extendedprice").join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.join(shops, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("p_brand", "n_name", "r_name").agg(F.count("*").alias("offers"), F.min("l_extendedprice").alias("lowest"))


@query(f"SELECT l_partkey, l_suppkey, l_shipdate, CASE WHEN h < 24 THEN 'vandaag gecontroleerd' WHEN h < 48 THEN '1 dag oud' WHEN h < 72 THEN '2 dagen oud' ELSE 'mogelijk niet actueel' END AS label FROM (SELECT *, date_diff('second', l_shipdate, TIMESTAMP '{AS_OF}') / 3600.0 AS h FROM lineitem)")
def freshness_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", dates.freshness_label(F.col("l_shipdate"), as_of()).alias("label"))
