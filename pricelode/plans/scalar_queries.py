"""Identifiers, prices, texts, URLs and times, and the import path, as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.functions import classify, dates, html, ids, prices, scoring, text, urls
from pricelode.operators import history, validation
from pricelode.plans.catalogue import query
from pricelode.plans.tables import AS_OF, OBS, as_of, observations, pages, table


def listed(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


#: An order's own six digits, and the first digit of its price, as SQL.
_DIGITS, _LEAD = "lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0')", "left(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), 1)"


def forms(spark: SparkSession, d: str, values: list[str | None]) -> DataFrame:
    """The orders as raw cells: each has one of the forms by its key, with its own digits in the place of #."""
    k = F.col("o_orderkey")
    form = F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (k % len(values) + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.replace(form, F.lit("#"), F.lpad((k % 1000000).cast("string"), 6, "0")).alias("raw"))


def picked(values: list[str | None]) -> str:
    """The form of an order by its key, as SQL."""
    return f"({listed(values)})[1 + o_orderkey % {len(values)}]"


def forms_sql(values: list[str | None]) -> str:
    """``forms`` as a CTE."""
    return f"v AS (SELECT o_orderkey, replace({picked(values)}, '#', {_DIGITS}) AS raw FROM orders)"


_CODE = "CAST(k * 7919 + 20000000000 AS VARCHAR)"


@query("""WITH a AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ' ' || (20000000000 + p_partkey) || '.0' WHEN 1 THEN 'EAN 060257' || (1000000 + p_partkey)
  WHEN 2 THEN CAST(p_partkey AS VARCHAR) WHEN 3 THEN '4006381' || (100000 + p_partkey) ELSE '10' || (200000000000 + p_partkey) END AS raw FROM part),
d AS (SELECT *, regexp_replace(regexp_replace(trim(raw), '\\.0$', ''), '[^0-9]', '', 'g') AS x FROM a), e AS (SELECT *, CASE WHEN length(x) = 11 THEN '0' || x ELSE x END AS y FROM d)
SELECT p_partkey, raw, CASE WHEN length(y) IN (8, 12, 13, 14) THEN y END AS ean, CASE WHEN length(y) IN (8, 12, 13, 14) THEN lpad(y, 14, '0') END AS gtin FROM e""".replace("\\\\", "\\"))
def gtin_normalize(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    s = lambda x: x.cast("string")
    raw = (
        F.when(k % 5 == 0, F.concat(F.lit(" "), s(F.lit(20000000000) + k), F.lit(".0"))).when(k % 5 == 1, F.concat(F.lit("EAN 060257"), s(k + 1000000))).when(k % 5 == 2, s(k))
        .when(k % 5 == 3, F.concat(F.lit("4006381"), s(k + 100000))).otherwise(F.concat(F.lit("10"), s(F.lit(200000000000) + k)))
    )
    a = table(spark, d, "part").select("p_partkey", raw.alias("raw"))
    return a.select("p_partkey", "raw", ids.ean(F.col("raw")).alias("ean"), ids.gtin14(F.col("raw")).alias("gtin"))


@query("""WITH b AS (SELECT p_partkey, lpad(CAST(p_partkey * 48611 AS VARCHAR), 12, '0') AS body FROM part),
c AS (SELECT *, list_sum(list_transform(range(1, 13), lambda i: CAST(substr(body, i, 1) AS INT) * CASE WHEN (12 - i) % 2 = 0 THEN 3 ELSE 1 END)) AS t FROM b),
k AS (SELECT *, CAST((10 - t % 10) % 10 AS INT) AS check_digit FROM c) SELECT p_partkey, body, check_digit, p_partkey % 10 = check_digit AS is_valid FROM k""")
def gtin_check_digit(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "part").select("p_partkey", F.lpad((F.col("p_partkey") * 48611).cast("string"), 12, "0").alias("body"))
    whole = F.concat("body", (F.col("p_partkey") % 10).cast("string"))
    return a.select("p_partkey", "body", ids.check_digit(F.col("body")).cast("int").alias("check_digit"), ids.is_valid_gtin(whole).alias("is_valid"))


EANS = ["602577#.0", "60257#", "123", None, "0602577#", "4006381333931", "4006381#", "6.02E+11", '="0602577#"', "abc", " 0-602577 # ", "", "12#", "nan"]


@query(f"""WITH {forms_sql(EANS)}, d AS (SELECT o_orderkey, raw, coalesce(raw, '') AS r, regexp_replace(coalesce(raw, ''), '[^0-9]', '', 'g') AS x FROM v),
b AS (SELECT *, trim(r) AS t, CASE WHEN trim(r) = '' THEN 'missing_ean' WHEN regexp_matches(lower(r), 'e[+-]') THEN 'scientific_notation' WHEN x = '' THEN 'non_numeric_ean' ELSE '' END AS reason FROM d)
SELECT o_orderkey, raw, CASE WHEN length(x) = 12 THEN '0' || x WHEN length(x) = 13 THEN x ELSE '' END AS bulk, CASE WHEN length(x) IN (12, 13) THEN x ELSE '' END AS sync,
  CASE WHEN length(x) IN (8, 12, 13, 14) THEN lpad(x, 14, '0') END AS search, CASE WHEN reason = '' THEN x ELSE '' END AS backfill, reason FROM b""")
def ean_variants(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw")
    b = ids.backfill_ean(raw)
    return forms(spark, d, EANS).select(
        "o_orderkey", "raw", ids.ean_bulk(raw).alias("bulk"), ids.ean_sync(raw).alias("sync"), ids.search_gtin(raw).alias("search"), b["ean"].alias("backfill"), b["reason"].alias("reason")
    )


@query(r"""WITH r AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) BETWEEN 8 AND 14) AS runs FROM documents)
SELECT doc_id, list_filter(runs, lambda x: length(x) = list_max(list_transform(runs, lambda y: length(y))))[1] AS code FROM r WHERE len(runs) > 0""")
def longest_digit_run(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", ids.longest_digit_run(F.col("text")).alias("code"))
    return found.where(F.col("code").isNotNull())


LABELLED = ["EAN: 0602577# en meer", "Barcode 4006381#", "gtin=12#, EAN-code: 87#", "barcode 11112222 ean 33#", "geen code 123", None, "EAN 123456789#"]


@query(f"""WITH {forms_sql(LABELLED)} SELECT o_orderkey, raw, coalesce(nullif(regexp_extract(raw, '(?i)\\bean(?:[- ]?code)?\\b[^0-9]{{0,20}}([0-9]{{8,14}})(?:[^0-9]|$)', 1), ''),
  nullif(regexp_extract(raw, '(?i)\\bbar ?code\\b[^0-9]{{0,20}}([0-9]{{8,14}})(?:[^0-9]|$)', 1), ''), nullif(regexp_extract(raw, '(?i)\\bgtin\\b[^0-9]{{0,20}}([0-9]{{8,14}})(?:[^0-9]|$)', 1), '')) AS code FROM v""")
def ean_extract(spark: SparkSession, d: str) -> DataFrame:
    return forms(spark, d, LABELLED).select("o_orderkey", "raw", ids.labelled_ean(F.col("raw")).alias("code"))


@query(r"""SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug, lower(trim(source)) || '::' || lower(trim(lang)) AS sync_key, regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g') AS open_slug FROM documents""")
def slug_keys(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.slug(t).alias("slug"), text.sync_key(F.col("source"), F.col("lang")).alias("sync_key"), text.open_slug(t).alias("open_slug"))


@query(r"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS s, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS h,
  regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g') AS path, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page FROM pages)
SELECT page_id, s || '://' || h || CASE WHEN path = '/' THEN path ELSE rtrim(path, '/') END AS url, regexp_replace(h, '^www\.', '') AS domain, page FROM p""")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.normalize_url(u).alias("url"), urls.domain(u).alias("domain"), urls.query_param(u, "page").alias("page"))


#: Raw prices; # is a digit. "2.345" stays as it is, since its rounding is that of its binary value.
PRICES = ["€ #.234,56", "#2,5", "#.234", "", "-#", "2.345", "#,234.56", "EUR #,99", "abc", "€ #,50 van € 9,99", "0", "#2.", None, "#.234.567,8", "nan"]
#: What each parser makes of PRICES: worked out from the rules, not by a run.
_EXPECTED = {
    "p1": ["#234.56", "#2.5", "#.234", None, "-#", "2.345", "#.23456", "#.99", None, None, "0", "#2", None, "#234567.8", None],
    "p2": ["#.23", "#2.50", "#.23", None, None, "2.35", "#.23", "#.99", None, "#.50", "0.00", "#2.00", None, "#.23", None],
    "p3": ["#.23", "#2.50", "#.23", "", "", "2.34", "#.23", "#.99", "", "#.51", "", "#2.00", "", "#.23", ""],
    "p4": ["#,234,56", "#2,5", "#,234", "", "-#", "2,345", "#,234,56", "#,99", "abc", "#,50van9,99", "0", "#2,", "", "#,234,567,8", "nan"],
    "p5": ["€#.234,56", "€#2,5", "€#.234", "", "-#", "€2.345", "€#,234.56", "€#,99", "abc", "€#,50", "€0", "€#2.", "", "€#.234.567,8", "nan"],
    "p6": [None, None, "0.0#", None, "-0.0#", "0.02", None, None, None, None, "0", "0.#2", None, None, None],
    "p7": [None, "#2.5", "#.23", None, "#", "2.35", None, "#.99", None, None, "0", "#2", None, None, None],
    "p8": ["#234.56", "#2.5", "#234", None, "-#", "2345", "#.23456", None, None, None, "0", "#2", None, "#234567.8", None],
    "p9": ["#234.56", "#2.50", "#.23", None, "-#.00", "2.35", None, None, None, None, "0.00", "#2.00", None, "#234567.80", None],
    "p10": ["#234.56", "#2.50", "#.23", "", "#.00", "2.35", "", "#.99", "", "", "0.00", "#2.00", "", "#234567.80", ""],
    "p11": ["#.23", "#2.50", "#.23", "", "#.00", "2.34", "#.23", "#.99", "", "#.50", "0.00", "#2.00", "", "#.23", ""],
    "p12": ["#234.56", "#2.50", "#.23", "", "-#.00", "2.35", "#.23", "#.99", "", "", "0.00", "#2.00", "", "#234567.80", ""],
    "p13": ["€#,23", "", "", "", "", "", "", "", "", "€9,99", "", "", "", "", ""],
}
_NUMBERS = ("p1", "p6", "p7", "p8")


def _add_price_query(name: str) -> None:
    """A query of one parser over the orders, each a raw price by its key with the first digit of its own price; its SQL lists the expected values."""
    kind = "double" if name in _NUMBERS else "string"

    def parse(spark: SparkSession, d: str) -> DataFrame:
        k, lead = F.col("o_orderkey"), F.left(F.floor("o_totalprice").cast("string"), F.lit(1))
        form = F.element_at(F.array(*(F.lit(v).cast("string") for v in PRICES)), (k % len(PRICES) + 1).cast("int"))
        rows = table(spark, d, "orders").select("o_orderkey", F.replace(form, F.lit("#"), lead).alias("raw"))
        return rows.select("o_orderkey", "raw", prices.PARSERS[name](F.col("raw")).cast(kind).alias("price"))

    parse.__name__ = f"price_parse_{name}"
    own = lambda values: f"replace({picked(values)}, '#', {_LEAD})"
    query(f"SELECT o_orderkey, {own(PRICES)} AS raw, CAST({own(_EXPECTED[name])} AS {'DOUBLE' if name in _NUMBERS else 'VARCHAR'}) AS price FROM orders")(parse)


for _name in prices.PARSERS:
    _add_price_query(_name)


@query("SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week FROM orders")
def iso_week(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", dates.iso_week(F.col("o_orderdate")).alias("week"))


WORDS = ["In stock", "sold-out", "Uitverkocht", "pre-order", "coming soon", "", None, "iets", "Niet op voorraad", "op voorraad", "Verwacht in mei", "true", "nee", "Nog # op voorraad", "Verwacht in week #", "Uitverkocht sinds #"]


@query(f"""WITH {forms_sql(WORDS)}, n AS (SELECT o_orderkey, raw, lower(coalesce(raw, '')) AS w, replace(replace(lower(coalesce(raw, '')), '-', '_'), ' ', '_') AS u FROM v)
SELECT o_orderkey, raw, CASE WHEN u IN ('out_of_stock', 'sold_out', 'uitverkocht') THEN 'out_of_stock' WHEN u IN ('preorder', 'pre_order', 'coming_soon') THEN 'preorder' ELSE 'in_stock' END AS by_word,
  CASE WHEN w = '' THEN 'unknown' WHEN w LIKE '%niet op voorraad%' OR w LIKE '%uitverkocht%' THEN 'out_of_stock' WHEN regexp_matches(w, 'pre-?order|verwacht|coming soon') THEN 'preorder'
    WHEN w LIKE '%op voorraad%' OR w LIKE '%in stock%' THEN 'in_stock' ELSE 'unknown' END AS by_text,
  CASE WHEN w IN ('true', 'ja') THEN 'in_stock' WHEN w IN ('false', 'nee') THEN 'out_of_stock' ELSE 'unknown' END AS by_flag FROM n""")
def availability_norm(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw")
    return forms(spark, d, WORDS).select("o_orderkey", "raw", classify.availability(raw).alias("by_word"), classify.availability_of_text(raw).alias("by_text"), classify.availability_of_flag(raw).alias("by_flag"))


@query("SELECT o_orderkey, CAST(least(1440, 10 * pow(2, greatest(o_orderkey % 12 - 1, 0))) AS INT) AS minutes FROM orders")
def backoff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", dates.backoff_minutes(F.col("o_orderkey") % 12).alias("minutes"))


TITLES = ["Night Ferry #- Harbour", "A - B # – C", "Solo #", None, "Een # — Twee", "X–Y #", " - ", "Artist  -  Title # (2LP)", "De Band - Album (Limited Edition)"]


@query(f"""WITH {forms_sql(TITLES)}, t AS (SELECT o_orderkey, raw, trim(regexp_replace(coalesce(raw, ''), '\\s+', ' ', 'g')) AS t FROM v),
s AS (SELECT *, CASE WHEN t LIKE '%_ – _%' THEN ' – ' WHEN t LIKE '%_ - _%' THEN ' - ' WHEN t LIKE '%_ — _%' THEN ' — ' WHEN t LIKE '%_–_%' THEN '–' WHEN t LIKE '%_—_%' THEN '—' END AS sep FROM t)
SELECT o_orderkey, raw, CASE WHEN sep IS NOT NULL THEN trim(substr(t, 1, instr(t, sep) - 1)) ELSE trim(regexp_extract(t, '^(.+?)-\\s+(.+)$', 1)) END AS artist,
  CASE WHEN sep IS NOT NULL THEN trim(substr(t, instr(t, sep) + length(sep))) WHEN regexp_matches(t, '^(.+?)-\\s+(.+)$') THEN trim(regexp_extract(t, '^(.+?)-\\s+(.+)$', 2)) ELSE t END AS title FROM s""")
def artist_title(spark: SparkSession, d: str) -> DataFrame:
    pair = text.infer_artist_title(F.lit(None).cast("string"), F.col("raw"))
    return forms(spark, d, TITLES).select("o_orderkey", "raw", pair["artist"].alias("artist"), pair["title"].alias("title"))


def _rules(price: Column, day: Column, flag: Column, qty: Column) -> list[tuple[str, Column]]:
    return [("missing_price", price < 2000), ("old_row", day < "1993-01-01"), ("second_hand", flag == "R"), ("bad_quantity", qty > 45)]


_RULES = "[CASE WHEN l_extendedprice < 2000 THEN 'missing_price' END, CASE WHEN l_shipdate < DATE '1993-01-01' THEN 'old_row' END, CASE WHEN l_returnflag = 'R' THEN 'second_hand' END, CASE WHEN l_quantity > 45 THEN 'bad_quantity' END]"


def _judged(spark: SparkSession, d: str, how) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag", "l_quantity")
    return rows.withColumn("reason", how(_rules(F.col("l_extendedprice"), F.col("l_shipdate"), F.col("l_returnflag"), F.col("l_quantity"))))


@query(f"SELECT l_partkey, l_suppkey, l_shipdate, list_filter({_RULES}, lambda x: x IS NOT NULL)[1] AS reason FROM lineitem")
def reject_cascade(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d, validation.first_reason).select("l_partkey", "l_suppkey", "l_shipdate", "reason")


@query(f"SELECT l_partkey, l_suppkey, l_shipdate, array_to_string(list_filter({_RULES}, lambda x: x IS NOT NULL), '|') AS reason FROM lineitem WHERE len(list_filter({_RULES}, lambda x: x IS NOT NULL)) > 0")
def reject_reasons_joined(spark: SparkSession, d: str) -> DataFrame:
    _, bad = validation.split(_judged(spark, d, validation.all_reasons), "reason")
    return bad.select("l_partkey", "l_suppkey", "l_shipdate", "reason")


@query(f"SELECT list_filter({_RULES}, lambda x: x IS NOT NULL)[1] AS reason, count(*) AS n FROM lineitem GROUP BY 1")
def reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return validation.reason_counts(_judged(spark, d, validation.first_reason), "reason")


_PARTS = "p AS (SELECT p_partkey, p_brand || p_size % 7 AS gtin, p_name AS product_key, floor(p_retailprice / 50) * 50 AS price FROM part)"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey", F.concat("p_brand", (F.col("p_size") % 7).cast("string")).alias("gtin"), F.col("p_name").alias("product_key"), (F.floor(F.col("p_retailprice") / 50) * 50).cast("double").alias("price")
    )


@query(f"WITH {_PARTS}, g AS (SELECT gtin, count(*) AS n_rows, count(DISTINCT product_key) AS n_products, count(DISTINCT price) AS n_prices FROM p GROUP BY 1) "
       "SELECT *, CASE WHEN n_rows = 1 THEN 'unique' WHEN n_products = 1 AND n_prices = 1 THEN 'benign' ELSE 'conflict' END AS kind FROM g")  # fmt: skip
def duplicate_classes(spark: SparkSession, d: str) -> DataFrame:
    return validation.duplicate_classes(_parts(spark, d), "gtin", "product_key", "price")


@query(f"""WITH {OBS}, w AS (SELECT *, count(*) OVER k AS n, min(price) OVER k = max(price) OVER k AS one, row_number() OVER (PARTITION BY product, shop ORDER BY seen DESC, price, in_stock DESC) AS rn FROM obs WINDOW k AS (PARTITION BY product, shop))
SELECT product, shop, price, seen, CASE WHEN n = 1 OR (one AND rn = 1) THEN NULL WHEN one THEN 'duplicate_same_product_same_price' ELSE 'conflicting_duplicate_ean' END AS reject_reason FROM w""")
def duplicate_rejects(spark: SparkSession, d: str) -> DataFrame:
    obs = observations(spark, d).withColumn("offer", F.concat_ws("/", "product", "shop"))
    found = validation.reject_duplicates(obs, "offer", "product", "price", [F.desc("seen"), F.asc("price"), F.desc("in_stock")])
    return found.select("product", "shop", "price", "seen", "reject_reason")


@query("""WITH h AS (SELECT regexp_extract(url, '//([^/?#]*)', 1) AS host, regexp_extract(url, '^[^/]*//[^/]*/([^/?#]*)', 1) AS lang FROM pages)
SELECT host, count(DISTINCT lang) AS n_values, array_to_string(list_sort(list_distinct(list(lang))), '|') AS conflicting_values FROM h GROUP BY 1 HAVING count(DISTINCT lang) > 1""")
def url_ean_conflicts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(urls.part(F.col("url"), "host").alias("host"), F.regexp_extract("url", "^[^/]*//[^/]*/([^/?#]*)", 1).alias("lang"))
    return validation.conflicts(p, ["host"], "lang")


@query(f"""WITH j AS (SELECT *, len(list_filter({_RULES}, lambda x: x IS NOT NULL)) > 0 AS bad, l_orderkey % 4 = 0 AS new, l_linenumber % 3 = 0 AS changed FROM lineitem)
SELECT count(*) AS rows_read, count(*) FILTER (NOT bad) AS accepted, count(*) FILTER (bad) AS rejected, count(*) FILTER (NOT bad AND new) AS new_rows,
  count(*) FILTER (NOT bad AND NOT new AND changed) AS changed, count(*) FILTER (NOT bad AND NOT new AND NOT changed) AS unchanged FROM j""")
def import_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    rows = rows.withColumn("reason", validation.first_reason(_rules(F.col("l_extendedprice"), F.col("l_shipdate"), F.col("l_returnflag"), F.col("l_quantity"))))
    return validation.import_stats(rows, "reason", F.col("l_orderkey") % 4 == 0, F.col("l_linenumber") % 3 == 0)


LABELS = ["cd", " CD ", "CD | Album", "CD #", "Vinyl", None, "", "Poster", "bluray", "LP"]


@query(f"WITH {forms_sql(LABELS)} SELECT o_orderkey, raw, upper(trim(coalesce(raw, ''))) IN ('CD', 'POSTER', 'ACCESSORIES', 'PHOTOBOOK', 'BLUERAY', 'BLURAY') AS hidden FROM v")
def format_blacklist(spark: SparkSession, d: str) -> DataFrame:
    return forms(spark, d, LABELS).select("o_orderkey", "raw", classify.is_hidden_format(F.col("raw")).alias("hidden"))


@query(f"WITH {OBS} SELECT product, shop, price, seen FROM obs QUALIFY row_number() OVER (PARTITION BY product ORDER BY price, seen DESC, shop) = 1")
def keep_first_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return history.first_by(observations(spark, d), ["product"], [F.asc("price"), F.desc("seen"), F.asc("shop")]).select("product", "shop", "price", "seen")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    return history.first_by(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("""WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS a, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS b, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE 'x' END AS c FROM part)
SELECT p_partkey, p_brand, a, b, c FROM p QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY (a <> '')::INT + (b IS NOT NULL)::INT + (trim(c) <> '')::INT DESC, p_partkey) = 1""")
def best_quality_dedupe(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.when(k % 2 == 0, F.col("p_name")).otherwise("").alias("a"), F.when(k % 3 == 0, F.col("p_type")).alias("b"), F.when(k % 5 == 0, " ").otherwise("x").alias("c"))
    return validation.best_quality(p, ["p_brand"], ["a", "b", "c"], [F.asc("p_partkey")])


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'ean' || page_id % 20 END AS ean, url FROM pages)
SELECT page_id, ean, url FROM p QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(ean, ''), url) ORDER BY page_id) = 1""")
def coalesced_key_dedupe(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    p = table(spark, d, "pages").select("page_id", F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("ean"), (k % 20).cast("string"))).alias("ean"), "url")
    return history.first_by(p, [F.coalesce(text.blank_to_null(F.col("ean")), "url")], [F.asc("page_id")])


@query("SELECT page_id, len(regexp_extract_all(html, '<a\\s+href=\"([^\"]*)\"', 1)) AS n_links, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, length(html) - length(replace(html, '<p>', '')) AS paragraph_chars FROM pages".replace("\\\\", "\\"))
def page_fields(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.size(html.links(h)).cast("long").alias("n_links"), html.title(h).alias("title"), (F.length(h) - F.length(F.replace(h, F.lit("<p>"), F.lit("")))).cast("long").alias("paragraph_chars"))


@query(None)
def similarity(spark: SparkSession, d: str) -> DataFrame:
    """Ratcliff-Obershelp of each part's name and type; no SQL function measures it."""
    return table(spark, d, "part").select("p_partkey", F.round(text.similarity(F.col("p_name"), F.col("p_type")), 6).alias("ratio"))


_HOST = "regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)"


@query(f"""WITH h AS (SELECT page_id, {_HOST} AS host, {_HOST} || regexp_extract(url, '^[a-zA-Z]+://[^/?#]*(/(?:[^?#]*/)?)', 1) AS folder, url FROM pages)
SELECT page_id, host || '/img/' || page_id || '.jpg' AS url, 'og' AS source, 0 AS position FROM h
UNION ALL SELECT page_id, CASE WHEN folder = host THEN host || '/' ELSE folder END || 'cover/1.jpg', 'img_tag', 1 FROM h""")
def image_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Image candidates of pages; the test pages have none of their own, so each gets markup before its html."""
    p = pages(spark, d)
    marked = F.concat(
        F.lit('<meta property="og:image" content="/img/'), F.col("page_id").cast("string"), F.lit('.jpg"><img src="//cdn.example.com/logo.png"><img class="cover" src="cover/1.jpg" width="600" height="600">'), "html"
    )
    found = p.select("page_id", F.explode(html.image_candidates(marked, F.col("url"))).alias("c"))
    return found.select("page_id", "c.url", "c.source", "c.position")


@query(f"SELECT page_id, {_HOST} || '/a/' || page_id || '.jpg' AS image FROM pages UNION ALL SELECT page_id, 'https://x.example/b.jpg' FROM pages")
def jsonld_images(spark: SparkSession, d: str) -> DataFrame:
    """Images of JSON-LD blocks, found at any depth; a block stands behind each page's own html, which has none."""
    block = F.concat("html", F.lit('<script type="application/ld+json">{"@graph": [{"@type": "Product", "image": ["/a/'), F.col("page_id").cast("string"), F.lit('.jpg", {"url": "https://x.example/b.jpg#f"}]}]}</script>'))
    found = pages(spark, d).select("page_id", F.explode(html.jsonld_images(block, F.col("url"))).alias("image"))
    return found


@query(f"SELECT l_partkey, l_suppkey, l_shipdate, CASE WHEN h <= 24 THEN 10 WHEN h <= 72 THEN 6 WHEN h <= 168 THEN 2 ELSE 0 END AS recency FROM (SELECT *, greatest(date_diff('second', l_shipdate, TIMESTAMP '{AS_OF}') / 3600.0, 0) AS h FROM lineitem)")
def recency_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", dates.recency_score(F.col("l_shipdate"), as_of()).alias("recency"))


@query("""WITH c AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'listing' WHEN 1 THEN 'og' WHEN 2 THEN 'img_tag' ELSE 'other' END AS source, p_size * 25 AS w, (p_partkey % 40) * 25 AS h, p_partkey % 2 = 0 AS prim FROM part),
s AS (SELECT *, least(w, h) AS sh, greatest(w, h) AS lo FROM c)
SELECT p_partkey, CAST(CASE source WHEN 'listing' THEN 45 WHEN 'og' THEN 28 WHEN 'img_tag' THEN 12 ELSE 0 END + 50 + CASE WHEN prim THEN 10 ELSE 0 END
  + CASE WHEN w <= 0 OR h <= 0 THEN 0 WHEN sh >= 900 THEN 20 WHEN sh >= 600 THEN 12 WHEN sh >= 250 THEN 6 ELSE 0 END
  + CASE WHEN w <= 0 OR h <= 0 THEN 0 WHEN lo <= sh * 1.25 THEN 8 WHEN lo <= sh * 1.6 THEN 2 ELSE -20 END + 4 AS INT) AS rank FROM s""")
def candidate_rank(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    source = F.when(k % 4 == 0, "listing").when(k % 4 == 1, "og").when(k % 4 == 2, "img_tag").otherwise("other")
    none = F.lit(None)
    rank = scoring.candidate_rank(source, none.cast("int"), k % 2 == 0, F.col("p_size") * 25, (k % 40) * 25, F.lit(True), none.cast("timestamp"), as_of())
    return table(spark, d, "part").select("p_partkey", rank.alias("rank"))
