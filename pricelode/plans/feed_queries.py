"""What feeds write, built from table columns, and the work that follows an import. The texts are made
by the same rule on both sides, so that the SQL works out every answer by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.functions import classify, dates, html, ids, page_walk, prices, text
from pricelode.operators import merge, queueing, ranking, validation
from pricelode.plans.catalogue import query
from pricelode.plans.tables import AS_OF, as_of, pages, table


def word_of(words: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(number, F.lit(len(words))) + 1).cast("int"))


def word_sql(words: list[str], number: str) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + f"][({number}) % {len(words)} + 1]"


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


_PRICE_TEXTS = """c AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
e AS (SELECT *, cents // 100 AS euros, lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS rest FROM c),
g AS (SELECT *, CASE WHEN euros >= 1000 THEN CAST(euros // 1000 AS VARCHAR) || '.' || lpad(CAST(euros % 1000 AS VARCHAR), 3, '0') ELSE CAST(euros AS VARCHAR) END AS dotted FROM e),
r AS (SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN '€ ' || dotted || ',' || rest WHEN 1 THEN 'EUR ' || euros || ',' || rest WHEN 2 THEN euros || '.' || rest WHEN 3 THEN replace(dotted, '.', ',') || '.' || rest
  WHEN 4 THEN '€ ' || euros || ',' || rest || ' van  € ' || (euros + 10) || ',' || rest WHEN 5 THEN CAST(cents AS VARCHAR) WHEN 6 THEN '-' || euros % 100 || ',5' WHEN 7 THEN dotted WHEN 8 THEN 'prijs op aanvraag' END AS raw FROM g),
t AS (SELECT *, trim(regexp_replace(coalesce(raw, ''), '\\s+', ' ', 'g')) AS t, coalesce(raw, '') AS x FROM r)"""


def _price_texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").select(k, F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    euros, rest = F.expr("cents div 100"), F.lpad(_text(F.col("cents") % 100), 2, "0")
    dotted = F.when(euros >= 1000, F.concat(_text(F.expr("cents div 100000")), F.lit("."), F.lpad(_text(euros % 1000), 3, "0"))).otherwise(_text(euros))
    raw = (
        F.when(k % 10 == 0, F.concat(F.lit("€ "), dotted, F.lit(","), rest)).when(k % 10 == 1, F.concat(F.lit("EUR "), _text(euros), F.lit(","), rest))
        .when(k % 10 == 2, F.concat(_text(euros), F.lit("."), rest)).when(k % 10 == 3, F.concat(F.translate(dotted, ".", ","), F.lit("."), rest))
        .when(k % 10 == 4, F.concat(F.lit("€ "), _text(euros), F.lit(","), rest, F.lit(" van  € "), _text(euros + 10), F.lit(","), rest)).when(k % 10 == 5, _text("cents"))
        .when(k % 10 == 6, F.concat(F.lit("-"), _text(euros % 100), F.lit(",5"))).when(k % 10 == 7, dotted).when(k % 10 == 8, F.lit("prijs op aanvraag"))
    )
    return c.select(k, raw.alias("raw"))


def _num(x: str) -> str:
    return rf"CASE WHEN regexp_matches({x}, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN CAST(rtrim({x}, '.') AS DOUBLE) END"


def _comma(x: str) -> str:
    return f"CASE WHEN contains({x}, ',') AND contains({x}, '.') THEN replace(replace({x}, '.', ''), ',', '.') ELSE replace({x}, ',', '.') END"


def _later(x: str) -> str:
    return (f"CASE WHEN contains({x}, ',') AND contains({x}, '.') THEN CASE WHEN strpos(reverse({x}), ',') < strpos(reverse({x}), '.') THEN replace(replace({x}, '.', ''), ',', '.') ELSE {x} END "
            f"ELSE replace({x}, ',', '.') END")  # fmt: skip


def _two_sql(x: str, otherwise: str) -> str:
    return f"CASE WHEN ({_num(x)}) IS NULL THEN {otherwise} ELSE printf('%.2f', {_num(x)}) END"


@query(f"""WITH {_PRICE_TEXTS},
s AS (SELECT *, regexp_replace(t, '€|EUR| ', '', 'g') AS a1, regexp_extract(replace(t, '€', ''), '-?\\d+[.,]?\\d*') AS tok, regexp_replace(replace(x, ',', '.'), '[^0-9.\\-]', '', 'g') AS d3, replace(t, 'EUR', '€') AS t5,
  regexp_replace(x, '[^\\d,.]', '', 'g') AS d7, replace(replace(trim(replace(t, '€', '')), '.', ''), ',', '.') AS d8, regexp_replace(t, '€| ', '', 'g') AS a9,
  replace(regexp_replace(x, '€|\\s', '', 'g'), ',', '.') AS a11, regexp_replace(x, '[^0-9,.\\-]', '', 'g') AS a12, regexp_extract_all(x, '€\\s*(\\d+[.,]\\d{{2}})', 1) AS f13 FROM t),
u AS (SELECT *, {_comma('a1')} AS c1, {_comma('tok')} AS c2, CASE WHEN contains(d3, '.') THEN split_part(d3, '.', 1) || '.' || replace(substr(d3, strpos(d3, '.') + 1), '.', '') ELSE d3 END AS c3,
  regexp_extract(t5, '€\\s*([\\d.,]+)', 1) AS e5, replace(d7, ',', '.') AS c7, {_later('a9')} AS c9, {_later('d7')} AS c10, regexp_extract(a11, '\\d+(\\.\\d{{1,2}})?') AS c11, {_comma('a12')} AS c12 FROM s),
v AS (SELECT *, CAST(round(({_num('c2')}) * 1000000) AS BIGINT) AS m2, CAST(round(({_num('c3')}) * 1000000) AS BIGINT) AS m3 FROM u)
SELECT o_orderkey, raw, CASE WHEN raw IS NOT NULL THEN {_num('c1')} END AS p1,
  CASE WHEN m2 >= 0 THEN ((m2 + 5000) // 10000) / 100.0 END::DOUBLE AS p2,
  CASE WHEN m3 > 0 THEN (m3 // 10000 + CASE WHEN m3 % 10000 > 5000 OR (m3 % 10000 = 5000 AND (m3 // 10000) % 2 = 1) THEN 1 ELSE 0 END) / 100.0 END::DOUBLE AS p3,
  replace(a1, '.', ',') AS p4, CASE WHEN e5 <> '' THEN '€' || e5 WHEN regexp_matches(t5, '^[\\d.,]+$') THEN '€' || t5 ELSE replace(t5, '€ ', '€') END AS p5,
  CAST(printf('%.2f', ({_num('trim(raw)')}) / 100) AS DOUBLE) AS p6, CAST(printf('%.2f', {_num('c7')}) AS DOUBLE) AS p7, {_num('d8')} AS p8, {_two_sql('c9', 'NULL')} AS p9, {_two_sql('c10', "''")} AS p10, {_two_sql('c11', "''")} AS p11, {_two_sql('c12', "''")} AS p12,
  CASE WHEN len(f13) > 0 THEN '€' || replace(f13[len(f13)], '.', ',') ELSE '' END AS p13
FROM v""".replace("\\\\", "\\"))
def feed_prices(spark: SparkSession, d: str) -> DataFrame:
    """Every parser over the order totals as ten kinds of feeds would write them."""
    numbers = {"p1", "p2", "p3", "p6", "p7", "p8"}
    raw = F.col("raw")
    made = [(F.nullif(p(raw).cast("string"), F.lit("")).cast("double") if n in numbers else p(raw).cast("string")).alias(n) for n, p in prices.PARSERS.items()]
    return _price_texts(spark, d).select("o_orderkey", "raw", *made)


_FORMS = ["{}", " {}.0", "EAN {}", "EAN: {} en meer", "barcode {}", "0{}", "{}E+11", "=\"{}\"", "gtin={}x"]


@query(f"""WITH c AS (SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN 60257700000 + p_partkey WHEN 1 THEN 602577000000 + p_partkey WHEN 2 THEN 4006381000000 + p_partkey ELSE p_partkey END AS VARCHAR) AS code FROM part),
r AS (SELECT p_partkey, replace({word_sql(_FORMS, 'p_partkey // 4')}, '{{}}', code) AS raw FROM c),
x AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS d, CASE WHEN trim(raw) = '' THEN 'missing_ean' WHEN regexp_matches(lower(raw), 'e[+-]') THEN 'scientific_notation' WHEN regexp_replace(raw, '[^0-9]', '', 'g') = '' THEN 'non_numeric_ean' ELSE '' END AS reason FROM r)
SELECT p_partkey, raw, CASE WHEN length(d) = 12 THEN '0' || d WHEN length(d) = 13 THEN d ELSE '' END AS bulk, CASE WHEN length(d) IN (12, 13) THEN d ELSE '' END AS sync,
  CASE WHEN length(d) IN (8, 12, 13, 14) THEN lpad(d, 14, '0') END AS search, CASE WHEN reason = '' THEN d ELSE '' END AS backfill, reason,
  coalesce(nullif(regexp_extract(raw, '(?i)\\bean(?:[- ]?code)?\\b[^0-9]{{0,20}}([0-9]{{8,14}})(?:[^0-9]|$)', 1), ''), nullif(regexp_extract(raw, '(?i)\\bbar ?code\\b[^0-9]{{0,20}}([0-9]{{8,14}})(?:[^0-9]|$)', 1), ''),
    nullif(regexp_extract(raw, '(?i)\\bgtin\\b[^0-9]{{0,20}}([0-9]{{8,14}})(?:[^0-9]|$)', 1), '')) AS labelled FROM x""".replace("\\\\", "\\"))
def feed_eans(spark: SparkSession, d: str) -> DataFrame:
    """Product codes of four lengths in nine forms, read by every variant."""
    k = F.col("p_partkey")
    code = F.when(k % 4 == 0, F.lit(60257700000) + k).when(k % 4 == 1, F.lit(602577000000) + k).when(k % 4 == 2, F.lit(4006381000000) + k).otherwise(k).cast("string")
    rows = table(spark, d, "part").select(k, F.replace(word_of(_FORMS, F.expr("p_partkey div 4")), F.lit("{}"), code).alias("raw"))
    raw, b = F.col("raw"), ids.backfill_ean(F.col("raw"))
    return rows.select(
        "p_partkey", "raw", ids.ean_bulk(raw).alias("bulk"), ids.ean_sync(raw).alias("sync"), ids.search_gtin(raw).alias("search"), b["ean"].alias("backfill"), b["reason"].alias("reason"),
        ids.labelled_ean(raw).alias("labelled"),
    )


_STATES = ["In stock", "sold-out", "Uitverkocht", "pre-order", "coming soon", "", "Niet op voorraad", "op voorraad", "Verwacht in mei", "true", "Nee", "JA", "0", "ok", "out_of_stock", "instock", "Levertijd 3 dagen", "niet leverbaar"]
_PRICED = "CASE WHEN price IS NOT NULL THEN 'in_stock' ELSE 'unknown' END"


def _any_sql(words: tuple[str, ...], column: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, {word_sql(_STATES, 'l_orderkey')} AS flag, {word_sql(_STATES, 'l_orderkey // 7 + l_linenumber')} || ' ' || lower(l_linestatus) AS label, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS price FROM lineitem),
w AS (SELECT *, lower(flag) AS f, lower(label) AS l, replace(replace(lower(flag), '-', '_'), ' ', '_') AS u, replace(lower(flag), '_', '') AS s FROM r)
SELECT l_orderkey, l_linenumber, CASE WHEN u IN ('out_of_stock', 'sold_out', 'uitverkocht') THEN 'out_of_stock' WHEN u IN ('preorder', 'pre_order', 'coming_soon') THEN 'preorder' ELSE 'in_stock' END AS by_word,
  CASE WHEN f IN ('true', '1', 'yes', 'ja', 'j') THEN 'in_stock' WHEN f IN ('false', '0', 'no', 'nee', 'n') THEN 'out_of_stock' ELSE 'unknown' END AS by_flag,
  CASE WHEN l = '' THEN 'unknown' WHEN regexp_matches(l, 'niet op voorraad|uitverkocht|sold out|out of stock|niet leverbaar') THEN 'out_of_stock' WHEN regexp_matches(l, 'pre-?order|verwacht|binnenkort|coming soon') THEN 'preorder'
    WHEN regexp_matches(l, 'op voorraad|in stock|leverbaar|add to cart|in winkelwagen') THEN 'in_stock' ELSE 'unknown' END AS by_text,
  CASE upper(flag) WHEN 'JA' THEN 'in_stock' WHEN 'NEE' THEN 'out_of_stock' ELSE 'unknown' END AS by_yes, CASE WHEN upper(flag) = 'JA' THEN 'in_stock' ELSE 'out_of_stock' END AS by_ja,
  CASE WHEN contains(l, 'uitverkocht') THEN 'out_of_stock' ELSE 'in_stock' END AS unless_sold_out,
  CASE WHEN {_any_sql(classify.SOLD_OUT_STATUS, 'f')} THEN 'out_of_stock' WHEN f = 'ok' THEN 'in_stock' ELSE {_PRICED} END AS by_listing,
  CASE WHEN f IN ('false', '0') THEN 'out_of_stock' WHEN f IN ('true', '1') THEN 'in_stock' WHEN {_any_sql(classify.VARIANT_SOLD_OUT, 'l')} THEN 'out_of_stock' WHEN {_any_sql(classify.VARIANT_FOR_SALE, 'l')} THEN 'in_stock' ELSE {_PRICED} END AS by_variant,
  CASE WHEN s = 'outofstock' THEN 'out_of_stock' WHEN s = 'instock' THEN 'in_stock' WHEN {_any_sql(classify.SOLD_OUT_WORDS, 'l')} THEN 'out_of_stock' WHEN {_any_sql(classify.FOR_SALE_WORDS, 'l')} THEN 'in_stock' ELSE {_PRICED} END AS by_status
FROM w""")
def feed_availability(spark: SparkSession, d: str) -> DataFrame:
    """All nine availability rules over flags and labels of line items."""
    k = F.col("l_orderkey")
    label = F.concat(word_of(_STATES, F.expr("l_orderkey div 7 + l_linenumber")), F.lit(" "), F.lower("l_linestatus"))
    rows = table(spark, d, "lineitem").select(k, "l_linenumber", word_of(_STATES, k).alias("flag"), label.alias("label"), F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("price"))
    f, n, p = F.col("flag"), F.col("label"), F.col("price")
    made = {
        "by_word": classify.availability(f), "by_flag": classify.availability_of_flag(f), "by_text": classify.availability_of_text(n), "by_yes": classify.availability_of_yes(f), "by_ja": classify.availability_of_ja(f),
        "unless_sold_out": classify.availability_unless_sold_out(n), "by_listing": classify.availability_of_listing(f, p), "by_variant": classify.availability_of_variant(f, n, p), "by_status": classify.availability_of_status(f, n, p),
    }
    return rows.select(k, "l_linenumber", *(c.alias(x) for x, c in made.items()))


_GAPS = [" - ", " – ", "- ", "–", " — ", " "]
_TITLE_SQL = f"t AS (SELECT p_partkey, trim(p_brand) || {word_sql(_GAPS, 'p_partkey')} || trim(p_name) AS raw, CASE WHEN p_size % 3 = 0 THEN ' cd ' WHEN p_size % 3 = 1 THEN 'Vinyl' ELSE trim(p_type) END AS carrier FROM part)"


@query(f"""WITH {_TITLE_SQL},
s AS (SELECT *, CASE WHEN raw LIKE '%_ – _%' THEN ' – ' WHEN raw LIKE '%_ - _%' THEN ' - ' WHEN raw LIKE '%_ — _%' THEN ' — ' WHEN raw LIKE '%_–_%' THEN '–' WHEN raw LIKE '%_—_%' THEN '—' END AS sep FROM t)
SELECT p_partkey, raw, CASE WHEN sep IS NOT NULL THEN trim(substr(raw, 1, instr(raw, sep) - 1)) ELSE trim(regexp_extract(raw, '^(.+?)-\\s+(.+)$', 1)) END AS artist,
  CASE WHEN sep IS NOT NULL THEN trim(substr(raw, instr(raw, sep) + length(sep))) WHEN regexp_matches(raw, '^(.+?)-\\s+(.+)$') THEN trim(regexp_extract(raw, '^(.+?)-\\s+(.+)$', 2)) ELSE raw END AS title,
  upper(trim(carrier)) IN ('CD', 'POSTER', 'ACCESSORIES', 'PHOTOBOOK', 'BLUERAY', 'BLURAY') AS hidden, trim(carrier || ' ' || raw) AS search_text FROM s""".replace("\\\\", "\\"))
def feed_titles(spark: SparkSession, d: str) -> DataFrame:
    """Artist and title out of one column, hidden formats and search texts of all parts."""
    raw = F.concat(F.trim("p_brand"), word_of(_GAPS, F.col("p_partkey")), F.trim("p_name"))
    carrier = F.when(F.col("p_size") % 3 == 0, " cd ").when(F.col("p_size") % 3 == 1, "Vinyl").otherwise(F.trim("p_type"))
    rows = table(spark, d, "part").select("p_partkey", raw.alias("raw"), carrier.alias("carrier"))
    pair = text.infer_artist_title(F.lit(None).cast("string"), F.col("raw"))
    return rows.select(
        "p_partkey", "raw", pair["artist"].alias("artist"), pair["title"].alias("title"), classify.is_hidden_format(F.col("carrier")).alias("hidden"),
        text.plain_search_text(F.col("carrier"), F.col("raw")).alias("search_text"),
    )


@query("""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN trim(p_brand) ELSE '' END AS artist, CASE WHEN p_partkey % 2 = 0 THEN trim(p_name) END AS title, CASE WHEN p_partkey % 5 < 3 THEN replace(lower(trim(p_brand)), '#', '-') ELSE '' END AS aslug,
  CASE WHEN p_partkey % 7 < 3 THEN replace(lower(trim(p_type)), ' ', '-') ELSE '' END AS tslug, CASE WHEN p_partkey % 11 < 4 THEN upper(replace(lower(trim(p_brand)), '#', ' ')) || ' ' || trim(p_type) ELSE '' END AS shown FROM part),
w AS (SELECT *, replace(aslug, '-', ' ') AS a, replace(tslug, '-', ' ') AS t FROM r),
n AS (SELECT *, coalesce(nullif(shown, ''), title, nullif(t, ''), '') AS d FROM w),
m AS (SELECT *, coalesce(nullif(artist, ''), a) AS ra, coalesce(title, nullif(t, ''), d) AS rt FROM n)
SELECT p_partkey, coalesce(nullif(ra, ''), 'Unknown Artist') AS artist, coalesce(nullif(rt, ''), 'Unknown Title') AS title FROM m""")
def fallback_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of listings whose columns are partly blank; none of these texts holds a separator."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        k, F.when(k % 3 == 0, F.trim("p_brand")).otherwise("").alias("artist"), F.when(k % 2 == 0, F.trim("p_name")).alias("title"),
        F.when(k % 5 < 3, F.replace(F.lower(F.trim("p_brand")), F.lit("#"), F.lit("-"))).otherwise("").alias("aslug"), F.when(k % 7 < 3, F.replace(F.lower(F.trim("p_type")), F.lit(" "), F.lit("-"))).otherwise("").alias("tslug"),
        F.when(k % 11 < 4, F.concat(F.upper(F.replace(F.lower(F.trim("p_brand")), F.lit("#"), F.lit(" "))), F.lit(" "), F.trim("p_type"))).otherwise("").alias("shown"),
    )
    pair = text.names_or_unknown(*(F.col(c) for c in ("artist", "title", "aslug", "tslug", "shown")))
    return rows.select("p_partkey", pair["artist"].alias("artist"), pair["title"].alias("title"))


@query(f"""WITH h AS (SELECT o_orderkey, o_orderdate, CAST(greatest(date_diff('second', o_orderdate, TIMESTAMP '{AS_OF}'), 0) AS DOUBLE) / 3600 AS age FROM orders WHERE o_orderdate <= TIMESTAMP '{AS_OF}')
SELECT o_orderkey, CASE WHEN age < 24 THEN 'Vandaag gecontroleerd' WHEN age < 48 THEN '1 dag geleden gecontroleerd' ELSE CAST(CAST(floor(age / 24) AS BIGINT) AS VARCHAR) || ' dagen geleden gecontroleerd' END AS checked,
  day(o_orderdate) || ' ' || ['jan', 'feb', 'mrt', 'apr', 'mei', 'jun', 'jul', 'aug', 'sep', 'okt', 'nov', 'dec'][month(o_orderdate)] || ' ' || year(o_orderdate) AS day FROM h""")
def page_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").where(F.col("o_orderdate") <= as_of())
    return rows.select("o_orderkey", dates.checked_label(F.col("o_orderdate"), as_of()).alias("checked"), dates.day_label(F.col("o_orderdate"), year=True).alias("day"))


@query(f"""WITH s AS (SELECT CASE WHEN l_linenumber < 3 THEN 'b1' ELSE 'b2' END AS batch_name, CAST(400000000000 + l_partkey AS VARCHAR) AS ean, l_linenumber * 10 + l_suppkey % 7 AS p, l_returnflag AS source FROM lineitem WHERE l_suppkey % 9 = 0),
pr AS (SELECT p_partkey AS product_id, CAST(400000000000 + p_partkey AS VARCHAR) AS ean, CASE WHEN p_partkey % 3 = 0 THEN 'u' END AS cover_url, p_partkey % 6 = 0 AS needs_refresh, ['missing', 'published', 'review', 'failed'][p_partkey % 4 + 1] AS status, CASE WHEN p_partkey % 5 > 0 THEN p_size END AS priority FROM part),
q AS (SELECT product_id, 'old' AS ean, 'seed' AS source, p_size AS priority, 'me' AS requested_by, CASE WHEN product_id % 4 = 0 THEN 'processing' ELSE 'done' END AS state, TIMESTAMP '1998-01-01' AS available_at, 1 AS request_count FROM pr JOIN part ON p_partkey = product_id WHERE product_id % 2 = 0),
m AS (SELECT product_id, s.ean, p, source FROM s JOIN pr ON pr.ean = s.ean WHERE batch_name = 'b1' QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY p DESC, s.ean, source) = 1)
SELECT coalesce(q.product_id, m.product_id) AS product_id, coalesce(m.ean, q.ean) AS ean, coalesce(m.source, q.source) AS source, greatest(q.priority, m.p) AS priority, CASE WHEN m.product_id IS NULL THEN requested_by ELSE 'seed-script' END AS requested_by,
  CASE WHEN m.product_id IS NULL OR state = 'processing' THEN state ELSE 'pending' END AS state, CASE WHEN m.product_id IS NULL OR state = 'processing' THEN available_at ELSE TIMESTAMP '{AS_OF}' END AS available_at,
  CAST(coalesce(request_count, 0) + CASE WHEN m.product_id IS NULL THEN 0 ELSE 1 END AS INT) AS request_count,
  CASE WHEN m.product_id IS NOT NULL AND (cover_url IS NULL OR needs_refresh) THEN 'queued' ELSE pr.status END AS status,
  CASE WHEN m.product_id IS NOT NULL AND (cover_url IS NULL OR needs_refresh OR pr.status IN ('missing', 'queued', 'failed', 'review')) THEN greatest(coalesce(pr.priority, 0), p) ELSE pr.priority END AS product_priority
FROM q FULL JOIN m ON q.product_id = m.product_id JOIN pr ON pr.product_id = coalesce(q.product_id, m.product_id)""")
def preload_batch(spark: SparkSession, d: str) -> DataFrame:
    """A batch of codes asks for covers: the queue after it, with the products' new states."""
    part, k = table(spark, d, "part"), F.col("p_partkey")
    code = lambda c: (F.lit(400000000000) + F.col(c)).cast("string")
    stage = table(spark, d, "lineitem").where("l_suppkey % 9 = 0").select(
        F.when(F.col("l_linenumber") < 3, "b1").otherwise("b2").alias("batch_name"), code("l_partkey").alias("ean"), (F.col("l_linenumber") * 10 + F.col("l_suppkey") % 7).alias("requested_priority"),
        F.col("l_returnflag").alias("source"), F.lit(None).cast("timestamp_ntz").alias("queued_at"),
    )
    products = part.select(
        k.alias("product_id"), code("p_partkey").alias("ean"), F.when(k % 3 == 0, "u").alias("cover_url"), (k % 6 == 0).alias("needs_refresh"),
        word_of(["missing", "published", "review", "failed"], k).alias("status"), F.when(k % 5 > 0, F.col("p_size")).alias("priority"),
    )
    queue = part.where(k % 2 == 0).select(
        k.alias("product_id"), F.lit("old").alias("ean"), F.lit("seed").alias("source"), F.col("p_size").alias("priority"), F.lit("me").alias("requested_by"),
        F.when(k % 4 == 0, "processing").otherwise("done").alias("state"), F.lit("1998-01-01").cast("timestamp_ntz").alias("available_at"), F.lit(1).alias("request_count"),
    )
    queued, updated, _ = queueing.apply_preload(queue, products, stage, "b1", "seed-script", as_of())
    return queued.join(updated.select("product_id", "status", F.col("priority").alias("product_priority")), "product_id")


@query("""WITH c AS (SELECT l_orderkey AS job, l_linenumber AS candidate, CAST(l_quantity AS INT) AS rank, l_returnflag = 'R' AS ok FROM lineitem),
o AS (SELECT *, rank() OVER (PARTITION BY job ORDER BY rank DESC, candidate) AS place FROM c), f AS (SELECT job, min(place) FILTER (ok) AS first FROM o GROUP BY 1)
SELECT o.job, max(CASE WHEN place = first THEN candidate END) AS chosen, count(*) FILTER (first IS NULL OR place < first) AS n_failed, CASE WHEN any_value(first) IS NULL THEN 'retry_later' ELSE 'published' END AS status
FROM o JOIN f ON o.job = f.job GROUP BY o.job""")
def publish_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Candidates are tried from the best rank on; the first that works is published."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("candidate"), F.col("l_quantity").cast("int").alias("rank"), (F.col("l_returnflag") == "R").alias("ok"))
    return queueing.first_success(rows, "job", "rank", "candidate", F.col("ok"))


_UPLOADS = {
    "products": "SELECT concat_ws('|', CASE WHEN p_size > 45 THEN 'bad_size' END, CASE WHEN p_retailprice > 1500 THEN 'invalid_price' END) AS r FROM part",
    "offers_latest": "SELECT concat_ws('|', CASE WHEN s_acctbal < 0 THEN 'invalid_price' END) AS r FROM supplier",
    "offers_history": "SELECT concat_ws('|', CASE WHEN l_quantity > 45 THEN 'bad_size' END, CASE WHEN l_discount > 0.09 THEN 'bad_discount' END) AS r FROM lineitem",
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS dataset, r AS rejection_reason, count(*) AS n FROM ({sql}) GROUP BY r" for name, sql in _UPLOADS.items()))
def upload_preflight(spark: SparkSession, d: str) -> DataFrame:
    """Three sets of rows split in validated and rejected ones, as a report."""
    sets = {
        "products": (table(spark, d, "part").select("p_size", "p_retailprice"), [("bad_size", F.col("p_size") > 45), ("invalid_price", F.col("p_retailprice") > 1500)]),
        "offers_latest": (table(spark, d, "supplier").select("s_acctbal"), [("invalid_price", F.col("s_acctbal") < 0)]),
        "offers_history": (table(spark, d, "lineitem").select("l_quantity", "l_discount"), [("bad_size", F.col("l_quantity") > 45), ("bad_discount", F.col("l_discount") > 0.09)]),
    }
    return validation.prepare_upload(sets)[1]


@query("""WITH r AS (SELECT l_suppkey AS shop, CASE WHEN l_quantity > 45 THEN 'bad' ELSE '' END AS reason, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_returnflag <> 'R' END AS ok FROM lineitem)
SELECT shop, count(*) AS rows_read, count(*) FILTER (reason = '') AS accepted, count(*) FILTER (reason <> '') AS rejected, count(*) FILTER (reason = '' AND ok) AS upload_ok, count(*) FILTER (reason = '' AND NOT ok) AS upload_failed,
  count(*) FILTER (reason <> '') / count(*) AS reject_share FROM r GROUP BY shop""")
def shop_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("shop"), F.when(F.col("l_quantity") > 45, "bad").otherwise("").alias("reason"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag") != "R").alias("ok"))
    return validation.run_metrics(rows, "shop", "reason", F.col("ok"))


@query("""WITH l AS (SELECT o_orderkey AS run, 'running' AS status, CAST(NULL AS INT) AS accepted, o_orderdate AS started FROM orders), r AS (SELECT o_orderkey AS run, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'success' END AS status, CAST(o_custkey AS INT) AS accepted FROM orders WHERE o_orderkey % 3 <> 0)
SELECT l.run, coalesce(r.status, l.status) AS status, coalesce(r.accepted, l.accepted) AS accepted, started FROM l LEFT JOIN r ON l.run = r.run""")
def run_log(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    log = o.select(F.col("o_orderkey").alias("run"), F.lit("running").alias("status"), F.lit(None).cast("int").alias("accepted"), F.col("o_orderdate").alias("started"))
    results = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("success").alias("status"), F.col("o_custkey").cast("int").alias("accepted"))
    return validation.finish_runs(log, results, "run")


@query("""WITH p AS (SELECT p_partkey AS product, ['missing', 'published', 'review', 'failed'][p_partkey % 4 + 1] AS status, p_size AS priority FROM part), q AS (SELECT l_partkey AS product, max(l_returnflag) AS error FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1)
SELECT p.product, status, priority, error AS queue_error FROM p LEFT JOIN q ON p.product = q.product WHERE status IN ('failed', 'review')""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    products = table(spark, d, "part").select(k.alias("product"), word_of(["missing", "published", "review", "failed"], k).alias("status"), F.col("p_size").alias("priority"))
    queue = table(spark, d, "lineitem").where("l_suppkey % 3 = 0").groupBy(F.col("l_partkey").alias("product")).agg(F.max("l_returnflag").alias("error"))
    return queueing.failed_review(products, queue, "product", "status", ["error"])


@query("""WITH b AS (SELECT l_orderkey AS page, 'u' || l_partkey % 5 AS target, l_returnflag AS title, l_linenumber AS steps, l_linestatus || ' ' || l_suppkey || CASE WHEN l_tax < 0.04 THEN ' ' || l_returnflag ELSE '' END AS text, CASE WHEN l_linenumber = 1 THEN ['u' || l_partkey % 5] ELSE ['u' || l_partkey % 5, 'u' || l_suppkey % 5] END AS links, CAST(l_quantity AS INT) % 4 AS prices FROM lineitem),
s AS (SELECT *, len(list_distinct(links)) AS n, len(list_filter(links, lambda x: x = target)) AS same, CASE WHEN len(list_distinct(links)) = 1 THEN 12 ELSE 2 END + CASE WHEN title <> '' AND contains(text, title) THEN 2 ELSE 0 END + CASE prices WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE -3 END AS score FROM b WHERE prices > 0 AND length(text) BETWEEN 1 AND 900)
SELECT page, target, score, CAST(n AS INT) AS n_links, prices, steps, text FROM s WHERE same > 0 QUALIFY row_number() OVER (PARTITION BY page, target ORDER BY score DESC, n, length(text), same DESC, steps, text DESC, prices DESC) = 1""")
def card_pick(spark: SparkSession, d: str) -> DataFrame:
    """The best block of each product link, by score, links, text and distance."""
    link = lambda c: F.concat(F.lit("u"), (F.col(c) % 5).cast("string"))
    blocks = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page"), link("l_partkey").alias("target"), F.col("l_returnflag").alias("title"), F.col("l_linenumber").alias("steps"),
        F.concat("l_linestatus", F.lit(" "), _text("l_suppkey"), F.when(F.col("l_tax") < 0.04, F.concat(F.lit(" "), "l_returnflag")).otherwise("")).alias("text"),
        F.when(F.col("l_linenumber") == 1, F.array(link("l_partkey"))).otherwise(F.array(link("l_partkey"), link("l_suppkey"))).alias("links"), (F.col("l_quantity").cast("int") % 4).alias("prices"),
    )
    return ranking.pick_cards(blocks, ["page", "target"])


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+', 0) AS root, unnest(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')) AS item, generate_subscripts(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>'), 1) AS position FROM pages)
SELECT page_id, CAST(position AS INT) AS position, trim(regexp_extract(item, '">([^<]*)</a>', 1)) AS text, root || regexp_extract(item, 'href="([^"]*)"', 1) AS link FROM p""")
def page_items(spark: SparkSession, d: str) -> DataFrame:
    """The items of all lists of saved pages, with their places and links."""
    found = pages(spark, d).select("page_id", F.explode(page_walk.cells(F.col("html"), F.col("url"))).alias("c")).where("c.tag = 'li'")
    return found.select("page_id", "c.position", "c.text", "c.link")


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+', 0) AS root, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS item FROM pages),
l AS (SELECT page_id, root || regexp_extract(item, 'href="([^"]*)"', 1) AS target, trim(regexp_extract(item, '">([^<]*)</a>', 1)) AS text FROM p)
SELECT DISTINCT page_id, target, text AS title, 14 AS score, 1 AS n_links, 0 AS prices, 0 AS steps, text FROM l WHERE text <> '' """)
def page_cards(spark: SparkSession, d: str) -> DataFrame:
    """The block that shows each link of a saved page best. These pages have no prices, so none is asked for."""
    found = pages(spark, d).select("page_id", F.explode(page_walk.cards(F.col("html"), F.col("url"), priced=False)).alias("c"))
    return found.select("page_id", "c.*")


@query("SELECT p_partkey AS product, p_brand AS artist, p_name AS title FROM part WHERE lower(trim(p_brand)) = 'brand#12'")
def artist_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("product"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"))
    return ranking.with_facet(p, "  BRAND#12 ")


@query("""WITH b AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE ' ' END AS brand, CASE WHEN p_size % 3 = 0 THEN p_type END AS kind FROM part WHERE p_partkey % 7 <> 0), n AS (SELECT p_partkey, p_type AS brand, p_name AS kind FROM part WHERE p_partkey % 5 <> 0)
SELECT b.p_partkey, coalesce(nullif(trim(b.brand), ''), nullif(trim(n.brand), '')) AS brand, coalesce(nullif(trim(b.kind), ''), nullif(trim(n.kind), '')) AS kind FROM b LEFT JOIN n ON b.p_partkey = n.p_partkey WHERE b.p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)""")
def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    """Blanks filled from a second listing; the rows of a third are deleted."""
    p = table(spark, d, "part")
    base = p.where("p_partkey % 7 <> 0").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(" ").alias("brand"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("kind"))
    other = p.where("p_partkey % 5 <> 0").select("p_partkey", F.col("p_type").alias("brand"), F.col("p_name").alias("kind"))
    doomed = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return merge.delete_using(merge.fill_missing(base, other, ["p_partkey"], ["brand", "kind"]), doomed, ["p_partkey"])


@query("""WITH t AS (SELECT page_id, url, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages)
SELECT page_id, trim(title) AS name, CAST(page_id % 500 AS VARCHAR) || '.50' AS price, 'EUR' AS currency FROM t WHERE page_id % 3 <> 0""")
def page_products(spark: SparkSession, d: str) -> DataFrame:
    """Products out of JSON-LD blocks that stand behind each page's own markup and hold its title."""
    h = F.col("html")
    offer = F.struct(F.concat((F.col("page_id") % 500).cast("string"), F.lit(".50")).alias("price"), F.lit("EUR").alias("priceCurrency"))
    product = F.struct(F.lit("Product").alias("@type"), html.title(h).alias("name"), F.array(offer).alias("offers"))
    block = F.to_json(F.when(F.col("page_id") % 3 != 0, F.struct(F.array(F.struct(F.lit("WebPage").alias("@type"), F.struct(product.alias("item")).alias("mainEntity"))).alias("@graph"))))
    page = F.concat(h, F.lit('<script type="application/ld+json">'), F.coalesce(F.replace(block, F.lit("</"), F.lit("<\\/")), F.lit("{}")), F.lit("</script>"))
    found = pages(spark, d).select("page_id", html.jsonld_product(page).alias("p"))
    return found.where(F.col("p.name").isNotNull()).select("page_id", "p.name", "p.price", "p.currency")
