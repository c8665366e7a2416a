"""Rules of rows (codes, names, times, enrichment) over columns of the tables, several of a family in one query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.functions import classify, dates, ids, text
from pricelode.operators import joins
from pricelode.plans.catalogue import query
from pricelode.plans.tables import AS_OF, table


def by_rest(key: Column, n: int, values: dict[int, Column | str | None], default: Column) -> Column:
    """A value by the remainder of a key."""
    found = default
    for rest, value in values.items():
        found = F.when(key % n == rest, value if isinstance(value, Column) else F.lit(value)).otherwise(found)
    return found


@query("""WITH c AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 6 > 0 THEN left(CAST(c_custkey * 7919000001 AS VARCHAR), 7 + CAST(c_custkey % 9 AS INT)) END AS code FROM customer),
e AS (SELECT *, CASE WHEN length(code) = 11 THEN '0' || code WHEN length(code) IN (8, 12, 13, 14) THEN code END AS ean, CASE WHEN length(code) IN (11, 12, 13) THEN lpad(code, 13, '0') END AS padded, CASE k % 3 WHEN 0 THEN lpad(CAST(k AS VARCHAR), 12, '1') WHEN 1 THEN '' END AS old, CASE WHEN k % 2 = 0 THEN '0' || lpad(CAST(k AS VARCHAR), 12, '1') ELSE CAST(k AS VARCHAR) END AS new, md5(name) AS m FROM c),
v AS (SELECT *, CASE WHEN (10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(padded, i, 1) AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 = CAST(substr(padded, 13, 1) AS INT) THEN padded END AS listing FROM e)
SELECT k, ean, listing, CASE WHEN length(code) = 13 THEN listing END AS strict, CASE WHEN lpad(ean, 14, '0') LIKE '0%' THEN substr(lpad(ean, 14, '0'), 2) END AS ean13, CASE WHEN length(old) = 12 AND new = '0' || old THEN new ELSE coalesce(nullif(old, ''), new) END AS upgraded,
m AS url_key, sha256(name) AS content_key, substr(m, 13, 1) BETWEEN '1' AND '5' AND substr(m, 17, 1) IN ('8', '9', 'a', 'b') AS is_uuid FROM v""")
def code_rules(spark: SparkSession, d: str) -> DataFrame:
    """Codes of several lengths in the variants that shops and listings need, and keys of names."""
    k, name = F.col("c_custkey"), F.col("c_name")
    code = F.when(k % 6 > 0, F.left((k * 7919000001).cast("string"), (7 + k % 9).cast("int")))
    sheet = F.when(k % 4 == 1, F.concat(code, F.lit(".0"))).otherwise(code)  # as a spreadsheet writes it
    long = F.lpad(k.cast("string"), 12, "1")
    old, new = by_rest(k, 3, {0: long, 1: ""}, F.lit(None).cast("string")), F.when(k % 2 == 0, F.concat(F.lit("0"), long)).otherwise(k.cast("string"))
    m = F.md5(name)
    uuid = F.concat_ws("-", *(F.substring(m, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return table(spark, d, "customer").select(
        k.alias("k"), ids.ean(sheet).alias("ean"), ids.ean_listing(code).alias("listing"), ids.ean_strict(code).alias("strict"), ids.gtin14_to_ean13(sheet).alias("ean13"), ids.upgraded_ean(old, new).alias("upgraded"),
        ids.url_key(name).alias("url_key"), ids.content_key(name).alias("content_key"), ids.is_uuid(uuid).alias("is_uuid"),
    )


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS name, p_brand AS brand, p_type AS kind, p_retailprice AS price, 1850 + 7 * p_size AS y, CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', ', ') ELSE p_name END AS listed, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS shown, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS item FROM part)
SELECT k, trim(regexp_replace(lower(name || ' - ' || brand), '[^a-z0-9]+', ' ', 'g')) AS free, left(name || kind, 9) AS short, CASE WHEN len(string_split(listed, ', ')) = 2 THEN string_split(listed, ', ')[2] || ' ' || string_split(listed, ', ')[1] ELSE listed END AS person,
CASE WHEN y BETWEEN 1900 AND 2100 THEN name ELSE name || ' ' || y END AS artist, CASE WHEN y BETWEEN 1900 AND 2100 THEN y END AS year, CASE WHEN shown = upper(shown) THEN upper(left(shown, 1)) || lower(substr(shown, 2)) ELSE shown END AS displayed,
CASE WHEN k % 5 = 0 THEN 'Vinyl' WHEN k % 2 = 1 AND brand <> kind THEN kind || ' | ' || brand ELSE kind END AS label, (['2LP', 'cd', 'Box', '12 inch', '7"', '', 'Tape'])[1 + k % 7] AS raw, (['LP', 'CD', 'BOX', '12 INCH', '7 INCH', '', 'TAPE'])[1 + k % 7] AS carrier,
CASE WHEN item IN (brand, kind) THEN brand || ' | ' || kind ELSE brand || ' | ' || kind || ' | ' || item END AS sources, CASE WHEN price < 1000 THEN brand || '|cheap' ELSE brand END AS flags, CASE WHEN length(kind) > length(name) THEN kind ELSE name END AS longer FROM p""")
def name_rules(spark: SparkSession, d: str) -> DataFrame:
    """Names and labels: persons, years, capitals, carriers, lists of sources and flags."""
    k, name, brand, kind = (F.col(c) for c in ("p_partkey", "p_name", "p_brand", "p_type"))
    blank = lambda c, test: F.when(test, F.lit(" ")).otherwise(c)
    raw = by_rest(k, 7, dict(enumerate(("2LP", "cd", "Box", "12 inch", '7"', ""))), F.lit("Tape"))
    by_year = text.artist_year(F.concat(name, F.lit("  "), (1850 + 7 * F.col("p_size")).cast("string")))
    return table(spark, d, "part").select(
        k.alias("k"), text.free_text(F.concat(name, F.lit(" - "), brand)).alias("free"), text.truncated(F.concat(name, kind), 9).alias("short"),
        text.last_first(F.when(k % 3 == 0, F.replace(name, F.lit(" "), F.lit(" ,  "))).otherwise(name)).alias("person"), by_year["artist"].alias("artist"), by_year["year"].alias("year"),
        text.display_case(F.when(k % 2 == 0, F.upper(name)).otherwise(name)).alias("displayed"), text.format_label(blank(kind, k % 5 == 0), blank(brand, (k % 5 == 0) | (k % 2 == 0)), blank(kind, k % 5 == 0)).alias("label"),
        raw.alias("raw"), text.carrier(raw).alias("carrier"), text.pipe_join(F.concat_ws(" | ", brand, kind), F.when(k % 2 == 0, name).otherwise(kind)).alias("sources"),
        text.with_flag(brand, "cheap", F.col("p_retailprice") < 1000).alias("flags"), text.longer_value(name, kind).alias("longer"),
    )


@query(f"""WITH e AS (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN NULL END AS said, TIMESTAMP '{AS_OF}' AS now FROM events),
p AS (SELECT *, CASE WHEN event_id % 4 = 2 THEN now ELSE CAST(said AS TIMESTAMP) END AS parsed, coalesce(CAST(said AS DATE), CASE WHEN event_id % 8 < 4 THEN CAST(ts AS DATE) END, CAST(now AS DATE)) AS day FROM e)
SELECT event_id, parsed, coalesce(strftime(said, '%Y-%m-%dT%H:%M:%SZ'), '') AS iso, day, epoch(now) - epoch(parsed) AS seconds, day >= CAST(now AS DATE) - 29 AS recent FROM p""")
def time_rules(spark: SparkSession, d: str) -> DataFrame:
    """Times that feeds write as ISO text, as a date, not at all, or unreadably; the days that follow, and which are recent."""
    key, now, ts = F.col("event_id"), F.lit(AS_OF).cast("timestamp"), F.col("ts").cast("timestamp")
    said = by_rest(key, 4, {0: F.date_format(ts, " yyyy-MM-dd'T'HH:mm:ss"), 1: F.date_format(ts, "yyyy-MM-dd"), 2: " "}, F.lit("soon"))
    parsed = dates.parse_timestamp(said, now)
    day = dates.date_or(said, F.when(key % 8 < 4, F.col("ts").cast("string")), now)
    return table(spark, d, "events").select(
        "event_id", parsed.cast("timestamp_ntz").alias("parsed"), dates.timestamp_text(said).alias("iso"), day.alias("day"), dates.duration_seconds(parsed, now).alias("seconds"), (day >= dates.cutoff_day(now, 30)).alias("recent")
    )


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS n, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS code, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'no_ean' WHEN 2 THEN 'second_hand_confirmed' ELSE p_type END AS status,
p_partkey % 11 <> 0 AS titled, p_partkey % 7 <> 0 AS informed, p_partkey % 2 = 0 AS described, p_partkey % 4 = 1 AS priced, p_partkey % 13 = 0 OR p_partkey % 17 = 0 AS used FROM part),
v AS (SELECT *, titled AND informed AND (described OR priced) AS valid FROM p)
SELECT k, code = '' AND coalesce(status, '') NOT IN ('no_ean', 'second_hand_confirmed') AS needs, valid, used AS second_hand, CASE WHEN n > 45 THEN 'fetch_error' WHEN NOT valid THEN 'invalid_page' WHEN code <> '' THEN 'ok' WHEN used THEN 'second_hand_confirmed' ELSE 'no_ean' END AS state,
NOT priced OR NOT titled AS lacks, least(1.0, CAST(4 * n AS DOUBLE) / 125) AS confidence, least(100, greatest(0, 3 * n - 20)) AS percent, CASE WHEN n % 9 = 0 THEN 'running' WHEN n % 9 = 1 THEN 'failed' WHEN n % 3 = 0 THEN 'empty' WHEN n % 4 > 0 THEN 'partial' ELSE 'success' END AS run FROM v""")
def enrichment_rules(spark: SparkSession, d: str) -> DataFrame:
    """Which rows need their page read again, what came of it, and how a run ended."""
    k, n, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    some = lambda c, test: F.when(test, c).otherwise(F.lit(" "))
    code = F.when(k % 3 == 0, F.lit("")).otherwise(k.cast("string"))
    status = by_rest(k, 5, {0: None, 1: "no_ean", 2: "second_hand_confirmed"}, F.col("p_type"))
    title, price = some(name, k % 11 != 0), some(F.col("p_retailprice").cast("string"), k % 4 == 1)
    valid = classify.is_valid_page(title, some(F.col("p_brand"), k % 7 != 0), some(F.col("p_type"), k % 2 == 0), price, F.lit(""))
    used = classify.is_second_hand(F.concat(name, F.when(k % 13 == 0, F.lit(" (2e  Hands)")).when(k % 17 == 0, F.lit(" pre-owned")).otherwise(F.lit(""))))
    exit_code = F.when(n % 9 == 0, F.lit(None).cast("int")).when(n % 9 == 1, F.lit(3)).otherwise(F.lit(0))
    return table(spark, d, "part").select(
        k.alias("k"), classify.needs_enrichment(code, status).alias("needs"), valid.alias("valid"), used.alias("second_hand"), classify.enrichment_state(valid, n > 45, code, used).alias("state"),
        classify.lacks_details(price, title).alias("lacks"), classify.confidence(4 * n).alias("confidence"), classify.rank_confidence(3 * n - 20).alias("percent"), classify.run_status(exit_code, n % 3, n % 4).alias("run"),
    )


@query("""WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' || p_brand || '  No 1' ELSE p_brand END AS artist, CASE p_partkey % 3 WHEN 0 THEN '' ELSE upper(p_name) END AS title, CASE WHEN p_partkey % 5 > 0 THEN CAST(4000000000000 + p_partkey AS VARCHAR) END AS ean FROM part)
SELECT k, lower(trim(regexp_replace(concat_ws(' ', nullif(trim(artist), ''), nullif(title, ''), ean), '\\s+', ' ', 'g'))) AS imported, nullif(trim(concat_ws(' ', artist, title, ean)), '') AS synced, lower(trim(concat_ws(' ', artist, title, ean))) AS staged FROM p""".replace("\\\\", "\\"))
def search_texts(spark: SparkSession, d: str) -> DataFrame:
    """What three ways into the catalogue make of the same names for their search: collapsed, as they are, in lower case."""
    k, brand = F.col("p_partkey"), F.col("p_brand")
    artist = by_rest(k, 4, {0: F.lit(None).cast("string"), 1: F.concat(F.lit(" "), brand, F.lit("  No 1"))}, brand)
    parts = [artist, by_rest(k, 3, {0: ""}, F.upper("p_name")), F.when(k % 5 > 0, (F.lit(4000000000000) + k).cast("string"))]
    return table(spark, d, "part").select(k.alias("k"), text.search_text(*parts).alias("imported"), text.plain_search_text(*parts).alias("synced"), text.staged_search_text(*parts).alias("staged"))


@query("SELECT CAST(4000000000000 + l_partkey AS VARCHAR) AS ean, p_partkey AS product, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def resolved_codes(spark: SparkSession, d: str) -> DataFrame:
    """Offers by code, all of which must belong to a product; the codes are counted before they are looked up."""
    code = lambda c: (F.lit(4000000000000) + F.col(c)).cast("string").alias("ean")
    offers = table(spark, d, "lineitem").groupBy(code("l_partkey")).agg(F.count("*").alias("n"))
    return joins.resolve_all(offers, table(spark, d, "part").select(code("p_partkey"), F.col("p_partkey").alias("product")), "ean", "product").select("ean", "product", "n")
