import datetime

import pytest
from pyspark.sql import functions as F

from pricelode.functions import classify, dates, html, ids, prices, scoring, text, urls


@pytest.fixture(scope="module")
def value(spark):
    """The value of an expression of a literal."""

    def of(function, *args):
        return spark.range(1).select(function(*(F.lit(a) if a is None or isinstance(a, (str, int, float)) else a for a in args)).alias("v")).first().v

    return of


@pytest.mark.parametrize(("raw", "want"), [("602577427664.0", "602577427664"), ("60257742766", "060257742766"), ("123", None), (None, None), ("0602577427664", "0602577427664")])
def test_ean(value, raw, want):
    assert value(ids.ean, raw) == want


def test_gtins(value):
    assert value(ids.gtin14, "0602577427664") == value(ids.gtin14, "602577427664") == "00602577427664"
    assert value(ids.check_digit, "060257742766") == 4
    assert value(ids.is_valid_gtin, "4006381333931") and not value(ids.is_valid_gtin, "4006381333930") and not value(ids.is_valid_gtin, "12")
    assert value(ids.ean_listing, "602577427664") == "0602577427664" and value(ids.ean_strict, "602577427664") is None
    assert value(ids.gtin14_to_ean13, "602577427664") == "0602577427664" and value(ids.same_product_code, "602577427664", "0602577427664")
    assert value(ids.upgraded_ean, "602577427664", "0602577427664") == "0602577427664" and value(ids.upgraded_ean, "12345678", "0602577427664") == "12345678"
    assert value(ids.is_uuid, "3f2504e0-4f89-11d3-9a0c-0305e82c3301") and not value(ids.is_uuid, "x")


@pytest.mark.parametrize(
    ("raw", "ean", "reason"),
    [("6.02E+11", "", "scientific_notation"), ('="0602577427664"', "0602577427664", ""), ("abc", "", "non_numeric_ean"), ("", "", "missing_ean"), (None, "", "missing_ean"), ("06-02 577", "0602577", "")],
)
def test_backfill_ean(value, raw, ean, reason):
    assert tuple(value(ids.backfill_ean, raw)) == (ean, reason)


@pytest.mark.parametrize(("raw", "want"), [("€ 1.234,56", 1234.56), ("12,5", 12.5), ("1.234", 1.234), ("", None), (None, None), ("nan", None), ("inf", None), ("1_000", None)])
def test_canonical_price(value, raw, want):
    assert value(prices.decimal_price, raw) == want


def test_rounding_differs_on_ties(value):
    assert str(value(prices.token_price, "2.345")) == "2.35" and value(prices.positive_price_text, "2.345") == "2.34"
    assert value(prices.token_price, "-5") is None and value(prices.positive_price_text, "-5") == ""
    assert value(prices.euro, 1234.5) == "€ 1.234,50" and value(prices.euro, F.lit(None).cast("double")) == "€--,--"
    assert tuple(value(prices.current_and_old, F.array(F.lit("20.00"), F.lit("15.00")))) == ("15.00", "20.00")


@pytest.mark.parametrize(
    ("artist", "title", "want"),
    [(None, "Night Ferry- Harbour", ("Night Ferry", "Harbour")), ("", "A - B – C", ("A - B", "C")), ("X", "A - B", ("X", "A - B")), (None, None, ("", "")), ("", "Solo", ("", "Solo"))],
)
def test_artist_and_title(value, artist, title, want):
    assert tuple(value(text.infer_artist_title, F.lit(artist).cast("string"), F.lit(title).cast("string"))) == want


def test_texts(value):
    assert value(text.collapse, "a  b‎ \t c") == "a b c" and value(text.collapse, F.lit(None).cast("string")) == ""
    assert value(text.slug, " Björk & Co! ") == "bj-rk-co" and value(text.canonical_key, "A B", "C") == "a-b::c"
    assert value(text.sync_key, "", "") is None
    assert tuple(value(text.artist_album, "Nick Cave - Ghosteen (2LP)")) == ("Nick Cave", "Ghosteen")
    assert tuple(value(text.artist_title_carrier, "Low - Hey What (Coloured Vinyl)")) == ("Low", "Hey What", "Coloured Vinyl")
    assert value(text.last_first, "Cave, Nick") == "Nick Cave" and value(text.last_first, "Low") == "Low"
    assert tuple(value(text.artist_year, "Low 2021")) == ("Low", 2021) and tuple(value(text.artist_year, "Low 3021")) == ("Low 3021", None)
    assert value(text.display_case, "ABBA") == "Abba" and value(text.display_case, "Abba x") == "Abba x"
    assert value(text.format_label, "LP", "", "LP", "Red") == "LP | Red" and value(text.format_label, "") == "Vinyl"
    assert value(text.carrier, "2LP") == "LP" and value(text.carrier, '12"') == "12 INCH" and value(text.carrier, "tape") == "TAPE"
    assert value(lambda a, b: text.pipe_join(a, b, 2), "a | b", "c") == "b | c" and value(text.pipe_join, "a", "a") == "a"
    assert value(lambda s: text.with_flag(s, "ok", F.lit(True)), "a|b") == "a|b|ok"
    assert value(lambda t: text.between_labels(t, ["Label"], ["Genre"]), "Label: 4AD Genre: Rock") == "4AD"
    assert value(text.strip_null_tokens, " NaN ") == "" and value(text.longer_value, "ab", "abc") == "abc"
    assert value(text.strip_format, "Hey What - 2LP") == "Hey What"


def test_similarity_is_ratcliff_obershelp(value):
    assert value(text.similarity, "abcd", "bcde") == 0.75  # two times three shared characters of eight
    assert value(text.similarity, "", "x") == 0.0 and value(text.similarity, F.lit(None).cast("string"), "x") == 0.0


def test_urls(value):
    assert value(urls.normalize_url, "HTTP://Ex.org//a//b/?q=1#x") == "http://ex.org/a/b" and value(urls.normalize_url, "") == ""
    assert value(lambda u: urls.query_param(u, "at"), "http://x/y?at=1&at=2") == "2"
    assert value(lambda u: urls.with_query_param(u, "page", F.lit(3)), "http://x/y?page=1&q=z#f") == "http://x/y?q=z&page=3"
    assert value(urls.resolve_image, "https://x.nl/a/b", "c.jpg#f") == "https://x.nl/a/c.jpg" and value(urls.resolve_image, "https://x.nl/a", "data:image/png") is None
    assert value(urls.resolve_image, "https://x.nl/a", "//c.nl/d.jpg") == "https://c.nl/d.jpg" and value(urls.resolve_image, "https://x.nl/a/b", "/d.jpg") == "https://x.nl/d.jpg"
    assert value(urls.domain, "https://www.X.nl/a") == "x.nl" and value(urls.country, "x.be") == "BE"
    assert value(lambda u: urls.canonical_product_url(u, "https://x.nl"), "/p/1/?a=1") == "https://x.nl/p/1"
    assert value(urls.max_page, '<a href="?page=2"><a href="?q=1&page=13">') == 13 and value(urls.max_page, "") == 1
    assert value(lambda u: urls.detail_fields(u)["release_id"], "https://x.nl/vinyl/low/hey-what/123") == "123"


def test_dates(value):
    ts = lambda x: F.lit(x).cast("timestamp")
    assert value(dates.local_day, ts("2024-03-31 23:30:00")) == datetime.date(2024, 4, 1)
    assert value(dates.iso_week, F.lit("2024-12-30").cast("date")) == "2025-W01"
    labels = [value(lambda a: dates.freshness_label(a, ts("2024-01-10 00:00:00")), ts(x)) for x in ("2024-01-09 00:06:00", "2024-01-09 00:00:00", "2024-01-08 00:00:00", "2024-01-07 00:00:00")]
    assert len(set(labels)) == 4
    assert [value(dates.backoff_minutes, n) for n in (1, 2, 3, 9, 100)] == [10, 20, 40, 1440, 1440]
    assert value(lambda a: dates.parse_timestamp(a, ts("2024-01-01 00:00:00")), "") == datetime.datetime(2024, 1, 1) and value(lambda a: dates.parse_timestamp(a, ts("2024-01-01 00:00:00")), "x") is None
    assert value(lambda a: dates.duration_seconds(a, ts("2024-01-01 00:00:01.5")), ts("2024-01-01 00:00:00")) == 1.5


def test_classes(value):
    assert value(classify.availability_of_text, "Niet op voorraad") == "out_of_stock" and value(classify.availability_of_text, "Op voorraad") == "in_stock"
    assert value(classify.is_hidden_format, "cd ") and not value(classify.is_hidden_format, "CD | Album")
    assert value(classify.is_second_hand, "2e hands LP") and not value(classify.is_second_hand, "nieuw")
    assert [value(classify.queue_state, s, n) for s, n in (("processing", 1), ("published", 0), ("published", 2), ("failed", 0))] == ["processing", "published", "queued", "queued"]
    assert value(classify.run_status, 0, 5, 1) == "partial" and value(classify.confidence, 250.0) == 1.0
    assert value(classify.signal_lines, "Low\n€ 12,00\nHey What\nLP\nLow") == ["Low", "Hey What"]


def test_decisions(value):
    decide = lambda a, b: value(scoring.match_decision, a, F.lit(b).cast("double"))
    assert [decide(116.0, None), decide(116.0, 110.0), decide(116.0, 104.0), decide(90.0, None)] == ["matched", "ambiguous", "matched", "no_match"]
    assert value(lambda: scoring.release_score(F.lit("1"), F.lit("1"), F.lit(100.0), F.lit(1.0), F.lit(0.5), F.lit("Official"))) == 150.0


def test_search_prefers_exact_over_prefix_over_part(value):
    none = F.lit(None)
    scores = [value(lambda t=t: scoring.search_score("low", F.lit("x"), F.lit(t), none, none, none, none)) for t in ("low", "lower", "slow")]
    assert scores == sorted(scores, reverse=True) and len(set(scores)) == 3


PAGE = """<title>T</title><meta property="og:image" content="/og.jpg"><meta name="twitter:image" content="https://c.nl/tw.jpg"><link rel="image_src" href="src.jpg">
<script type="application/ld+json">{"@type":"Product","image":["/ld.jpg",{"url":"https://c.nl/logo.png"}]}</script><img src="/img/logo.png"><img src="/x.jpg"><img class="cover" src="/cover.jpg">"""


def test_image_order(value):
    found = value(html.image_candidates, PAGE, "https://s.nl/p/1")
    assert [(c.url, c.source) for c in found] == [
        ("https://s.nl/og.jpg", "og"), ("https://c.nl/tw.jpg", "twitter"), ("https://s.nl/p/src.jpg", "image_src"), ("https://s.nl/ld.jpg", "jsonld"), ("https://s.nl/cover.jpg", "img_tag"), ("https://s.nl/x.jpg", "img_tag"),
    ]
    assert value(html.jsonld_images, '<script type="application/ld+json">{bad</script>', "https://s.nl") == []


def test_page_values(value):
    page = "<div>EAN:</div><div>0602577427664</div><p>12345678</p><script>var x=1</script>"
    assert value(lambda h: html.value_after(html.lines(h), "ean"), page) == "0602577427664" and value(lambda h: html.first_code_line(html.lines(h)), page) == "0602577427664"
    assert value(lambda t: html.labelled_price(t, ["Onze prijs"]), "Verzendkosten € 3,00 Onze prijs: € 19,99") == "19,99"
    assert value(lambda t: html.labelled_price(t, ["Adviesprijs"]), "€ 12,00 verzending € 3,00") == "12,00"
    assert value(html.embedded_array, 'x = {"variants": [{"a": "]"}, [1]]};', "variants") == '[{"a": "]"}, [1]]'


def test_product_of_a_page(value):
    block = '<script type="application/ld+json">{"@graph": [{"@type": "WebPage"}, {"@type": ["Thing", "Product"], "name": " N ", "offers": [{"url": "x"}, {"price": 12.5, "priceCurrency": "EUR"}]}]}</script>'
    found = value(html.jsonld_product, "<p>x</p><script type='application/ld+json'>{bad</script>" + block)
    assert (found.name, found.price, found.currency, found.availability) == ("N", "12.5", "EUR", None)
    assert value(html.jsonld_product, "<p>none</p>").name is None and value(html.jsonld_product, F.lit(None).cast("string")).name is None


def test_images_of_known_pages(spark):
    page = (
        '<meta property="og:image" content="/a.jpg"><link rel="image_src" href="//c.example/b.jpg"><script type="application/ld+json">{"image": ["/a.jpg", {"url": "/d.jpg#f"}]}</script>'
        '<img src="plain.png"><img class="product" src="main.png"><img src="/logo.png">'
    )
    row = spark.createDataFrame([(page, "http://s.example/x/")], "h string, u string").select(html.image_candidates(F.col("h"), F.col("u")).alias("c"), html.jsonld_images(F.col("h"), F.col("u")).alias("j")).first()
    assert [(c.url, c.source, c.position) for c in row.c] == [
        ("http://s.example/a.jpg", "og", 0), ("http://c.example/b.jpg", "image_src", 1), ("http://s.example/d.jpg", "jsonld", 2), ("http://s.example/x/main.png", "img_tag", 3), ("http://s.example/x/plain.png", "img_tag", 4),
    ]
    assert row.j == ["http://s.example/a.jpg", "http://s.example/d.jpg"]


def test_fallback_names(value):
    names = lambda *c: tuple(value(text.names_or_unknown, *(F.lit(x).cast("string") for x in c)))
    assert names(None, None, None, None, None) == ("Unknown Artist", "Unknown Title")
    assert names("", "", "the-band", "an-album", "") == ("the band", "an album") and names("A", "", "", "", "Shown") == ("A", "Shown")
    assert names("", "Night Ferry - Harbour", "", "", "") == ("Night Ferry", "Harbour")


def test_rows_that_lack_details(value):
    assert value(classify.lacks_details, "€ 80,00", "x") and value(classify.lacks_details, "", "x") and value(classify.lacks_details, "9,99", " ") and not value(classify.lacks_details, "9,99", "x")
    assert value(classify.rank_confidence, 130) == 100 and value(classify.rank_confidence, -5) == 0


def test_prices_round_as_binary_numbers(value):
    assert value(prices.plain_price, "382.895") == 382.89 and value(prices.digits_sign_price, "382.895") == "382.89" and value(prices.stripped_price, "2,675") == "2.67"


def test_embedded_arrays_with_escapes(value):
    assert value(html.embedded_array, 'var x = {"items": ["a]\\\\", "b"], "y": 1}', "items") == '["a]\\\\", "b"]'
    assert value(html.embedded_array, '"items": [1, 2', "items") is None
