"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, name: str) -> Column:
    """scheme, host (with credentials and port), path or query; '' where missing."""
    return F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), _PARTS, ("scheme", "host", "path", "query").index(name) + 1)


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, one slash for many, no last slash, query or fragment; '' stays."""
    scheme = F.lower(F.coalesce(F.nullif(part(url, "scheme"), F.lit("")), F.lit("https")))
    path = F.regexp_replace(part(url, "path"), "/+", "/")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    whole = F.concat(scheme, F.lit("://"), F.lower(part(url, "host")), path)
    return F.when(F.trim(F.coalesce(url, F.lit(""))) == "", F.lit("")).otherwise(whole)


def canonical_product_url(url: Column, root: str) -> Column:
    """A product's URL without query, fragment and last slash; relative paths belong to ``root``."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"[?#].*$", ""), "/+$", "")
    return F.when(bare == "", F.lit("")).when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), bare).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(bare, "^/+", "")))


def resolve_image(base: Column, url: Column) -> Column:
    """An image's absolute URL without fragment; null for blank and data: URLs."""
    u = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    scheme = F.coalesce(F.nullif(part(base, "scheme"), F.lit("")), F.lit("https"))
    origin = F.concat(scheme, F.lit("://"), part(base, "host"))
    folder = F.regexp_replace(part(base, "path"), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when((u == "") | F.lower(u).startswith("data:"), F.lit(None).cast("string")).when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), u)
        .when(u.startswith("//"), F.concat(scheme, F.lit(":"), u)).when(u.startswith("/"), F.concat(origin, u)).otherwise(F.concat(origin, folder, u))
    )


def query_param(url: Column, name: str) -> Column:
    """The last value of a query parameter; '' where missing."""
    found = F.regexp_extract_all(F.concat(F.lit("&"), part(url, "query")), F.lit(rf"&\Q{name}\E=([^&]*)"), 1)
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def with_query_param(url: Column, name: str, value: Column) -> Column:
    """The URL with a query parameter set; others keep their order."""
    pairs = F.filter(F.split(part(url, "query"), "&"), lambda p: (p != "") & ~p.rlike(rf"^\Q{name}\E(=|$)"))
    query = F.array_join(F.concat(pairs, F.array(F.concat(F.lit(f"{name}="), value.cast("string")))), "&")
    return F.concat(F.regexp_replace(F.trim(url), r"[?#].*$", ""), F.lit("?"), query)


def path_segments(url: Column) -> Column:
    return F.filter(F.split(part(url, "path"), "/"), lambda s: s != "")


def detail_fields(url: Column) -> Column:
    """struct(kind, artist_slug, title_slug, release_id) of /kind/artist/title/id paths."""
    s = path_segments(url)
    at = lambda k: F.coalesce(F.try_element_at(s, F.lit(k)), F.lit(""))
    last = F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(""))
    return F.struct(at(1).alias("kind"), at(2).alias("artist_slug"), at(3).alias("title_slug"), F.regexp_extract(last, r"([0-9]+)$", 1).alias("release_id"))


def domain(url: Column) -> Column:
    """The host for display: lower case, without www."""
    return F.regexp_replace(F.lower(part(url, "host")), "^www\\.", "")


#: Fixed values.
_COUNTRIES = {".nl": "NL", ".be": "BE", ".de": "DE"}


def country(host: Column) -> Column:
    found = F.lit("NL")
    for tail, code in _COUNTRIES.items():
        found = F.when(F.lower(host).endswith(tail), F.lit(code)).otherwise(found)
    return found


def storage_path(prefix: str, code: Column, digest: Column, extension: str) -> Column:
    """prefix/ean/<first three>/<code>/<sixteen of the digest>.extension"""
    return F.concat_ws("/", F.lit(prefix), F.lit("ean"), F.substring(code, 1, 3), code, F.concat(F.substring(digest, 1, 16), F.lit(f".{extension}")))


def max_page(html: Column) -> Column:
    """The largest page number of the links of a page; 1 if there are none."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(html, F.lit(r"[?&]page=(\d{1,6})"), 1), lambda x: x.cast("int"))), F.lit(1))
