"""URL functions as column expressions; lenient by regular expressions, where the built-in parser refuses or raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that only track, and file kinds.
TRACKING_KEYS = ("spm", "from", "source", "ref", "fbclid", "gclid")
TRACKING_PREFIX = "utm_"
HTML_SUFFIX = r"(?i)\.(html|htm|php|asp|aspx)$"
MEDIA_SUFFIX = r"(?i)\.(jpg|jpeg|png|gif|zip|rar)$"
EXTENSIONS = {"text/html": ".html", "application/pdf": ".pdf", "text/plain": ".txt", "image/png": ".png", "image/jpeg": ".jpg", "application/zip": ".zip", "application/json": ".json"}

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*)://"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def host(url: Column) -> Column:
    return F.regexp_extract(url, HOST, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def _coded(c: Column) -> Column:
    """Form decoding and encoding again, as form data is written."""
    back = F.url_encode(F.coalesce(F.try_url_decode(c), c))
    return F.replace(F.replace(back, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalized(url: Column) -> Column:
    """Without fragment and tracking keys; an empty path becomes /; other keys keep their order and blank values."""
    items = F.filter(F.split(F.regexp_extract(url, QUERY, 1), "&"), lambda i: i != "")
    pairs = F.transform(items, lambda i: F.struct(F.regexp_extract(i, "^([^=]*)", 1).alias("k"), F.regexp_extract(i, "^[^=]*=(.*)$", 1).alias("v")))
    kept = F.filter(pairs, lambda p: ~p["k"].isin(*TRACKING_KEYS) & ~p["k"].startswith(TRACKING_PREFIX))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_coded(p["k"]), F.lit("="), _coded(p["v"]))), "&")
    p = path(url)
    base = F.concat(scheme(url), F.lit("://"), host(url), F.when(p == "", F.lit("/")).otherwise(p))
    return F.when(query != "", F.concat(base, F.lit("?"), query)).otherwise(base)


def allowed(url: Column, domains: Column, excluded: Column) -> Column:
    """http(s), host exactly among the domains, and no non-empty excluded pattern within the path."""
    p = path(url)
    return (
        scheme(url).isin("http", "https")
        & F.array_contains(domains, host(url))
        & ~F.exists(F.coalesce(excluded, F.array().cast("array<string>")), lambda x: (x != "") & F.contains(p, x))
    )


def is_pdf(url: Column, mime: Column) -> Column:
    return F.contains(F.lower(F.coalesce(mime, F.lit(""))), F.lit("pdf")) | F.lower(path(url)).endswith(".pdf")


def is_html(url: Column, mime: Column) -> Column:
    p = path(url)
    return F.contains(F.lower(F.coalesce(mime, F.lit(""))), F.lit("html")) | ~F.contains(p, F.lit(".")) | p.rlike(HTML_SUFFIX)


def extension(url: Column, mime: Column) -> Column:
    """.pdf for PDFs, else what the media type says, else .html."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1)))
    known = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.when(is_pdf(url, mime), F.lit(".pdf")).otherwise(F.coalesce(F.try_element_at(known, kind), F.lit(".html")))


def is_media(url: Column) -> Column:
    return url.rlike(MEDIA_SUFFIX)


def title_from(url: Column, fallback: Column) -> Column:
    """The last part of the path, decoded, without its suffix; the fallback where that is empty."""
    stem = F.regexp_replace(F.regexp_extract(path(url), "([^/]*)/?$", 1), r"(?<=.)\.[^.]*$", "")
    plain = F.trim(F.coalesce(F.try_url_decode(F.replace(stem, F.lit("+"), F.lit("%2B"))), stem))
    return F.coalesce(F.nullif(plain, F.lit("")), fallback)
