"""URL expressions: canonical form and the classes of links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that only track visitors, and path patterns of pages without products.
TRACKING = ["srsltid", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid"]
EXCLUDED = [r"/media/", r"/tin-tuc/", r"/news/", r"/blog/", r"/khuyen-mai", r"/lien-he", r"/gioi-thieu", r"/tra-gop", r"/bao-hanh", r"/buildpc/?$", r"_idtin\d+\.html$", r"/tag/", r"/brand/", r"/search", r"/cart", r"/login", r"/register"]


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def canonical(url: Column, aliases: dict[str, str] | None = None) -> Column:
    """https, lower-case host (or its alias), single slashes, no tracking keys, no fragment."""
    h = host(url)
    for old, new in (aliases or {}).items():
        h = F.when(h == old, new).otherwise(h)
    kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    q = F.array_join(kept, "&")
    p = F.regexp_replace(path(url), "/{2,}", "/")
    return F.concat(F.lit("https://"), h, F.when(p == "", "/").otherwise(p), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def is_xml(url: Column) -> Column:
    return F.lower(path(url)).endswith(".xml")


def is_product_sitemap(url: Column) -> Column:
    return path(url).rlike(r"(?i)/sitemap_pc\d+\.xml$")


def is_category(url: Column) -> Column:
    return path(url).rlike(r"(?i)_dm\d+\.html(?:-\d+)?$")


def is_pagination(url: Column) -> Column:
    return path(url).rlike(r"(?i)\.html-\d+$")


def is_product_page(url: Column) -> Column:
    return F.lower(path(url)).endswith(".html") & ~is_category(url) & ~is_pagination(url)


def is_excluded(url: Column) -> Column:
    return path(url).rlike("(?i)" + "|".join(EXCLUDED))


def is_candidate(url: Column, hosts: list[str]) -> Column:
    """A product page of an allowed host that no pattern excludes."""
    return host(url).isin(*hosts) & is_product_page(url) & ~is_excluded(url)


def cache_key(url: Column) -> Column:
    """Name of a stored page: twelve digits of the URL's hash and its path with dashes."""
    name = F.regexp_replace(F.regexp_replace(path(url), r"[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.substring(F.sha1(url), 1, 12), F.lit("_"), F.substring(F.when(name == "", "index").otherwise(name), 1, 80))
