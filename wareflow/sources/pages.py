"""Product records out of HTML pages.

Parsing markup is the one place here that needs Python; it runs over Arrow batches and only pulls strings out of
the page. All rules on these strings are native expressions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareflow.functions import text
from wareflow.session import importable

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
MAX_IMAGES = 20
#: Pages whose strings a task holds before it hands them on.
HELD_PAGES = 64
RAW_SCHEMA = "url string, title string, h1 string, og_title string, json_ld string, body string, links array<string>, images array<string>, pairs array<struct<key: string, value: string>>, crumbs array<string>, n_scripts int"


class PageText(HTMLParser):
    """Collects the strings of a page that records are made of."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.got = {"title": "", "h1": "", "og_title": None, "json_ld": [], "body": [], "links": [], "images": [], "pairs": [], "crumbs": [], "n_scripts": 0}
        self.open: list[str] = []
        self.row: list[str] = []
        self.cell: list[str] | None = None
        self.term = ""
        self.script = ""
        self.crumb = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag not in VOID:
            self.open.append(tag)
        if tag == "meta" and a.get("property") == "og:title":
            self.got["og_title"] = a.get("content")
        elif tag == "a" and a.get("href"):
            self.got["links"].append(a["href"])
        elif tag == "img" and (src := a.get("data-src") or a.get("src")) and src not in self.got["images"] and len(self.got["images"]) < MAX_IMAGES:
            self.got["images"].append(src)
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th", "dt", "dd", "li"):
            self.cell = []
        elif tag == "script":
            self.script = a.get("type") or ""
            self.got["n_scripts"] += 1
        if tag in ("nav", "ol", "ul") and "breadcrumb" in (a.get("class") or ""):
            self.crumb = len(self.open)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        cell = " ".join("".join(self.cell or []).split())
        if tag in ("td", "th"):
            self.row.append(cell)
        elif tag == "tr" and len(self.row) == 2 and all(self.row):
            self.got["pairs"].append({"key": self.row[0], "value": self.row[1]})
        elif tag == "dt":
            self.term = cell
        elif tag == "dd" and self.term and cell:
            self.got["pairs"].append({"key": self.term, "value": cell})
        elif tag == "li":
            key, colon, value = cell.partition(":")
            if self.crumb:
                self.got["crumbs"].append(cell)
            elif colon and key.strip() and value.strip() and len(key) <= 60:
                self.got["pairs"].append({"key": key.strip(), "value": value.strip()})
        if tag in ("td", "th", "dt", "dd", "li"):
            self.cell = None
        if self.crumb and len(self.open) < self.crumb:
            self.crumb = 0

    def handle_data(self, data):
        top = self.open[-1] if self.open else ""
        if top == "script":
            if self.script == "application/ld+json":
                self.got["json_ld"].append(data)
            return
        if top == "style":
            return
        for tag in ("title", "h1"):
            if tag in self.open:
                self.got[tag] += data
        if self.cell is not None:
            self.cell.append(data)
        if "title" not in self.open:
            self.got["body"].append(data)


def product_json(blocks: list[str]) -> str | None:
    """The first product object of JSON-LD blocks, graphs flattened, as JSON."""
    for block in blocks:
        try:
            todo = [json.loads(block)]
        except ValueError:
            continue
        while todo:
            x = todo.pop(0)
            if isinstance(x, list):
                todo = x + todo
            elif isinstance(x, dict):
                kind = x.get("@type")
                if kind == "Product" or (isinstance(kind, list) and "Product" in kind):
                    return json.dumps(x, ensure_ascii=False)
                todo += [x["@graph"]] if "@graph" in x else []
    return None


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The raw strings of each page; null markup gives a row of empty strings."""

    importable(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), HELD_PAGES):
                part = batch.iloc[at : at + HELD_PAGES]
                rows = []
                for u, h in zip(part["u"], part["h"], strict=True):
                    p = PageText()
                    p.feed(h or "")
                    p.close()
                    g = p.got
                    rows.append(g | {"url": u, "json_ld": product_json(g["json_ld"]), "body": " ".join("".join(g["body"]).split())})
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in RAW_SCHEMA.split(", ") if not c.startswith("value")])

    return pages.select(F.col(url).alias("u"), F.col(html).alias("h")).mapInPandas(run, RAW_SCHEMA)


def script_counts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, n_scripts) of each page by the same parser, whose other strings never leave the page they are of."""

    importable(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = []
            for h in batch["h"]:
                p = PageText()
                p.feed(h or "")
                p.close()
                counts.append(p.got["n_scripts"])
            yield pd.DataFrame({"url": batch["u"], "n_scripts": counts})

    return pages.select(F.col(url).alias("u"), F.col(html).alias("h")).mapInPandas(run, "url string, n_scripts int")


def records(raw: DataFrame) -> DataFrame:
    """Product records by native rules: JSON-LD first, then markup. Content pages are dropped.

    A page goes if it has no name, or if its category is other and it has neither a JSON-LD product, a price nor specs.
    """
    j = lambda p: F.nullif(text.clean(F.get_json_object("json_ld", p)), F.lit(""))
    some = lambda c: F.nullif(text.clean(c), F.lit(""))
    name = F.coalesce(j("$.name"), some(F.col("h1")), some(F.col("og_title")))
    price = F.coalesce(text.price_digits(F.regexp_replace(F.coalesce(j("$.offers.price"), j("$.offers[0].price")), r"\.0+$", "")), text.price_in_text(F.col("body")))
    availability = F.lower(F.coalesce(j("$.offers.availability"), j("$.offers[0].availability")))
    stock = F.when(availability.contains("outofstock"), "out_of_stock").when(availability.contains("instock"), "in_stock").otherwise(text.stock_phrase(F.col("body")))
    specs = F.when(F.size("pairs") >= 3, F.col("pairs")).otherwise(F.array().cast("array<struct<key: string, value: string>>"))
    out = raw.select(
        F.col("url").alias("source_url"),
        name.alias("name"),
        F.coalesce(j("$.brand.name"), j("$.brand")).alias("brand"),
        F.coalesce(j("$.sku"), j("$.mpn")).alias("sku"),
        price.alias("price_vnd"),
        stock.alias("stock_status"),
        F.coalesce(j("$.description"), F.lit(None)).alias("description"),
        some(F.regexp_extract("body", r"(?iu)(bảo hành[^.]{0,80})", 1)).alias("warranty"),
        F.col("crumbs").alias("breadcrumbs"),
        "images",
        specs.alias("raw_specs"),
        text.category(F.concat_ws(" ", F.array_join("crumbs", " "), name, F.col("url"))).alias("category"),
        F.col("json_ld").isNotNull().alias("has_json_ld"),
    )
    content = (F.col("category") == "other") & ~F.col("has_json_ld") & F.col("price_vnd").isNull() & (F.size("raw_specs") == 0)
    return out.where(F.col("name").isNotNull() & ~content)
