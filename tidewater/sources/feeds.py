"""Landed feed payloads to observations: RSS and Atom documents, JSON item lists, CSV registries.

Payloads arrive as rows (id, payload), whatever fetched them, so parsing is parallel and repeatable. Malformed payloads give
no rows and never stop a job.
"""

from __future__ import annotations

import html
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.phrases import published, quoted

ATOM = "{http://www.w3.org/2005/Atom}"
ITEM_SCHEMA = "pos int, title string, url string, published string"


#: Element of an item: its title, its link, the link's attribute that holds the address (None: its text), its times.
FORMS = {
    "item": ("title", "link", None, ("pubDate",)),
    f"{ATOM}entry": (f"{ATOM}title", f"{ATOM}link", "href", (f"{ATOM}published", f"{ATOM}updated")),
}


def _items(payload: str) -> list[tuple[str, str, str | None]]:
    """title, url, time of the usable items of one document, read in one pass of parser events; RSS before Atom."""
    found: dict[str, list] = {name: [] for name in FORMS}
    parser = ET.XMLPullParser(("end",))
    parser.feed(payload)
    parser.close()
    for _, node in parser.read_events():
        if node.tag not in FORMS:
            continue
        title, link, attribute, times = FORMS[node.tag]
        parts = {child.tag: child for child in reversed(node)}  # the first of each
        text = "".join(parts[title].itertext()) if title in parts else ""
        place = parts.get(link)
        url = "" if place is None else place.get(attribute, "") if attribute else place.text or ""
        if attribute is None:
            text = html.unescape(text)
        if text and url.startswith("http"):
            found[node.tag].append((text, url, next((parts[t].text for t in times if t in parts and parts[t].text), None)))
        node.clear()
    return next((rows for rows in found.values() if rows), [])


def feed_items(payloads: DataFrame, max_items: int = 500) -> DataFrame:
    """id, pos, title, url, published of RSS 2.0 payloads; Atom entries only where there is no valid RSS item.

    Items without a title or an http address are left out before the limit. XML has no split points and titles nest
    markup, which is why a payload is parsed as a whole, in Arrow batches.
    """
    kind = dict(payloads.dtypes)["id"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, payload in zip(batch["id"], batch["payload"]):
                try:
                    rows += [(key, i, *item) for i, item in enumerate(_items(payload)[:max_items])]
                except (ET.ParseError, TypeError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["id", "pos", "title", "url", "published"])

    parsed = payloads.select("id", "payload").mapInPandas(parse, f"id {kind}, {ITEM_SCHEMA}")
    return parsed.withColumn("published", published(F.col("published")))


def ranked_ids(payloads: DataFrame, items: DataFrame, max_items: int = 60, page: str = "https://news.example/item?id=") -> DataFrame:
    """pos, title, url, published: an id list cut to ``max_items`` first, then joined with its items; dead, deleted and
    untitled items are left out, items without an address get their page."""
    ids = payloads.select(F.posexplode(F.from_json("payload", "array<bigint>")).alias("pos", "item")).where(F.col("pos") < max_items)
    fields = F.from_json("payload", "id bigint, title string, url string, time bigint, dead boolean, deleted boolean")
    parsed = items.select(fields.alias("x")).select("x.*").where(F.col("id").isNotNull() & ~F.coalesce("dead", F.lit(False)) & ~F.coalesce("deleted", F.lit(False)) & (F.length("title") > 0))
    joined = ids.join(parsed, ids["item"] == parsed["id"])
    return joined.select("pos", "title", F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit(page), F.col("item").cast("string"))).alias("url"), F.timestamp_seconds("time").alias("published"))


def most_viewed(payloads: DataFrame, base: str, max_items: int = 500, special: tuple[str, ...] = ("Special:", "Wikipedia:", "Main_Page", "Accueil_principal")) -> DataFrame:
    """pos, title, url of a list of viewed articles: cut first, then special pages removed; underscores become spaces."""
    shape = "items array<struct<articles array<struct<article string, views bigint>>>>"
    articles = F.from_json("payload", shape)["items"][0]["articles"]
    rows = payloads.select(F.posexplode(articles).alias("pos", "a")).where(F.col("pos") < max_items).select("pos", F.col("a.article").alias("article"))
    ordinary = rows.where(F.col("article").isNotNull())
    for prefix in special:
        ordinary = ordinary.where(~F.col("article").startswith(prefix))
    return ordinary.select("pos", F.replace("article", F.lit("_"), F.lit(" ")).alias("title"), F.concat(F.lit(base), quoted(F.col("article"))).alias("url"))


def register_documents(payloads: DataFrame) -> DataFrame:
    """pos, title, url, published of a JSON result list; entries without title or address are left out."""
    shape = "results array<struct<title string, html_url string, publication_date string>>"
    rows = payloads.select(F.posexplode(F.from_json("payload", shape)["results"]).alias("pos", "r"))
    return rows.where((F.length("r.title") > 0) & (F.length("r.html_url") > 0)).select("pos", F.col("r.title").alias("title"), F.col("r.html_url").alias("url"), published(F.col("r.publication_date")).alias("published"))


def price_points(payloads: DataFrame) -> DataFrame:
    """symbol, day, close of chart payloads (symbol, payload): stamps and closes side by side, unusable closes left out, the
    last of a day kept, 4 places."""
    shape = "chart struct<result array<struct<timestamp array<bigint>, indicators struct<quote array<struct<close array<double>>>>>>>"
    result = F.from_json("payload", shape)["chart"]["result"][0]
    pairs = F.arrays_zip(result["timestamp"].alias("t"), result["indicators"]["quote"][0]["close"].alias("c"))
    rows = payloads.select("symbol", F.explode(pairs).alias("p")).select("symbol", F.col("p.t").alias("t"), F.col("p.c").alias("c")).where((F.col("c") > 0) & F.col("t").isNotNull())
    return rows.groupBy("symbol", F.to_date(F.timestamp_seconds("t")).alias("day")).agg(F.round(F.max_by("c", "t"), 4).alias("close"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """A CSV registry with a header; every column is text."""
    return spark.read.option("header", True).csv(path)


def within_size(payloads: DataFrame, most: int, payload: Column | None = None) -> DataFrame:
    """Payloads of at most ``most`` bytes."""
    return payloads.where(F.octet_length(payload if payload is not None else F.col("payload")) <= most)
