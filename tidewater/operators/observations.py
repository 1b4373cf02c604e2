"""Observations: filters, first-wins deduplication, and daily counts of documents and phrases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.config import OTHER_DOMAIN
from tidewater.functions.phrases import phrases, scheme, without_publisher


def recent(obs: DataFrame, days: int = 3, always: str = "trend_feed") -> DataFrame:
    """Observations published within ``days`` of their collection, undated ones, and all of the family ``always``."""
    return obs.where((F.col("family") == always) | F.col("published").isNull() | (F.col("published") >= F.col("collected_at_utc") - F.expr(f"INTERVAL {days} DAYS")))


def publisher_stripped(obs: DataFrame, family: str = "news_agg") -> DataFrame:
    """Titles of aggregators without the publisher behind the last dash."""
    return obs.withColumn("title", F.when(F.col("family") == family, without_publisher(F.col("title"))).otherwise(F.col("title")))


def web_address(url: Column) -> Column:
    """Whether an address starts with http:// or https://, as written."""
    return F.coalesce(url.startswith("https://") | url.startswith("http://"), F.lit(False))


def web_scheme(url: Column) -> Column:
    """Whether an address has the scheme http or https in any letter case."""
    return F.coalesce(scheme(url).isin("http", "https"), F.lit(False))


def first_wins(obs: DataFrame, keep: list[str], accepted: Column) -> DataFrame:
    """One observation per source and url: the first by obs_id. A minimum of structs, combined on the map side."""
    best = F.min(F.struct("obs_id", *keep)).alias("first__")
    return obs.where(accepted).groupBy("source", "url").agg(best).select("source", "url", "first__.obs_id", *[f"first__.{k}" for k in keep])


def limited(obs: DataFrame, items: int) -> DataFrame:
    """The first ``items`` observations of each source."""
    return obs.withColumn("at__", F.row_number().over(W.partitionBy("source").orderBy("obs_id"))).where(F.col("at__") <= items).drop("at__")


def documents_by(dedup: DataFrame, keys: list[str]) -> DataFrame:
    """Documents per key, counted before phrases are exploded: a document without phrases counts."""
    return dedup.groupBy(*keys).agg(F.count("*").alias("documents"))


def exploded(dedup: DataFrame, keep: list[str], extract: Callable[[Column], Column] = phrases) -> DataFrame:
    """One row per document and distinct phrase; ``extract`` makes an array of phrases out of a title."""
    return dedup.select(*keep, F.explode(extract(F.col("title"))).alias("term"))


def terms_by(dedup: DataFrame, keys: list[str]) -> DataFrame:
    """Documents that hold a phrase, per key and phrase."""
    return exploded(dedup, keys).groupBy(*keys, "term").agg(F.count("*").alias("count"))


def first_links(pairs: DataFrame, keys: list[str], order: list[Column], links: int = 3) -> DataFrame:
    """The first ``links`` distinct addresses of each key in arrival order.

    Each address is reduced to its first arrival and ranked, so no key's addresses are ever collected whole.
    """
    first = pairs.groupBy(*keys, "url").agg(F.min(F.struct(*order)).alias("at__"))
    ranked = first.withColumn("n__", F.row_number().over(W.partitionBy(*keys).orderBy("at__", "url"))).where(F.col("n__") <= links)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n__", "url"))).alias("l__")).select(*keys, F.transform("l__", lambda x: x["url"]).alias("links"))


def domain(obs: DataFrame) -> DataFrame:
    """Observations with a domain, the default one where it is missing."""
    return obs.withColumn("domain", F.coalesce("domain", F.lit(OTHER_DOMAIN)))


def overlaid(history: DataFrame, today: DataFrame, key: str = "day") -> DataFrame:
    """``history`` with the days of ``today`` replaced by it."""
    return history.join(today.select(key).distinct(), key, "left_anti").unionByName(today)


def last_days(daily: DataFrame, n: int, before: Column | None = None) -> DataFrame:
    """The rows of the last ``n`` days that occur (not calendar days), optionally only before a day."""
    days = daily.select("day").distinct() if before is None else daily.where(F.col("day") < before).select("day").distinct()
    kept = days.orderBy(F.col("day").desc()).limit(n)
    return daily.join(F.broadcast(kept), "day", "left_semi")  # at most n days
