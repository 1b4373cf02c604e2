"""The connectors over payloads made from the test tables, and their SQL twins.

A payload is one document as a source would send it: the items of one source on the last day, or the quotes of one symbol.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.runtime import table
from tidewater.sources import feeds

PAGE = "https://news.example/item?id="
WIKI = "https://wiki.example/wiki/"


def _last_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The observations of the last day; a feed document holds one source's items of a day."""
    o = table(spark, sf, "observation")
    return o.join(F.broadcast(o.agg(F.max("batch_id").alias("batch_id"))), "batch_id")  # one row


def _listed(df: DataFrame, by: list[str], item: Column) -> DataFrame:
    """The items of each document in order of arrival."""
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("obs_id", item.alias("item")))).alias("rows"))
    return rows.select(*by, F.col("rows.item").alias("items"))


def feed_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """id (source), payload: RSS of the last day's items; every other source, by its length, sends Atom instead."""

    def xml(c: Column) -> Column:
        for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(sign), F.lit(entity))
        return F.coalesce(c, F.lit(""))

    day = F.coalesce(F.date_format("published", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.lit(""))
    iso = F.coalesce(F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    rss = F.concat(F.lit("<item><title>"), xml(F.col("title")), F.lit("</title><link>"), xml(F.col("url")), F.lit("</link><pubDate>"), day, F.lit("</pubDate></item>"))
    atom = F.concat(F.lit("<entry><title>"), xml(F.col("title")), F.lit('</title><link href="'), xml(F.col("url")), F.lit('"/><updated>'), iso, F.lit("</updated></entry>"))
    rows = _listed(_last_batch(spark, sf), ["source"], F.when(F.length("source") % 2 == 0, rss).otherwise(atom))
    body = F.array_join("items", "")
    whole = F.when(F.length("source") % 2 == 0, F.concat(F.lit("<rss><channel>"), body, F.lit("</channel></rss>"))).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), body, F.lit("</feed>")))
    return rows.select(F.col("source").alias("id"), whole.alias("payload"))


def feed_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of feed documents: RSS, Atom where there is no RSS item."""
    rows = feeds.feed_items(feed_payloads(spark, sf), max_items=10_000)
    return rows.select("id", "title", "url", F.unix_timestamp("published").alias("published_s"))


def ranked_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The first sixty of the last day's ranked ids, joined with the items of all days."""
    ids = _listed(_last_batch(spark, sf).withColumn("all", F.lit(1)), ["all"], F.col("obs_id")).select(F.to_json("items").alias("payload"))
    item = F.struct(F.col("obs_id").alias("id"), "title", "url", F.unix_timestamp("published").alias("time"), F.when(F.col("lang").isNull(), True).alias("dead"))
    items = table(spark, sf, "observation").select(F.to_json(item).alias("payload"))
    return feeds.ranked_ids(ids, items, 60, PAGE).select("pos", "title", "url", F.unix_timestamp("published").alias("published_s"))


def most_viewed(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of the last day as a list of viewed articles."""
    article = F.struct(F.replace("title", F.lit(" "), F.lit("_")).alias("article"), F.lit(1).cast("long").alias("views"))
    rows = _listed(_last_batch(spark, sf).withColumn("all", F.lit(1)), ["all"], article)
    payload = F.to_json(F.struct(F.array(F.struct(F.col("items").alias("articles"))).alias("items")))
    return feeds.most_viewed(rows.select(payload.alias("payload")), WIKI)


def register_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Items of the last day as a register's result list."""
    entry = F.struct("title", F.col("url").alias("html_url"), F.date_format("published", "yyyy-MM-dd").alias("publication_date"))
    rows = _listed(_last_batch(spark, sf).withColumn("all", F.lit(1)), ["all"], entry)
    out = feeds.register_documents(rows.select(F.to_json(F.struct(F.col("items").alias("results"))).alias("payload")))
    return out.select("pos", "title", "url", F.date_format("published", "yyyy-MM-dd").alias("published"))


def price_points(spark: SparkSession, sf: str) -> DataFrame:
    """Daily closes of every symbol from its chart document."""
    quotes = table(spark, sf, "market").where(F.col("quote_ts").isNotNull()).select("symbol", F.unix_timestamp("quote_ts").alias("t"), F.when(~F.isnan("close"), F.col("close")).alias("c"), "quote_id")
    rows = quotes.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("t", "quote_id", "c"))).alias("q"))
    result = F.struct(F.col("q.t").alias("timestamp"), F.struct(F.array(F.struct(F.col("q.c").alias("close"))).alias("quote")).alias("indicators"))
    chart = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")), {"ignoreNullFields": "false"})
    return feeds.price_points(rows.select("symbol", chart.alias("payload")))


QUERIES = {"feed_items": feed_items, "ranked_ids": ranked_ids, "most_viewed": most_viewed, "register_documents": register_documents, "price_points": price_points}


# --- twins --------------------------------------------------------------------------------------------------------------
def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def unescaped_sql(column: str) -> str:
    """``column`` with every entity resolved once, from the list of all named ones; the ampersand's comes last."""
    named = {f"&{name}": sign for name, sign in html.entities.html5.items() if name.endswith(";")}
    table_ = f"map([{', '.join(map(_quoted, named))}], [{', '.join(map(_quoted, named.values()))}])"
    code = "CASE WHEN e ILIKE '&#x%' THEN chr(('0x' || e[4:-2])::INTEGER) WHEN e LIKE '&#%' THEN chr(e[3:-2]::INTEGER) ELSE coalesce(named[e], e) END"
    found = f"list_distinct(regexp_extract_all({column}, '&(#[0-9]{{1,6}}|#[xX][0-9a-fA-F]{{1,5}}|[A-Za-z][A-Za-z0-9]*);'))"
    order = f"list_concat(list_filter({found}, lambda e: e NOT IN ('&amp;', '&AMP;')), list_filter({found}, lambda e: e IN ('&amp;', '&AMP;')))"
    return f"(SELECT list_reduce(list_prepend({column}, {order}), lambda acc, e: replace(acc, e, {code})) FROM (SELECT {table_} AS named))"


_LAST = "last_batch AS (SELECT *, (row_number() OVER (ORDER BY obs_id) - 1)::INTEGER AS pos FROM observation WHERE batch_id = (SELECT max(batch_id) FROM observation))"

SQL = {
    "feed_items": f"WITH {_LAST} SELECT source AS id, CASE WHEN length(source) % 2 = 0 THEN {unescaped_sql('title')} ELSE title END AS title, url, epoch(published)::BIGINT AS published_s FROM last_batch WHERE title <> '' AND url LIKE 'http%'",
    "ranked_ids": f"WITH {_LAST} SELECT pos, title, coalesce(nullif(url, ''), '{PAGE}' || obs_id) AS url, epoch(published)::BIGINT AS published_s FROM last_batch WHERE pos < 60 AND lang IS NOT NULL AND title <> ''",
    "most_viewed": f"WITH {_LAST} SELECT pos, replace(title, '_', ' ') AS title, '{WIKI}' || replace(url_encode(replace(title, ' ', '_')), '%2F', '/') AS url FROM last_batch WHERE pos < 500 AND title IS NOT NULL AND NOT regexp_matches(replace(title, ' ', '_'), '^(Special:|Wikipedia:|Main_Page|Accueil_principal)')",
    "register_documents": f"WITH {_LAST} SELECT pos, title, url, strftime(published, '%Y-%m-%d') AS published FROM last_batch WHERE title <> '' AND url <> ''",
    "price_points": "SELECT symbol, strftime(quote_ts, '%Y-%m-%d') AS day, round(close, 4) AS close FROM market WHERE close > 0 AND isfinite(close) QUALIFY row_number() OVER (PARTITION BY symbol, quote_ts::DATE ORDER BY quote_ts DESC, quote_id DESC) = 1",
}
