"""The queries of the trend, theme and market computations over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.config import OTHER_DOMAIN, THEME_IDS
from tidewater.functions import phrases as P
from tidewater.functions.days import figure, parse_day
from tidewater.functions.terms import term_key
from tidewater.operators import market as M
from tidewater.operators import observations as O
from tidewater.operators import trends as T
from tidewater.operators.latest import latest_by
from tidewater.plans import connectors
from tidewater.plans.series import counted_snapshots
from tidewater.runtime import new_path, table
from tidewater.streaming import events as S

Query = Callable[[SparkSession, str], DataFrame]


def obs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "observation")


def by_source(spark: SparkSession, sf: str, keep: list[str] | None = None) -> DataFrame:
    """Observations once per source and address, as the source charts count them."""
    return O.first_wins(obs(spark, sf), keep or ["title"], O.web_scheme(F.col("url")))


def by_domain(spark: SparkSession, sf: str) -> DataFrame:
    """Observations once per source and address, as the domain charts count them."""
    return O.first_wins(O.domain(obs(spark, sf)), ["title", "family", "domain", "collected_at_utc"], O.web_address(F.col("url")))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return counted_snapshots(spark, sf).where(F.col("documents") >= 0).select("source", "day", F.col("documents").cast("long").alias("documents"))


def terms(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "snapshot_terms").select("source", parse_day(F.col("date")).alias("day"), term_key(F.col("term")).alias("term"), figure(F.col("count")).alias("count"), "collected_at_utc")
    rows = latest_by(raw.where(F.col("day").isNotNull()), ["source", "day", "term"], [F.col("collected_at_utc")], ["count"])
    return rows.where(F.col("count") > 0).withColumn("count", F.col("count").cast("long"))


def linked_terms(spark: SparkSession, sf: str) -> DataFrame:
    """source, day, term, pos, url of every address that stands for a counted phrase."""
    raw = table(spark, sf, "snapshot_terms").select("source", parse_day(F.col("date")).alias("day"), term_key(F.col("term")).alias("term"), figure(F.col("count")).alias("count"), "links", "collected_at_utc")
    rows = latest_by(raw.where(F.col("day").isNotNull()), ["source", "day", "term"], [F.col("collected_at_utc")], ["count", "links"])
    return rows.where(F.col("count") > 0).select("source", "day", "term", F.posexplode("links").alias("pos", "url"))


def statuses(spark: SparkSession, sf: str) -> DataFrame:
    """source, day, status of the last check of a day."""
    checks = table(spark, sf, "source_health").select("source", F.to_date("checked_at").alias("day"), "checked_at", F.upper(P.stripped(F.col("status"))).alias("status"))
    return checks.groupBy("source", "day").agg(F.max(F.struct("checked_at", "status")).alias("m")).select("source", "day", "m.status")


def sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_def")


def last_day(spark: SparkSession, sf: str) -> date:
    return counted_snapshots(spark, sf).agg(F.max("day")).first()[0]


def _days(spark: SparkSession, sf: str, as_of: date) -> DataFrame:
    return T.source_days(sources(spark, sf), documents(spark, sf), statuses(spark, sf), as_of)


#: The gate of 21 observed days out of 21 leaves few test sources, whose checks have gaps: the chart queries ask for 15.
GATES = T.Acceleration(observed=15)


def accel_top5(spark: SparkSession, sf: str) -> DataFrame:
    as_of = last_day(spark, sf)
    return T.accelerating(_days(spark, sf, as_of), T.term_weeks(terms(spark, sf), as_of), GATES)


def accel_full_window(spark: SparkSession, sf: str) -> DataFrame:
    """The chart with the operator's own gate: all 21 days observed."""
    as_of = last_day(spark, sf)
    return T.accelerating(_days(spark, sf, as_of), T.term_weeks(terms(spark, sf), as_of))


def board_state_full(spark: SparkSession, sf: str) -> DataFrame:
    as_of = last_day(spark, sf)
    days = _days(spark, sf, as_of)
    return T.board_states(days, T.accelerating(days, T.term_weeks(terms(spark, sf), as_of)))


def chart_links(spark: SparkSession, sf: str) -> DataFrame:
    """source, term, rank, links: up to three addresses of the last week for every chart entry, those of the newest day first."""
    as_of = last_day(spark, sf)
    linked = T.in_last(linked_terms(spark, sf), as_of, 7)
    return T.evidence(accel_top5(spark, sf).select("source", "term", "rank"), linked, ["source", "term"], [F.datediff(F.lit(as_of), "day"), F.col("pos")], 3)


def theme_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """theme, term, rank, source_ids, links (up to four, in order of day and source) of the week's first twenty per theme."""
    as_of = last_day(spark, sf)
    week = T.in_last(_theme_days(spark, sf), as_of, 7)
    order = [F.desc("score"), F.desc("source_count"), F.desc("mentions"), F.asc("term")]
    top = T.ranked(T.theme_scores(week), ["theme"], order, 20).select("theme", "term", "rank")
    own = week.join(top.select("theme", "term"), ["theme", "term"], "left_semi")
    ids = own.groupBy("theme", "term").agg(F.array_join(F.array_sort(F.collect_set("source")), " ").alias("source_ids"))
    linked = own.select("theme", "source", "day", "term").join(linked_terms(spark, sf).where(F.col("pos") < 3), ["source", "day", "term"])
    return T.evidence(top.join(ids, ["theme", "term"]), linked, ["theme", "term"], [F.col("day"), F.col("source"), F.col("pos")], 4)


def theme_entries(spark: SparkSession, sf: str) -> DataFrame:
    """theme, entries of every theme, also of those without any phrase in the last week."""
    week = T.in_last(_theme_days(spark, sf), last_day(spark, sf), 7).select("theme", "term").distinct()
    counts = week.groupBy("theme").agg(F.least(F.lit(20), F.count("*")).cast("long").alias("entries"))
    every = spark.createDataFrame([(t,) for t in THEME_IDS], "theme string")
    return every.join(counts, "theme", "left").select("theme", F.coalesce("entries", F.lit(0)).cast("long").alias("entries"))


def domain_health(spark: SparkSession, sf: str) -> DataFrame:
    """domain, sources, ok, empty, unavailable: the registered sources of each domain by their status on the last checked day."""
    status = statuses(spark, sf)
    today = status.where(F.col("day") == F.lit(status.agg(F.max("day")).first()[0])).select("source", "status")
    named = sources(spark, sf).select(F.col("id").alias("source"), F.coalesce("domain", F.lit(OTHER_DOMAIN)).alias("domain")).join(today, "source", "left")
    s = F.col("status")
    return named.groupBy("domain").agg(F.count("*").alias("sources"), F.count_if(s == "OK").alias("ok"), F.count_if(s == "EMPTY").alias("empty"), F.count_if(~s.isin("OK", "EMPTY")).alias("unavailable"))


def board_state(spark: SparkSession, sf: str) -> DataFrame:
    as_of = last_day(spark, sf)
    days = _days(spark, sf, as_of)
    return T.board_states(days, T.accelerating(days, T.term_weeks(terms(spark, sf), as_of), GATES), GATES)


def window_rates(spark: SparkSession, sf: str) -> DataFrame:
    as_of = last_day(spark, sf)
    rows = T.term_weeks(terms(spark, sf), as_of).where(F.col("n0") > 0).join(_days(spark, sf, as_of), "source")
    return rows.select("source", "term", *[F.round(T.rate(F.col(f"n{k}"), F.col(f"d{k}")), 3).alias(name) for k, name in ((2, "rate_early"), (1, "rate_middle"), (0, "rate_recent"))])


def observed_days(spark: SparkSession, sf: str) -> DataFrame:
    return _days(spark, sf, last_day(spark, sf)).select("source", "observed_days", "documents_today")


def source_preview(spark: SparkSession, sf: str) -> DataFrame:
    return T.preview(terms(spark, sf), last_day(spark, sf))


def research_queue(spark: SparkSession, sf: str) -> DataFrame:
    """candidate_id, source, rank, acceleration of every chart entry."""
    return accel_top5(spark, sf).select(F.concat_ws(":", "source", "term").alias("candidate_id"), "source", "rank", "acceleration")


def source_docs(spark: SparkSession, sf: str) -> DataFrame:
    counts = O.documents_by(by_source(spark, sf), ["source"])
    return sources(spark, sf).select(F.col("id").alias("source")).join(counts, "source", "left").select("source", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"))


def source_terms(spark: SparkSession, sf: str) -> DataFrame:
    return O.terms_by(by_source(spark, sf), ["source"])


def domain_terms(spark: SparkSession, sf: str) -> DataFrame:
    pairs = O.exploded(by_domain(spark, sf), ["domain", "family"])
    return pairs.groupBy("domain", "term").agg(F.count("*").alias("count"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"))


def domain_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of every domain that a source is registered for, or that occurs; 0 where there are none."""
    counts = O.documents_by(by_domain(spark, sf), ["domain"])
    every = sources(spark, sf).select(F.coalesce("domain", F.lit(OTHER_DOMAIN)).alias("domain")).union(counts.select("domain")).distinct()
    return every.join(counts, "domain", "left").select("domain", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"))


def term_links(spark: SparkSession, sf: str) -> DataFrame:
    pairs = O.exploded(by_source(spark, sf), ["source", "url", "obs_id"])
    return O.first_links(pairs, ["source", "term"], [F.col("obs_id")]).select("source", "term", F.array_join("links", " ").alias("links"))


def domain_rank(spark: SparkSession, sf: str) -> DataFrame:
    dedup = by_domain(spark, sf).withColumn("day", F.to_date("collected_at_utc"))
    docs = O.documents_by(dedup, ["domain", "day"])
    rows = O.exploded(dedup, ["domain", "day", "family"]).groupBy("domain", "day", "term").agg(F.count("*").alias("count"), F.countDistinct("family").alias("breadth"))
    return T.domain_growth(docs, rows, docs.agg(F.max("day")).first()[0])


def theme_classify(spark: SparkSession, sf: str) -> DataFrame:
    """term, domain, theme of every phrase of every domain that mentions it."""
    named = sources(spark, sf).select(F.col("id").alias("source"), F.coalesce("domain", F.lit(OTHER_DOMAIN)).alias("domain"))
    return terms(spark, sf).select("source", "term").join(named, "source").select("term", "domain").distinct().withColumn("theme", T.theme(F.col("term"), F.col("domain")))


def theme_noise(spark: SparkSession, sf: str) -> DataFrame:
    words = O.exploded(by_source(spark, sf), ["source"]).select("term").distinct()
    return words.where(T.is_noise(F.col("term")))


def _theme_days(spark: SparkSession, sf: str) -> DataFrame:
    return T.theme_days(documents(spark, sf), terms(spark, sf), sources(spark, sf))


def theme_daily(spark: SparkSession, sf: str) -> DataFrame:
    return _theme_days(spark, sf).withColumn("rate", F.round("rate", 3))


def theme_scores(spark: SparkSession, sf: str) -> DataFrame:
    return T.theme_scores(T.in_last(_theme_days(spark, sf), last_day(spark, sf), 7))


def complete_window(spark: SparkSession, sf: str) -> DataFrame:
    return T.complete_sources(documents(spark, sf), statuses(spark, sf), last_day(spark, sf))


def common_sources(spark: SparkSession, sf: str) -> DataFrame:
    as_of = last_day(spark, sf)
    docs, status = documents(spark, sf), statuses(spark, sf)
    return T.complete_sources(docs, status, as_of).intersect(T.complete_sources(docs, status, as_of, 1))


def theme_billboard(spark: SparkSession, sf: str) -> DataFrame:
    return T.theme_charts(_theme_days(spark, sf), common_sources(spark, sf), last_day(spark, sf))


def chart_movement(spark: SparkSession, sf: str) -> DataFrame:
    """theme, term, rank, previous_rank, movement, status over all sources, whether complete or not."""
    every = sources(spark, sf).select(F.col("id").alias("source"))
    return T.theme_charts(_theme_days(spark, sf), every, last_day(spark, sf)).select("theme", "term", "rank", "previous_rank", "movement", "status")


def run_status(spark: SparkSession, sf: str) -> DataFrame:
    """day, observations of health, healthy sources, unavailable ones, and whether the day was partial."""
    s = F.col("status")
    return statuses(spark, sf).groupBy("day").agg(F.count("*").alias("checked"), F.count_if(s == "OK").alias("ok"), F.count_if(~F.coalesce(s.isin("OK", "EMPTY"), F.lit(False))).alias("unavailable"), F.bool_or(F.coalesce(s != "OK", F.lit(True))).alias("partial"))


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """One line over everything: observations, sources with documents, non-empty domains, unavailable sources of the last
    checked day, source charts with entries."""
    d, status = by_domain(spark, sf), statuses(spark, sf)
    last = status.groupBy("day").agg(F.count_if(~F.coalesce(F.col("status").isin("OK", "EMPTY"), F.lit(False))).alias("n")).agg(F.max_by("n", "day").alias("unavailable_sources"))
    counts = d.agg(F.count("*").alias("observations"), F.countDistinct("source").alias("sources"), F.countDistinct("domain").alias("domains"))
    boards = accel_top5(spark, sf).agg(F.countDistinct("source").alias("boards"))
    one = F.lit(1).alias("one")  # three tables of one row each
    return counts.select("*", one).join(last.select("*", one), "one").join(boards.select("*", one), "one").drop("one")


def history_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Daily documents with the last day's figures doubled by a later correction."""
    daily = documents(spark, sf)
    today = daily.where(F.col("day") == F.lit(last_day(spark, sf))).withColumn("documents", F.col("documents") * 2)
    return O.overlaid(daily, today)


def obs_union(spark: SparkSession, sf: str) -> DataFrame:
    """Collectors' outputs concatenated by name: observations per family from separately read parts."""
    o = obs(spark, sf).select("obs_id", "family", "title")
    dated = o.where(F.col("title").isNotNull()).unionByName(o.where(F.col("title").isNull()))
    return dated.groupBy("family").agg(F.count("*").alias("observations"), F.count("title").alias("titles"))


def obs_tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Observations with the attributes of their registered source, counted by kind and domain."""
    named = sources(spark, sf).select(F.col("id").alias("source"), F.col("domain").alias("source_domain"), "kind")
    return obs(spark, sf).select("source").join(named, "source").groupBy("kind", "source_domain").agg(F.count("*").alias("observations"))


def published_text(spark: SparkSession, sf: str) -> DataFrame:
    """Publication times written as RFC 2822 (even ids) or ISO 8601 and read again."""
    o = obs(spark, sf).where(F.col("published").isNotNull())
    text = F.when(F.col("obs_id") % 2 == 0, F.date_format("published", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise(F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return o.select("obs_id", F.unix_timestamp(P.published(text)).alias("published_s"))


def closes(spark: SparkSession, sf: str) -> DataFrame:
    return M.daily_closes(table(spark, sf, "market"))


def quote_age(spark: SparkSession, sf: str) -> DataFrame:
    rows = closes(spark, sf)
    return M.ages(rows.groupBy("symbol").agg(F.max("day").alias("day")), rows.agg(F.max("day")).first()[0])


def market_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return quote_age(spark, sf).agg(F.count_if(F.col("status") == "CURRENT_DAILY").alias("current"), F.count("*").alias("symbols"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def daily_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return S.daily_counts(_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")))


def stream_daily(spark: SparkSession, sf: str) -> DataFrame:
    """The same counts, from the file stream with deduplication state, through the daily table."""
    stream = S.arriving(spark, sf, _events(spark, sf).schema, "events.parquet")
    path = new_path(spark, "stream_daily")
    S.to_history(S.daily_counts(S.deduplicated(stream)), path, new_path(spark, "stream"))
    return S.read_history(spark, path)


QUERIES: dict[str, Query] = {
    "recency_filter": lambda s, d: O.recent(obs(s, d)).select("obs_id"),
    "strip_publisher": lambda s, d: O.publisher_stripped(obs(s, d)).select("obs_id", "title"),
    "unescape_titles": lambda s, d: obs(s, d).where(F.col("title").isNotNull()).select("obs_id", P.unescaped(F.col("title")).alias("title")),
    "url_parts": lambda s, d: obs(s, d).where(F.col("url").isNotNull()).select("obs_id", P.scheme(F.col("url")).alias("scheme"), P.host(F.col("url")).alias("host")),
    "url_quote": lambda s, d: terms(s, d).select("term").distinct().select("term", P.quoted(F.col("term")).alias("path")),
    "published_text": published_text,
    "dedup_source": lambda s, d: by_source(s, d).select("source", "url", "title"),
    "dedup_domain": lambda s, d: by_domain(s, d).select("source", "url", "title"),
    "item_limit": lambda s, d: O.limited(obs(s, d).select("source", "obs_id"), 30),
    "title_phrases": lambda s, d: O.exploded(obs(s, d), ["obs_id"]),
    "obs_tagged": obs_tagged,
    "obs_union": obs_union,
    "source_docs": source_docs,
    "source_terms": source_terms,
    "domain_docs": domain_docs,
    "domain_terms": domain_terms,
    "term_links": term_links,
    "history_overlay": history_overlay,
    "last_snapshots": lambda s, d: O.last_days(documents(s, d), 90).groupBy("day").agg(F.sum("documents").alias("documents")),
    "observed_days": observed_days,
    "window_rates": window_rates,
    "accel_top5": accel_top5,
    "board_state": board_state,
    "source_preview": source_preview,
    "research_queue": research_queue,
    "domain_rank": domain_rank,
    "theme_classify": theme_classify,
    "theme_noise": theme_noise,
    "theme_daily": theme_daily,
    "theme_scores": theme_scores,
    "complete_window": complete_window,
    "common_sources": common_sources,
    "theme_billboard": theme_billboard,
    "chart_movement": chart_movement,
    "run_status": run_status,
    "run_summary": run_summary,
    "price_clean": closes,
    "market_sma": lambda s, d: M.averages(closes(s, d)),
    "market_return": lambda s, d: M.returns(closes(s, d)),
    "market_volatility": lambda s, d: M.volatility(closes(s, d)),
    "market_drawdown": lambda s, d: M.drawdown(closes(s, d)),
    "market_indicators": lambda s, d: M.indicators(closes(s, d)),
    "market_tail": lambda s, d: M.tail(closes(s, d)),
    "quote_age": quote_age,
    "market_coverage": market_coverage,
    "daily_tumbling": daily_tumbling,
    "stream_daily": stream_daily,
    "title_grams": lambda s, d: O.exploded(obs(s, d), ["obs_id"], lambda title: P.phrases(title, (1, 2, 3, 4))),
    "accel_full_window": accel_full_window,
    "board_state_full": board_state_full,
    "chart_links": chart_links,
    "theme_evidence": theme_evidence,
    "theme_entries": theme_entries,
    "domain_health": domain_health,
    **connectors.QUERIES,
}
