"""The charts: growth within domains, acceleration within sources, weekly movement within themes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.operators.observations import first_links
from tidewater.config import DOMAIN_THEMES, NOISE_PATTERN, NOISE_PHRASES, OTHER_THEME, THEME_PATTERNS, Acceleration, Growth, Themes

EDGE_BEFORE, EDGE_AFTER = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"


def rate(n: Column, documents: Column) -> Column:
    """Mentions per ten thousand documents; NULL without documents."""
    return n * F.lit(10000.0) / F.nullif(documents, F.lit(0))


def ranked(df: DataFrame, by: list[str], order: list[Column], top: int) -> DataFrame:
    """Adds ``rank`` and keeps the first ``top`` of each group."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)


# --- sources -----------------------------------------------------------------------------------------------------------


def weeks(day: Column, as_of: date) -> Column:
    """0 for the seven days that end with ``as_of``, 1 for those before, and so on."""
    return F.floor(F.datediff(F.lit(as_of), day) / 7).cast("int")


def in_last(df: DataFrame, as_of: date, days: int) -> DataFrame:
    """Rows of the last ``days`` days, as literal bounds that reach the scan of a table partitioned by day."""
    return df.where((F.col("day") <= F.lit(as_of)) & (F.col("day") > F.date_sub(F.lit(as_of), days)))


def source_days(sources: DataFrame, documents: DataFrame, status: DataFrame, as_of: date, gates: Acceleration = Acceleration()) -> DataFrame:
    """source, observed_days, documents_today, d0, d1, d2 for every registered source.

    documents: source, day, documents; status: source, day, status; one row per source and day each. A day counts as
    observed with the status OK or EMPTY, or without any status but with documents.
    """
    joined = in_last(documents, as_of, gates.days).join(in_last(status, as_of, gates.days), ["source", "day"], "full")
    docs = F.coalesce("documents", F.lit(0))
    seen = F.when(F.col("status").isNotNull(), F.col("status").isin("OK", "EMPTY")).otherwise(docs > 0)
    week = weeks(F.col("day"), as_of)
    sums = [F.sum(F.when(week == k, docs).otherwise(0)).alias(f"d{k}") for k in range(3)]
    per = joined.groupBy("source").agg(F.count_if(seen).alias("observed_days"), F.sum(F.when(F.col("day") == F.lit(as_of), docs).otherwise(0)).alias("documents_today"), *sums)
    cols = ["observed_days", "documents_today", "d0", "d1", "d2"]
    return sources.select(F.col("id").alias("source")).join(per, "source", "left").select("source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in cols])


def term_weeks(terms: DataFrame, as_of: date) -> DataFrame:
    """source, term, n0, n1, n2, active: mentions by week and the days with mentions in the last week, in one scan."""
    week, n = weeks(F.col("day"), as_of), F.coalesce("count", F.lit(0))
    recent = in_last(terms, as_of, 21)
    return recent.groupBy("source", "term").agg(*[F.sum(F.when(week == k, n).otherwise(0)).cast("long").alias(f"n{k}") for k in range(3)], F.count_if((week == 0) & (n > 0)).alias("active"))


def accelerating(days: DataFrame, term_counts: DataFrame, gates: Acceleration = Acceleration()) -> DataFrame:
    """The phrases of each eligible source whose rate grows, and grows faster: ranked on rounded acceleration."""
    able = days.where((F.col("documents_today") > 0) & (F.col("observed_days") >= gates.observed) & (F.col("d0") >= gates.documents) & (F.col("d1") > 0) & (F.col("d2") > 0))
    strong = term_counts.where((F.col("n0") >= gates.mentions) & (F.col("active") >= gates.active_days))
    both = strong.join(able, "source")
    r0, r1, r2 = (rate(F.col(f"n{k}"), F.col(f"d{k}")) for k in range(3))
    both = both.select("source", "term", r0.alias("r0"), r1.alias("r1"), r2.alias("r2"), "n0", "active")
    both = both.withColumn("v", F.col("r0") - F.col("r1")).withColumn("a", F.col("r0") - 2 * F.col("r1") + F.col("r2")).where((F.col("v") > 0) & (F.col("a") > 0))
    rows = both.select("source", "term", F.round("a", 3).alias("acceleration"), F.round("v", 3).alias("velocity"), F.round("r2", 3).alias("rate_early"), F.round("r1", 3).alias("rate_middle"), F.round("r0", 3).alias("rate_recent"), F.col("n0").alias("mentions_7d"), F.col("active").alias("active_days_7d"))
    return ranked(rows, ["source"], [F.desc("acceleration"), F.desc("mentions_7d"), F.asc("term")], gates.top)


def board_states(days: DataFrame, charts: DataFrame, gates: Acceleration = Acceleration()) -> DataFrame:
    """source, state, observed_days, documents_today: the first reason that keeps a source from a chart, else whether it has one."""
    has = charts.select("source").distinct().withColumn("has", F.lit(True))
    state = (
        F.when(F.col("documents_today") == 0, "NO_DATA")
        .when(F.col("observed_days") < gates.observed, "INSUFFICIENT_HISTORY")
        .when(F.col("d0") < gates.documents, "INSUFFICIENT_VOLUME")
        .when(F.col("has"), "RANKED_EXPLORATORY")
        .otherwise("NO_POSITIVE_ACCELERATION")
    )
    return days.join(has, "source", "left").select("source", state.alias("state"), "observed_days", "documents_today")


def preview(terms: DataFrame, as_of: date, count: int = 2, top: int = 5) -> DataFrame:
    """source, term, mentions_today, rank of the day's phrases."""
    today = terms.where((F.col("day") == F.lit(as_of)) & (F.col("count") >= count)).select("source", "term", F.col("count").cast("long").alias("mentions_today"))
    return ranked(today, ["source"], [F.desc("mentions_today"), F.asc("term")], top)


def evidence(chart: DataFrame, linked: DataFrame, keys: list[str], order: list[Column], links: int) -> DataFrame:
    """``chart`` with ``links``: the first ``links`` distinct addresses of each entry in the given order, joined by spaces.

    linked: the keys, what ``order`` needs, and ``url``, one row per address. Only the chart's own entries are looked at."""
    own = linked.join(chart.select(*keys).distinct(), keys, "left_semi")
    found = first_links(own, keys, order, links).withColumn("links", F.array_join("links", " "))
    return chart.join(found, keys, "left").withColumn("links", F.coalesce("links", F.lit("")))


# --- domains -----------------------------------------------------------------------------------------------------------


def domain_growth(documents: DataFrame, terms: DataFrame, as_of: date, gates: Growth = Growth()) -> DataFrame:
    """domain, term, score, mentions, rate, growth, quality, rank of the day ``as_of`` against earlier days.

    documents: domain, day, documents; terms: domain, day, term, count, breadth. History are the last ``history`` days with
    documents in the domain of the last ``snapshots`` days that occur; a phrase without a row on such a day counts 0, which
    needs no row: the mean is the sum of the rates there are over the number of days.
    """
    prior = documents.where((F.col("day") < F.lit(as_of)) & (F.col("documents") > 0))
    all_days = documents.where(F.col("day") < F.lit(as_of)).select("day").distinct().orderBy(F.desc("day")).limit(gates.snapshots)
    prior = prior.join(F.broadcast(all_days), "day", "left_semi")
    newest = W.partitionBy("domain").orderBy(F.desc("day"))
    prior = prior.withColumn("n__", F.row_number().over(newest)).withColumn("available", F.count("*").over(W.partitionBy("domain")))
    framed = prior.where(F.col("n__") <= gates.history).select("domain", "day", F.col("documents").alias("then"), "available")
    spans = framed.groupBy("domain").agg(F.count("*").alias("days"), F.max("available").alias("available"))
    now = terms.where((F.col("day") == F.lit(as_of)) & (F.col("count") >= gates.count)).select("domain", "term", F.col("count").alias("mentions"), "breadth")
    past = terms.where(F.col("day") < F.lit(as_of)).select("domain", "day", "term", "count").join(now.select("domain", "term"), ["domain", "term"], "left_semi")
    base = past.join(framed, ["domain", "day"]).groupBy("domain", "term").agg(F.sum(F.col("count") * 10000.0 / F.col("then")).alias("rates"))
    today = documents.where(F.col("day") == F.lit(as_of)).select("domain", F.col("documents").alias("docs"))
    rows = now.join(today, "domain").join(spans, "domain", "left").join(base, ["domain", "term"], "left")
    r = F.col("mentions") * 10000.0 / F.greatest(F.lit(1), F.col("docs"))
    baseline = F.when(F.col("days") > 0, F.coalesce("rates", F.lit(0.0)) / F.col("days"))
    rows = rows.withColumn("r", r).withColumn("b", baseline).withColumn("g", F.when(F.col("b").isNotNull(), (F.col("r") - F.col("b")) / F.greatest(F.lit(1.0), F.col("b"))))
    damped = F.when(F.col("g").isNotNull(), F.least(F.lit(5.0), F.greatest(F.lit(-2.0), F.col("g")))).otherwise(0.0)
    measurable = (F.col("available") >= gates.measurable) & (F.col("docs") > 0) & (F.col("breadth") >= 2) & (F.col("mentions") >= 3)
    rows = rows.select("domain", "term", F.round(F.log1p("r") + damped + 0.25 * F.col("breadth"), 3).alias("score"), "mentions", F.round("r", 2).alias("rate"), F.round("g", 3).alias("growth"), F.when(F.coalesce(measurable, F.lit(False)), "MEASURABLE").otherwise("EXPLORATORY").alias("quality"))
    return ranked(rows, ["domain"], [F.desc("score"), F.desc("mentions"), F.asc("term")], gates.top)


# --- themes ------------------------------------------------------------------------------------------------------------


def bounded(pattern: str) -> str:
    """A pattern between word edges of any script, in a form that different regular expression engines read alike."""
    return f"{EDGE_BEFORE}(?:{pattern}){EDGE_AFTER}"


def theme(term: Column, domain: Column) -> Column:
    """The theme of a phrase: the first pattern that holds, else that of the source's domain."""
    folded = F.lower(F.trim(term))
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in THEME_PATTERNS:
        chain = chain.when(folded.rlike(bounded(pattern)), name)
    by_domain = F.lit(OTHER_THEME)
    for name, value in DOMAIN_THEMES.items():
        by_domain = F.when(domain == name, value).otherwise(by_domain)
    return chain.otherwise(by_domain)


def is_noise(term: Column) -> Column:
    """Whether a phrase comes from templated titles."""
    folded = F.lower(term)
    return folded.isin(*NOISE_PHRASES) | folded.rlike(bounded(NOISE_PATTERN))


def theme_days(documents: DataFrame, terms: DataFrame, sources: DataFrame, gates: Themes = Themes()) -> DataFrame:
    """theme, source, day, term, count, rate of the phrases of days with enough documents."""
    solid = documents.where(F.col("documents") >= gates.documents).select("source", "day", "documents")
    kept = terms.where((F.col("count") >= gates.count) & ~is_noise(F.col("term"))).select("source", "day", "term", "count")
    named = sources.select(F.col("id").alias("source"), F.coalesce("domain", F.lit("news")).alias("domain"))
    rows = kept.join(solid, ["source", "day"]).join(named, "source", "left").withColumn("domain", F.coalesce("domain", F.lit("news")))
    return rows.select(theme(F.col("term"), F.col("domain")).alias("theme"), "source", "day", "term", F.col("count").cast("long").alias("count"), (F.col("count") * 10000.0 / (F.col("documents") + gates.smoothing)).alias("rate"))


def theme_scores(daily: DataFrame, by: list[str] | None = None) -> DataFrame:
    """theme, term, score, mentions, source_count: the mean over sources of the means of their observed days."""
    by = by or []
    per = daily.groupBy(*by, "theme", "term", "source").agg(F.avg("rate").alias("mean"), F.sum("count").alias("n"))
    return per.groupBy(*by, "theme", "term").agg(F.round(F.avg("mean"), 3).alias("score"), F.sum("n").alias("mentions"), F.count("*").alias("source_count"))


def complete_sources(documents: DataFrame, status: DataFrame, as_of: date, week: int = 0) -> DataFrame:
    """source: sources with a healthy status and a sample on each day of a week."""
    low, high = F.date_sub(F.lit(as_of), 7 * week + 6), F.date_sub(F.lit(as_of), 7 * week)
    healthy = status.where(F.col("status").isin("OK", "EMPTY")).select("source", "day")
    both = documents.select("source", "day").join(healthy, ["source", "day"], "left_semi").where(F.col("day").between(low, high))
    return both.groupBy("source").agg(F.countDistinct("day").alias("n")).where(F.col("n") == 7).select("source")


def theme_charts(daily: DataFrame, common: DataFrame, as_of: date, gates: Themes = Themes()) -> DataFrame:
    """theme, term, score, mentions, source_count, rank, previous_rank, movement, status of the week against the one
    before, both over the sources complete in both. Without such a source: the day alone, movement unavailable.

    Phrases are classified once for both weeks, and ranked in one pass over (week, theme)."""
    last = in_last(daily, as_of, 14).withColumn("week", weeks(F.col("day"), as_of))
    order = [F.desc("score"), F.desc("source_count"), F.desc("mentions"), F.asc("term")]
    if common.isEmpty():
        today = ranked(theme_scores(last.where(F.col("day") == F.lit(as_of))), ["theme"], order, gates.top)
        return today.withColumns({"previous_rank": F.lit(None).cast("int"), "movement": F.lit(None).cast("int"), "status": F.lit("UNAVAILABLE")})
    both = ranked(theme_scores(last.join(common, "source", "left_semi"), ["week"]), ["week", "theme"], order, gates.top)
    prior = both.where(F.col("week") == 1).select("theme", "term", F.col("rank").alias("previous_rank"))
    moved = both.where(F.col("week") == 0).drop("week").join(prior, ["theme", "term"], "left").withColumn("movement", F.col("previous_rank") - F.col("rank"))
    return moved.withColumn("status", F.when(F.col("movement").isNull(), "NEW").when(F.col("movement") > 0, "UP").when(F.col("movement") < 0, "DOWN").otherwise("SAME"))
