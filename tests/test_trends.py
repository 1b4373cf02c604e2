"""Scenarios of the charts, phrase extraction, feeds, stores and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewater.functions import phrases as P
from tidewater.functions.days import parse_day, weekday_number
from tidewater.operators import market as M
from tidewater.operators import observations as O
from tidewater.operators import trends as T
from tidewater.sources import feeds, store
from tidewater.streaming import events as S

AS_OF = dt.date(2025, 3, 21)


def ago(n):
    return AS_OF - dt.timedelta(days=n)


def frames(spark, docs, term_rows, status=None):
    documents = spark.createDataFrame(docs, "source string, day date, documents long")
    terms = spark.createDataFrame(term_rows, "source string, day date, term string, count long")
    status = spark.createDataFrame(status if status is not None else [(s, d, "OK") for s, d, _ in docs], "source string, day date, status string")
    sources = spark.createDataFrame([("s", "news"), ("quiet", None)], "id string, domain string")
    return sources, documents, terms, status


def weekly(per_day, days=21):
    """21 days of 100 documents with the given mentions per day of each week, oldest week first."""
    docs = [("s", ago(i), 100) for i in range(days)]
    terms = [("s", ago(i), "solar kelp", per_day[2 - i // 7]) for i in range(days) if per_day[2 - i // 7]]
    return docs, terms


def chart(spark, docs, terms, status=None):
    sources, documents, term_rows, status = frames(spark, docs, terms, status)
    days = T.source_days(sources, documents, status, AS_OF)
    rows = T.accelerating(days, T.term_weeks(term_rows, AS_OF))
    return {r.source: r for r in T.board_states(days, rows).collect()}, rows.collect()


def test_acceleration_is_ranked_and_measured(spark):
    states, rows = chart(spark, *weekly([1, 2, 8]))
    assert states["s"].state == "RANKED_EXPLORATORY" and states["quiet"].state == "NO_DATA"
    (row,) = rows
    assert (row.rate_early, row.rate_middle, row.rate_recent) == (100.0, 200.0, 800.0)
    assert (row.velocity, row.acceleration, row.mentions_7d, row.active_days_7d, row.rank) == (600.0, 500.0, 56, 7, 1)


def test_linear_growth_has_exactly_no_acceleration(spark):
    states, rows = chart(spark, *weekly([1, 6, 11]))
    assert states["s"].state == "NO_POSITIVE_ACCELERATION" and not rows


@pytest.mark.parametrize("gone, state", [("day", "INSUFFICIENT_HISTORY"), ("today", "NO_DATA"), ("failed", "INSUFFICIENT_HISTORY"), ("unknown", "RANKED_EXPLORATORY")])
def test_observation_rules(spark, gone, state):
    docs, terms = weekly([1, 2, 8])
    status = [("s", d, "OK") for _, d, _ in docs]
    if gone == "day":
        docs, status = docs[:5] + docs[6:], status[:5] + status[6:]
    if gone == "today":
        docs[0] = ("s", AS_OF, 0)
    if gone == "failed":
        status[5] = ("s", ago(5), "RATE_LIMITED")  # has documents, and still isn't observed
    if gone == "unknown":
        del status[5]  # no check, but documents
    assert chart(spark, docs, terms, status)[0]["s"].state == state


def test_one_day_spike_and_thin_weeks_are_not_ranked(spark):
    docs, _ = weekly([0, 0, 0])
    assert not chart(spark, docs, [("s", AS_OF, "one day", 20)])[1]
    thin = [("s", ago(i), 4) for i in range(21)]
    assert chart(spark, thin, [])[0]["s"].state == "INSUFFICIENT_VOLUME"


def test_phrases_follow_the_surviving_tokens(spark):
    titles = ["The quantum chips for data centers", "chips in data", "Élan café – Übergröße x2025 model", "x" * 50, "", None, "one"]
    df = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    got = {r.id: set(r.p) for r in df.select("id", P.phrases(F.col("title")).alias("p")).collect()}
    assert got[0] == {"quantum chips", "data centers"}
    assert got[1] == {"chips data"}
    assert got[2] == {"élan café", "café übergröße", "élan café übergröße"}
    assert got[3] == {"x" * 40 + " " + "x" * 10}
    assert got[4] == got[5] == got[6] == set()


def test_domain_growth_needs_history_only_for_growth(spark):
    docs = [("geek", ago(0), 10)] + [("geek", ago(i), 10) for i in range(1, 15)] + [("new", ago(0), 10)]
    terms = [("geek", ago(0), "anime fair", 5, 2)] + [("geek", ago(i), "anime fair", 1, 1) for i in range(1, 15)] + [("new", ago(0), "anime fair", 5, 2), ("new", ago(0), "rare pair", 1, 1)]
    rows = {r.domain: r for r in T.domain_growth(spark.createDataFrame(docs, "domain string, day date, documents long"), spark.createDataFrame(terms, "domain string, day date, term string, count long, breadth long"), AS_OF).collect()}
    assert rows["geek"].quality == "MEASURABLE" and rows["geek"].growth == 4.0 and rows["geek"].rate == 5000.0
    assert rows["new"].quality == "EXPLORATORY" and rows["new"].growth is None and rows["new"].score == pytest.approx(9.017, abs=1e-3)


def test_themes_by_pattern_domain_and_noise(spark):
    rows = [("anime cosplay", "news"), ("quantum computing", "news"), ("kelp audit", "health"), ("kelp audit", "nowhere"), ("ÉLECTION locale", "news"), ("preelections", "science")]
    df = spark.createDataFrame(rows, "term string, domain string")
    got = [r.t for r in df.select(T.theme(F.col("term"), F.col("domain")).alias("t")).collect()]
    assert got == ["geek", "technology", "health", "pop_culture", "geopolitics", "science"]
    noisy = spark.createDataFrame([("final notice",), ("noticed kelp",), ("study finds",)], "term string").select(T.is_noise(F.col("term")).alias("n"))
    assert [r.n for r in noisy.collect()] == [True, False, True]


def test_theme_movement_and_preview(spark):
    docs = [("s", ago(i), 100) for i in range(14)]
    terms = [("s", ago(i), t, n) for i in range(14) for t, n in (("anime fair", 9 if i < 7 else 3), ("manga week", 3 if i < 7 else 9))] + [("s", AS_OF, "cosplay night", 2), ("s", AS_OF, "comics once", 1)]
    sources, documents, term_rows, status = frames(spark, docs, terms)
    daily = T.theme_days(documents, term_rows, sources)
    common = T.complete_sources(documents, status, AS_OF).intersect(T.complete_sources(documents, status, AS_OF, 1))
    got = {r.term: (r.rank, r.previous_rank, r.movement, r.status) for r in T.theme_charts(daily, common, AS_OF).collect()}
    assert got["anime fair"] == (1, 2, 1, "UP") and got["manga week"] == (2, 1, -1, "DOWN") and got["cosplay night"][3] == "NEW" and "comics once" not in got
    alone = T.theme_charts(daily, common.limit(0), AS_OF).collect()
    assert {r.status for r in alone} == {"UNAVAILABLE"} and {r.movement for r in alone} == {None}


def test_tiny_denominators_and_smoothing(spark):
    sources, documents, terms, _ = frames(spark, [("s", AS_OF, 10), ("s", ago(1), 1)], [("s", AS_OF, "kelp fair", 2), ("s", AS_OF, "kelp once", 1), ("s", ago(1), "kelp fair", 9)])
    (row,) = T.theme_days(documents, terms, sources).collect()
    assert round(row.rate, 3) == 222.222


def test_market_indicators_by_hand(spark):
    closes = [float(100 + i) for i in range(80)]
    df = spark.createDataFrame([("UP", ago(80 - i), c) for i, c in enumerate(closes)] + [("NEW", AS_OF, 5.0)], "symbol string, day date, close double")
    got = {r.symbol: r for r in M.indicators(df).collect()}
    assert got["UP"].sma20 == 169.5 and got["UP"].sma50 == 154.5 and got["UP"].return_20d_pct == round((179 / 159 - 1) * 100, 3)
    assert got["UP"].max_drawdown_90d_pct == 0.0 and got["UP"].volatility_20d_annualized_pct > 0
    assert got["NEW"].sma20 is None and got["NEW"].return_20d_pct is None and got["NEW"].volatility_20d_annualized_pct is None


def test_first_wins_and_limits(spark):
    rows = [(3, "s", "https://a.example", "later"), (1, "s", "https://a.example", "first"), (2, "t", "https://a.example", "other"), (4, "s", "HTTPS://b.example", "upper"), (5, "s", None, "none"), (6, "s", "ftp://c.example", "ftp")]
    df = spark.createDataFrame(rows, "obs_id long, source string, url string, title string")
    assert {r.title for r in O.first_wins(df, ["title"], O.web_scheme(F.col("url"))).collect()} == {"first", "other", "upper"}
    assert {r.title for r in O.first_wins(df, ["title"], O.web_address(F.col("url"))).collect()} == {"first", "other"}
    assert {r.obs_id for r in O.limited(df, 1).collect()} == {1, 2}


def test_days_in_all_notations(spark):
    texts = ["2025-01-06", " 2025-01-06\t", "2025-01-06 ", "2025/01/06", "20250106", "2025-01-06T00:00:00Z", "6 Jan 2025", "06 Jan 2025", "", None, "2025-13-40", "soon"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_day(F.col("t")).alias("d"))
    assert [r.d for r in df.collect()] == [dt.date(2025, 1, 6)] * 8 + [None] * 4
    days = spark.createDataFrame([(dt.date(2025, 1, 3),), (dt.date(2025, 1, 4),), (dt.date(2025, 1, 6),)], "d date").select(weekday_number(F.col("d")).alias("n"))
    fri, sat, mon = (r.n for r in days.collect())
    assert sat is None and mon == fri + 1


def test_feeds_of_every_kind(spark):
    news = spark.createDataFrame([("[3, 1, 2, 9]",)], "payload string")
    items = spark.createDataFrame([(json.dumps(x),) for x in ({"id": 1, "title": "One", "url": "https://x.example", "time": 1736157600}, {"id": 2, "title": "Dead", "dead": True}, {"id": 3, "title": "Three"}, {"id": 9, "title": "Beyond"})] + [("broken",)], "payload string")
    rows = feeds.ranked_ids(news, items, max_items=3).orderBy("pos").collect()
    assert [(r.title, r.url) for r in rows] == [("Three", "https://news.example/item?id=3"), ("One", "https://x.example")]
    viewed = spark.createDataFrame([(json.dumps({"items": [{"articles": [{"article": "Main_Page"}, {"article": "A_b/c é"}, {"article": "Cut"}]}]}),)], "payload string")
    assert [(r.title, r.url) for r in feeds.most_viewed(viewed, "https://w.example/", max_items=2).collect()] == [("A b/c é", "https://w.example/A_b/c%20%C3%A9")]
    register = spark.createDataFrame([(json.dumps({"results": [{"title": "T", "html_url": "https://r.example", "publication_date": "2025-01-06"}, {"title": "", "html_url": "https://q.example"}]}),)], "payload string")
    assert [r.title for r in feeds.register_documents(register).collect()] == ["T"]
    prices = spark.createDataFrame([("S", json.dumps({"chart": {"result": [{"timestamp": [1736157600, 1736161200, 1736244000], "indicators": {"quote": [{"close": [1.5, 2.123456, None]}]}}]}}))], "symbol string, payload string")
    assert [(str(r.day), r.close) for r in feeds.price_points(prices).collect()] == [("2025-01-06", 2.1235)]


def test_history_is_idempotent_and_bounded(spark, tmp_path):
    path = f"file://{tmp_path}/daily"
    rows = spark.createDataFrame([(ago(i), "s", i) for i in range(5)], "day date, source string, documents long")
    store.write_days(rows, path)
    store.write_days(rows.where(F.col("day") == F.lit(AS_OF)).withColumn("documents", F.lit(99).cast("long")), path)
    got = {r.day: r.documents for r in store.read_days(spark, path).collect()}
    assert got == {AS_OF: 99} | {ago(i): i for i in range(1, 5)}
    assert {r.day for r in store.read_days(spark, path, before=AS_OF, days=2).collect()} == {ago(1), ago(2)}
    with pytest.raises(ValueError):
        store.write_days(rows.limit(0), path)


def test_nested_snapshots_flatten_and_publish(spark, tmp_path):
    good = {"date": "2025-01-06", "schema_version": 2, "sources": {"a": {"documents": 3, "terms": {"kelp fair": {"count": 2, "links": ["https://x.example"]}}}}, "source_health": [{"source": "a", "status": "OK"}, {"source": "a", "status": "EMPTY"}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/2025-01-06.json").write_text(json.dumps(good))
    (tmp_path / "in/2025-01-07.json").write_text("{broken")
    snapshots = store.read_snapshots(spark, f"file://{tmp_path}/in")
    assert [r.documents for r in store.flat_documents(snapshots).collect()] == [3]
    assert [(r.term, r["count"]) for r in store.flat_terms(snapshots).collect()] == [("kelp fair", 2)]
    assert [r.status for r in store.flat_status(snapshots).collect()] == ["EMPTY"]
    out = f"file://{tmp_path}/latest"
    for n in (1, 2, 3, 4):
        store.publish_json(spark, spark.range(n), out)
        # readers go by the pointer, which names a whole version at any time; the one before it stays for those still reading
        assert spark.read.json(store.published_path(spark, out)).count() == n
    assert len([f for f in (tmp_path / "latest").iterdir() if f.is_dir()]) == 2


def test_stream_into_history_is_repeatable(spark, tmp_path, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = S.daily_counts(S.deduplicated(S.arriving(spark, sf, schema, "events.parquet")))
    for k in range(2):
        S.to_history(stream, f"file://{tmp_path}/daily", f"file://{tmp_path}/check{k}")
    rows = spark.read.parquet(f"file://{tmp_path}/daily")
    assert rows.agg(F.sum("count")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_stream_rewrites_only_the_days_it_touches(spark, tmp_path):
    path, source = f"file://{tmp_path}/daily", tmp_path / "in"
    schema = spark.createDataFrame([], "event_id long, ts timestamp, event_type string").schema

    def arrive(k, rows):
        spark.createDataFrame([(i, dt.datetime(2025, 1, d, 9), t) for i, d, t in rows], schema).write.parquet(f"file://{source}/part{k}")
        stream = S.arriving(spark, f"file://{source}/*", schema)
        S.to_history(S.daily_counts(S.deduplicated(stream)), path, f"file://{tmp_path}/check")
        return {(r.day.day, r.term): r["count"] for r in S.read_history(spark, path).collect()}

    assert arrive(1, [(1, 6, "a"), (2, 6, None), (3, 7, "a")]) == {(6, "a"): 1, (6, None): 1, (7, "a"): 1}
    before = sorted(f.name for f in (tmp_path / "daily/day=2025-01-06").glob("*.parquet"))
    assert arrive(2, [(4, 7, "a"), (5, 7, "b"), (3, 7, "a")]) == {(6, "a"): 1, (6, None): 1, (7, "a"): 2, (7, "b"): 1}
    assert before == sorted(f.name for f in (tmp_path / "daily/day=2025-01-06").glob("*.parquet"))


def test_entities_digits_and_other_extractors(spark):
    texts = ["caf&eacute; &amp;eacute; d&#8217;or&rsquo; &unknown; &lt;b&gt;", "no entity", None, ""]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.unescaped(F.col("t")).alias("t")).collect()]
    assert got == ["café &eacute; d’or’ &unknown; <b>", "no entity", None, ""]
    df = spark.createDataFrame([(1, "tidal kelp² survey fair", "x")], "obs_id int, title string, term string")
    assert {r.term for r in O.exploded(df, ["obs_id"]).collect()} == {"survey fair"}
    assert [r.term for r in O.exploded(df, ["obs_id"], lambda t: F.split(t, " ")).collect()] == ["tidal", "kelp²", "survey", "fair"]


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[:3] == ["source", "term", "acceleration"]
