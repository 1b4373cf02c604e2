"""SQL twins of the core queries, for DuckDB over the same tables."""

from __future__ import annotations

from tidewater.config import THEME_IDS, DOMAIN_THEMES, NOISE_PATTERN, NOISE_PHRASES, OTHER_THEME, STOP_WORDS, THEME_PATTERNS
from tidewater.functions.phrases import DIGIT
from tidewater.operators.trends import bounded
from tidewater.plans import connectors

WHITE = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TERM = rf"trim(regexp_replace(lower(nfc_normalize(term)), '{WHITE}+', ' ', 'g'))"
BARE = rf"regexp_replace(date, '^{WHITE}+|{WHITE}+$', '', 'g')"
DAY = "coalesce(" + ", ".join(f"try_strptime({BARE}, '{f}')" for f in ("%Y-%m-%d", "%Y/%m/%d", "%Y%m%d", "%Y-%m-%dT%H:%M:%SZ", "%d %b %Y")) + ")::DATE"


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


SNAP = f"""snap_raw AS (SELECT source, {DAY} AS day, CASE WHEN isfinite(documents::DOUBLE) THEN documents::DOUBLE END AS documents, collected_at_utc FROM trend_snapshot),
snap AS (SELECT source, day, documents FROM snap_raw WHERE day IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, day ORDER BY collected_at_utc DESC) = 1)"""
DOCS = SNAP + ", docs AS (SELECT source, day, documents::BIGINT AS documents FROM snap WHERE documents >= 0), last_of_all AS (SELECT max(day) AS d FROM snap)"
TERMS = f"""terms_raw AS (SELECT source, {DAY} AS day, {TERM} AS term, count::DOUBLE AS n, collected_at_utc FROM snapshot_terms),
terms_all AS (SELECT source, day, term, n FROM terms_raw WHERE day IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, day, term ORDER BY collected_at_utc DESC) = 1),
terms AS (SELECT source, day, term, n::BIGINT AS count FROM terms_all WHERE n > 0)"""
STATUS = r"""stat AS (SELECT source, checked_at::DATE AS day, upper(regexp_replace(status, '^\s+|\s+$', '', 'g')) AS status FROM source_health
    QUALIFY row_number() OVER (PARTITION BY source, checked_at::DATE ORDER BY checked_at DESC, status DESC NULLS LAST) = 1)"""

# --- series -------------------------------------------------------------------------------------------------------------
_GAPS = f"""
WITH {SNAP},
usable AS (
    SELECT 'snapshot' AS series, source AS entity, day FROM snap WHERE documents IS NOT NULL
    UNION SELECT 'health', source, checked_at::DATE FROM source_health WHERE upper(regexp_replace(status, '^\\s+|\\s+$', '', 'g')) IN ('OK', 'EMPTY')
    UNION SELECT 'market', symbol, quote_ts::DATE FROM market WHERE close > 0 AND isfinite(close) AND isodow(quote_ts::DATE) <= 5),
spans AS (SELECT series, entity, min(day) AS lo, max(day) AS hi FROM usable GROUP BY ALL),
grid AS (SELECT series, entity, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM spans)
SELECT g.series, g.entity, strftime(g.day, '%Y-%m-%d') AS day FROM grid g ANTI JOIN usable u USING (series, entity, day) WHERE g.series <> 'market' OR isodow(g.day) <= 5"""

_ROLL = f"""
WITH {SNAP}, {TERMS},
spans AS (SELECT source, min(day) AS lo, max(day) AS hi FROM snap GROUP BY source),
figures AS (
    SELECT 'documents' AS measure, source, '' AS term, day, CASE WHEN documents > 0 THEN documents ELSE 0 END AS v FROM snap
    UNION ALL SELECT 'count', source, term, day, CASE WHEN n > 0 THEN n ELSE 0 END FROM terms_all),
keys AS (SELECT DISTINCT measure, source, term FROM figures),
grid AS (SELECT measure, source, term, lo, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM keys JOIN spans USING (source)),
dense AS (SELECT g.*, coalesce(f.v, 0) AS v FROM grid g LEFT JOIN figures f USING (measure, source, term, day)),
rolled AS (SELECT measure, source, term, day, lo,
    sum(v) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS total7, sum(v) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS total30
    FROM dense WINDOW w AS (PARTITION BY measure, source, term ORDER BY day)),
kept AS (SELECT *, total7 / 7 AS average7, total30 / 30 AS average30 FROM rolled WHERE day >= lo + 29)"""

_P5 = f"""
WITH {SNAP},
readings AS (
    SELECT 'snapshot' AS series, source AS entity, day, documents AS v FROM snap WHERE documents IS NOT NULL
    UNION ALL SELECT 'market', symbol, quote_ts::DATE, close FROM (SELECT * FROM market WHERE isfinite(close) QUALIFY row_number() OVER (PARTITION BY symbol, quote_ts::DATE ORDER BY quote_ts DESC, close DESC) = 1)),
split AS (SELECT *, CASE WHEN series = 'snapshot' THEN v < 0 OR v >= 900000 ELSE v <= 0 END AS bound FROM readings),
valid AS (SELECT *, list(v) OVER (o ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS l, list(v) OVER (o ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS r,
    v - lag(v) OVER o AS b, v - lead(v) OVER o AS a, CASE WHEN v = lag(v) OVER o THEN 0 ELSE 1 END AS step FROM split WHERE NOT bound WINDOW o AS (PARTITION BY series, entity ORDER BY day)),
near AS (SELECT *, list_concat(coalesce(l, []), coalesce(r, [])) AS around, sum(step) OVER (PARTITION BY series, entity ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM valid),
level AS (SELECT *, list_aggregate(around, 'median') AS med, count(*) OVER (PARTITION BY series, entity, run) AS len, count(*) OVER (PARTITION BY series, entity) AS n,
    count(*) OVER (PARTITION BY series, entity) - sum(step) OVER (PARTITION BY series, entity) AS same, median(v) OVER (PARTITION BY series, entity) AS usual,
    median(CASE WHEN b <> 0 THEN abs(b) END) OVER (PARTITION BY series, entity) AS move FROM near),
dev AS (SELECT *, list_aggregate(list_transform(around, lambda x: abs(x - med)), 'median') AS mad FROM level),
flags AS (SELECT series, entity, day, len >= 5 AND (same - (len - 1))::DOUBLE / greatest(n - len, 1) < 0.15 AND (series = 'market' OR usual >= 10) AS stuck,
    CASE WHEN series = 'snapshot' THEN abs(v - med) >= 10 AND (v >= 4 * med OR v * 4 <= med) AND abs(v - med) > 3 * 1.4826 * mad
        ELSE b IS NOT NULL AND a IS NOT NULL AND b * a > 0 AND least(abs(b), abs(a)) > 12 * move END AS spike FROM dev)
SELECT series, entity, strftime(day, '%Y-%m-%d') AS day FROM flags WHERE stuck OR spike
UNION ALL SELECT series, entity, strftime(day, '%Y-%m-%d') FROM split WHERE bound"""

# --- observations ---------------------------------------------------------------------------------------------------------
_FIRST = "QUALIFY row_number() OVER (PARTITION BY source, url ORDER BY obs_id) = 1"
_SRC = rf"bysrc AS (SELECT * FROM observation WHERE regexp_matches(url, '^ *[hH][tT][tT][pP][sS]?:') {_FIRST})"
_DOM = f"bydom AS (SELECT obs_id, title, url, source, family, coalesce(domain, 'news') AS domain, collected_at_utc FROM observation WHERE url LIKE 'https://%' OR url LIKE 'http://%' {_FIRST})"
_TOKENS = r"list_filter(regexp_extract_all(lower(title), '[\p{L}\p{Nl}\p{No}][\p{L}\p{N}_-]{2,39}'), lambda t: NOT regexp_full_match(t, '\p{N}+'))"


def _phrases(of: str, keep: str, sizes: tuple[int, ...] = (2, 3)) -> str:
    """A CTE ``ph`` with one row per row of ``of`` and distinct phrase."""
    stop = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
    groups = ", ".join(f"list_transform(range(1, len(t) - {n - 2}), lambda i: list_slice(t, i, i + {n - 1}))" for n in sizes)
    return rf"""tok AS (SELECT {keep}, {_TOKENS} AS t FROM {of} WHERE title IS NOT NULL),
grp AS (SELECT {keep}, list_concat({groups}) AS g FROM tok),
ph AS (SELECT {keep}, unnest(list_distinct(list_transform(list_filter(g, lambda x: NOT list_has_any(x, {stop}) AND NOT regexp_matches(array_to_string(x, ' '), '{DIGIT}')), lambda x: array_to_string(x, ' ')))) AS term FROM grp)"""


_THEME = "CASE " + " ".join(f"WHEN regexp_matches(lower(trim(term)), '{bounded(p)}') THEN '{name}'" for name, p in THEME_PATTERNS) + " ELSE CASE domain " + " ".join(f"WHEN '{d}' THEN '{t}'" for d, t in DOMAIN_THEMES.items()) + f" ELSE '{OTHER_THEME}' END END"
_NOISE = f"(lower(term) IN {_in(NOISE_PHRASES)} OR regexp_matches(lower(term), '{bounded(NOISE_PATTERN)}'))"

_DAYS = f"""{DOCS}, {STATUS},
joined AS (SELECT coalesce(a.source, b.source) AS source, coalesce(a.day, b.day) AS day, coalesce(documents, 0) AS documents, status,
    date_diff('day', coalesce(a.day, b.day), (SELECT d FROM last_of_all)) // 7 AS week FROM docs a FULL JOIN stat b ON a.source = b.source AND a.day = b.day
    WHERE coalesce(a.day, b.day) <= (SELECT d FROM last_of_all) AND coalesce(a.day, b.day) > (SELECT d FROM last_of_all) - 21),
per AS (SELECT source, count(*) FILTER (CASE WHEN status IS NOT NULL THEN status IN ('OK', 'EMPTY') ELSE documents > 0 END) AS observed_days,
    sum(CASE WHEN day = (SELECT d FROM last_of_all) THEN documents ELSE 0 END) AS documents_today, sum(CASE WHEN week = 0 THEN documents ELSE 0 END) AS d0,
    sum(CASE WHEN week = 1 THEN documents ELSE 0 END) AS d1, sum(CASE WHEN week = 2 THEN documents ELSE 0 END) AS d2 FROM joined GROUP BY source),
days AS (SELECT id AS source, coalesce(observed_days, 0)::BIGINT AS observed_days, coalesce(documents_today, 0)::BIGINT AS documents_today, coalesce(d0, 0)::BIGINT AS d0, coalesce(d1, 0)::BIGINT AS d1, coalesce(d2, 0)::BIGINT AS d2
    FROM source_def LEFT JOIN per ON id = per.source)"""
_WEEKS = f"""{_DAYS}, {TERMS},
recent AS (SELECT *, date_diff('day', day, (SELECT d FROM last_of_all)) // 7 AS week FROM terms WHERE day <= (SELECT d FROM last_of_all) AND day > (SELECT d FROM last_of_all) - 21),
wk AS (SELECT source, term, sum(CASE WHEN week = 0 THEN count ELSE 0 END)::BIGINT AS n0, sum(CASE WHEN week = 1 THEN count ELSE 0 END)::BIGINT AS n1, sum(CASE WHEN week = 2 THEN count ELSE 0 END)::BIGINT AS n2,
    count(*) FILTER (week = 0 AND count > 0) AS active FROM recent GROUP BY source, term),
rates AS (SELECT source, term, n0, active, observed_days, documents_today, d0, d1, d2, n0 * 10000.0::DOUBLE / nullif(d0, 0) AS r0, n1 * 10000.0::DOUBLE / nullif(d1, 0) AS r1, n2 * 10000.0::DOUBLE / nullif(d2, 0) AS r2 FROM wk JOIN days USING (source))"""
_CHART = f"""{_WEEKS},
moves AS (SELECT *, r0 - r1 AS v, r0 - 2 * r1 + r2 AS a FROM rates WHERE documents_today > 0 AND observed_days >= 15 AND d0 >= 35 AND n0 >= 4 AND active >= 2),
rows_ AS (SELECT source, term, round(a, 3) AS acceleration, round(v, 3) AS velocity, round(r2, 3) AS rate_early, round(r1, 3) AS rate_middle, round(r0, 3) AS rate_recent, n0 AS mentions_7d, active AS active_days_7d FROM moves WHERE v > 0 AND a > 0),
chart AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY acceleration DESC, mentions_7d DESC, term)::INTEGER AS rank FROM rows_ QUALIFY rank <= 5)"""

_LINKED = """linked AS (SELECT source, day, term, unnest(links) AS link, unnest(range(1, len(links) + 1))::INTEGER AS pos FROM linked_rows)"""
_LINKED = f"""linked_raw AS (SELECT source, {DAY} AS day, {TERM} AS term, count::DOUBLE AS n, links, collected_at_utc FROM snapshot_terms),
linked_rows AS (SELECT * FROM (SELECT * FROM linked_raw WHERE day IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, day, term ORDER BY collected_at_utc DESC, n DESC NULLS LAST, links DESC NULLS LAST) = 1) WHERE n > 0),
{_LINKED}"""

_THEMED = f"""{DOCS}, {TERMS},
themed AS (SELECT {_THEME} AS theme, source, day, term, count, count * 10000.0::DOUBLE / (documents + 80) AS rate FROM (
    SELECT t.*, d.documents, coalesce(s.domain, 'news') AS domain FROM terms t JOIN docs d USING (source, day) LEFT JOIN source_def s ON s.id = t.source
    WHERE d.documents >= 10 AND t.count >= 2 AND NOT {_NOISE}))"""


def _complete(name: str, week: int) -> str:
    return f"""{name} AS (SELECT source FROM docs JOIN stat USING (source, day) WHERE status IN ('OK', 'EMPTY') AND day BETWEEN (SELECT d FROM last_of_all) - {7 * week + 6} AND (SELECT d FROM last_of_all) - {7 * week}
    GROUP BY source HAVING count(DISTINCT day) = 7)"""


def _charts(common: str) -> str:
    return f"""
fortnight AS (SELECT *, date_diff('day', day, (SELECT d FROM last_of_all)) // 7 AS week FROM themed WHERE day <= (SELECT d FROM last_of_all) AND day > (SELECT d FROM last_of_all) - 14 AND source IN (SELECT source FROM {common})),
means AS (SELECT week, theme, term, source, avg(rate) AS mean, sum(count) AS n FROM fortnight GROUP BY ALL),
scored AS (SELECT week, theme, term, round(avg(mean), 3) AS score, sum(n)::BIGINT AS mentions, count(*) AS source_count FROM means GROUP BY week, theme, term),
ranked AS (SELECT *, row_number() OVER (PARTITION BY week, theme ORDER BY score DESC, source_count DESC, mentions DESC, term)::INTEGER AS rank FROM scored QUALIFY rank <= 20),
final AS (SELECT c.theme, c.term, c.score, c.mentions, c.source_count, c.rank, p.rank AS previous_rank, p.rank - c.rank AS movement,
    CASE WHEN p.rank IS NULL THEN 'NEW' WHEN p.rank > c.rank THEN 'UP' WHEN p.rank < c.rank THEN 'DOWN' ELSE 'SAME' END AS status
    FROM (SELECT * FROM ranked WHERE week = 0) c LEFT JOIN (SELECT * FROM ranked WHERE week = 1) p USING (theme, term))"""


_GROWTH = f"""
WITH {_DOM}, {_phrases("bydom", "domain, family, collected_at_utc")},
dd AS (SELECT domain, collected_at_utc::DATE AS day, count(*) AS documents FROM bydom GROUP BY ALL),
dt AS (SELECT domain, collected_at_utc::DATE AS day, term, count(*) AS count, count(DISTINCT family) AS breadth FROM ph GROUP BY ALL),
last_of_all AS (SELECT max(day) AS d FROM dd),
lastdays AS (SELECT DISTINCT day FROM dd WHERE day < (SELECT d FROM last_of_all) ORDER BY day DESC LIMIT 90),
prior AS (SELECT domain, day, documents, row_number() OVER (PARTITION BY domain ORDER BY day DESC) AS n, count(*) OVER (PARTITION BY domain) AS available FROM dd WHERE day IN (SELECT day FROM lastdays)),
framed AS (SELECT * FROM prior WHERE n <= 28),
spans AS (SELECT domain, count(*) AS days, max(available) AS available FROM framed GROUP BY domain),
base AS (SELECT dt.domain, dt.term, sum(dt.count * 10000.0::DOUBLE / f.documents) AS rates FROM dt JOIN framed f USING (domain, day) GROUP BY ALL),
now_ AS (SELECT t.domain, t.term, t.count AS mentions, t.breadth, d.documents AS docs, t.count * 10000.0::DOUBLE / greatest(1, d.documents) AS r FROM dt t JOIN dd d USING (domain, day) WHERE t.day = (SELECT d FROM last_of_all) AND t.count >= 2),
based AS (SELECT n.*, available, CASE WHEN days > 0 THEN coalesce(rates, 0) / days END AS b FROM now_ n LEFT JOIN spans USING (domain) LEFT JOIN base USING (domain, term)),
grown AS (SELECT *, (r - b) / greatest(1.0::DOUBLE, b) AS g FROM based),
scored AS (SELECT domain, term, round(ln(1 + r) + CASE WHEN b IS NULL THEN 0 ELSE least(5, greatest(-2, g)) END + 0.25::DOUBLE * breadth, 3) AS score, mentions, round(r, 2) AS rate, CASE WHEN b IS NOT NULL THEN round(g, 3) END AS growth,
    CASE WHEN available >= 14 AND docs > 0 AND breadth >= 2 AND mentions >= 3 THEN 'MEASURABLE' ELSE 'EXPLORATORY' END AS quality FROM grown)
SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, mentions DESC, term)::INTEGER AS rank FROM scored QUALIFY rank <= 20"""

# --- market -----------------------------------------------------------------------------------------------------------------
_CLOSES = """closes AS (SELECT symbol, quote_ts::DATE AS day, round(close, 4) AS close FROM market WHERE close > 0 AND isfinite(close)
    QUALIFY row_number() OVER (PARTITION BY symbol, quote_ts::DATE ORDER BY quote_ts DESC, close DESC) = 1),
num AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS n, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS step FROM closes)"""
_SMA = "SELECT symbol, " + ", ".join(f"CASE WHEN count(*) FILTER (n <= {w}) = {w} THEN round(avg(close) FILTER (n <= {w}), 4) END AS sma{w}" for w in (20, 50)) + " FROM num GROUP BY symbol"
_RET = "SELECT symbol, round((max(close) FILTER (n = 1) / max(close) FILTER (n = 21) - 1) * 100, 3) AS return_20d_pct FROM num GROUP BY symbol"
_VOL = "SELECT symbol, CASE WHEN count(step) FILTER (n <= 19) >= 10 THEN round(stddev_samp(step) FILTER (n <= 19) * sqrt(252.0) * 100, 3) END AS volatility_20d_annualized_pct FROM num GROUP BY symbol"
_FALL = "SELECT symbol, round(least(0.0, min(fall)), 3) AS max_drawdown_90d_pct FROM (SELECT symbol, (close / max(close) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) - 1) * 100 AS fall FROM num WHERE n <= 90) GROUP BY symbol"
_AGE = f"WITH {_CLOSES}, last AS (SELECT symbol, max(day) AS day FROM closes GROUP BY symbol), aged AS (SELECT symbol, day, CASE WHEN date_diff('day', day, (SELECT max(day) FROM closes)) <= 5 THEN 'CURRENT_DAILY' ELSE 'STALE' END AS status FROM last)"

_TUMBLING = "SELECT ts::DATE AS day, event_type AS term, count(*) AS count FROM events GROUP BY ALL"

SQL = {
    "p1_found": _GAPS,
    "p5_found": _P5,
    "p6_found": _ROLL + " SELECT measure, source, term, strftime(day, '%Y-%m-%d') AS day FROM kept WHERE (measure = 'documents' AND total7 >= 1 AND 30 * total7 >= 14 * total30) OR (measure = 'count' AND total7 >= 12 AND 30 * total7 >= 21 * total30)",
    "p6_totals": _ROLL + " SELECT measure, source, term, day, total7::DOUBLE AS total7, average7::DOUBLE AS average7, total30::DOUBLE AS total30, average30::DOUBLE AS average30 FROM kept",
    "recency_filter": "SELECT obs_id FROM observation WHERE family = 'trend_feed' OR published IS NULL OR published >= collected_at_utc - INTERVAL 3 DAY",
    "strip_publisher": r"SELECT obs_id, CASE WHEN family = 'news_agg' THEN regexp_replace(regexp_replace(title, '^(.*) - .*$', '\1', 's'), '^\s+|\s+$', '', 'g') ELSE title END AS title FROM observation",
    "unescape_titles": f"SELECT obs_id, {connectors.unescaped_sql('title')} AS title FROM observation WHERE title IS NOT NULL",
    "url_parts": "SELECT obs_id, lower(regexp_extract(ltrim(url), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(ltrim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM observation WHERE url IS NOT NULL",
    "url_quote": f"WITH {TERMS} SELECT DISTINCT term, replace(url_encode(term), '%2F', '/') AS path FROM terms",
    "published_text": "SELECT obs_id, epoch(published)::BIGINT AS published_s FROM observation WHERE published IS NOT NULL",
    "dedup_source": f"WITH {_SRC} SELECT source, url, title FROM bysrc",
    "dedup_domain": f"WITH {_DOM} SELECT source, url, title FROM bydom",
    "item_limit": "SELECT source, obs_id FROM observation QUALIFY row_number() OVER (PARTITION BY source ORDER BY obs_id) <= 30",
    "title_phrases": f"WITH {_phrases('observation', 'obs_id')} SELECT obs_id, term FROM ph",
    "obs_tagged": "SELECT kind, s.domain AS source_domain, count(*) AS observations FROM observation o JOIN source_def s ON s.id = o.source GROUP BY ALL",
    "obs_union": "SELECT family, count(*) AS observations, count(title) AS titles FROM observation GROUP BY family",
    "source_docs": f"WITH {_SRC}, n AS (SELECT source, count(*) AS documents FROM bysrc GROUP BY source) SELECT id AS source, coalesce(documents, 0) AS documents FROM source_def LEFT JOIN n ON n.source = id",
    "source_terms": f"WITH {_SRC}, {_phrases('bysrc', 'source')} SELECT source, term, count(*) AS count FROM ph GROUP BY ALL",
    "domain_docs": f"WITH {_DOM}, n AS (SELECT domain, count(*) AS documents FROM bydom GROUP BY domain), every_one AS (SELECT coalesce(domain, 'news') AS domain FROM source_def UNION SELECT domain FROM n) SELECT domain, coalesce(documents, 0) AS documents FROM every_one LEFT JOIN n USING (domain)",
    "domain_terms": f"WITH {_DOM}, {_phrases('bydom', 'domain, family')} SELECT domain, term, count(*) AS count, string_agg(DISTINCT family, ',' ORDER BY family) AS families FROM ph GROUP BY ALL",
    "term_links": f"WITH {_SRC}, {_phrases('bysrc', 'source, url, obs_id')}, f AS (SELECT source, term, url, min(obs_id) AS first_at FROM ph GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source, term ORDER BY first_at, url) AS n FROM f) SELECT source, term, string_agg(url, ' ' ORDER BY n) AS links FROM r WHERE n <= 3 GROUP BY ALL",
    "history_overlay": f"WITH {DOCS} SELECT day, source, CASE WHEN day = (SELECT d FROM last_of_all) THEN 2 * documents ELSE documents END AS documents FROM docs",
    "last_snapshots": f"WITH {DOCS} SELECT day, sum(documents)::BIGINT AS documents FROM docs WHERE day IN (SELECT DISTINCT day FROM docs ORDER BY day DESC LIMIT 90) GROUP BY day",
    "observed_days": f"WITH {_DAYS} SELECT source, observed_days, documents_today FROM days",
    "window_rates": f"WITH {_WEEKS} SELECT source, term, round(r2, 3) AS rate_early, round(r1, 3) AS rate_middle, round(r0, 3) AS rate_recent FROM rates WHERE n0 > 0",
    "accel_top5": f"WITH {_CHART} SELECT * FROM chart",
    "board_state": f"WITH {_CHART} SELECT source, CASE WHEN documents_today = 0 THEN 'NO_DATA' WHEN observed_days < 15 THEN 'INSUFFICIENT_HISTORY' WHEN d0 < 35 THEN 'INSUFFICIENT_VOLUME' WHEN source IN (SELECT source FROM chart) THEN 'RANKED_EXPLORATORY' ELSE 'NO_POSITIVE_ACCELERATION' END AS state, observed_days, documents_today FROM days",
    "source_preview": f"WITH {DOCS}, {TERMS} SELECT source, term, count AS mentions_today, row_number() OVER (PARTITION BY source ORDER BY count DESC, term)::INTEGER AS rank FROM terms WHERE day = (SELECT d FROM last_of_all) AND count >= 2 QUALIFY rank <= 5",
    "research_queue": f"WITH {_CHART} SELECT source || ':' || term AS candidate_id, source, rank, acceleration FROM chart",
    "domain_rank": _GROWTH,
    "theme_classify": f"WITH {TERMS} SELECT DISTINCT term, domain, {_THEME} AS theme FROM (SELECT term, coalesce(s.domain, 'news') AS domain FROM terms t JOIN source_def s ON s.id = t.source)",
    "theme_noise": f"WITH {_SRC}, {_phrases('bysrc', 'source')} SELECT DISTINCT term FROM ph WHERE {_NOISE}",
    "theme_daily": f"WITH {_THEMED} SELECT theme, source, day, term, count, round(rate, 3) AS rate FROM themed",
    "theme_scores": f"WITH {_THEMED}, m AS (SELECT theme, term, source, avg(rate) AS mean, sum(count) AS n FROM themed WHERE day <= (SELECT d FROM last_of_all) AND day > (SELECT d FROM last_of_all) - 7 GROUP BY ALL) SELECT theme, term, round(avg(mean), 3) AS score, sum(n)::BIGINT AS mentions, count(*) AS source_count FROM m GROUP BY theme, term",
    "complete_window": f"WITH {DOCS}, {STATUS}, {_complete('c0', 0)} SELECT source FROM c0",
    "common_sources": f"WITH {DOCS}, {STATUS}, {_complete('c0', 0)}, {_complete('c1', 1)} SELECT source FROM c0 INTERSECT SELECT source FROM c1",
    "theme_billboard": f"WITH {_THEMED}, {STATUS}, {_complete('c0', 0)}, {_complete('c1', 1)}, common AS (SELECT source FROM c0 INTERSECT SELECT source FROM c1), {_charts('common')} SELECT theme, term, score, mentions, source_count, rank, previous_rank, movement, status FROM final",
    "chart_movement": f"WITH {_THEMED}, every_one AS (SELECT id AS source FROM source_def), {_charts('every_one')} SELECT theme, term, rank, previous_rank, movement, status FROM final",
    "run_status": f"WITH {STATUS} SELECT day, count(*) AS checked, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status IS NULL OR status NOT IN ('OK', 'EMPTY')) AS unavailable, bool_or(coalesce(status <> 'OK', true)) AS partial FROM stat GROUP BY day",
    "run_summary": f"WITH {_DOM}, {_CHART} SELECT count(*) AS observations, count(DISTINCT source) AS sources, count(DISTINCT domain) AS domains, (SELECT count(*) FROM stat WHERE day = (SELECT max(day) FROM stat) AND (status IS NULL OR status NOT IN ('OK', 'EMPTY'))) AS unavailable_sources, (SELECT count(DISTINCT source) FROM chart) AS boards FROM bydom",
    "price_clean": f"WITH {_CLOSES} SELECT symbol, day, close FROM closes",
    "market_sma": f"WITH {_CLOSES} {_SMA}",
    "market_return": f"WITH {_CLOSES} {_RET}",
    "market_volatility": f"WITH {_CLOSES} {_VOL}",
    "market_drawdown": f"WITH {_CLOSES} {_FALL}",
    "market_indicators": f"WITH {_CLOSES} SELECT * FROM ({_SMA}) JOIN ({_RET}) USING (symbol) JOIN ({_VOL}) USING (symbol) JOIN ({_FALL}) USING (symbol)",
    "market_tail": f"WITH {_CLOSES} SELECT symbol, day, close FROM num WHERE n <= 180",
    "quote_age": _AGE + " SELECT symbol, day, status FROM aged",
    "market_coverage": _AGE + " SELECT count(*) FILTER (status = 'CURRENT_DAILY') AS current, count(*) AS symbols FROM aged",
    "daily_tumbling": _TUMBLING,
    "stream_daily": _TUMBLING,
    "title_grams": f"WITH {_phrases('observation', 'obs_id', (1, 2, 3, 4))} SELECT obs_id, term FROM ph",
    "accel_full_window": f"WITH {_CHART.replace('observed_days >= 15', 'observed_days >= 21')} SELECT * FROM chart",
    "board_state_full": f"WITH {_CHART.replace('observed_days >= 15', 'observed_days >= 21')} SELECT source, CASE WHEN documents_today = 0 THEN 'NO_DATA' WHEN observed_days < 21 THEN 'INSUFFICIENT_HISTORY' WHEN d0 < 35 THEN 'INSUFFICIENT_VOLUME' WHEN source IN (SELECT source FROM chart) THEN 'RANKED_EXPLORATORY' ELSE 'NO_POSITIVE_ACCELERATION' END AS state, observed_days, documents_today FROM days",
    "chart_links": f"""WITH {_CHART}, {_LINKED}, at_ AS (SELECT source, term, rank, link, min((date_diff('day', day, DATE '2100-01-01'), pos)) AS first_at FROM chart JOIN linked USING (source, term)
        WHERE day <= (SELECT d FROM last_of_all) AND day > (SELECT d FROM last_of_all) - 7 GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY source, term ORDER BY first_at, link) AS n FROM at_),
        l AS (SELECT source, term, string_agg(link, ' ' ORDER BY n) AS links FROM n WHERE n <= 3 GROUP BY ALL) SELECT source, term, rank, coalesce(links, '') AS links FROM chart LEFT JOIN l USING (source, term)""",
    "theme_evidence": f"""WITH {_THEMED}, {_LINKED}, week_ AS (SELECT * FROM themed WHERE day <= (SELECT d FROM last_of_all) AND day > (SELECT d FROM last_of_all) - 7),
        m AS (SELECT theme, term, source, avg(rate) AS mean, sum(count) AS n FROM week_ GROUP BY ALL), scored AS (SELECT theme, term, round(avg(mean), 3) AS score, sum(n) AS mentions, count(*) AS source_count, string_agg(source, ' ' ORDER BY source) AS source_ids FROM m GROUP BY theme, term),
        top AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY score DESC, source_count DESC, mentions DESC, term)::INTEGER AS rank FROM scored QUALIFY rank <= 20),
        at_ AS (SELECT w.theme, w.term, link, min((w.day, w.source, pos)) AS first_at FROM week_ w JOIN top USING (theme, term) JOIN linked k ON k.source = w.source AND k.day = w.day AND k.term = w.term WHERE pos <= 3 GROUP BY ALL),
        n AS (SELECT *, row_number() OVER (PARTITION BY theme, term ORDER BY first_at, link) AS n FROM at_), l AS (SELECT theme, term, string_agg(link, ' ' ORDER BY n) AS links FROM n WHERE n <= 4 GROUP BY ALL)
        SELECT theme, term, rank, source_ids, coalesce(links, '') AS links FROM top LEFT JOIN l USING (theme, term)""",
    "theme_entries": f"WITH {_THEMED}, week_ AS (SELECT DISTINCT theme, term FROM themed WHERE day <= (SELECT d FROM last_of_all) AND day > (SELECT d FROM last_of_all) - 7), all_ AS (SELECT unnest([{', '.join(repr(t) for t in THEME_IDS)}]) AS theme), n AS (SELECT theme, least(20, count(*)) AS entries FROM week_ GROUP BY theme) SELECT theme, coalesce(entries, 0) AS entries FROM all_ LEFT JOIN n USING (theme)",
    "domain_health": f"WITH {STATUS} SELECT coalesce(s.domain, 'news') AS domain, count(*) AS sources, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status = 'EMPTY') AS empty, count(*) FILTER (status IS NOT NULL AND status NOT IN ('OK', 'EMPTY')) AS unavailable FROM source_def s LEFT JOIN (SELECT * FROM stat WHERE day = (SELECT max(day) FROM stat)) h ON h.source = s.id GROUP BY 1",
    **connectors.SQL,
}

#: Twins whose rows have a day; days are compared as text.
for _name in ("p6_totals", "history_overlay", "last_snapshots", "theme_daily", "run_status", "price_clean", "market_tail", "quote_age", "daily_tumbling", "stream_daily"):
    SQL[_name] = f"SELECT * REPLACE (strftime(day, '%Y-%m-%d') AS day) FROM ({SQL[_name]})"
