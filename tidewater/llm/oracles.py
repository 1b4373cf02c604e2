"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

TERM = r"trim(regexp_replace(lower(nfc_normalize(term)), '[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))"
BARE_DAY = r"regexp_replace(date, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')"
DAY = f"coalesce(try_strptime({BARE_DAY}, '%Y-%m-%d'), try_strptime({BARE_DAY}, '%Y/%m/%d'), try_strptime({BARE_DAY}, '%Y%m%d'), try_strptime({BARE_DAY}, '%Y-%m-%dT%H:%M:%SZ'), try_strptime({BARE_DAY}, '%d %b %Y'))::DATE"

_RANKED = f"""
WITH raw AS (SELECT chart_date, board, {TERM} AS term, CASE WHEN isfinite(score) THEN score END AS score,
    CASE WHEN isfinite(acceleration_per_10k_week2) THEN acceleration_per_10k_week2 END AS acceleration_per_10k_week2, mentions, collected_at_utc FROM billboard),
counted AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY chart_date, board, term ORDER BY collected_at_utc DESC) = 1),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY chart_date, board ORDER BY score DESC, acceleration_per_10k_week2 DESC NULLS LAST, mentions DESC, term) AS INTEGER) AS rank
    FROM counted WHERE score IS NOT NULL)
SELECT COLUMNS__ FROM ranked WHERE rank <= 5"""

_TERMS = f"""
WITH raw AS (SELECT source, {DAY} AS day, {TERM} AS term, count AS figure, collected_at_utc FROM snapshot_terms),
counted AS (SELECT * FROM raw WHERE day IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, day, term ORDER BY collected_at_utc DESC) = 1),
words AS (SELECT obs_id, unnest(regexp_extract_all(nfc_normalize(lower(nfc_normalize(title))), '\\p{{L}}+')) AS term FROM observation WHERE title IS NOT NULL),
both_scopes AS (
    SELECT 'snapshot' AS scope, term, CAST(sum(CASE WHEN figure > 0 THEN figure ELSE 0 END) AS BIGINT) AS occurrences, count(*) AS records,
        (SELECT count(*) FROM (SELECT DISTINCT source, day FROM counted)) AS n FROM counted GROUP BY term
    UNION ALL
    SELECT 'title', term, count(*), count(DISTINCT obs_id), (SELECT count(*) FROM observation WHERE title IS NOT NULL) FROM words GROUP BY term),
marked AS (SELECT scope, term, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records >= 0.05 * n THEN 'common' END AS mark FROM both_scopes)
SELECT COLUMNS__ FROM marked"""

SQL = {
    "p4_terms": _TERMS.replace("COLUMNS__", "scope, term, occurrences, records, mark"),
    "p4_found": _TERMS.replace("COLUMNS__", "scope, term, mark") + " WHERE mark IS NOT NULL",
    "p7_ranked": _RANKED.replace("COLUMNS__", "chart_date, board, score, acceleration_per_10k_week2, mentions, term, rank"),
    "p7_found": _RANKED.replace("COLUMNS__", "chart_date, board, term"),
}
