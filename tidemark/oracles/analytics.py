"""DuckDB text for the feedback reports."""

from __future__ import annotations

from tidemark import rules
from tidemark.oracles.dialect import FEEDBACK, in_list, with_
from tidemark.plans.analytics import NOW
from tidemark.plans.inputs import PAGE_SIZE

ORACLES = {
    "feedback_clean": with_(FEEDBACK, body="""
SELECT event_id, CAST(least(5, greatest(1, raw_satisfaction)) AS BIGINT) AS satisfaction, helpful, correct_language,
  coalesce(substring(comments, 1, 300), '') AS comments FROM feedback WHERE raw_satisfaction <> 0"""),
    "feedback_health": with_(FEEDBACK, body="""
SELECT n, round(a, 2) AS avg_satisfaction, round(100.0 * h / (h + u), 1) AS helpful_pct,
  round(100.0 * c / (c + w), 1) AS correct_pct, round(100.0 * lo / n, 1) AS low_pct, round(100.0 * hi / n, 1) AS high_pct,
  w > c * 0.15 AS language_alert
FROM (SELECT count(*) n, avg(satisfaction) a, count(*) FILTER (WHERE helpful) h, count(*) FILTER (WHERE NOT helpful) u,
  count(*) FILTER (WHERE correct_language) c, count(*) FILTER (WHERE NOT correct_language) w,
  count(*) FILTER (WHERE satisfaction <= 2) lo, count(*) FILTER (WHERE satisfaction >= 4) hi FROM feedback)"""),
    "feedback_hist": with_(FEEDBACK, body="""
SELECT s.satisfaction, count(f.event_id) AS n FROM (SELECT unnest([1, 2, 3, 4, 5])::BIGINT AS satisfaction) s
LEFT JOIN feedback f USING (satisfaction) GROUP BY 1"""),
    "feedback_newest": with_(FEEDBACK, body="""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, satisfaction FROM feedback ORDER BY ts DESC, event_id DESC"""),
    "feedback_since": with_(FEEDBACK, body=f"""
SELECT event_id, satisfaction FROM feedback WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY"""),
    "daily_volume": with_(FEEDBACK, body="""
SELECT CAST(day AS VARCHAR) AS day, n FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM feedback GROUP BY 1
ORDER BY 1 DESC LIMIT 14)"""),
    "failure_keywords": f"""
SELECT word, count(*) AS n FROM (
  SELECT unnest(regexp_split_to_array(c, '[^a-zA-ZÀ-ÿŵŷ]+')) AS word FROM (
    SELECT lower(trim(text)) AS c FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))
  WHERE length(c) > 3)
WHERE length(word) > 2 AND word NOT IN {in_list(rules.COMMENT_STOP)} GROUP BY 1 ORDER BY n DESC, word LIMIT 12""",
    "admin_stats": with_(FEEDBACK, body="""
SELECT count(*) AS total, round(avg(satisfaction), 1) AS avg_satisfaction,
  CAST(floor(100.0 * count(*) FILTER (WHERE helpful) / count(*) + 0.5) AS BIGINT) AS helpful_pct,
  CAST(floor(100.0 * count(*) FILTER (WHERE correct_language) / count(*) + 0.5) AS BIGINT) AS lang_pct,
  count(*) FILTER (WHERE trim(coalesce(comments, '')) <> '') AS with_comments FROM feedback"""),
    "feedback_csv": with_(FEEDBACK, body="""
SELECT row_number() OVER (ORDER BY ts DESC, event_id DESC) AS row_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
  satisfaction AS rating, CASE WHEN helpful THEN 'Yes' WHEN NOT helpful THEN 'No' ELSE '' END AS helpful,
  CASE WHEN correct_language THEN 'Yes' WHEN NOT correct_language THEN 'No' ELSE '' END AS correct_language,
  '"' || replace(coalesce(comments, ''), '"', '""') || '"' AS comments FROM feedback"""),
    "session_dropoff": with_(FEEDBACK, body="""
SELECT user_id, CAST(s AS BIGINT) AS session_no, count(*) AS n_events, arg_max(satisfaction, (ts, event_id)) AS last_satisfaction,
  arg_max(satisfaction, (ts, event_id)) <= 2 AS dropped_off
FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM feedback))
GROUP BY 1, 2"""),
    "props_parse": """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing,
  '{"t":"' || event_type || '"}' AS dumped FROM events""",
    "paged_scan": f"""
SELECT o_orderkey, (n - 1) // {PAGE_SIZE} AS page, (n - 1) % {PAGE_SIZE} AS position
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)""",
}
