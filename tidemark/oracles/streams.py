"""DuckDB text for the batch equivalents of the streams."""

from __future__ import annotations

from tidemark.oracles import language as ol

_TURNS = "turns AS (SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant'))"


def _sub(key: str) -> str:
    """A language oracle over the given turns only (no example rows)."""
    sql = ol.ORACLES[key]
    return "(" + f"WITH {_TURNS}" + sql.split("WHERE role IN ('user', 'assistant'))", 1)[1] + ")"


ORACLES = {
    "stream_feedback_daily": """
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg(least(5, greatest(1, event_id % 9 - 1))), 6) AS avg_satisfaction
FROM events WHERE event_id % 9 <> 1 GROUP BY 1""",
    "stream_embed_refresh": """
SELECT doc_id AS id, left(sha1(CASE WHEN doc_id % 7 = 0 THEN t || 'x' ELSE t END), 16) AS hash,
  CASE WHEN doc_id % 5 = 0 THEN 3 WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS embedded_in, 64 AS dim
FROM (SELECT doc_id, regexp_replace(concat_ws(chr(10), source, text), '^\\s+|\\s+$', '', 'g') AS t FROM documents)""",
    "stream_turn_state": f"""
SELECT conv_id, turn, emotion, anchor, topics FROM {_sub('emotion_turns')} e JOIN {_sub('student_state')} s USING (conv_id, turn)
JOIN {_sub('topic_stack')} t USING (conv_id, turn)""",
}
