"""The same tables for DuckDB, as common table expressions."""

TURNS = r"""
t0 AS (SELECT conv_id AS call_id, turn::INT AS turn_id, role AS speaker, text,
       len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '')) AS n_words FROM conversations WHERE text IS NOT NULL),
turns AS (SELECT call_id, turn_id, speaker, text, n_words,
       (sum(n_words) OVER w - n_words) / 2.5 AS start, sum(n_words) OVER w / 2.5 AS "end"
       FROM t0 WINDOW w AS (PARTITION BY call_id ORDER BY turn_id ROWS UNBOUNDED PRECEDING))"""

WORDS = TURNS + r""",
w0 AS (SELECT call_id, turn_id, speaker, round(start * 2.5)::INT AS a, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS toks FROM turns),
words AS (SELECT call_id, turn_id, a + k - 1 AS idx, toks[k] AS word, (a + k - 1) / 2.5 AS start, (a + k) / 2.5 AS "end", speaker
       FROM w0, generate_series(1, len(toks)) g(k))"""

SEGMENTS = r"""
segments AS (SELECT user_id AS call_id, event_id AS idx, event_type AS speaker, round(epoch_us(ts) / 1e6, 3) AS start,
       round(round(epoch_us(ts) / 1e6, 3) + round(greatest(coalesce(value, 0.0), 0.0), 3), 3) AS "end"
       FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"""
