"""DuckDB SQL that says what each query must return."""

from .sql_tables import SEGMENTS, TURNS, WORDS

ORACLES: dict[str, str] = {}

_TOKENS = r"len(list_filter(regexp_split_to_array(trim({0}), '\s+'), lambda x: x <> ''))"

# The quality report by any keys of a turns relation.
_ASSESS = r"""
flags AS (SELECT *, strpos(text, '.') > 0 AND """ + _TOKENS.format("substr(text, strpos(text, '.') + 1)") + r""" >= 3 AS is_buried,
    "end" - start >= 2.0 AND n_words / greatest("end" - start, 1e-6) < 0.8
    AND NOT (len(regexp_extract_all(text, '\d')) >= greatest(4, floor(length(replace(text, ' ', '')) / 3))) AS is_stretched FROM {t}),
calls AS (SELECT {k}, count(*) AS turns, sum(n_words)::BIGINT AS words, count(DISTINCT speaker) AS speakers, sum("end" - start) AS speech,
    count(*) FILTER (is_buried) AS buried, count(*) FILTER (is_stretched) AS stretched FROM flags GROUP BY {k}),
held AS (SELECT {k}, speaker, sum("end" - start) AS sec FROM {t} GROUP BY {k}, speaker),
dom AS (SELECT {k}, 100 * max(sec) / nullif(sum(sec), 0) AS d FROM held GROUP BY {k}),
rep AS (SELECT {k}, sum(c - 1)::BIGINT AS repeated FROM (SELECT {k}, trim(text) AS x, count(*) AS c FROM {t}
    WHERE """ + _TOKENS.format("text") + r""" >= 3 GROUP BY {k}, trim(text) HAVING count(*) > 1) GROUP BY {k}),
rated AS (SELECT calls.*, coalesce(rep.repeated, 0)::BIGINT AS repeated, round(buried / greatest(turns, 1), 4) AS buried_rate,
    round(round(coalesce(d, 0), 6), 1) AS dominant_pct, round(words / CASE WHEN speech = 0 THEN 1.0 ELSE speech END, 2) AS words_per_speech_sec
    FROM calls JOIN dom USING ({k}) LEFT JOIN rep USING ({k})),
ruled AS (SELECT *, (speakers > 2)::INT + (speakers < 2)::INT + (repeated > 0)::INT + (stretched > 0)::INT + (buried > 0)::INT
    + (buried >= 3 AND dominant_pct > 85)::INT AS n_rules FROM rated),
judged AS (SELECT *, CASE WHEN words < 5 THEN 'empty' WHEN speakers = 1 AND buried = 0 AND words < 120 THEN 'one-sided'
    WHEN n_rules = 0 THEN 'clean'
    WHEN (buried * 10 >= turns AND buried >= 3) OR speakers > 2 OR (buried >= 3 AND dominant_pct > 85) OR repeated >= 3 THEN 'unreliable'
    ELSE 'suspect' END AS verdict FROM ruled),
assessed AS (SELECT *, CASE WHEN verdict IN ('empty', 'one-sided') THEN 1 ELSE n_rules END AS n_problems FROM judged)"""


def _assess(t: str = "turns", k: str = "call_id") -> str:
    return _ASSESS.replace("{t}", t).replace("{k}", k)


ORACLES["conv_quality"] = f"""WITH {TURNS}, {_assess()}
SELECT call_id, turns, words, speakers, repeated, stretched, buried, buried_rate, dominant_pct, words_per_speech_sec, verdict, n_problems FROM assessed"""

ORACLES["speaker_share"] = f"""WITH {TURNS}, h AS (SELECT call_id, speaker, sum("end" - start) AS sec FROM turns GROUP BY ALL)
SELECT call_id, speaker, round(sec, 3) AS seconds,
  round(round(CASE WHEN sum(sec) OVER (PARTITION BY call_id) > 0 THEN 100 * sec / sum(sec) OVER (PARTITION BY call_id) ELSE 0.0 END, 6), 1) AS pct FROM h"""

ORACLES["repeated_lines"] = (
    r"""WITH l AS (SELECT source AS call_id, doc_id, k, trim(string_split(text, chr(10))[k]) AS x
  FROM documents, generate_series(1, len(string_split(text, chr(10)))) g(k) WHERE text IS NOT NULL),
c AS (SELECT call_id, x, count(*) AS n, min((doc_id, k)) AS first FROM l WHERE """
    + _TOKENS.format("x")
    + r""" >= 3 GROUP BY call_id, x HAVING count(*) > 1),
r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY n DESC, first) AS rank FROM c)
SELECT call_id, sum(n - 1)::BIGINT AS repeated, string_agg(x, ' / ' ORDER BY rank) FILTER (rank <= 3) AS examples FROM r GROUP BY call_id"""
)

ORACLES["buried_tail"] = f"""WITH {TURNS}, x AS (SELECT call_id, turn_id, strpos(text, '.') AS p, {_TOKENS.format("substr(text, strpos(text, '.') + 1)")} AS tail_words FROM turns)
SELECT call_id, turn_id, tail_words FROM x WHERE p > 0 AND tail_words >= 3"""

ORACLES["stretched_turns"] = (
    f"WITH {TURNS}"
    + r""", s AS (SELECT *, ("end" - start) * (turn_id % 5 + 1) AS seconds FROM turns)
SELECT call_id, turn_id, round(seconds, 3) AS seconds, len(regexp_extract_all(text, '\d'))::BIGINT AS digits FROM s
WHERE seconds >= 2.0 AND n_words / greatest(seconds, 1e-6) < 0.8
  AND NOT (len(regexp_extract_all(text, '\d')) >= greatest(4, floor(length(replace(text, ' ', '')) / 3)))"""
)

ORACLES["compare_metrics"] = f"""WITH {TURNS}, h AS (SELECT call_id, speaker, sum("end" - start) AS sec, count(*) AS n FROM turns GROUP BY ALL)
SELECT call_id, sum(n)::BIGINT AS turns, round(sum(sec), 2) AS speech_sec, round(round(coalesce(sum(n) / nullif(sum(sec) / 60, 0), 0), 6), 2) AS switch_rate,
  round(round(coalesce(100 * max(sec) / nullif(sum(sec), 0), 0), 6), 1) AS dominant_pct FROM h GROUP BY call_id"""

ORACLES["segment_majority"] = f"""WITH {SEGMENTS}, c AS (SELECT call_id, floor(start / 86400)::BIGINT AS day, speaker, count(*) AS n, min(idx) AS first FROM segments WHERE speaker IS NOT NULL GROUP BY ALL)
SELECT call_id, day, speaker FROM c QUALIFY row_number() OVER (PARTITION BY call_id, day ORDER BY n DESC, first) = 1"""

ORACLES["turn_islands"] = f"""WITH {SEGMENTS},
b AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN lag(speaker) OVER w IS DISTINCT FROM speaker OR round(start - lag("end") OVER w, 9) > 28800 THEN 1 ELSE 0 END AS b
  FROM segments WINDOW w AS (PARTITION BY call_id ORDER BY start, idx)),
i AS (SELECT *, sum(b) OVER (PARTITION BY call_id ORDER BY start, idx ROWS UNBOUNDED PRECEDING)::BIGINT AS turn_id FROM b)
SELECT call_id, turn_id, arg_min(speaker, (start, idx)) AS speaker, min(start) AS start, arg_max("end", (start, idx)) AS "end", count(*) AS n_words FROM i GROUP BY call_id, turn_id"""

_RUNS = """
r AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN lag({s}) OVER w IS DISTINCT FROM {s} THEN 1 ELSE 0 END AS b FROM segments WINDOW w AS (PARTITION BY call_id ORDER BY start, idx)),
r2 AS (SELECT *, sum(b) OVER (PARTITION BY call_id ORDER BY start, idx ROWS UNBOUNDED PRECEDING)::BIGINT AS run0 FROM r),
r3 AS (SELECT *, max("end") OVER (PARTITION BY call_id, run0 ORDER BY start, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sofar FROM r2),
r4 AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN sofar IS NULL OR start - sofar > 28800 THEN 1 ELSE 0 END AS b2 FROM r3 WINDOW w AS (PARTITION BY call_id ORDER BY start, idx)),
r5 AS (SELECT *, sum(b2) OVER (PARTITION BY call_id ORDER BY start, idx ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM r4),
runs AS (SELECT call_id, run, arg_min({s}, (start, idx)) AS speaker, min(start) AS start, max("end") AS "end", count(*) AS n FROM r5 GROUP BY call_id, run)"""
_SESSIONS = SEGMENTS + "," + _RUNS.replace("{s}", "'x'") + """,
sessions AS (SELECT call_id, run AS span_idx, start, "end" FROM runs)"""
_SHIFTED = """
shifted AS (SELECT call_id, idx, start + 900.0 * (idx % 9) AS start, "end" + 900.0 * (idx % 9) + 60 AS "end", speaker AS word FROM segments)"""

ORACLES["merge_runs"] = f"WITH {SEGMENTS}, {_RUNS.replace('{s}', 'speaker')} SELECT call_id, run, speaker, start, \"end\", n FROM runs"

ORACLES["plain_turns"] = f"""WITH {SEGMENTS},
b AS (SELECT *, coalesce(speaker, 'UNKNOWN') AS sp, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN lag(coalesce(speaker, 'UNKNOWN')) OVER w <> coalesce(speaker, 'UNKNOWN') THEN 1 ELSE 0 END AS b
  FROM segments WINDOW w AS (PARTITION BY call_id ORDER BY start, idx)),
i AS (SELECT *, sum(b) OVER (PARTITION BY call_id ORDER BY start, idx ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM b)
SELECT call_id, run, min(sp) AS speaker, min(start) AS start, max("end") AS "end", count(*) AS n FROM i GROUP BY call_id, run"""

ORACLES["speech_gaps"] = f"""WITH {_SESSIONS},
g AS (SELECT *, start - lag("end") OVER (PARTITION BY call_id ORDER BY start, span_idx) AS gap FROM sessions)
SELECT call_id, count(*) AS spans, round(sum("end" - start), 3) AS speech_sec, round(coalesce(max(gap), 0.0), 3) AS longest_gap, count(*) FILTER (gap > 43200) AS long_gaps FROM g GROUP BY call_id"""

ORACLES["assign_overlap"] = f"""WITH {SEGMENTS}, {_SHIFTED},
segs AS (SELECT call_id, idx AS seg_idx, speaker, start, "end" + 600 AS "end" FROM segments),
o AS (SELECT w.call_id, w.idx, s.speaker, round(sum(least(w."end", s."end") - greatest(w.start, s.start)), 9) AS shared, min(s.seg_idx) AS first
  FROM shifted w JOIN segs s ON w.call_id = s.call_id AND w.start < s."end" AND w."end" > s.start GROUP BY ALL),
best AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY call_id, idx ORDER BY shared DESC, first) = 1),
near AS (SELECT w.call_id, w.idx, s.speaker FROM shifted w JOIN segs s ON w.call_id = s.call_id
  WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.call_id = w.call_id AND b.idx = w.idx)
  QUALIFY row_number() OVER (PARTITION BY w.call_id, w.idx ORDER BY round(CASE WHEN (w.start + w."end") / 2 BETWEEN s.start AND s."end" THEN 0.0
    WHEN (w.start + w."end") / 2 < s.start THEN s.start - (w.start + w."end") / 2 ELSE (w.start + w."end") / 2 - s."end" END, 6), s.seg_idx) = 1)
SELECT w.call_id, w.idx, coalesce(b.speaker, n.speaker) AS assigned,
  round(CASE WHEN b.speaker IS NOT NULL THEN round(least(b.shared / greatest(w."end" - w.start, 1e-6), 1.0), 3) WHEN n.speaker IS NOT NULL THEN 0.0 END, 2) AS speaker_confidence
FROM shifted w LEFT JOIN best b ON b.call_id = w.call_id AND b.idx = w.idx LEFT JOIN near n ON n.call_id = w.call_id AND n.idx = w.idx"""

_LINE = """
line AS (SELECT call_id, span_idx, start, "end", sum("end" - start) OVER w AS next_cum, sum("end" - start) OVER w - ("end" - start) AS cum,
  lead(start) OVER (PARTITION BY call_id ORDER BY start, span_idx) AS next_start FROM sessions WINDOW w AS (PARTITION BY call_id ORDER BY start, span_idx ROWS UNBOUNDED PRECEDING))"""

ORACLES["timeline_remap"] = f"""WITH {_SESSIONS}, {_LINE},
p AS (SELECT call_id, idx, ((idx * 977) % 500000)::DOUBLE AS t FROM segments),
m AS (SELECT p.call_id, p.idx, p.t, l.* EXCLUDE (call_id) FROM p JOIN line l ON p.call_id = l.call_id
  QUALIFY row_number() OVER (PARTITION BY p.call_id, p.idx ORDER BY l.cum <= p.t DESC, CASE WHEN l.cum <= p.t THEN -l.cum ELSE l.cum END, CASE WHEN l.cum <= p.t THEN -l.span_idx ELSE l.span_idx END) = 1)
SELECT call_id, idx, round(CASE WHEN t <= cum THEN start WHEN next_start IS NOT NULL AND next_cum - t <= 60.0 + 1e-9 THEN next_start ELSE least(start + (t - cum), "end") END, 3) AS original FROM m"""

ORACLES["snap_to_spans"] = f"""WITH {_SESSIONS}, {_SHIFTED},
best AS (SELECT w.call_id, w.idx, s.start AS rs, s."end" AS re FROM shifted w JOIN sessions s ON w.call_id = s.call_id AND w.start < s."end" AND w."end" > s.start
  QUALIFY row_number() OVER (PARTITION BY w.call_id, w.idx ORDER BY round(least(w."end", s."end") - greatest(w.start, s.start), 9) DESC, s.span_idx) = 1),
side AS (SELECT w.call_id, w.idx, w.start, w."end", max(s."end") FILTER (s."end" <= w.start) AS eb, min(s.start) FILTER (s.start >= w.start) AS ea
  FROM shifted w LEFT JOIN sessions s ON w.call_id = s.call_id GROUP BY ALL),
d AS (SELECT side.*, rs, re, round(start - eb, 9) AS back, round(ea - "end", 9) AS ahead FROM side LEFT JOIN best USING (call_id, idx)),
n AS (SELECT *, round(CASE WHEN rs IS NOT NULL THEN greatest(start, rs) WHEN ahead IS NOT NULL AND ahead <= 7200 AND (back IS NULL OR ahead < back) THEN ea
    WHEN back IS NOT NULL AND back <= 7200 THEN eb - ("end" - start) END, 3) AS ns,
  round(CASE WHEN rs IS NOT NULL THEN least("end", re) WHEN ahead IS NOT NULL AND ahead <= 7200 AND (back IS NULL OR ahead < back) THEN ea + ("end" - start)
    WHEN back IS NOT NULL AND back <= 7200 THEN eb END, 3) AS ne FROM d),
f AS (SELECT call_id, idx, start, "end", CASE WHEN ns IS NOT NULL AND ne > ns THEN ns ELSE start END AS a, CASE WHEN ns IS NOT NULL AND ne > ns THEN ne ELSE "end" END AS b FROM n)
SELECT call_id, idx, round(a, 3) AS new_start, round(b, 3) AS new_end, abs(a - start) > 0.02 OR abs(b - "end") > 0.02 AS moved FROM f"""

ORACLES["attach_range"] = f"""WITH {_SESSIONS}, {_SHIFTED}
SELECT w.call_id, s.span_idx AS turn_id, w.idx FROM shifted w JOIN sessions s ON w.call_id = s.call_id AND w.start >= s.start - 30 AND w."end" <= s."end" + 30"""

ORACLES["cut_silence"] = f"WITH {_SESSIONS}, {_LINE} SELECT call_id, span_idx, round(cum, 3) AS cum, round(next_cum, 3) AS next_cum, next_start FROM line"

ORACLES["polish_windows"] = f"""WITH RECURSIVE {TURNS},
o AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY start, turn_id) AS k FROM turns),
f AS (SELECT call_id, turn_id, k, start AS first, 0 AS "window" FROM o WHERE k = 1 UNION ALL
  SELECT o.call_id, o.turn_id, o.k, CASE WHEN o."end" - f.first > 150 THEN o.start ELSE f.first END, f."window" + (o."end" - f.first > 150)::INT FROM f JOIN o ON o.call_id = f.call_id AND o.k = f.k + 1)
SELECT call_id, turn_id, "window" FROM f"""

ORACLES["sentence_vote"] = (
    f"WITH {WORDS}"
    + r""", m AS (SELECT * REPLACE (CASE WHEN idx % 7 = 3 THEN 'other' ELSE speaker END AS speaker), regexp_matches(word, '[.?!]\s*$') AS e FROM words),
s AS (SELECT *, coalesce(sum(e::INT) OVER (PARTITION BY call_id ORDER BY start, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent, count(*) OVER (PARTITION BY call_id) AS total FROM m),
c AS (SELECT call_id, sent, speaker, count(*) AS n FROM s GROUP BY ALL),
v AS (SELECT call_id, sent, arg_max(speaker, n) AS best, max(n) AS most, sum(n) AS alln FROM c GROUP BY call_id, sent),
o AS (SELECT s.*, CASE WHEN 2 * most > alln AND total >= 3 THEN best ELSE speaker END AS voted FROM s JOIN v USING (call_id, sent))
SELECT call_id, turn_id, count(*) AS n, count(*) FILTER (voted = 'other') AS others, count(*) FILTER (voted <> speaker) AS changed FROM o GROUP BY call_id, turn_id"""
)

ORACLES["collapse_minor"] = f"""WITH {TURNS},
talk AS (SELECT call_id, speaker, sum("end" - start) AS sec, min(turn_id) AS first FROM turns GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY round(sec, 6) DESC, first) AS rank, sec / sum(sec) OVER (PARTITION BY call_id) AS share FROM talk),
c AS (SELECT call_id, NOT bool_or(rank > 2 AND share > 0.15) AND bool_or(rank > 2) AS applied FROM rk GROUP BY call_id),
x AS (SELECT t.*, rk.rank <= 2 AS kept, c.applied FROM turns t JOIN rk USING (call_id, speaker) JOIN c USING (call_id)),
near AS (SELECT a.call_id, a.turn_id, b.speaker AS ns FROM x a JOIN x b ON a.call_id = b.call_id AND b.kept WHERE a.applied AND NOT a.kept
  QUALIFY row_number() OVER (PARTITION BY a.call_id, a.turn_id ORDER BY round(abs((a.start + a."end") / 2 - (b.start + b."end") / 2), 6), b.turn_id) = 1),
y AS (SELECT x.call_id, x.turn_id AS idx, coalesce(ns, speaker) AS speaker, start, "end", applied FROM x LEFT JOIN near USING (call_id, turn_id)),
segments AS (SELECT * FROM y WHERE applied), {_RUNS.replace('{s}', 'speaker').replace('28800', '5')}
SELECT call_id, run, speaker, round(start, 3) AS start, round("end", 3) AS "end", n, true AS applied FROM runs
UNION ALL SELECT call_id, idx::BIGINT, speaker, round(start, 3), round("end", 3), 1, false FROM y WHERE NOT applied"""

ORACLES["rename_first_seen"] = f"""WITH {TURNS}, f AS (SELECT call_id, speaker, min(turn_id) AS first FROM turns WHERE speaker IS NOT NULL GROUP BY ALL),
n AS (SELECT *, printf('SPEAKER_%02d', row_number() OVER (PARTITION BY call_id ORDER BY first, speaker) - 1) AS renamed FROM f)
SELECT t.call_id, t.turn_id, t.speaker, n.renamed FROM turns t LEFT JOIN n USING (call_id, speaker)"""

ORACLES["question_tails"] = (
    f"WITH {WORDS}"
    + r""", q AS (SELECT *, regexp_matches(word, '\.$') AND lead(idx) OVER (PARTITION BY call_id, turn_id ORDER BY idx) IS NOT NULL AS asks FROM words),
t AS (SELECT *, coalesce(sum(asks::INT) OVER (PARTITION BY call_id, turn_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS tail FROM q),
n AS (SELECT call_id, count(DISTINCT speaker) AS c, min(speaker) AS a, max(speaker) AS b FROM words GROUP BY call_id),
h AS (SELECT t.*, CASE WHEN tail > 0 AND c = 2 THEN CASE WHEN speaker = a THEN b ELSE a END ELSE speaker END AS handed FROM t JOIN n USING (call_id))
SELECT call_id, turn_id, handed, count(*) AS n, max(tail) AS tails FROM h GROUP BY ALL"""
)

_CANDIDATES = TURNS + """,
cand AS (SELECT *, 'plain' AS engine FROM turns UNION ALL SELECT * REPLACE (CASE WHEN turn_id % 4 = 3 THEN CASE WHEN speaker = 'user' THEN 'assistant' ELSE 'user' END ELSE speaker END AS speaker), 'moved' FROM turns)"""

ORACLES["arbitrate"] = f"""WITH {_CANDIDATES}, {_assess('cand', 'call_id, engine')}
SELECT call_id, engine, buried, n_problems FROM assessed QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY buried, n_problems, engine = 'moved') = 1"""

ORACLES["choose_engine"] = f"""WITH {_CANDIDATES}, {_assess('cand', 'call_id, engine')}
SELECT call_id, engine, dominant_pct FROM assessed QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY buried, abs(dominant_pct - 50), engine = 'moved') = 1"""

ORACLES["engine_matrix"] = f"""WITH {_CANDIDATES}, {_assess('cand', 'call_id, engine')}
SELECT call_id, max(dominant_pct) FILTER (engine = 'plain') AS plain, max(dominant_pct) FILTER (engine = 'moved') AS moved FROM assessed GROUP BY call_id"""

ORACLES["batch_report"] = f"""WITH {TURNS}, {_assess()},
s AS (SELECT *, CASE verdict WHEN 'unreliable' THEN 0 WHEN 'suspect' THEN 1 WHEN 'one-sided' THEN 2 WHEN 'empty' THEN 3 WHEN 'clean' THEN 4 ELSE 5 END AS severity FROM assessed)
SELECT call_id, verdict, severity, buried, row_number() OVER (ORDER BY severity, buried DESC, call_id) AS place FROM s"""

ORACLES["batch_totals"] = f"""WITH {TURNS}, {_assess()}, l AS (SELECT call_id, max("end") AS dur FROM turns GROUP BY call_id),
r AS (SELECT verdict, dur, CASE WHEN call_id % 11 = 0 THEN 'failed' ELSE 'ok' END AS status FROM assessed JOIN l USING (call_id))
SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'ok' AND verdict = 'clean') AS clean,
  count(*) FILTER (status = 'ok' AND verdict NOT IN ('clean', 'empty', 'one-sided')) AS flagged, count(*) FILTER (status = 'failed') AS failed, round(coalesce(sum(dur), 0) / 60, 2) AS minutes FROM r"""

ORACLES["variance_report"] = """SELECT o_orderpriority AS file, count(*) AS runs, round(avg(o_totalprice), 2) AS o_totalprice_mean, min(o_totalprice) AS o_totalprice_min,
  max(o_totalprice) AS o_totalprice_max, round(stddev_pop(o_totalprice), 2) AS o_totalprice_sd FROM orders GROUP BY 1"""

ORACLES["sweep_report"] = """WITH t(threshold) AS (VALUES (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE)),
r AS (SELECT threshold, count(*) AS words, round(sum(value), 2) AS speech_sec, count(DISTINCT user_id) AS speakers FROM events, t WHERE value / 500 >= threshold / 4 GROUP BY threshold),
a AS (SELECT *, round(100 * words / (SELECT count(*) FROM events WHERE value IS NOT NULL), 2) AS agree FROM r),
d AS (SELECT *, round(agree - (SELECT min(agree) FROM a WHERE threshold = 0.3), 4) AS delta FROM a)
SELECT *, CASE WHEN delta > 0.5 THEN 'better' WHEN delta < -0.5 THEN 'worse' ELSE 'no change' END AS label FROM d"""

ORACLES["incremental_todo"] = "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"

ORACLES["hesitation_dips"] = f"""WITH {SEGMENTS}, p AS (SELECT call_id, idx, speaker AS word, start, round(1 - ((idx * 7919) % 1000) / 2500.0, 4)::DOUBLE AS probability FROM segments),
n AS (SELECT *, lag(probability, 1, 1.0) OVER w AS b, lead(probability, 1, 1.0) OVER w AS a FROM p WINDOW w AS (PARTITION BY call_id ORDER BY start, idx)),
d AS (SELECT * FROM n WHERE probability < CASE WHEN start <= 30 THEN 0.88 ELSE 0.78 END AND least(a, b) >= CASE WHEN start <= 30 THEN 0.85 ELSE 0.90 END AND length(word) >= 2)
SELECT call_id, idx, probability, row_number() OVER (PARTITION BY call_id ORDER BY probability, start, idx) AS rank FROM d QUALIFY rank <= 20"""

_NORM = r"trim(lower(regexp_replace({0}, '[^\p{{L}}\p{{M}}\p{{N}}_ ]+', '', 'g')))"

ORACLES["anchor_trim"] = (
    f"WITH {TURNS}"
    + r""", n AS (SELECT call_id, turn_id, text, lag(text, 1, '') OVER w AS prev, lead(text, 1, '') OVER w AS nxt FROM turns WINDOW w AS (PARTITION BY call_id ORDER BY turn_id)),
toks AS (SELECT call_id, turn_id, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS t, list_filter(regexp_split_to_array(trim(prev), '\s+'), lambda x: x <> '') AS p, list_filter(regexp_split_to_array(trim(nxt), '\s+'), lambda x: x <> '') AS q FROM n),
ans AS (SELECT call_id, turn_id, p, q, list_concat(list_concat(p[greatest(len(p) - 2, 1):], t[1:6]), q[1:3]) AS a FROM toks),
nrm AS (SELECT *, [lower(regexp_replace(x, '[^\p{L}\p{M}\p{N}_]+', '', 'g')) for x in a] AS na, [lower(regexp_replace(x, '[^\p{L}\p{M}\p{N}_]+', '', 'g')) for x in p] AS np, [lower(regexp_replace(x, '[^\p{L}\p{M}\p{N}_]+', '', 'g')) for x in q] AS nq FROM ans),
c1 AS (SELECT *, coalesce((SELECT max(k) FROM generate_series(1, least(len(na), len(np))) g(k) WHERE na[1:k] = np[len(np) - k + 1:len(np)]), 0) AS k1 FROM nrm),
s1 AS (SELECT call_id, turn_id, a[k1 + 1:len(a)] AS a, na[k1 + 1:len(na)] AS na, nq FROM c1),
c2 AS (SELECT *, coalesce((SELECT max(k) FROM generate_series(1, least(len(na), len(nq))) g(k) WHERE na[len(na) - k + 1:len(na)] = nq[1:k]), 0) AS k2 FROM s1)
SELECT call_id, turn_id, array_to_string(a[1:len(a) - k2], ' ') AS trimmed FROM c2"""
)

ORACLES["guards"] = (
    f"WITH {TURNS}"
    + r""", n AS (SELECT call_id, turn_id, text, lead(text, 1, '') OVER (PARTITION BY call_id ORDER BY turn_id) AS nw FROM turns),
m AS (SELECT *, trim(lower(regexp_replace(nw, '[^\p{L}\p{M}\p{N}_ ]+', '', 'g'))) AS nn, trim(lower(regexp_replace(text, '[^\p{L}\p{M}\p{N}_ ]+', '', 'g'))) AS nt FROM n),
k AS (SELECT *, list_filter(string_split(nn, ' '), lambda x: x <> '') AS tk FROM m)
SELECT call_id, turn_id, NOT (length(text) >= 8 AND abs(length(nw) - length(text)) > greatest(4, floor(length(text) / 3))) AS rewrite_ok,
  length(replace(nw, ' ', '')) / greatest(length(replace(text, ' ', '')), 1) BETWEEN 0.45 AND 2.0 AND regexp_matches(nw, '[a-z]') AS polish_ok,
  len(tk) > 0 AND regexp_matches(nw, '[a-z]') AND length(replace(nn, ' ', '')) / greatest(length(replace(nt, ' ', '')), 1) BETWEEN 0.3 AND 3.0
    AND NOT EXISTS (SELECT 1 FROM generate_series(1, len(tk) - 4) g(i) WHERE len(list_distinct(tk[i:i + 4])) = 1) AS plausible FROM k"""
)

ORACLES["referee_votes"] = """WITH e AS (SELECT user_id AS call_id, ((event_id * 37) % 101) / 100.0 AS a, ((event_id * 53) % 101) / 100.0 AS b FROM events)
SELECT call_id, CASE WHEN round(b, 4) > round(a + 0.1, 4) AND b >= 0.7 THEN 'secondary' WHEN a >= 0.7 AND round(a - b, 4) >= 0.2 THEN 'primary-confirmed' ELSE 'unresolved' END AS resolved, count(*) AS n FROM e GROUP BY ALL"""

ORACLES["clean_text"] = r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[\x{200e}\x{200f}\x{061c}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{feff}]', '', 'g'), '\s+', ' ', 'g'))) AS squeezed,
  md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped, length(replace(text, ' ', ''))::BIGINT AS solid FROM documents WHERE text IS NOT NULL"""

ORACLES["clock_format"] = f"""WITH {SEGMENTS}, s AS (SELECT idx, round("end" - start, 3) * 37 AS s FROM segments),
i AS (SELECT idx, floor(s)::BIGINT AS t, floor(round(s * 1000, 6))::BIGINT AS ms FROM s)
SELECT idx, CASE WHEN t >= 3600 THEN printf('%d:%02d:%02d', t // 3600, t % 3600 // 60, t % 60) ELSE printf('%d:%02d', t // 60, t % 60) END AS clock,
  printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS srt FROM i"""

_UNIT = """
e AS (SELECT vec_id, label, [x::DOUBLE for x in embedding] AS v FROM embeddings),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS nrm FROM e),
vecs AS (SELECT vec_id, label, v, [x / nrm for x in v] AS uv FROM u)"""
_CENT = """
m AS (SELECT label, k AS pos, avg(v[k]) AS a, count(*) AS n FROM vecs, generate_series(1, 64) g(k) GROUP BY ALL),
ml AS (SELECT label, list(a ORDER BY pos) AS c, max(n) AS n FROM m GROUP BY label),
cents AS (SELECT label, n, [x / sqrt(list_dot_product(c, c)) for x in c] AS c FROM ml)"""

ORACLES["centroids"] = f"WITH {_UNIT}, {_CENT} SELECT label, n, (k - 1)::INT AS pos, round(c[k], 6) AS x FROM cents, generate_series(1, 64) g(k)"

_NEAR = """
sims AS (SELECT vec_id, w.label, c.label AS other, round(list_dot_product(uv, c.c), 9) AS sim FROM vecs w, cents c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, other) AS r FROM sims),
near AS (SELECT vec_id, max(other) FILTER (r = 1) AS best, max(sim) FILTER (r = 1) AS sim, max(sim) FILTER (r = 1) - coalesce(max(sim) FILTER (r = 2), -1.0) AS margin FROM ranked GROUP BY vec_id)"""

ORACLES["nearest_centroid"] = f"WITH {_UNIT}, {_CENT}, {_NEAR} SELECT vec_id, best, round(sim, 4) AS sim, round(margin, 4) AS margin FROM near"

ORACLES["purify"] = f"""WITH {_UNIT}, {_CENT},
own AS (SELECT w.vec_id, w.label, w.v, round(list_dot_product(uv, c.c), 9) AS sim FROM vecs w JOIN cents c USING (label)),
fl AS (SELECT label, round(quantile_cont(sim, 0.2), 9) AS f FROM own GROUP BY label),
pure AS (SELECT own.* FROM own JOIN fl USING (label) WHERE sim >= f),
pm AS (SELECT label, k AS pos, avg(v[k]) AS a FROM pure, generate_series(1, 64) g(k) GROUP BY ALL),
pl AS (SELECT label, list(a ORDER BY pos) AS c FROM pm GROUP BY label),
pc AS (SELECT label, [x / sqrt(list_dot_product(c, c)) for x in c] AS c FROM pl)
SELECT w.vec_id, w.label, p.label AS new_label FROM vecs w, pc p QUALIFY row_number() OVER (PARTITION BY w.vec_id ORDER BY round(list_dot_product(uv, p.c), 9) DESC, p.label) = 1"""

ORACLES["within_across"] = f"""WITH {_UNIT}, p AS (SELECT a.label = b.label AS same, 1 - list_dot_product(a.uv, b.uv) AS d FROM vecs a JOIN vecs b ON a.vec_id < b.vec_id)
SELECT round(avg(d) FILTER (same), 6) AS within, round(avg(d) FILTER (NOT same), 6) AS across, round(avg(d) FILTER (NOT same) - avg(d) FILTER (same), 6) AS gap FROM p"""

ORACLES["silhouette"] = f"""WITH {_UNIT}, p AS (SELECT a.vec_id, a.label, b.label AS other, sum(1 - list_dot_product(a.uv, b.uv)) AS s, count(*) AS n FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id GROUP BY ALL),
ab AS (SELECT vec_id, max(s / n) FILTER (label = other) AS a, min(s / n) FILTER (label <> other) AS b FROM p GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) <= 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS n FROM ab"""

ORACLES["level_frames"] = """WITH r AS (SELECT user_id % 10 AS call_id, event_type AS speaker, value, 20 * log10(value / 500) AS db FROM events WHERE value > 0),
m AS (SELECT call_id, speaker, median(db) AS m FROM r WHERE round(value, 9) >= 0.2 GROUP BY ALL)
SELECT call_id, speaker, round(m, 4) AS median_db, round(least(greatest(-20 - m, -12.0), 18.0), 4) AS gain_db FROM m QUALIFY count(*) OVER (PARTITION BY call_id) >= 2"""

ORACLES["level_spread"] = """WITH r AS (SELECT event_type, 20 * log10(value / 500) AS db FROM events WHERE value > 0)
SELECT event_type, round(quantile_cont(db, 0.9) - quantile_cont(db, 0.1), 4) AS spread_db, round(median(db), 4) AS median_db, count(*) AS n FROM r GROUP BY event_type"""

ORACLES["bandwidth_share"] = """WITH b AS (SELECT event_type AS call_id, floor(value / 5)::BIGINT AS hz, count(*)::DOUBLE AS power FROM events GROUP BY ALL),
c AS (SELECT *, round(sum(power) OVER (PARTITION BY call_id ORDER BY hz ROWS UNBOUNDED PRECEDING) / sum(power) OVER (PARTITION BY call_id), 12) AS s FROM b)
SELECT call_id, min(hz) AS bandwidth_hz FROM c WHERE s >= 0.99 GROUP BY call_id"""

ORACLES["clipped_runs"] = """WITH h AS (SELECT event_id % 3 AS call_id, event_id // 3 AS pos FROM events WHERE abs(value / 25) >= 0.9),
r AS (SELECT call_id, pos - row_number() OVER (PARTITION BY call_id ORDER BY pos) AS run FROM h),
n AS (SELECT call_id, run, count(*) AS n FROM r GROUP BY ALL HAVING count(*) >= 3)
SELECT call_id, count(*) AS runs, sum(n)::BIGINT AS clipped FROM n GROUP BY call_id"""

ORACLES["pack_windows"] = f"""WITH RECURSIVE {_SESSIONS},
o AS (SELECT call_id, start, "end", row_number() OVER w AS k, lead(start) OVER w AS following FROM sessions WINDOW w AS (PARTITION BY call_id ORDER BY start, span_idx)),
n AS (SELECT a.call_id, a.k, a.start, coalesce(min(b.k) FILTER (WHERE b.following IS NOT NULL AND b."end" - a.start BETWEEN 2 * 86400 AND 4 * 86400), max(b.k) FILTER (WHERE b."end" - a.start <= 4 * 86400 OR b.k = a.k)) AS cut
  FROM o a JOIN o b ON b.call_id = a.call_id AND b.k >= a.k GROUP BY ALL),
f AS (SELECT call_id, 0 AS "window", start, cut FROM n WHERE k = 1 UNION ALL SELECT n.call_id, f."window" + 1, n.start, n.cut FROM f JOIN n ON n.call_id = f.call_id AND n.k = f.cut + 1)
SELECT f.call_id, f."window", f.start, o."end" FROM f JOIN o ON o.call_id = f.call_id AND o.k = f.cut"""
