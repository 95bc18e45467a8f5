"""Queries of attribution, dispute, frame and voice operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import attribution as A
from ..operators import consensus as C
from ..operators import embeddings as V
from ..operators import intervals as I
from ..operators import quality as Q
from ..operators import report as R
from ..operators import signal as S
from ..sources import sinks
from . import tables as T
from .more import query
from .sql_tables import SEGMENTS, TURNS, WORDS

FRAMES_A_CALL = 100

#: Vectors as frames of a call: their first numbers are a level and probabilities of three tracks.
FRAMES = f"""frames AS (SELECT vec_id // {FRAMES_A_CALL} AS call_id, (vec_id % {FRAMES_A_CALL})::INT AS frame_idx, round(embedding[1]::DOUBLE, 4) AS a, round(embedding[2]::DOUBLE, 4) AS b, round(embedding[3]::DOUBLE, 4) AS c FROM embeddings)"""


def frames(spark, sf_dir):
    x = lambda k: F.round(F.get("embedding", k).cast("double"), 4)
    at = F.col("vec_id")
    rows = T.read(spark, sf_dir, "embeddings")
    return rows.select(F.floor(at / FRAMES_A_CALL).alias("call_id"), (at % FRAMES_A_CALL).cast("int").alias("frame_idx"), x(0).alias("a"), x(1).alias("b"), x(2).alias("c"))


def levels(spark, sf_dir):
    return frames(spark, sf_dir).select("call_id", "frame_idx", F.round(-90 + 300 * F.abs("a"), 2).alias("db"))


LEVELS = FRAMES + ", levels AS (SELECT call_id, frame_idx, round(-90 + 300 * abs(a), 2) AS db FROM frames)"


# ---- metrics -----------------------------------------------------------------------------


@query(f"""WITH {WORDS}, m AS (SELECT call_id, CASE WHEN idx % 13 <> 0 THEN speaker END AS speaker, CASE WHEN idx % 7 <> 3 THEN (idx % 10) / 10.0::DOUBLE END AS p FROM words),
w AS (SELECT call_id, count(*) AS words, count(DISTINCT speaker) AS speakers, coalesce(round(avg(p), 4), 0)::DOUBLE AS mean_word_confidence, count(*) FILTER (WHERE p < 0.5) AS low_confidence_words,
count(*) FILTER (WHERE speaker IS NULL) AS unattributed_words FROM m GROUP BY call_id), t AS (SELECT call_id, count(*) AS turns, round(max("end"), 2)::DOUBLE AS duration_sec FROM turns GROUP BY call_id)
SELECT call_id, turns, duration_sec, coalesce(words, 0) AS words, coalesce(speakers, 0) AS speakers, coalesce(mean_word_confidence, 0) AS mean_word_confidence,
coalesce(low_confidence_words, 0) AS low_confidence_words, coalesce(unattributed_words, 0) AS unattributed_words FROM t LEFT JOIN w USING (call_id)""")
def transcript_metrics(spark, sf_dir):
    words = T.words(spark, sf_dir).withColumns({"probability": F.when(F.col("idx") % 7 != 3, F.col("idx") % 10 / 10.0), "speaker": F.when(F.col("idx") % 13 != 0, F.col("speaker"))})
    return Q.transcript_metrics(T.turns(spark, sf_dir), words)


@query(f"""WITH {SEGMENTS}, h AS (SELECT call_id, speaker, round(sum("end" - start), 3)::DOUBLE AS seconds FROM segments GROUP BY ALL)
SELECT call_id, speaker, seconds, row_number() OVER (PARTITION BY call_id ORDER BY seconds DESC, speaker) > 2 AS surplus FROM h""")
def surplus_labels(spark, sf_dir):
    return A.surplus_labels(T.segments(spark, sf_dir), 2)


# ---- disputes ----------------------------------------------------------------------------


def _disputes(spark, sf_dir):
    """Every third turn as a dispute about its words."""
    words = T.words(spark, sf_dir).filter("turn_id % 3 = 0")
    held = words.groupBy("call_id", F.col("turn_id").alias("d_idx")).agg(F.sort_array(F.collect_list("idx")).alias("out_word_ids"), F.min("start").alias("start"), F.max("end").alias("end"))
    return held.withColumn("resolved", F.when(F.col("d_idx") % 2 == 0, "secondary"))


DISPUTES = WORDS + """, disputes AS (SELECT call_id, turn_id AS d_idx, list(idx ORDER BY idx) AS out_word_ids, min(start) AS start, max("end") AS "end", CASE WHEN turn_id % 2 = 0 THEN 'secondary' END AS resolved
FROM words WHERE turn_id % 3 = 0 GROUP BY ALL)"""


@query(f"""WITH {DISPUTES}, g AS (SELECT * FROM words WHERE idx % 3 <> 0)
SELECT call_id, d_idx, right(coalesce((SELECT string_agg(word, ' ' ORDER BY g.start, g.idx) FROM g WHERE g.call_id = d.call_id AND g."end" <= d.start), ''), 120) AS prev_text,
left(coalesce((SELECT string_agg(word, ' ' ORDER BY g.start, g.idx) FROM g WHERE g.call_id = d.call_id AND g.start >= d."end"), ''), 120) AS next_text FROM disputes d""")
def dispute_context(spark, sf_dir):
    words = T.words(spark, sf_dir).withColumn("agreement", F.col("idx") % 3 != 0)
    return C.context(_disputes(spark, sf_dir), words)


@query(f"""WITH {DISPUTES}, a AS (SELECT call_id, d_idx, start AS s, "end" AS e, out_word_ids, round((d_idx % 10) / 10.0, 1)::DOUBLE AS p FROM disputes WHERE d_idx % 10 >= 5),
n AS (SELECT call_id, round(s + k * greatest((e - s) / 3, 0.05), 3)::DOUBLE AS start, round(s + (k + 1) * greatest((e - s) / 3, 0.05), 3)::DOUBLE AS "end", ['<one>', '<two>', '<three>'][k + 1] AS word, p AS probability, 'rescue' AS source FROM a, generate_series(0, 2) g(k)),
gone AS (SELECT call_id, unnest(out_word_ids) AS idx FROM a)
SELECT call_id, start::DOUBLE AS start, "end"::DOUBLE AS "end", word, 0.9::DOUBLE AS probability, 'kept' AS source FROM words ANTI JOIN gone USING (call_id, idx) UNION ALL SELECT * FROM n""")
def spliced_words(spark, sf_dir):
    answers = _disputes(spark, sf_dir).select("call_id", "d_idx", "out_word_ids", F.lit("<one> <two> <three>").alias("text"), F.round(F.col("d_idx") % 10 / 10.0, 1).alias("confidence"))
    return C.splice(T.words(spark, sf_dir).withColumn("probability", F.lit(0.9)), answers)


@query(f"""WITH {DISPUTES} SELECT call_id, d_idx, row_number() OVER (PARTITION BY call_id ORDER BY start, d_idx)::INT AS turn FROM disputes WHERE resolved IS NULL
QUALIFY turn <= 2""")
def open_disputes(spark, sf_dir):
    return C.unresolved(C.mark_unresolved(_disputes(spark, sf_dir)), most=2).select("call_id", "d_idx", "turn")


@query("""WITH p AS (SELECT user_id AS call_id, event_id // 500 AS d_idx, event_id AS pos, (event_id % 7) / 7.0::DOUBLE AS cov_a, (event_id % 5) / 5.0::DOUBLE AS cov_b FROM events)
SELECT call_id, d_idx, pos, cov_a, cov_b FROM p QUALIFY row_number() OVER (PARTITION BY call_id, d_idx ORDER BY round(abs(cov_a - cov_b), 9) DESC, pos) = 1""")
def best_probes(spark, sf_dir):
    return C.best_probe(_probes(spark, sf_dir)).drop("text")


def _probes(spark, sf_dir):
    e = F.col("event_id")
    return T.read(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), F.floor(e / 500).alias("d_idx"), e.alias("pos"), F.lit("").alias("text"), (e % 7 / 7.0).alias("cov_a"), (e % 5 / 5.0).alias("cov_b"))


@query("""SELECT user_id AS call_id, event_id // 500 AS d_idx, CASE WHEN bool_and((event_id % 7) / 7.0::DOUBLE >= 0.7) THEN 'primary-confirmed' ELSE 'unresolved' END AS resolved FROM events GROUP BY ALL""")
def heard_hesitations(spark, sf_dir):
    return C.referee_hesitations(_probes(spark, sf_dir).withColumn("coverage", F.col("cov_a")))


@query(f"""WITH {TURNS}, c AS (SELECT call_id, count(*) AS n FROM turns GROUP BY call_id)
SELECT call_id, turn_id, CASE WHEN n % 2 = 0 THEN 'new' ELSE 'old' END AS kind FROM turns JOIN c USING (call_id)""")
def guarded_rows(spark, sf_dir):
    rows = T.turns(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("call_id"))
    last = F.max("turn_id").over(Window.partitionBy("call_id"))
    after = rows.withColumns({"_n": n, "_last": last}).filter("_n % 2 = 0 or turn_id < _last")
    pick = lambda df, kind: df.select("call_id", "turn_id", F.lit(kind).alias("kind"))
    return C.same_count_or_none(pick(rows, "old"), pick(after, "new"))


@query(f"""WITH RECURSIVE {WORDS}, o AS (SELECT call_id, idx, start + turn_id * 0.5 AS s, "end" + turn_id * 0.5 AS e, row_number() OVER (PARTITION BY call_id ORDER BY start, idx) AS k FROM words),
f AS (SELECT call_id, idx, k, s AS first, e AS last, 0 AS chunk FROM o WHERE k = 1 UNION ALL
SELECT o.call_id, o.idx, o.k, CASE WHEN o.e - f.first > 20 AND o.s - f.last > 0.15 THEN o.s ELSE f.first END, o.e, f.chunk + (o.e - f.first > 20 AND o.s - f.last > 0.15)::INT FROM f JOIN o ON o.call_id = f.call_id AND o.k = f.k + 1)
SELECT call_id, idx, chunk FROM f""")
def alignment_chunks(spark, sf_dir):
    later = F.col("turn_id") * 0.5
    words = T.words(spark, sf_dir).withColumns({"start": F.col("start") + later, "end": F.col("end") + later})
    return C.align_chunks(words).select("call_id", "idx", "chunk")


@query(f"""WITH {FRAMES} SELECT call_id, frame_idx // 3 AS token_idx, round(min(frame_idx) * 0.02, 3)::DOUBLE AS start, round((max(frame_idx) + 1) * 0.02, 3)::DOUBLE AS "end", round(avg(a), 3)::DOUBLE + 0.0 AS align_score, round(avg(a), 3) >= 0.05 AS ok
FROM frames WHERE frame_idx % 10 <> 0 GROUP BY ALL""")
def word_ends(spark, sf_dir):
    path = frames(spark, sf_dir).select("call_id", "frame_idx", F.when(F.col("frame_idx") % 10 != 0, F.floor(F.col("frame_idx") / 3)).alias("token_idx"), F.col("a").alias("score"))
    return C.ends_of_frames(path, 0.02, least=0.05)


# ---- attribution -------------------------------------------------------------------------


@query(f"""WITH {TURNS}, k AS (SELECT call_id, list(DISTINCT speaker) AS known FROM turns GROUP BY call_id),
e AS (SELECT *, turn_id % 4 AS m, text = '' OR trim(text) = '' AS bare FROM turns JOIN k USING (call_id)),
p AS (SELECT *, m = 0 AND NOT bare AND list_contains(known, 'user') AS split_ok, m < 2 AND list_contains(known, 'assistant') AS label_ok FROM e)
SELECT call_id, turn_id, part::INT AS part, CASE WHEN split_ok THEN 'user' WHEN label_ok THEN 'assistant' ELSE speaker END AS speaker, text,
CASE WHEN m = 3 THEN 'none' WHEN split_ok THEN 'split' WHEN label_ok THEN 'label' ELSE 'refused' END AS edit FROM p, (SELECT 0 AS part)""")
def edited_turns(spark, sf_dir):
    """A quarter each of splits that hold the text, splits that don't, labels that nobody has, and no edit."""
    t = T.turns(spark, sf_dir)
    m = F.col("turn_id") % 4
    part = F.struct(F.when(m == 1, F.concat("text", F.lit(" more"))).otherwise(F.col("text")).alias("text"), F.lit("user").alias("speaker"))
    last = t.filter(m < 3).select("call_id", F.col("turn_id").alias("i"), F.lit(2).alias("pos"), F.when(m < 2, "assistant").otherwise("nobody").alias("speaker"), F.when(m < 2, F.array(part)).alias("split"))
    first = last.withColumns({"pos": F.lit(1), "speaker": F.lit("nobody")})
    return A.apply_edits(t, first.unionByName(last))


@query(f"""WITH {SEGMENTS}, o AS (SELECT *, ("end" - start >= 20 OR row_number() OVER w = 1)::INT AS own FROM segments WINDOW w AS (PARTITION BY call_id ORDER BY start, idx)),
g AS (SELECT *, sum(own) OVER (PARTITION BY call_id ORDER BY start, idx ROWS UNBOUNDED PRECEDING) AS g FROM o),
t AS (SELECT call_id, g, arg_min(speaker, (start, idx)) AS speaker, min(start) AS start, max("end") AS "end", min(idx) AS idx FROM g GROUP BY ALL),
c AS (SELECT *, (lag(speaker) OVER w IS DISTINCT FROM speaker)::INT AS new FROM t WINDOW w AS (PARTITION BY call_id ORDER BY start, idx)),
r AS (SELECT *, sum(new) OVER (PARTITION BY call_id ORDER BY start, idx ROWS UNBOUNDED PRECEDING) - 1 AS run FROM c)
SELECT call_id, run::BIGINT AS run, first(speaker) AS speaker, min(start) AS start, max("end") AS "end", count(*) AS n FROM r GROUP BY call_id, run""")
def absorbed_flicker(spark, sf_dir):
    out = A.absorb_flicker(T.segments(spark, sf_dir), least=20.0)
    first = F.min("run").over(Window.partitionBy("call_id"))
    return out.select("call_id", (F.col("run") - first).cast("long").alias("run"), "speaker", "start", "end", "n")


@query(f"""WITH {SEGMENTS}, m AS (SELECT call_id, idx, start AS t, length(speaker) AS label, lag(start) OVER w AS b, lead(start) OVER w AS f, lag(length(speaker)) OVER w AS pl FROM segments WINDOW w AS (PARTITION BY call_id ORDER BY idx)),
g AS (SELECT *, sum((pl IS DISTINCT FROM label OR t - b > 7200)::INT) OVER (PARTITION BY call_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - 1 AS turn_id FROM m)
SELECT call_id, turn_id::BIGINT AS turn_id, printf('SPEAKER_%02d', first(label)) AS speaker, round(arg_min(coalesce((b + t) / 2, t), idx), 4)::DOUBLE AS start, round(arg_max(coalesce((f + t) / 2, t + 0.25), idx), 4)::DOUBLE AS "end" FROM g GROUP BY call_id, turn_id""")
def window_turns(spark, sf_dir):
    rows = T.segments(spark, sf_dir).select("call_id", F.col("idx").alias("win_idx"), F.col("start").alias("time"), F.length("speaker").alias("label"))
    out = A.turns_from_windows(rows, gap=7200.0)
    first = F.min("turn_id").over(Window.partitionBy("call_id"))
    return out.select("call_id", (F.col("turn_id") - first).cast("long").alias("turn_id"), "speaker", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


@query(f"""WITH {FRAMES}, tall AS (SELECT call_id, frame_idx, k - 1 AS track, round(10 * [a, b, c][k], 4) AS prob FROM frames, generate_series(1, 3) g(k)),
act AS (SELECT call_id, track, count(*) FILTER (WHERE prob >= 0.5) * 0.08 AS sec, min(frame_idx) FILTER (WHERE prob >= 0.5) AS first FROM tall GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY sec DESC, track) AS rk FROM act),
kept AS (SELECT call_id, track, printf('SPEAKER_%02d', row_number() OVER (PARTITION BY call_id ORDER BY first NULLS FIRST, track) - 1) AS speaker FROM r WHERE (sec >= 2 OR rk = 1) AND rk <= 2),
best AS (SELECT call_id, frame_idx, arg_max(speaker, (prob, -track)) AS speaker FROM tall JOIN kept USING (call_id, track) WHERE prob >= 0.5 GROUP BY ALL),
c AS (SELECT *, (lag(speaker) OVER w IS DISTINCT FROM speaker OR frame_idx - lag(frame_idx) OVER w > 1)::INT AS new FROM best WINDOW w AS (PARTITION BY call_id ORDER BY frame_idx)),
g AS (SELECT *, sum(new) OVER (PARTITION BY call_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS g FROM c),
o AS (SELECT call_id, first(speaker) AS speaker, round(min(frame_idx) * 0.08, 3)::DOUBLE AS start, round((max(frame_idx) + 1) * 0.08, 3)::DOUBLE AS "end" FROM g GROUP BY call_id, g)
SELECT * FROM o WHERE "end" - start >= 0.2 - 1e-9""")
def track_turns(spark, sf_dir):
    rows = frames(spark, sf_dir).select("call_id", "frame_idx", F.array(*(F.round(10 * F.col(x), 4) for x in "abc")).alias("probs"))
    return A.track_turns(rows, speakers=2).select("call_id", "speaker", "start", "end")


# ---- windows -----------------------------------------------------------------------------


@query(f"""WITH {WORDS}, l AS (SELECT call_id, max("end") AS z FROM words GROUP BY call_id), v AS (SELECT call_id, k, greatest(k * 20 - 3, 0)::DOUBLE AS a, (k * 20 + 23)::DOUBLE AS b FROM l, generate_series(0, floor(z / 20)::BIGINT) g(k)),
n AS (SELECT *, (lag(b) OVER w + a) / 2 AS low, (lead(a) OVER w + b) / 2 AS high FROM v WINDOW w AS (PARTITION BY call_id ORDER BY k))
SELECT w.call_id, n.k AS "window", w.idx, round(w.start, 3)::DOUBLE AS start, round(w."end", 3)::DOUBLE AS "end" FROM words w JOIN n ON w.call_id = n.call_id AND w.start >= a AND w.start < b AND (low IS NULL OR w.start >= low) AND (high IS NULL OR w.start < high)""")
def stitched_words(spark, sf_dir):
    words = T.words(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("z") / 20))).alias("window")
    windows = words.groupBy("call_id").agg(F.max("end").alias("z")).select("call_id", k)
    windows = windows.withColumns({"start": F.greatest(F.col("window") * 20 - 3, F.lit(0)).cast("double"), "end": (F.col("window") * 20 + 23).cast("double")})
    bounds = windows.select("call_id", "window", F.col("start").alias("a"), F.col("end").alias("b"))
    heard = words.join(bounds, "call_id").filter("start >= a and start < b").withColumns({"start": F.col("start") - F.col("a"), "end": F.col("end") - F.col("a")})
    return I.stitch(windows, heard.select("call_id", "window", "idx", "start", "end"))


@query(f"""WITH {TURNS}, n AS (SELECT call_id, turn_id AS span_idx, start, greatest(0, floor(("end" - start - 1.5) / 0.25 + 1e-9))::INT AS n FROM turns),
v AS (SELECT call_id, span_idx, k AS win_idx, start + k * 0.25 AS start, start + k * 0.25 + 1.5 AS "end" FROM n, generate_series(0, n) g(k)),
h AS (SELECT v.*, sum(least(v."end", t.start + 4) - greatest(v.start, t.start)) AS s FROM v JOIN turns t ON t.call_id = v.call_id AND v.start < t.start + 4 AND v."end" > t.start WHERE t.turn_id % 2 = 0 GROUP BY ALL)
SELECT call_id, span_idx, win_idx::INT AS win_idx, round(start, 3)::DOUBLE AS start, round("end", 3)::DOUBLE AS "end" FROM h WHERE round(s / 1.5, 9) >= 0.5""")
def voiced_windows(spark, sf_dir):
    turns = T.turns(spark, sf_dir)
    voiced = turns.filter("turn_id % 2 = 0").select("call_id", "start", (F.col("start") + 4).alias("end"))
    out = V.window_plan(turns.withColumnRenamed("turn_id", "span_idx"), voiced=voiced)
    return out.select("call_id", "span_idx", "win_idx", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query(f"""WITH {WORDS} SELECT call_id, idx, round(greatest(m - h, 0), 6)::DOUBLE AS span_start, round(m + h, 6)::DOUBLE AS span_end
FROM (SELECT call_id, idx, (start + "end") / 2 AS m, greatest(("end" - start) / 2 + 0.15, 0.2) AS h FROM words)""")
def word_spans(spark, sf_dir):
    return V.word_spans(T.words(spark, sf_dir)).select("call_id", "idx", F.round("span_start", 6).alias("span_start"), F.round("span_end", 6).alias("span_end"))


# ---- frames ------------------------------------------------------------------------------


@query(f"""WITH {FRAMES}, h AS (SELECT call_id, frame_idx, round(frame_idx * 0.1, 6) AS s FROM frames WHERE a > 0.1), c AS (SELECT *, coalesce(frame_idx - lag(frame_idx) OVER w > 4, true)::INT AS new FROM h WINDOW w AS (PARTITION BY call_id ORDER BY frame_idx)),
g AS (SELECT *, sum(new) OVER (PARTITION BY call_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS g FROM c)
SELECT call_id, round(min(frame_idx) * 0.1, 3)::DOUBLE AS start, round((max(frame_idx) + 1) * 0.1, 3)::DOUBLE AS "end" FROM g GROUP BY call_id, g""")
def sound_runs(spark, sf_dir):
    out = I.sound_runs(frames(spark, sf_dir), F.col("a") > 0.1, 0.1)
    return out.select("call_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query(f"""WITH {LEVELS}, f AS (SELECT call_id, quantile_cont(db, 0.2) FILTER (WHERE db > -80) AS floor FROM levels GROUP BY call_id)
SELECT call_id, frame_idx, coalesce(round(db - floor, 6) > 6, false) AS voiced FROM levels JOIN f USING (call_id)""")
def energy_gate(spark, sf_dir):
    return S.energy_gate(levels(spark, sf_dir)).select("call_id", "frame_idx", "voiced")


@query(f"""WITH {LEVELS}, m AS (SELECT call_id, quantile_cont(db, 0.5) AS m FROM levels GROUP BY call_id)
SELECT call_id, count(*) AS frames, round(coalesce(abs(avg(db) FILTER (WHERE db > m) - avg(db) FILTER (WHERE db <= m)) / nullif(stddev_pop(db), 0), 0), 3)::DOUBLE AS bimodality,
round(coalesce(quantile_cont(db, 0.9) FILTER (WHERE db > -80) - quantile_cont(db, 0.1) FILTER (WHERE db > -80), 0), 3)::DOUBLE AS snr_db, round(100 * avg((db <= -80)::INT), 2)::DOUBLE AS digital_silence_pct
FROM levels JOIN m USING (call_id) GROUP BY call_id""")
def level_shape(spark, sf_dir):
    rows = levels(spark, sf_dir)
    return rows.groupBy("call_id").agg(F.count("*").alias("frames")).join(S.activity(rows, keys=("call_id",)).select("call_id", "bimodality", "snr_db", "digital_silence_pct"), "call_id")


@query(f"""WITH {FRAMES} SELECT call_id, frame_idx, round(0.25 * coalesce(lag(a) OVER w, 0) + 0.5 * a + 0.25 * coalesce(lead(a) OVER w, 0), 6)::DOUBLE AS gain FROM frames WINDOW w AS (PARTITION BY call_id ORDER BY frame_idx)""")
def smoothed_gains(spark, sf_dir):
    return S.smooth(frames(spark, sf_dir).withColumnRenamed("a", "gain")).select("call_id", "frame_idx", F.round("gain", 6).alias("gain"))


@query(f"""WITH {FRAMES} SELECT call_id, round(corr(l, r), 4)::DOUBLE AS correlation, CASE WHEN round(corr(l, r), 4) > 0.98 THEN 'dual-mono' ELSE 'true-stereo' END AS relation
FROM (SELECT call_id, a AS l, CASE WHEN call_id % 2 = 0 THEN a + 0.01 * b ELSE b END AS r FROM frames) GROUP BY call_id""")
def channel_relation(spark, sf_dir):
    right = F.when(F.col("call_id") % 2 == 0, F.col("a") + 0.01 * F.col("b")).otherwise(F.col("b"))
    return S.channel_relation(frames(spark, sf_dir).select("call_id", F.col("a").alias("left"), right.alias("right")))


@query(f"""WITH {FRAMES} SELECT call_id, count(DISTINCT x) AS levels, round(log2(greatest(count(DISTINCT x), 1)), 3)::DOUBLE AS bits FROM (SELECT call_id, round(a * 50) AS x FROM frames) GROUP BY call_id""")
def level_counts(spark, sf_dir):
    return S.level_counts(frames(spark, sf_dir).select("call_id", F.round(F.col("a") * 50).alias("x")))


@query("""WITH p AS (SELECT event_id, (event_id * 37 % 9000) AS bw, event_id % 5 AS clipped, -(event_id % 50)::DOUBLE AS mean, -(event_id % 3)::DOUBLE AS peak, event_id * 101 % 64000 AS br, event_id * 13 % 48000 AS sr, event_id % 4 = 0 AS dual, event_id % 16 AS bits FROM events)
SELECT event_id, (bw < 4200)::INT + (clipped > 0)::INT + (mean < -35)::INT + (peak > -0.1)::INT + (br < 24000)::INT + (sr < 16000)::INT + dual::INT + (bits < 7)::INT AS notes, bw < 4200 AS narrow FROM p""")
def profile_notes(spark, sf_dir):
    e = F.col("event_id")
    row = T.read(spark, sf_dir, "events").select(
        "event_id", (e * 37 % 9000).alias("bandwidth_hz"), (e % 5).alias("clipped"), (-(e % 50)).cast("double").alias("mean_db"), (-(e % 3)).cast("double").alias("peak_db"),
        (e * 101 % 64000).alias("bit_rate"), (e * 13 % 48000).alias("sample_rate"), F.when(e % 4 == 0, "dual-mono").otherwise("true-stereo").alias("relation"), (e % 16).alias("bits"),
    )
    return row.select("event_id", F.size(S.profile_notes()).alias("notes"), S.narrowband(F.col("bandwidth_hz")).alias("narrow"))


# ---- voices ------------------------------------------------------------------------------


@query("""SELECT round(quantile_cont(d, 0.5), 6)::DOUBLE AS median, round(quantile_cont(d, 0.9), 6)::DOUBLE AS p90, round(max(d), 6)::DOUBLE AS most, count(*) AS n
FROM (SELECT round(abs(embedding[1]::DOUBLE), 6) AS d FROM embeddings ORDER BY vec_id LIMIT 40)""")
def control_distances(spark, sf_dir):
    """The operator itself takes the first 40 pairs of its control arm."""
    pairs = T.read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "idx")
    return V.split_half_control(pairs, F.round(F.abs(F.get("embedding", 0).cast("double")), 6))


@query("""SELECT event_id, CASE WHEN s < 0.1 THEN 'voices can''t be told apart' WHEN s < 0.2 THEN 'voices are hard to tell apart' END AS note, s < 0.15 OR d > 0.85 AS weak
FROM (SELECT event_id, (event_id % 40) / 100.0::DOUBLE AS s, (event_id % 100) / 100.0::DOUBLE AS d FROM events)""")
def separation_notes(spark, sf_dir):
    s, d = F.col("event_id") % 40 / 100.0, F.col("event_id") % 100 / 100.0
    return T.read(spark, sf_dir, "events").select("event_id", V.separation_note(s).alias("note"), V.weak_voice(s, d).alias("weak"))


# ---- sinks and batches -------------------------------------------------------------------


@query(f"""WITH {WORDS}, m AS (SELECT call_id, turn_id, idx, word, start + turn_id * 3 AS s FROM words), l AS (SELECT call_id, turn_id, min(s) AS s, string_agg(word, ' ' ORDER BY idx) AS t FROM m GROUP BY ALL)
SELECT call_id, count(*) AS lines, length(string_agg(t, chr(10))) AS letters FROM l GROUP BY call_id""")
def timed_lines(spark, sf_dir):
    later = F.col("turn_id") * 3.0
    words = T.words(spark, sf_dir).withColumns({"start": F.col("start") + later, "end": F.col("end") + later})
    lines = F.split("value", "\n")
    bare = F.transform(lines, lambda x: F.regexp_replace(x, r"^\[[0-9:]+\] ", ""))
    return sinks.timed_lines(words).select("call_id", F.size(lines).cast("long").alias("lines"), F.length(F.array_join(bare, "\n")).cast("long").alias("letters"))


@query("""SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN 'good' ELSE 'bad' END AS part FROM events""")
def sorted_out(spark, sf_dir):
    rows = T.read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, "no sound").alias("error"))
    good, bad = R.sort_out(rows)
    return good.select("event_id", F.lit("good").alias("part")).unionByName(bad.select("event_id", F.lit("bad").alias("part")))
