"""Queries of the smaller operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import consensus as C
from ..operators import intervals as I
from ..operators import report as R
from ..sources import sinks
from . import tables as T
from .sql_tables import TURNS, WORDS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


@query("""SELECT event_type AS model, count(*) AS calls, sum(user_id)::BIGINT AS tokens_in, sum(event_id)::BIGINT AS tokens_out,
round((sum(user_id)::BIGINT * 5.0::DOUBLE + sum(event_id)::BIGINT * 25.0::DOUBLE) / 1e6, 6) AS cost FROM events GROUP BY event_type""")
def usage_costs(spark, sf_dir):
    calls = T.read(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("tokens_in"), F.col("event_id").alias("tokens_out"))
    prices = calls.select("model").distinct().withColumns({"in_per_million": F.lit(5.0), "out_per_million": F.lit(25.0)})
    return R.usage_cost(calls, prices)


@query("SELECT user_id AS call_id, round(avg(exp(-value / 1000)), 4) AS probability FROM events GROUP BY user_id")
def token_probability(spark, sf_dir):
    rows = T.read(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), (-F.col("value") / 1000).alias("logprob"))
    return R.mean_token_probability(rows)


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 50)::DOUBLE WHEN 1 THEN least(event_id % 300, 180)::DOUBLE ELSE 8.0::DOUBLE * (event_id % 5 + 1) END AS wait FROM events""")
def retry_waits(spark, sf_dir):
    e = F.col("event_id")
    header = F.when(e % 4 == 0, (e % 50).cast("string")).when(e % 4 == 2, F.lit("soon"))
    body = F.when(e % 4 == 1, F.concat(F.lit('{"retryDelay": "'), (e % 300).cast("string"), F.lit('s"}'))).otherwise(F.lit("{}"))
    return T.read(spark, sf_dir, "events").select("event_id", X.retry_wait(header, body, e % 5).alias("wait"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'exhausted' WHEN 2 THEN 'exhausted' WHEN 3 THEN CASE WHEN user_id % 2 = 0 THEN 'exhausted' ELSE 'retry' END ELSE 'fatal' END AS kind FROM events""")
def error_kinds(spark, sf_dir):
    code = F.element_at(F.array(*map(F.lit, (200, 402, 404, 429, 500, 403))), (F.col("event_id") % 6 + 1).cast("int"))
    body = F.when(F.col("user_id") % 2 == 0, "limit of requests per day").otherwise("limit of requests per minute")
    return T.read(spark, sf_dir, "events").select("event_id", X.error_kind(code, body).alias("kind"))


@query(f"""WITH {WORDS} SELECT call_id, idx, round(start * 0.85 + call_id % 7 * 10, 3)::DOUBLE AS start, round("end" * 0.85 + call_id % 7 * 10, 3)::DOUBLE AS "end" FROM words""")
def rescaled_words(spark, sf_dir):
    moved = I.rescale(T.words(spark, sf_dir), 0.85, (F.col("call_id") % 7 * 10).cast("double"))
    return moved.select("call_id", "idx", "start", "end")


@query(f"""WITH {TURNS}, c AS (SELECT call_id, (max("end") * 100)::DOUBLE AS s FROM turns GROUP BY call_id)
SELECT call_id, k::INT AS chunk, (k * 1200)::DOUBLE AS "offset", least(1200.0::DOUBLE, s - k * 1200) AS length
FROM c, generate_series(0, greatest(1, ceil(s / 1200))::BIGINT - 1) g(k)""")
def chunk_plans(spark, sf_dir):
    calls = T.turns(spark, sf_dir).groupBy("call_id").agg((F.max("end") * 100).cast("double").alias("sec"))
    return I.chunk_plan(calls, F.col("sec"))


@query(f"""WITH {WORDS} SELECT t.call_id, t.turn_id, w.idx FROM turns t JOIN words w ON t.call_id = w.call_id AND w.start + 0.1 >= t.start AND w.start + 0.1 < t."end" """)
def attach_half_open(spark, sf_dir):
    words = T.words(spark, sf_dir).withColumns({"start": F.col("start") + 0.1, "end": F.col("end") + 0.1})
    return I.attach_words(T.turns(spark, sf_dir), words, slack=0.0, half_open=True)


@query("""WITH r AS (SELECT event_type AS file, user_id % 10 AS threshold, count(*) AS words FROM events GROUP BY ALL)
SELECT file, threshold, words FROM r QUALIFY row_number() OVER (PARTITION BY file ORDER BY words DESC, threshold) = 1""")
def most_words(spark, sf_dir):
    rows = T.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("file"), (F.col("user_id") % 10).alias("threshold")).agg(F.count("*").alias("words"))
    return R.most_words(rows, "threshold")


@query("""SELECT conv_id AS call_id, turn::INT AS turn_id, text AS before, text || ' indeed' AS "after" FROM conversations WHERE text IS NOT NULL AND turn % 3 = 0""")
def text_changes(spark, sf_dir):
    turns = T.turns(spark, sf_dir)
    after = turns.withColumn("text", F.when(F.col("turn_id") % 3 == 0, F.concat("text", F.lit(" indeed"))).otherwise(F.col("text")))
    return R.changes(turns, after, ["call_id", "turn_id"])


@query("""WITH t AS (SELECT conv_id AS call_id, turn::INT AS turn_id, text, CASE WHEN turn % 2 = 0 THEN text || repeat('!', (turn % 9)::INT) END AS new FROM conversations WHERE text IS NOT NULL)
SELECT call_id, turn_id, CASE WHEN new IS NOT NULL AND NOT (length(text) >= 8 AND length(new) - length(text) > greatest(4, length(text) // 3)) THEN new ELSE text END AS text FROM t""")
def polished_turns(spark, sf_dir):
    turns = T.turns(spark, sf_dir)
    answers = turns.filter("turn_id % 2 = 0").withColumn("text", F.concat("text", F.repeat(F.lit("!"), (F.col("turn_id") % 9).cast("int"))))
    return R.polished(turns, answers, X.rewrite_ok).select("call_id", "turn_id", "text")


@query(f"""WITH {WORDS}, b AS (SELECT call_id, turn_id, min(start) AS low, max("end") AS high FROM words GROUP BY ALL),
m AS (SELECT w.call_id, w.idx, w.start AS s, w."end" AS e, b.low, (low * 2 + 1)::DOUBLE AS a, greatest((high - low) / 2, 0.05)::DOUBLE / greatest(high - low, 1e-6) AS k FROM words w JOIN b USING (call_id, turn_id))
SELECT call_id, idx, round(a + (s - low) * k, 3)::DOUBLE AS start, round(a + (e - low) * k, 3)::DOUBLE AS "end" FROM m""")
def rebased_words(spark, sf_dir):
    words = T.words(spark, sf_dir)
    targets = words.groupBy("call_id", "turn_id").agg((F.min("start") * 2 + 1).alias("a_start"), (F.min("start") * 2 + 1 + (F.max("end") - F.min("start")) / 2).alias("a_end"))
    return C.rebase(words, targets, ("call_id", "turn_id")).select("call_id", "idx", "start", "end")


@query(f"""WITH {WORDS} SELECT call_id, count(*) FILTER (WHERE right(word, 1) IN ('.', '?', '!')) AS sentences FROM words GROUP BY call_id""")
def sentence_ends(spark, sf_dir):
    return T.words(spark, sf_dir).groupBy("call_id").agg(F.count_if(X.ends_sentence(F.col("word"))).alias("sentences"))


@query("""SELECT event_id, props AS block, NULL::VARCHAR AS none FROM events WHERE props IS NOT NULL""")
def json_blocks(spark, sf_dir):
    rows = T.read(spark, sf_dir, "events").filter("props is not null")
    answer = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n``` as asked"))
    return rows.select("event_id", X.json_block(answer).alias("block"), X.json_block(answer, "[").alias("none"))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '0:12 ' || text WHEN regexp_matches(text, '(?m)^\d{1,2}:\d{2}') THEN regexp_extract(text, '(?ms)(^\d{1,2}:\d{2}.*)\z', 1) ELSE 'Sure:' || chr(10) || text END AS text
FROM documents WHERE text IS NOT NULL""")
def shaved_preambles(spark, sf_dir):
    rows = T.read(spark, sf_dir, "documents").filter("text is not null")
    answer = F.concat(F.lit("Sure:\n"), F.when(F.col("doc_id") % 2 == 0, "0:12 ").otherwise(""), F.col("text"))
    return rows.select("doc_id", X.shave_preamble(answer).alias("text"))


@query("SELECT doc_id, (4 * ((strlen(text) + 2) // 3))::INT AS size FROM documents WHERE text IS NOT NULL")
def payload_sizes(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", X.payload_size(F.encode("text", "UTF-8")).alias("size"))


_SRT = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@query(f"""WITH {TURNS}, m AS (SELECT *, round(start * 1000)::BIGINT AS a, round("end" * 1000)::BIGINT AS z, row_number() OVER (PARTITION BY call_id ORDER BY start, turn_id) AS k FROM turns)
SELECT call_id, string_agg(k || chr(10) || {_SRT.format('a')} || ' --> ' || {_SRT.format('z')} || chr(10) || coalesce(speaker, '?') || ': ' || text, chr(10) || chr(10) ORDER BY k) || chr(10) AS value FROM m GROUP BY call_id""")
def subtitles(spark, sf_dir):
    return sinks.subtitles(T.turns(spark, sf_dir))


@query(f"""WITH {TURNS}, l AS (SELECT call_id, "end" - start AS s FROM turns)
SELECT call_id, count(*) AS windows, round(round(quantile_cont(s, 0.5), 6), 1)::DOUBLE AS median_sec, round(round(min(s), 6), 1)::DOUBLE AS least_sec, round(round(max(s), 6), 1)::DOUBLE AS most_sec FROM l GROUP BY call_id""")
def window_stats(spark, sf_dir):
    return R.window_stats(T.turns(spark, sf_dir))
