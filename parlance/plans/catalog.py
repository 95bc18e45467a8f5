"""All registered queries of the library and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.levels import rounded, spread
from ..operators import attribution as A
from ..operators import consensus as C
from ..operators import embeddings as V
from ..operators import intervals as I
from ..operators import quality as Q
from ..operators import report as R
from ..operators import signal as S
from . import further, more  # noqa: F401
from . import tables as T
from .oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
HOURS_8 = 8 * 3600.0


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# ---- quality and shares -----------------------------------------------------------------


@query
def conv_quality(spark, sf_dir):
    report = Q.assess(T.turns(spark, sf_dir), terminator=".")
    report = report.withColumn("n_problems", F.size("problems"))
    return report.select("call_id", "turns", "words", "speakers", "repeated", "stretched", "buried", "buried_rate", "dominant_pct", "words_per_speech_sec", "verdict", "n_problems")


@query
def speaker_share(spark, sf_dir):
    return Q.speaker_share(T.turns(spark, sf_dir))


@query
def repeated_lines(spark, sf_dir):
    lines = T.read(spark, sf_dir, "documents").filter("text is not null").select(F.col("source").alias("call_id"), "doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    lines = lines.withColumn("turn_id", F.struct("doc_id", "k"))
    return Q.repeated_lines(lines).select("call_id", "repeated", F.array_join("repeated_examples", " / ").alias("examples"))


@query
def buried_tail(spark, sf_dir):
    rows = T.turns(spark, sf_dir).filter(Q.is_buried(F.col("text"), "."))
    return rows.select("call_id", "turn_id", F.size(Q.tokens(F.substr("text", F.instr("text", ".") + 1))).alias("tail_words"))


@query
def stretched_turns(spark, sf_dir):
    rows = T.turns(spark, sf_dir).withColumn("seconds", (F.col("end") - F.col("start")) * (F.col("turn_id") % 5 + 1))
    return rows.filter(Q.is_stretched(F.col("text"), F.col("n_words"), F.col("seconds"))).select("call_id", "turn_id", F.round("seconds", 3).alias("seconds"), X.digits(F.col("text")).cast("long").alias("digits"))


@query
def compare_metrics(spark, sf_dir):
    return R.compare_metrics(T.turns(spark, sf_dir))


# ---- intervals ---------------------------------------------------------------------------


@query
def segment_majority(spark, sf_dir):
    rows = T.segments(spark, sf_dir).withColumn("day", F.floor(F.col("start") / 86400))
    return A.segment_speaker(rows, ["call_id", "day"])


@query
def turn_islands(spark, sf_dir):
    rows = T.segments(spark, sf_dir).withColumn("word", F.col("speaker"))
    return A.turns_from_words(rows, gap=HOURS_8).select("call_id", F.col("turn_id").cast("long").alias("turn_id"), "speaker", "start", "end", "n_words")


@query
def merge_runs(spark, sf_dir):
    return I.merge_runs(T.segments(spark, sf_dir), HOURS_8).select("call_id", "run", "speaker", "start", "end", "n")


@query
def plain_turns(spark, sf_dir):
    return A.build_turns(T.segments(spark, sf_dir).withColumnRenamed("idx", "seg_idx")).select("call_id", "run", "speaker", "start", "end", "n")


def _sessions(spark, sf_dir):
    """Runs of a user's events with pauses of under 8 hours, whatever their kind."""
    rows = T.segments(spark, sf_dir).withColumn("speaker", F.lit("x"))
    return I.merge_runs(rows, HOURS_8).select("call_id", F.col("run").cast("long").alias("span_idx"), "start", "end")


@query
def speech_gaps(spark, sf_dir):
    return I.speech_stats(_sessions(spark, sf_dir), long_gap=12 * 3600.0)


def _shifted(spark, sf_dir):
    """Each event as a word, later by a quarter of an hour times its id modulo 9."""
    rows = T.segments(spark, sf_dir)
    shift = 900.0 * (F.col("idx") % 9)
    return rows.select("call_id", "idx", (F.col("start") + shift).alias("start"), (F.col("end") + shift + 60).alias("end"), F.col("speaker").alias("word"))


@query
def assign_overlap(spark, sf_dir):
    segs = T.segments(spark, sf_dir).select("call_id", F.col("idx").alias("seg_idx"), "speaker", "start", (F.col("end") + 600).alias("end"))
    out = I.assign_words(_shifted(spark, sf_dir), segs)
    return out.select("call_id", "idx", "assigned", rounded(F.col("speaker_confidence"), 2).alias("speaker_confidence"))


@query
def timeline_remap(spark, sf_dir):
    spans = _sessions(spark, sf_dir)
    points = T.segments(spark, sf_dir).select("call_id", "idx", (F.pmod(F.col("idx") * 977, F.lit(500000)) / 1.0).alias("t"))
    return I.to_original(points, spans, tolerance=60.0).select("call_id", "idx", F.round("original", 3).alias("original"))


@query
def snap_to_spans(spark, sf_dir):
    out = I.snap(_shifted(spark, sf_dir), _sessions(spark, sf_dir), most=2 * 3600.0)
    return out.select("call_id", "idx", F.round("new_start", 3).alias("new_start"), F.round("new_end", 3).alias("new_end"), "moved")


@query
def attach_range(spark, sf_dir):
    turns = _sessions(spark, sf_dir).withColumnRenamed("span_idx", "turn_id")
    return I.attach_words(turns, _shifted(spark, sf_dir), slack=30.0)


@query
def cut_silence(spark, sf_dir):
    """Sessions on the clock without pauses."""
    return I.timeline(_sessions(spark, sf_dir)).select("call_id", "span_idx", F.round("cum", 3).alias("cum"), F.round("next_cum", 3).alias("next_cum"), "next_start")


@query
def pack_windows(spark, sf_dir):
    return I.pack_windows(_sessions(spark, sf_dir), 2 * 86400.0, 4 * 86400.0)


@query
def polish_windows(spark, sf_dir):
    out = I.group_by_span(T.turns(spark, sf_dir), 150.0)
    return out.select("call_id", "turn_id", "window")


# ---- attribution -------------------------------------------------------------------------


@query
def sentence_vote(spark, sf_dir):
    words = T.words(spark, sf_dir)
    mixed = words.withColumn("speaker", F.when(F.col("idx") % 7 == 3, "other").otherwise(F.col("speaker")))
    out = A.vote_by_sentence(mixed)
    return out.groupBy("call_id", "turn_id").agg(F.count("*").alias("n"), F.count_if(F.col("voted") == "other").alias("others"), F.count_if(F.col("voted") != F.col("speaker")).alias("changed"))


@query
def collapse_minor(spark, sf_dir):
    out = A.collapse_speakers(T.turns(spark, sf_dir), expected=2, gap=5.0)
    return out.select("call_id", "run", "speaker", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n", "applied")


@query
def rename_first_seen(spark, sf_dir):
    out = A.rename_first_seen(T.turns(spark, sf_dir), idx="turn_id")
    return out.select("call_id", "turn_id", "speaker", "renamed")


@query
def question_tails(spark, sf_dir):
    words = T.words(spark, sf_dir).withColumn("word", F.regexp_replace("word", r"\.$", "?"))
    out = A.split_tails(words)
    return out.groupBy("call_id", "turn_id", "handed").agg(F.count("*").alias("n"), F.max("tail").cast("long").alias("tails"))


# ---- choosing and reports ------------------------------------------------------------------


def _candidates(spark, sf_dir):
    """Two labellings of each call: as it is, and with every fourth turn given to the other side."""
    turns = T.turns(spark, sf_dir)
    other = turns.withColumn("speaker", F.when(F.col("turn_id") % 4 == 3, F.when(F.col("speaker") == "user", "assistant").otherwise("user")).otherwise(F.col("speaker")))
    rows = turns.withColumns({"engine": F.lit("plain"), "rank": F.lit(0)}).unionByName(other.withColumns({"engine": F.lit("moved"), "rank": F.lit(1)}))
    named = rows.groupBy("call_id", "engine").agg(F.max("rank").alias("rank"))
    return Q.assess(rows, keys=("call_id", "engine"), terminator=".").join(named, ["call_id", "engine"]).withColumn("error", F.lit(None).cast("string"))


@query
def arbitrate(spark, sf_dir):
    return R.arbitrate(_candidates(spark, sf_dir)).select("call_id", "engine", "buried", F.size("problems").alias("n_problems"))


@query
def choose_engine(spark, sf_dir):
    return R.choose_engine(_candidates(spark, sf_dir)).select("call_id", "engine", "dominant_pct")


@query
def engine_matrix(spark, sf_dir):
    return R.compare_matrix(_candidates(spark, sf_dir), "dominant_pct", ["plain", "moved"], ("call_id",))


@query
def batch_report(spark, sf_dir):
    rows = Q.assess(T.turns(spark, sf_dir), terminator=".")
    return R.batch_report(rows, "call_id").select("call_id", "verdict", "severity", "buried", F.col("place").cast("long").alias("place"))


@query
def batch_totals(spark, sf_dir):
    turns = T.turns(spark, sf_dir)
    length = turns.groupBy("call_id").agg(F.max("end").alias("duration_sec"))
    rows = Q.assess(turns, terminator=".").join(length, "call_id").withColumn("status", F.when(F.col("call_id") % 11 == 0, "failed").otherwise("ok"))
    return R.batch_totals(rows)


@query
def variance_report(spark, sf_dir):
    rows = T.read(spark, sf_dir, "orders").withColumn("file", F.col("o_orderpriority"))
    return R.variance_report(rows, ["o_totalprice"], digits=2).select("file", "runs", "o_totalprice_mean", "o_totalprice_min", "o_totalprice_max", "o_totalprice_sd")


@query
def sweep_report(spark, sf_dir):
    limits = spark.createDataFrame([(0.3,), (0.4,), (0.5,), (0.6,)], "threshold double")
    events = T.read(spark, sf_dir, "events").filter("value is not null")
    rows = events.crossJoin(F.broadcast(limits)).filter(F.col("value") / 500 >= F.col("threshold") / 4)
    rows = rows.groupBy("threshold").agg(F.count("*").alias("words"), F.round(F.sum("value"), 2).alias("speech_sec"), F.count_distinct("user_id").alias("speakers"))
    rows = rows.crossJoin(F.broadcast(events.agg(F.count("*").alias("_all")))).withColumn("agree", F.round(100 * F.col("words") / F.col("_all"), 2)).drop("_all")
    return R.baseline_deltas(rows, "threshold", "agree", F.col("threshold") == 0.3)


@query
def incremental_todo(spark, sf_dir):
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "source")
    return R.todo(docs, T.read(spark, sf_dir, "labels"), ["doc_id"])


# ---- consensus -----------------------------------------------------------------------------


@query
def hesitation_dips(spark, sf_dir):
    p = F.round(1 - F.pmod(F.col("idx") * 7919, F.lit(1000)) / 2500.0, 4)
    words = T.segments(spark, sf_dir).select("call_id", "idx", F.col("speaker").alias("word"), "start", "end", p.alias("probability"), F.lit(True).alias("agreement"))
    return C.hesitations(words, most=20).select("call_id", "idx", "probability", F.col("rank").cast("long").alias("rank"))


def _altered(words: DataFrame) -> DataFrame:
    """A second stream: every 11th word goes, every 13th is another."""
    return words.filter(F.col("idx") % 11 != 5).withColumn("word", F.when(F.col("idx") % 13 == 4, F.lit("changed")).otherwise(F.col("word")))


@query
def normalised_agreement(spark, sf_dir):
    words = T.words(spark, sf_dir).select("call_id", "idx", "word", "start", "end", F.lit(0.9).alias("probability"))
    return C.agreement(C.align_streams(words, _altered(words)))


@query
def loop_collapse(spark, sf_dir):
    words = T.words(spark, sf_dir).select("call_id", "idx", F.when(F.col("idx") % 40 < 9, "so").otherwise(F.col("word")).alias("word"), "start", "end")
    return C.collapse_loops(words).groupBy("call_id").agg(F.count("*").alias("words"), F.max("loops").alias("loops"))


@query
def anchor_trim(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("call_id").orderBy("turn_id")
    rows = T.turns(spark, sf_dir).withColumn("prev", F.lag("text", 1, "").over(w)).withColumn("next", F.lead("text", 1, "").over(w))
    ends = lambda c, n: F.array_join(F.slice(X.words_of(F.col(c)), n, 3), " ")
    tail = F.array_join(F.slice(X.words_of(F.col("prev")), F.greatest(F.size(X.words_of(F.col("prev"))) - 2, F.lit(1)), 3), " ")
    answer = F.concat_ws(" ", tail, F.array_join(F.slice(X.words_of(F.col("text")), 1, 6), " "), ends("next", 1))
    return rows.select("call_id", "turn_id", X.anchor_trim(answer, F.col("prev"), F.col("next")).alias("trimmed"))


@query
def guards(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("call_id").orderBy("turn_id")
    rows = T.turns(spark, sf_dir).withColumn("new", F.lead("text", 1, "").over(w))
    return rows.select(
        "call_id",
        "turn_id",
        X.rewrite_ok(F.col("text"), F.col("new")).alias("rewrite_ok"),
        X.polish_ok(F.col("text"), F.col("new"), "[a-z]").alias("polish_ok"),
        X.is_plausible(F.col("new"), F.col("text"), F.col("text"), "[a-z]").alias("plausible"),
    )


@query
def referee_votes(spark, sf_dir):
    a, b = F.pmod(F.col("event_id") * 37, F.lit(101)) / 100.0, F.pmod(F.col("event_id") * 53, F.lit(101)) / 100.0
    rows = T.read(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), C.referee(a, b).alias("resolved"))
    return C.outcome_counts(rows)


# ---- text ------------------------------------------------------------------------------------


@query
def clean_text(spark, sf_dir):
    docs = T.read(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", F.md5(X.squeeze(X.strip_marks(F.col("text")))).alias("squeezed"), F.md5(X.escape_html(F.col("text"))).alias("escaped"), X.solid_length(F.col("text")).cast("long").alias("solid"))


@query
def clock_format(spark, sf_dir):
    rows = T.segments(spark, sf_dir).withColumn("s", F.round(F.col("end") - F.col("start"), 3) * 37)
    return rows.select("idx", X.clock(F.col("s")).alias("clock"), X.srt_clock(F.col("s")).alias("srt"))


# ---- vectors ---------------------------------------------------------------------------------


@query
def centroids(spark, sf_dir):
    out = V.centroids(T.vectors(spark, sf_dir))
    return out.select("label", "n", F.posexplode("centroid").alias("pos", "x")).select("label", "n", "pos", F.round("x", 6).alias("x"))


@query
def nearest_centroid(spark, sf_dir):
    vectors = T.vectors(spark, sf_dir)
    out = V.nearest_centroid(V.similarities(vectors, V.centroids(vectors)))
    return out.select("vec_id", "best", F.round("sim", 4).alias("sim"), F.round("margin", 4).alias("margin"))


@query
def purify(spark, sf_dir):
    return V.purify(T.vectors(spark, sf_dir))


@query
def within_across(spark, sf_dir):
    return V.within_across(T.vectors(spark, sf_dir))


@query
def silhouette(spark, sf_dir):
    out = V.silhouette(T.vectors(spark, sf_dir))
    return out.select(F.round("silhouette", 6).alias("silhouette"), "n")


@query
def kmeans_labels(spark, sf_dir):
    return V.spark_kmeans(T.vectors(spark, sf_dir), 10)


# ---- sound -----------------------------------------------------------------------------------


@query
def level_frames(spark, sf_dir):
    """Values as levels: a gain per kind of event and user group, and the spread before and after."""
    rows = T.read(spark, sf_dir, "events").filter("value > 0")
    rows = rows.select((F.col("user_id") % 10).alias("call_id"), F.col("event_type").alias("speaker"), F.lit(0.0).alias("start"), F.col("value").alias("end"), (20 * F.log10(F.col("value") / 500)).alias("db"))
    return S.speaker_gains(rows)


@query
def level_spread(spark, sf_dir):
    rows = T.read(spark, sf_dir, "events").filter("value > 0").withColumn("db", 20 * F.log10(F.col("value") / 500))
    return rows.groupBy("event_type").agg(F.round(spread(F.col("db")), 4).alias("spread_db"), F.round(F.percentile("db", F.lit(0.5)), 4).alias("median_db"), F.count("*").alias("n"))


@query
def bandwidth_share(spark, sf_dir):
    bins = T.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("call_id"), F.floor(F.col("value") / 5).alias("hz")).agg(F.count("*").cast("double").alias("power"))
    return S.energy_bandwidth(bins)


@query
def clipped_runs(spark, sf_dir):
    rows = T.read(spark, sf_dir, "events").select((F.col("event_id") % 3).alias("call_id"), F.floor(F.col("event_id") / 3).alias("pos"), (F.col("value") / 25).alias("x"))
    return S.clipped_runs(rows, level=0.9, least=3)

QUERIES |= more.QUERIES
ORACLES |= more.ORACLES
