"""From worker responses to transcripts, verdicts and a batch report.

Words of a call can be labelled in several ways. Each way is a candidate; candidates
stand in one table under (call_id, candidate), are scored once together, and the
best of each call is kept.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import UNKNOWN_SPEAKER
from .operators import attribution, intervals, quality, report
from .sources import readers, sinks

BOTH = ("call_id", "candidate")


@dataclass(frozen=True)
class Transcribed:
    """Tables of a batch; turns and reports have the chosen candidate of each call, files has a row per call, failed ones included."""

    turns: DataFrame
    reports: DataFrame
    candidates: DataFrame
    files: DataFrame

    def texts(self, names: dict[str, str] | None = None) -> DataFrame:
        return sinks.transcript_text(self.turns, names)

    def subtitles(self, names: dict[str, str] | None = None) -> DataFrame:
        return sinks.subtitles(self.turns, names)

    def markdown(self) -> DataFrame:
        return report.report_markdown(self.files)


def settled(df: DataFrame) -> DataFrame:
    """df computed and kept in the cluster's checkpoint folder.

    Every operator joins its input with itself, so without such cuts the plan of the
    whole call doubles at each. Where no folder is set, a local session gets one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="parlance-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def labelings(words: DataFrame, segments: DataFrame | None = None, ends: Column | None = None) -> DataFrame:
    """words with candidate and rank: as the worker labelled them (rank 0), and by the speaker segments of a second diarizer (rank 1).

    Calls without segments have the worker's candidate alone. Both are voted on by
    sentence; in the second, what follows a question within a turn goes to the other speaker.
    """
    plain = ["call_id", "idx", "word", "start", "end", "speaker", "probability"]
    words = words.select(*plain)
    voted = attribution.vote_by_sentence(words, ends=ends).withColumn("speaker", F.col("voted"))
    out = voted.select(*plain, F.lit("worker").alias("candidate"), F.lit(0).alias("rank"))
    if segments is None:
        return out
    known = words.join(segments.select("call_id").distinct(), "call_id", "left_semi")
    second = intervals.assign_words(known, segments).withColumn("speaker", F.col("assigned")).select(*plain)
    second = attribution.vote_by_sentence(second, ends=ends).withColumn("speaker", F.col("voted")).select(*plain)
    begins = ~F.lag("speaker").over(intervals.along()).eqNullSafe(F.col("speaker"))
    turned = intervals.islands(second, begins, name="turn_id")
    handed = attribution.split_tails(turned).withColumn("speaker", F.col("handed")).select(*plain)
    return out.unionByName(handed.select(*plain, F.lit("segments").alias("candidate"), F.lit(1).alias("rank")))


def transcribe_report(
    responses: DataFrame, segments: DataFrame | None = None, spans: DataFrame | None = None, expected: int | None = 2, gap: float = 1.0, terminator: str = "?", ends: Column | None = None
) -> Transcribed:
    """Transcripts and verdicts of worker responses (call_id, output and, where a call failed, error).

    segments: call_id, seg_idx, start, end, speaker of a second diarizer. spans:
    call_id, span_idx, start, end of the speech kept, if silence was cut before the
    words were timed. A call whose response has no words becomes a failed file, as does
    one with an error; neither stops the others. A word without speaker belongs to UNKNOWN.
    """
    error = F.col("error") if "error" in responses.columns else F.lit(None).cast("string")
    asked = responses.withColumn("error", error)
    heard = readers.segment_speakers(readers.response_segments(asked.filter("error is null")))
    own = heard.select("call_id", "seg_idx", F.col("speaker").alias("_of_segment"))
    words = readers.segment_words(heard).join(own, ["call_id", "seg_idx"]).filter("word <> ''")
    words = words.withColumn("speaker", F.coalesce("speaker", "_of_segment", F.lit(UNKNOWN_SPEAKER))).drop("_of_segment")
    words = settled(words)
    labelled = labelings(words, segments, ends)
    if spans is not None:
        line = labelled.select(*BOTH).distinct().join(spans, "call_id")
        labelled = attribution.remap_words(labelled, line, keys=BOTH)
    labelled = settled(labelled)
    turns = settled(attribution.turns_from_words(labelled, gap, BOTH))
    if expected:
        turns = attribution.collapse_speakers(turns, expected, gap=gap, keys=BOTH, text="text").withColumnRenamed("run", "turn_id")
        turns = turns.withColumn("n_words", F.size(quality.tokens(F.col("text"))))
    turns = settled(turns.select(*BOTH, "turn_id", "speaker", "start", "end", "text", "n_words"))
    reports = quality.assess(turns, labelled, expected, BOTH, terminator).join(labelled.select(*BOTH, "rank").distinct(), list(BOTH))
    reports = settled(reports)
    chosen = report.arbitrate(reports)
    best = turns.join(chosen.select(*BOTH), list(BOTH), "left_semi")
    best = attribution.rename_first_seen(best, idx="turn_id").withColumn("speaker", F.col("renamed")).drop("renamed", "candidate")
    length = best.groupBy("call_id").agg(F.max("end").alias("duration_sec"))
    rows = asked.select("call_id", "error").join(chosen, "call_id", "left").join(length, "call_id", "left")
    ok = F.col("error").isNull() & F.col("verdict").isNotNull()
    files = rows.select(
        F.col("call_id").alias("file"),
        F.when(ok, "ok").otherwise("failed").alias("status"),
        F.when(~ok, F.coalesce("error", F.lit("no words in the response"))).alias("error"),
        *(F.when(ok, F.col(c)).alias(c) for c in ("candidate", "verdict", "problems", "speakers", "turns", "words", "buried", "dominant_pct", "duration_sec")),
    )
    return Transcribed(best, chosen.drop("rank"), reports, files)
