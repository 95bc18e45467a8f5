"""The driver's tables as interval tables.

Conversations have no clock, so turns get a synthetic one: words follow each other
at 2.5 a second, without pauses. Events become segments: the user is the call, the
kind the speaker, and the value the length in seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS_PER_SEC = 2.5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_id, turn_id, speaker, start, end, text, n_words."""
    rows = read(spark, sf_dir, "conversations").filter("text is not null")
    n = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda t: t != ""))
    rows = rows.select(F.col("conv_id").alias("call_id"), F.col("turn").cast("int").alias("turn_id"), F.col("role").alias("speaker"), "text", n.alias("n_words"))
    w = Window.partitionBy("call_id").orderBy("turn_id").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("n_words").over(w)
    return rows.select("call_id", "turn_id", "speaker", ((end - F.col("n_words")) / WORDS_PER_SEC).alias("start"), (end / WORDS_PER_SEC).alias("end"), "text", "n_words")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_id, turn_id, idx, word, start, end, speaker."""
    t = turns(spark, sf_dir).select("call_id", "turn_id", "speaker", F.round(F.col("start") * WORDS_PER_SEC).cast("int").alias("_at"), F.posexplode(F.filter(F.split(F.trim("text"), r"\s+"), lambda t: t != "")).alias("_k", "word"))
    idx = F.col("_at") + F.col("_k")
    return t.select("call_id", "turn_id", idx.alias("idx"), "word", (idx / WORDS_PER_SEC).alias("start"), ((idx + 1) / WORDS_PER_SEC).alias("end"), "speaker")


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) / 1e6


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_id (user), idx, speaker, start, end: events with their value as length, kept to the millisecond."""
    start = F.round(seconds(F.col("ts")), 3)
    length = F.round(F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0)), 3)
    rows = read(spark, sf_dir, "events").filter("user_id is not null and ts is not null")
    return rows.select(F.col("user_id").alias("call_id"), F.col("event_id").alias("idx"), F.col("event_type").alias("speaker"), start.alias("start"), F.round(start + length, 3).alias("end"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")
