"""Sources: recordings, worker responses, speaker segments, timelines, settings."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import UNKNOWN_SPEAKER

#: Suffixes of recordings, and of files derived from them.
SOUND = ("wav", "mp3", "m4a", "ogg", "opus", "flac", "aac", "wma", "mp4")
DERIVED = (".16k.wav", ".speech.wav")
TRAINING = ("wav", "flac", "mp3")


def recordings(spark: SparkSession, folder: str, recursive: bool = False, suffixes=SOUND) -> DataFrame:
    """(path, length, modificationTime, content) of a folder's recordings without derived files. Columns that aren't selected aren't read."""
    pattern = "*.{" + ",".join(s for x in suffixes for s in (x, x.upper())) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    for suffix in DERIVED:
        files = files.filter(~F.lower("path").endswith(suffix))
    return files


def training_files(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings below a folder with place: all wav files by path, then flac, then mp3."""
    rank = F.lit(0)
    for k, s in enumerate(TRAINING):
        rank = F.when(F.lower("path").endswith(f".{s}"), k).otherwise(rank)
    files = recordings(spark, folder, True, TRAINING).withColumn("_rank", rank)
    return files.withColumn("place", F.row_number().over(Window.orderBy("_rank", "path")) - 1).drop("_rank")


PROFILE = (
    T.StructType()
    .add("codec", T.StringType())
    .add("sample_rate", T.IntegerType())
    .add("channels", T.IntegerType())
    .add("bits", T.IntegerType())
    .add("duration_sec", T.DoubleType())
    .add("bit_rate", T.LongType())
    .add("error", T.StringType())
)


@F.pandas_udf(PROFILE)
def wav_profile(content: pd.Series) -> pd.DataFrame:
    """The header of PCM WAV data; error names what is wrong, and other codecs belong to a provider."""
    rows = []
    for data in content:
        try:
            with wave.open(io.BytesIO(data or b"")) as w:
                n, rate, channels, width = w.getnframes(), w.getframerate(), w.getnchannels(), w.getsampwidth()
                if not n:
                    raise EOFError("no samples")
                rows.append(("pcm", rate, channels, 8 * width, n / rate, rate * channels * width * 8, None))
        except (wave.Error, EOFError) as e:
            rows.append((None, None, None, None, None, None, str(e) or "no sound"))
    return pd.DataFrame(rows, columns=PROFILE.names)


#: What broken or foreign sound data raise.
UNREADABLE = (wave.Error, EOFError, TypeError, ValueError)


def stored(data: bytes) -> tuple[np.ndarray, int, int]:
    """Sample values as the file has them, one column per channel, their bits and the rate; data cut short within a sample lose that sample."""
    with wave.open(io.BytesIO(data)) as w:
        raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    octets = np.frombuffer(raw[: len(raw) // (width * channels) * width * channels], np.uint8).reshape(-1, width)
    if width == 1:
        values = octets[:, 0].astype(np.int32)
    else:
        wide = np.zeros((len(octets), 4), np.uint8)
        wide[:, 4 - width :] = octets
        values = wide.view("<i4")[:, 0] >> (32 - 8 * width)
    return values.reshape(-1, channels), 8 * width, rate


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """Samples in -1..1, one column per channel, and the rate."""
    values, bits, rate = stored(data)
    return ((values.astype(np.float64) - (128 if bits == 8 else 0)) / (1 << (bits - 1))).astype(np.float32), rate


@F.pandas_udf(T.StructType().add("samples", T.ArrayType(T.FloatType())).add("rate", T.IntegerType()))
def mono_16k(content: pd.Series) -> pd.DataFrame:
    """Sound as 16 kHz mono; null where it can't be decoded."""
    from ..operators.signal import _resample

    out = []
    for data in content:
        try:
            x, rate = decode(data)
            out.append((_resample(x.mean(axis=1), rate, 16000).astype(np.float32), 16000))
        except UNREADABLE:
            out.append((None, None))
    return pd.DataFrame(out, columns=["samples", "rate"])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def raw_samples(content: pd.Series) -> pd.Series:
    """Sample values at the file's own depth, for counting levels; null where they can't be read."""

    def values(data: bytes | None) -> np.ndarray | None:
        try:
            return stored(data)[0].ravel()
        except UNREADABLE:
            return None

    return pd.Series([values(x) for x in content], dtype=object)


def fetch(base64_data: Column, url_data: Column) -> Column:
    """Sound from base64 if there is any, else what a provider got from the URL; null with neither."""
    return F.coalesce(F.unbase64(F.nullif(base64_data, F.lit(""))), url_data)


def preflight(profiled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a sound stream and the quarantined rest; rows without a profile, for want of a tool, go on."""
    bad = F.coalesce(F.col("profile.error").isNotNull(), F.lit(False))
    return profiled.filter(~bad), profiled.filter(bad)


_WORD = "struct<word:string,start:double,end:double,speaker:string,probability:double>"
_SEGMENT = f"struct<text:string,start:double,end:double,speakers:array<string>,words:array<{_WORD}>>"


def response_segments(responses: DataFrame) -> DataFrame:
    """(call_id, seg_idx, start, end, text, speakers, words) of worker responses (call_id, output as JSON text).

    output is an object or a list of objects, each with result: a list of batches, or
    of events, {type, data}. Events of type segments count, with data as a list or an
    object. Segments without text and words are dropped.
    """
    as_list = lambda j: F.when(F.ltrim(j).startswith("["), F.from_json(j, "array<string>")).otherwise(F.array(j))
    out = responses.select("call_id", F.posexplode(as_list(F.col("output"))).alias("i", "container"))
    out = out.select("call_id", "i", F.posexplode(as_list(F.get_json_object("container", "$.result"))).alias("j", "batch"))
    out = out.select("call_id", "i", "j", F.posexplode(as_list(F.col("batch"))).alias("k", "event"))
    out = out.filter(F.get_json_object("event", "$.type") == "segments")
    out = out.select("call_id", "i", "j", "k", F.posexplode(as_list(F.get_json_object("event", "$.data"))).alias("m", "segment"))
    out = out.select("call_id", "i", "j", "k", "m", F.from_json("segment", _SEGMENT).alias("s"))
    kept = out.filter((F.trim(F.coalesce("s.text", F.lit(""))) != "") | (F.size(F.coalesce("s.words", F.array().cast(f"array<{_WORD}>"))) > 0))
    place = F.row_number().over(Window.partitionBy("call_id").orderBy("i", "j", "k", "m")) - 1
    return kept.select("call_id", place.alias("seg_idx"), "s.start", "s.end", F.trim(F.coalesce("s.text", F.lit(""))).alias("text"), "s.speakers", "s.words")


def segment_words(segments: DataFrame) -> DataFrame:
    """(call_id, seg_idx, idx, word, start, end, speaker, probability); a word without speaker stays null."""
    rows = segments.select("call_id", "seg_idx", F.posexplode("words").alias("_w", "w"))
    place = F.row_number().over(Window.partitionBy("call_id").orderBy("seg_idx", "_w")) - 1
    return rows.select("call_id", "seg_idx", place.alias("idx"), F.trim(F.coalesce("w.word", F.lit(""))).alias("word"), F.coalesce("w.start", F.lit(0.0)).alias("start"), F.coalesce("w.end", F.lit(0.0)).alias("end"), "w.speaker", "w.probability")


def segment_speakers(segments: DataFrame) -> DataFrame:
    """segments with speaker: the most frequent of its words, first seen on a tie, else the first it lists, else UNKNOWN."""
    from ..operators.attribution import segment_speaker

    words = segment_words(segments)
    mode = segment_speaker(words, ["call_id", "seg_idx"])
    return segments.join(mode, ["call_id", "seg_idx"], "left").withColumn("speaker", F.coalesce("speaker", F.get("speakers", 0), F.lit(UNKNOWN_SPEAKER)))


def rttm(spark: SparkSession, path: str) -> DataFrame:
    """(call_id, seg_idx, start, end, speaker) of SPEAKER lines with eight fields or more, by start."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter((f[0] == "SPEAKER") & (F.size(f) >= 8))
    rows = rows.select(f[1].alias("call_id"), f[3].cast("double").alias("start"), (f[3].cast("double") + f[4].cast("double")).alias("end"), f[7].alias("speaker"))
    place = F.row_number().over(Window.partitionBy("call_id").orderBy("start", "end", "speaker")) - 1
    return rows.select("call_id", place.alias("seg_idx"), "start", "end", "speaker")


def timeline(spark: SparkSession, path: str) -> DataFrame:
    """(path, span_idx, start, end) of timeline files {"spans": [{"start", "end"}]}."""
    rows = spark.read.schema("spans array<struct<start:double,end:double>>").option("multiLine", "true").json(path)
    return rows.select(F.input_file_name().alias("path"), F.posexplode("spans").alias("span_idx", "s")).select("path", "span_idx", "s.start", "s.end")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("audio_filepath string, offset double, duration double, label string, text string, num_speakers int").json(path)


def settings(text: str) -> dict[str, str]:
    """NAME=value lines; comments, blank lines and outer quotes go, the first of a name stands."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        name, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and not name.startswith("#"):
            out.setdefault(name.strip(), value.strip().strip("\"'"))
    return out


def todo(spark: SparkSession, inputs: DataFrame, results: str, on=("call_id",)) -> DataFrame:
    """Inputs that have no row in the results written so far; all if nothing has been written."""
    from pyspark.errors import AnalysisException

    from ..operators import report

    try:
        done = spark.read.json(results)
    except AnalysisException:
        return inputs
    return report.todo(inputs, done, on) if set(on) <= set(done.columns) else inputs
