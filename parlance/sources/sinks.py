"""Sinks: transcripts as text, subtitles, web page and JSON; sound; reports."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clock, escape_html, srt_clock
from ..operators.intervals import KEYS, along, islands

LEFT_SIDE, RIGHT_SIDE = "left", "right"


def _listed(*order, text: Column, sep: str) -> Column:
    rows = F.sort_array(F.collect_list(F.struct(*order, text.alias("_t"))))
    return F.array_join(F.transform(rows, lambda r: r["_t"]), sep)


def labelled(speaker: Column, names: dict[str, str] | None) -> Column:
    """A speaker's display name, or the label itself."""
    if not names:
        return speaker
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), speaker), speaker)


def transcript_text(turns: DataFrame, names: dict[str, str] | None = None, keys=KEYS) -> DataFrame:
    """(keys, value): two lines of heading, then the clock, the name and the text of each turn."""
    body = F.concat(F.lit("["), clock(F.col("start")), F.lit("] "), labelled(F.col("speaker"), names), F.lit(":\n"), F.col("text"), F.lit("\n"))
    out = turns.groupBy(*keys).agg(_listed("start", "turn_id", text=body, sep="\n").alias("b"), F.count("*").alias("n"), F.count_distinct("speaker").alias("s"), F.max("end").alias("e"))
    head = F.concat(F.format_string("%d turns, %d speakers, ", "n", "s"), clock(F.col("e")), F.lit("\n\n"))
    return out.select(*keys, F.concat(head, F.col("b")).alias("value"))


def subtitles(turns: DataFrame, names: dict[str, str] | None = None, keys=KEYS) -> DataFrame:
    """(keys, value): SubRip text."""
    place = F.row_number().over(along(keys, ("start", "turn_id")))
    times = F.concat(srt_clock(F.col("start")), F.lit(" --> "), srt_clock(F.col("end")))
    body = F.concat_ws("\n", F.col("_n").cast("string"), times, F.concat(labelled(F.col("speaker"), names), F.lit(": "), F.col("text")))
    return turns.withColumn("_n", place).groupBy(*keys).agg(F.concat(_listed("_n", text=body, sep="\n\n"), F.lit("\n")).alias("value"))


def chat_page(turns: DataFrame, reports: DataFrame | None = None, names: dict[str, str] | None = None, weak: float = 0.75, keys=KEYS) -> DataFrame:
    """(keys, value): a right-to-left web page of the call as a chat.

    turns: keys, turn_id, speaker, start, end, text, words (array of word and
    probability). The first speaker is on the right. Words under `weak` are
    underlined if the words of a turn are as many as the tokens of its text.
    """
    first = turns.groupBy(*keys).agg(F.min_by("speaker", F.struct("start", "turn_id")).alias("_first"))
    own = F.split(F.trim("text"), r"\s+")
    marked = F.array_join(
        F.transform(own, lambda t, i: F.when(F.get("words", i)["probability"] < weak, F.concat(F.lit("<u>"), escape_html(t), F.lit("</u>"))).otherwise(escape_html(t))), " "
    )
    text = F.when(F.size(own) == F.size("words"), marked).otherwise(escape_html(F.col("text")))
    side = F.when(F.col("speaker") == F.col("_first"), RIGHT_SIDE).otherwise(LEFT_SIDE)
    body = F.concat(F.lit('<div class="turn '), side, F.lit('"><b>'), escape_html(labelled(F.col("speaker"), names)), F.lit("</b> <i>"), clock(F.col("start")), F.lit("</i><p>"), text, F.lit("</p></div>"))
    out = turns.join(first, list(keys)).groupBy(*keys).agg(_listed("start", "turn_id", text=body, sep="\n").alias("_body"))
    held = turns.groupBy(*keys, "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("_sec"))
    share = F.format_string("%s %.0f%%", labelled(F.col("speaker"), names), 100 * F.col("_sec") / F.greatest(F.col("_all"), F.lit(1e-9)))
    totals = held.groupBy(*keys).agg(F.sum("_sec").alias("_all"))
    shares = held.join(totals, list(keys)).groupBy(*keys).agg(_listed((-F.col("_sec")).alias("s"), "speaker", text=escape_html(share), sep=" · ").alias("_shares"))
    out = out.join(shares, list(keys))
    box = F.lit("")
    if reports is not None:
        out = out.join(reports.select(*keys, "verdict", "problems"), list(keys), "left")
        items = F.array_join(F.transform("problems", lambda p: F.concat(F.lit("<li>"), escape_html(p), F.lit("</li>"))), "")
        box = F.coalesce(F.concat(F.lit('<div class="quality"><b>'), escape_html(F.col("verdict")), F.lit("</b><ul>"), items, F.lit("</ul></div>\n")), F.lit(""))
    head = F.lit('<!DOCTYPE html><html dir="rtl"><meta charset="utf-8"><body>\n')
    return out.select(*keys, F.concat(head, box, F.lit('<p class="share">'), F.col("_shares"), F.lit("</p>\n"), F.col("_body"), F.lit("\n</body></html>\n")).alias("value"))


def transcript_json(turns: DataFrame, metrics: DataFrame | None = None, keys=KEYS) -> DataFrame:
    """(keys, value): the call as one JSON object, its turns in order."""
    fields = [c for c in turns.columns if c not in keys]
    rows = turns.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "turn_id", F.struct(*fields).alias("t")))).alias("_rows"))
    rows = rows.select(*keys, F.transform("_rows", lambda r: r["t"]).alias("turns"))
    more = [] if metrics is None else [c for c in metrics.columns if c not in keys]
    rows = rows if metrics is None else rows.join(metrics, list(keys), "left")
    return rows.select(*keys, F.to_json(F.struct(*keys, *more, "turns")).alias("value"))


def timeline_json(spans: DataFrame, keys=KEYS) -> DataFrame:
    row = F.struct(F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))
    rows = F.sort_array(F.collect_list(F.struct("span_idx", row.alias("s"))))
    return spans.groupBy(*keys).agg(F.to_json(F.struct(F.transform(rows, lambda r: r["s"]).alias("spans"))).alias("value"))


def timed_lines(words: DataFrame, pause: float = 1.0, keys=KEYS) -> DataFrame:
    """(keys, value): words on timed lines, a new one after each pause."""
    w = along(keys)
    rows = islands(words, F.col("start") - F.lag("end").over(w) > pause, keys, name="_line")
    lines = rows.groupBy(*keys, "_line").agg(F.min("start").alias("s"), _listed("start", "idx", text=F.col("word"), sep=" ").alias("t"))
    return lines.groupBy(*keys).agg(_listed("_line", text=F.concat(F.lit("["), clock(F.col("s")), F.lit("] "), F.col("t")), sep="\n").alias("value"))


@F.pandas_udf(T.BinaryType())
def wav_bytes(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """16-bit mono WAV data."""
    out = []
    for x, r in zip(samples, rate):
        held = io.BytesIO()
        with wave.open(held, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(int(r))
            w.writeframes((np.clip(np.asarray(x, float), -1, 1) * 32767).astype("<i2").tobytes())
        out.append(held.getvalue())
    return pd.Series(out)


def write_texts(rows: DataFrame, path: str, keys=KEYS, value: str = "value") -> None:
    """One text row per call, in folders by call, replacing what is there; a single file each is what Spark makes of one row."""
    rows.select(*keys, value).write.mode("overwrite").partitionBy(*keys).text(path)


def archive(rows: DataFrame, path: str) -> None:
    """Raw responses as JSON lines, so that rules can be applied again without paying for them again."""
    rows.write.mode("append").json(path)


def write_media(rows: DataFrame, path: str, name: str = "name", content: str = "content") -> None:
    """A mirrored set of media as a table of names and bytes, which any store takes."""
    rows.select(F.col(name).alias("path"), F.col(content).alias("content")).write.mode("overwrite").parquet(path)
