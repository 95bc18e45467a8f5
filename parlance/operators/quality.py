"""Shape-based quality of a transcript: metrics, problems and a verdict per call.

One pass each over words and turns, aggregated by call; nothing is collected but
a few examples per call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import KEYS

LOW_CONFIDENCE = 0.5


def tokens(text: Column) -> Column:
    """The white-space separated tokens; none for empty text."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")


def is_repetition_candidate(text: Column) -> Column:
    return F.size(tokens(text)) >= 3


def is_dictation(text: Column) -> Column:
    """Digits make up so much of the text that slow speech is reading out numbers."""
    digits = F.regexp_count(text, F.lit(r"\d"))
    return digits >= F.greatest(F.lit(4), F.floor(F.length(F.replace(text, F.lit(" "), F.lit(""))) / 3))


def is_stretched(text: Column, n_words: Column, seconds: Column) -> Column:
    return (seconds >= 2.0) & (n_words / F.greatest(seconds, F.lit(1e-6)) < 0.8) & ~is_dictation(text)


def is_buried(text: Column, terminator: str = "?") -> Column:
    """The first terminator is followed by three tokens or more."""
    rest = F.substr(text, F.instr(text, terminator) + 1)
    return (F.instr(text, terminator) > 0) & (F.size(tokens(rest)) >= 3)


def speaker_share(turns: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, speaker, seconds, pct) of the talk time of a call; 0 where nobody talks."""
    held = turns.groupBy(*keys, "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("_sec"))
    total = F.sum("_sec").over(Window.partitionBy(*keys))
    pct = F.when(total > 0, 100 * F.col("_sec") / total).otherwise(0.0)
    return held.select(*keys, "speaker", F.round("_sec", 3).alias("seconds"), F.round(F.round(pct, 6), 1).alias("pct"))


def repeated_lines(turns: DataFrame, keys=KEYS, idx: str = "turn_id") -> DataFrame:
    """(keys, repeated, repeated_examples): lines of three tokens or more beyond their first time; the three most frequent, the first seen on a tie."""
    texts = turns.filter(is_repetition_candidate(F.col("text"))).groupBy(*keys, F.trim("text").alias("text"))
    texts = texts.agg(F.count("*").alias("n"), F.min(idx).alias("first")).filter("n > 1")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), "first"))
    texts = texts.withColumn("rank", rank)
    examples = F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "text")))), lambda r: r["text"])
    return texts.groupBy(*keys).agg(F.sum(F.col("n") - 1).alias("repeated"), examples.alias("repeated_examples"))


def assess(turns: DataFrame, words: DataFrame | None = None, expected: int | None = 2, keys=KEYS, terminator: str = "?") -> DataFrame:
    """The quality report, one row per call.

    turns: keys, turn_id, speaker, start, end, text, n_words. words: keys, probability
    (null without); by default the turns' n_words without confidence. Rates are 0 for
    empty calls. Expected None turns the rules on the number of speakers off.
    """
    seconds = F.col("end") - F.col("start")
    t = turns.withColumns({"_buried": is_buried(F.col("text"), terminator), "_stretched": is_stretched(F.col("text"), F.col("n_words"), seconds)})

    def examples(flag: str, text: Column) -> Column:
        rows = F.sort_array(F.collect_list(F.when(F.col(flag), F.struct("turn_id", text.alias("x")))))
        return F.transform(F.slice(rows, 1, 3), lambda r: r["x"])

    at = F.instr("text", terminator)
    begin = F.greatest(at - 30, F.lit(1))
    question = F.trim(F.substr(F.col("text"), begin, at - begin + 1))
    buried_text = F.concat(question, F.lit(" >> "), F.substr(F.trim(F.substr(F.col("text"), at + 1)), F.lit(1), F.lit(30)))
    stretched_text = F.format_string("%s (%d words over %.0fs)", F.substring("text", 1, 40), F.col("n_words").cast("int"), seconds)
    per_call = t.groupBy(*keys).agg(
        F.count("*").alias("turns"),
        F.sum("n_words").alias("_turn_words"),
        F.count_distinct("speaker").alias("speakers"),
        F.sum(seconds).alias("_speech"),
        F.count_if("_stretched").alias("stretched"),
        examples("_stretched", stretched_text).alias("stretched_examples"),
        F.count_if("_buried").alias("buried"),
        examples("_buried", buried_text).alias("buried_examples"),
    )
    held = turns.groupBy(*keys, "speaker").agg(F.sum(seconds).alias("_sec"))
    dominant = held.groupBy(*keys).agg((100 * F.max("_sec") / F.nullif(F.sum("_sec"), F.lit(0.0))).alias("_dominant"))
    out = per_call.join(dominant, list(keys)).join(repeated_lines(turns, keys), list(keys), "left")
    if words is not None:
        scored = words.groupBy(*keys).agg(
            F.count("*").alias("words"), F.round(F.avg("probability"), 4).alias("_mean"), F.count_if(F.col("probability") < LOW_CONFIDENCE).alias("_low")
        )
        out = out.join(scored, list(keys), "left").withColumn("words", F.coalesce("words", F.lit(0)))
    else:
        out = out.withColumn("words", F.col("_turn_words")).withColumn("_mean", F.lit(0.0)).withColumn("_low", F.lit(0).cast("long"))
    speech = F.when(F.col("_speech") == 0, 1.0).otherwise(F.col("_speech"))
    out = out.select(
        *keys,
        "turns",
        "words",
        "speakers",
        F.coalesce("_mean", F.lit(0.0)).alias("mean_confidence"),
        F.coalesce("_low", F.lit(0)).alias("low_confidence_words"),
        F.round(100 * F.coalesce("_low", F.lit(0)) / F.greatest("words", F.lit(1)), 1).alias("low_confidence_pct"),
        F.coalesce("repeated", F.lit(0)).alias("repeated"),
        F.coalesce("repeated_examples", F.array().cast("array<string>")).alias("repeated_examples"),
        "stretched",
        "stretched_examples",
        "buried",
        "buried_examples",
        F.round(F.col("buried") / F.greatest("turns", F.lit(1)), 4).alias("buried_rate"),
        F.round(F.round(F.coalesce("_dominant", F.lit(0.0)), 6), 1).alias("dominant_pct"),
        F.round(F.col("words") / speech, 2).alias("words_per_speech_sec"),
    )
    return out.withColumn("verdict", verdict(expected)).withColumn("problems", problems(expected))


def _widespread() -> Column:
    return F.col("buried") * 10 >= F.greatest("turns", F.lit(1))


def _rules(expected: int | None) -> dict[str, Column]:
    never = F.lit(False)
    return {
        "extra speakers": F.col("speakers") > expected if expected else never,
        "missing speakers": F.col("speakers") < expected if expected else never,
        "repeated lines": F.col("repeated") > 0,
        "stretched turns": F.col("stretched") > 0,
        "buried answers": F.col("buried") > 0,
        "one speaker dominates": (F.col("buried") >= 3) & (F.col("dominant_pct") > 85),
        "low confidence": F.col("low_confidence_pct") > 10,
    }


def verdict(expected: int | None = 2) -> Column:
    """empty, one-sided, clean, unreliable or suspect, in this order of precedence."""
    rules = _rules(expected)
    severe = (_widespread() & (F.col("buried") >= 3)) | rules["extra speakers"] | rules["one speaker dominates"] | (F.col("repeated") >= 3)
    one_sided = (F.col("speakers") == 1) & (F.col("buried") == 0) & (F.col("words") < 120) if expected else F.lit(False)
    some = F.lit(False)
    for rule in rules.values():
        some = some | rule
    return F.when(F.col("words") < 5, "empty").when(one_sided, "one-sided").when(~some, "clean").when(severe, "unreliable").otherwise("suspect")


def problems(expected: int | None = 2) -> Column:
    """What is wrong, as sentences; needs the columns of assess and verdict."""
    rules = _rules(expected)
    pct = F.format_string("%.0f", 100 * F.col("buried") / F.greatest("turns", F.lit(1)))
    texts = {
        "extra speakers": F.format_string(f"%d speakers where {expected} were expected", F.col("speakers")),
        "missing speakers": F.format_string(f"only %d of {expected} expected speakers", F.col("speakers")),
        "repeated lines": F.format_string("%d repeated lines, such as '%s'", F.col("repeated"), F.substring(F.get("repeated_examples", 0), 1, 50)),
        "stretched turns": F.format_string("%d turns slower than speech, such as '%s'", F.col("stretched"), F.get("stretched_examples", 0)),
        "buried answers": F.concat(
            F.format_string("%d of %d turns (", F.col("buried"), F.col("turns")),
            pct,
            F.lit("%) hold a question and its answer, "),
            F.when(_widespread(), "widespread").otherwise("isolated"),
            F.format_string(", such as '%s'", F.substring(F.get("buried_examples", 0), 1, 70)),
        ),
        "one speaker dominates": F.concat(F.lit("one speaker holds "), F.col("dominant_pct").cast("string"), F.lit("% of the talk")),
        "low confidence": F.concat(F.col("low_confidence_pct").cast("string"), F.lit("% of the words are below the confidence limit")),
    }
    listed = F.array_compact(F.array(*(F.when(rules[k], text) for k, text in texts.items())))
    return (
        F.when(F.col("verdict") == "empty", F.array(F.lit("little or no speech")))
        .when(F.col("verdict") == "one-sided", F.array(F.lit("short recording of a single voice")))
        .otherwise(listed)
    )


def transcript_metrics(turns: DataFrame, words: DataFrame, keys=KEYS) -> DataFrame:
    """Per call: turns, words, speakers, mean confidence, low-confidence and unattributed words, duration; zeros rather than nulls."""
    t = turns.groupBy(*keys).agg(F.count("*").alias("turns"), F.round(F.max("end"), 2).alias("duration_sec"))
    w = words.groupBy(*keys).agg(
        F.count("*").alias("words"),
        F.count_distinct("speaker").alias("speakers"),
        F.coalesce(F.round(F.avg("probability"), 4), F.lit(0.0)).alias("mean_word_confidence"),
        F.count_if(F.col("probability") < LOW_CONFIDENCE).alias("low_confidence_words"),
        F.count_if(F.col("speaker").isNull()).alias("unattributed_words"),
    )
    return t.join(w, list(keys), "full").fillna(0)
