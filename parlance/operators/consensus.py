"""Two token streams of one call: alignment, disputes and their escalation.

The alignment itself is Ratcliff-Obershelp matching, which no window or join can
express, so it runs per call in Arrow batches; all that follows is native.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .intervals import KEYS, along, dealt

_DROP = re.compile(r"[^\w֐-׿]+")


NEEDED = ["call_id", "idx", "word", "start", "end", "probability"]


def _norm(word: str | None) -> str:
    return _DROP.sub("", word or "").lower().strip()


class _Stream:
    """The words of one side of a call, in order, as plain lists and arrays."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.word = [w or "" for w in rows["word"]]
        self.normal = [_norm(w) for w in self.word]
        self.idx = rows["idx"].astype(int).tolist()
        self.probability = rows["probability"].fillna(0.0).to_numpy(float)
        self.start, self.end = (rows[c].to_numpy(float) for c in ("start", "end"))

    def mean(self, i: int, j: int) -> float:
        return float(self.probability[i:j].mean()) if j > i else 0.0

    def text(self, i: int, j: int) -> str:
        return " ".join(self.word[i:j])

    def span(self, i: int, j: int) -> tuple[float, float]:
        """Least start and largest end; null times are passed over."""
        return float(np.fmin.reduce(self.start[i:j])), float(np.fmax.reduce(self.end[i:j]))


def align_streams(a: DataFrame, b: DataFrame, by_probability: bool = False, margin: float = 0.05) -> DataFrame:
    """Aligned parts of two word tables (call_id, idx, word, start, end, probability).

    One row per part: call_id, op_idx, op (equal, replace, delete, insert), kept (a or
    b), a_words and b_words (arrays of idx), texts, mean probabilities, start, end.
    Where both have words b is kept only by_probability, if its mean is higher by
    margin. Calls that only one side has are all delete or insert.
    """
    schema = T.StructType(
        [T.StructField("call_id", a.schema["call_id"].dataType), T.StructField("op_idx", T.IntegerType()), T.StructField("op", T.StringType()), T.StructField("kept", T.StringType())]
        + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("a_words", "b_words")]
        + [T.StructField(c, T.StringType()) for c in ("text_a", "text_b")]
        + [T.StructField(c, T.DoubleType()) for c in ("prob_a", "prob_b", "start", "end")]
    )

    def align(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["start", "idx"])
        call, of_b = group["call_id"].iloc[0], group["_side"].to_numpy() == 1
        left, right = _Stream(group[~of_b]), _Stream(group[of_b])
        codes = SequenceMatcher(None, left.normal, right.normal, autojunk=False).get_opcodes()
        rows = []
        for k, (op, i, i_end, j, j_end) in enumerate(codes):
            p, q = left.mean(i, i_end), right.mean(j, j_end)
            take_b = op == "insert" or (op == "replace" and by_probability and q > p + margin)
            span = right.span(j, j_end) if take_b else left.span(i, i_end)
            rows.append((call, k, op, "b" if take_b else "a", left.idx[i:i_end], right.idx[j:j_end], left.text(i, i_end), right.text(j, j_end), p, q, *span))
        return pd.DataFrame(rows, columns=schema.names)

    both = a.select(*NEEDED, F.lit(0).alias("_side")).unionByName(b.select(*NEEDED, F.lit(1).alias("_side")))
    return dealt(both, "call_id").groupBy("call_id").applyInPandas(align, schema)


def merged_words(a: DataFrame, b: DataFrame, parts: DataFrame) -> DataFrame:
    """The kept words with agreement and source, in time order: call_id, source, idx, word, start, end, probability, agreement."""

    def side(words: DataFrame, name: str) -> DataFrame:
        own = parts.filter(F.col("kept") == name).select("call_id", (F.col("op") == "equal").alias("agreement"), F.explode(f"{name}_words").alias("idx"))
        return words.join(own, ["call_id", "idx"]).select("call_id", F.lit(name).alias("source"), "idx", "word", "start", "end", "probability", "agreement")

    return side(a, "a").unionByName(side(b, "b"))


def agreement(parts: DataFrame, keys=KEYS) -> DataFrame:
    """Counts of words agreed, disagreed, in one stream only, and the agreement in percent, 0 for empty calls."""
    na, nb = F.size("a_words"), F.size("b_words")
    out = parts.groupBy(*keys).agg(
        F.sum(F.when(F.col("op") == "equal", na).otherwise(0)).alias("agreed"),
        F.sum(F.when(F.col("op") == "replace", F.greatest(na, nb)).otherwise(0)).alias("disagreed"),
        F.sum(F.when(F.col("op") == "delete", na).otherwise(0)).alias("only_a"),
        F.sum(F.when(F.col("op") == "insert", nb).otherwise(0)).alias("only_b"),
    )
    return out.withColumn("agreement_pct", agreement_pct(F.col("agreed"), F.col("disagreed"), F.col("only_a"), F.col("only_b")))


def agreement_pct(agreed: Column, *others: Column) -> Column:
    total = agreed
    for x in others:
        total = total + x
    return F.when(total > 0, F.round(100 * agreed / total, 1)).otherwise(0.0)


def disagreements(parts: DataFrame, label_a: str = "a", label_b: str = "b") -> DataFrame:
    """A row per disputed part, by start: the columns of the disagreements table."""
    rows = parts.filter("op <> 'equal'")
    place = F.row_number().over(Window.partitionBy("call_id").orderBy("start", "op_idx")) - 1
    return rows.select(
        "call_id",
        place.alias("d_idx"),
        F.round("start", 2).alias("start"),
        F.round("end", 2).alias("end"),
        F.lit(label_a).alias("label_a"),
        "text_a",
        F.lit(label_b).alias("label_b"),
        "text_b",
        F.when(F.col("kept") == "a", label_a).otherwise(label_b).alias("kept"),
        F.round("prob_a", 3).alias("prob_a"),
        F.round("prob_b", 3).alias("prob_b"),
        F.lit(False).alias("hesitation"),
        F.lit(None).cast("string").alias("resolved"),
        F.when(F.col("kept") == "a", F.col("a_words")).otherwise(F.col("b_words")).alias("out_word_ids"),
    )


def hesitations(words: DataFrame, threshold: float = 0.78, neighbour: float = 0.90, opening: float = 30.0, opening_threshold: float = 0.88, opening_neighbour: float = 0.85, most: int = 60, keys=KEYS) -> DataFrame:
    """Agreed words that dip below the threshold between confident neighbours: the `most` deepest of a call, with rank.

    The opening seconds have limits of their own. A missing neighbour and a null
    probability count as 1. Only words of two letters or more are looked at.
    """
    w = along(keys)
    p = F.coalesce("probability", F.lit(1.0))
    early = F.col("start") <= opening
    limit, near = F.when(early, opening_threshold).otherwise(threshold), F.when(early, opening_neighbour).otherwise(neighbour)
    rows = words.withColumn("_p", p).withColumn("_before", F.lag(p, 1, 1.0).over(w)).withColumn("_after", F.lead(p, 1, 1.0).over(w))
    dips = rows.filter(F.col("agreement") & (F.col("_p") < limit) & (F.col("_before") >= near) & (F.col("_after") >= near) & (F.length(X.normalise(F.col("word"), False)) >= 2))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_p", "start", "idx"))
    return dips.withColumn("rank", rank).filter(F.col("rank") <= most).select(*words.columns, "rank")


def unresolved(disputes: DataFrame, most: int = 80, keys=KEYS) -> DataFrame:
    """What goes on to the listener: unresolved disputes with words, the first `most` of a call."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("start", "d_idx"))
    open_ = (F.col("resolved") == "unresolved") & (F.size("out_word_ids") > 0)
    return disputes.filter(open_).withColumn("turn", rank).filter(F.col("turn") <= most)


def mark_unresolved(disputes: DataFrame) -> DataFrame:
    return disputes.withColumn("resolved", F.coalesce("resolved", F.lit("unresolved")))


@F.pandas_udf(T.DoubleType())
def coverage(text: pd.Series, target: pd.Series) -> pd.Series:
    """Share of the target's characters that lie in matching blocks with the text, both normalised with spaces; 0 for an empty target."""
    clean = lambda s: re.sub(r"[^\w֐-׿ ]+", "", s or "").lower().strip()

    def one(a: str | None, b: str | None) -> float:
        a, b = clean(a), clean(b)
        return sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) / len(b) if b else 0.0

    return pd.Series([one(a, b) for a, b in zip(text, target)])


def referee(cov_a: Column, cov_b: Column, has_b: Column | None = None) -> Column:
    """secondary if the other reading was heard clearly better, primary-confirmed if the kept one was, else unresolved."""
    has_b = F.lit(True) if has_b is None else has_b
    a, b = F.round(cov_a, 9), F.round(cov_b, 9)
    return (
        F.when((b > F.round(a + 0.1, 9)) & (b >= 0.7) & has_b, "secondary")
        .when((a >= 0.7) & (F.round(a - b, 9) >= 0.2), "primary-confirmed")
        .otherwise("unresolved")
    )


def referee_hesitations(probes: DataFrame, keys=("call_id", "d_idx")) -> DataFrame:
    """(keys, resolved): confirmed only if every probe covers 0.7 of the word."""
    ok = F.coalesce(F.bool_and(F.col("coverage") >= 0.7), F.lit(False))
    return probes.groupBy(*keys).agg(F.when(ok, "primary-confirmed").otherwise("unresolved").alias("resolved"))


def best_probe(probes: DataFrame, keys=("call_id", "d_idx")) -> DataFrame:
    """The probe (pos, text, cov_a, cov_b) that separates the readings most, the first on a tie."""
    apart = F.round(F.abs(F.col("cov_a") - F.col("cov_b")), 9)
    return probes.groupBy(*keys).agg(F.max_by(F.struct("pos", "text", "cov_a", "cov_b"), F.struct(apart, -F.col("pos"))).alias("p")).select(*keys, "p.*")


def outcome_counts(disputes: DataFrame, keys=KEYS) -> DataFrame:
    return disputes.groupBy(*keys, F.coalesce("resolved", F.lit("open")).alias("resolved")).agg(F.count("*").alias("n"))


def context(disputes: DataFrame, words: DataFrame, before: int = 120, after: int = 120, keys=KEYS) -> DataFrame:
    """(keys, d_idx, prev_text, next_text): agreed words that end before and start after each dispute, the last and first characters of them."""
    own = disputes.select(*(F.col(k).alias(f"_{k}") for k in keys), "d_idx", F.col("start").alias("d_start"), F.col("end").alias("d_end"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    agreed = words.filter("agreement").select(*keys, "idx", "word", "start", "end")
    # A word is a character or more, so as many words as characters are enough on each side.
    rank_back = F.row_number().over(Window.partitionBy(*keys, "d_idx").orderBy(F.col("start").desc(), F.col("idx").desc()))
    rank_on = F.row_number().over(Window.partitionBy(*keys, "d_idx").orderBy("start", "idx"))

    def joined(side: DataFrame) -> DataFrame:
        rows = F.sort_array(F.collect_list(F.struct("start", "idx", "word")))
        return side.groupBy(*keys, "d_idx").agg(F.array_join(F.transform(rows, lambda r: r["word"]), " ").alias("text"))

    back = joined(agreed.join(own, same & (F.col("end") <= F.col("d_start"))).withColumn("r", rank_back).filter(F.col("r") <= before))
    on = joined(agreed.join(own, same & (F.col("start") >= F.col("d_end"))).withColumn("r", rank_on).filter(F.col("r") <= after))
    out = disputes.select(*keys, "d_idx").join(back.withColumnRenamed("text", "_p"), [*keys, "d_idx"], "left").join(on.withColumnRenamed("text", "_n"), [*keys, "d_idx"], "left")
    return out.select(*keys, "d_idx", F.right(F.coalesce("_p", F.lit("")), F.lit(before)).alias("prev_text"), F.left(F.coalesce("_n", F.lit("")), F.lit(after)).alias("next_text"))


@F.pandas_udf(T.StringType())
def fuzzy_anchor_trim(answer: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
    """Anchor trimming where the context was heard otherwise: cuts through the window most like the nearest four words of context, if its ratio is 0.75."""

    def window(tokens: list[str], anchor: list[str]) -> tuple[float, int, int]:
        best = (0.0, 0, 0)
        for size in sorted({max(1, len(anchor) - 1), len(anchor), len(anchor) + 1}):
            for i in range(len(tokens) - size + 1):
                ratio = SequenceMatcher(None, " ".join(anchor), " ".join(tokens[i : i + size]), autojunk=False).ratio()
                if ratio > best[0]:
                    best = (ratio, i, i + size)
        return best

    def one(text: str, prev: str, following: str) -> str:
        tokens = (text or "").split()
        for anchor, at_start in (((prev or "").split()[-4:], True), ((following or "").split()[:4], False)):
            if not anchor or len(tokens) < 2:
                continue
            ratio, a, b = window([_norm(t) for t in tokens], [_norm(t) for t in anchor])
            if ratio >= 0.75 and at_start and b < len(tokens):
                tokens = tokens[b:]
            elif ratio >= 0.75 and not at_start and a > 0:
                tokens = tokens[:a]
        return " ".join(tokens)

    return pd.Series([one(*x) for x in zip(answer, before, after)])


def splice(words: DataFrame, answers: DataFrame, keys=KEYS, least_confidence: float = 0.5) -> DataFrame:
    """words with disputed ones replaced by the tokens of an answer, evenly spaced: keys, start, end, word, probability, source.

    answers: keys, d_idx, out_word_ids, text, confidence; those under
    least_confidence, or without one, change nothing. A token at the edge that
    equals the neighbouring word outside goes; an answer with no tokens left changes
    nothing. A token lasts 0.05 seconds or more.
    """
    w, answers = along(keys), answers.filter(F.col("confidence") >= least_confidence)
    around = words.withColumn("_prev", F.lag("word").over(w)).withColumn("_next", F.lead("word").over(w))
    ids = answers.select(*keys, "d_idx", F.explode("out_word_ids").alias("idx"))
    spans = around.join(ids, [*keys, "idx"]).groupBy(*keys, "d_idx").agg(
        F.min("start").alias("s"), F.max("end").alias("e"), F.min_by("_prev", F.struct("start", "idx")).alias("_prev"), F.max_by("_next", F.struct("start", "idx")).alias("_next")
    )
    rows = answers.join(spans, [*keys, "d_idx"]).withColumn("t", X.words_of(F.col("text")))
    same = lambda a, b: F.coalesce((X.normalise(a) == X.normalise(b)) & (X.normalise(a) != ""), F.lit(False))
    rows = rows.withColumn("t", F.when(same(F.get("t", 0), F.col("_prev")), F.slice("t", 2, F.size("t"))).otherwise(F.col("t")))
    last = F.get(F.col("t"), F.size("t") - 1)
    rows = rows.withColumn("t", F.when(same(last, F.col("_next")), F.slice("t", 1, F.size("t") - 1)).otherwise(F.col("t"))).filter(F.size("t") > 0)
    step = F.greatest((F.col("e") - F.col("s")) / F.size("t"), F.lit(0.05))
    new = rows.select(*keys, "s", step.alias("step"), F.col("confidence").alias("probability"), F.posexplode("t").alias("k", "word"))
    new = new.select(
        *keys, F.round(F.col("s") + F.col("k") * F.col("step"), 3).alias("start"), F.round(F.col("s") + (F.col("k") + 1) * F.col("step"), 3).alias("end"), "word", "probability", F.lit("rescue").alias("source")
    )
    gone = rows.select(*keys, F.explode("out_word_ids").alias("idx"))
    kept = words.join(gone, [*keys, "idx"], "left_anti").select(*keys, "start", "end", "word", "probability", F.lit("kept").alias("source"))
    return kept.unionByName(new)


def rebase(words: DataFrame, targets: DataFrame, keys=("call_id", "d_idx")) -> DataFrame:
    """Words moved into another span by an affine map of their times; targets: keys, a_start, a_end."""
    w = Window.partitionBy(*keys)
    low, high = F.min("start").over(w), F.max("end").over(w)
    rows = words.withColumn("_low", low).withColumn("_scale", F.greatest(high - low, F.lit(1e-6))).join(targets, list(keys))
    scale = F.greatest(F.col("a_end") - F.col("a_start"), F.lit(0.05)) / F.col("_scale")
    move = lambda c: F.round(F.col("a_start") + (F.col(c) - F.col("_low")) * scale, 3)
    return rows.withColumns({"start": move("start"), "end": move("end")}).select(*words.columns)


def repeats(said: np.ndarray, cycle: int) -> np.ndarray:
    """How often the `cycle` tokens from each place on are said in a row there, once included; 1 where one of them is empty or missing."""
    n = len(said)
    same = np.zeros(n, bool)
    same[: max(0, n - cycle)] = said[: max(0, n - cycle)] == said[cycle:]
    place = np.arange(n)
    #: The first place from each one on whose token isn't the one `cycle` later.
    ends = np.minimum.accumulate(np.where(same, n, place)[::-1])[::-1] if n else place
    times = 1 + (ends - place) // cycle
    for k in range(cycle):
        empty = np.ones(n, bool)
        empty[: max(0, n - k)] = said[k:] == ""
        times[empty] = 1
    return times


def collapse_loops(words: DataFrame, most: int = 3, keys=KEYS) -> DataFrame:
    """words without the repeats of loops, and the loops of the call.

    At each place, in time order, a cycle of one token is tried, then one of two;
    one that is said over `most` times in a row keeps the first `most`, and the
    scan goes on after its last time. Tokens are compared in lower case without
    outer spaces and .,!? and must not be empty; null counts as empty. Linear in
    the words of a call.
    """
    schema = T.StructType([*words.schema.fields, T.StructField("loops", T.IntegerType())])

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["start", "idx"]).reset_index(drop=True)
        said = np.array([(w or "").strip(" .,!?").lower() for w in rows["word"]], object)
        times = {cycle: repeats(said, cycle) for cycle in (1, 2)}
        looped = np.flatnonzero((times[1] > most) | (times[2] > most))
        stays, after, loops = np.ones(len(rows), bool), 0, 0
        for i in looped.tolist():
            if i >= after:
                cycle = 1 if times[1][i] > most else 2
                after = i + cycle * int(times[cycle][i])
                stays[i + cycle * most : after] = False
                loops += 1
        return rows[stays].assign(loops=loops)

    return dealt(words, *keys).groupBy(*keys).applyInPandas(scan, schema)


def ends_of_frames(path: DataFrame, frame_sec: float, least: float = 0.0, keys=KEYS) -> DataFrame:
    """Words from a frame-to-token path (frame_idx, token_idx, score): start, end and mean score of each run; ok if that is at least `least`."""
    rows = path.filter("token_idx is not null").groupBy(*keys, "token_idx").agg(
        F.round(F.min("frame_idx") * frame_sec, 3).alias("start"), F.round((F.max("frame_idx") + 1) * frame_sec, 3).alias("end"), F.round(F.avg("score"), 3).alias("align_score")
    )
    return rows.withColumn("ok", F.col("align_score") >= least)


def align_chunks(words: DataFrame, limit: float = 20.0, pause: float = 0.15, keys=KEYS) -> DataFrame:
    """Adds chunk: a new one begins at a pause over `pause` once the word would end over limit seconds after the chunk's start."""
    order = F.sort_array(F.collect_list(F.struct("start", "idx", "end")))
    zero = F.struct(F.lit(None).cast("double").alias("from"), F.lit(None).cast("double").alias("to"), F.lit(0).alias("c"), F.array().cast("array<struct<idx:int,c:int>>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        new = acc["from"].isNotNull() & (w["end"] - acc["from"] > limit) & (w["start"] - acc["to"] > pause)
        c = acc["c"] + new.cast("int")
        return F.struct(
            F.when(acc["from"].isNull() | new, w["start"]).otherwise(acc["from"]).alias("from"), w["end"].alias("to"), c.alias("c"), F.concat(acc["out"], F.array(F.struct(w["idx"].cast("int").alias("idx"), c.alias("c")))).alias("out")
        )

    packed = words.groupBy(*keys).agg(order.alias("rows")).select(*keys, F.explode(F.aggregate("rows", zero, step)["out"]).alias("o"))
    return words.join(packed.select(*keys, F.col("o.idx").alias("idx"), F.col("o.c").alias("chunk")), [*keys, "idx"])


def same_count_or_none(before: DataFrame, after: DataFrame, keys=KEYS) -> DataFrame:
    """after for calls in which it has as many rows as before, before for the others; both have the same columns."""
    n = before.groupBy(*keys).agg(F.count("*").alias("_a")).join(after.groupBy(*keys).agg(F.count("*").alias("_b")), list(keys), "left")
    ok = n.filter("_a = _b").select(*keys)
    return after.join(ok, list(keys), "left_semi").unionByName(before.join(ok, list(keys), "left_anti"))
