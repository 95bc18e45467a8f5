"""Intervals on one clock: islands, overlap, nearest, as-of and snapping joins.

All functions partition by `keys` (one call, by default) and break ties by the
index column, so results don't depend on how rows are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import rounded

KEYS = ("call_id",)


def along(keys=KEYS, order=("start", "idx")):
    return Window.partitionBy(*keys).orderBy(*order)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in as many partitions by keys as shuffles have, for folds whose work exceeds what their bytes tell: adaptive merging leaves these partitions alone."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def islands(df: DataFrame, begins: Column, keys=KEYS, order=("start", "idx"), name: str = "island") -> DataFrame:
    """Adds the number (from 0) of the island that a row is in; a row begins one where begins is true, and the first row always does."""
    w = along(keys, order)
    first = F.row_number().over(w) == 1
    flagged = df.withColumn("_begins", F.when(first, 0).otherwise(F.coalesce(begins, F.lit(False)).cast("int")))
    return flagged.withColumn(name, F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_begins")


def merge_runs(df: DataFrame, gap: float | None = None, keys=KEYS, label: str = "speaker", idx: str = "idx", text: str | None = None) -> DataFrame:
    """Neighbours of one label become one row: keys, run, label, start, end (the largest), n and, given its column, their text in order.

    With a gap, a row joins only if it starts at most gap seconds after the largest
    end so far of its label's run.
    """
    order = ("start", idx)
    w = along(keys, order)
    changed = ~F.lag(label).over(w).eqNullSafe(F.col(label))
    runs = islands(df, changed, keys, order, "_run")
    if gap is not None:
        so_far = F.max("end").over(along((*keys, "_run"), order).rowsBetween(Window.unboundedPreceding, -1))
        runs = runs.withColumn("_so_far", so_far)
        runs = islands(runs, F.col("_so_far").isNull() | (F.col("start") - F.col("_so_far") > gap), keys, order, "_run")
    said = [] if text is None else [F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", idx, F.col(text).alias("_said")))), lambda r: r["_said"]), " ").alias(text)]
    return (
        runs.groupBy(*keys, F.col("_run").alias("run"))
        .agg(F.min_by(label, F.struct("start", idx)).alias(label), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), *said)
    )


def gaps(df: DataFrame, keys=KEYS, idx: str = "idx") -> DataFrame:
    """Adds gap: seconds from the end of the row before, null for the first."""
    return df.withColumn("gap", F.col("start") - F.lag("end").over(along(keys, ("start", idx))))


def overlap_join(left: DataFrame, right: DataFrame, keys=KEYS, bucket: float | None = None, how: str = "inner") -> DataFrame:
    """Rows of left (start, end) with those of right (r_start, r_end) that overlap by more than a point.

    bucket: seconds of a time bucket that joins the keys, for calls too long for one
    task; a pair is kept in the bucket where the later of the two starts.
    """
    hit = (F.col("start") < F.col("r_end")) & (F.col("end") > F.col("r_start"))
    if bucket is None:
        return left.join(right.withColumnsRenamed({k: f"_{k}" for k in keys}), _equal(keys) & hit, how).drop(*(f"_{k}" for k in keys))
    if how != "inner":
        raise ValueError("buckets are for inner joins")

    def spread(df: DataFrame, a: str, b: str) -> DataFrame:
        first, last = F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket)
        return df.withColumn("_bucket", F.explode(F.sequence(first, F.greatest(first, last))))

    joined = spread(left, "start", "end").join(spread(right, "r_start", "r_end"), [*keys, "_bucket"]).filter(hit)
    return joined.filter(F.col("_bucket") == F.floor(F.greatest("start", "r_start") / bucket)).drop("_bucket")


def _equal(keys) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(k) == F.col(f"_{k}"))
    return out


def neighbours(points: DataFrame, spans: DataFrame, keys=KEYS, at: str = "mid") -> DataFrame:
    """Adds `before` struct<edge, idx> (the span with the last end up to the point) and `after` (with the first start from it on).

    spans: keys, r_idx, r_start, r_end. One sort by time for each side, no pairs.
    Ties go to the smallest r_idx.
    """
    kept = points.columns
    marks = points.withColumn("_t", F.col(at)).withColumn("_own", F.lit(1))
    ends = spans.select(*keys, F.col("r_end").alias("_t"), F.lit(0).alias("_own"), F.struct(F.col("r_end").alias("edge"), (-F.col("r_idx")).alias("back")).alias("_end"))
    starts = spans.select(*keys, F.col("r_start").alias("_t"), F.lit(2).alias("_own"), F.struct(F.col("r_start").alias("edge"), F.col("r_idx").alias("idx")).alias("_start"))
    rows = marks.unionByName(ends, allowMissingColumns=True).unionByName(starts, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_own")
    rows = rows.withColumn("before", F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("after", F.min("_start").over(w.rowsBetween(0, Window.unboundedFollowing)))
    before = F.when(F.col("before").isNotNull(), F.struct(F.col("before.edge").alias("edge"), (-F.col("before.back")).alias("idx")))
    return rows.filter("_own = 1").select(*kept, before.alias("before"), "after")


def assign_words(words: DataFrame, segments: DataFrame, keys=KEYS, bucket: float | None = None) -> DataFrame:
    """words with assigned (label) and speaker_confidence from segments (seg_idx, start, end, speaker).

    The label with the largest summed overlap wins, the one whose first overlapping
    segment comes first on a tie; confidence is that overlap over the word's length,
    at most 1. Without overlap the segment nearest to the word's middle, the
    first on a tie, with confidence 0; null without segments, or where the segment
    has no label.
    """
    spans = segments.select(*keys, F.col("seg_idx").alias("r_idx"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("speaker").alias("r_speaker"))
    part = F.least("end", "r_end") - F.greatest("start", "r_start")
    best = (
        overlap_join(words.select(*keys, "idx", "start", "end"), spans, keys, bucket)
        .groupBy(*keys, "idx", "r_speaker")
        .agg(F.sum(part).alias("shared"), F.min("r_idx").alias("first"))
        .groupBy(*keys, "idx")
        .agg(F.max(F.struct(F.round("shared", 9).alias("shared"), (-F.col("first")).alias("first"), F.col("r_speaker").alias("speaker"))).alias("best"))
    )
    near = nearest_segment(words.join(best, [*keys, "idx"], "left_anti"), spans, keys)
    length = F.greatest(F.col("end") - F.col("start"), F.lit(1e-6))
    sure = rounded(F.least(F.col("best.shared") / length, F.lit(1.0)), 3)
    return (
        words.join(best, [*keys, "idx"], "left")
        .join(near, [*keys, "idx"], "left")
        .select(
            *words.columns,
            F.coalesce(F.col("best.speaker"), F.col("near_speaker")).alias("assigned"),
            F.when(F.col("best.speaker").isNotNull(), sure).when(F.col("near_speaker").isNotNull(), 0.0).alias("speaker_confidence"),
        )
    )


def nearest_segment(words: DataFrame, spans: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, idx, near_idx, near_speaker, distance): the span nearest to the middle of each word, to the microsecond, 0 away inside one; the smallest r_idx on a tie."""
    points = words.select(*keys, "idx", ((F.col("start") + F.col("end")) / 2).alias("mid"))
    inside = points.join(spans.withColumnsRenamed({k: f"_{k}" for k in keys}), _equal(keys) & (F.col("r_start") <= F.col("mid")) & (F.col("mid") <= F.col("r_end")))
    inside = inside.groupBy(*keys, "idx").agg(F.min("r_idx").alias("in_idx"))
    sides = neighbours(points, spans, keys).join(inside, [*keys, "idx"], "left")
    back, on = F.col("mid") - F.col("before.edge"), F.col("after.edge") - F.col("mid")
    nearer = F.round(back, 6) - F.round(on, 6)
    pick = (
        F.when(F.col("in_idx").isNotNull(), F.struct(F.lit(0.0).alias("d"), F.col("in_idx").alias("i")))
        .when(F.col("after").isNull() | (nearer < 0), F.struct(back.alias("d"), F.col("before.idx").alias("i")))
        .when(F.col("before").isNull() | (nearer > 0), F.struct(on.alias("d"), F.col("after.idx").alias("i")))
        .otherwise(F.struct(back.alias("d"), F.least("before.idx", "after.idx").alias("i")))
    )
    chosen = sides.select(*keys, "idx", pick.alias("p")).select(*keys, "idx", F.col("p.i").alias("r_idx"), F.col("p.d").alias("distance"))
    return chosen.join(spans, [*keys, "r_idx"]).select(*keys, "idx", F.col("r_idx").alias("near_idx"), F.col("r_speaker").alias("near_speaker"), "distance")


def timeline(spans: DataFrame, keys=KEYS) -> DataFrame:
    """spans with cum and next_cum, their place on the clock from which silence is cut, next_start, and last."""
    w = along(keys, ("start", "span_idx"))
    length = F.col("end") - F.col("start")
    upto = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        spans.withColumn("next_cum", upto)
        .withColumn("cum", F.col("next_cum") - length)
        .withColumn("next_start", F.lead("start").over(w))
    )


def to_original(points: DataFrame, spans: DataFrame, time: str = "t", tolerance: float = 0.15, keys=KEYS, name: str = "original") -> DataFrame:
    """Adds a time on the full clock for one on the trimmed clock, as an as-of join with the timeline.

    A time within tolerance of a span's end belongs to the start of the next span;
    times outside are clamped to the first start and the last end. Each point meets
    the last span that starts up to it, found by one sort by time. Without spans
    the time stays as it is.
    """
    line = timeline(spans, keys).select(*keys, F.struct("cum", "next_cum", "start", "end", "next_start").alias("_span"))
    rows = points.withColumn("_t", F.col(time)).withColumn("_own", F.lit(1)).unionByName(
        line.withColumn("_t", F.col("_span.cum")).withColumn("_own", F.lit(0)), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy("_t", "_own", "_span")
    at = F.last("_span", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min("_span").over(Window.partitionBy(*keys))
    rows = rows.withColumn("_at", F.coalesce(at, first)).filter("_own = 1")
    inside = F.col("_at.start") + (F.col(time) - F.col("_at.cum"))
    jump = F.col("_at.next_start").isNotNull() & (F.col("_at.next_cum") - F.col(time) <= tolerance + 1e-9)
    mapped = F.when(F.col("_at").isNull(), F.col(time)).when(F.col(time) <= F.col("_at.cum"), F.col("_at.start")).when(jump, F.col("_at.next_start"))
    return rows.select(*points.columns, F.round(mapped.otherwise(F.least(inside, F.col("_at.end"))), 6).alias(name))


def snap(words: DataFrame, spans: DataFrame, most: float = 2.0, keys=KEYS, bucket: float | None = None) -> DataFrame:
    """words with new_start, new_end and moved: held to the span that they overlap most, else shifted to the nearest edge within most seconds.

    Every span is a candidate; the earliest wins a tie. A word left without length
    stays where it was. moved: an end changed by over 0.02 seconds.
    """
    r = spans.select(*keys, F.col("span_idx").alias("r_idx"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    part = F.round(F.least("end", "r_end") - F.greatest("start", "r_start"), 9)
    best = overlap_join(words.select(*keys, "idx", "start", "end"), r, keys, bucket).groupBy(*keys, "idx")
    best = best.agg(F.max(F.struct(part.alias("shared"), (-F.col("r_idx")).alias("back"), "r_start", "r_end")).alias("best"))
    points = words.select(*keys, "idx", "start", "end").withColumn("mid", F.col("start"))
    sides = neighbours(points, r, keys)
    sides = sides.select(*keys, "idx", F.col("before.edge").alias("edge_before"), F.col("after.edge").alias("edge_after"))
    rows = words.join(best, [*keys, "idx"], "left").join(sides, [*keys, "idx"], "left")
    length = F.col("end") - F.col("start")
    back, on = F.round(F.col("start") - F.col("edge_before"), 9), F.round(F.col("edge_after") - F.col("end"), 9)
    to_next = on.isNotNull() & (on <= most) & (back.isNull() | (on < back))
    to_last = back.isNotNull() & (back <= most)
    start = F.when(F.col("best").isNotNull(), F.greatest("start", "best.r_start")).when(to_next, F.col("edge_after")).when(to_last, F.col("edge_before") - length)
    end = F.when(F.col("best").isNotNull(), F.least("end", "best.r_end")).when(to_next, F.col("edge_after") + length).when(to_last, F.col("edge_before"))
    rows = rows.withColumn("_s", F.round(start, 3)).withColumn("_e", F.round(end, 3))
    good = F.col("_s").isNotNull() & (F.col("_e") > F.col("_s"))
    rows = rows.withColumn("new_start", F.when(good, F.col("_s")).otherwise(F.col("start"))).withColumn("new_end", F.when(good, F.col("_e")).otherwise(F.col("end")))
    moved = (F.abs(F.col("new_start") - F.col("start")) > 0.02) | (F.abs(F.col("new_end") - F.col("end")) > 0.02)
    return rows.select(*words.columns, "new_start", "new_end", moved.alias("moved"))


def attach_words(turns: DataFrame, words: DataFrame, slack: float = 0.05, half_open: bool = False, keys=KEYS) -> DataFrame:
    """Pairs (turn_id, idx) of words within a turn, give or take slack at both ends; a word may match two turns. half_open: by the word's start alone."""
    t = turns.select(*(F.col(k).alias(f"_{k}") for k in keys), "turn_id", F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    if half_open:
        within = (F.col("start") >= F.col("t_start") - slack) & (F.col("start") < F.col("t_end") + slack)
    else:
        within = (F.col("start") >= F.col("t_start") - slack) & (F.col("end") <= F.col("t_end") + slack)
    return words.select(*keys, "idx", "start", "end").join(t, _equal(keys) & within).select(*keys, "turn_id", "idx")


def speech_stats(spans: DataFrame, total: Column | None = None, keys=KEYS, idx: str = "span_idx", long_gap: float = 3.0) -> DataFrame:
    """Per call: spans, speech_sec, longest_gap, long_gaps and, given the recording's seconds, speech_ratio."""
    rows = gaps(spans, keys, idx)
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("spans"),
        F.round(F.sum(F.col("end") - F.col("start")), 3).alias("speech_sec"),
        F.round(F.coalesce(F.max("gap"), F.lit(0.0)), 3).alias("longest_gap"),
        F.count_if(F.col("gap") > long_gap).alias("long_gaps"),
        *([F.max(total).alias("_total")] if total is not None else []),
    )
    return out if total is None else out.withColumn("speech_ratio", F.round(F.col("speech_sec") / F.col("_total"), 4)).drop("_total")


def sound_runs(frames: DataFrame, loud: Column, frame_sec: float, close: float = 0.3, keys=KEYS) -> DataFrame:
    """(keys, run, start, end) of loud frames; pauses of up to close seconds between two runs are filled."""
    hits = frames.filter(loud).select(*keys, (F.col("frame_idx") * frame_sec).alias("start"), ((F.col("frame_idx") + 1) * frame_sec).alias("end"), F.col("frame_idx").alias("idx"))
    return merge_runs(hits.withColumn("speaker", F.lit("speech")), close + 1e-9, keys).select(*keys, "run", "start", "end")


def pack_windows(spans: DataFrame, low: float, high: float, adaptive: bool = False, keys=KEYS) -> DataFrame:
    """(keys, window, start, end): spans packed greedily into windows of low to high seconds.

    A window is cut at its first pause once it is low seconds long, or with
    adaptive at the longest pause before high, the first on a tie; one without such
    a pause takes all spans that fit, one at least. A fold within each call, so calls
    are the unit of work; only the ends of spans are handed to Python.
    """
    import pandas as pd

    kinds = ", ".join(f"{k} {spans.schema[k].dataType.simpleString()}" for k in keys)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["start", "span_idx"])
        starts, ends, out, k = rows["start"].tolist(), rows["end"].tolist(), [], 0
        while k < len(starts):
            fits = k
            while fits + 1 < len(ends) and ends[fits + 1] - starts[k] <= high:
                fits += 1
            legal = [j for j in range(k, min(fits + 1, len(ends) - 1)) if low <= ends[j] - starts[k] <= high]
            cut = fits
            if legal:
                cut = max(legal, key=lambda j: (starts[j + 1] - ends[j], -j)) if adaptive else legal[0]
            out.append((*[rows[c].iloc[0] for c in keys], len(out), starts[k], ends[cut]))
            k = cut + 1
        return pd.DataFrame(out, columns=[*keys, "window", "start", "end"])

    return dealt(spans.select(*keys, "span_idx", "start", "end"), *keys).groupBy(*keys).applyInPandas(pack, f"{kinds}, window int, start double, end double")


#: Window lengths of the segmentation variants: low, high, cut at the longest pause, seconds of overlap.
VARIANTS = {"B": (20, 30, False, 0.0), "C": (20, 30, False, 3.0), "D": (8, 15, False, 0.0), "E": (25, 45, False, 0.0), "F": (15, 40, True, 0.0), "G": (15, 40, True, 0.0)}


def group_by_span(turns: DataFrame, limit: float = 150.0, keys=KEYS, idx: str = "turn_id") -> DataFrame:
    """Adds window: a new one begins where a turn would end over limit seconds after the window's start.

    A fold over the sorted turns of a call, done by a higher-order function.
    """
    order = F.sort_array(F.collect_list(F.struct("start", F.col(idx).alias("i"), "end")))
    start = F.struct(F.lit(None).cast("double").alias("from"), F.lit(-1).alias("window"), F.array().cast("array<struct<i:int,window:int>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        new = acc["from"].isNull() | (t["end"] - acc["from"] > limit)
        window = acc["window"] + new.cast("int")
        row = F.array(F.struct(t["i"].cast("int").alias("i"), window.alias("window")))
        return F.struct(F.when(new, t["start"]).otherwise(acc["from"]).alias("from"), window.alias("window"), F.concat(acc["out"], row).alias("out"))

    packed = turns.groupBy(*keys).agg(order.alias("rows")).select(*keys, F.explode(F.aggregate("rows", start, step)["out"]).alias("o"))
    return turns.join(packed.select(*keys, F.col("o.i").alias(idx), F.col("o.window").alias("window")), [*keys, idx])


def stitch(windows: DataFrame, words: DataFrame, keys=KEYS) -> DataFrame:
    """Words of overlapping windows on the call's clock, each once.

    windows: keys, window, start, end (with the overlap); words: keys, window, idx,
    word, start, end on the window's own clock. Neighbouring windows share their
    overlap up to its middle: the first keeps what is before it, the second the rest.
    """
    w = Window.partitionBy(*keys).orderBy("window")
    low = (F.lag("end").over(w) + F.col("start")) / 2
    high = (F.lead("start").over(w) + F.col("end")) / 2
    bounds = windows.select(*keys, "window", F.col("start").alias("_from"), low.alias("_low"), high.alias("_high"))
    moved = words.join(bounds, [*keys, "window"]).withColumn("start", F.round(F.col("start") + F.col("_from"), 3)).withColumn("end", F.round(F.col("end") + F.col("_from"), 3))
    keep = (F.col("_low").isNull() | (F.col("start") >= F.col("_low"))) & (F.col("_high").isNull() | (F.col("start") < F.col("_high")))
    return moved.filter(keep).select(*words.columns)


def chunk_plan(calls: DataFrame, seconds: Column, length: float = 1200.0, keys=KEYS) -> DataFrame:
    """(keys, chunk, offset, length): each recording in pieces of at most length seconds."""
    n = F.greatest(F.lit(1), F.ceil(seconds / length)).cast("int")
    rows = calls.select(*keys, seconds.alias("_s"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return rows.select(*keys, "chunk", (F.col("chunk") * length).alias("offset"), F.least(F.lit(length), F.col("_s") - F.col("chunk") * length).alias("length"))


def rescale(words: DataFrame, tempo: float, offset: Column | None = None) -> DataFrame:
    """start and end from a stretched clock to the real one, plus an offset: t * tempo + offset, to the millisecond."""
    shift = F.lit(0.0) if offset is None else offset
    return words.withColumns({c: F.round(F.col(c) * tempo + shift, 3) for c in ("start", "end")})
