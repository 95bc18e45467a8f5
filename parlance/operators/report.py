"""Choosing among candidates, and reports over many calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severity of a verdict in reports, the worst first; others come last.
SEVERITY = {"unreliable": 0, "suspect": 1, "one-sided": 2, "empty": 3, "clean": 4}


def arbitrate(candidates: DataFrame, keys=("call_id",), order: list[Column] | None = None) -> DataFrame:
    """The best candidate of each call; by default fewest buried answers, then fewest problems, then rank."""
    order = order or [F.col("buried").asc(), F.size("problems").asc(), F.col("rank").asc()]
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return candidates.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def choose_engine(candidates: DataFrame, keys=("call_id",)) -> DataFrame:
    """The engine with the fewest buried answers, then the share nearest to half; failed ones are left out, unknown counts as 99 and 100."""
    order = [F.coalesce("buried", F.lit(99)).asc(), F.abs(F.coalesce("dominant_pct", F.lit(100.0)) - 50).asc(), F.col("rank").asc()]
    return arbitrate(candidates.filter("error is null"), keys, order)


def severity(verdict: Column) -> Column:
    out = F.lit(len(SEVERITY))
    for name, value in SEVERITY.items():
        out = F.when(verdict == name, value).otherwise(out)
    return out


def batch_report(rows: DataFrame, idx: str = "file") -> DataFrame:
    """rows (verdict, buried) with severity and place: worst first, then by buried answers, then by idx."""
    place = F.row_number().over(Window.orderBy("severity", F.col("buried").desc(), idx))
    return rows.withColumn("severity", severity(F.col("verdict"))).withColumn("place", place)


def batch_totals(rows: DataFrame) -> DataFrame:
    """One row: files ok, clean, flagged (ok but none of clean, empty, one-sided), failed, minutes of sound."""
    ok = F.col("status") == "ok"
    return rows.agg(
        F.count_if(ok).alias("ok"),
        F.count_if(ok & (F.col("verdict") == "clean")).alias("clean"),
        F.count_if(ok & ~F.coalesce(F.col("verdict").isin("clean", "empty", "one-sided"), F.lit(False))).alias("flagged"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.round(F.coalesce(F.sum("duration_sec"), F.lit(0.0)) / 60, 2).alias("minutes"),
    )


def report_markdown(rows: DataFrame) -> DataFrame:
    """The batch report as one text row: a summary, a table by severity, the flagged files with their problems, the failures."""
    ordered = batch_report(rows)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "file", "verdict", F.col("speakers").cast("string"), F.col("turns").cast("string"), F.col("words").cast("string"), F.col("buried").cast("string")), F.lit(" |"))
    flagged = (F.col("status") == "ok") & ~F.coalesce(F.col("verdict").isin("clean", "empty", "one-sided"), F.lit(False))
    detail = F.concat(F.lit("### "), F.col("file"), F.lit("\n"), F.array_join(F.transform("problems", lambda p: F.concat(F.lit("- "), p)), "\n"))
    failure = F.concat(F.lit("- "), F.col("file"), F.lit(": "), F.coalesce("error", F.lit("?")))

    def listed(when: Column, text: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("place", text.alias("t"))))), lambda r: r["t"]), "\n")

    ok = F.col("status") == "ok"
    body = ordered.agg(listed(ok, line).alias("table"), listed(flagged, detail).alias("flagged_text"), listed(F.col("status") == "failed", failure).alias("failed_text"))
    t = batch_totals(rows)
    head = F.format_string("%d files read, %d clean, %d flagged, %d failed, %s minutes", "ok", "clean", "flagged", "failed", F.col("minutes").cast("string"))
    text = F.concat_ws("\n\n", head, F.concat(F.lit("| file | verdict | speakers | turns | words | buried |\n|---|---|---|---|---|---|\n"), F.col("table")), F.nullif("flagged_text", F.lit("")), F.nullif("failed_text", F.lit("")))
    return t.crossJoin(body).select(text.alias("value"))


def variance_report(rows: DataFrame, metrics: list[str], keys=("file",), digits: int = 4) -> DataFrame:
    """Mean, minimum, maximum and population deviation of metrics over repeated runs, and the number of runs."""
    out = []
    for m in metrics:
        x = F.col(m).cast("double")
        out += [F.round(F.avg(x), digits).alias(f"{m}_mean"), F.min(x).alias(f"{m}_min"), F.max(x).alias(f"{m}_max"), F.round(F.stddev_pop(x), digits).alias(f"{m}_sd")]
    return rows.groupBy(*keys).agg(F.count("*").alias("runs"), *out)


def verdict_counts(rows: DataFrame, keys=("file",)) -> DataFrame:
    return rows.groupBy(*keys, "verdict").agg(F.count("*").alias("n"))


def baseline_deltas(rows: DataFrame, param: str, metric: str, base: Column, lower_is_better: bool = False, limit: float = 0.5) -> DataFrame:
    """rows with delta against the row where base is true, and label better, worse or no change beyond limit."""
    one = rows.filter(base).agg(F.min(metric).alias("_base"))
    delta = F.round(F.col(metric) - F.col("_base"), 4)
    good = -F.col("delta") if lower_is_better else F.col("delta")
    label = F.when(good > limit, "better").when(good < -limit, "worse").otherwise("no change")
    return rows.crossJoin(F.broadcast(one)).withColumn("delta", delta).withColumn("label", label).drop("_base")


def most_words(rows: DataFrame, param: str, keys=("file",)) -> DataFrame:
    """The first parameter with the most words, which is not the best one by itself: sweep reports give both."""
    return rows.groupBy(*keys).agg(F.max_by(param, F.struct("words", -F.col(param))).alias(param), F.max("words").alias("words"))


def compare_matrix(rows: DataFrame, metric: str, engines: list[str], keys=("file",), engine: str = "engine") -> DataFrame:
    """One row per file, one column per engine."""
    return rows.groupBy(*keys).pivot(engine, engines).agg(F.first(metric))


def compare_metrics(turns: DataFrame, keys=("call_id",)) -> DataFrame:
    """Turns, talk seconds, turns a minute, and the largest share in percent."""
    held = turns.groupBy(*keys, "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("_sec"), F.count("*").alias("_n"))
    total = F.sum("_sec")
    return held.groupBy(*keys).agg(
        F.sum("_n").alias("turns"),
        F.round(total, 2).alias("speech_sec"),
        F.round(F.round(F.coalesce(F.sum("_n") / F.nullif(total / 60, F.lit(0.0)), F.lit(0.0)), 6), 2).alias("switch_rate"),
        F.round(F.round(F.coalesce(100 * F.max("_sec") / F.nullif(total, F.lit(0.0)), F.lit(0.0)), 6), 1).alias("dominant_pct"),
    )


def todo(inputs: DataFrame, done: DataFrame, on) -> DataFrame:
    """Inputs without a result yet."""
    return inputs.join(done.select(*on).distinct(), list(on), "left_anti")


def sort_out(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error, so that a bad file never stops a batch."""
    return rows.filter("error is null"), rows.filter("error is not null")


def changes(before: DataFrame, after: DataFrame, on, text: str = "text") -> DataFrame:
    """(on, before, after) where a text differs."""
    b = before.select(*on, F.col(text).alias("before")).join(after.select(*on, F.col(text).alias("after")), list(on))
    return b.filter(~F.col("before").eqNullSafe(F.col("after")))


def polished(turns: DataFrame, answers: DataFrame, ok, keys=("call_id",)) -> DataFrame:
    """Turns with a polished text where there is one and ok(before, after) holds."""
    a = answers.select(*keys, "turn_id", F.col("text").alias("_new"))
    good = F.col("_new").isNotNull() & ok(F.col("text"), F.col("_new"))
    return turns.join(a, [*keys, "turn_id"], "left").withColumn("text", F.when(good, F.col("_new")).otherwise(F.col("text"))).drop("_new")


def gender_signals(turns: DataFrame, keys=("call_id",)) -> DataFrame:
    """Turns with a feminine self-marker: keys, turn_id, speaker, marker, marked (such turns of the speaker), suspect.

    Suspect: the speaker's only one, while another speaker has two or more.
    """
    from ..functions.text import feminine_self_marker

    hits = turns.withColumn("marker", feminine_self_marker(F.col("text"))).filter("marker is not null")
    counts = hits.groupBy(*keys, "speaker").agg(F.count("*").alias("marked"))
    strong = F.count_if(F.col("marked") >= 2).over(Window.partitionBy(*keys))
    counts = counts.withColumn("_strong", strong)
    return hits.join(counts, [*keys, "speaker"]).select(*keys, "turn_id", "speaker", "marker", "marked", ((F.col("marked") == 1) & (F.col("_strong") > 0)).alias("suspect"))


def usage_cost(calls: DataFrame, prices: DataFrame, keys=("model",)) -> DataFrame:
    """Tokens and their cost by model: prices has in_per_million and out_per_million."""
    used = calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    cost = (F.col("tokens_in") * F.col("in_per_million") + F.col("tokens_out") * F.col("out_per_million")) / 1e6
    return used.join(prices, list(keys), "left").withColumn("cost", F.round(cost, 6)).drop("in_per_million", "out_per_million")


def mean_token_probability(logprobs: DataFrame, keys=("call_id",)) -> DataFrame:
    return logprobs.groupBy(*keys).agg(F.round(F.avg(F.exp("logprob")), 4).alias("probability"))


def window_stats(windows: DataFrame, keys=("call_id",)) -> DataFrame:
    """Windows (keys, start, end) of a plan: their number and the median, least and largest length in seconds."""
    length = F.col("end") - F.col("start")
    one = lambda x: F.round(F.round(x, 6), 1)
    return windows.groupBy(*keys).agg(
        F.count("*").alias("windows"), one(F.percentile(length, F.lit(0.5))).alias("median_sec"), one(F.min(length)).alias("least_sec"), one(F.max(length)).alias("most_sec")
    )
