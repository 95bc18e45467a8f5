"""Embedding operators: centroids, similarity, purification, clustering, silhouette."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot, unit
from .intervals import KEYS, dealt


def window_plan(spans: DataFrame, length: float = 1.5, hop: float = 0.25, voiced: DataFrame | None = None, least_voiced: float = 0.5, keys=KEYS) -> DataFrame:
    """(keys, span_idx, win_idx, start, end): sliding windows over each span; with speech spans `voiced`, only those covered to least_voiced."""
    n = F.greatest(F.lit(0), F.floor((F.col("end") - F.col("start") - length) / hop + 1e-9)).cast("int")
    rows = spans.select(*keys, "span_idx", F.col("start").alias("_s"), F.explode(F.sequence(F.lit(0), n)).alias("win_idx"))
    rows = rows.select(*keys, "span_idx", "win_idx", (F.col("_s") + F.col("win_idx") * hop).alias("start"), (F.col("_s") + F.col("win_idx") * hop + length).alias("end"))
    if voiced is None:
        return rows
    from .intervals import overlap_join

    r = voiced.select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    part = F.least("end", "r_end") - F.greatest("start", "r_start")
    held = overlap_join(rows, r, keys).groupBy(*keys, "span_idx", "win_idx", "start", "end").agg(F.sum(part).alias("_v"))
    return held.filter(F.round(F.col("_v") / length, 9) >= least_voiced).drop("_v")


def centroids(vectors: DataFrame, keys=("label",), vec: str = "vec", scaled: bool = True) -> DataFrame:
    """(keys, centroid, n): the mean of each group's vectors, by default scaled to length 1. Partial sums are made before the shuffle."""
    mean = (
        vectors.select(*keys, F.posexplode(vec).alias("pos", "x"))
        .groupBy(*keys, "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
        .groupBy(*keys)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda r: r["m"]).alias("centroid"), F.max("n").alias("n"))
    )
    return mean.withColumn("centroid", unit(F.col("centroid"))) if scaled else mean


def similarities(vectors: DataFrame, cents: DataFrame, idx: str = "vec_id", vec: str = "vec", keys=()) -> DataFrame:
    """(keys, idx, centroid_label, sim): each vector with each centroid of its call; cents (keys, label, centroid) has a handful of rows per call, so it is sent along if small."""
    c = cents.select(*keys, F.col("label").alias("centroid_label"), "centroid")
    #: Scaled before the join, so once for each vector and not for each pair.
    scaled = vectors.select(*keys, idx, unit(F.col(vec)).alias("_unit"))
    rows = scaled.join(c, list(keys)) if keys else scaled.crossJoin(c)
    return rows.select(*keys, idx, "centroid_label", dot(F.col("_unit"), F.col("centroid")).alias("sim"))


def nearest_centroid(sims: DataFrame, idx: str = "vec_id", least_margin: float = 0.08, keys=()) -> DataFrame:
    """(keys, idx, best, sim, margin, decided): the most similar centroid, the first label on a tie, and its lead over the second."""
    order = F.sort_array(F.collect_list(F.struct(F.round("sim", 9).alias("sim"), (-F.col("centroid_label")).alias("back"))), asc=False)
    top = sims.groupBy(*keys, idx).agg(order.alias("o"))
    lead = F.round(F.get("o", 0)["sim"] - F.coalesce(F.get("o", 1)["sim"], F.lit(-1.0)), 9)
    return top.select(*keys, idx, (-F.get("o", 0)["back"]).alias("best"), F.get("o", 0)["sim"].alias("sim"), lead.alias("margin"), (lead >= least_margin).alias("decided"))


def purify(vectors: DataFrame, drop: float = 0.2, idx: str = "vec_id", vec: str = "vec") -> DataFrame:
    """(idx, label, new_label): centroids without the least similar share of each cluster, and every vector's nearest of these. One round; labels are few."""
    cents = centroids(vectors, ("label",), vec)
    own = vectors.join(cents.select("label", "centroid"), "label").withColumn("sim", F.round(dot(unit(F.col(vec)), F.col("centroid")), 9))
    floor = own.groupBy("label").agg(F.percentile("sim", F.lit(drop)).alias("floor"))
    pure = centroids(own.join(floor, "label").filter(F.col("sim") >= F.round("floor", 9)).select("label", vec), ("label",), vec)
    best = nearest_centroid(similarities(vectors.select(idx, vec), pure, idx, vec), idx)
    return vectors.select(idx, "label").join(best.select(idx, F.col("best").alias("new_label")), idx)


def silhouette(vectors: DataFrame, idx: str = "vec_id", vec: str = "vec", keys=()) -> DataFrame:
    """(keys, silhouette, n): mean cosine silhouette, exactly and without pairs.

    The mean cosine distance of a unit vector to a cluster is 1 - its dot product with
    the cluster's mean vector, so clusters are compared by their sums.
    """
    unit_rows = vectors.select(*keys, idx, "label", unit(F.col(vec)).alias(vec))
    means = centroids(unit_rows, (*keys, "label"), vec, scaled=False).select(*keys, F.col("label").alias("other"), "centroid", "n")
    pairs = unit_rows.join(means, list(keys)) if keys else unit_rows.crossJoin(means)
    d = 1 - dot(F.col(vec), F.col("centroid"))
    # A vector's own cluster leaves it out: its distance to itself is 0.
    own = F.when((F.col("label") == F.col("other")) & (F.col("n") > 1), d * F.col("n") / (F.col("n") - 1))
    rows = pairs.groupBy(*keys, idx, "label").agg(F.max(own).alias("a"), F.min(F.when(F.col("label") != F.col("other"), d)).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") <= 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return rows.groupBy(*keys).agg(F.avg(s).alias("silhouette"), F.count("*").alias("n"))


def within_across(vectors: DataFrame, span: str = "label", vec: str = "vec", idx: str = "vec_id") -> DataFrame:
    """Mean cosine distance within and across spans and their gap, over all pairs, by way of sums: one row.

    Sums of unit vectors give all pair sums: for a group, (|sum|^2 - n) / 2 is the sum
    of the dot products of its pairs.
    """
    rows = vectors.select(F.col(span).alias("s"), unit(F.col(vec)).alias("v"))
    total = rows.select("s", F.posexplode("v").alias("p", "x")).groupBy("s", "p").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    by_span = total.groupBy("s").agg(F.sum(F.col("x") * F.col("x")).alias("q"), F.max("n").alias("n"))
    inner = by_span.agg(F.sum((F.col("q") - F.col("n")) / 2).alias("inner_dot"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("inner_n"), F.sum("n").alias("all_n"))
    every = total.groupBy("p").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("all_q"))
    out = inner.crossJoin(every)
    outer_n = F.col("all_n") * (F.col("all_n") - 1) / 2 - F.col("inner_n")
    within = 1 - F.col("inner_dot") / F.nullif(F.col("inner_n"), F.lit(0.0))
    across = 1 - ((F.col("all_q") - F.col("all_n")) / 2 - F.col("inner_dot")) / F.nullif(outer_n, F.lit(0.0))
    return out.select(F.round(within, 6).alias("within"), F.round(across, 6).alias("across"), F.round(across - within, 6).alias("gap"))


def split_half_control(pairs: DataFrame, distance: Column, first: int = 40) -> DataFrame:
    """Median, 90th percentile and maximum of the first distances of a control arm, in their order idx."""
    rows = pairs.select("idx", distance.alias("d")).orderBy("idx").limit(first)
    p = F.percentile("d", F.array(F.lit(0.5), F.lit(0.9)))
    return rows.agg(F.round(p[0], 6).alias("median"), F.round(p[1], 6).alias("p90"), F.round(F.max("d"), 6).alias("most"), F.count("*").alias("n"))


def separation_note(separation: Column) -> Column:
    return F.when(separation < 0.10, "voices can't be told apart").when(separation < 0.20, "voices are hard to tell apart")


def weak_voice(separation: Column, dominant: Column) -> Column:
    return (separation < 0.15) | (dominant > 0.85)


def rejudge_words(sims: DataFrame, words: DataFrame, margin: float = 0.08, idx: str = "idx", keys=KEYS) -> DataFrame:
    """words with rejudged: the label of the nearest voice where it leads by margin, else the word's own label index."""
    best = nearest_centroid(sims, idx, margin, keys)
    return words.join(best.select(*keys, idx, "best", "decided"), [*keys, idx], "left").withColumn("rejudged", F.when(F.col("decided"), F.col("best")).otherwise(F.col("label"))).drop("best", "decided")


def word_spans(words: DataFrame, pad: float = 0.15, least: float = 0.40) -> DataFrame:
    """Padded spans to embed: pad on both sides, at least `least` long around the middle, not before 0."""
    mid, half = (F.col("start") + F.col("end")) / 2, F.greatest((F.col("end") - F.col("start")) / 2 + pad, F.lit(least / 2))
    return words.withColumn("span_start", F.greatest(mid - half, F.lit(0.0))).withColumn("span_end", mid + half)


# ---- clustering of one call, in numpy ------------------------------------------------


def _unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _agglomerate(x: np.ndarray, k: int, complete: bool) -> np.ndarray:
    """Labels of k clusters by merging the closest two (mean or largest cosine distance) again and again."""
    n = len(x)
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    size, group = np.ones(n), np.arange(n)
    alive = n
    while alive > k:
        i, j = divmod(int(np.argmin(d)), n)
        row = np.maximum(d[i], d[j]) if complete else (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        row[~np.isfinite(d[i]) | ~np.isfinite(d[j])] = np.inf
        row[[i, j]] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        group[group == j] = i
        alive -= 1
    return np.unique(group, return_inverse=True)[1]


def _kmeans(x: np.ndarray, k: int, starts: int = 10, seed: int = 0) -> np.ndarray:
    rng, best = np.random.default_rng(seed), (np.inf, np.zeros(len(x), int))
    for _ in range(starts):
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(50):
            label = np.argmin(((x[:, None] - c[None]) ** 2).sum(2), axis=1)
            new = np.array([x[label == i].mean(0) if (label == i).any() else c[i] for i in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = ((x - c[label]) ** 2).sum()
        if cost < best[0] - 1e-12:
            best = (cost, label)
    return best[1]


def _silhouette(x: np.ndarray, label: np.ndarray) -> float:
    if len(set(label.tolist())) < 2:
        return 0.0
    d, names = 1 - x @ x.T, np.unique(label)
    sums = np.stack([d[:, label == c].sum(1) for c in names], 1)
    sizes = np.array([(label == c).sum() for c in names])
    own = np.searchsorted(names, label)
    at = np.arange(len(x))
    a = sums[at, own] / np.maximum(sizes[own] - 1, 1)
    other = sums / sizes
    other[at, own] = np.inf
    b = other.min(1)
    s = np.where((sizes[own] > 1) & (np.maximum(a, b) > 0), (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0.0)
    return float(s.mean())


def _contest(x: np.ndarray, k: int, rounds: int = 2, drop: float = 20.0) -> tuple[np.ndarray, float]:
    """The best of three clusterings by silhouette, purified while that doesn't fall."""
    if len(x) < max(k, 4):
        return np.zeros(len(x), int), 0.0
    tries = [_agglomerate(x, k, False), _agglomerate(x, k, True), _kmeans(x, k)]
    scores = [_silhouette(x, t) for t in tries]
    label, score = tries[int(np.argmax(scores))], max(scores)
    for _ in range(rounds):
        cents = []
        for c in np.unique(label):
            own = x[label == c]
            sim = own @ _unit_rows(own.mean(0, keepdims=True))[0]
            cents.append(own[sim >= np.percentile(sim, drop)].mean(0))
        new = np.argmax(x @ _unit_rows(np.array(cents)).T, axis=1)
        again = _silhouette(x, new)
        if again < score:
            break
        label, score = new, again
    return label, score


def cluster(vectors: DataFrame, k: int | None = None, keys=KEYS, idx: str = "win_idx", vec: str = "vec", most: int = 6) -> DataFrame:
    """(keys, idx, cluster, separation): each call's vectors in k clusters, or in the number from 2 to `most` with the best silhouette.

    Quadratic in the windows of a call, which is the unit of work; calls are spread.
    For one large set without calls use `spark_kmeans`.
    """
    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in (*keys, idx))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(idx)
        x = _unit_rows(np.array(rows[vec].tolist(), float))
        found = [_contest(x, n) for n in ([k] if k else range(2, most + 1))]
        label, score = max(found, key=lambda f: f[1])
        return rows[[*keys, idx]].assign(cluster=label.astype("int32"), separation=round(score, 6))

    return dealt(vectors.select(*keys, idx, vec), *keys).groupBy(*keys).applyInPandas(run, f"{kinds}, cluster int, separation double")


def spark_kmeans(vectors: DataFrame, k: int, idx: str = "vec_id", vec: str = "vec", seed: int = 0) -> DataFrame:
    """(idx, cluster) by MLlib's distributed k-means with cosine distance; cluster numbers follow the smallest id in each."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(idx, array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", initSteps=2, maxIter=20).fit(rows)
    found = model.transform(rows).select(idx, "prediction")
    names = found.groupBy("prediction").agg(F.min(idx).alias("_first"))
    names = names.select("prediction", (F.row_number().over(Window.orderBy("_first")) - 1).alias("cluster"))
    return found.join(F.broadcast(names), "prediction").select(idx, "cluster")


def pair_distances(a: DataFrame, b: DataFrame, on, vec: str = "vec") -> DataFrame:
    """(on, distance): cosine distance of the vectors of two tables that share keys."""
    return a.select(*on, F.col(vec).alias("_a")).join(b.select(*on, F.col(vec).alias("_b")), list(on)).select(*on, F.round(1 - cosine(F.col("_a"), F.col("_b")), 6).alias("distance"))
