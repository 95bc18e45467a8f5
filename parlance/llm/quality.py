"""Quality classifier: naive Bayes support vectors.

A text is the set of its character n-grams, hashed to columns. Column indicators
are scaled by the log-count ratio of the classes, a linear hinge-loss model is
fitted to them by dual coordinate descent, and a logistic curve on held-back
margins turns its margin into a score. The patterns in which words recur within
word 4-grams are columns too if that ranks the held-back folds of the training
rows better; no other labels take part in the choice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow

#: Columns of hashed n-grams, and the lengths of these.
COLUMNS, LENGTHS = 1 << 18, (1, 2, 3)
#: The bounds of the training sample: documents of each class, and the characters up to which a document is taken, whole.
SAMPLE_DOCUMENTS, SAMPLE_CHARACTERS = 1_500, 20_000
#: Of the fit: smoothing of counts, cost of a miss, passes, share of a plain indicator in the interpolation.
SMOOTHING, COST, PASSES, PLAIN = 1.0, 0.1, 20, 0.25
FOLDS = 3
#: A text's indicators count SCALE / (their number) each, so that its length doesn't matter.
SCALE = 100.0


def columns(text: str | None, recurrence: bool = True) -> np.ndarray:
    """The different columns of a text's n-grams, and with recurrence of its patterns, in no order; the whole text counts."""
    if not text:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    for n in LENGTHS:
        if len(codes) < n:
            break
        grams = np.full(len(codes) - n + 1, 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            grams = (grams ^ codes[k : len(codes) - n + 1 + k]) * np.uint32(0x85EBCA6B)
            grams ^= grams >> np.uint32(13)
        found.append((grams * np.uint32(0xC2B2AE35)) >> np.uint32(32 - 18))
    if recurrence:
        found.append(patterns(text))
    every = np.concatenate(found).astype(np.int64)
    last = _scratch()
    order = np.arange(len(every))
    last[every] = order
    return every[last[every] == order]


def patterns(text: str) -> np.ndarray:
    """Columns of the patterns in which words recur: of each four neighbouring words, which equal an earlier one of them."""
    words = text.split()
    if len(words) < 4:
        return np.zeros(0, np.int64)
    ids = np.fromiter(map(hash, words), np.int64, len(words))
    n = len(ids) - 3
    code = np.zeros(n, np.int64)
    for k, (a, b) in enumerate(((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))):
        code |= (ids[a : a + n] == ids[b : b + n]).astype(np.int64) << k
    return np.unique(code)


def _scratch(held: list[np.ndarray] = []) -> np.ndarray:  # noqa: B006  one per process
    if not held:
        held.append(np.zeros(COLUMNS, np.int64))
    return held[0]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    recurrence: bool = True

    def margin(self, own: np.ndarray) -> float:
        return float(self.weights[own].sum() / max(1, len(own))) * SCALE + self.bias

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(columns(text, self.recurrence)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """log of (share of a column among class 1) over (its share among class 0), smoothed."""
    counts = [np.full(COLUMNS, SMOOTHING), np.full(COLUMNS, SMOOTHING)]
    for own, label in zip(rows, labels):
        counts[int(label)][own] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def hinge(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, costs: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and bias (a column of ones) that minimise |w|^2 / 2 + sum of cost * max(0, 1 - y * margin), by dual coordinate descent."""
    sign = np.where(labels > 0, 1.0, -1.0)
    squares = np.array([v @ v + 1.0 for v in values])
    alpha, weights, bias = np.zeros(len(rows)), np.zeros(COLUMNS), 0.0
    order = np.random.default_rng(7)
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(len(rows)):
            slope = sign[i] * (weights[rows[i]] @ values[i] + bias) - 1.0
            now = min(max(alpha[i] - slope / squares[i], 0.0), costs[i])
            step = (now - alpha[i]) * sign[i]
            if step:
                weights[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = now
        if moved < 1e-4:
            break
    return weights, bias


def _fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of plain columns: the mean size of the hinge weights is mixed in, as the method has it for small classes."""
    ratio = log_count_ratio(rows, labels)
    values = [ratio[own] * (SCALE / max(1, len(own))) for own in rows]
    share = np.where(labels > 0, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    weights, bias = hinge(rows, values, labels, COST * share * len(labels))
    size = np.abs(weights).sum() / max(1, np.count_nonzero(weights))
    return ratio * (PLAIN * size + (1 - PLAIN) * weights), bias


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope (0 or more) and shift of the curve through the margins, by Newton steps on smoothed targets."""
    ones, zeros = labels.sum(), (1 - labels).sum()
    goal = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    inputs, at = np.stack([margins, np.ones_like(margins)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(inputs @ at, -30, 30)))
        slope = inputs.T @ (p - goal) + 1e-3 * at
        curve = (inputs * (p * (1 - p))[:, None]).T @ inputs + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        at -= step
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(at[0])), float(at[1])


def ranking(margins: np.ndarray, labels: np.ndarray) -> float:
    """The share of pairs of both classes that margins rank right, ties counting half."""
    ones, zeros = np.sort(margins[labels > 0]), np.sort(margins[labels == 0])
    right = np.searchsorted(zeros, ones, "left").sum() + np.searchsorted(zeros, ones, "right").sum()
    return float(right / (2 * len(ones) * len(zeros)))


def _held_back(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Each row's margin by a model of the other folds."""
    margins, fold = np.zeros(len(rows)), np.arange(len(rows)) % FOLDS
    for k in range(FOLDS):
        rest, held = np.nonzero(fold != k)[0], np.nonzero(fold == k)[0]
        weights, bias = _fit([rows[i] for i in rest], labels[rest])
        own = Model(weights, bias, 1, 0)
        margins[held] = [own.margin(rows[i]) for i in held]
    return margins


def fit(sample: list[tuple[str, int]]) -> Model:
    """The model of (text, label 0 or 1) rows. With one class or none every score is the class, or 0.5."""
    labels = np.array([x for _, x in sample], float)
    if len(set(labels)) < 2:
        shift = 0.0 if not len(labels) else 30.0 if labels[0] else -30.0
        return Model(np.zeros(COLUMNS), 0.0, 0.0, shift)
    tried = []
    for recurrence in (False, True):
        rows = [columns(t, recurrence) for t, _ in sample]
        margins = _held_back(rows, labels)
        tried.append((ranking(margins, labels), recurrence, rows, margins))
    _, recurrence, rows, margins = max(tried, key=lambda x: x[0])
    return Model(*_fit(rows, labels), *_logistic(margins, labels), recurrence)


def sample(docs: DataFrame, labels: DataFrame, usable: Column, documents: int = SAMPLE_DOCUMENTS, characters: int = SAMPLE_CHARACTERS) -> list[tuple[str, int]]:
    """A bounded training sample, the same on every run: (text, quality) rows.

    Of each class `documents` documents with the least hash of their id among those
    usable, with a quality of 0 or 1 and a text of up to `characters`, taken whole;
    null texts count as empty. A class's labels are counted first, then a share of
    hashes that holds twice the wanted number is joined, so no task ranks a class.
    A document with both labels counts as 0; null ids are left out.
    """
    known = labels.filter(usable & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    share = F.lit(1.0)
    for r in known.groupBy("quality").count().collect():
        share = F.when(F.col("quality") == r.quality, min(1.0, 2.0 * documents / r["count"])).otherwise(share)
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    known = known.withColumn("place", place).filter(F.col("place") < share)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= characters)
    found: dict[int, list[tuple[float, str, str]]] = {0: [], 1: []}
    for r in texts.join(F.broadcast(known), "doc_id").select("place", "doc_id", "text", "quality").collect():
        found[r.quality].append((r.place, str(r.doc_id), r.text))
    chosen = [(hash_of(d), d, t, label) for label, rows in found.items() for _, d, t in sorted(rows)[:documents]]
    return [(t, label) for _, _, t, label in sorted(chosen)]


def hash_of(value) -> int:
    return zlib.crc32(str(value).encode())


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score double, predicted int) for every row of docs by its whole text. Null and empty texts get the score of no n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], schema.names)

    return in_arrow(docs.select("doc_id", "text"), run, schema)
