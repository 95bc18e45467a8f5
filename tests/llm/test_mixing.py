import math
import random
from collections import defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from parlance.llm import mixing

SCHEMA = "doc_id long, text string, source string, w double, size string, target int"


def good(w):
    return w if w and w > 0 else 1.0


def brute(rows, weights=(5, 2, 1), seed="mix-1"):
    size = [len([x for x in (t or "").replace("\n", " ").split(" ") if x]) for _, t, _, _ in rows]
    total = defaultdict(int)
    for (_, _, s, _), n in zip(rows, size):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    # Reshare until no target is above twice its source.
    capped, budget = set(), 1.5 * sum(total.values())
    while True:
        rest = budget - sum(2 * total[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: 2.0 * total[s] for s in capped} | {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 2 * total[s] + 1e-9}
        if not over:
            break
        capped |= over
    out = []
    for s in order:
        own = []
        for k, (d, _, src, q) in enumerate(rows):
            if src == s:
                name, t = "" if d is None else d, rows[k][1]
                number = sum(r[:2] == (d, t) and r[2] == s and good(r[3]) == good(q) for r in rows[:k])
                u = (int(md5(f"{seed}:{name}:{'' if t is None else md5(t.encode()).hexdigest()}:{number}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                own.append((-math.log(u) / good(q), -1 if d is None else d, size[k], k))
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest, upto = target[s] - epochs * total[s], 0
        for _, _, n, k in sorted(own):
            extra = 2 * upto + n <= 2 * rest
            upto += n
            out.append((str(rows[k][0]), str(s), n, total[s], round(target[s], 6), n * (epochs + extra)))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), str(r.source), r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect())


def table(rng, n):
    sources = ["b", "a", None, "é", "zz", "hot", "hot", "hot"]
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 5, 40]))), rng.choice(sources), rng.choice([0.5, 1.0, 2.0, None, -1.0])) for i in range(n)]
    return rows + [(n, None, "hot", 1.0), (None, "x y", "a", 1.0), (n + 1, "only", "single", 1.0), (n + 2, "", "empty", 1.0)]


@pytest.mark.parametrize("n,bucket_rows", [(300, 4096), (300, 7)])
def test_matches_brute_force(spark, n, bucket_rows):
    rows = table(random.Random(n), n)
    docs = spark.createDataFrame([(*r, "size?", 1) for r in rows], SCHEMA)
    got = mixing.mix_sources(docs, weight=F.col("w"), bucket_rows=bucket_rows)
    assert result(got) == brute(rows)


def test_targets_are_met_and_reruns_agree(spark):
    rows = table(random.Random(3), 2000)
    docs = spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA)
    first, second = result(mixing.mix_sources(docs)), result(mixing.mix_sources(docs.repartition(13)))
    assert first == second
    taken, target = defaultdict(int), {}
    for _, s, n, _, t, x in first:
        taken[s] += x
        target[s] = t
        assert x <= 2 * n
    for s in target:
        assert abs(taken[s] - target[s]) <= 40


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1.0, "", 1)] * 5, SCHEMA)
    assert {(r.size, r.source_size) for r in mixing.mix_sources(docs).collect()} == {(2, 10)}
    assert mixing.mix_sources(docs.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, "", "s", 1.0, "", 1), (2, None, None, 1.0, "", 1)], SCHEMA)
    assert {(r.target, r.taken) for r in mixing.mix_sources(blank).collect()} == {(0.0, 0)}


@pytest.mark.parametrize("name", [7, None])
def test_rows_of_one_id_draw_by_themselves(spark, name):
    """The target is met although all rows of the source share an id, and some a text."""
    rows = [(name, "w " * (1 + k % 15), "s", 1.0, "", 1) for k in range(300)] + [(k, "o " * 4, "t", 1.0, "", 1) for k in range(1000, 1900)]
    docs = spark.createDataFrame(rows, SCHEMA)
    first = result(mixing.mix_sources(docs))
    assert first == result(mixing.mix_sources(docs.repartition(7))) == brute([r[:4] for r in rows])
    target = {s: t for _, s, _, _, t, _ in first}
    assert all(abs(sum(x for *_, x in (r for r in first if r[1] == s)) - t) <= 16 for s, t in target.items())


def test_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    docs = spark.createDataFrame([(1, "a b", "s", 1.0, "", 1)] * 95 + [(2, "c", "t", 1.0, "", 1)], SCHEMA)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 96 and abs(sum(r.taken for r in got if r.source == "s") - next(r.target for r in got if r.source == "s")) <= 2


def test_labels_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (None, "c", "s"), (2, None, None), (3, "d", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = {(r.doc_id, r._size, r.quality_weight) for r in mixing.with_quality(docs, labels).collect()}
    assert got == {(1, 2, 2.0), (None, 1, 1.0), (2, 0, 0.5), (3, 1, 1.0)}
