import numpy as np
from pyspark.sql import functions as F

from parlance.llm import quality as Q


def test_columns_are_the_set_of_ngrams():
    text = "abcabc é字"
    grams = {text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}
    assert len(set(Q.columns(text).tolist())) == len(Q.columns(text)) <= len(grams)
    assert len(Q.columns(text)) > len(grams) - 3
    assert set(Q.columns("abcabc").tolist()) == set(Q.columns("abcabcabc").tolist())
    assert len(Q.columns(None)) == len(Q.columns("")) == 0 and len(Q.columns("x")) == 1


def test_hinge_solves_its_dual():
    """The optimum of a separable set: every margin is 1 or more, and only those at 1 carry weight."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    y = (x @ [1.0, -2.0, 0.5] > 0).astype(float)
    rows = [np.arange(3)] * 40
    w, b = Q.hinge(rows, list(x), y, np.full(40, 1e4), passes=4000)
    margins = (2 * y - 1) * (x @ w[:3] + b)
    assert margins.min() > 0.99 and np.sort(margins)[0] < 1.01

    def primal(v):
        return 0.5 * v @ v + 0.5 * np.maximum(0, 1 - (2 * y - 1) * (x @ v[:3] + v[3])).sum()

    w, b = Q.hinge(rows, list(x), y, np.full(40, 0.5), passes=4000)
    best = np.append(w[:3], b)
    assert all(primal(best) <= primal(best + 0.01 * rng.normal(size=4)) + 1e-9 for _ in range(200))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    sample = Q.sample(docs, labels, ~held_out)
    assert sample == Q.sample(docs.repartition(3), labels, ~held_out)
    rows = Q.classify(docs.filter(held_out), Q.fit(sample)).join(labels, "doc_id").select("score", "predicted", "quality").collect()
    ones, zeros = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([a > b for a in ones for b in zeros]) > 0.99
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97


def test_odd_rows(spark):
    model = Q.fit([("good text here", 1), ("bad |||| text", 0)] * 5)
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (2, "", 0.2), (None, "good text", 0.1)], "doc_id long, text string, score double")
    rows = Q.classify(docs, model).collect()
    assert len(rows) == 4 and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1 and all(0 <= r.score <= 1 for r in rows)
    assert Q.classify(docs.limit(0), model).count() == 0
    assert Q.fit([]).score("x") == 0.5 and Q.fit([("a", 1)]).score("x") > 0.9 and Q.fit([("a", 0)]).score("") < 0.1
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (1, 5), (1, None)], "doc_id long, quality int")
    assert Q.sample(docs, labels, F.lit(True)) == [("", 0), ("", 0)]


def test_ranking_matches_all_pairs():
    rng = np.random.default_rng(3)
    margins, labels = rng.integers(0, 9, 60).astype(float), rng.integers(0, 2, 60).astype(float)
    pairs = [(a > b) + 0.5 * (a == b) for a in margins[labels > 0] for b in margins[labels == 0]]
    assert abs(Q.ranking(margins, labels) - np.mean(pairs)) < 1e-12


def test_columns_are_chosen_on_training_folds():
    """Texts that differ by recurring words only need the patterns; with telling letters they are left out."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(60)]
    texts = [" ".join(np.repeat(rng.choice(words, 20), 2) if k % 2 else rng.permutation(np.repeat(rng.choice(words, 20, replace=False), 2))) for k in range(120)]
    assert Q.fit([(t, k % 2) for k, t in enumerate(texts)]).recurrence
    assert not Q.fit([(f"{'x' if k % 2 else 'q'} {t}", k % 2) for k, t in enumerate(texts[::2] + texts[::2])]).recurrence


def test_scores_match_a_slow_fit(spark):
    """classify against the definition: scaled indicators, the fitted weights, the logistic curve."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()
    model = Q.fit([(r.text or "", int(r.doc_id) % 2) for r in rows[:40]])
    got = {r.doc_id: r for r in Q.classify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for r in rows:
        own = sorted(set(Q.columns(r.text, model.recurrence).tolist()))
        margin = model.bias + (Q.SCALE * sum(model.weights[c] for c in own) / len(own) if own else 0.0)
        score = 1 / (1 + np.exp(-(model.slope * margin + model.shift)))
        assert abs(got[r.doc_id].score - score) < 1e-9 and got[r.doc_id].predicted == int(score >= 0.5)
