"""The pipeline against a plain composition of slow versions of its stages."""

import math
import sys
from functools import lru_cache
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
import numpy as np
from test_language import phrases
from test_line_dedup import brute as slow_dedup
from test_mixing import brute as slow_mix
from test_simhash import slow_fingerprint

from parlance.llm import decontamination, language

def slow_cost(text, model, samples):
    """Least normalised phrases per symbol by plain searches in the learned text, less what chance adds."""
    show = lambda codes: "".join(map(chr, (model.index[codes] + 32).tolist()))
    own = show(language.spelled(text)) if text else ""
    if not own:
        return math.inf
    learned = [" " + show(np.concatenate([language.spelled(t) for t in fitting(texts)])) for _, texts in samples]
    least = min(phrases(own, known) * math.log2(len(known) + 2) for known in learned)
    return least / len(own) - language.CHANCE / math.sqrt(len(own))


@lru_cache
def fitting(texts):
    held, size = [], 1
    for t in texts:
        if size + len(language.spelled(t)) <= language.SAMPLE_SYMBOLS:
            held.append(t)
            size += len(language.spelled(t))
    return held


SF = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    now = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        seen.append((name, now.columns, now.collect()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
            now = spark.createDataFrame(seen[-1][2], docs.schema)
    samples = language.sample(docs, corpus_pipeline.F.lit(True))
    model, bound = language.Model(samples), language.cost_bound(samples)
    good = {d for d, r in rows.items() if slow_cost(r.text, model, samples) <= bound}
    assert {r.doc_id for r in seen[0][2]} == good
    texts = {int(d): t for d, t, gone in slow_dedup([(d, rows[d].text) for d in good]) if t or not gone}
    assert {r.doc_id: r.text for r in seen[1][2]} == texts
    assert all(r.n_chars == len(r.text) for r in seen[1][2] if r.text != rows[r.doc_id].text)
    fps, group = {d: slow_fingerprint(t) for d, t in texts.items()}, {}
    for d in sorted(texts):
        todo = [d] if d not in group else []
        while todo:
            x = todo.pop()
            group[x] = d
            todo += [y for y in texts if y not in group and y not in todo and (fps[x] ^ fps[y]).bit_count() <= 3]
    firsts = {d for d, g in group.items() if d == g}
    assert {r.doc_id for r in seen[2][2]} == firsts
    items = [(r.item_id, r.text) for r in corpus_pipeline.table(spark, SF, "benchmark").collect()]
    block = decontamination.Block(items)
    clean = {d for d in firsts if not block.matches([texts[d]])[0]}
    assert {r.doc_id for r in seen[3][2]} == clean
    quality = {r.doc_id: {1: 2.0, 0: 0.5}[r.quality] for r in corpus_pipeline.table(spark, SF, "labels").collect()}
    mixed = {(d, t) for d, _, _, _, _, t in slow_mix([(d, texts[d], rows[d].source, quality.get(d, 1.0)) for d in sorted(clean)]) if t}
    assert {(str(r.doc_id), r.taken) for r in seen[4][2] if r.taken} == mixed
    assert {(r.doc_id, r.taken) for r in corpus_pipeline.run(spark, SF).collect()} == {(r.doc_id, r.taken) for r in seen[4][2]}


def test_null_and_repeated_rows(spark):
    schema = corpus_pipeline.table(spark, SF, "documents").schema
    text = "thing in the other that is here and there for all of them to see again"
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, None, None, None, None), (None, text + " once", None, None, 3), (3, "", "en", "s", 0), (4, "una cosa de la otra que es para todos los demás", "es", None, 9)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(r.doc_id for r in docs.collect() if r.doc_id) == [1, 4]
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.collect() == []
