import random

import numpy as np
from pyspark.sql import functions as F

from parlance.llm import language as L

SAMPLES = (("a", ("the cat sat on the mat and then the dog sat on the cat " * 20,)), ("b", ("el gato y la mesa de la casa en el campo con la niña " * 20,)), ("c", ("кот сидел на столе и смотрел в окно " * 20,)))


def phrases(text, learned, block=L.BLOCK):
    """Cross-parsing as its definition has it: longest matches, one block after the other."""
    count = 0
    for k in range(0, len(text), block):
        part, i = text[k : k + block], 0
        while i < len(part):
            n = 0
            while i + n < len(part) and part[i : i + n + 1] in learned:
                n += 1
            count += 1
            i += max(n, 1)
    return count


def test_automaton_counts_longest_matches():
    rng = random.Random(0)
    model = L.Model(SAMPLES)
    back = {int(v): chr(c) for c, v in enumerate(model.index) if v > L.OTHER}
    texts = ["the mat", "la mesa!! xyz", "стол", "", None, "123", "q", "The CAT, the cat\n" * 90]
    texts += ["".join(rng.choice("aetсл hno,zñ") for _ in range(rng.randrange(2000))) for _ in range(25)]
    counts, sizes = model.phrases(texts)
    for k, text in enumerate(texts):
        symbols = model.index[L.spelled(text)] if text else []
        own = "".join(back.get(int(s), " " if s == L.SPACE else "\0") for s in symbols)
        assert sizes[k] == len(own)
        for lang, (_, held) in enumerate(SAMPLES):
            learned = " " + "".join(back.get(int(s), " ") for s in model.index[L.spelled(held[0])])
            assert counts[k, lang] == phrases(own, learned)
            if len(own):
                assert np.isclose(model.costs(counts, sizes)[k, lang], phrases(own, learned) * np.log2(len(learned) + 2) / len(own))


def test_spelling():
    shown = lambda t: "".join(chr(c) if c else " " for c in L.spelled(t))
    assert shown("Ab, c--d!") == "ab c d " and shown("12 3") == "" and shown("É́x") == "é́x"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    samples = L.sample(docs, ~held_out)
    assert all(len(texts) <= L.SAMPLE_TEXTS for _, texts in samples)
    rows = L.identify(docs.filter(held_out), samples).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.995
    assert all(0 <= r.score <= 1 for r in rows)
    assert samples == L.sample(docs.repartition(5), ~held_out)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "12 !!", None), (4, "the cat", "a"), (4, "the cat", "a"), (None, "la casa", "b"), (7, "12 \u0301 3", None), (6, "字字字字字字字字字字字字字字字字字字字字字字字字字字", None)]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    got = {(r.doc_id, r.lang_pred) for r in L.identify(docs, SAMPLES).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "a"), (None, "b")} <= got
    assert L.identify(docs, SAMPLES).count() == len(rows) and {r.lang_pred for r in L.identify(docs.filter("doc_id = 7"), SAMPLES).collect()} == {"und"}
    kept = L.keep_identified(docs, SAMPLES, bound=4.0)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {4, None}
    assert {r.lang_pred for r in L.identify(docs, ()).collect()} == {"und"}
    assert L.sample(docs.limit(0), F.lit(True)) == () and L.identify(docs.limit(0), SAMPLES).count() == 0


def test_little_text_is_no_disadvantage():
    """A language of which little was learned needs more phrases; normalised, they are still its own text's fewest."""
    rng = random.Random(2)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(300)] for lang, letters in (("a", "abcdefgh"), ("b", "cdefghij"))}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    model = L.Model((("a", (text("a", 150),)), ("b", (text("b", 6000),))))
    asked = [text(lang, 30) for lang in "ab" * 100]
    counts, sizes = model.phrases(asked)
    assert np.mean([model.languages[k] == lang for k, lang in zip(model.costs(counts, sizes).argmin(1), "ab" * 100)]) > 0.9


def test_bound_keeps_text_and_rejects_shuffled_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang is not null")
    half = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    samples = L.sample(docs, half)
    own = docs.filter(~half)
    assert L.keep_identified(own, samples).count() == own.filter("text rlike '[a-zA-Z]'").count()
    shuffled = own.filter("length(text) > 100").withColumn("text", F.array_join(F.shuffle(F.split("text", ""), F.lit(3)), ""))
    assert L.keep_identified(shuffled, samples).count() <= 0.05 * shuffled.count()
    strange = own.filter("length(text) > 100").withColumn("text", F.translate(F.lower("text"), "etaoinsrhl", "zqxjkvwpyg"))
    assert L.keep_identified(strange, samples).count() <= 0.05 * strange.count()


def test_sample_takes_whole_texts():
    model = L.Model((("a", ("abc " * 20_000, "the cat", "a dog")), ("b", ("xyz " * 20_000,))))
    assert len(model.tables[0]) < 60 * 20 and len(model._learned([np.arange(9), np.arange(3)], 6)) == 4
    assert len(model._learned([np.arange(9)], 6)) == 6 and len(model._learned([], 6)) == 1
