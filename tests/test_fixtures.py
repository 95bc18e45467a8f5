"""The literal cases of the fixtures, each with two calls interleaved and rows shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.functions import text as X
from parlance.operators import attribution as A
from parlance.operators import consensus as C
from parlance.operators import intervals as I
from parlance.operators import quality as Q
from parlance.operators import report as R


@pytest.fixture
def table(spark):
    def make(rows, schema):
        """rows, once for call a and once, with other times, for call b; shuffled."""
        both = [("a", *r) for r in rows] + [("b", *r) for r in rows]
        random.Random(0).shuffle(both)
        return spark.createDataFrame(both, f"call_id string, {schema}").repartition(3)

    return make


def of(df, *columns, order=None):
    """Rows of each call, which must agree."""
    rows = {}
    for r in df.collect():
        rows.setdefault(r.call_id, []).append(r)
    shown = {k: [tuple(r[c] for c in columns) for r in sorted(v, key=lambda r: tuple(r[c] for c in (order or columns)))] for k, v in rows.items()}
    assert shown.get("a") == shown.get("b")
    return shown.get("a", [])


WORD = "idx int, word string, start double, end double, speaker string, probability double"


def words(*rows):
    return [(i, r[3] if len(r) > 3 else f"w{i}", float(r[1]), float(r[2]), r[0], r[4] if len(r) > 4 else None) for i, r in enumerate(rows)]


def test_turns_from_words(table):
    w = table(words(("A", 0, 1), ("A", 1.5, 2), ("A", 3.1, 3.5), ("B", 3.5, 4)), WORD)
    assert of(A.turns_from_words(w), "speaker", "start", "end", order=["start"]) == [("A", 0, 2), ("A", 3.1, 3.5), ("B", 3.5, 4)]


def test_build_turns(table):
    s = table([(0, 0.0, 5.0, "A"), (1, 2.0, 3.0, "A"), (2, 5.0, 6.0, "B")], "seg_idx int, start double, end double, speaker string")
    assert of(A.build_turns(s), "speaker", "start", "end") == [("A", 0, 5), ("B", 5, 6)]


def test_segment_speaker_tie(table):
    w = table(words(*((s, i, i + 1) for i, s in enumerate("BAAB"))), WORD)
    assert of(A.segment_speaker(w, ["call_id"]), "speaker") == [("B",)]


def test_remap(table):
    spans = table([(0, 10.0, 12.0), (1, 60.0, 65.0)], "span_idx int, start double, end double")
    points = table([(t,) for t in (0.5, 1.8, 1.9, 2.0, 3.0, 99.0)], "t double")
    assert of(I.to_original(points, spans), "t", "original") == [(0.5, 10.5), (1.8, 11.8), (1.9, 60), (2.0, 60), (3.0, 61), (99.0, 65)]


def test_snap(table):
    spans = table([(0, 4.1, 4.9)], "span_idx int, start double, end double")
    w = table(words(("A", 4.0, 4.5), ("A", 3.0, 3.6), ("A", 0.0, 0.4)), WORD)
    assert of(I.snap(w, spans), "idx", "new_start", "new_end", "moved") == [(0, 4.1, 4.5, True), (1, 4.1, 4.7, True), (2, 0.0, 0.4, False)]


@pytest.mark.parametrize("bucket", [None, 0.7])
def test_assign(table, bucket):
    segs = table([(0, 0.0, 2.0, "A"), (1, 2.0, 4.0, "B")], "seg_idx int, start double, end double, speaker string")
    w = table(words((None, 1.5, 2.5), (None, 1.0, 1.4), (None, 9.0, 9.2)), WORD)
    assert of(I.assign_words(w, segs, bucket=bucket), "idx", "assigned", "speaker_confidence") == [(0, "A", 0.5), (1, "A", 1.0), (2, "B", 0.0)]
    none = I.assign_words(w, segs.limit(0))
    assert of(none, "idx", "assigned", "speaker_confidence", order=["idx"]) == [(0, None, None), (1, None, None), (2, None, None)]


@pytest.mark.parametrize("labels,expected", [("AABA", "AAAA"), ("ABAB", "ABAB"), ("AB", "AB")])
def test_sentence_vote(table, labels, expected):
    n = len(labels)
    w = table(words(*((s, i, i + 1, "end." if i == n - 1 else "x") for i, s in enumerate(labels))), WORD)
    assert "".join(v for _, v in of(A.vote_by_sentence(w), "idx", "voted")) == expected


TURN = "turn_id int, speaker string, start double, end double, text string, n_words int"


def turns(*rows):
    out, at = [], 0.0
    for i, (speaker, seconds, text) in enumerate(rows):
        out.append((i, speaker, at, at + seconds, text, len(text.split())))
        at += seconds
    return out


def test_collapse(table):
    t = table(turns(("A", 50.0, "x"), ("C", 5.0, "x"), ("B", 45.0, "x")), TURN)
    assert of(A.collapse_speakers(t), "start", "speaker", "end", "applied") == [(0, "A", 50, True), (50, "B", 100, True)]
    t = table(turns(("A", 50.0, "x"), ("B", 30.0, "x"), ("C", 20.0, "x")), TURN)
    assert [r[1] for r in of(A.collapse_speakers(t), "start", "speaker")] == ["A", "B", "C"]


def report(table, rows, **more):
    return of(Q.assess(table(turns(*rows), TURN), **more), "verdict", "buried", "stretched", "repeated", "problems")[0]


def test_verdicts(table):
    talk = lambda n: " ".join(f"w{i}" for i in range(n))
    assert report(table, [("A", 1.0, talk(4))])[0] == "empty" and len(report(table, [("A", 1.0, talk(4))])[4]) == 1
    assert report(table, [("A", 20.0, talk(60))])[0] == "one-sided"
    assert report(table, [("A", 1.0, "a b c")] * 4 + [("B", 2.0, talk(5))])[0] == "unreliable"
    twenty = [("AB"[i % 2], 2.0, talk(4) + f" n{i}") for i in range(19)]
    assert report(table, twenty)[0] == "clean"
    assert report(table, twenty + [("B", 2.0, "Name? It is Dan.")])[:2] == ("suspect", 1)


def test_buried_stretched_repeated(table):
    rows = [("A", 1.0, "Name? It is Dan."), ("B", 1.0, "Name? Dan."), ("A", 1.0, "No question here")]
    assert report(table, rows)[1] == 1
    rows = [("A", 5.0, "two words"), ("B", 5.0, "0545 123456"), ("A", 1.9, "one")]
    assert report(table, rows)[2] == 1
    rows = [("A", 1.0, "a b c")] * 3 + [("B", 1.0, "ok")] * 5
    assert report(table, rows)[3] == 2


def test_loops(table):
    w = table(words(*(("A", i, i + 1, x) for i, x in enumerate(["u", "p"] * 6))), WORD)
    assert len(of(C.collapse_loops(w), "idx")) == 6 and set(of(C.collapse_loops(w), "loops")) == {(1,)}
    w = table(words(*(("A", i, i + 1, "no") for i in range(3))), WORD)
    assert of(C.collapse_loops(w), "idx", "loops") == [(0, 0), (1, 0), (2, 0)]


@pytest.mark.parametrize("p,q,mode,kept", [(0.9, 0.9, False, "y"), (0.4, 0.9, True, "q"), (0.9, 0.92, True, "y")])
def test_consensus(table, p, q, mode, kept):
    a = table(words(*(("A", i, i + 1, x, p) for i, x in enumerate("xyz"))), WORD)
    b = table(words(*(("A", i, i + 1, x, q) for i, x in enumerate("xqz"))), WORD)
    parts = C.align_streams(a, b, mode)
    assert of(C.agreement(parts), "agreed", "disagreed", "agreement_pct") == [(2, 1, 66.7)]
    assert [r[1] for r in of(C.merged_words(a, b, parts), "start", "word")] == ["x", kept, "z"]
    assert of(C.disagreements(parts), "text_a", "text_b", "resolved") == [("y", "q", None)]


def test_consensus_with_one_side(table):
    a = table(words(("A", 0, 1, "x")), WORD)
    parts = C.align_streams(a, a.limit(0))
    assert of(C.agreement(parts), "agreed", "only_a", "agreement_pct") == [(0, 1, 0.0)]


@pytest.mark.parametrize("start,probs,flagged", [(40, (0.95, 0.70, 0.95), [1]), (40, (0.80, 0.70, 0.95), []), (10, (0.86, 0.87, 0.86), [0, 1, 2]), (40, (None, 0.5, None), [1])])
def test_hesitations(table, start, probs, flagged):
    w = table(words(*(("A", start + i, start + i + 1, "word", p) for i, p in enumerate(probs))), WORD).withColumn("agreement", F.lit(True))
    assert [i for (i,) in of(C.hesitations(w), "idx")] == flagged


def test_pack_windows(table):
    spans = table([(0, 0.0, 9.0), (1, 10.0, 21.0), (2, 22.0, 31.0), (3, 35.0, 40.0)], "span_idx int, start double, end double")
    assert of(I.pack_windows(spans, 20, 30), "start", "end") == [(0, 21), (22, 40)]
    assert of(I.pack_windows(spans, 5, 45, adaptive=True), "start", "end") == [(0, 31), (35, 40)]


def test_polish_windows(table):
    t = table([(0, "A", 0.0, 100.0, "x", 1), (1, "A", 100.0, 149.0, "x", 1), (2, "A", 149.0, 160.0, "x", 1)], TURN)
    assert of(I.group_by_span(t), "turn_id", "window") == [(0, 0), (1, 0), (2, 1)]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, X.anchor_trim(lit("b c X d"), lit("a b c"), lit("d e"))) == "X"
    assert one(spark, X.clock(lit(3661.25))) == "1:01:01" and one(spark, X.clock(lit(61.9))) == "1:01"
    assert one(spark, X.srt_clock(lit(3661.25))) == "01:01:01,250"
    text = "123456789012"
    assert one(spark, X.rewrite_ok(lit(text), lit(text + "1234"))) and not one(spark, X.rewrite_ok(lit(text), lit(text + "12345")))
    assert one(spark, X.question_marks(lit("האם זה נכון."))) == "האם זה נכון?" and one(spark, X.question_marks(lit("מה זה."))) == "מה זה."
    assert one(spark, X.question_marks(lit("ולמה לא! כן."))) == "ולמה לא? כן."
    assert one(spark, X.feminine_self_marker(lit("אז אני ממש אומרת לך"))) == "אומרת"
    assert one(spark, X.feminine_self_marker(lit("אני לומד"))) is None
    assert one(spark, X.strip_marks(lit("a‎b‪c﻿"))) == "abc"
    assert one(spark, X.shave_preamble(lit("Sure!\n0:01 hello\nx"))) == "0:01 hello\nx"
    assert one(spark, X.retry_wait(lit(None).cast("string"), lit('"retryDelay": "500s"'), lit(0))) == 180
    assert one(spark, X.error_kind(lit(429), lit("requests per day"))) == "exhausted" and one(spark, X.error_kind(lit(200), lit(""))) is None
    assert one(spark, X.is_plausible(lit("שלום לך"), lit("שלום"), lit("x"))) and not one(spark, X.is_plausible(lit("כן כן כן כן כן"), lit("כן כן כן כן"), lit("x")))
    assert one(spark, X.json_block(lit('x {"a": 1} y'))) == '{"a": 1}'


def test_fuzzy_anchor_and_coverage(spark):
    rows = spark.createDataFrame([("we said hallo there Dan Cohen thanks", "so we said hello there", "thanks")], "a string, b string, c string")
    assert rows.select(C.fuzzy_anchor_trim("a", "b", "c").alias("x")).first().x == "Dan Cohen"
    rows = spark.createDataFrame([("the word was Dan here", "Dan"), ("", "x"), ("x", "")], "a string, b string")
    assert [r.x for r in rows.select(C.coverage("a", "b").alias("x")).collect()] == [1.0, 0.0, 0.0]


def test_rename(table):
    t = table([(i, s) for i, s in enumerate(["S7", "S2", "S7"])], "idx int, speaker string")
    assert [r[1] for r in of(A.rename_first_seen(t), "idx", "renamed")] == ["SPEAKER_00", "SPEAKER_01", "SPEAKER_00"]


def test_arbitration(spark):
    rows = [("f", "worker", 0, 2, ["p"]), ("f", "local", 1, 1, ["p"] * 3), ("g", "worker", 0, 1, ["p"]), ("g", "local", 1, 1, ["p"])]
    c = spark.createDataFrame(rows, "call_id string, engine string, rank int, buried int, problems array<string>")
    assert {(r.call_id, r.engine) for r in R.arbitrate(c).collect()} == {("f", "local"), ("g", "worker")}


def test_variance(spark):
    out = R.variance_report(spark.createDataFrame([("f", 620), ("f", 637)], "file string, words int"), ["words"]).first()
    assert (out.words_mean, out.words_sd, out.runs) == (628.5, 8.5, 2)


def test_referee(spark):
    for a, b, expected in ((0.8, 0.5, "primary-confirmed"), (0.7, 0.6, "unresolved"), (0.6, 0.8, "secondary")):
        assert one(spark, C.referee(F.lit(a), F.lit(b))) == expected


def test_splice_and_rebase(table, spark):
    w = table(words(("A", 0, 1, "hi"), ("A", 1, 2, "bad"), ("A", 2, 3, "worse"), ("A", 3, 4, "bye")), WORD)
    answers = table([(0, [1, 2], "hi good day bye", 0.9)], "d_idx int, out_word_ids array<int>, text string, confidence double")
    assert of(C.splice(w, answers), "start", "end", "word", "source") == [(0, 1, "hi", "kept"), (1, 2, "good", "rescue"), (2, 3, "day", "rescue"), (3, 4, "bye", "kept")]
    moved = C.rebase(w.withColumn("d_idx", F.lit(0)), table([(0, 10.0, 12.0)], "d_idx int, a_start double, a_end double"))
    assert of(moved, "start", "end") == [(10, 10.5), (10.5, 11), (11, 11.5), (11.5, 12)]


def test_tails(table):
    rows = [(0, i, w, s) for i, (w, s) in enumerate([("name?", "A"), ("Dan", "A"), ("age?", "A"), ("ten", "A")])] + [(1, 4, "ok", "B")]
    w = table(rows, "turn_id int, idx int, word string, speaker string")
    assert [r[1] for r in of(A.split_tails(w), "idx", "handed")] == ["A", "B", "B", "B", "B"]
    veto = table([(0, 1, 0.9, 0.5, 0.0), (0, 2, 0.9, 0.5, 9.0)], "turn_id int, tail int, own_sim double, other_sim double, level_gap double")
    assert [r[1] for r in of(A.split_tails(w, veto), "idx", "handed")] == ["A", "A", "A", "B", "B"]


def test_edits(table):
    t = table([(0, "A", "one two three"), (1, "B", "four"), (2, "A", "five")], "turn_id int, speaker string, text string")
    e = table(
        [(0, 0, "B", None), (0, 1, None, [("one two", "A"), ("three", "B")]), (1, 0, "X", None), (2, 0, None, [("other", "A")])],
        "i int, pos int, speaker string, split array<struct<text:string,speaker:string>>",
    )
    assert of(A.apply_edits(t, e), "turn_id", "part", "speaker", "text", "edit") == [(0, 0, "A", "one two", "split"), (0, 1, "B", "three", "split"), (1, 0, "B", "four", "refused"), (2, 0, "A", "five", "refused")]


def test_flicker_and_windows(table):
    t = table([(0, 0.0, 0.3, "A"), (1, 0.3, 2.0, "B"), (2, 2.0, 2.4, "A"), (3, 2.4, 5.0, "B")], "idx int, start double, end double, speaker string")
    assert of(A.absorb_flicker(t), "start", "end", "speaker") == [(0, 0.3, "A"), (0.3, 5, "B")]
    w = table([(0, 1.0, 0), (1, 2.0, 0), (2, 3.0, 1)], "win_idx int, time double, label int")
    assert of(A.turns_from_windows(w), "start", "end", "speaker") == [(1, 2.5, "SPEAKER_00"), (2.5, 3.25, "SPEAKER_01")]


def test_stitch_keeps_each_word_once(table):
    win = table([(0, 0.0, 12.0), (1, 8.0, 20.0)], "window int, start double, end double")
    rows = [(0, i, "w", float(t), t + 0.5) for i, t in enumerate((1, 9, 11))] + [(1, i, "w", float(t), t + 0.5) for i, t in enumerate((1, 3, 10))]
    out = I.stitch(win, table(rows, "window int, idx int, word string, start double, end double"))
    assert of(out, "window", "start") == [(0, 1), (0, 9), (1, 11), (1, 18)]


def test_chunks_and_rescale(table):
    c = table([(2500.0,)], "seconds double")
    assert of(I.chunk_plan(c, F.col("seconds")), "chunk", "offset", "length") == [(0, 0, 1200), (1, 1200, 1200), (2, 2400, 100)]
    w = table(words(("A", 10, 20)), WORD)
    assert of(I.rescale(w, 0.85), "start", "end") == [(8.5, 17.0)]


def test_tracks(table):
    rows = [(i, [0.9, 0.1, 0.0, 0.0] if i < 30 else [0.2, 0.8, 0.0, 0.9 if i == 40 else 0.0]) for i in range(80)]
    t = table(rows, "frame_idx int, probs array<double>")
    assert of(A.track_turns(t), "start", "end", "speaker") == [(0, 2.4, "SPEAKER_00"), (2.4, 6.4, "SPEAKER_01")]


def test_gender_signals(table):
    t = table([(0, "A", "אני אומרת"), (1, "A", "אני חושבת"), (2, "B", "אני יודעת"), (3, "B", "שלום")], "turn_id int, speaker string, text string")
    assert of(R.gender_signals(t), "turn_id", "marker", "suspect") == [(0, "אומרת", False), (1, "חושבת", False), (2, "יודעת", True)]


def test_align_chunks(table):
    w = table(words(("A", 0, 10), ("A", 10.05, 21), ("A", 22, 23)), WORD)
    assert of(C.align_chunks(w), "idx", "chunk") == [(0, 0), (1, 0), (2, 1)]


def slow_loops(said, most=3):
    """The rule, place by place: a cycle of one token is tried before one of two."""
    out, loops, i = [], 0, 0
    while i < len(said):
        for cycle in (1, 2):
            unit, n = said[i : i + cycle], 1
            while len(unit) == cycle and all(unit) and said[i + n * cycle : i + (n + 1) * cycle] == unit:
                n += 1
            if n > most:
                out += said[i : i + most * cycle]
                i, loops = i + n * cycle, loops + 1
                break
        else:
            out.append(said[i])
            i += 1
    return out, loops


def test_loops_match_the_rule_on_random_streams(spark):

    rng = random.Random(5)
    streams = {f"c{k}": [rng.choice(("a", "b", "", "c")[: rng.choice((2, 2, 3, 4))]) for _ in range(rng.randrange(1, 30))] for k in range(1000)}
    streams["x"] = "a b a b a b a b b b b".split()
    rows = [(c, i, w, float(i), i + 1.0) for c, ws in streams.items() for i, w in enumerate(ws)]
    rng.shuffle(rows)
    got = {}
    for r in C.collapse_loops(spark.createDataFrame(rows, "call_id string, idx int, word string, start double, end double")).orderBy("call_id", "idx").collect():
        got.setdefault(r.call_id, ([], r.loops))[0].append(r.word)
    assert got == {c: slow_loops(ws) for c, ws in streams.items()}
    assert len(got["x"][0]) == 9 and got["x"][1] == 1
