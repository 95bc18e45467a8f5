import random
from hashlib import md5

import pytest

from parlance.llm import line_dedup

BLANKS = " \t\n\v\f\r"


def brute(rows):
    """Each row by itself: its chunks, its units, and what of them occurs earlier."""
    docs = {}
    for d, t in {r for r in rows if r[0] is not None and r[1] is not None}:
        pieces, last, cut = [[]], 0, False
        for line in t.split("\n"):
            if line.strip(BLANKS):
                long = len(line.encode().split()) >= 50
                if cut or (long and any(x.strip(BLANKS) for x in pieces[-1])):
                    pieces.append([])
                h = int(md5(line.encode()).hexdigest()[:8], 16) % 2147483647
                cut = long or (last * 1000003 + h) % 2147483647 % 64 > 0
                last = h
            pieces[-1].append(line)
        docs[d, t] = pieces
    first, wordy = {}, lambda piece: "\n".join(x for x in piece if x.strip(BLANKS))
    found = []
    for (d, t), pieces in docs.items():
        own = [wordy(p) for p in pieces]
        for k in range(len(own)):
            if k + 1 < len(own):
                found.append((d, k, t, (own[k], own[k + 1]), (k, k + 1)))
            if "\n" in own[k] or len(own[k].encode().split()) >= 50:
                found.append((d, k, t, own[k], (k,)))
    for d, k, t, unit, _ in found:
        first[unit] = min(first.get(unit, (d, k)), (d, k))
    gone = {(d, t, k) for d, at, t, unit, ks in found if first[unit] != (d, at) for k in ks}
    out = []
    for d, t in rows:
        if (d, t) not in docs:
            out.append((str(d), str(t), 0))
            continue
        left = ["\n".join(p) for k, p in enumerate(docs[d, t]) if (d, t, k) not in gone]
        out.append((str(d), "\n".join(left), sum(len(p) for k, p in enumerate(docs[d, t]) if (d, t, k) in gone)))
    return sorted(out)


def a_line(rng, least=3, most=9):
    return " ".join(rng.choice("alpha beta gamma delta é 字".split()) + str(rng.randrange(900)) for _ in range(rng.randrange(least, most)))


def passages():
    rng = random.Random(4)
    shared = [[a_line(rng) for _ in range(12)] for _ in range(4)] + [[a_line(rng, 55, 80)]]
    rows = []
    for d in range(120):
        lines = [a_line(rng) for _ in range(rng.randrange(1, 8))]
        if d % 3:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = shared[d % 5][rng.randrange(3) if d % 5 < 4 else 0 :]
        if d % 7 == 0:
            lines = [x for line in lines for x in (line, " " * (d % 2))]
        rows.append((d, "\n".join(lines)))
    return rows + [(500, rows[7][1]), (7, rows[7][1]), (501, None), (502, ""), (503, "\n\n\n"), (None, rows[8][1]), (504, "a\n" * 400), (505, "\n\n" + rows[8][1])]


def result(df):
    return sorted((str(r.doc_id), str(r.text), r.removed_lines) for r in df.collect())


def test_matches_brute_force(spark):
    rows = passages()
    docs = spark.createDataFrame([(*r, 5, "h", 1) for r in rows], "doc_id long, text string, removed_lines int, hash string, _row int")
    got = line_dedup.dedup_lines(docs)
    assert result(got) == brute(rows) == result(line_dedup.dedup_lines(docs.repartition(7)))
    assert got.columns == ["doc_id", "text", "hash", "_row", "removed_lines"]
    assert sum(r[2] for r in result(got)) > 400


def lost(own, other):
    """Lines of the second document's copy that are found, by the definition of units."""
    seen = {(pair, h) for _, pair, h in line_dedup.units(own)}
    spans = line_dedup.contents(other)
    gone = {p + k for p, pair, h in line_dedup.units(other) if (pair, h) in seen for k in range(1 + pair)}
    return {line for k in gone for line in range(*spans[k][:2])}


@pytest.mark.parametrize("n", [2, 3, 4, 6, 8, 12, 20])
def test_recall_on_planted_passages(n):
    """Of the lines of a passage between other lines, nine in ten at least are found, and none of the others."""
    rng = random.Random(n)
    found = 0
    for _ in range(400):
        passage = [f"{rng.random()} of six words in all" for _ in range(n)]
        sides = [[f"{rng.random()} other" for _ in range(3)] for _ in range(4)]
        got = lost("\n".join(sides[0] + passage + sides[1]), "\n".join(sides[2] + passage + sides[3]))
        assert got <= set(range(3, 3 + n))
        found += len(got)
    assert found >= 0.9 * 400 * n


def test_long_single_lines_and_blank_lines():
    rng = random.Random(1)
    line = " ".join(str(rng.random()) for _ in range(50))
    assert sum(lost(f"a\n{line}\nb", f"c {k}\n{line}\nd") == {1} for k in range(100)) == 100
    assert not any(lost(f"a\n{line[:-30]}\nb", f"c {k}\n{line[:-30]}\nd") for k in range(100))
    assert lost("x 1\nfirst\n\nnext\n\nthird\ny", "x 2\nfirst\nnext\nthird") == {1, 2, 3}


def test_something_of_every_passage_stays(spark):
    rng = random.Random(2)
    lines = [f"line {k}" for k in range(12)]
    rows = [(d, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9)))) for d in range(200)]
    got = result(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)
    assert {x for _, t in rows for x in t.split("\n")} == {x for _, t, _ in got for x in t.split("\n")} - {""}


def test_frequent_passage_and_text_of_one_id(spark):
    text = "one line here\nand another one\nand a third"
    rows = [(d, f"start {d}\n{text}\nend {d}") for d in range(300)] + [(5, f"{text}\nsomething else")]
    got = result(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum(text in t for _, t, _ in got) >= 1 and sum(n for *_, n in got) >= 280 * 3
    assert [t for d, t, _ in got if d == "5"].count("something else") + sum(text in t for d, t, _ in got if d == "5") >= 1


def test_single_chunks_stay(spark):
    docs = spark.createDataFrame([(1, "one two three four five\nsix seven eight nine"), (2, "a b c d e\nf g h i j")], "doc_id long, text string")
    before = [(r.doc_id, r.text) for r in docs.collect()]
    assert [(r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).orderBy("doc_id").collect()] == before


def test_empty(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
