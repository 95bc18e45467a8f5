import random
import re
import unicodedata

from parlance.llm import decontamination as D

WORDS = "river stone cloud paper metal garden window silver basket candle mirror bottle pencil hammer ladder saddle".split()


def item(rng, n=30):
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n))


def spell(text):
    """The token rules, one at a time."""
    out, start, number = [], True, False
    for m in re.finditer(r"\d+(?:[.,:]\d+)*|[^\W\d_]+|[.!?\n]|[%$€£°]", unicodedata.normalize("NFC", text)):
        t = m.group()
        if t in ".!?\n":
            start, number = True, False
            continue
        if t in "%$€£°":
            near = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
            if not any(c.isdigit() for c in near) and not (text[m.start() - 1 : m.start()] == " " and text[m.start() - 2 : m.start() - 1].isdigit()):
                continue
            out.append("<unit>")
        elif t[0].isdigit():
            out.append("<number>")
        elif number and t.lower() in D.UNITS:
            out.append("<unit>")
        elif not start and len(t) > 1 and t[0].isupper() and sum(c.isupper() for c in t) == 1:
            out.append("<name>")
        else:
            out.append(t.lower())
        start, number = False, t[0].isdigit()
    return out


def test_canonical_tokens():
    texts = ["Anna paid $3.50 for 2 kg of Apples. Then 5 km, 7% and 8 %.", "", "WORD!! and $$$ %%% ÉTÉ Été x\nNew line", "a1b2 3,000.5:7 ok 3 days", "."]
    code = lambda k: {int(D.NUMBER): "<number>", int(D.UNIT): "<unit>", int(D.NAME): "<name>"}.get(int(k))
    got = D.canonical(texts)
    for i, text in enumerate(texts):
        own = got.text == i
        shown = [code(c) or text[s : s + n].lower() for c, s, n in zip(got.code[own], got.start[own], got.size[own])]
        assert shown == spell(text)


def test_planted_items(spark):
    rng = random.Random(2)
    items = [(i, item(rng)) for i in range(20)] + [(20, "too short"), (21, None), (22, "In town Peter bought 12 kg of flour and 3 bags of sugar for Anna and paid 40 euros for it")]
    clean = [(100 + i, item(rng, 200)) for i in range(40)]
    docs = list(clean)
    docs.append((200, "before this " + items[3][1] + " after that"))
    docs.append((201, item(rng) + ". " + items[4][1].upper().replace(" ", "!! ") + " end"))
    docs.append((202, "So in town Maria bought 15 kg of flour and 7 bags of sugar for Julia and paid 99 euros for it"))
    docs.append((203, "In town Maria bought 15 kg of flour and 15 bags of sugar for Maria and paid 15 euros for it"))
    docs.append((204, " ".join(items[5][1].split()[:20])))
    docs += [(205, None), (206, ""), (207, items[6][1] + " " + items[7][1]), (207, items[6][1] + " " + items[7][1])]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.reworded) for r in D.contaminated(frame, bench).collect())
    expected = [(200, 3, False), (201, 4, False), (202, 22, True), (204, 5, False)] + [(207, 6, False), (207, 7, False)] * 2
    assert [g for g in got if g[0] != 203] == sorted(expected)
    assert got == sorted((r.doc_id, r.item_id, r.reworded) for r in D.contaminated(frame, bench, block_bytes=500).collect())
    kept = D.keep_uncontaminated(frame, bench, block_bytes=500)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} >= {d for d, _ in clean} | {205, 206}
    assert not {r.doc_id for r in kept.collect()} & {200, 201, 202, 204, 207}


def test_slots_must_agree():
    bench = "if a box holds 4 pens then how many pens do 4 boxes and 4 more boxes hold in all of 9 shops"
    same = bench.replace("4", "7").replace("9", "3")
    mixed = "if a box holds 4 pens then how many pens do 5 boxes and 6 more boxes hold in all of 8 shops"
    block = D.Block([(1, bench)])
    (whole,), (part,) = block.matches([same])[0], (block.matches([mixed])[0] or [(1, 0, 0, False)])
    assert whole[2] == whole[1] and whole[3] and part[2] < whole[2]


def test_passages_of_long_items():
    rng = random.Random(6)
    long, longer = item(rng, 200), item(rng, 2000)
    block = D.Block([(1, long), (2, longer)])
    part = lambda text, a, b: " ".join(text.split()[a:b])
    around = lambda text: f"{item(rng, 40)} {text} {item(rng, 40)}"
    found = block.matches([around(part(long, 70, 130)), around(part(longer, 600, 1500)), around(part(long, 50, 63)), around(part(long, 50, 62)), item(rng, 3000)])
    assert found == [[(1, 200, 60, False)], [(2, 2000, 900, False)], [(1, 200, 13, False)], [], []]
    bought = lambda name, n: f"in town {name} then bought {n} kg of flour and some more bags of sugar for the {n} old neighbours who live with {name} over there"
    block = D.Block([(3, bought("Peter", 12) + " . " + long)])
    assert block.matches([bought("Maria", 70) + " . " + item(rng, 200)]) == [[(3, 226, 26, True)]]


def test_verbatim_copies_are_found():
    items = {
        1: "What is 12 + 7 - 3 * 4 + 9 - 2 + 6 * 8 + 1?",
        2: "Mayor Anna Smith Opens New Harbour Bridge After Long Delay In Hamburg",
        3: "Who wrote Faust?",
        4: "1990 12 1991 14 1992 17 1993 22 1994 31",
        5: "7 7 7 7 7 7 7 7 7 7 7 7",
        6: "?!",
        7: "The Mayor Of Hamburg",
    }
    block = D.Block(list(items.items()))
    for k in (1, 2, 3, 4, 5, 7):
        for text in (items[k], items[k].lower(), items[k].upper()):
            assert (k, False) in [(m[0], m[3]) for m in block.matches([f"so he said {text} and went on"])[0]]
    assert block.matches(["So he asked who wrote it, and the mayor of Bremen said 13 + 8 - 4 ?! 7 7 7"]) == [[]]


def test_readings_of_capitalised_words():
    items = {
        1: "What is the boiling point of water",
        2: "Anna has 5 apples left",
        3: "Gestern kaufte Anna im Laden 3 Hefte und 2 Stifte und zahlte dafür 9 Euro",
        4: "Peter Jones met Anna Smith",
    }
    block = D.Block(list(items.items()))
    found = lambda text: [(m[0], m[3]) for m in block.matches([text])[0]]
    assert found("Question: What is the boiling point of water") == found("Yes. What is the boiling point of water") == [(1, False)]
    assert found("Peter has 7 apples left") == found("Question: Peter has 7 apples left") == [(2, True)]
    assert found("So. gestern kaufte anna im laden 4 hefte und 7 stifte und zahlte dafür 8 euro") == [(3, True)]
    assert found("Heute kaufte Maria im Laden 4 Hefte und 7 Stifte und zahlte dafür 8 Euro") == [(3, True)]
    assert found("Then Maria Brown met Julia Green") == []


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "some words here and there")], "doc_id long, text string")
    assert D.contaminated(docs, bench).collect() == [] and D.contaminated(none, bench).collect() == []
    assert D.keep_uncontaminated(docs, bench).count() == 1
