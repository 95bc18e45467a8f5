import random

import xxhash
from pyspark.sql import functions as F

from parlance.llm import simhash
from parlance.llm.components import connected_components


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, radius=3):
    fps = [slow_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), f"{fps[i]:016x}", str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


def texts():
    rng = random.Random(5)
    words = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(60)]
    base = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 8, 60, 200]))) for _ in range(60)]
    out = []
    for t in base:
        out.append(t)
        for _ in range(rng.choice([0, 0, 2, 6])):
            w = t.split()
            w[rng.randrange(len(w))] = rng.choice(words)
            out.append("\t".join(w))
    return out + base[:5] + [None, "", "  \n", "x y", "A", "a"]


def result(df):
    fp = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return sorted((str(r[0]), r[1], str(r[2])) for r in df.select("doc_id", fp, "component_id").collect())


def test_matches_brute_force(spark):
    rows = list(enumerate(texts(), 100)) + [(100, "again"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, component_id int")
    assert result(simhash.near_duplicates(docs)) == slow_components(rows)
    assert result(simhash.near_duplicates(docs.repartition(5), tile=2)) == slow_components(rows)


def test_links_are_complete(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = {centre} | {rng.getrandbits(64) for _ in range(50)} | {0, 2**64 - 1, 1, 7, 2**63}
    for _ in range(400):
        x = centre
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 5])):
            x ^= 1 << b
        fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = connected_components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), tile=50))
    root = {r.node & (2**64 - 1): r.root for r in got.collect()}
    for x in fps:
        for y in fps:
            if x != y and (x ^ y).bit_count() <= 3:
                assert root[x] == root[y]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
