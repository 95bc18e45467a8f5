"""SimHash fingerprints of word shingles and their exact links within a radius.

Fingerprints are compared in tiles. A tile holds fingerprints with the same
population counts in their four 16-bit quarters; two tiles are compared, by
numpy exclusive-or and bit counts, unless their population counts differ beyond
the radius. Equal fingerprints are one before that, and each comparison returns
a spanning forest of its links, not the links, so a group of near copies costs
rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, fresh, in_arrow
from .components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 3
QUARTERS = 4
#: Fingerprints in a tile, on average, where a combination of counts has more than these.
TILE = 4096
#: Comparisons made at once, and shingle hashes counted at once.
CELLS, HASHES = 1 << 20, 1 << 16


def fingerprint(text: bytes | None) -> int:
    """The unsigned 64-bit SimHash of UTF-8 text; 0 without words.

    A-Z are lower-cased, words are runs of anything but ASCII white space, and a
    bit is 1 if it is set in over half the hashes of all shingles.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[-n:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, HASHES):
        hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + HASHES], stops[k : k + HASHES])], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        found = np.fromiter((fingerprint(x.as_py()) for x in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for every row of docs, computed once."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return checkpointed(in_arrow(docs.select("doc_id", "text"), _fingerprints, f"doc_id {kind}, fp long"))


def _roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """root (the least node known to be linked, for each of n nodes) after the links a-b."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        least = np.minimum(x, y)
        np.minimum.at(root, np.maximum(x, y), least)
        while (root[root] != root).any():
            root = root[root]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, same, radius): two tiles, or one with itself. Gives the forest of their links."""
    for batch in batches:
        out_a, out_b = [], []
        tiles = [(batch.column(k).offsets.to_numpy(), batch.column(k).values.to_numpy()) for k in (0, 1)]
        same, radius = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for row in range(batch.num_rows):
            a, b = (values[at[row] : at[row + 1]].view(np.uint64) for at, values in tiles)
            root, step = np.arange(len(a) + len(b)), max(1, CELLS // max(1, len(b)))
            linked = False
            for k in range(0, len(a), step):
                near = np.bitwise_count(a[k : k + step, None] ^ b[None, :]) <= radius[row]
                if same[row]:
                    near &= np.arange(k, k + len(near))[:, None] < np.arange(len(b))[None, :]
                if near.any():
                    i, j = np.nonzero(near)
                    root = _roots(len(root), i + k, j if same[row] else j + len(a), root)
                    linked = True
            if linked:
                nodes = np.nonzero(root != np.arange(len(root)))[0]
                both = np.concatenate([a, b]).view(np.int64)
                out_a.append(both[nodes])
                out_b.append(both[root[nodes]])
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_b)], ["a", "b"])


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """A forest (a, b) that joins all distinct fingerprints (fp) within radius of each other, directly or by way of others.

    Counts of four quarters have at most 17^4 = 83,521 combinations; only a table
    with a row for each of these is broadcast. Combinations with more than tile
    fingerprints are split by hash, so no task holds an unbounded tile.
    """
    width = 64 // QUARTERS
    ones = [F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND((1 << width) - 1)) for k in range(QUARTERS)]
    counts = [f"c{k}" for k in range(QUARTERS)]
    placed = distinct.select("fp", *(x.cast("int").alias(c) for x, c in zip(ones, counts)))
    parts = placed.groupBy(*counts).agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    tiles = checkpointed(
        placed.join(F.broadcast(parts), counts)
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .groupBy(*counts, "part")
        .agg(F.sort_array(F.collect_list("fp")).alias("tile"))
    )
    steps = [d for d in product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, d)) <= radius and d >= (0,) * QUARTERS]
    step = F.explode(F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip(d, counts))) for d in steps)))
    #: A tile goes to each tile of a neighbouring combination by that tile's own key, so a combination with many tiles is many keys.
    sent = tiles.select("part", F.col("tile").alias("a"), *counts, step.alias("step")).select(
        "part",
        "a",
        *((F.col(c) + F.col(f"step.{c}")).alias(c) for c in counts),
        F.forall(F.array(*(F.col(f"step.{c}") == 0 for c in counts)), lambda x: x).alias("home"),
    )
    sent = sent.join(F.broadcast(parts), counts).withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = sent.filter("not home or part <= part_b").withColumn("same", F.col("home") & (F.col("part") == F.col("part_b")))
    pairs = sent.select("a", "same", *counts, "part_b").join(tiles.withColumnRenamed("part", "part_b"), [*counts, "part_b"])
    pairs = pairs.select("a", F.col("tile").alias("b"), "same", F.lit(radius).alias("radius"))
    return in_arrow(pairs, _compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fp long, root long, component_id) for every row of docs (doc_id, text).

    component_id is the smallest doc_id that can be reached over links of radius
    differing bits or fewer, the document itself included; root, a fingerprint,
    also names the component. Texts without words, null ones too, have the
    fingerprint 0 and are linked like any other. Rows with equal texts are in one
    component; a null doc_id is never the smallest, and component_id is null only
    where no row of a component has an id. No rows in, no rows out; other columns
    of docs are left out.
    """
    found = fingerprints(docs)
    distinct = found.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(links(distinct.select("fp"), radius, tile))
    distinct = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    distinct = distinct.withColumn("root", F.coalesce("root", "fp"))
    groups = distinct.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = distinct.select("fp", "root").join(groups, "root").select("fp", "root", "component_id")
    return found.join(checkpointed(groups), "fp").select("doc_id", "fp", "root", "component_id")


def _with_fingerprints(docs: DataFrame, name: str) -> DataFrame:
    at, names = docs.columns.index("text"), [*docs.columns, name]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py()) for x in batch.column(at).cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names)

    return in_arrow(docs, add, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def keep_one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of docs for each component, unchanged: that of the smallest doc_id, a null id coming last.

    Where ids are null or repeated, the fingerprint decides between rows of one
    id, and of rows equal in both any one stays.
    """
    own, kept, fp = (fresh(c, docs) for c in ("_own", "_kept", "_fp"))
    found = checkpointed(near_duplicates(docs, radius))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "fp")).alias("first"))
    first = checkpointed(first.select(F.col("first.doc_id").alias(own), F.col("first.fp").alias(kept)))
    unclear = found.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if unclear.isEmpty():
        return docs.join(first, F.col("doc_id") == F.col(own), "left_semi")
    marked = _with_fingerprints(docs, fp)
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(fp) == F.col(kept))
    return marked.join(first, same, "left_semi").dropDuplicates(["doc_id", fp]).select(*docs.columns)
