"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last lines decides where a chunk ends, so
the same passage is cut alike wherever it stands. Chunks are small: to find
repeated passages down to two lines, 63 of 64 lines end one. What is compared all
over the corpus are units of several lines: two neighbouring chunks, a chunk of
several lines by itself, or a single line as long as a passage. Of equal units the
first stays, and the chunks of the others are removed once their bytes have been
compared with the first one's. Units overlap, so a repeated passage is removed as
far as it reaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, fresh, in_arrow, spread_join

#: Lines in the window of the rolling hash, its base and modulus, and the one of how many windows that does not end a chunk.
SPAN, BASE, MODULUS, DIVISOR = 2, 1_000_003, 2_147_483_647, 64
#: Words that make a single line a passage.
PASSAGE_WORDS = 50
SPACE = " \t\n\v\f\r"


def is_passage(line: bytes) -> bool:
    return len(line.split(None, PASSAGE_WORDS - 1)) == PASSAGE_WORDS


def chunks(text: str) -> list[tuple[int, int]]:
    """(first line, line after the last) of each chunk, in order.

    The rolling hash after a line with a word is that of the last SPAN hashes of
    such lines (those before the first count as 0). A chunk ends before the next
    line with a word unless that hash is 0 modulo DIVISOR; a line as long as a
    passage is a chunk by itself. Lines without a word belong to the chunk before
    them, at the start of a text to the first one.
    """
    starts, before, ends = [0], 0, None
    lines = text.split("\n")
    for k, line in enumerate(lines):
        if not line.strip(SPACE):
            continue
        whole = line.encode()
        passage = is_passage(whole)
        if ends or (passage and ends is not None):
            starts.append(k)
        own = int.from_bytes(md5(whole).digest()[:4], "big") % MODULUS
        ends = passage or (before * BASE + own) % MODULUS % DIVISOR != 0
        before = own
    return list(zip(starts, [*starts[1:], len(lines)]))


def contents(text: str) -> list[tuple[int, int, bytes, int]]:
    """(first line, line after the last, its lines with a word as UTF-8, their number) of each chunk."""
    lines, out = text.split("\n"), []
    for a, b in chunks(text):
        own = [x for x in lines[a:b] if x.strip(SPACE)]
        out.append((a, b, "\n".join(own).encode(), len(own)))
    return out


def units(text: str) -> Iterator[tuple[int, bool, int]]:
    """(place of its first chunk, whether it is a pair of chunks, hash) of every unit of a text."""
    before = b""
    for place, (_, _, own, n) in enumerate(contents(text)):
        digest = md5(own).digest()
        if place:
            yield place - 1, True, int.from_bytes(md5(before + digest).digest()[:8], "big", signed=True)
        if n > 1 or (n and is_passage(own)):
            yield place, False, int.from_bytes(digest[:8], "big", signed=True)
        before = digest


def _index(docs: DataFrame, row: str) -> DataFrame:
    """(doc, row, place int, pair boolean, hash long) of every unit of the documents with an id."""
    added = [T.StructField("place", T.IntegerType()), T.StructField("pair", T.BooleanType()), T.StructField("hash", T.LongType())]
    schema = T.StructType([T.StructField("doc", docs.schema["doc_id"].dataType), T.StructField("row", T.LongType()), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *u) for i, text in enumerate(batch.column(2)) for u in units(text.as_py())]
            owner, place, pair, digest = zip(*found) if found else ((),) * 4
            owners = pa.array(owner, pa.int64())
            arrays = [batch.column(0).take(owners), batch.column(1).take(owners), pa.array(place, pa.int32()), pa.array(pair, pa.bool_()), pa.array(digest, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return in_arrow(docs.filter("doc_id is not null and text is not null").select("doc_id", row, "text"), run, schema)


def _texts(marked: DataFrame, row: str, wanted: str) -> DataFrame:
    """(doc, row, place, chunk binary) for the places in the column wanted."""
    schema = T.StructType([T.StructField("doc", marked.schema["doc_id"].dataType), T.StructField("row", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("chunk", T.BinaryType())])
    names = marked.columns
    doc, own, text, places = (names.index(c) for c in ("doc_id", row, "text", wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, place, found = [], [], []
            for i, asked in enumerate(batch.column(places)):
                if asked.is_valid:
                    every = contents(batch.column(text)[i].as_py())
                    for k in sorted(set(asked.as_py())):
                        owner.append(i), place.append(k), found.append(every[k][2])
            owners = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(doc).take(owners), batch.column(own).take(owners), pa.array(place, pa.int32()), pa.array(found, pa.binary())], schema.names)

    return in_arrow(marked, run, schema)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text replaced by what is left of it, and a column removed_lines (long).

    Every row stays. Of equal units the one with the smallest (doc_id, place) stays;
    rows that share a doc_id and a text count as one document, so a repeated row is
    left as it is, while rows of one id with different texts are documents in the
    order of a hash. What is removed always has an equal chunk before it, so
    something of each passage stays. Null and empty texts are left as they are, and
    so are rows with a null doc_id, which also take no part as first occurrences. A
    text whose chunks all go becomes empty. An empty table gives an empty result; a
    column removed_lines of docs is replaced, all others are kept.

    Only hashes and places are grouped. Texts are shuffled once, by doc_id: both
    joins with docs read the same exchange. Chunks that repeat travel once for each
    copy, to be compared byte by byte. Frequent hashes and chunks are dealt over tasks.
    """
    kept = [c for c in docs.columns if c.lower() != "removed_lines"]
    docs = docs.select(*kept)
    row, wanted, later_name = (fresh(c, docs) for c in ("_row", "_wanted", "_later"))
    docs = docs.withColumn(row, F.xxhash64("text"))
    index = checkpointed(_index(docs, row))
    at = F.struct("doc", "row", "place")
    repeated = index.groupBy("hash", "pair").agg(F.count("*").alias("n"), F.min(at).alias("first"))
    repeated = checkpointed(repeated.filter("n > 1").select("hash", "pair", "first"))
    # Chunks of later units, each with the first unit's chunk that its bytes must equal.
    later = spread_join(index, repeated, ["hash", "pair"]).filter(at != F.col("first"))
    step = F.explode(F.when(F.col("pair"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    later = later.select("doc", "row", "place", "first", step.alias("step"))
    source = F.struct(F.col("first.doc").alias("doc"), F.col("first.row").alias("row"), (F.col("first.place") + F.col("step")).alias("place"))
    later = later.groupBy("doc", "row", (F.col("place") + F.col("step")).alias("at")).agg(F.min(source).alias("source"))
    later = checkpointed(later.select(F.col("doc").alias("of"), F.col("row").alias("of_row"), "at", "source.*"))
    asked = later.groupBy("doc", "row").agg(F.collect_set("place").alias(wanted))
    texts = _texts(_beside(docs, asked, row, wanted), row, wanted)
    found = spread_join(later, texts, ["doc", "row", "place"])
    found = found.groupBy(F.col("of").alias("doc"), F.col("of_row").alias("row")).agg(F.collect_list(F.struct("at", "chunk")).alias(later_name))
    marked = _beside(docs, found, row, later_name)
    return in_arrow(marked, _removal(kept), T.StructType([*docs.select(*kept).schema.fields, T.StructField("removed_lines", T.LongType())]))


def _beside(docs: DataFrame, marks: DataFrame, row: str, name: str) -> DataFrame:
    """docs with the column name of marks for their id and text, or null."""
    same = (F.col("doc_id") == marks["doc"]) & (F.col(row) == marks["row"])
    return docs.join(marks, same, "left").select(*docs.columns, name)


def _removal(kept: list[str]):
    text_at = kept.index("text")

    def cut(text: str | None, later: list[dict] | None) -> tuple[str | None, int]:
        if not text or not later:
            return text, 0
        wanted = {x["at"]: x["chunk"] for x in later}
        lines, left, gone = text.split("\n"), [], 0
        for k, (a, b, own, _) in enumerate(contents(text)):
            if wanted.get(k) == own:
                gone += b - a
            else:
                left += lines[a:b]
        return "\n".join(left), gone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [cut(text.as_py(), later.as_py()) for text, later in zip(batch.column(text_at), batch.column(len(kept) + 1))]
            columns = batch.columns[: len(kept)]
            columns[text_at] = pa.array([t for t, _ in done], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in done], pa.int64())], [*kept, "removed_lines"])

    return run
