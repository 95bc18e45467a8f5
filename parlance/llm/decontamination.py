"""Benchmark decontamination by template canonicalisation.

Texts become token sequences in which numbers, units and names are typed
placeholders. Windows of a benchmark item's template are hash-joined with the
windows of every document; matches are lined up by item and offset, and the
values behind the placeholders must map to each other one to one, so a question
asked again with other numbers and names is found and a chance pattern is not.
Windows of the words themselves are joined beside them, so that a verbatim copy is
found whatever its case and however many placeholders its template has.

The benchmark is the small side of the hash join. It is taken in blocks of
bounded size, each sent to the workers as sorted hashes; documents are not
shuffled.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

#: Tokens in a window; an item that is shorter is one window. Literal tokens that a window has at least, as a share.
WINDOW, LITERAL = 8, 0.5
#: Tokens that a template has at least; of shorter items only verbatim copies are found. `too_short` lists those.
LEAST_TOKENS = 5
#: An item is held if consistent windows cover this share of its tokens, or this many in a row, whatever its length:
#: RUN with the item's own values, or REWORDED_RUN, as up to half of those may be placeholders.
COVERAGE, RUN, REWORDED_RUN = 0.5, 13, 26
#: UTF-8 bytes of benchmark text in a block.
BLOCK_BYTES = 16 << 20

#: Abbreviations and words of units, which count only after a number.
UNITS = (
    "mm cm dm m km in ft yd mi mg g kg t oz lb lbs ml cl l gal ms s sec secs min mins h hr hrs hz khz mhz ghz"
    " kb mb gb tb v w kw kwh a pa kpa bar k c f usd eur gbp cents dollars euros pounds percent"
    " second seconds minute minutes hour hours day days week weeks month months year years"
    " meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards"
    " gram grams kilogram kilograms ton tons tonne tonnes liter liters litre litres degree degrees"
).split()
ENDS, SIGNS, JOINERS = ".!?\n", "%$€£°", ".,:"
OTHER, LETTER, DIGIT, END, SIGN = range(5)
#: Codes of the placeholders.
NUMBER, UNIT, NAME = np.array([1, 2, 3], np.uint64)
#: Characters that are tokenised at once.
ROUND = 1 << 18
#: Bits of a window's hash by which it is looked for first.
LEADING = 20
LOOK = np.uint64(64 - LEADING)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(256)], np.uint64)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its class, its lower case, whether it is upper or title case, whether it joins digits."""
    size = 0x110000
    kind, lower, upper, joins = np.zeros(size, np.uint8), np.arange(size, dtype=np.uint32), np.zeros(size, bool), np.zeros(size, bool)
    for c in range(size):
        category = unicodedata.category(chr(c))
        if category[0] in "LM":
            kind[c], upper[c] = LETTER, category in ("Lu", "Lt")
            if len(low := chr(c).lower()) == 1:
                lower[c] = ord(low)
        elif category == "Nd":
            kind[c] = DIGIT
    kind[[ord(c) for c in ENDS]], kind[[ord(c) for c in SIGNS]], joins[[ord(c) for c in JOINERS]] = END, SIGN, True
    return kind, lower, upper, joins


class Tokens(NamedTuple):
    """Arrays with an entry for each token: its text's index, code, value, first character there, length; whether it is a number.

    And the codes of its other readings: with title-case words as names where they
    begin a sentence too, and with no names.
    """

    text: np.ndarray
    code: np.ndarray
    value: np.ndarray
    start: np.ndarray
    size: np.ndarray
    is_number: np.ndarray
    named: np.ndarray
    nameless: np.ndarray


def canonical(texts: list[str]) -> Tokens:
    """The template tokens of texts.

    Tokens are runs of letters and runs of digits, with single points, commas and
    colons between digits. A run of digits is a number; a unit's name after a
    number in the same sentence, or a currency, percent or degree sign beside one,
    is a unit; a word in title case that doesn't begin a sentence or line is a
    name. Any other word's code is the hash of its lower case. The value is that
    hash for all tokens. Punctuation is dropped.
    """
    kind_of, lower, upper, joins = _tables()
    codes = np.frombuffer("".join(f"\n{t}" for t in texts).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32)
    kind = kind_of[codes]
    digit = kind == DIGIT
    inner = np.nonzero(joins[codes[1:-1]] & digit[:-2] & digit[2:])[0] + 1
    kind[inner] = DIGIT
    digit[inner] = True
    sign = np.nonzero(kind == SIGN)[0]
    beside = digit[sign - 1] | digit[sign + 1] | ((codes[sign - 1] == 32) & digit[np.maximum(sign - 2, 0)])
    kind[sign[~beside]] = OTHER
    cut = np.nonzero(np.concatenate([[True], kind[1:] != kind[:-1]]) | (kind == SIGN))[0]
    size = np.diff(np.append(cut, len(codes)))
    place = np.arange(len(codes)) - np.repeat(cut, size)
    value = np.add.reduceat((lower[codes].astype(np.uint64) + np.uint64(7)) * _POWERS[place & 255], cut)
    value ^= value >> np.uint64(31)
    value *= _MIX
    capitals = np.add.reduceat(upper[codes].astype(np.int64), cut)
    sentence = np.cumsum(kind == END)[cut]
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), cut, "right")
    of = kind[cut]
    token = (of == LETTER) | (of == DIGIT) | (of == SIGN)
    cut, size, value, capitals, sentence, text, of = (x[token] for x in (cut, size, value, capitals, sentence, text, of))
    first = np.concatenate([[True], sentence[1:] != sentence[:-1]])[: len(cut)]
    after_number = np.concatenate([[False], of[:-1] == DIGIT])[: len(cut)] & ~first
    code = value.copy()
    title = (of == LETTER) & (size > 1) & (capitals == 1) & upper[codes[cut]]
    if (after := np.nonzero(after_number)[0]).size:
        code[after[np.isin(value[after], _unit_values())]] = UNIT
    code[of == SIGN], code[of == DIGIT] = UNIT, NUMBER
    named = np.where(title & (code != UNIT), NAME, code)
    nameless, code = code, np.where(first, code, named)
    first_of = np.cumsum([1] + [len(t) + 1 for t in texts])
    return Tokens(text, code, value, cut - first_of[text], size, of == DIGIT, named, nameless)


@lru_cache(1)
def _unit_values() -> np.ndarray:
    return canonical(UNITS).value


def windows(code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of literal tokens of every window of n tokens."""
    size = max(0, len(code) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * _MIX + code[k : k + size]
        out ^= out >> np.uint64(29)
    slots = np.concatenate([[0], np.cumsum(code <= NAME)])
    return out, n - (slots[n:] - slots[:-n])[:size]


class Block:
    """The templates of some benchmark items, and their windows by hash."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.items = []
        entries = defaultdict(list)
        for item_id, text in items:
            _, code, value, _, _, _, named, nameless = canonical([text])
            if not len(code):
                continue
            n = min(window, len(code))
            own = {(int(h), k) for k, h in enumerate(windows(value, n)[0])}
            if len(code) >= LEAST_TOKENS:
                for reading in (code, nameless, named):
                    hashes, literal = windows(reading, n)
                    #: An item of one window stands for itself, unless its first word is taken for a name; else a template's window needs enough words of its own.
                    alone = len(code) == n and reading is not named
                    own |= {(int(hashes[k]), k) for k in np.nonzero((literal >= LITERAL * n) | alone)[0].tolist()}
            entries[n] += [(h, len(self.items), k) for h, k in own]
            self.items.append((item_id, value.tolist(), n))
        self.by_size = {}
        for n, rows in entries.items():
            rows.sort()
            hashes = np.array([r[0] for r in rows], np.uint64)
            #: Most windows end at a look into this table by leading bits.
            seen = np.zeros(1 << LEADING, bool)
            seen[hashes >> LOOK] = True
            self.by_size[n] = (seen, hashes, np.array([r[1:] for r in rows], np.int64))

    def matches(self, texts: list[str | None]) -> list[list[tuple[int, int, int, bool]]]:
        """For each text, for every item that it holds: (item id, its tokens, those of them that are covered, whether values differ)."""
        out: list[list[tuple[int, int, int, bool]]] = [[] for _ in texts]
        held: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if text:
                held.append(i)
                size += len(text)
            if held and (size >= ROUND or i == len(texts) - 1):
                for at, found in self._matches([texts[k] for k in held]).items():
                    out[held[at]] = found
                held, size = [], 0
        if held:
            for at, found in self._matches([texts[k] for k in held]).items():
                out[held[at]] = found
        return out

    def _matches(self, texts: list[str]) -> dict[int, list[tuple[int, int, int, bool]]]:
        owner, code, value, _, _, _, named, nameless = canonical(texts)
        found: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        verbatim: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for n, (seen, hashes, places) in self.by_size.items():
            readings = [windows(value, n)[0]]
            for reading in (nameless, code, named) if n >= LEAST_TOKENS else ():
                readings.append(windows(reading, n)[0])
            plain = readings[0]
            for r, own in enumerate(readings):
                which = seen[own >> LOOK]
                for before in readings[:r]:
                    which &= own != before
                hit = np.nonzero(which)[0]
                hit = hit[owner[hit] == owner[hit + n - 1]]
                left, right = (np.searchsorted(hashes, own[hit], side).tolist() for side in ("left", "right"))
                for d, text, a, b in zip(hit.tolist(), owner[hit].tolist(), left, right):
                    for item, k in places[a:b].tolist():
                        found[text, item].append((d - k, k))
                        if own is plain:
                            verbatim[text, item].append((d - k, k))
        out = defaultdict(list)
        for (text, item), hits in sorted(found.items()):
            item_id, wanted, n = self.items[item]
            if min(len({k for _, k in hits}) * n, len(wanted)) < min(COVERAGE * len(wanted), RUN):
                continue
            #: Placeholders that also fit elsewhere can't spoil a verbatim copy, as it is judged by itself.
            covered, changed = max((_consistent(h, n, wanted, value) for h in (verbatim[text, item], hits)), key=lambda x: len(x[0]))
            if covered:
                out[text].append((item_id, len(wanted), len(covered), changed))
        return out


def _longest_run(places: set[int]) -> int:
    """The most consecutive numbers in places."""
    best = run = 0
    before = None
    for j in sorted(places):
        run = run + 1 if j - 1 == before else 1
        best, before = max(best, run), j
    return best


def _consistent(hits: list[tuple[int, int]], n: int, wanted: list[int], values: np.ndarray) -> tuple[set[int], bool]:
    """Tokens of the item that windows (offset, place) cover whose values map one to one; and whether any differs.

    Offsets within half an item's length of the one before are one copy of it,
    with words put in or left out. In each copy a value stands for the one that it
    is paired with most often, the least on a tie; windows in which another pair
    occurs don't count. Of the copies that hold the item, the one with the most
    covered tokens is returned; no tokens if none does.
    """
    best: tuple[set[int], bool] = (set(), False)
    by_offset = defaultdict(list)
    for offset, k in hits:
        by_offset[offset].append(k)
    copies: list[list[int]] = []
    for offset in sorted(by_offset):
        if copies and offset - copies[-1][-1] <= len(wanted) // 2:
            copies[-1].append(offset)
        else:
            copies.append([offset])
    for offsets in copies:
        places = {(o + k + i, k + i) for o in offsets for k in by_offset[o] for i in range(n)}
        pairs = Counter((wanted[j], int(values[d])) for d, j in places)
        there: dict[int, int] = {}
        back: dict[int, int] = {}
        for (a, b), _ in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
            if a not in there and b not in back:
                there[a], back[b] = b, a
        covered = {k + i for o in offsets for k in by_offset[o] if all(there.get(wanted[k + i]) == values[o + k + i] for i in range(n)) for i in range(n)}
        same = {j for j in covered if there[wanted[j]] == wanted[j]}
        held = len(covered) >= COVERAGE * len(wanted) or _longest_run(same) >= RUN or _longest_run(covered) >= REWORDED_RUN
        if held and len(covered) > len(best[0]):
            best = covered, any(there[wanted[j]] != wanted[j] for j in covered)
    return best


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Items with a text, block by block; the number of blocks comes from the size of the benchmark, and the driver holds one at a time."""
    items = benchmark.filter("item_id is not null and text is not null").select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // block_bytes))
    part = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for k in range(n):
        yield sorted((r.item_id, r.text) for r in part.filter(F.col("part") == k).collect())


def _over(docs: DataFrame, items: list[tuple[int, str]], rows: Callable, schema) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value)
        for batch in batches:
            yield rows(block, batch)

    return in_arrow(docs, scan, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, tokens, covered, coverage, reworded) for each document and item it holds.

    Only documents that hold an item have rows. Null and empty texts hold none;
    items without id or text, or without a letter or digit, are not looked for, and
    those of under five tokens only word for word; equal items are reported each; a
    repeated document has rows for each of its rows.
    """
    kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {kind}, item_id {item_kind}, tokens long, covered long, coverage double, reworded boolean"

    def rows(block: Block, batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(i, m) for i, found_in in enumerate(block.matches(batch.column(1).to_pylist())) for m in sorted(found_in)]
        ids = batch.column(0).take(pa.array([i for i, _ in found], pa.int64()))
        columns = list(zip(*(m for _, m in found))) or [()] * 4
        share = [c / n for n, c in zip(columns[1], columns[2])]
        kinds = (pa.int32() if item_kind == "int" else pa.string() if item_kind == "string" else pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
        return pa.RecordBatch.from_arrays(
            [ids, *(pa.array(list(x), k) for x, k in zip((*columns[:3], share, columns[3]), kinds))],
            ["doc_id", "item_id", "tokens", "covered", "coverage", "reworded"],
        )

    parts = [_over(docs.select("doc_id", "text"), items, rows, schema) for items in _blocks(benchmark, block_bytes)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def too_short(benchmark: DataFrame) -> DataFrame:
    """Items that `contaminated` looks for only word for word, or not at all, for want of tokens."""
    words = F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+"))
    return benchmark.filter(F.col("text").isNull() | (words < LEAST_TOKENS))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that hold no benchmark item, with their columns unchanged."""
    at = docs.columns.index("text")

    def rows(block: Block, batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([not found for found in block.matches(batch.column(at).to_pylist())], pa.bool_()))

    for items in _blocks(benchmark, block_bytes):
        docs = _over(docs, items, rows, docs.schema)
    return docs
