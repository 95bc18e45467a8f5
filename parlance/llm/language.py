"""Language identification by cross-parsing entropy.

The labelled text of each language becomes a suffix automaton. A text is parsed
against it into phrases, each the longest match from where the last one ended. A
phrase grows with the logarithm of the text that was learned, so phrases are
counted in units of it, and the language that needs the fewest per symbol wins.

Cross-parsing is a walk over the automaton that starts a new phrase at its root
where no transition fits, so the automaton is kept as a dense table with those
restarts filled in, and many blocks of many texts are walked in step by numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow

#: The bounds of the training sample: texts of a language, and symbols that are learned of it. Texts of up to SAMPLE_LENGTH characters come first.
SAMPLE_TEXTS, SAMPLE_SYMBOLS, SAMPLE_LENGTH = 100, 40_000, 2_000
#: Symbols of all languages together; with many languages each gets its share.
ALL_SYMBOLS = 640_000
#: A text is parsed in blocks of so many symbols; a phrase ends with its block.
BLOCK = 512
#: Symbols that are walked at once.
ROUND = 1 << 21
UNKNOWN = "und"
SPACE, OTHER = 0, 1
LETTER = 1


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point 1 for a letter, 2 for a mark, 0 for others."""
    import unicodedata

    return np.fromiter(("LM".find(unicodedata.category(chr(c))[0]) + 1 for c in range(0x110000)), np.uint8, 0x110000)


def spelled(text: str) -> np.ndarray:
    """Lower-cased code points, with each run of anything but letters and their marks as one 0; empty without letters."""
    codes = _codes(text)
    kinds = _letters()[codes]
    if not (kinds == LETTER).any():
        return codes[:0]
    codes = np.where(kinds > 0, codes, 0)
    keep = (codes != 0) | (np.concatenate([[0], codes[:-1]]) != 0)
    return codes[keep]


class Automaton:
    """The suffix automaton of symbols below width, as a table of restarting transitions."""

    def __init__(self, symbols: list[int], width: int):
        length, link, steps = [0], [-1], [{}]
        last = 0
        for c in symbols:
            state = len(length)
            length.append(length[last] + 1)
            link.append(0)
            steps.append({})
            p = last
            while p != -1 and c not in steps[p]:
                steps[p][c] = state
                p = link[p]
            if p != -1:
                q = steps[p][c]
                if length[p] + 1 != length[q]:
                    copy = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    steps.append(dict(steps[q]))
                    while p != -1 and steps[p].get(c) == q:
                        steps[p][c] = copy
                        p = link[p]
                    link[q] = copy
                    q = copy
                link[state] = q
            last = state
        #: table[state * width + symbol] = 2 * (next state * width) + (1 if a new phrase starts with the symbol)
        states = np.repeat(np.arange(len(steps)), [len(x) for x in steps])
        symbol = np.fromiter((c for x in steps for c in x), np.int64, len(states))
        target = np.fromiter((t for x in steps for t in x.values()), np.int64, len(states))
        first = np.ones(width, np.int64)
        for c, t in steps[0].items():
            first[c] += 2 * t * width
        table = np.tile(first, len(steps))
        #: From the root a symbol always starts a phrase.
        inside = states > 0
        table[states[inside] * width + symbol[inside]] = 2 * target[inside] * width
        self.table = table.astype(np.int64 if table.max() >= 2**31 else np.int32)


class Model:
    """Automata of several languages over one alphabet."""

    def __init__(self, samples: tuple[tuple[str, tuple[str, ...]], ...]):
        self.languages = [lang for lang, _ in samples]
        parts = [[spelled(x) for x in texts] for _, texts in samples]
        known = np.unique(np.concatenate([np.zeros(1, np.uint32), *(x for p in parts for x in p)]))
        self.index = np.full(0x110000, OTHER, np.int32)
        self.index[known[known != 0]] = np.arange(2, 2 + np.count_nonzero(known))
        self.index[0] = SPACE
        width = int(self.index.max()) + 1
        most = min(SAMPLE_SYMBOLS, ALL_SYMBOLS // max(1, len(samples)))
        self.tables, self.units = [], []
        for own in parts:
            symbols = self._learned([self.index[x] for x in own], most)
            self.tables.append(Automaton(symbols.tolist(), width).table)
            #: What a phrase counts: the logarithm of the symbols it was looked for in.
            self.units.append(np.log2(len(symbols) + 2))

    @staticmethod
    def _learned(texts: list[np.ndarray], most: int) -> np.ndarray:
        """Whole texts, in order, as long as they fit; of a language that has only longer ones, what fits of the first."""
        held, size = [np.zeros(1, np.int32)], 1
        for x in texts:
            if size + len(x) <= most:
                held.append(x)
                size += len(x)
        return np.concatenate(held) if len(held) > 1 or not texts else np.concatenate([held[0], texts[0][: most - 1]])

    def costs(self, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Normalised phrases per symbol, by text and language; 0 for texts without symbols."""
        return counts * np.array(self.units)[None, :] / np.maximum(sizes, 1)[:, None]

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases needed, by text and language, and symbols of each text."""
        counts, sizes = np.zeros((len(texts), len(self.tables)), np.int64), np.zeros(len(texts), np.int64)
        held, owners, total = [], [], 0
        for i, text in enumerate(texts):
            symbols = self.index[spelled(text)] if text else ()
            sizes[i] = len(symbols)
            for k in range(0, len(symbols), BLOCK):
                held.append(symbols[k : k + BLOCK])
                owners.append(i)
                total += len(held[-1])
            if total >= ROUND:
                self._walk(held, owners, counts)
                held, owners, total = [], [], 0
        self._walk(held, owners, counts)
        return counts, sizes

    def _walk(self, blocks: list[np.ndarray], owners: list[int], counts: np.ndarray) -> None:
        for k in range(0, len(blocks), ROUND // BLOCK):
            part, own = blocks[k : k + ROUND // BLOCK], np.array(owners[k : k + ROUND // BLOCK])
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            order = np.argsort(-sizes, kind="stable")
            at = np.concatenate([part[i] for i in order])
            sizes, own = sizes[order], own[order]
            starts = np.cumsum(sizes) - sizes
            active = len(part) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
            for lang, table in enumerate(self.tables):
                state, found = np.zeros(len(part), table.dtype), np.zeros(len(part), np.int64)
                for step, n in enumerate(active.tolist()):
                    value = table[state[:n] + at[starts[:n] + step]]
                    found[:n] += value & 1
                    state[:n] = value >> 1
                np.add.at(counts[:, lang], own, found)


@lru_cache(1)
def model(samples: tuple[tuple[str, tuple[str, ...]], ...]) -> Model:
    """Built once in each worker process."""
    return Model(samples)


def sample(docs: DataFrame, usable: Column, texts: int = SAMPLE_TEXTS, length: int = SAMPLE_LENGTH) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """A bounded training sample of whole texts, the same on every run: (language, texts) by language.

    Of each language `texts` different texts with the least hash, among documents
    that are usable and have a label and letters; those of up to length characters
    come first, then those of up to twice that, and so on. Different texts are
    counted first, by sketches of a fixed size; a share of hashes that holds twice
    the wanted number is read then, so neither a frequent language nor a text with
    many copies fills a task. Null texts and labels are passed over; an empty table
    gives no languages.
    """
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text")
    rows = rows.select("lang", "text", F.xxhash64("text").alias("hash"), F.ceil(F.log2(F.greatest(F.length("text") / length, F.lit(1.0)))).cast("int").alias("rank"))
    wanted: dict[str, int] = {}
    shares = []
    for r in sorted(rows.groupBy("lang", "rank").agg(F.approx_count_distinct("hash").alias("n")).collect()):
        left = wanted.get(r.lang, texts)
        wanted[r.lang] = left - r.n
        if left > 0:
            shares.append((r.lang, r["rank"], min(1.0, 2.0 * max(left, texts // 4) / max(1, r.n))))
    if not shares:
        return ()
    shares = docs.sparkSession.createDataFrame(shares, "lang string, rank int, share double")
    place = F.shiftrightunsigned("hash", 11) / float(1 << 53)
    chosen = rows.withColumn("lang", F.col("lang").cast("string")).join(F.broadcast(shares), ["lang", "rank"]).filter(place < F.col("share"))
    found: dict[str, list[tuple[int, int, str]]] = {}
    for r in chosen.groupBy("lang", "rank", "hash").agg(F.min("text").alias("text")).collect():
        found.setdefault(r.lang, []).append((r["rank"], r.hash % (1 << 64), r.text))
    return tuple((lang, tuple(x for *_, x in sorted(found[lang])[:texts])) for lang in sorted(found))


def identify(docs: DataFrame, samples: tuple[tuple[str, tuple[str, ...]], ...]) -> DataFrame:
    """Adds lang_pred (string), score (double) and phrase_rate (double) to docs by its column text.

    lang_pred is the language with the fewest normalised phrases, the first by name
    on a tie. score is 1 - (its phrases) / (those of the runner-up); with one
    language 1. phrase_rate is normalised phrases per symbol of the winner, in
    bits. Marks without a letter are no letters. Null texts and
    texts without letters, or no samples at all: 'und', 0.0 and null. Columns of
    docs with one of the three names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "phrase_rate")]
    docs = docs.select(*kept)
    at = kept.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sizes = model(samples).phrases(batch.column(at).to_pylist()) if samples else (None, None)
            costs = model(samples).costs(counts, sizes) if samples else None
            lang, score, rate = [], [], []
            for i in range(batch.num_rows):
                if sizes is None or not sizes[i]:
                    lang.append(UNKNOWN), score.append(0.0), rate.append(None)
                    continue
                order = np.argsort(costs[i], kind="stable")
                best, second = costs[i][order[0]], costs[i][order[min(1, len(order) - 1)]]
                lang.append(model(samples).languages[order[0]])
                score.append(1.0 - best / second if len(order) > 1 else 1.0)
                rate.append(best)
            arrays = [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "lang_pred", "score", "phrase_rate"])

    added = T.StructType().add("lang_pred", "string").add("score", "double").add("phrase_rate", "double")
    schema = T.StructType([*docs.schema.fields, *added.fields])
    return in_arrow(docs, predict, schema)


#: Of the held-back texts' costs, the share that lies under the fit; what chance adds to the cost of a text of one symbol.
FIT_SHARE, CHANCE = 0.95, 6.0
#: Every so-many-th text of the sample is held back to find the bound.
HELD_BACK = 4


def cost_bound(samples, seed: int = 5) -> float:
    """Normalised phrases per symbol midway between labelled text that wasn't learned and the same text with its letters shuffled.

    Infinite where a language has too few texts to hold one back.
    """
    rest = tuple((lang, tuple(t for k, t in enumerate(texts) if k % HELD_BACK or len(texts) < HELD_BACK)) for lang, texts in samples)
    held = [t for _, texts in samples if len(texts) >= HELD_BACK for t in texts[::HELD_BACK]]
    if not held:
        return float("inf")
    draw = np.random.default_rng(seed)
    shuffled = ["".join(draw.permutation(list(t))) for t in held]
    fitted = Model(rest)
    own, random = ((fitted.costs(*found).min(axis=1), found[1]) for found in (fitted.phrases(held), fitted.phrases(shuffled)))
    #: What short texts add by chance is taken off before the two are compared.
    natural = np.quantile(own[0] - CHANCE / np.sqrt(np.maximum(own[1], 1)), FIT_SHARE)
    return float(max(natural, (natural + np.median(random[0])) / 2))


def keep_identified(docs: DataFrame, samples, bound: float | None = None) -> DataFrame:
    """The rows of docs that have a language, unchanged: not 'und', and of a cost under the bound.

    bound: normalised phrases per symbol, cost_bound of the samples by default. A text of n
    symbols may have CHANCE / sqrt(n) more, as chance weighs more the shorter it
    is; very short ones therefore stay if they have a letter. Null and empty texts
    go. Extra columns stay, whatever their names.
    """
    bound = cost_bound(samples) if bound is None else bound
    kept, at, sampled = docs.columns, docs.columns.index("text"), tuple(samples)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sizes = model(sampled).phrases(batch.column(at).to_pylist())
            costs = model(sampled).costs(counts, sizes).min(axis=1)
            stays = (sizes > 0) & (costs <= bound + CHANCE / np.sqrt(np.maximum(sizes, 1)))
            yield batch.filter(pa.array(stays)).select(kept)

    return in_arrow(docs, judge, docs.schema) if sampled else docs.limit(0)
