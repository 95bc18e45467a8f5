"""License scans by patience alignment.

A license is found where a short span of a text covers enough of its words when
both are aligned: words unique to both sides anchor the alignment, the longest
increasing subsequence of the anchors is kept, and the gaps between them are
aligned in the same way.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import in_arrow
from .decontamination import ROUND, canonical
from .license_texts import COMMON, GENERIC, TEMPLATES, notices

#: Share of a template's words that must be covered; a span may be longer than the template by a half, or four words, that of a notice by one.
COVERAGE, NOTICE_GAP = 0.8, 1


def longest_increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs (i, j) with a[i] == b[j], increasing in both, by patience alignment."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        counts = Counter(a[i:i_end]), Counter(b[j:j_end])
        place = {b[k]: k for k in range(j, j_end) if counts[1][b[k]] == 1}
        anchors = [(k, place[a[k]]) for k in range(i, i_end) if counts[0][a[k]] == 1 and a[k] in place]
        anchors = [anchors[k] for k in longest_increasing([y for _, y in anchors])]
        if not anchors:
            continue
        out += anchors
        for (x, y), (x_end, y_end) in zip([(i - 1, j - 1), *anchors], [*anchors, (i_end, j_end)]):
            todo.append((x + 1, x_end, y + 1, y_end))
    return sorted(out)


class Scanner:
    """Templates as word hashes."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE, notices: dict[str, list[tuple[str, str]]] | None = None):
        self.common = set(canonical(list(COMMON)).value.tolist())
        self.generic = set(canonical(list(GENERIC)).value.tolist())
        self.templates, self.telling = [], {}
        for name, text in templates.items():
            words = canonical([text])
            values = words.value.tolist()
            numbers = {v for v, digit in zip(values, words.is_number.tolist()) if digit}
            self._add(name, values, numbers, coverage, max(4, len(values) // 2))
        for name, forms in (notices or {}).items():
            for text, called in forms:
                own = set(canonical([called]).value.tolist())
                self._add(name, canonical([text]).value.tolist(), (own - self.generic) or own, coverage, NOTICE_GAP)
        self.hashes = np.array(sorted(self.telling), np.uint64)

    def _add(self, name: str, values: list[int], needed: set[int], coverage: float, gap: int) -> None:
        """A template by its words, those of them that must be covered whatever the share, and the words by which a span may be longer."""
        telling = {k for k, v in enumerate(values) if v not in self.common}
        if not telling:
            raise ValueError(f"{name} has no word of its own")
        allowed = int((1 - coverage) * len(values) + 1e-9)
        lead = {values[k]: k for k in sorted(telling)}
        at = len(self.templates)
        self.templates.append((name, values, needed, lead, max(1, len(telling) - allowed), allowed, len(values) + gap))
        for v in lead:
            self.telling.setdefault(v, set()).add(at)

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, int, int, int, int]]]:
        """For each text its licenses: (template, its words, words covered, first character, character after the last)."""
        out: list[list] = [[] for _ in texts]
        held, size = [], 0
        for i, text in enumerate(texts):
            if text:
                held.append(i)
                size += len(text)
            if held and (size >= ROUND or i + 1 == len(texts)):
                self._scan(held, [texts[k] for k in held], out)
                held, size = [], 0
        return out

    def _scan(self, owners: list[int], texts: list[str], out: list[list]) -> None:
        if not len(self.hashes):
            return
        words = canonical(texts)
        near = np.searchsorted(self.hashes, words.value)
        hits = np.nonzero(self.hashes[np.minimum(near, len(self.hashes) - 1)] == words.value)[0]
        starts = np.searchsorted(words.text, np.arange(len(texts) + 1)).tolist()
        for at in np.unique(words.text[hits]).tolist():
            a, b = starts[at], starts[at + 1]
            own = hits[np.searchsorted(hits, a) : np.searchsorted(hits, b)] - a
            values = words.value[a:b]
            by_template: dict[int, list[int]] = {}
            for k in own.tolist():
                for t in self.telling[int(values[k])]:
                    by_template.setdefault(t, []).append(k)
            found = [x for t, places in by_template.items() for x in self._spans(t, places, values)]
            # Of overlapping spans the one that covers the most words stands.
            found.sort(key=lambda x: (-x[2], x[1], x[3], x[0]))
            taken: list[tuple[int, int]] = []
            for name, n, covered, first, last in found:
                if all(last < x or first > y for x, y in taken):
                    taken.append((first, last))
                    end = int(words.start[a + last] + words.size[a + last])
                    out[owners[at]].append((name, n, covered, int(words.start[a + first]), end))
            out[owners[at]].sort(key=lambda x: (x[3], x[0]))

    def _spans(self, t: int, places: list[int], values: np.ndarray) -> Iterator[tuple[str, int, int, int, int]]:
        name, wanted, needed, lead, need, allowed, span = self.templates[t]
        #: Without these words nothing needs an alignment.
        if not (needed - self.common) <= {int(values[k]) for k in places}:
            return
        after, k = 0, 0
        while k + need <= len(places):
            first = places[k]
            if first < after or places[k + need - 1] - first >= span:
                k += 1
                continue
            start = first - lead[int(values[first])]
            low, high = max(after, start - allowed), min(len(values), start + span)
            pairs = patience(wanted, values[low:high].tolist())
            if pairs and len(pairs) + allowed >= len(wanted):
                # The first word may have been another's: align again from where the template would start.
                at = max(after, low + pairs[0][1] - pairs[0][0] - allowed)
                again = patience(wanted, values[at : at + span + allowed].tolist())
                if len(again) > len(pairs):
                    low, pairs = at, again
            if len(pairs) + allowed >= len(wanted) and needed <= {wanted[i] for i, _ in pairs} and pairs[-1][1] - pairs[0][1] < len(pairs) + span - len(wanted):
                last = low + pairs[-1][1]
                yield name, len(wanted), len(pairs), low + pairs[0][1], last
                after = last + 1
            k += 1


@lru_cache(4)
def _scanner(templates: tuple[tuple[str, str], ...] | None) -> Scanner:
    return Scanner(TEMPLATES, notices=notices()) if templates is None else Scanner(dict(templates))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, form, words, covered, coverage, start, end) for every license span of every document.

    start and end are character positions in the text. Only documents with a
    license have rows; one that holds several, or one several times, has a row for
    each, and of overlapping spans the one that covers most words. The numbers of a
    template, such as its version, must be covered, and the telling words of a name
    in a notice. templates: texts by identifier/form; by default the built-in texts
    and notices, and no templates find nothing. Null and empty texts have none;
    a repeated document has rows for each of its rows. Other columns are left out.
    """
    fixed = None if templates is None else tuple(templates.items())
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("license", T.StringType()), T.StructField("form", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in ("words", "covered")]
        + [T.StructField("coverage", T.DoubleType())]
        + [T.StructField(c, T.LongType()) for c in ("start", "end")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *m) for i, own in enumerate(_scanner(fixed).scan(batch.column(1).to_pylist())) for m in own]
            columns = list(zip(*found)) or [()] * 6
            names = [name.partition("/") for name in columns[1]]
            long = lambda x: pa.array(list(x), pa.int64())
            share = [c / n for n, c in zip(columns[2], columns[3])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(long(columns[0])), pa.array([n[0] for n in names], pa.string()), pa.array([n[2] for n in names], pa.string())]
                + [long(columns[2]), long(columns[3]), pa.array(share, pa.float64()), long(columns[4]), long(columns[5])],
                schema.names,
            )

    return in_arrow(docs.select("doc_id", "text"), run, schema)
