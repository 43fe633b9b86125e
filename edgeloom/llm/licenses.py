"""License scans: winnowed fingerprints find candidates, banded alignment measures them (operator 9).

The templates' word n-grams are winnowed into an inverted index. A document's winnowed
fingerprints that the index holds vote for a template and a diagonal; candidates within a
band of diagonals are aligned with the template inside that band, then what lies before and
behind the match again until nothing is left, so notices in a row are all found. A segment
that is too short is aligned again in a band wider by GAP words, which chains what follows. Matches that cover
enough of the template are reported with their spans. Any run of n + window - 1 words
shared with a template is a candidate. The index has the templates' size, whatever the data.

Defined results: null and empty texts, and texts without a match, have no row. Rows that
repeat a doc_id are scanned each. Matches of one template in one document don't overlap;
of those that do, the one with most matched words stays, ties to the earlier. Matches of
different templates may overlap, but one that lies within a longer match of another is
part of it and goes. A null doc_id is kept as such. An empty table gives no row. Other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from edgeloom.llm.common import id_and_text
from edgeloom.llm.license_texts import TEMPLATES

WORD = re.compile(r"[^\W_]+")
NGRAM = 3
WINDOW = 2
BAND = 8
COVERAGE = 0.8
#: Foreign words in a row that a match may hold.
GAP = 50
NONE = np.iinfo(np.uint64).max
SCHEMA = "doc_id bigint, license string, start_char bigint, end_char bigint, start_word int, end_word int, matched_words int, template_words int, coverage double"


def winnow(words: np.ndarray, ngram: int, window: int) -> list[tuple[int, int]]:
    """(hash, position): of each window of n-grams the smallest hash, the last of equals. n-grams with word 0 are left out."""
    n = len(words) - ngram + 1
    if n <= 0:
        return []
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(ngram):
        part = words[k : k + n]
        known &= part > 0
        h = (h + part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    if not known.any():
        return []
    h = np.where(known, h >> np.uint64(1), NONE)
    width = min(window, n)
    picked = set()
    for start in sorted({int(s) for p in np.flatnonzero(known) for s in range(max(0, p - width + 1), min(p, n - width) + 1)}):
        part = h[start : start + width]
        best = start + width - 1 - int(part[::-1].argmin())
        if h[best] != NONE:
            picked.add(best)
    return [(int(h[p]), p) for p in sorted(picked)]


@dataclass
class Index:
    names: list[str]
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    postings: dict[int, list[tuple[int, int]]] = field(default_factory=dict)


def build_index(templates: dict[str, str], ngram: int = NGRAM, window: int = WINDOW) -> Index:
    vocabulary: dict[str, int] = {}
    split = [WORD.findall(t.lower()) for t in templates.values()]
    for w in (w for words in split for w in words):
        vocabulary.setdefault(w, len(vocabulary) + 1)
    index = Index(list(templates), [np.array([vocabulary[w] for w in words], np.int64) for words in split], vocabulary)
    for t, words in enumerate(index.words):
        for h, p in winnow(words, ngram, window):
            index.postings.setdefault(h, []).append((t, p))
    return index


@dataclass(frozen=True)
class Segment:
    """Template words matched in order: how many, the span in the document."""

    matched: int
    start: int
    end: int


def align(template: np.ndarray, words: np.ndarray, low: int, high: int, begin: int = 0, stop: int | None = None) -> Segment | None:
    """Most words of the template matched in order within diagonals low to high (document minus template position).

    Only document words from `begin` to `stop` count. Of equal matches the shortest span, then the earliest.
    """
    stop = len(words) if stop is None else stop
    # A state: (matched, start, end); the row of the template position before.
    nothing = (0, 0, 0)
    before: dict[int, tuple] = {}
    for i, w in enumerate(template.tolist()):
        row: dict[int, tuple] = {}
        best = nothing
        for j in range(max(begin, i + low), min(stop, i + high + 1)):
            up = before.get(j, nothing)
            best = max(best, up, key=_rank)
            if words[j] == w:
                corner = before.get(j - 1, nothing)
                best = max(best, (corner[0] + 1, corner[1] if corner[0] else j, j + 1), key=_rank)
            row[j] = best
        before = row or before
    best = max(before.values(), key=_rank, default=nothing)
    return Segment(*best) if best[0] else None


def _rank(state: tuple) -> tuple[int, int, int]:
    return state[0], state[1] - state[2], -state[1]


def segments(template: np.ndarray, words: np.ndarray, diagonals: set[int], band: int, gap: int, need: float, least: int) -> set[Segment]:
    """Matches of at least `need` words, found in bands of diagonals: in each the best, then the best before and behind it.

    A segment of at least `least` words that is too short is aligned again in a band that is
    wider by the gap, so what follows it behind foreign words is chained with it.
    """
    found: set[Segment] = set()
    reached = None
    known = np.concatenate([[0], np.cumsum(np.isin(words, template))])
    for d in sorted(diagonals):
        if reached is not None and d <= reached:
            continue  # the band of the candidate before holds this diagonal
        reached = d + band
        open_spans = [(max(0, d - band), min(len(words), d + len(template) + 2 * band))]
        while open_spans:
            begin, stop = open_spans.pop()
            far = min(len(words), stop + gap)
            if known[far] - known[begin] < need:
                continue
            best = align(template, words, d - band, d + 2 * band, begin, stop) if known[stop] - known[begin] >= least else None
            if best is not None and least <= best.matched < need:
                best = align(template, words, d - band, d + 2 * band + gap, begin, far)
            if best is not None and best.matched >= need:
                found.add(best)
                open_spans += [(begin, min(best.start, stop)), (best.end, max(best.end, stop))]
    return found


def scan_text(text: str, index: Index, ngram: int = NGRAM, window: int = WINDOW, band: int = BAND, coverage: float = COVERAGE, gap: int = GAP) -> list[tuple]:
    """(license, start_char, end_char, start_word, end_word, matched_words, template_words, coverage) of a text."""
    found = WORD.findall(text.lower())
    of = index.vocabulary.get
    words = np.array([of(w, 0) for w in found], np.int64)
    votes: dict[int, set[int]] = {}
    for h, p in winnow(words, ngram, window):
        for t, q in index.postings.get(h, ()):
            votes.setdefault(t, set()).add(p - q)
    out: list[tuple] = []
    for t, diagonals in votes.items():
        template = index.words[t]
        need = coverage * len(template)
        matches = segments(template, words, diagonals, band, gap, need, min(ngram + window - 1, len(template)))
        taken: list[Segment] = []
        for m in sorted(matches, key=lambda m: (-m.matched, m.end - m.start, m.start)):
            if all(m.end <= x.start or x.end <= m.start for x in taken):
                taken.append(m)
        out += [(index.names[t], m.start, m.end, m.matched, len(template)) for m in taken]
    out = _longest(out)
    if not out:
        return []
    spans = [m.span() for m in WORD.finditer(text)]
    # Lower-casing may change the number of words in rare scripts; characters then follow the lower-cased text.
    if len(spans) != len(found):
        spans = [m.span() for m in WORD.finditer(text.lower())]
    return sorted((name, spans[a][0], spans[b - 1][1], a, b, m, n, m / n) for name, a, b, m, n in out)


def _longest(found: list[tuple]) -> list[tuple]:
    """Without what lies within a match of another template that has more words, or as many of a shorter template."""
    kept: list[tuple] = []
    reach: list[tuple] = []  # matches that may still hold others
    for x in sorted(found, key=lambda m: (m[1], -m[2], -m[3], m[4])):
        reach = [y for y in reach if y[2] > x[1]]
        if not any(y[0] != x[0] and y[1] <= x[1] and x[2] <= y[2] and (y[3], -y[4]) > (x[3], -x[4]) for y in reach):
            kept.append(x)
        reach.append(x)
    return kept


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """A row for each match: doc_id, license, spans in characters and words, matched words and coverage of the template."""
    templates = templates or TEMPLATES

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = build_index(templates)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        for batch in batches:
            rows = [(doc, *m) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for m in scan_text(text, index, coverage=coverage)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return id_and_text(docs).mapInArrow(each, SCHEMA)
