"""Token counts of sections by offset-mapped attribution (operator 7).

A document is encoded once as a whole; the byte spans of its tokens are joined to the
spans of its sections. A token that crosses boundaries goes by an explicit rule:
"largest" (the section it shares most bytes with, ties to the earlier), "first" or "last"
(the section of its first or last byte within any section). So each token counts once.

Defined results: sections are the document's lines, each with its line end, unless a table
of sections (doc_id, name, start, end in characters) is given; of sections that overlap,
the later one starts where the earlier ends. Tokens in no section form a row with a null
section. A null or empty text has no line and no row. Rows that repeat a doc_id are
counted each. Null, empty or reversed spans are ignored. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import id_and_text, slices
from edgeloom.llm.tokens import default_tokenizer, encoder

SCHEMA = "doc_id bigint, section int, name string, start_char bigint, end_char bigint, n_tokens bigint, n_crossing bigint"
KINDS = pa.schema([
    ("doc_id", pa.int64()), ("section", pa.int32()), ("name", pa.string()), ("start_char", pa.int64()),
    ("end_char", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])


def attribute(ends: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str = "largest") -> tuple[np.ndarray, np.ndarray]:
    """For tokens that end at `ends` (each begins where the one before ends): its section, -1 for none, and whether it crosses.

    Sections [start, stop) are sorted and don't overlap.
    """
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    low = np.searchsorted(stops, begins, side="right")
    high = np.searchsorted(starts, ends, side="left") - 1
    out = np.where(high < low, -1, low if rule != "last" else high)
    # Outside of any section for a part is crossing, too.
    inside = (high == low) & (low < len(starts))
    at = np.minimum(low, max(0, len(starts) - 1))
    crossing = (out >= 0) & ~(inside & (starts[at] <= begins) & (ends <= stops[at])) if len(starts) else np.zeros(len(ends), bool)
    if rule == "largest":
        for i in np.flatnonzero(high > low):
            span = np.arange(low[i], high[i] + 1)
            shared = np.minimum(ends[i], stops[span]) - np.maximum(begins[i], starts[span])
            out[i] = span[int(shared.argmax())]
    return out, crossing


def line_spans(text: str) -> list[tuple[str | None, int, int]]:
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        out.append((None, at, end))
        at = end
    return out


def given_spans(rows: list[dict] | None, length: int) -> list[tuple[str | None, int, int]]:
    """Spans in order, cut at the text's end and at the span before."""
    out, reached = [], 0
    for r in sorted(rows or [], key=lambda r: (r["start"], r["end"], r["name"] or "")):
        start, end = max(r["start"], reached), min(r["end"], length)
        if start < end:
            out.append((r["name"], start, end))
            reached = end
    return out


def count_tokens(docs: DataFrame, sections: DataFrame | None = None, tokenizer: str | None = None, rule: str = "largest") -> DataFrame:
    """doc_id, section (from 0), name, start_char, end_char, n_tokens, n_crossing."""
    if rule not in ("largest", "first", "last"):
        raise ValueError(f"no such rule: {rule}")
    tokenizer = tokenizer or default_tokenizer()
    texts = id_and_text(docs)
    if sections is not None:
        spans = sections.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.struct(
            F.col("name").cast("string").alias("name"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")).alias("s"))
        # As many as the document itself has sections.
        spans = spans.where("s.start < s.end").groupBy("doc_id").agg(F.collect_list("s").alias("spans"))
        texts = texts.join(spans, "doc_id", "left")
    given = sections is not None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            spans = batch.column("spans").to_pylist() if given else [None] * len(texts)
            for a, b in slices(texts):
                parts: list[list] = [[] for _ in KINDS]
                for doc, text, own, ids in zip(names[a:b], texts[a:b], spans[a:b], tool.encode(texts[a:b]), strict=True):
                    found = given_spans(own, len(text)) if given else line_spans(text)
                    starts, stops = (np.array([s[k] for s in found], np.int64) for k in (1, 2))
                    bytes_at = _byte_offsets(text)
                    at, crossing = attribute(np.cumsum(tool.widths[ids]), bytes_at[starts], bytes_at[stops], rule)
                    n = np.bincount(at + 1, minlength=len(found) + 1)
                    c = np.bincount(at + 1, weights=crossing, minlength=len(found) + 1).astype(np.int64)
                    if n[0]:
                        for column, x in zip(parts, (doc, None, None, None, None, int(n[0]), 0), strict=True):
                            column.append(x)
                    for column, x in zip(parts, ([doc] * len(found), range(len(found)), [s[0] for s in found], starts.tolist(), stops.tolist(), n[1:].tolist(), c[1:].tolist()), strict=True):
                        column.extend(x)
                yield pa.RecordBatch.from_arrays([pa.array(p, f.type) for p, f in zip(parts, KINDS, strict=True)], schema=KINDS)

    return texts.mapInArrow(each, SCHEMA)


def _byte_offsets(text: str) -> np.ndarray:
    """Where each character begins in UTF-8, and the end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))]).astype(np.int64)
