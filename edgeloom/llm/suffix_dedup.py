"""Removal of byte strings that occur twice, with a logarithmic family of suffix arrays (operator 1).

Work is placed by content. Of each window of `length` bytes the smallest hash of its short
grams is the anchor, so equal windows have equal anchors at equal places, wherever they
are. A run of windows with one anchor is a fragment; a window lies in exactly one.

* Fragments that occur twice as a whole need no further look.
* Distinct fragments with a common anchor meet in one index family: batches get suffix
  arrays (their windows in the order of their bytes), which are merge-scanned against the
  levels there are; levels of about equal size merge, so a family has few levels. An anchor
  with more than `FAMILY` distinct fragments would be too much for one task; there the
  windows themselves are counted by their 128-bit hash.
* The windows found twice are brought back to all places of their fragments, and each text
  loses the bytes they cover.

Texts that are copies share one key and are processed once for a slice and place.

Defined results: a null text is empty; texts shorter than `length` lose nothing. Rows that
repeat a doc_id are documents of their own, so exact repeats lose all their windows. An
empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import few_rows, id_and_text, slices
from edgeloom.session import cut_lineage

LENGTH = 200
#: Bytes of a gram: two halves of the doubling below.
GRAM = 20
#: Distinct fragments of an anchor that one task takes, and windows of a batch.
FAMILY = 4_000
BATCH = 30_000
#: Bits of the place in an anchor's sort key; a slice has fewer bytes.
PLACE = 24
#: Window starts of a long text that are looked at together.
STRETCH = 4_000_000

# Odd multipliers of the rolling hash.
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of GRAM bytes."""
    h = (data.astype(np.uint64) + np.uint64(1)) * ODD[0]
    h ^= h >> np.uint64(31)
    four = None
    for k in range(4):  # runs of 2, 4, 8 and 16 bytes
        h = h[: len(h) - (1 << k)] * ODD[k + 1] + h[1 << k :]
        four = h if k == 1 else four
    n = len(data) - GRAM + 1
    h = h[:n] * ODD[5] + four[16 : 16 + n]
    h = (h ^ (h >> np.uint64(32))) * ODD[3]
    return h ^ (h >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row, from running minima of blocks of that width."""
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def fragments(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, anchor hash, fragment hash) of all fragments of the texts."""
    import xxhash

    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    assert len(data) < 1 << PLACE
    h = gram_hashes(data)
    low = np.uint64((1 << PLACE) - 1)
    # Ties go to the first place in the window, which only its content decides.
    anchor = (sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1) & low).astype(np.int64)
    start = np.arange(len(anchor))
    text = np.searchsorted(ends, start, side="right")
    inside = start + length <= ends[np.minimum(text, len(ends) - 1)]
    start, text, anchor = start[inside], text[inside], anchor[inside]
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.concatenate([first, [len(start)]]))
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    begin = start[first]
    whole = np.array([digest(view[a:b]) for a, b in zip(begin.tolist(), (begin + count + length - 1).tolist(), strict=True)], np.uint64)
    at = text[first]
    return at, begin - (ends[at] - sizes[at]), count, h[anchor[first]].view(np.int64), whole.view(np.int64)


def stretches(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Numbers, offsets and bytes to look at together; a very long text comes in stretches that share no window."""
    for a, b in slices(texts):
        done = a
        for i in [*(i for i in range(a, b) if len(texts[i]) > STRETCH), b]:
            if done < i:
                yield list(range(done, i)), [0] * (i - done), texts[done:i]
            for start in range(0, len(texts[i]) if i < b else 0, STRETCH):
                yield [i], [start], [texts[i][start : start + STRETCH + length - 1]]
            done = i + 1


def once_per_text(found: tuple[np.ndarray, ...], length: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Of places with equal fragments in one text the first, how many there are, and the ranges they cover if several.

    Periodic texts repeat a fragment at every period.
    """
    text, start, count, anchor, whole = found
    order = np.lexsort((start, text, anchor, whole))
    keys = np.stack([whole, anchor, text])[:, order]
    first = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])) if len(order) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([first, [len(order)]]))
    ranges: list = [None] * len(first)
    for g in np.flatnonzero(times > 1).tolist():
        begin = start[order[first[g] : first[g] + times[g]]]
        end = begin + int(count[order[first[g]]]) + length - 1
        cut = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
        last = np.concatenate([cut[1:], [len(begin)]]) - 1
        ranges[g] = np.stack([begin[cut], end[last]], axis=1)
    return order[first], times, ranges


def places(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, whole, copies, key, size, start, windows, ranges): all fragments of all texts.

    Copies within a slice come once, and so do equal fragments of a text, with the ranges of all.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, list[int]] = {}
            for text, key in zip(batch.column("text").to_pylist(), batch.column("key").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if len(data) >= length:
                    held.setdefault(data, [key, 0])[1] += 1
            texts, keys = list(held), np.array(list(held.values()), np.int64).reshape(-1, 2)
            for numbers, offsets, part in stretches(texts, length):
                found = fragments(part, length)
                at, times, ranges = once_per_text(found, length)
                text, start, count, anchor, whole = (x[at] for x in found)
                shift = np.array(offsets, np.int64)[text]
                spans = [None if r is None else [{"start": int(a + s), "end": int(b + s)} for a, b in r] for r, s in zip(ranges, shift.tolist(), strict=True)]
                own, size = np.array(numbers)[text], np.array([len(texts[i]) for i in numbers], np.int64)[text]
                yield pa.RecordBatch.from_pydict({
                    "anchor": pa.array(anchor), "whole": pa.array(whole), "copies": pa.array(keys[own, 1] * times), "key": pa.array(keys[own, 0]),
                    "size": pa.array(size), "start": pa.array(start + shift), "windows": pa.array(count.astype(np.int32)), "ranges": pa.array(spans, kind)})

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = "anchor bigint, whole bigint, copies bigint, key bigint, size bigint, start bigint, windows int, ranges array<struct<start: bigint, end: bigint>>"
    return keyed(docs).select("key", "text").mapInArrow(each, schema)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, key and size of the text, which together stand for the text."""
    return id_and_text(docs).withColumn("key", F.xxhash64("text")).withColumn("size", F.octet_length("text").cast("bigint"))


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, key, size and the compressed text, for shuffles."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tool = zstandard.ZstdCompressor(level=1)
        for batch in few_rows(batches):
            data = [tool.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "key", "size")] + [pa.array(data, pa.binary())], names=["doc_id", "key", "size", "packed"])

    return keyed(docs).select("doc_id", "key", "size", "text").mapInArrow(each, "doc_id bigint, key bigint, size bigint, packed binary")


def shared_places(docs: DataFrame, length: int) -> DataFrame:
    """The places whose anchor occurs twice, with `times` of the fragment, `kinds` of fragments of the anchor and one `chosen` place of each."""
    found = places(docs, length).repartition("anchor")
    same = Window.partitionBy("anchor", "whole")
    ordered = same.orderBy("key", "size", "start")
    found = found.withColumn("times", F.sum("copies").over(same)).withColumn("chosen", F.row_number().over(ordered) == 1)
    found = found.withColumn("kinds", F.sum(F.col("chosen").cast("int")).over(Window.partitionBy("anchor")))
    return cut_lineage(found.where("times > 1 or kinds > 1").drop("copies"))


def cut_out(docs: DataFrame, shared: DataFrame, length: int) -> DataFrame:
    """(anchor, whole, kinds, data): the bytes of one of each kind of fragment whose anchor has several."""
    asked = shared.where("chosen and kinds > 1").groupBy("key", "size").agg(F.collect_list(F.struct("anchor", "whole", "kinds", "start", "windows")).alias("asked"))
    texts = packed(docs).dropDuplicates(["key", "size"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            rows: list[tuple] = []
            for data, asked in zip(batch.column("packed").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                text = tool.decompress(data)
                for r in asked:
                    part = text[r["start"] : r["start"] + r["windows"] + length - 1]
                    if xxhash.xxh3_64_intdigest(part) == r["whole"] % (1 << 64):
                        rows.append((r["anchor"], r["whole"], r["kinds"], part))
                if len(rows) >= 20_000:
                    yield _batch(rows, ("anchor", "whole", "kinds", "data"), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))
                    rows = []
            yield _batch(rows, ("anchor", "whole", "kinds", "data"), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))

    joined = texts.join(asked, ["key", "size"]).select("packed", "asked")
    return joined.mapInArrow(each, "anchor bigint, whole bigint, kinds bigint, data binary")


def _batch(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))


class Family:
    """Suffix arrays of one anchor's batches. A level holds windows in the order of their bytes and their numbers."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Numbers of all windows found equal to another, in the batch or in a level."""
        order = np.argsort(keys, kind="stable")
        level = (keys[order], numbers[order])
        del keys, order
        found = [level[1][_twins(level[0])]]
        for other in self.levels:
            at = np.searchsorted(other[0], level[0])
            hit = at < len(other[0])
            hit[hit] = other[0][at[hit]] == level[0][hit]
            found += [level[1][hit], other[1][at[hit]]]
        while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
            level = _merge(self.levels.pop(), level)
        self.levels.append(level)
        return np.unique(np.concatenate(found))


def _twins(keys: np.ndarray) -> np.ndarray:
    same = keys[1:] == keys[:-1]
    return np.concatenate([same, [False]]) | np.concatenate([[False], same])


def _merge(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The union in order; of equal windows the first stays, the others are known to be twins.

    Windows of `other` are put where they belong in `one`, so only the result is allocated.
    """
    fresh = np.concatenate([[True], other[0][1:] != other[0][:-1]]) if len(other[0]) else np.zeros(0, bool)
    at = np.searchsorted(one[0], other[0])
    known = at < len(one[0])
    known[known] = one[0][at[known]] == other[0][known]
    fresh &= ~known
    return np.insert(one[0], at[fresh], other[0][fresh]), np.insert(one[1], at[fresh], other[1][fresh])


def windows_of(data: bytes, length: int) -> np.ndarray:
    """All windows of a fragment as fixed-width byte strings."""
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), length)
    return np.ascontiguousarray(view).view(f"S{length}").ravel()


def twin_windows(parts: DataFrame, length: int) -> DataFrame:
    """(anchor, whole, first, past): ranges of windows that occur in another fragment of the anchor."""
    schema = "anchor bigint, whole bigint, first int, past int"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, rows, held, keys, base = Family(), [], 0, [], 0
        done: set[int] = set()

        def flush(goes_on: bool) -> pa.RecordBatch:
            nonlocal family, rows, held, keys, base, done
            numbers = np.concatenate([np.arange(b, b + n) for _, _, b, n in rows[-len(keys):]])
            found = [int(x) for x in family.add(np.concatenate(keys), numbers) if x not in done]
            out = _ranges(rows, np.array(found, np.int64))
            keys, held = [], 0
            if goes_on:
                done.update(found)
            else:
                family, rows, base, done = Family(), [], 0, set()
            return out

        for batch in batches:
            for anchor, whole, data in zip(*(batch.column(c).to_pylist() for c in ("anchor", "whole", "data")), strict=True):
                if held >= BATCH:
                    yield flush(goes_on=anchor == rows[-1][0])
                n = len(data) - length + 1
                rows.append((anchor, whole, base, n))
                keys.append(windows_of(data, length))
                base, held = base + n, held + n
        if keys:
            yield flush(goes_on=False)

    small = parts.where(F.col("kinds") <= FAMILY).select("anchor", "whole", "data").repartition("anchor").sortWithinPartitions("anchor", "whole")
    return small.mapInArrow(each, schema).unionByName(_counted_windows(parts.where(F.col("kinds") > FAMILY), length))


def _ranges(rows: list[tuple], found: np.ndarray) -> pa.RecordBatch:
    """Window numbers as ranges within their fragments."""
    bases = np.array([r[2] for r in rows], np.int64)
    at = np.searchsorted(bases, found, side="right") - 1
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(found) != 1) | (np.diff(at) != 0)])) if len(found) else np.zeros(0, np.int64)
    last = np.concatenate([cut[1:], [len(found)]])[: len(cut)] - 1
    own = at[cut]
    out = [(rows[i][0], rows[i][1], int(a), int(b)) for i, a, b in zip(own.tolist(), (found[cut] - bases[own]).tolist(), (found[last] - bases[own] + 1).tolist(), strict=True)]
    return _batch(out, ("anchor", "whole", "first", "past"), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))


def _counted_windows(parts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many fragments: windows with equal hashes, counted before they are shuffled."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = ("anchor", "whole", "first", "h1", "h2")
        for batch in batches:
            for anchor, whole, data in zip(*(batch.column(c).to_pylist() for c in ("anchor", "whole", "data")), strict=True):
                n = len(data) - length + 1
                both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[i : i + length]) for i in range(n)]), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, anchor)), pa.array(np.full(n, whole)), pa.array(np.arange(n, dtype=np.int32)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=list(names))

    hashed = parts.mapInArrow(each, "anchor bigint, whole bigint, first int, h1 bigint, h2 bigint")
    twice = hashed.groupBy("h1", "h2").count().where("count > 1").drop("count")
    return hashed.join(twice, ["h1", "h2"], "left_semi").select("anchor", "whole", "first", (F.col("first") + 1).alias("past"))


def covered(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, size, spans): the byte ranges that texts lose; they may touch or overlap."""
    shared = shared_places(docs, length)
    # Two steps read the fragments; as a stage table they are cut out once, and no task has two Python workers.
    found = cut_lineage(twin_windows(cut_lineage(cut_out(docs, shared, length)), length))
    own = F.array(F.struct("start", (F.col("start") + F.col("windows") + (length - 1)).alias("end")))
    whole = shared.where("times > 1").select("key", "size", F.explode(F.coalesce("ranges", own)).alias("r")).select("key", "size", "r.start", "r.end")
    parts = shared.where("times = 1").join(found, ["anchor", "whole"]).select(
        "key", "size", (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("past") + (length - 1)).alias("end"))
    # The ranges of one text; a text that has many of them is long itself.
    return whole.union(parts).distinct().groupBy("key", "size").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or []):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return b"".join([*out, text[at:]])


def repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start, end) of what is removed."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tool = zstandard.ZstdDecompressor()
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in few_rows(batches):
            rows = []
            for doc, data, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "spans")), strict=True):
                text, gone = tool.decompress(data), merged(spans)
                rows.append((doc, len(text), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept(text, gone)).hexdigest(), [{"start": a, "end": b} for a, b in gone]))
            yield _batch(rows, ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span))

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start: bigint, end: bigint>>"
    return packed(docs).join(covered(docs, length), ["key", "size"], "left").select("doc_id", "packed", "spans").mapInArrow(each, schema)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with the text that is left, all other columns as they are; n_chars, where there is one, is counted again.

    A character that loses some of its bytes loses them all. A text that loses nothing stays as it is, null included.
    """

    @F.arrow_udf("string")
    def rest(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([kept(t.encode("utf-8", "surrogatepass"), merged(s)).decode("utf-8", "ignore") for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    found = covered(docs, length).select("key", "size", "spans")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = rows.join(found, (F.xxhash64("text") == F.col("key")) & (F.octet_length("text") == F.col("size")), "left")
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    out = joined.select("row", "spans", F.when(F.col("spans").isNotNull(), rest("text", F.coalesce("spans", none))).otherwise(F.col("row")["text"]).alias("left"))
    counted = F.when(F.col("spans").isNotNull(), F.char_length("left")).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    new = {"text": F.col("left"), "n_chars": counted}
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
