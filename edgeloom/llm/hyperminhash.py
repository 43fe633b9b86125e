"""Near-duplicates by HyperMinHash registers (operator 12).

Each hash of a document's shingle set falls into one of the buckets of a sketch; a bucket
keeps its smallest value as the count of leading zeros and a few mantissa bits. An empty
bucket takes the register of the first filled one in an order of its own, so registers of
two sketches agree as often as the sets are similar, whatever their size. Registers are
banded, what shares a band is a candidate, the share of equal registers less the expected
accidental ones estimates the similarity, and the sets themselves decide.

Documents of the same set are one class. In a band, members are not compared in all pairs:
each class is first asked of the smallest it meets, which gathers most of a family. Of bands
whose members are then in several components, those outside the largest are compared with
all of it, and in the end with each other, in blocks of bounded size (see `blocks`): the sets
with those of the component, the sketches with each other, and what doesn't match makes no
row. So every pair of a band is compared or connected already. Pairs at the threshold share
no band with a chance of (1 - 0.8 ** ROWS) ** BANDS, 5 in 10 million; nothing else is lost.

Shingles are compared by 64-bit hashes. A long text is one row of 8 bytes a shingle.

Defined results: a null, empty or blank text has an empty set and its own component. Rows
that repeat a doc_id keep a row each. A null doc_id never names a component unless all its
documents have none; `kept` is then true for them. An empty table gives no row. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.blocks import joined, linked_to_components, outside, squares
from edgeloom.llm.common import id_and_text, ship_package, text_key
from edgeloom.llm.components import components
from edgeloom.session import cut_lineage

BANDS, ROWS = 48, 6
BUCKETS = BANDS * ROWS
#: Bits of the mantissa; the rest of a register counts zeros.
MANTISSA = 10
#: Fixed value of the published estimate of accidental collisions.
COLLISIONS = 0.169919487159739093975315012348
#: How far an estimate may lie below the threshold: about eight standard deviations, for sets of a few shingles too.
SLACK = 0.2
_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WORDS: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _orders() -> np.ndarray:
    """For each bucket the rank of all others in its own order."""
    pairs = np.arange(BUCKETS * BUCKETS, dtype=np.uint64).reshape(BUCKETS, BUCKETS)
    return np.argsort(np.argsort(_mix(pairs * _GOLDEN), axis=1), axis=1).astype(np.int16)


ORDERS = _orders()


def shingle_set(text: str) -> np.ndarray:
    """Distinct hashes, in order, of pairs of neighbouring words; of the word where there is one."""
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and ASCII white space only
    new = {w for w in found if w not in _WORDS}
    if len(_WORDS) + len(new) > 1_000_000:
        _WORDS.clear()
        new = set(found)
    _WORDS.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
    h = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    return np.unique(_mix(h * _GOLDEN) if len(h) < 2 else _mix(h[:-1] * _GOLDEN ^ _mix(h[1:])))


def registers(values: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes that isn't empty."""
    bucket = ((values >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)
    least = np.full(BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bucket.astype(np.int64), _mix(values + _GOLDEN))
    filled = np.bincount(bucket.astype(np.int64), minlength=BUCKETS) > 0
    smeared = least.copy()
    for k in (1, 2, 4, 8, 16, 32):
        smeared |= smeared >> np.uint64(k)
    zeros = np.minimum(64 - np.bitwise_count(smeared).astype(np.uint64), 63)
    register = (zeros << np.uint64(MANTISSA)) | ((least << zeros) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    if not filled.all():
        held, bare = np.flatnonzero(filled), np.flatnonzero(~filled)
        register[bare] = register[held[ORDERS[np.ix_(bare, held)].argmin(axis=1)]]
    return register.astype(np.uint16)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A hash of each band of each sketch."""
    banded = sketches.reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), banded.shape[:2])
    for k in range(ROWS):
        key = _mix(key * _GOLDEN + banded[:, :, k])
    return key.view(np.int64)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), n_shingles; for sets that aren't empty also their fp, sketch and bands."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            known: dict[str, tuple] = {}  # copies are worked out once
            for t in batch.column("text").to_pylist():
                if t not in known:
                    found = shingle_set(t)
                    known[t] = (len(found), xxhash.xxh3_128_hexdigest(found.tobytes()), registers(found)) if len(found) else (0, None, None)
            own = [known[t] for t in batch.column("text").to_pylist()]
            filled = [x[2] for x in own if x[0]]
            keys = iter(band_keys(np.array(filled)).tolist()) if filled else iter(())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array([x[0] for x in own], pa.int64()), pa.array([x[1] for x in own], pa.string()),
                 pa.array([x[2].tobytes() if x[0] else None for x in own], pa.binary()), pa.array([next(keys) if x[0] else None for x in own], pa.list_(pa.int64()))],
                names=["doc_id", "key", "n_shingles", "fp", "sketch", "bands"])

    ship_package(docs.sparkSession)
    texts = id_and_text(docs).withColumn("key", text_key(F.col("text")))
    return texts.mapInArrow(each, "doc_id bigint, key bigint, n_shingles bigint, fp string, sketch binary, bands array<bigint>")


def similar_sketches(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches, of sets of n and m shingles, and sizes allow the similarity."""
    accidental = COLLISIONS * BUCKETS / 2**MANTISSA * 4 * n * m / (n + m) ** 2
    near = ((x == y).sum(axis=-1) - accidental) / BUCKETS >= percent / 100 - SLACK
    return near & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) of classes those whose sketches and sizes allow the similarity."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.float64) for c in ("n", "m"))
            yield batch.select(["a", "b"]).filter(pa.array(similar_sketches(_sketches(batch.column("x")), _sketches(batch.column("y")), n, m, percent), pa.bool_()))

    one, other = (classes.select(F.col("class").alias(c), F.col("sketch").alias(s), F.col("n_shingles").alias(n)) for c, s, n in (("a", "x", "n"), ("b", "y", "m")))
    return pairs.join(one, "a").join(other, "b").mapInArrow(each, "a bigint, b bigint")


def estimated_within(left: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a band of `left` (band, place, class) and whose sketches and sizes
    allow the similarity; each from the first band that the two have in common."""
    def compare(block: pa.Table) -> pa.Table:
        side, place = block.column("half").to_numpy(), block.column("place").to_numpy()[0]
        names, own, n = (block.column(c).to_numpy() for c in ("class", "own", "n_shingles"))
        sketches, found = _sketches(block.column("sketch")), [np.zeros((0, 2), np.int64)]
        within = block.column("row")[0] == block.column("column")[0]
        for k in range(len(names)) if within else np.flatnonzero(side == 0).tolist():
            rest = slice(k + 1, None) if within else np.flatnonzero(side == 1)
            equal = sketches[rest] == sketches[k]
            first = equal.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == place
            near = similar_sketches(sketches[rest], sketches[k], n[rest].astype(np.float64), float(n[k]), percent)
            others = names[rest][first & near & (own[rest] != own[k])]
            found.append(np.stack([np.minimum(others, names[k]), np.maximum(others, names[k])], axis=1))
        pairs = np.concatenate(found)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    named = left.join(labels, "class", "left").withColumn("own", F.coalesce("component", "class")).join(classes.select("class", "sketch", "n_shingles"), "class")
    return squares(named, ["band"], "class").groupBy("band", "row", "column").applyInArrow(compare, "a bigint, b bigint")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose whole sets are similar."""
    one, other = (sets.select(F.col("class").alias(c), F.col("shingles").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    common = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(other, "b").where(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("a", "b")


def shingle_sets(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """class and shingles of the classes given, from the text of one document of each."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(found, pa.list_(pa.int64()))], names=["class", "shingles"])

    texts, own = id_and_text(docs).withColumn("key", text_key(F.col("text"))).alias("t"), classes.select("class", "doc_id", "key").alias("c")
    same = (F.col("t.key") == F.col("c.key")) & F.col("t.doc_id").eqNullSafe(F.col("c.doc_id"))
    return texts.join(own, same).dropDuplicates(["class"]).select("class", "text").mapInArrow(each, "class bigint, shingles array<bigint>")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach."""
    found = cut_lineage(sketched(docs))
    classes = found.where("fp is not null").groupBy("fp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("one"), *(F.first(c).alias(c) for c in ("n_shingles", "sketch", "bands")))
    classes = cut_lineage(classes.select(F.monotonically_increasing_id().alias("class"), "fp", "one.doc_id", "one.key", "n_shingles", "sketch", "bands"))
    met = _meetings(classes)
    sets = cut_lineage(shingle_sets(classes.join(met.select("class").distinct(), "class", "left_semi"), docs))
    labels = _connected(met, classes, sets, percent)
    rooted = cut_lineage(classes.join(labels, "class", "left").select("fp", "doc_id", F.coalesce("component", "class").alias("root")))
    names = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = found.select("doc_id", "n_shingles", "fp").join(rooted.join(names, "root").select("fp", "component_id"), "fp", "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _meetings(classes: DataFrame) -> DataFrame:
    """(band, place, class, first): classes that are not alone in a band, with the smallest there; `place` is the band's number."""
    placed = classes.select("class", F.posexplode("bands").alias("place", "band"))
    shared = cut_lineage(placed.groupBy("band").agg(F.min("class").alias("first"), F.max("class").alias("last")).where("first < last").select("band", "first"))
    return cut_lineage(placed.join(shared, "band"))


def _connected(met: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(class, component) of the classes that links join."""
    def linked(pairs: DataFrame) -> DataFrame:
        return cut_lineage(confirmed(cut_lineage(estimated(pairs, classes, percent)), sets, percent))

    asked = cut_lineage(met.groupBy("class").agg(F.min("first").alias("a")).where("a < class").select("a", F.col("class").alias("b")))
    labels = components(linked(asked)).select(F.col("node").alias("class"), "component")
    for _ in range(2):  # once more, as components have grown
        left, others = outside(met.drop("first"), labels, "band")
        labels = joined(labels, cut_lineage(linked_to_components(others, labels, sets, percent)))
    apart = cut_lineage(estimated_within(left, labels, classes, percent)).join(asked, ["a", "b"], "left_anti")
    return joined(labels, cut_lineage(confirmed(apart, sets, percent)))


def kept_documents(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, and whether the document names its component."""
    return near_duplicates(docs, percent).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
