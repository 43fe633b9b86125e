"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 4).

Fingerprints within distance r of each other have a third within r/2 of both. So every
distinct fingerprint emits all variants within r/2, the variants are shuffled, and what
meets on a variant is linked. All that meet are within r of each other, so linking each to
the smallest of them loses no component. A variant holds at most one fingerprint for each
flip, so no bucket grows with the data, and copies are merged before anything is emitted.

Defined results: a null or blank text has fingerprint zero, which links like any other.
Rows that repeat a doc_id keep a row each. A null doc_id never names a component unless
all its documents have none. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations
from math import acos, ceil, comb, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.blocks import joined, squares
from edgeloom.llm.common import few_rows, id_and_text, text_key
from edgeloom.llm.components import components
from edgeloom.session import cut_lineage

SEED = 42


def _runs(text: str, words: int) -> list[bytes]:
    """Each run of so many words, repeats included; the whole where there are fewer words."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and ASCII white space only
    joined = b" ".join(found)
    if len(found) <= words:
        return [joined] if found else []
    starts = list(accumulate((len(w) + 1 for w in found), initial=0))
    return [joined[a : b - 1] for a, b in zip(starts, starts[words:])]


def shingle_hashes(text: str, words: int) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.array([digest(run, SEED) for run in _runs(text, words)], np.uint64)


def fingerprint(text: str, words: int) -> int:
    """Signed 64-bit fingerprint: a bit is set where over half the shingle hashes set it."""
    hashes = shingle_hashes(text, words)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, key (tells rows of one doc_id apart) and signed 64-bit fp."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            found = [fingerprint(text, words) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(found, pa.int64())], names=["doc_id", "key", "fp"])

    return id_and_text(docs).withColumn("key", text_key(F.col("text"))).mapInArrow(each, "doc_id bigint, key bigint, fp bigint")


def ball(radius: int, width: int = 64) -> Column:
    """All masks of at most so many of the lowest bits, a constant array."""
    flips = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]
    return F.array(*(F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint") for m in flips))


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) that connect what lies within the radius; `prints` has distinct fp."""
    if radius % 2:
        raise ValueError("the radius must be even: balls of half the radius meet in its middle")
    variants = prints.select("fp", F.explode(ball(radius // 2)).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.withColumn("first", F.min("fp").over(Window.partitionBy("variant"))).where("fp <> first")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("first"))) <= radius
    return met.where(close).select(F.col("first").alias("a"), F.col("fp").alias("b")).distinct()


def _named(found: DataFrame, prints: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds component_id and root, which is unique for each component, to `found`. `prints` has each fp of it once, with the `least` doc_id; `groups` the component of a node."""
    rooted = prints.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return found.join(rooted.join(names, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, key, fp and component_id, the smallest doc_id that links reach."""
    found = cut_lineage(fingerprints(docs, words))
    prints = cut_lineage(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return _named(found, prints, components(links(prints, radius)))


@dataclass(frozen=True)
class Parts:
    """Fingerprints in several parts, for pairs too far apart for a radius in one piece.

    Each part of `bits` bits is matched within `radius` of its own. Pairs that meet in any
    part and differ in at most `most` bits, the distance expected at `similarity` plus four
    standard deviations, are candidates; the sets of shingles themselves decide.
    """

    parts: int
    bits: int
    words: int = 5
    similarity: float = 0.8
    radius: int = 2

    @classmethod
    def at(cls, similarity: float = 0.8, words: int = 5, bits: int = 30, radius: int = 2, found: float = 0.9) -> Parts:
        """As many parts as it takes for a pair at the threshold to meet with the chance `found`, whatever the rows."""
        p = _apart(similarity)
        meets = sum(comb(bits, n) * p**n * (1 - p) ** (bits - n) for n in range(radius + 1))
        return cls(ceil(log(1 - found) / log(1 - meets)), bits, words, similarity, radius)

    @property
    def most(self) -> int:
        total, p = self.parts * self.bits, _apart(self.similarity)
        return int(total * p + 4 * sqrt(total * p * (1 - p)))


def _apart(similarity: float) -> float:
    """Chance that a fingerprint bit differs, at a similarity of sets."""
    return acos(2 * similarity / (1 + similarity)) / pi


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct hashes of the runs, in order."""
    return np.unique(shingle_hashes(text, words))


def part_fingerprint(text: str, scheme: Parts) -> list[int]:
    """The parts of a SimHash fingerprint, of the set of runs, of as many bits as they have in all."""
    import xxhash

    total, digest = scheme.parts * scheme.bits, xxhash.xxh3_128_digest
    runs = list(set(_runs(text, scheme.words)))
    ones = np.zeros(-(-total // 128) * 128, np.int64)
    for k in range(0, len(runs), 1 << 14):
        for seed in range(len(ones) // 128):
            part = np.frombuffer(b"".join([digest(r, SEED + seed) for r in runs[k : k + (1 << 14)]]), np.uint8).reshape(-1, 16)
            ones[seed * 128 : seed * 128 + 128] += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * ones[:total] > len(runs)).reshape(scheme.parts, scheme.bits)
    return (bits @ (1 << np.arange(scheme.bits, dtype=np.int64))).tolist()


def part_fingerprints(docs: DataFrame, scheme: Parts) -> DataFrame:
    """doc_id, key and the parts; fp, a hash of the set of shingles, stands for them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in few_rows(batches):
            known: dict[str, tuple[list[int], int]] = {}  # copies are worked out once
            for t in batch.column("text").to_pylist():
                if t not in known:
                    known[t] = part_fingerprint(t, scheme), int(np.uint64(xxhash.xxh3_64_intdigest(shingle_set(t, scheme.words).tobytes())).view(np.int64))
            parts, fp = zip(*(known[t] for t in batch.column("text").to_pylist()), strict=True) if len(batch) else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(parts, pa.list_(pa.int64())), pa.array(fp, pa.int64())], names=["doc_id", "key", "parts", "fp"])

    texts = id_and_text(docs).withColumn("key", text_key(F.col("text")))
    return texts.mapInArrow(each, "doc_id bigint, key bigint, parts array<bigint>, fp bigint")


def part_links(prints: DataFrame, scheme: Parts) -> DataFrame:
    """All pairs (a, b) of fingerprints that meet in a part and agree on the whole."""
    return _agreeing(_meetings(prints, scheme).select("variant", F.col("fp").alias("class")), None, prints, scheme)


def part_components(prints: DataFrame, scheme: Parts, docs: DataFrame) -> DataFrame:
    """(node, component) of what is linked: fingerprints that meet in a part, agree on the whole and stand for similar sets.

    `prints` has fp, parts and least_key, the key of a text of that fingerprint in `docs`.
    Meeting in one part doesn't prove closeness. So what meets is first asked of the smallest
    fp on the variant, which connects most. Of variants that still hold several components,
    members are compared with each other as fingerprints, in blocks of bounded size that
    return what agrees and isn't connected (`blocks`), and their sets decide. So none stays
    unchecked because the smallest was a stranger to it, and members of one component are
    never asked in all pairs. Sets are made only of texts whose fingerprints agree with another.
    """
    percent = round(100 * scheme.similarity)
    met = cut_lineage(_meetings(prints, scheme))

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = cut_lineage(pairs)
        wanted = prints.join(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fp", "left_semi")
        return similar_pairs(pairs, cut_lineage(shingle_sets(wanted, docs, scheme)), percent)

    stars = met.where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b")).distinct()
    labels = components(linked(_agree(stars, prints, scheme))).withColumnRenamed("node", "class")
    others = met.where("fp <> first").select("variant", F.col("fp").alias("class")).join(labels, "class", "left").withColumn("own", F.coalesce("component", "class"))
    several = others.groupBy("variant").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select("variant")
    rest = _agreeing(others.join(several, "variant").select("variant", "class"), labels, prints, scheme)
    return joined(labels, linked(rest)).withColumnRenamed("class", "node")


def shingle_sets(prints: DataFrame, docs: DataFrame, scheme: Parts) -> DataFrame:
    """class (the fp) and its distinct shingle hashes."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            found = [shingle_set(t, scheme.words).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(found, pa.list_(pa.int64()))], names=["class", "shingles"])

    wanted = prints.select("fp", F.col("least_key").alias("key"))
    own = id_and_text(docs).withColumn("key", text_key(F.col("text"))).join(wanted, "key").dropDuplicates(["fp"]).select("fp", "text")
    return own.mapInArrow(each, "class bigint, shingles array<bigint>")


def similar_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose sets of shingle hashes have the similarity, by exact Jaccard. Sets grow with the data, so they are never broadcast."""
    one, other = (sets.select(F.col("class").alias(n), F.col("shingles").alias(v)).hint("merge") for n, v in (("a", "x"), ("b", "y")))
    common = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(other, "b").where(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("a", "b")


def _meetings(prints: DataFrame, scheme: Parts) -> DataFrame:
    """(variant, fp, first): what is not alone on a variant, with the smallest fp there."""
    split = prints.select("fp", F.posexplode("parts").alias("part", "value"))
    variants = split.select("fp", "part", "value", F.explode(ball(scheme.radius // 2, scheme.bits)).alias("mask"))
    placed = variants.select("fp", (F.shiftleft(F.col("part").cast("bigint"), 48) + F.col("value").bitwiseXOR(F.col("mask"))).alias("variant"))
    own = Window.partitionBy("variant")
    return placed.withColumn("first", F.min("fp").over(own)).withColumn("last", F.max("fp").over(own)).where("first < last").drop("last")


def _agree(asked: DataFrame, prints: DataFrame, scheme: Parts) -> DataFrame:
    """Of the pairs (a, b) those that agree on the whole."""
    one, other = (prints.select(F.col("fp").alias(n), F.col("parts").alias(v)).hint("merge") for n, v in (("a", "x"), ("b", "y")))
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, m: n + m)
    return asked.join(one, "a").join(other, "b").where(apart <= scheme.most).select("a", "b")


def _agreeing(left: DataFrame, labels: DataFrame | None, prints: DataFrame, scheme: Parts) -> DataFrame:
    """Pairs (a, b) of different components on a variant of `left` (variant, class) that agree on the whole.

    Two fingerprints can meet on many variants: the pair comes from the first part they meet
    in, from the smaller of the values between theirs.
    """
    def compare(block: pa.Table) -> pa.Table:
        side, variant = block.column("half").to_numpy(), int(block.column("variant")[0].as_py())
        names, own = block.column("class").to_numpy(), block.column("own").to_numpy()
        parts, found = block.column("parts").combine_chunks().flatten().to_numpy().reshape(len(names), -1), [np.zeros((0, 2), np.int64)]
        part, value = variant >> 48, variant & ((1 << 48) - 1)
        within = block.column("row")[0] == block.column("column")[0]
        for k in range(len(names)) if within else np.flatnonzero(side == 0).tolist():
            rest = slice(k + 1, None) if within else np.flatnonzero(side == 1)
            differ = parts[rest] ^ parts[k]
            apart = np.bitwise_count(differ)
            one = differ[:, part] & -differ[:, part]
            between = np.minimum(parts[rest][:, part] ^ one, parts[k, part] ^ one)
            here = ((apart <= scheme.radius).argmax(axis=1) == part) & (between == value)
            others = names[rest][here & (apart.sum(axis=1) <= scheme.most) & (own[rest] != own[k])]
            found.append(np.stack([np.minimum(others, names[k]), np.maximum(others, names[k])], axis=1))
        pairs = np.concatenate(found)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    named = left.withColumn("own", F.col("class")) if labels is None else left.join(labels, "class", "left").select("variant", "class", F.coalesce("component", "class").alias("own"))
    rows = named.join(prints.select(F.col("fp").alias("class"), "parts").hint("merge"), "class")
    return squares(rows, ["variant"], "class").groupBy("variant", "row", "column").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates_by_parts(docs: DataFrame, scheme: Parts) -> DataFrame:
    """doc_id, key, fp, root (of the component) and component_id, of fingerprints in parts."""
    found = cut_lineage(part_fingerprints(docs, scheme))
    prints = cut_lineage(found.groupBy("fp", "parts").agg(F.min("doc_id").alias("least"), F.min("key").alias("least_key")))
    return _named(found.drop("parts"), prints.select("fp", "least"), part_components(prints.drop("least"), scheme, docs))


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint as 16 lowercase hex digits, component_id."""
    return near_duplicates(docs, words, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest doc_id, ties to the smaller key."""
    kept = near_duplicates_by_parts(docs, Parts.at(similarity, words)).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("one"))
    kept = kept.select(F.col("one.doc_id").alias("doc"), "one.key").distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("doc"), text_key(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    chosen = rows.alias("d").join(kept.alias("k"), F.col("d.doc").eqNullSafe(F.col("k.doc")) & (F.col("d.key") == F.col("k.key")), "left_semi")
    return chosen.dropDuplicates(["doc", "key"]).select("row.*")
