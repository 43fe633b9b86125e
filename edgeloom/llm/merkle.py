"""Merkle manifest of a dataset from level strings (operator 11).

Every row is a leaf, every value of `lang` a tree and the trees' roots one more tree. Nodes
of a tree are dealt to aligned blocks of FANOUT ** HEIGHT. A block keeps each level as one
string of digests side by side: a parent is the hash of a substring of fixed width, and what
flanks a node in that substring are its siblings. The top nodes of blocks are the nodes of
the next pass, so a pass shortens the data by the block's size and its number of jobs grows
with the logarithm of the rows. No task holds more than a block.

Defined results: nulls in any column count as such. A null doc_id comes first in its
language and its row is never taken as tampered. Rows that repeat a doc_id are ordered by
their leaf and keep a row each. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.session import cut_lineage

#: Nodes a parent has, characters of a digest.
FANOUT, DIGEST = 8, 64
#: Levels a block reduces.
HEIGHT = 3
_RUN = FANOUT * DIGEST
_ROW_MASK = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in its low 33 bits


def field(value: Column) -> Column:
    """A value with its length in bytes, or a dash."""
    plain = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in (doc_id, source, lang, n_chars, text))), 256)


@dataclass(frozen=True)
class Manifest:
    """`proofs`: doc_id, lang, leaf, claim, path, subroot, root; `subroots`: lang, hash, and path to the root;
    `levels`: the block tables of the languages' trees, lowest first, with their level strings."""

    proofs: DataFrame
    subroots: DataFrame
    levels: list[DataFrame]


def build(docs: DataFrame, text_now: Column | None = None, height: int = HEIGHT) -> Manifest:
    """The manifest of `docs`; `claim` is the leaf of each row with `text_now` for its text."""
    names = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    own = leaf(*names, F.col("text"))
    claim = own if text_now is None else F.when(F.col("text").eqNullSafe(text_now), own).otherwise(leaf(*names, text_now))
    rows = docs.select("doc_id", "lang", field(F.col("lang")).alias("tree"), own.alias("hash"), claim.alias("claim"))
    levels = _blocks(_placed(cut_lineage(rows), ["doc_id", "hash"], ["doc_id", "lang", "claim"]), height)
    roots = None
    for blocks in levels:  # a tree ends in the table that holds all of it in one block
        ended = blocks.where(F.col("total") <= FANOUT**height).select("tree", F.col("top").alias("hash"))
        roots = ended if roots is None else roots.unionByName(ended)
    named = levels[0].where("block = 0").select("tree", F.col("items")[0]["lang"].alias("lang"))
    roots = roots.join(named, "tree").select(F.col("tree").alias("own"), "lang", F.lit("").alias("tree"), "hash")
    above = _blocks(_placed(cut_lineage(roots), ["lang"], ["own", "lang"]), height)
    subroots = cut_lineage(_paths(above, height).select(F.col("item.own").alias("tree"), F.col("item.lang").alias("lang"), F.col("item.hash").alias("hash"), "path", F.col("root")))
    inner = _paths(levels, height, subroots.select("tree", F.col("path").alias("beyond"), F.col("root").alias("whole")))
    proofs = inner.select(
        F.col("item.doc_id").alias("doc_id"), F.col("item.lang").alias("lang"), F.col("item.hash").alias("leaf"), F.col("item.claim").alias("claim"), "path", F.col("root").alias("subroot"), F.col("whole").alias("root"))
    return Manifest(proofs, subroots, levels)


def proof_digest(path: Column) -> Column:
    """Hash of all siblings, from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(path, node, lambda held, s: F.sha2(F.concat(s["before"], held, s["after"]), 256))


def verify(docs: DataFrame, text_now: Column, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, and what the rows with `text_now` fold to."""
    at = build(docs, text_now, height).proofs.withColumn("folded_root", folded(F.col("claim"), F.col("path")))
    return at.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def third_lowered(doc_id: Column, text: Column) -> Column:
    """The text, its A-Z lower-cased where the checksum of doc_id is divisible by three."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate(text, capitals, capitals.lower())).otherwise(text)


def _placed(rows: DataFrame, order: list[str], kept: list[str]) -> DataFrame:
    """tree, pos (from 0 in its tree), total (nodes of the tree), item (hash and what is `kept`).

    Rows are sorted by range; each partition numbers its own, and the counts of a tree in the
    partitions before it, one small row each, shift the numbers.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    stored = cut_lineage(ranged.select("tree", F.struct("hash", *kept).alias("item"), F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit(_ROW_MASK)).alias("row")))
    sizes = stored.groupBy("part", "tree").agg(F.min("row").alias("low"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("part", "tree", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"), F.sum("n").over(Window.partitionBy("tree")).alias("total"))
    return stored.join(shift, ["part", "tree"]).select("tree", (F.col("row") + F.col("shift")).alias("pos"), "total", "item")


def _parents(level: Column) -> Column:
    """The level above a level string: the hash of each run of digests."""
    starts = F.sequence(F.lit(0), ((F.length(level) - 1) / _RUN).cast("int"))
    return F.array_join(F.transform(starts, lambda i: F.sha2(F.substring(level, i * _RUN + 1, F.lit(_RUN)), 256)), "")


def _blocks(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Block tables from the lowest up: tree, block, total, items in order, level strings l0, l1, ..., top."""
    size, tables = FANOUT**height, []
    while True:
        block = nodes.groupBy("tree", F.expr(f"pos div {size}").alias("block"), "total").agg(F.sort_array(F.collect_list(F.struct("pos", "item"))).alias("held"))
        block = block.select("tree", "block", "total", F.transform("held", lambda h: h["item"]).alias("items"))
        block = block.withColumn("l0", F.array_join(F.transform("items", lambda x: x["hash"]), ""))
        for n in range(1, height + 1):  # a level of one node in the whole tree has no parents
            block = block.withColumn(f"l{n}", F.when(F.col("total") > FANOUT ** (n - 1), _parents(F.col(f"l{n - 1}"))))
        tables.append(cut_lineage(block.withColumn("top", F.coalesce(*(f"l{n}" for n in range(height, -1, -1))))))
        taller = tables[-1].where(F.col("total") > size)
        if taller.isEmpty():
            return tables
        nodes = taller.select("tree", F.col("block").alias("pos"), F.ceil(F.col("total") / size).alias("total"), F.struct(F.col("top").alias("hash")).alias("item"))


def _paths(tables: list[DataFrame], height: int, beyond: DataFrame | None = None) -> DataFrame:
    """Each node of the lowest table: tree, pos, item, root of its tree, path of (before, after) up to it and `beyond`, and `whole`."""
    size, none = FANOUT**height, F.expr("cast(array() as array<struct<before: string, after: string>>)")
    up = None
    for blocks in reversed(tables):
        ends = blocks.where(F.col("total") <= size).withColumns({"higher": none, "root": F.col("top")})
        ends = ends.withColumn("whole", F.col("top")) if beyond is None else ends.join(beyond, "tree").withColumn("higher", F.col("beyond")).drop("beyond")
        if up is not None:
            ends = ends.unionByName(blocks.where(F.col("total") > size).join(up, ["tree", "block"]))
        here = _opened(ends, height)
        up = here.select("tree", F.col("pos").alias("block"), F.col("path").alias("higher"), "root", "whole")
    return here


def _opened(blocks: DataFrame, height: int) -> DataFrame:
    """The nodes of blocks with their paths: runs first, so no row copies more than a few hundred digests."""
    def run(r: Column) -> Column:
        held = [F.substring(F.col(f"l{n}"), F.floor(r / FANOUT**n).cast("int") * _RUN + 1, F.lit(_RUN)).alias(f"s{n}") for n in range(height)]
        return F.struct(r.alias("r"), F.slice("items", r * FANOUT + 1, FANOUT).alias("own"), *held)

    runs = blocks.select("tree", "block", "total", "higher", "root", "whole", F.explode(F.transform(F.sequence(F.lit(0), ((F.size("items") - 1) / FANOUT).cast("int")), run)).alias("run"))
    nodes = runs.select("tree", "block", "total", "higher", "root", "whole", "run", F.posexplode("run.own").alias("k", "item"))
    steps = []
    for n in range(height):
        k = F.col("k") if n == 0 else F.floor(F.col("run.r") / FANOUT ** (n - 1)).cast("int") % FANOUT
        held = F.col(f"run.s{n}")
        step = F.struct(F.substring(held, F.lit(1), k * DIGEST).alias("before"), F.substring(held, (k + 1) * DIGEST + 1, F.lit(_RUN)).alias("after"))
        steps.append(F.when(F.col("total") > FANOUT**n, step))
    path = F.concat(F.filter(F.array(*steps), lambda s: s.isNotNull()), F.col("higher"))
    pos = F.col("block") * FANOUT**height + F.col("run.r") * FANOUT + F.col("k")
    return nodes.select("tree", pos.alias("pos"), "item", "root", "whole", path.alias("path"))
