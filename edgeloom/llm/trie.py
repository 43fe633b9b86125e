"""Prefix trie of conversations by a splitter skeleton (operator 13).

A conversation's path is the string of its turns' digests, of fixed width, so those with a
common beginning lie side by side when paths are sorted. Paths are dealt to shards by
sampled splitters. Only prefixes of splitters, the skeleton, may have members in several
shards; the splitters are broadcast, and a scan of each sorted shard finishes all other
nodes with a stack as deep as its paths. Skeleton nodes leave partial sums there, which are
added up; what a skeleton node needs of those below it is settled in one pass over the
skeleton, whose size is bounded: `SKELETON_BYTES` for all splitters, whatever the rows.

Copies of one conversation are split over shards by conv_id, as splitters have one. The ids
that end in a skeleton node travel in pieces of text and are hashed as a stream; in other
nodes the scan hashes them as they come.

Defined results: a null role or text is empty. Turns of the same number are ordered by
their digest; repeated rows are turns of their own. Rows without conv_id take no part. An
empty table gives no row, not even the root. Other columns are ignored. A conversation is
one row of 36 bytes a turn.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import ship_package
from edgeloom.session import cut_lineage

#: Characters of a turn's digest (128 bits), bytes of all splitters and of their sample, bytes of paths a shard has.
WIDTH, SKELETON_BYTES, SHARD_BYTES = 32, 16_000_000, 32_000_000
#: Sampled paths for each splitter; ids in a piece of text.
OVERSAMPLE, PIECE = 16, 5_000
NO_ENDS = hashlib.sha256().hexdigest()
_ROWS = 20_000
_SCAN = ("done boolean, conv_id bigint, depth bigint, parent_conv_id bigint, at bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
         "saved_tokens bigint, words bigint, ends_sha256 string, shard bigint, piece bigint, ends string")
_NAMES = [c.split()[0] for c in _SCAN.split(", ")]
_TYPES = [{"boolean": pa.bool_(), "bigint": pa.int64(), "string": pa.string()}[c.split()[1]] for c in _SCAN.split(", ")]


def paths_of(turns: DataFrame, family: int = 20, openings: int = 4) -> DataFrame:
    """conv_id, path and words (of each turn), of rebuilt conversations.

    A conversation begins with as many turns of its family's first (the id is a multiple of
    `family`) as the checksum of its id says, fewer than `openings`, and goes on with its own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, WIDTH)
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    own = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
    own = cut_lineage(own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    first = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, openings - 1).alias("opening"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % openings).cast("int")
    joined = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % family, "h": taken}).join(first, "base", "left")
    none = F.expr("cast(array() as array<struct<turn: bigint, digest: string, words: int>>)")
    rebuilt = F.concat(F.coalesce(F.slice("opening", F.lit(1), F.col("h")), none), F.slice("turns", F.col("h") + 1, F.size("turns")))
    whole = joined.select("conv_id", rebuilt.alias("turns"))
    return whole.select("conv_id", F.array_join(F.col("turns.digest"), "").alias("path"), F.col("turns.words").alias("words"))


def prefix_trie(paths: DataFrame, shards: int | None = None, piece: int = PIECE) -> DataFrame:
    """A row for each distinct prefix of paths (conv_id, path, words): conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256 (of the ids that end there, ascending)."""
    paths = cut_lineage(paths)
    spark = paths.sparkSession
    ship_package(spark)
    rows, size, longest = paths.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("path")), F.lit(0)), F.coalesce(F.max(F.length("path")), F.lit(0))).first()
    most = SKELETON_BYTES // (longest + 16)
    shards = min(shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES), max(2, most), max(1, rows))
    sent = spark.sparkContext.broadcast(_splitters(paths, shards, min(OVERSAMPLE * shards, max(2, most))))
    scanned = cut_lineage(_dealt(paths, sent, shards).mapInArrow(lambda batches: _scan(batches, sent.value, piece), _SCAN))
    skeleton = _reduced(scanned)
    done = scanned.where("done").drop("ends", "piece", "shard", "words", "done")
    own = done.where("at is null").drop("at")
    # The skeleton is bounded by SKELETON_BYTES, whatever the rows.
    above = F.broadcast(skeleton.select("at", F.col("depth").alias("above"), F.col("conv_id").alias("top")))
    under = done.where("at is not null").withColumn("above", F.col("depth") - 1).join(above, ["at", "above"]).withColumn("parent_conv_id", F.col("top"))
    ends = _ends(scanned.where("ends is not null").select("at", "depth", "shard", "piece", "ends"))
    skeleton = skeleton.join(ends, ["at", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return own.select(*columns).unionByName(under.select(*columns)).unionByName(skeleton.select(*columns))


def _splitters(paths: DataFrame, shards: int, sample: int) -> list[tuple[str, int]]:
    """Paths, with an id, at even places of a sample by hash; both bounded in bytes."""
    drawn = paths.select("path", "conv_id").orderBy(F.xxhash64("conv_id"), "conv_id").limit(sample)
    found = sorted((r.path, r.conv_id) for r in drawn.collect())
    return sorted({found[len(found) * k // shards] for k in range(1, shards)}) if found else []


def _dealt(paths: DataFrame, sent, shards: int) -> DataFrame:
    """The rows of each shard in a partition of its own, in order."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(sent.value, key) for key in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=["conv_id", "path", "words", "shard"])

    placed = paths.select("conv_id", "path", "words").mapInArrow(place, "conv_id bigint, path string, words array<int>, shard int")
    return placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")


class _Node:
    """A prefix that is still open in the scan of a shard."""

    __slots__ = ("at", "children", "ends", "hashed", "held", "least", "leaves", "n", "pieces", "saved", "sides", "words")

    def __init__(self, at: int | None, sides: tuple[str, ...], words: int):
        self.at, self.sides, self.words = at, sides, words  # its place in the skeleton; the splitters that it begins
        self.n = self.children = self.leaves = self.saved = self.pieces = 0
        self.least = self.hashed = None
        self.ends: list[str] = []
        self.held: list[list] = []  # children that wait for this node's smallest member


def _scan(batches: Iterator[pa.RecordBatch], splitters: list[tuple[str, int]], piece: int) -> Iterator[pa.RecordBatch]:
    """Finished nodes (`done`; with `at` where the parent is in the skeleton), partial sums of skeleton nodes, pieces of their ends."""
    out: list[list] = []
    stack: list[_Node] = []
    shard, last = None, ""

    def close() -> None:
        node, depth = stack.pop(), len(stack)
        parent = stack[-1] if stack else None
        if node.at is not None:
            flush(node, depth)
            node.saved += node.n * node.words
            out.append([False, node.least, depth, None, node.at, node.n, node.children, node.leaves, node.saved, node.words, None, None, None, None])
        else:
            node.leaves, node.saved = node.leaves or 1, node.saved + (node.n - 1) * node.words
            if node.ends:
                absorb(node)
            for row in node.held:
                row[3] = node.least
            out.extend(node.held)
            ends = NO_ENDS if node.hashed is None else node.hashed.hexdigest()
            row = [True, node.least, depth, None, parent.at, node.n, node.children, node.leaves, node.saved, None, ends, None, None, None]
            (out if parent.at is not None else parent.held).append(row)
            parent.children += 1
        if parent is not None:
            parent.n, parent.leaves, parent.saved = parent.n + node.n, parent.leaves + node.leaves, parent.saved + node.saved
            parent.least = node.least if parent.least is None else min(parent.least, node.least)

    def absorb(node: _Node) -> None:
        """Hash the ids that have come; a comma stands between two."""
        text = ",".join(node.ends).encode()
        if node.hashed is None:
            node.hashed = hashlib.sha256(text)
        else:
            node.hashed.update(b"," + text)
        node.ends.clear()

    def flush(node: _Node, depth: int) -> None:
        if node.ends:
            out.append([None, None, depth, None, node.at, None, None, None, None, None, None, shard, node.pieces, ",".join(node.ends)])
            node.pieces += 1
            node.ends.clear()

    for batch in batches:
        for conv_id, path, words, own in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "path", "words", "shard")), strict=True):
            if own != shard:
                while stack:
                    close()
                shard, last = own, ""
                # Of all splitters, those next to a shard have the longest prefixes in common with its paths.
                stack.append(_Node(0, tuple(s[0] for s in splitters[max(0, own - 1) : own + 1]), 0))
            if path != last:
                common = _common(path, last)
                while len(stack) - 1 > common:
                    close()
                for depth in range(common, len(path) // WIDTH):
                    turn = path[depth * WIDTH : (depth + 1) * WIDTH]
                    sides = tuple(s for s in stack[-1].sides if s[depth * WIDTH : (depth + 1) * WIDTH] == turn)
                    at = bisect_left(splitters, (path[: (depth + 1) * WIDTH],)) if sides else None
                    stack.append(_Node(at, sides, words[depth]))
                last = path
            top = stack[-1]
            top.n += 1
            top.least = conv_id if top.least is None else min(top.least, conv_id)
            top.ends.append(str(conv_id))
            if len(top.ends) >= piece:
                flush(top, len(stack) - 1) if top.at is not None else absorb(top)
            if len(out) >= _ROWS:
                yield _batch(out)
                out.clear()
    while stack:
        close()
    for k in range(0, len(out), _ROWS):
        yield _batch(out[k : k + _ROWS])


def _common(path: str, last: str) -> int:
    """Turns that two paths have in common, found by halving."""
    low, high = 0, min(len(path), len(last)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if path.startswith(last[low * WIDTH : mid * WIDTH], low * WIDTH):
            low = mid
        else:
            high = mid - 1
    return low


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def _reduced(scanned: DataFrame) -> DataFrame:
    """The skeleton: partial sums added up, then, in its own order, what nodes take from those below."""
    sums = scanned.where("not done").groupBy("at", "depth").agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("words").alias("words"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["at", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words"]
        rows = [list(r) for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in names), strict=True)]
        chain: list[int] = []  # numbers of the rows from the root to here
        above: list[int | None] = []
        for i, row in enumerate(rows):
            del chain[row[1] :]
            above.append(chain[-1] if chain else None)
            if chain:
                rows[chain[-1]][4] += 1
            chain.append(i)
        less = [[1 if row[4] == 0 else 0, row[7]] for row in rows]  # leaves of the skeleton, words counted once too often
        for i in range(len(rows) - 1, 0, -1):
            for k in (0, 1):
                less[above[i]][k] += less[i][k]
        for row, (leaves, words), parent in zip(rows, less, above, strict=True):
            row[5], row[6], row[7] = row[5] + leaves, row[6] - words, None if parent is None else rows[parent][2]
        for k in range(0, len(rows), _ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + _ROWS], strict=True)], names=[*names[:-1], "parent_conv_id"])

    schema = "at bigint, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, parent_conv_id bigint"
    # One task, as the skeleton is bounded. In this order a node comes after its parent.
    return cut_lineage(sums.coalesce(1).sortWithinPartitions("at", "depth").mapInArrow(settle, schema))


def _ends(pieces: DataFrame) -> DataFrame:
    """at, depth, ends_sha256: the pieces of each node's ids in order, hashed as they pass."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for at, depth, ends in zip(*(batch.column(c).to_pylist() for c in ("at", "depth", "ends")), strict=True):
                if (at, depth) == key:
                    state.update(b"," + ends.encode())
                else:
                    done += [(*key, state.hexdigest())] if key else []
                    key, state = (at, depth), hashlib.sha256(ends.encode())
            if done:
                yield row(done)
        if key:
            yield row([(*key, state.hexdigest())])

    def row(done: list[tuple]) -> pa.RecordBatch:
        at, depth, ends = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(depth, pa.int64()), pa.array(ends)], names=["at", "depth", "ends_sha256"])

    dealt = pieces.repartition("at", "depth").sortWithinPartitions("at", "depth", "shard", "piece").select("at", "depth", "ends")
    return dealt.mapInArrow(hashed, "at bigint, depth bigint, ends_sha256 string")
