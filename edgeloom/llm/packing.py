"""Best-fit packing of documents into sequences of at most so many tokens (operator 2).

Bin completion works on the histogram of piece lengths, which the sequence length bounds
whatever the data: around the largest piece left, undominated fillings of the rest of the
sequence are enumerated, a branch is cut when its waste can no longer beat the incumbent,
and best-fit solutions are the incumbents: of all pieces, and, where that misses the lower
bound, of the largest pieces by themselves with the fullest fillings of the rest, for
several shares of largest pieces. The search stops at the bound or after NODES branches,
each with WIDTH fillings at most, so a solution above the bound may not be the best. A
filling is used as often as the counts allow, so a solution is a short list of patterns. Spark then ranks the pieces of each length and
the pattern that owns a rank gives the piece its sequence and offset.

Defined results: a null text is empty and yields the piece that holds the separator id
alone. Rows with the same doc_id are separate documents. An empty table gives no piece.
Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import few_rows, id_and_text
from edgeloom.llm.tokens import default_tokenizer, encoder
from edgeloom.session import cut_lineage

#: Branches tried beyond the incumbent, and fillings tried at a node.
NODES = 3_000
WIDTH = 4
#: Shares of the pieces that incumbents pack by themselves; a fullest filling is used for one in so many of what it could serve.
SHARES = [k / 48 for k in range(46)]
SPREAD = 4
#: Pieces of one length that one task ranks.
RANKED = 50_000

Pattern = tuple[tuple[int, ...], int]


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, separator: int = 0) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32. The first piece of a cut document takes the remainder."""
    tokenizer = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, last = encoder(tokenizer), np.array([separator], "<u4")
        for batch in few_rows(batches):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tool.encode(batch.column("text").to_pylist()), strict=True):
                ids = np.concatenate([ids, last])
                start, length = 0, (len(ids) - 1) % capacity + 1
                for k in range((len(ids) - 1) // capacity + 1):
                    rows.append((doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                    start, length = start + length, capacity
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs).mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: total length, and for each threshold the pieces that can't share (Martello and Toth)."""
    sizes = sorted(counts)
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    for small in [0, *(s for s in sizes if s <= capacity // 2)]:
        alone = sum(counts[s] for s in sizes if s > capacity - small)
        large = {s: counts[s] for s in sizes if capacity // 2 < s <= capacity - small}
        room = sum(large.values()) * capacity - sum(s * n for s, n in large.items())
        rest = sum(s * counts[s] for s in sizes if small <= s <= capacity // 2)
        best = max(best, alone + sum(large.values()) + max(0, -(-(rest - room) // capacity)))
    return best


def fillings(counts: dict[int, int], order: list[int], room: int, most: int) -> list[tuple[int, ...]]:
    """Undominated fillings of `room` by one to three pieces and then best fit, least waste first.

    `order` has the lengths left, largest first. A filling goes when an equally long or
    longer one of fewer pieces exists: the fewer, larger pieces are harder to place later.
    """
    import bisect

    rising = order[::-1]

    def largest(limit: int, but: tuple[int, ...]) -> int:
        """The largest length up to the limit that is still there beside those taken."""
        k = bisect.bisect_right(rising, limit) - 1
        while k >= 0 and counts[rising[k]] <= but.count(rising[k]):
            k -= 1
        return rising[k] if k >= 0 else 0

    first = largest(room, ())
    if not first:
        return [()]
    found, reached = [(first,)], first
    if first < room:
        pairs = []
        for a in [s for s in order if s <= room]:
            b = largest(min(a, room - a), (a,))
            if b and a + b > reached:
                pairs.append((a, b))
                if a + b == room:
                    break
        pairs.sort(key=lambda p: (-sum(p), -p[0]))
        found += pairs[:most]
        reached = max([reached, *(sum(p) for p in pairs)])
    if reached < room:
        triples = []
        for a in [s for s in order if s <= room][:200]:
            for b in [s for s in order if s <= min(a, room - a)][:40]:
                if counts[a] <= (a == b):
                    continue
                c = largest(min(b, room - a - b), (a, b))
                if c and a + b + c > reached:
                    triples.append((a, b, c))
            if triples and sum(triples[-1]) == room:
                break
        triples.sort(key=lambda p: (-sum(p), -p[0]))
        found += triples[:most]
    out = []
    for one in found:  # small pieces may still fit
        used, rest = list(one), room - sum(one)
        while rest and (s := largest(rest, tuple(used))):
            used.append(s)
            rest -= s
        out.append(tuple(used))
    out = sorted(dict.fromkeys(out), key=lambda p: (-sum(p), len(p), tuple(-s for s in p)))
    return out[:1] if sum(out[0]) == room else out[:most]


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing by patterns: around the largest piece, the largest that fits, again and again."""
    left, done = dict(counts), []
    order = sorted(left, reverse=True)
    while order:
        used, rest = [order[0]], capacity - order[0]
        for s in order:
            while s <= rest and left[s] > used.count(s):
                used.append(s)
                rest -= s
        done.append(_use(left, tuple(used)))
        order = [s for s in order if left[s]]
    return done


def _use(left: dict[int, int], used: tuple[int, ...]) -> Pattern:
    """Take a pattern as often as the counts allow."""
    each = {s: used.count(s) for s in set(used)}
    times = min(left[s] // n for s, n in each.items())
    for s, n in each.items():
        left[s] -= times * n
    return used, times


def fullest(left: dict[int, int], order: list[int], room: int) -> tuple[int, ...]:
    """Lengths that are left with the largest sum within the room; of equal sums one of long lengths. `order` has the largest first."""
    reach, steps, inside = 1, [], (1 << (room + 1)) - 1  # bit n: the sum n can be had
    for s in order:
        many, lot = min(left[s], room // s), 1
        while many > 0:
            taken = min(lot, many)
            steps.append((s, taken, reach))
            reach |= (reach << (s * taken)) & inside
            many, lot = many - taken, lot * 2
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, []
    for s, taken, before in reversed(steps):
        if not before >> at & 1:
            used += [s] * taken
            at -= s * taken
    return tuple(sorted(used, reverse=True))


def fullest_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Around the largest piece the fullest filling, again and again; only a part of the counts goes to one pattern, as later ones need the same lengths."""
    left, done = dict(counts), []
    order = sorted((s for s in left if left[s]), reverse=True)
    while order:
        left[order[0]] -= 1
        used = (order[0], *fullest(left, order, capacity - order[0]))
        left[order[0]] += 1
        each = {s: used.count(s) for s in set(used)}
        times = max(1, min(left[s] // n for s, n in each.items()) // SPREAD)
        for s, n in each.items():
            left[s] -= times * n
        done.append((used, times))
        order = [s for s in order if left[s]]
    return done


def incumbent(counts: dict[int, int], capacity: int, bound: int) -> list[Pattern]:
    """The best of best fit and of its solutions of the largest pieces alone with the fullest fillings of the rest."""
    best, total = best_fit(counts, capacity), sum(counts.values())
    for share in SHARES:
        if sum(n for _, n in best) <= bound:
            break
        top, rest, wanted = {}, dict(counts), int(total * share)
        for s in sorted(counts, reverse=True):
            top[s] = min(counts[s], wanted)
            rest[s] -= top[s]
            wanted -= top[s]
        found = best_fit({s: n for s, n in top.items() if n}, capacity) + fullest_fit(rest, capacity)
        best = min(best, found, key=lambda p: sum(n for _, n in p))
    return best


def solve(counts: dict[int, int], capacity: int, nodes: int = NODES, width: int = WIDTH) -> list[Pattern]:
    """Patterns that place all pieces; depth-first branch and bound from the best-fit incumbent."""
    counts = {s: n for s, n in counts.items() if n}
    bound = lower_bound(counts, capacity)
    total = sum(s * n for s, n in counts.items())
    best = incumbent(counts, capacity, bound)
    fewest = sum(n for _, n in best)
    stack: list[tuple[dict[int, int], list[Pattern], int, int]] = [(counts, [], 0, 0)]
    while stack and fewest > bound and nodes:
        left, done, bins, waste = stack.pop()
        nodes -= 1
        order = sorted((s for s in left if left[s]), reverse=True)
        if not order:
            if bins < fewest:
                best, fewest = done, bins
            continue
        # With `fewest - 1` sequences, so much may be wasted in all.
        if waste > (fewest - 1) * capacity - total:
            continue
        big = order[0]
        beside = {**left, big: left[big] - 1}
        options = fillings(beside, [s for s in order if beside[s]], capacity - big, width)
        for filling in reversed(options):  # the best is popped first
            rest = dict(left)
            used, times = _use(rest, (big, *filling))
            stack.append((rest, [*done, (used, times)], bins + times, waste + times * (capacity - sum(used))))
    return best


def slots(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset): ranks from the first on go to sequences from the first on.

    Sorted by length and rank. Each pattern uses up what a length can give at its
    multiplicity, so there are fewer rows than capacity times its logarithm, whatever the data.
    """
    taken: dict[int, int] = {}
    rows, base = [], 0
    for used, times in patterns:
        at = 0
        for s in used:
            rows.append((s, taken.get(s, 0), base, at))
            taken[s] = taken.get(s, 0) + times
            at += s
        base += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def ranked(found: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Pieces with `rank`, from 0 within their length. A length that many pieces share is ranked in parts that are added up."""
    spark = found.sparkSession
    if not sizes:
        return found.withColumn("rank", F.lit(0).cast("bigint"))
    parts = spark.createDataFrame(pa.table({"length": pa.array(list(sizes), pa.int64()), "parts": pa.array([n // RANKED + 1 for n in sizes.values()], pa.int32())}))  # no Python on executors
    dealt = found.join(F.broadcast(parts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "parts")).drop("parts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    own = dealt.withColumn("place", F.row_number().over(within) - 1)
    return own.join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("place")).drop("salt", "base", "place")


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, separator: int = 0) -> DataFrame:
    """Pieces with sequence_id and offset."""
    found = cut_lineage(pieces(docs, capacity, tokenizer, separator))
    # As many rows as there are lengths: the capacity at most.
    sizes = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    table = slots(solve(sizes, capacity))
    # The number of pieces of a length is below 2**40, so both fit one sorted key.
    keys = (table[:, 0] << 40) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 40) + rank, side="right") - 1
            columns = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            columns |= {"sequence_id": pa.array(table[at, 2] + rank - table[at, 1], pa.int64()), "offset": pa.array(table[at, 3], pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    return ranked(found, sizes).mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
