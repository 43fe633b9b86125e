"""Approximate nearest neighbours by learned partitions (operator 5).

On a bounded sample a nearest-neighbour graph is cut into balanced parts, and a small
classifier (one hidden layer) learns the part of a vector. Every vector is indexed in its
most probable part; a query goes to the several most probable parts and what they hold is
ranked by the exact inner product. How many parts a query visits is set on queries of the
sample whose true neighbours are known.

Equal vectors are indexed once, with as many of their smallest ids as a result can need.
A part is dealt into shards of vectors and blocks of queries, so that no group of either
grows with the data; the best of each shard are merged.

Defined results: vectors that are null, zero, or hold a null or non-finite component take
no part, neither do those of another dimension than most. A row without vec_id takes no
part. Rows that repeat vec_id and vector count once, rows with one vec_id and different
vectors each. With fewer candidates than asked for, all are returned. An empty table gives
no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.session import cut_lineage

#: Expected number of vectors the partition and the classifier are learned from.
SAMPLE = 8_000
#: Vectors of the sample in a part.
PART = 250
NEIGHBOURS = 10
HIDDEN = 128
EPOCHS = 40
#: Share of the true neighbours that queries of the sample must find.
RECALL = 0.94
#: Vectors in a shard and queries in a block, about.
SHARD = 20_000
BLOCK = 4_000
SPREAD = 64


@dataclass
class Router:
    """Standardization and the two layers of the classifier, and how many parts to visit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return len(self.b2)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def route(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The most probable parts, best first."""
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, :visits]


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k best by inner product, itself left out."""
    out = np.zeros((len(x), min(k, len(x) - 1)), np.int64)
    for a in range(0, len(x), 1000):
        s = x[a : a + 1000] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 1000] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Cut the graph into parts of nearly equal size with few edges between them.

    Halving along the widest direction gives equal parts; then nodes move to the part most
    of their neighbours, either way, are in, best gain first, while the part has room.
    """
    label = np.zeros(len(x), np.int64)
    pending = [(np.arange(len(x)), parts)]
    used = 0
    while pending:
        rows, n = pending.pop()
        if n == 1 or len(rows) < 2:
            label[rows] = used
            used += 1
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        axis = np.linalg.svd(centred[:2000], full_matrices=False)[2][0]
        order = np.argsort(centred @ axis, kind="stable")
        half = len(rows) * (n // 2) // n
        pending += [(rows[order[:half]], n // 2), (rows[order[half:]], n - n // 2)]
    room = int(np.ceil(1.1 * len(x) / parts))
    source = np.repeat(np.arange(len(x)), graph.shape[1])
    ends = graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.float32)
        np.add.at(votes, (source, label[ends]), 1)
        np.add.at(votes, (ends, label[source]), 1)
        wanted = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), wanted] - votes[np.arange(len(x)), label]
        size = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[wanted[i]] < room:
                size[label[i]] -= 1
                size[wanted[i]] += 1
                label[i] = wanted[i]
                moved += 1
        if not moved:
            break
    return label


def train(x: np.ndarray, label: np.ndarray, parts: int) -> Router:
    """A small network by mini-batches with Adam."""
    order = np.random.default_rng(0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = (x - mean) / scale
    p = [
        order.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        order.normal(0, np.sqrt(2 / HIDDEN), (HIDDEN, parts)), np.zeros(parts),
    ]
    first, second = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p]
    t = 0
    for _ in range(EPOCHS):
        for rows in np.array_split(order.permutation(len(z)), max(1, len(z) // 128)):
            h = np.maximum(z[rows] @ p[0] + p[1], 0)
            s = h @ p[2] + p[3]
            s = np.exp(s - s.max(axis=1, keepdims=True))
            d = s / s.sum(axis=1, keepdims=True)
            d[np.arange(len(rows)), label[rows]] -= 1
            d /= len(rows)
            back = (d @ p[2].T) * (h > 0)
            t += 1
            for k, g in enumerate((z[rows].T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0))):
                g = g + 1e-4 * p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Router(mean, scale, *p, probes=parts)


def fit(x: np.ndarray, k: int) -> Router:
    """Learn parts from sample vectors; a tenth of them stays out of it and sets the number of probes."""
    parts = max(1, len(x) // PART)
    if parts == 1:
        d = x.shape[1] if x.ndim == 2 and len(x) else 1
        return Router(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    apart = np.arange(len(x)) % 10 == 0
    own = x[~apart]
    router = train(own, balanced_parts(own, neighbour_graph(own, NEIGHBOURS), parts), parts)
    at = router.route(own, 1)[:, 0]
    truth = at[np.argsort(-(x[apart] @ own.T), axis=1, kind="stable")[:, :k]]
    visits = router.route(x[apart], parts)
    for probes in range(1, parts + 1):
        found = (truth[:, :, None] == visits[:, None, :probes]).any(axis=2).mean()
        if found >= RECALL:
            break
    router.probes = probes
    return router


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0)).distinct()


def dealt(size: int, per: int, key: Column, salt: int) -> Column:
    """A number below size / per, by a hash."""
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(max(1, -(-size // per)))).cast("int")


def nearest(vectors: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that `queries` selects."""
    spark = vectors.sparkSession
    rows = usable(vectors).withColumn("q", queries)
    # A query itself may be among its vector's copies, hence one more. Large groups of copies shrink in two steps.
    # Zeros of either sign are equal here as in the product.
    parted = rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x))).withColumn("h", F.xxhash64("v")).withColumn("salt", F.pmod("vec_id", F.lit(SPREAD)))
    few = parted.withColumn("n", F.row_number().over(Window.partitionBy("h", "v", "salt").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    kinds = few.groupBy("h", "v").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    kinds = cut_lineage(kinds.withColumn("kind", F.col("ids")[0]))
    count = kinds.count()
    share = min(1.0, SAMPLE / max(count, 1))
    chosen = kinds.where(F.pmod(F.xxhash64(F.lit(5), "kind"), F.lit(1 << 30)) < int(share * (1 << 30))).select("kind", "v").toArrow().sort_by("kind")
    sample = np.array(chosen["v"].to_pylist(), np.float64)
    router = fit(sample, k)
    held = spark.sparkContext.broadcast(router)

    def placed(frame: DataFrame, visits: int) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column("v"))
                parts = held.value.route(x, visits).astype(np.int32)
                at = pa.array(np.repeat(np.arange(len(x)), visits))
                yield pa.RecordBatch.from_arrays([batch.column("kind").take(at), batch.column("v").take(at), pa.array(parts.ravel())], names=["kind", "v", "part"])

        return frame.select("kind", "v").mapInArrow(each, "kind bigint, v array<double>, part int")

    asking = cut_lineage(parted.where("q").join(kinds.select("h", "v", "kind"), ["h", "v"]).select("vec_id", "kind"))
    asked = kinds.join(asking.select("kind").distinct(), "kind", "left_semi")
    n_asked = asked.count()
    need = k + 1

    def search(asked: DataFrame, visits: int) -> DataFrame:
        blocks, shards = max(1, -(-n_asked * visits // (BLOCK * router.parts))), max(1, -(-count // (SHARD * router.parts)))
        there = placed(kinds, 1).withColumn("shard", dealt(shards, 1, F.col("kind"), 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        here = placed(asked, visits).withColumn("block", dealt(blocks, 1, F.col("kind"), 2)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        group = ["part", "shard", "block"]

        def rank(left: pa.Table, right: pa.Table) -> pa.Table:
            names, x = left["kind"].to_numpy(), _matrix(left["v"].combine_chunks()) if left.num_rows else None
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            if left.num_rows and right.num_rows:
                y = _matrix(right["v"].combine_chunks())
                asks = right["kind"].to_numpy()
                for a in range(0, len(y), 500):
                    s = y[a : a + 500] @ x.T
                    m = min(need + 4, s.shape[1])
                    best = np.argpartition(-s, m - 1, axis=1)[:, :m]
                    # The same sum for a pair wherever it stands, so that ties are ties.
                    exact = (y[a : a + 500, None, :] * x[best]).sum(axis=2)
                    out.append((np.repeat(asks[a : a + 500], m), names[best].ravel(), exact.ravel()))
            q, c, s = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            return pa.table({"ask": pa.array(q, pa.int64()), "kind": pa.array(c, pa.int64()), "score": pa.array(s, pa.float64())})

        return there.groupBy(group).cogroup(here.groupBy(group)).applyInArrow(rank, "ask bigint, kind bigint, score double")

    def best(found: DataFrame) -> DataFrame:
        """The kinds a query needs, then their ids in the order of the result."""
        top = Window.partitionBy("ask").orderBy(F.desc("score"), "kind")
        kept = found.withColumn("n", F.row_number().over(top)).where(F.col("n") <= need)
        ids = kept.join(kinds.select("kind", "ids"), "kind").select("ask", F.explode("ids").alias("vec_id"), "score")
        listed = ids.groupBy("ask").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "score"))).alias("list"))
        return listed.select("ask", F.slice("list", 1, need).alias("list"))

    result = cut_lineage(best(search(asked, router.probes)))
    enough = F.size("list") >= min(need, rows.count())
    if router.probes < router.parts:
        # Where the parts visited hold too few, all are searched.
        short = asked.join(result.where(enough).select(F.col("ask").alias("kind")), "kind", "left_anti")
        if not short.isEmpty():
            result = result.where(enough).unionByName(best(search(short, router.parts)))
    named = asking.join(result, asking["kind"] == result["ask"])
    others = named.select(F.col("vec_id").alias("query_id"), F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("vec_id")), 1, k).alias("list"))
    return others.select("query_id", F.posexplode("list").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)
