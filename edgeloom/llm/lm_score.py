"""Cross-entropy difference of two n-gram language models (operator 10).

Tokens are characters, lower case, all told apart. Both models, of the target documents and
of all documents as background, share one vocabulary (the characters of the corpus and one
symbol for the start), one order and one smoothing (interpolated Witten-Bell). Counts and
losses are tables keyed by n-gram, which grow with the corpus. A document's score is the mean
over its tokens of target loss minus background loss: lower means closer to the target.

Documents meet the table of losses where they are while it is small enough to be sent, else
their distinct n-grams are joined to it; scores are the same.

Defined results: a null or empty text has no token, null losses and score 0. Rows that
repeat a doc_id keep a row each, and count each. Without target rows both losses follow
the same smoothing, and the target model is uniform. An empty table gives no row. Other
columns are ignored. Where `symbols` is given, only the most frequent characters are told
apart, with one symbol for the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import broadcast_if_small, id_and_text, slices, text_key
from edgeloom.session import cut_lineage

ORDER = 4
#: Bits of a symbol (a code point and two more), and of those of a context in 63.
BITS = 21
#: Target ids that are sent to all executors, some 3 MB; more are joined by a shuffle of the texts.
SMALL = 200_000
#: N-grams with losses that are sent to all executors, some 50 MB; more are joined.
SENT = 2_000_000


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def vocabulary(docs: DataFrame, symbols: int) -> list[int]:
    """The most frequent characters, ties to the smaller one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(0x110000, np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                found = np.bincount(code_points("".join(texts[a:b])))
                sums[: len(found)] += found
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(sums[used])], names=["point", "n"])

    counted = id_and_text(docs).select("text").mapInArrow(count, "point bigint, n bigint").groupBy("point").agg(F.sum("n").alias("n"))
    return [r["point"] for r in counted.orderBy(F.desc("n"), "point").limit(symbols - 2).collect()]


def symbol_table(points: list[int] | None) -> np.ndarray:
    """The symbol of each code point: 0 is the start, 1 is any other."""
    if points is None:
        return np.arange(2, 0x110002, dtype=np.int64)
    table = np.ones(0x110000, np.int64)
    table[points] = np.arange(2, 2 + len(points))
    return table


def grams(texts: list[str], table: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of the texts as contexts and last symbols, the number of that of each token, and the tokens of each text."""
    found = [table[code_points(t)] for t in texts]
    sizes = np.array([len(x) for x in found], np.int64)
    start = np.zeros(order - 1, np.int64)
    used, s = np.unique(np.concatenate([y for x in found for y in (start, x)]) if found else start, return_inverse=True)
    width = max(1, int(len(used) - 1).bit_length())
    # Windows of order symbols, without those that end in a start.
    ends = np.arange(int(sizes.sum())) + np.repeat(np.arange(1, len(sizes) + 1) * (order - 1), sizes)
    columns = [s[ends - k] for k in range(order)]  # the last symbol first
    if width * order <= 63:
        code = sum((c.astype(np.int64) << (width * k) for k, c in enumerate(columns)), np.zeros(len(ends), np.int64))
        code, number = np.unique(code, return_inverse=True)
        columns = [(code >> (width * k)) & ((1 << width) - 1) for k in range(order)]
    else:
        columns, number = np.unique(np.stack(columns), axis=1, return_inverse=True)
    context = np.zeros(len(columns[0]), np.int64)
    for k in range(order - 1, 0, -1):
        context = (context << BITS) | used[columns[k]]
    return context, used[columns[0]], number.reshape(-1), sizes


def gram_counts(docs: DataFrame, target: DataFrame, points: list[int] | None, order: int = ORDER) -> DataFrame:
    """(context, symbol, target, every): how often each n-gram occurs in target documents and in all. `target` has the doc_ids (distinct)."""
    marked = id_and_text(docs).join(target.withColumn("t", F.lit(True)), "doc_id", "left").select("text", F.coalesce("t", F.lit(False)).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = symbol_table(points)
        for batch in batches:
            texts, inside = batch.column("text").to_pylist(), np.array(batch.column("t").to_pylist(), bool)
            for a, b in slices(texts):
                context, symbol, number, sizes = grams(texts[a:b], table, order)
                own = np.bincount(number[np.repeat(inside[a:b], sizes)], minlength=len(context))
                every = np.bincount(number, minlength=len(context))
                for k in range(0, len(context), 100_000):
                    at = slice(k, k + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (context, symbol, own, every)], names=["context", "symbol", "target", "every"])

    found = marked.mapInArrow(count, "context bigint, symbol bigint, target bigint, every bigint")
    return found.groupBy("context", "symbol").agg(F.sum("target").alias("target"), F.sum("every").alias("every"))


def losses(counts: DataFrame, symbols: int, order: int = ORDER) -> DataFrame:
    """(context, symbol, target, every): minus the log probability of the symbol, interpolated Witten-Bell."""
    lower = None
    for n in range(1, order + 1):
        short = F.col("context").bitwiseAND(F.lit((1 << BITS * (n - 1)) - 1))
        own = counts.groupBy(short.alias("context"), "symbol").agg(F.sum("target").alias("target"), F.sum("every").alias("every"))
        sums = own.groupBy("context").agg(*(f for m in ("target", "every") for f in (F.sum(m).alias(f"{m}_total"), F.count_if(F.col(m) > 0).alias(f"{m}_kinds"))))
        if lower is None:
            own = own.withColumns({f"{m}_below": F.lit(1 / symbols) for m in ("target", "every")})
        else:
            before = F.col("context").bitwiseAND(F.lit((1 << BITS * (n - 2)) - 1))
            own = own.withColumn("shorter", before).join(lower.select(F.col("context").alias("shorter"), "symbol", *(F.col(m).alias(f"{m}_below") for m in ("target", "every"))), ["shorter", "symbol"])

        def mixed(m: str):
            total, kinds, below = (F.col(f"{m}_{x}") for x in ("total", "kinds", "below"))
            return F.when(total > 0, (F.col(m) + kinds * below) / (total + kinds)).otherwise(below).alias(m)

        lower = own.join(sums, "context").select("context", "symbol", mixed("target"), mixed("every"))
    return lower.select("context", "symbol", (-F.log("target")).alias("target"), (-F.log("every")).alias("every"))


class Table:
    """Losses to look up by n-gram, in the order of a number of the n-gram."""

    def __init__(self, context: np.ndarray, symbol: np.ndarray, losses: list[np.ndarray], order: int):
        self.order, self.used = order, np.unique(np.concatenate([[0], symbol]))
        self.width = max(1, int(len(self.used) - 1).bit_length())
        self.fits = self.width * order <= 63
        if self.fits:
            key = self.key(context, symbol)
            by = np.argsort(key)
            self.keys, self.losses = key[by], [x[by] for x in losses]

    def key(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """All their symbols are in use: the start or the last of some n-gram."""
        out = np.searchsorted(self.used, symbol)
        for k in range(self.order - 1):
            out = out | (np.searchsorted(self.used, (context >> (BITS * k)) & ((1 << BITS) - 1)) << (self.width * (k + 1)))
        return out


SCORED = "n_tokens bigint, target_loss double, background_loss double, score double"


def score_by_sent_table(docs: DataFrame, points: list[int] | None, table: Table) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (means) and score, their difference."""
    held = docs.sparkSession.sparkContext.broadcast(table)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, table = symbol_table(points), held.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                context, symbol, number, sizes = grams(texts[a:b], symbols, table.order)
                at = np.searchsorted(table.keys, table.key(context, symbol))[number]
                own = np.repeat(np.arange(len(sizes)), sizes)
                t, e = (np.bincount(own, x[at], len(sizes)) / np.maximum(sizes, 1) for x in table.losses)
                none = sizes == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(sizes), pa.array(t, mask=none), pa.array(e, mask=none), pa.array(t - e)],
                    names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
                )

    return id_and_text(docs).mapInArrow(each, f"doc_id bigint, {SCORED}")


def score_by_join(docs: DataFrame, points: list[int] | None, table: DataFrame, order: int = ORDER) -> DataFrame:
    """The same from a join of each document's distinct n-grams with the table."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = symbol_table(points)
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                context, symbol, number, sizes = grams([text], symbols, order)
                n = np.bincount(number, minlength=len(context))
                same = (np.full(len(n), x, np.int64) for x in (key, sizes[0]))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*same, context, symbol, n)], names=["key", "n_tokens", "context", "symbol", "n"])

    texts = id_and_text(docs).withColumn("key", text_key(F.col("text")))
    asked = texts.select("key", "text").mapInArrow(each, "key bigint, n_tokens bigint, context bigint, symbol bigint, n bigint")
    # Copies of a text add to the sums and to their number alike.
    means = (F.sum(F.col("n") * F.col(m)) / F.sum("n") for m in ("target", "every"))
    scored = asked.join(table, ["context", "symbol"]).groupBy("key", "n_tokens").agg(*(x.alias(m) for x, m in zip(means, ("target_loss", "background_loss"), strict=True)))
    rows = texts.select("doc_id", "key").join(scored, "key", "left")
    return rows.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "target_loss", "background_loss", F.coalesce(F.col("target_loss") - F.col("background_loss"), F.lit(0.0)).alias("score"))


def cross_entropy_difference(docs: DataFrame, target: DataFrame, symbols: int | None = None, order: int = ORDER, sent: int = SENT) -> DataFrame:
    """Score all documents against the model of those whose doc_id is in `target`."""
    if (order - 1) * BITS > 63:
        raise ValueError("a context has three symbols at most")
    points = vocabulary(docs, symbols) if symbols else None
    wanted = cut_lineage(target.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct())
    counts = cut_lineage(gram_counts(docs, broadcast_if_small(wanted, SMALL), points, order))
    table = cut_lineage(losses(counts, symbols or counts.select("symbol").distinct().count() + 1, order))
    if table.count() <= sent:
        found = table.toArrow()
        held = Table(*(found[c].to_numpy() for c in ("context", "symbol")), [found[c].to_numpy() for c in ("target", "every")], order)
        if held.fits:
            return score_by_sent_table(docs, points, held)
    return score_by_join(docs, points, table, order)
