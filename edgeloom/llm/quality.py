"""Quality classifier: naive Bayes support vectors (operator 6).

Features are indicators of hashed byte n-grams and of runs of repeated words, each scaled
by the log ratio of its smoothed class frequencies over all training rows. A linear
hinge-loss model of the scaled indicators is fitted by dual coordinate descent on a bounded
sample of them, and Platt's sigmoid, fitted on a fold that took no part, turns margins into
probabilities.

Folds are crc32(doc_id as text) mod 5: fold 0 is never learned from, fold 1 calibrates,
the others train. labels, lang, source and doc_id are never inputs of a score.

Defined results: null and empty texts have no feature and get the score of the bias. Rows
that repeat a doc_id keep a row each; of several labels of a doc_id the lowest counts, and
null labels don't. A null doc_id is never learned from and not held out. Without labels of
both classes every score is one half. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import broadcast_if_small, id_and_text
from edgeloom.session import cut_lineage

#: Hashed feature space; the model and the class counts have so many entries.
BITS = 18
ORDERS = (2, 3, 4)
#: Expected number of training rows the support vectors are fitted on, and of rows for calibration.
SAMPLE = 8_000
CALIBRATION = 4_000
#: The sample comes to the driver in so many pieces.
PIECES = 8
COST = 1.0
EPOCHS = 15
#: Share of the fitted weights; the rest is their mean size, as naive Bayes alone would have it.
MIX = 0.5
THRESHOLD = 0.3
#: Labels that are sent to all executors, some 5 MB; more are joined by a shuffle of the texts.
SMALL = 200_000


def features(text: str, seen: np.ndarray) -> np.ndarray:
    """Sorted feature numbers of a text. `seen` is a scratch array of zeros, and is again after the call."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    for start in range(0, len(data), 1 << 20):
        code = data[start : start + (1 << 20) + max(ORDERS) - 1].astype(np.uint32)
        h = code
        for n in range(2, max(ORDERS) + 1):
            if len(code) < n:
                break
            h = h[:-1] * np.uint32(16777619) ^ code[n - 1 :]
            if n in ORDERS:
                seen[(h * np.uint32(2654435761) + np.uint32(n)) >> np.uint32(32 - BITS)] = 1
    for run in repeats(data):
        seen[int(run)] = 1
    found = np.flatnonzero(seen)
    seen[found] = 0
    return found


def repeats(data: np.ndarray) -> np.ndarray:
    """Which n-grams of "equals the word before" occur: runs of 1, 2, 4, 8 and so on of them."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(starts) < 2:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        power = np.full(len(data) + 1, np.uint64(1099511628211))
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * power[:-1], dtype=np.uint64)])
        # Equal words have equal sums once both are brought to the same power.
        words = (total[ends] - total[starts]) * power[len(data) - starts]
    same = np.concatenate([[False], words[1:] == words[:-1], [False]])
    change = np.flatnonzero(np.diff(same.astype(np.int8)))
    longest = int((change[1::2] - change[::2]).max()) if len(change) else 0
    return np.arange(longest.bit_length(), dtype=np.int64)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, text: str, seen: np.ndarray) -> float:
        margin = float(self.weights[features(text, seen)].sum(dtype=np.float64)) + self.bias
        return _sigmoid(self.slope * margin + self.shift)


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))


def labelled(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """doc_id, text, fold and label (0 or 1) of the rows that may be learned from, in the shared folder."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column).cast("int").alias("label")).where("label in (0, 1)")
    known = known.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0").groupBy("doc_id", "fold").agg(F.min("label").alias("label"))
    texts = id_and_text(docs).where(fold(F.col("doc_id")) != 0)
    return cut_lineage(texts.join(broadcast_if_small(cut_lineage(known), SMALL), "doc_id"))


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """In how many rows of label 1 and of label 0 each feature occurs; each partition sends sums only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sums = np.zeros(1 << BITS, np.uint8), np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                sums[label][features(text, seen)] += 1
        used = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(sums[1][used]), pa.array(sums[0][used])], names=["feature", "ones", "zeros"])

    sums = rows.select("text", "label").mapInArrow(count, "feature bigint, ones bigint, zeros bigint")
    found = sums.groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).toArrow()  # 2**BITS rows at most
    out = np.zeros((2, 1 << BITS))
    at = found["feature"].to_numpy()
    out[0][at], out[1][at] = found["ones"].to_numpy(), found["zeros"].to_numpy()
    return out[0], out[1]


def sampled(rows: DataFrame, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels (1 and -1) of about `most` rows, chosen by a hash of doc_id, in the order of that hash."""
    total = rows.count()
    place = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30))
    chosen = rows.withColumn("place", place).where(F.col("place") < int(min(1.0, most / max(total, 1)) * (1 << 30)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, np.uint8)
        for batch in batches:
            found = [features(t, seen).astype("<u4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())], names=["place", "doc_id", "label", "found"])

    stored = cut_lineage(chosen.select("place", "doc_id", "label", "text").mapInArrow(each, "place bigint, doc_id bigint, label int, found binary"))
    keys, rows_of = [], []
    for k in range(PIECES):  # the driver holds the sample once, as it was received
        got = stored.where(F.pmod(F.xxhash64("place"), F.lit(PIECES)) == k).toArrow()
        rows_of += [np.frombuffer(x.as_buffer(), "<u4") for x in got["found"]]
        keys += zip(*(got[c].to_pylist() for c in ("place", "doc_id", "label")), strict=True)
    times = Counter(keys)  # the features decide between rows of one doc_id only
    order = sorted(range(len(keys)), key=lambda i: (*keys[i], rows_of[i].tobytes() if times[keys[i]] > 1 else b""))
    return [rows_of[i] for i in order], np.array([1.0 if keys[i][2] == 1 else -1.0 for i in order])


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the scaled indicators and bias that minimize the hinge loss with squared weights."""
    weights, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([float((ratio[x] ** 2).sum()) + 1 for x in rows])
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x = rows[i]
            scaled = ratio[x]
            gradient = labels[i] * (float(weights[x] @ scaled) + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), COST)
            if new != alpha[i]:
                step = (new - alpha[i]) * labels[i]
                weights[x] += step * scaled
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3 * COST:
            break
    return weights, bias


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid by Newton's method, with Platt's softened targets."""
    ones, zeros = int((labels > 0).sum()), int((labels < 0).sum())
    if not ones or not zeros:
        return 1.0, 0.0
    target = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([margins, np.ones_like(margins)])
    at = np.array([1.0, 0.0])

    def loss(v: np.ndarray) -> float:
        z = v @ x
        return float((np.logaddexp(0, z) - target * z).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -60, 60)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-9 * np.eye(2), x @ (p - target))
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE) -> Model:
    """Counts over all training rows, support vectors over a sample of about `sample` of them."""
    rows = labelled(docs, labels, column)
    training = rows.where("fold <> 1")
    ones, zeros = class_counts(training)
    none = Model(np.zeros(1 << BITS), 0.0, 1.0, 0.0)
    if not ones.any() or not zeros.any():
        return none
    ratio = np.log((ones + 1) / (ones + 1).sum()) - np.log((zeros + 1) / (zeros + 1).sum())
    ratio[ones + zeros == 0] = 0
    found, sides = sampled(training, sample)
    if len(set(sides)) < 2:
        return none
    weights, bias = dual_coordinate_descent(found, sides, ratio)
    weights = (MIX * weights + (1 - MIX) * np.abs(weights[ones + zeros > 0]).mean()) * ratio
    del found
    apart, truth = sampled(rows.where("fold = 1"), CALIBRATION)
    slope, shift = platt(np.array([float(weights[x].sum()) + bias for x in apart]), truth)
    del apart
    pa.default_memory_pool().release_unused()
    return Model(weights, bias, slope, shift)


def scorer(docs: DataFrame, model: Model) -> Callable[[Column], Column]:
    """A column function of texts; the model has a fixed size and is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.slope, model.shift))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, seen = Model(*held.value), np.zeros(1 << BITS, np.uint8)
        for texts in batches:
            yield pa.array([own.score(t, seen) for t in texts.to_pylist()], pa.float64())

    return lambda text: score(F.coalesce(text.cast("string"), F.lit("")))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = id_and_text(docs).select("doc_id", scorer(docs, model)(F.col("text")).alias("score"))
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents the classifier doesn't reject, with all their columns."""
    return docs.where(scorer(docs, model)(F.col("text")) >= THRESHOLD)
