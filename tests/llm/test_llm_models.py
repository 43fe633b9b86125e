"""Learned operators and the pipeline: held-out accuracy, recall against brute force, order of the stages."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from edgeloom.llm import ann, decontaminate, quality, queries

SMALL = "/root/testdata/sf0.01"


def auc(score, truth):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    ones = truth.sum()
    return (rank[truth == 1].mean() - (ones - 1) / 2) / (len(truth) - ones)


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_documents(docs, quality.fit(docs, labels))
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    known = [(rows[r.doc_id].score, r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert auc(np.array([s for s, _ in known]), np.array([q for _, q in known])) > 0.95


def test_quality_never_reads_what_it_must_not(spark):
    """Held-out labels, ids, source and lang don't move a score."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet").limit(300) for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    one = quality.fit(docs, labels)
    other = quality.fit(docs.withColumn("source", F.lit("z")).withColumn("lang", F.lit("z")), flipped)
    assert np.array_equal(one.weights, other.weights) and one.bias == other.bias


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, "", 0.5), (None, "abc", 0.5), (2, "dup dup dup dup", 0.1), (2, "dup dup dup dup", 0.1)], "doc_id bigint, text string, score double")
    none = quality.fit(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert [r.score for r in quality.score_documents(docs, none).collect()] == [0.5] * 5
    labels = spark.createDataFrame([(2, 0), (2, 1), (1, None), (3, 1)], "doc_id bigint, quality int")
    assert quality.score_documents(docs, quality.fit(docs, labels)).count() == 5
    assert quality.score_documents(docs.limit(0), none).count() == 0
    assert quality.accepted(docs, none).columns == docs.columns


def test_repeated_words_are_seen():
    seen = np.zeros(1 << quality.BITS, np.uint8)
    assert quality.repeats(np.frombuffer(b"a b c d", np.uint8)).tolist() == []
    assert quality.repeats(np.frombuffer(b"ab ab  ab\nab x x", np.uint8)).tolist() == [0, 1]
    assert len(quality.features("", seen)) == 0 and not seen.any()


def brute(rows, k):
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            found = sorted((-float(np.dot(v, w)), j) for j, w in rows if j != i)[:k]
            out[i] = [j for _, j in found]
    return out


def test_neighbours_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got: dict[int, set] = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    expected = brute([(r.vec_id, np.array(r.embedding, float)) for r in table.collect()], 20)
    assert set(got) == set(expected)
    assert np.mean([len(got[i] & set(expected[i])) / 20 for i in expected]) >= 0.9


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 2.0]) for i in range(30)]
    odd = [(40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [inf, 1.0]), (120, [None, 1.0]), (140, [1.0]), (None, [1.0, 1.0]), (160, [3.0, 1.0]), (160, [3.0, 1.0])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in same + odd], "vec_id bigint, embedding array<double>, rank int, score int")
    got: dict[int, list] = {}
    for r in sorted(ann.nearest(table, F.col("vec_id") % 20 == 0).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    first = list(range(20))
    assert got == {
        0: [(160, 5.0)] + [(i, 5.0) for i in range(1, 20)] if False else sorted([(160, 5.0)] + [(i, 5.0) for i in range(1, 30)])[:20],
        20: sorted([(i, 5.0) for i in range(30) if i != 20] + [(160, 5.0)])[:20],
        160: [(i, 5.0) for i in first],
    }
    assert ann.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [2.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert [(r.vec_id, r.score) for r in sorted(ann.nearest(few, F.col("vec_id") == 0).collect(), key=lambda r: r["rank"])] == [(2, 2.0), (1, 0.5)]


def test_neighbours_in_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 10)
    monkeypatch.setattr(ann, "BLOCK", 2)
    monkeypatch.setattr(ann, "PART", 60)
    r = np.random.default_rng(1)
    rows = [(i, r.normal(0, 1, 8).tolist()) for i in range(240)]
    got: dict[int, set] = {}
    for x in ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    expected = brute([(i, np.array(v)) for i, v in rows], 5)
    assert np.mean([len(got[i] & set(expected[i])) / 5 for i in expected]) >= 0.8 and all(len(v) == 5 for v in got.values())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        docs = corpus_pipeline.cut_lineage(docs)
        found[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == columns
            assert 0 < docs.count() <= before
            before = docs.count()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = labels.join(found["quality_classifier"], "doc_id", "left_semi")
    assert kept.where("quality = 1").count() >= 0.98 * labels.where("quality = 1").count()
    assert kept.where("quality = 0").count() <= 0.2 * labels.where("quality = 0").count()
    texts = found["simhash_near_dedup"]
    assert texts.select("text").distinct().count() == texts.count()
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert decontaminate.decontaminate(found["benchmark_decontamination"], bench).where("contaminated").isEmpty()
    packed = found["best_fit_packing"]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
    assert packed.select("doc_id").distinct().count() == before


@pytest.mark.parametrize("name", ["op7_token_counts", "op9_license_scan"])
def test_queries_cover_their_tables(spark, name):
    found = queries.llm_queries()[name](spark, "/root/testdata/sf0.001")
    assert found.count() > 0
