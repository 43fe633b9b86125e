"""The pipeline as a whole on odd tables."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from edgeloom.llm import decontaminate, packing, quality, simhash, suffix_dedup
from edgeloom.llm.tokens import Encoder, default_tokenizer

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, __key string, __spans string, key bigint, row string, spans string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["tha", "re", "io", "un", "le"]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_stages_keep_clashing_columns_and_null_rows(spark):
    rows = [(1, prose(1, 80)), (1, prose(1, 80)), (2, None), (3, ""), (None, prose(2, 60)), (None, None), (4, prose(3, 50) + " " + prose(9, 60)), (5, prose(9, 60) + " " + prose(4, 50))]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or ""), "k", "s", 7, "r", "p") for i, t in rows], SCHEMA)
    for stage in (simhash.keep_one, suffix_dedup.without_repeats):
        out = stage(docs)
        assert out.columns == docs.columns and out.where("__key <> 'k' or __spans <> 's' or key <> 7 or row <> 'r' or spans <> 'p'").isEmpty()
        assert stage(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.count() == 5 and kept.where("doc_id = 1").count() == 1  # copies, and null texts with the empty one
    left = {r.doc_id: r for r in suffix_dedup.without_repeats(docs).where("doc_id in (4, 5)").collect()}
    assert all(r.n_chars == len(r.text) < 330 for r in left.values())


def test_run_on_empty_and_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame([(i, prose(i, 90), "en", "s", 1, "k", "s", 7, "r", "p") for i in range(12)] + [(None, None, None, None, None, "k", "s", 7, "r", "p")], SCHEMA)
    for name, part in (("full", docs), ("empty", docs.limit(0))):
        folder = str(tmp_path / name)
        part.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(0, prose(0, 90))] if name == "full" else [], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder)
        found = got.select("doc_id").distinct().collect()
        assert {r.doc_id for r in found} == (set(range(1, 12)) | {None} if name == "full" else set())
        assert got.agg(F.max(F.col("offset") + F.col("length"))).first()[0] in (None, *range(1, 2049))


def test_python_holds_few_texts_at_a_time():
    import pyarrow as pa

    from edgeloom.llm.common import few_rows

    texts = ["x" * 1000] * 500 + ["", None, "y" * 50_000] + ["z"] * 10
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(t, pa.string())}) for t in (texts, [], texts[:3])]
    parts = [b.column("text").to_pylist() for b in few_rows(iter(batches), 20_000)]
    assert sum(parts, []) == texts + texts[:3]
    assert max(len(p) for p in parts) <= 20


def test_executors_hold_few_texts_at_a_time(spark):
    def each(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs, before = spark.createDataFrame([], SCHEMA), spark.conf.get(key)
    for stage in (corpus_pipeline.simhash_near_dedup, corpus_pipeline.suffix_array_dedup, corpus_pipeline.best_fit_packing):
        spark.conf.unset(key)
        stage(spark, docs, "")
        sizes = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 2000) as text").mapInArrow(each, "n bigint")
        assert sizes.agg(F.max("n")).first()[0] <= 2_100_000
    spark.conf.set(key, before)


def workers(df):
    """The most steps in Python that one task of the plan runs, by Spark's text of it."""
    most, above = 0, []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [(d, n) for d, n in above if d < depth]
        n = 0 if "Exchange" in line else (above[-1][1] if above else 0) + ("MapInArrow" in line or "ArrowEvalPython" in line)
        above.append((depth, n))
        most = max(most, n)
    return most


def test_no_task_has_two_python_workers(spark, monkeypatch):
    written, cut = [], suffix_dedup.cut_lineage
    monkeypatch.setattr(suffix_dedup, "cut_lineage", lambda df: written.append(df) or cut(df))
    docs = spark.createDataFrame([(i, prose(8, 60) + " " + prose(i, 60) + " " + prose(9, 60), "en", "s", 1, "k", "s", 7, "r", "p") for i in range(6)], SCHEMA)
    written.append(suffix_dedup.without_repeats(docs))
    assert len(written) > 2 and max(map(workers, written)) == 1
    sizes = {1: 2, 5: packing.RANKED * 2}
    ranked = packing.ranked(spark.createDataFrame([], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint").repartition(1), sizes)
    assert "ExistingRDD[length" not in ranked._jdf.queryExecution().executedPlan().toString()


def test_cached_pieces_never_exceed_their_room():
    import sys

    tool = Encoder(default_tokenizer(), capacity=80)
    texts = [prose(k, 3000) for k in range(4)]
    assert [x.tolist() for x in tool.encode(texts)] == [e.ids for e in tool.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert len(tool.cache) == 80 and sys.getsizeof(tool.cache) <= sys.getsizeof({str(k): b"" for k in range(81)})


def test_driver_builds_no_tables_unasked(spark, tmp_path):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.execution.arrow.maxBytesPerBatch")
    docs, before = spark.createDataFrame([], SCHEMA), {k: spark.conf.get(k) for k in keys}
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(keys[0])
        stage(spark, docs, str(tmp_path))
        small = spark.range(9).withColumnRenamed("id", "n")
        plan = small.join(small.groupBy("n").count(), "n")._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan
        asked = small.join(F.broadcast(small.groupBy("n").count()), "n")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in asked
    for k in keys:
        spark.conf.set(k, before[k])


def test_steps_of_decontamination_have_small_plans(spark, monkeypatch):
    written, cut = [], decontaminate.cut_lineage
    monkeypatch.setattr(decontaminate, "cut_lineage", lambda df: written.append(df) or cut(df))
    docs = spark.createDataFrame([(i, prose(i, 90), "en", "s", 1, "k", "s", 7, "r", "p") for i in range(6)] + [(7, "alone", "en", "s", 1, "k", "s", 7, "r", "p")], SCHEMA)
    items = spark.createDataFrame([("a", prose(0, 90)), ("b", prose(1, 12)), ("c", "alone"), ("d", "absent words")], "item_id string, text string")
    found = decontaminate.clean_only(docs, items)
    dirty = decontaminate.decontaminate(docs, items).where("contaminated")
    assert {r.doc_id for r in found.collect()} == set(range(2, 6)) and {r.doc_id for r in dirty.collect()} == {0, 1, 7}
    joins = [df._jdf.queryExecution().executedPlan().toString().count("Join ") for df in [*written, found]]
    assert max(joins) <= 4


def test_driver_holds_the_sample_once(spark):
    import tracemalloc

    r = random.Random(5)
    rows = spark.createDataFrame([(max(i, 9), "".join(map(chr, r.choices(range(33, 127), k=6000))), i % 2, 2) for i in range(120)], "doc_id bigint, text string, label int, fold int")
    quality.sampled(rows, 1000)
    tracemalloc.start()
    found, sides = quality.sampled(rows, 1000)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(found) == len(sides) == 120 and most < sum(x.nbytes for x in found)
    again, _ = quality.sampled(rows.repartition(3), 1000)
    assert [x.tolist() for x in found] == [x.tolist() for x in again]
