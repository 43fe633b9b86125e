"""Feed B as a stream: every micro-batch adds mergeable partial counts, and the edge table is their sum.

Counts, source sets and first days merge in any order, so late rows need no rule: they count
wherever they arrive. Partial counts lie in a log-structured table (`runs.MergeTable`): it
stays small, and a replayed batch changes nothing. Which keys are new is known to the
engine: `first_keys` keeps a row for each key in its state store, so no batch reads what
came before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from edgeloom.constants import MIN_B_ONLY_EVENTS
from edgeloom.functions.parse import sql_date_day, sql_date_month
from edgeloom.operators import edges as E
from edgeloom.operators.facts import KEY
from edgeloom.streaming.runs import MergeTable

PARTIAL_SCHEMA = T.StructType([
    T.StructField("subject_org_id", T.StringType()), T.StructField("object_org_id", T.StringType()),
    T.StructField("event_month", T.StringType()), T.StructField("relation_type", T.StringType()),
    T.StructField("day", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("n", T.LongType()),
    T.StructField("subject_canonical", T.StringType()), T.StructField("object_canonical", T.StringType()),
])
FIRST_SCHEMA = T.StructType([
    *[T.StructField(c, T.StringType()) for c in KEY], T.StructField("first_day", T.StringType()),
    T.StructField("events", T.LongType()), T.StructField("first_batch", T.LongType()),
])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def partials(classified: DataFrame) -> DataFrame:
    """Classified events as two kinds of rows: per key (where mapped) and, without a key, per day and reason.

    Both are far fewer than keys times days, and the log needs no more: a key's first day, a day's counts.
    """
    names = ("subject_canonical", "object_canonical")
    fields = (*KEY, *names)
    by_key = F.struct(*fields, "day", "reason", "n")
    by_day = F.struct(*[F.lit(None).cast("string").alias(c) for c in fields], "day", "reason", "n")
    return classified.select(F.explode(F.when(F.col("reason") == "mapped", F.array(by_key, by_day)).otherwise(F.array(by_day))).alias("row")).select("row.*")


def _summed(rows: DataFrame) -> DataFrame:
    """Rows of a key become one with its first day; those without are told apart by day."""
    own = F.when(F.col("relation_type").isNull(), F.col("day"))
    return rows.groupBy(*KEY, "reason", own.alias("_day")).agg(
        F.min("day").alias("day"), F.sum("n").alias("n"),
        F.first("subject_canonical").alias("subject_canonical"), F.first("object_canonical").alias("object_canonical")).drop("_day")


def partial_table(spark: SparkSession, path: str, fanout: int = 4) -> MergeTable:
    """Counts and first day per edge key, and counts per day and reason."""
    return MergeTable(spark, path, PARTIAL_SCHEMA, _summed, fanout, sort="event_month")


def fuse_stream(
    events: DataFrame, dictionary: DataFrame, path: str, checkpoint: str, available_now: bool = True,
    interval: str = "1 minute", fanout: int = 4,
) -> StreamingQuery:
    """Start the stream that adds the partial counts of each batch to the table in `path`."""
    table = partial_table(events.sparkSession, path, fanout)

    def write(batch: DataFrame, batch_id: int) -> None:
        table.add(partials(E.classified_events(batch, dictionary)), checkpoint, batch_id)

    return _started(events.writeStream.foreachBatch(write), checkpoint, available_now, interval)


def _started(writer, checkpoint: str, available_now: bool, interval: str) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def read_partials(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All partial counts so far: rows of keys, and rows of days and reasons."""
    rows = partial_table(spark, path).read()
    return rows.where("relation_type is not null"), rows.where("relation_type is null")


def stream_edges(spark: SparkSession, path: str, seed: DataFrame, min_b_only: int = MIN_B_ONLY_EVENTS) -> DataFrame:
    """Edge table from seed and partials; weak edges are pruned on reading, never in the stream."""
    return E.fused_edges(seed, read_partials(spark, path)[0], min_b_only)


def stream_log(spark: SparkSession, path: str, seed: DataFrame) -> DataFrame:
    """Daily log over everything streamed so far."""
    keys, days = read_partials(spark, path)
    return E.daily_log(seed, days, keys)


def _first(rows: DataFrame) -> DataFrame:
    """Totals only grow, so the largest is the last."""
    return rows.groupBy(*KEY).agg(F.min("first_day").alias("first_day"), F.max("events").alias("events"), F.min("first_batch").alias("first_batch"))


def first_table(spark: SparkSession, path: str, fanout: int = 4) -> MergeTable:
    """First day, events and first batch per edge key."""
    return MergeTable(spark, path, FIRST_SCHEMA, _first, fanout, sort="subject_org_id")


def key_states(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The running state of the edge keys of a stream: first day, events, whether the key came with the batch at hand.

    The engine keeps one row of numbers for each key and hands on those a batch touches. All
    rows of a batch have the batch's time, so a key is new where its first and last are one.
    A late row lowers the first day.
    """
    rows = events.select(
        sql_date_day("SQLDATE").alias("day"), sql_date_month("SQLDATE").alias("event_month"),
        "Actor1Name", "Actor2Name", "EventCode", "EventRootCode", F.lit(1).cast("bigint").alias("n"),
    )
    usable = E.classified(rows, dictionary).where("reason = 'mapped'").withColumn("came", F.current_timestamp())
    states = usable.groupBy(*KEY).agg(F.min("day").alias("first_day"), F.sum("n").alias("events"), F.min("came").alias("_from"), F.max("came").alias("_to"))
    return states.select(*KEY, "first_day", "events", (F.col("_from") == F.col("_to")).alias("is_new"))


def first_keys_stream(
    events: DataFrame, dictionary: DataFrame, path: str, checkpoint: str, available_now: bool = True,
    interval: str = "1 minute", fanout: int = 4,
) -> StreamingQuery:
    """Start the stream that keeps the first day of every edge key, its state in RocksDB, below the checkpoint.

    What a batch touches is added to the table in `path`. Of new keys the batch is kept.
    """
    spark = events.sparkSession
    table = first_table(spark, path, fanout)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("first_batch", F.when(F.col("is_new"), F.lit(batch_id).cast("bigint")))
        table.add(rows.drop("is_new"), checkpoint, batch_id)

    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)  # a query keeps the provider that it starts with
    try:
        return _started(key_states(events, dictionary).writeStream.outputMode("update").foreachBatch(write), checkpoint, available_now, interval)
    finally:
        spark.conf.set(setting, before)


def new_keys(spark: SparkSession, path: str, seed: DataFrame) -> DataFrame:
    """Edge keys that the stream opened: those of the table that the seed lacks."""
    return first_table(spark, path).merge(first_table(spark, path).read()).join(seed.select(*KEY).distinct(), list(KEY), "left_anti")


def batch_log(spark: SparkSession, path: str, seed: DataFrame) -> DataFrame:
    """Per batch and first day: the edges it opened. Reads only the table of first keys, none of the partial counts."""
    return new_keys(spark, path, seed).groupBy("first_batch", F.col("first_day").alias("date")).agg(F.count(F.lit(1)).alias("new_edges"))


def windowed_counts(events: DataFrame, date: str = "SQLDATE", delay: str = "2 days") -> DataFrame:
    """Daily event counts inside the engine: rows later than the delay are dropped (a batch run recovers them)."""
    stamped = events.withColumn("event_time", F.try_to_timestamp(F.col(date), F.lit("yyyyMMdd"))).where("event_time is not null")
    return (
        stamped.withWatermark("event_time", delay).groupBy(F.window("event_time", "1 day"))
        .agg(F.count(F.lit(1)).alias("processed_events"))
        .select(F.date_format("window.start", "yyyy-MM-dd").alias("date"), "processed_events")
    )
