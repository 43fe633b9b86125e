"""Sinks. Parquet inside the library; text on export."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet table. Rows of one partition value go to few files, but a hot value still spreads over tasks (AQE)."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def export_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("sep", sep).option("header", header).csv(path)


def export_intervals(intervals: DataFrame, *paths: str) -> None:
    """Headerless tab files: subject, property, object, start, end."""
    table = intervals.select("subject", "property", "object", "start_time", "end_time")
    for path in paths:
        export_csv(table, path, sep="\t", header=False)


def export_quarantine(bad: DataFrame, path: str) -> None:
    export_csv(bad, path)


def export_candidates(candidates: DataFrame, json_path: str, table_path: str) -> None:
    """Candidate constraints as JSON lines and as a table; an empty table keeps its columns."""
    candidates.write.mode("overwrite").json(json_path)
    candidates.write.mode("overwrite").parquet(table_path)


def export_timeline(timeline: DataFrame, path: str) -> None:
    """One JSON document per month, in a folder per month."""
    timeline.write.mode("overwrite").partitionBy("month").json(path)


def upsert_each_batch(df: DataFrame, send: Callable[[Sequence[dict]], None], batch_size: int = 1000) -> None:
    """Hand rows to any server in batches, from the executors. The send function must be idempotent: tasks may repeat."""

    def deliver(rows: Iterable) -> None:
        batch: list[dict] = []
        for row in rows:
            batch.append(row.asDict(recursive=True))
            if len(batch) == batch_size:
                send(batch)
                batch = []
        if batch:
            send(batch)

    df.foreachPartition(deliver)


def export_cases(cases: dict[str, DataFrame], folder: str) -> None:
    """Named case tables side by side under one folder."""
    for name, df in cases.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/case_name={name}")


def export_zipped_lines(lines: DataFrame, folder: str, suffix: str = ".txt") -> int:
    """Write rows of one text column as zip archives of text, one for each partition; returns the number of lines.

    The folder must be one that executors can write to as files, or a store pyarrow knows.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [line or "" for batch in batches for line in batch.column(0).to_pylist()]
        if held:
            name = f"part-{TaskContext.get().partitionId():06d}{suffix}"
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr(name, "\n".join(held) + "\n")
            store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
            store.create_dir(path, recursive=True)
            # The same name and content however often the task runs.
            with store.open_output_stream(f"{path}/{name}.zip") as out:
                out.write(data.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], names=["lines"])

    return lines.mapInArrow(write, "lines bigint").agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("n")).first()["n"]
