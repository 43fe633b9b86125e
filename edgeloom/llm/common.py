"""Small helpers of the training-data operators: inputs, shared files, text columns."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text a Python task works on at a time.
SLICE_BYTES = 2_000_000
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, unless they find it by themselves as the driver does."""
    import shutil
    import tempfile

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    context = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == root or context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "edgeloom"), "zip", root, "edgeloom"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text only, whatever other columns there are; a null text is empty."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def text_key(text: Column) -> Column:
    """Tells documents with the same doc_id apart; rows that repeat both are one document."""
    return F.xxhash64(text)


def slices(texts: list[str], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters each, one text at least."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def few_rows(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about so many bytes each, one row at least, so that Python holds the texts of a part only."""
    for batch in batches:
        step = max(1, min(batch.num_rows, batch.num_rows * most // max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
        del batch
    pa.default_memory_pool().release_unused()


def small_batches(spark: SparkSession, most: int = SLICE_BYTES) -> None:
    """From now on the session sends Python batches of about so many bytes, so that executors hold little of them on either side."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def only_asked_broadcasts(spark: SparkSession) -> None:
    """From now on the session broadcasts what has the hint alone. Else the driver builds a table, with buffers and a thread, for each side that turns out small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def broadcast_if_small(df: DataFrame, most: int) -> DataFrame:
    """The hint where `df` has so few rows; else the planner decides. It is counted, so it should be a stage table."""
    return F.broadcast(df) if df.count() <= most else df


def local_path(uri: str) -> str | None:
    """Path of a folder that is mounted, None for a store that only file system clients reach."""
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def write_shared(uri: str, data: bytes | memoryview) -> None:
    """Write a file of the shared folder; on a mount it appears whole or not at all."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(inner) as out:
            out.write(data)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "wb") as out:
        out.write(data)
    os.replace(draft, path)


def map_shared(uri: str, dtype):
    """A file of the shared folder as an array: memory-mapped on a mount, read elsewhere."""
    import numpy as np

    path = local_path(uri)
    if path is not None:
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    with store.open_input_file(inner) as source:
        return np.frombuffer(source.read(), dtype)
