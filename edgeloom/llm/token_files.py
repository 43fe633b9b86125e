"""Token ids as flat binary files (operator 3).

A range partition of the documents writes three files into the shared folder: the ids of
its documents as flat unsigned integers, 64-bit offsets (where each document starts, and
the end), and the doc_ids. Rows of the manifest name the files that belong to the result:
a task that runs twice leaves files that no row names. The place of a partition in the
whole sequence is the prefix sum of the manifest's counts.

Defined results: a null text is empty and gets the end id alone. Null doc_ids come first.
Rows with the same doc_id are separate documents, in the order of their texts. An empty
table gives no file. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import id_and_text, map_shared, write_shared
from edgeloom.llm.tokens import default_tokenizer, encoder
from edgeloom.session import cut_lineage, stage_path

MANIFEST = "part int, path string, width int, n_docs bigint, n_null bigint, n_ids bigint"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Encode documents in ascending doc_id order, write the files below `folder`, return the manifest.

    Ids are 16 bits wide where the vocabulary allows it, else 32.
    """
    tokenizer = tokenizer or default_tokenizer()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool = encoder(tokenizer)
        kind = np.dtype("<u2" if max(tool.size, end_id + 1) <= 1 << 16 else "<u4")
        ids, lengths, names, nulls = bytearray(), [], [], 0
        for batch in batches:
            found = batch.column("doc_id").to_pylist()
            nulls += found.count(None)
            names.extend(0 if x is None else x for x in found)
            for one in tool.encode(batch.column("text").to_pylist()):
                ids += one.astype(kind).tobytes()
                ids += np.array([end_id], kind).tobytes()
                lengths.append(len(one) + 1)
        if not names:
            return
        part = TaskContext.get().partitionId()
        path = f"{folder.rstrip('/')}/part-{part:06d}-{uuid.uuid4().hex}"
        write_shared(f"{path}.ids", memoryview(ids))
        write_shared(f"{path}.off", np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes())
        write_shared(f"{path}.doc", np.array(names, "<i8").tobytes())
        row = {"part": part, "path": path, "width": kind.itemsize, "n_docs": len(names), "n_null": nulls, "n_ids": int(sum(lengths))}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([
            ("part", pa.int32()), ("path", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_ids", pa.int64())]))

    placed = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return cut_lineage(placed.mapInArrow(write, MANIFEST))


def located(manifest: DataFrame) -> DataFrame:
    """The manifest with `base`, the ids of all partitions before; it has one row for each partition."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents read back: doc_id, start, n_tokens, ids_crc32, and the ids themselves if asked for."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = map_shared(f"{row['path']}.ids", f"<u{row['width']}")
                offsets = map_shared(f"{row['path']}.off", "<u8").astype(np.int64)
                names = np.array(map_shared(f"{row['path']}.doc", "<i8"))
                for k in range(0, len(names), 2000):
                    span = range(k, min(k + 2000, len(names)))
                    parts = [ids[offsets[i] : offsets[i + 1]].astype("<u4") for i in span]
                    columns = {
                        "doc_id": pa.array(names[span.start : span.stop], pa.int64(), mask=np.arange(span.start, span.stop) < row["n_null"]),
                        "start": pa.array(row["base"] + offsets[span.start : span.stop], pa.int64()),
                        "n_tokens": pa.array([len(p) for p in parts], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array([p.tolist() for p in parts], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    parts = max(1, manifest.count())
    return located(manifest).repartition(parts, "part").mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write documents to a fresh folder below the checkpoint folder and read them back."""
    folder = stage_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id))
