"""Scans. All text columns; the caller parses."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.constants import NULL_TOKENS
from edgeloom.functions.codes import relation_light
from edgeloom.functions.parse import month_number, month_text, null_tokens_to_null
from edgeloom.sources.schemas import INTERVAL_TEXT_SCHEMA, TIMELINE_SCHEMA
from edgeloom.sources.zipped import archives, opened, register_zipped, store_of


def read_delimited(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType | None = None,
    sep: str = "\t",
    header: bool = True,
    recursive: bool = False,
    pattern: str | None = None,
    exclude_directory: str | None = None,
    file_column: str | None = None,
    nulls: Iterable[str] = NULL_TOKENS,
    skip_corrupt: bool = False,
    multiline: bool = False,
) -> DataFrame:
    """Plain delimited text files; quotes within quoted fields are doubled.

    Short rows are filled with nulls, long ones cut; the null spellings become null. A file
    that can't be read is an error unless `skip_corrupt` says otherwise. With `multiline`,
    quoted fields may hold line breaks, and a file is read by one task.
    """
    reader = (
        spark.read.option("sep", sep).option("header", header).option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"')
        .option("ignoreCorruptFiles", skip_corrupt).option("recursiveFileLookup", recursive).option("encoding", "UTF-8").option("multiLine", multiline)
    )
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(paths if isinstance(paths, str) else list(paths))
    first = df.columns[0]
    if first.startswith("﻿"):
        df = df.withColumnRenamed(first, first.lstrip("﻿"))
    file_path, file_name = F.col("_metadata.file_path"), F.col("_metadata.file_name")
    tokens = tuple(nulls)
    if exclude_directory:
        df = df.where(~F.array_contains(F.split(file_path, "/"), exclude_directory))
    columns = [null_tokens_to_null(F.col(f"`{c}`"), tokens).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes]
    return df.select(*columns, *([file_name.alias(file_column)] if file_column else []))


def unreadable_archives(
    spark: SparkSession, paths: str | Sequence[str], recursive: bool = False, pattern: str = "*.zip", exclude_directory: str | None = None,
) -> DataFrame:
    """Paths of the archives that `read_zipped` skips when told to."""
    wanted = [paths] if isinstance(paths, str) else list(paths)
    found = [p for _, p in archives(wanted, pattern, recursive, exclude_directory)]

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(wanted[0])
        for batch in batches:
            bad = []
            for path in batch.column(0).to_pylist():
                with opened(store, path) as data:
                    bad += [] if zipfile.is_zipfile(data) else [path]
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], names=["path"])

    return spark.createDataFrame([(p,) for p in found], "path string").repartition(max(1, len(found) // 100)).mapInArrow(test, "path string")


def read_zipped(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType,
    sep: str = "\t",
    header: bool = True,
    file_column: str | None = None,
    recursive: bool = False,
    pattern: str = "*.zip",
    exclude_directory: str | None = None,
    nulls: Iterable[str] = NULL_TOKENS,
    members: str = "all",
    skip_corrupt: bool = False,
    multiline: bool = True,
) -> DataFrame:
    """Delimited text inside zip archives, a task for each member (see `zipped`).

    All members are read, or with members="first" the first. Columns go by name where there is
    a header; rows, nulls, quotes and unreadable archives are treated as in plain files
    (`unreadable_archives` names the latter). A quoted field may hold line breaks, so a quote
    that isn't closed takes what follows; with multiline=False it ends with its line.
    """
    register_zipped(spark)
    names = [f.name for f in schema.fields]
    own = T.StructType([T.StructField(n, T.StringType()) for n in [*names, *([file_column] if file_column else [])]])
    options = {
        "paths": json.dumps([paths] if isinstance(paths, str) else list(paths)), "sep": sep, "header": header, "fileColumn": file_column or "", "recursive": recursive,
        "pattern": pattern, "exclude": exclude_directory or "", "members": members, "skipCorrupt": skip_corrupt, "multiLine": multiline,
    }
    df = spark.read.format("zipped_text").schema(own).options(**options).load()
    tokens = tuple(nulls)
    return df.select(*[null_tokens_to_null(F.col(f"`{n}`"), tokens).alias(n) for n in names], *([file_column] if file_column else []))


def union_drifted(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by name; columns missing on one side become null."""
    frames = list(frames)
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def read_feed_files(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.tab", header: bool = True,
    exclude_directory: str | None = None, file_column: str | None = "Source File", multiline: bool = True,
) -> DataFrame:
    """All plain and zipped files of a feed below a folder (zipped ones end in .zip after the pattern), with their
    file names, exact repeats removed. Where no quoted field holds a line break, multiline=False lets tasks share large plain files."""
    plain = read_delimited(
        spark, folder, schema, header=header, recursive=True, pattern=pattern, exclude_directory=exclude_directory, file_column=file_column, multiline=multiline
    )
    zipped = read_zipped(
        spark, folder, schema, header=header, file_column=file_column, recursive=True, pattern=f"{pattern}.zip", exclude_directory=exclude_directory, multiline=multiline
    )
    return union_drifted([plain, zipped]).distinct()


def read_cases(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """Case tables written side by side: their names, or the rows of one."""
    if name is not None:
        return spark.read.parquet(f"{folder.rstrip('/')}/case_name={name}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    return files.select(F.regexp_extract("path", r"case_name=([^/]+)/", 1).alias("case_name")).distinct().orderBy("case_name")


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", *fallbacks: str, **options) -> DataFrame:
    """First of the paths that exists, else an empty table of the schema."""
    for candidate in (path, *fallbacks):
        try:
            return spark.read.format(fmt).options(**options).schema(schema).load(candidate)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], schema)


def parse_intervals(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interval rows with readable months (reversed ends swapped), and the quarantined rest."""
    parsed = raw.select(
        F.col("subject").alias("subject_org_id"),
        relation_light("property").alias("relation_type"),
        F.col("object").alias("object_org_id"),
        "start_time", "end_time",
        month_number("start_time").alias("_s"),
        month_number("end_time").alias("_e"),
    )
    readable = F.col("_s").isNotNull() & F.col("_e").isNotNull()
    good = parsed.where(readable).select(
        "subject_org_id", "relation_type", "object_org_id",
        F.least("_s", "_e").alias("start_no"), F.greatest("_s", "_e").alias("end_no"),
    ).withColumns({"start_time": month_text("start_no"), "end_time": month_text("end_no")})
    return good, parsed.where(~readable).drop("_s", "_e")


def read_intervals(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Headerless tab file of subject, property, object, start, end."""
    raw = spark.read.option("sep", "\t").option("header", False).schema(INTERVAL_TEXT_SCHEMA).csv(path)
    return parse_intervals(raw)


def read_edges_jdbc(
    spark: SparkSession, url: str, table: str = "relation_edges",
    partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
    partitions: int = 1, fetch_size: int = 10_000, **properties: str,
) -> DataFrame:
    """Edge table in a database, read in parallel ranges of a numeric column when one is named."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=fetch_size, **properties)
    if partition_column is not None:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions
        )
    return reader.load()


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TIMELINE_SCHEMA).json(path)


def timeline_links(timeline: DataFrame) -> DataFrame:
    return timeline.select("month", F.inline("links"))


def timeline_nodes(timeline: DataFrame) -> DataFrame:
    return timeline.select("month", F.inline("nodes"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """One row per response file: its name and whole text."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("response_id"), F.col("value").alias("response_text")
    )

