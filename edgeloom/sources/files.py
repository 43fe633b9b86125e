"""Small files of shared folders, through the file system client that Spark has for their store."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkRuntimeError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not exist yet; False where it does. It appears whole or not at all."""
    jvm = spark._jvm
    target = _path(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    store = _store(spark, path)
    store.mkdirs(target.getParent())
    if store.exists(target):
        return False
    out = store.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, target, none)
    except Exception:
        store.delete(draft, False)
        if store.exists(target):  # someone was faster
            return False
        raise
    return True


def read_texts(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """Whole texts of small files of one folder."""
    out = []
    for name in names:
        stream = _store(spark, folder).open(_path(spark, f"{folder}/{name}"))
        try:
            out.append(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
    return out


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in a folder, drafts left out; none where there is no folder."""
    store, place = _store(spark, folder), _path(spark, folder)
    if not store.exists(place):
        return []
    return sorted(n for n in (s.getPath().getName() for s in store.listStatus(place)) if not n.startswith("."))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with what is in it; nothing happens where there is none."""
    store, place = _store(spark, path), _path(spark, path)
    if store.exists(place) and not store.delete(place, True):
        raise PySparkRuntimeError(f"{path} can't be deleted")
