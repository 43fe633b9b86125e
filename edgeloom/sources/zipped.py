"""Delimited text in zip archives as a data source whose partitions are archive members.

The members are read from each archive's directory, a few ranged reads at its end, so an
archive of many members is read by as many tasks. A member is opened at its place, unpacked
and split into rows as it streams, whatever its size; nothing holds a whole member.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import json
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = 20_000
#: Archives whose directories are read at a time while a scan is planned.
PLANNERS = 16


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def archives(paths: list[str], pattern: str, recursive: bool, exclude_directory: str | None) -> list[tuple[fs.FileSystem, str]]:
    """Files of the pattern at or below the paths, each once, in order."""
    found = {}
    for uri in paths:
        store, path = store_of(uri)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(uri)
        infos = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=recursive))
        for x in infos:
            inside = not exclude_directory or exclude_directory not in x.path.split("/")
            if x.is_file and inside and (info.is_file or fnmatch.fnmatchcase(x.base_name, pattern)):
                found[x.path] = store
    return [(found[p], p) for p in sorted(found)]


class Ranged(io.RawIOBase):
    """A file of a store, read at the places asked for."""

    def __init__(self, data: pa.NativeFile):
        self.data = data

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.data.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        place = offset + (0, self.data.tell(), self.data.size())[whence]
        if place < 0:
            raise OSError("before the start of the file")
        return self.data.seek(place)

    def readinto(self, buffer) -> int:
        got = self.data.read(len(buffer))
        buffer[: len(got)] = got
        return len(got)


def opened(store: fs.FileSystem, path: str) -> io.BufferedReader:
    return io.BufferedReader(Ranged(store.open_input_file(path)), 1 << 16)


@dataclass
class Member(InputPartition):
    """A member of an archive."""

    uri: str
    path: str
    name: str

    def __post_init__(self):
        super().__init__((self.path, self.name))


class MemberReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.names, self.options = schema.fieldNames(), {k.lower(): v for k, v in options.items()}

    def _flag(self, name: str) -> bool:
        return self.options.get(name, "false").lower() == "true"

    def partitions(self) -> list[Member]:
        o = self.options
        paths = json.loads(o["paths"])
        files = archives(paths, o.get("pattern", "*.zip"), self._flag("recursive"), o.get("exclude") or None)

        def members(file: tuple[fs.FileSystem, str]) -> list[Member]:
            store, path = file
            with opened(store, path) as data:
                if not zipfile.is_zipfile(data):
                    if self._flag("skipcorrupt"):
                        return []
                    raise zipfile.BadZipFile(f"{path} is not a zip file")
                with zipfile.ZipFile(data) as archive:
                    found = [m.filename for m in archive.infolist() if not m.is_dir()]
            return [Member(paths[0], path, n) for n in (found[:1] if o.get("members", "all") == "first" else found)]

        with ThreadPoolExecutor(PLANNERS) as pool:
            planned = [m for found in pool.map(members, files) for m in found]
        return planned or [Member("", "", "")]

    def read(self, member: Member) -> Iterator[pa.RecordBatch]:
        if not member.path:
            return
        csv.field_size_limit(2**31 - 1)
        store, _ = store_of(member.uri)
        own = self.options.get("filecolumn", "")
        sep, places, rows = self.options.get("sep", "\t"), None, []
        names = [n for n in self.names if n != own]
        if not self._flag("header"):
            places = list(range(len(names)))
        with opened(store, member.path) as data, zipfile.ZipFile(data) as archive, archive.open(member.name) as packed:
            with io.TextIOWrapper(packed, encoding="utf-8-sig", errors="replace", newline="") as text:
                lines = csv.reader(unended(text), delimiter=sep) if self._flag("multiline") else (split_line(x, sep) for x in map(lambda x: x.rstrip("\r\n"), text) if x)
                for fields in lines:
                    if not fields or fields == [""]:
                        continue
                    if places is None:
                        places = [fields.index(n) if n in fields else len(fields) for n in names]
                        continue
                    rows.append([(fields[i] or None) if i < len(fields) else None for i in places])
                    if len(rows) >= ROWS:
                        yield self._batch(rows, names, own, member.path)
                        rows = []
        if rows:
            yield self._batch(rows, names, own, member.path)

    def _batch(self, rows: list[list], names: list[str], own: str, path: str) -> pa.RecordBatch:
        columns = dict(zip(names, (pa.array(c, pa.string()) for c in zip(*rows, strict=True)), strict=True))
        if own:
            columns[own] = pa.array([path.rsplit("/", 1)[-1]] * len(rows), pa.string())
        return pa.RecordBatch.from_arrays([columns[n] for n in self.names], names=self.names)


def unended(lines: Iterator[str]) -> Iterator[str]:
    """The lines, the last without its end: a quote that isn't closed then ends before it."""
    held = None
    for line in lines:
        if held is not None:
            yield held
        held = line
    if held is not None:
        yield held.rstrip("\r\n")


def split_line(line: str, sep: str) -> list[str]:
    """Fields of a line; a quote that isn't closed ends with it, as in plain files."""
    return next(csv.reader([line], delimiter=sep)) if '"' in line else line.split(sep)


class ZippedText(DataSource):
    """Options: paths (JSON list), pattern, recursive, exclude, sep, header, members (all or first), fileColumn, skipCorrupt, multiLine."""

    @classmethod
    def name(cls) -> str:
        return "zipped_text"

    def schema(self) -> str:
        raise ValueError("zipped text needs a schema of its columns")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return MemberReader(schema, dict(self.options))


def register_zipped(spark: SparkSession) -> None:
    spark.dataSource.register(ZippedText)
