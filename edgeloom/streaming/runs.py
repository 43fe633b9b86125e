"""A table of mergeable rows as a log-structured merge tree.

A write adds a run, a folder of rows, at level 0. As soon as a level has `fanout` runs they
are merged into one of the level above, in the same commit. A version is a small file that
names the runs it consists of; it appears whole, so a reader has the table before a write or
after it and nothing between. n writes leave at most (fanout - 1) * log(n) runs.

A write says which stream and batch it is; a batch that the table has is not written again.
Versions, and runs that only they name, are deleted once `keep` newer ones exist.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from edgeloom.sources.files import names_in, put_new, read_texts, remove


class MergeTable:
    """`merge` folds rows of equal keys; folding in any order and grouping must give the same."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame], fanout: int = 4, keep: int = 8, sort: str | None = None):
        if fanout < 2 or keep < 1:
            raise ValueError("a level holds two runs at least, and the newest version is kept")
        self.spark, self.path, self.schema, self.merge = spark, path.rstrip("/"), schema, merge
        self.fanout, self.keep, self.sort = fanout, keep, sort

    def version(self, number: int | None = None) -> dict:
        """The newest version or the one of a number: number, runs (folder, level, batches), last batch of each stream."""
        found = names_in(self.spark, f"{self.path}/versions")
        if not found:
            return {"number": 0, "runs": [], "streams": {}}
        name = found[-1] if number is None else f"{number:012d}"
        return json.loads(read_texts(self.spark, f"{self.path}/versions", [name])[0])

    def read(self, number: int | None = None) -> DataFrame:
        """Rows of a version, not folded: keys may occur once in each run."""
        return self._rows([r["folder"] for r in self.version(number)["runs"]])

    def add(self, rows: DataFrame, stream: str, batch: int, attempts: int = 20) -> bool:
        """Add a batch of a stream; False where the table has it already."""
        own = None
        for _ in range(attempts):
            held = self.version()
            if batch <= held["streams"].get(stream, -1):
                return False
            if own is None:
                own = self._write(self.merge(rows))
            runs, merged = self._compacted([*held["runs"], {"folder": own, "level": 0, "batches": 1}])
            number = held["number"] + 1
            made = {"number": number, "runs": runs, "streams": held["streams"] | {stream: batch}}
            if put_new(self.spark, f"{self.path}/versions/{number:012d}", json.dumps(made)):
                if own not in {r["folder"] for r in runs}:  # merged at once
                    remove(self.spark, f"{self.path}/runs/{own}")
                self._forget()
                return True
            for folder in merged:  # another writer was faster: start from its version
                remove(self.spark, f"{self.path}/runs/{folder}")
        raise RuntimeError(f"no version of {self.path} could be written in {attempts} attempts")

    def _compacted(self, runs: list[dict]) -> tuple[list[dict], list[str]]:
        """The runs after merging full levels, lowest first, and the folders written for it."""
        made, level = [], 0
        while level <= max(r["level"] for r in runs):
            own = [r for r in runs if r["level"] == level]
            if len(own) >= self.fanout:
                folder = self._write(self.merge(self._rows([r["folder"] for r in own])))
                made.append(folder)
                runs = [r for r in runs if r["level"] != level] + [{"folder": folder, "level": level + 1, "batches": sum(r["batches"] for r in own)}]
            level += 1
        last = {r["folder"] for r in runs}
        for folder in made:  # merged again at once
            if folder not in last:
                remove(self.spark, f"{self.path}/runs/{folder}")
        return runs, [f for f in made if f in last]

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/runs/{f}" for f in folders])

    def _write(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        placed = rows.select(*self.schema.fieldNames()).hint("rebalance")  # few files for few rows
        placed = placed.sortWithinPartitions(self.sort) if self.sort else placed
        placed.write.mode("errorifexists").parquet(f"{self.path}/runs/{folder}")
        return folder

    def _forget(self) -> None:
        """Drop versions beyond `keep` and the runs that none of those kept names."""
        found = names_in(self.spark, f"{self.path}/versions")
        old, kept = found[: -self.keep], found[-self.keep :]
        if old:
            texts = [json.loads(t) for t in read_texts(self.spark, f"{self.path}/versions", old + kept)]
            named = {r["folder"] for v in texts[len(old) :] for r in v["runs"]}
            for name, version in zip(old, texts, strict=False):
                for folder in {r["folder"] for r in version["runs"]} - named:
                    remove(self.spark, f"{self.path}/runs/{folder}")
                remove(self.spark, f"{self.path}/versions/{name}")

    def sweep(self) -> int:
        """Delete runs that no kept version names, left by writes that failed; only while nobody writes. Returns their number."""
        kept = names_in(self.spark, f"{self.path}/versions")
        named = {r["folder"] for t in read_texts(self.spark, f"{self.path}/versions", kept) for r in json.loads(t)["runs"]}
        lost = [n for n in names_in(self.spark, f"{self.path}/runs") if n not in named]
        for name in lost:
            remove(self.spark, f"{self.path}/runs/{name}")
        return len(lost)
