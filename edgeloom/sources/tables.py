"""Tables that take appends exactly once and upserts by key.

Rows are written to a fresh folder first; a small file that appears whole then says that
they count. What a writer that failed has left is never read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.sources.files import names_in, put_new, read_texts, remove
from edgeloom.sources.writers import write_table


def append_once(df: DataFrame, path: str, append_id: str, partition_by: Sequence[str] = ("event_month",)) -> bool:
    """Append rows under an id; False, and nothing happens, where the table has that append already.

    The commit of an append is a file named after its id, so appends with different ids
    never wait for each other, and of two with the same one wins.
    """
    spark, name = df.sparkSession, hashlib.sha256(append_id.encode()).hexdigest()
    if name in names_in(spark, f"{path}/commits"):
        return False
    folder = uuid.uuid4().hex
    write_table(df, f"{path}/data/append={folder}", partition_by, mode="errorifexists")
    if put_new(spark, f"{path}/commits/{name}", json.dumps({"append": append_id, "folder": folder})):
        return True
    remove(spark, f"{path}/data/append={folder}")
    return False


def appends(spark: SparkSession, path: str) -> dict[str, str]:
    """The folder of each append that counts."""
    found = [json.loads(t) for t in read_texts(spark, f"{path}/commits", names_in(spark, f"{path}/commits"))]
    return {x["append"]: x["folder"] for x in found}


def read_appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of all appends that count."""
    folders = sorted(appends(spark, path).values())
    if not folders:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*[f"{path}/data/append={f}" for f in folders])
    return found.select(*schema.fieldNames())


def sweep_appends(spark: SparkSession, path: str) -> int:
    """Delete folders that no commit names; only while nobody appends. Returns their number."""
    kept = {f"append={f}" for f in appends(spark, path).values()}
    lost = [f for f in names_in(spark, f"{path}/data") if f not in kept]
    for folder in lost:
        remove(spark, f"{path}/data/{folder}")
    return len(lost)


class KeyedTable:
    """The latest row of each key, in buckets of keys; an upsert rewrites only the buckets it changes.

    A version is a small file that maps buckets to folders and appears whole, so readers see
    an upsert as a whole or not at all. Of two rows of a key the one with the larger `order`
    stays; of equal ones that of the later upsert, and within an upsert the larger row. So
    an upsert that is repeated changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], order: str, buckets: int = 64, keep: int = 8):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.order, self.buckets, self.keep = list(keys), order, buckets, keep

    def version(self, number: int | None = None) -> dict:
        found = names_in(self.spark, f"{self.path}/versions")
        if not found:
            return {"number": 0, "buckets": {}}
        return json.loads(read_texts(self.spark, f"{self.path}/versions", [found[-1] if number is None else f"{number:012d}"])[0])

    def read(self, number: int | None = None) -> DataFrame:
        return self._rows(self.version(number)["buckets"].values()).drop("_bucket")

    def upsert(self, rows: DataFrame, attempts: int = 20) -> set[int]:
        """Merge rows in; returns the buckets that were rewritten."""
        columns = self.schema.fieldNames()
        new = self._latest(rows.select(*columns).withColumn("_late", F.lit(1)), F.struct(*columns)).drop("_late").withColumn("_bucket", self._bucket())
        for _ in range(attempts):
            held = self.version()
            old = self._rows(held["buckets"].values())
            # At most as many rows as there are buckets come to the driver.
            changed = {r["_bucket"] for r in self._merged(old, new).select(*columns, "_bucket").exceptAll(old.select(*columns, "_bucket")).select("_bucket").distinct().collect()}
            if not changed:
                return set()
            folder = uuid.uuid4().hex
            own = self._rows([held["buckets"][str(b)] for b in sorted(changed) if str(b) in held["buckets"]])
            merged = self._merged(own, new.where(F.col("_bucket").isin(sorted(changed)))).select(*columns, "_bucket")
            merged.hint("rebalance", "_bucket").write.mode("errorifexists").partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
            number = held["number"] + 1
            made = {"number": number, "buckets": held["buckets"] | {str(b): f"{folder}/_bucket={b}" for b in changed}}
            if put_new(self.spark, f"{self.path}/versions/{number:012d}", json.dumps(made)):
                self._forget()
                return changed
            remove(self.spark, f"{self.path}/data/{folder}")  # another writer was faster
        raise RuntimeError(f"no version of {self.path} could be written in {attempts} attempts")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _latest(self, rows: DataFrame, tie: Column) -> DataFrame:
        """The row of each key with the largest order, then the later one, then the larger `tie`."""
        rest = [c for c in rows.columns if c not in self.keys]
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(self.order).isNotNull(), F.col(self.order), "_late", tie)).alias("row"))
        return best.select(*self.keys, *[F.col(f"row.{c}").alias(c) for c in rest])

    def _merged(self, old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.withColumn("_late", F.lit(0)).unionByName(new.withColumn("_late", F.lit(1)))
        return self._latest(both, F.lit(0)).drop("_late")

    def _rows(self, folders) -> DataFrame:
        folders = list(folders)
        if not folders:
            return self.spark.createDataFrame([], self.schema).withColumn("_bucket", F.lit(0))
        found = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])
        return found.select(*self.schema.fieldNames()).withColumn("_bucket", self._bucket())

    def _forget(self) -> None:
        """Drop versions beyond `keep`, and bucket folders that none of the kept names."""
        found = names_in(self.spark, f"{self.path}/versions")
        old, kept = found[: -self.keep], found[-self.keep :]
        if old:
            texts = [json.loads(t) for t in read_texts(self.spark, f"{self.path}/versions", old + kept)]
            named = {f for v in texts[len(old) :] for f in v["buckets"].values()}
            for name, version in zip(old, texts, strict=False):
                for folder in set(version["buckets"].values()) - named:
                    remove(self.spark, f"{self.path}/data/{folder}")
                remove(self.spark, f"{self.path}/versions/{name}")
