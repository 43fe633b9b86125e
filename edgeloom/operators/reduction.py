"""Reduction of a large feed B to events between organizations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from edgeloom.constants import REDUCTION_COLUMNS
from edgeloom.functions.names import reduction_signal
from edgeloom.functions.parse import clean_text
from edgeloom.operators.ids import dense_ids
from edgeloom.sources.columns import keep_existing, with_missing

NEEDED = tuple(
    f"{p}{f}" for p in ("Actor1", "Actor2") for f in ("Name", "KnownGroupCode", "Type1Code", "Type2Code", "Type3Code")
)


def named_actors(both: bool = True) -> Column:
    first, second = clean_text("Actor1Name") != "", clean_text("Actor2Name") != ""
    return first & second if both else first | second


def between_organizations(mode: str = "both_org") -> Column:
    first, second = reduction_signal("Actor1"), reduction_signal("Actor2")
    return first & second if mode == "both_org" else first | second


def sample_by_hash(df: DataFrame, every: int, *key: str) -> DataFrame:
    """One row in `every`, chosen by the hash of its key: no order, no shuffle, same rows on every run."""
    return df if every <= 1 else df.where(F.pmod(F.xxhash64(*key), F.lit(every)) == 0)


def sample_by_position(df: DataFrame, every: int, *order: str) -> DataFrame:
    """Rows 1, 1 + every, ... in a declared total order, numbered without sorting everything in one task."""
    if every <= 1:
        return df
    numbered = dense_ids(df, list(order), "_position")
    return numbered.where(F.col("_position").cast("bigint") % every == 1).drop("_position")


def reduce_events(events: DataFrame, mode: str = "both_org", both_names: bool = True, every: int = 1, *key: str) -> DataFrame:
    """Organization events with the kept columns. Narrow: filters and a projection at the scan."""
    rows = with_missing(events, NEEDED)
    rows = rows.where(named_actors(both_names) & between_organizations(mode))
    if every > 1:
        rows = sample_by_hash(rows, every, *key)
    names = {c: clean_text(c) for c in ("Actor1Name", "Actor2Name")}
    return keep_existing(rows.withColumns(names), (*REDUCTION_COLUMNS, "event_seq"))


def counted_write(events: DataFrame, path: str, **options) -> dict[str, int]:
    """Write the reduction and count rows read and written in the same pass."""
    raw, written = Observation("raw"), Observation("written")
    seen = events.observe(raw, F.count(F.lit(1)).alias("rows"))
    out = reduce_events(seen, **options).observe(written, F.count(F.lit(1)).alias("rows"))
    out.write.mode("overwrite").parquet(path)
    return {"raw_rows": raw.get["rows"], "written_rows": written.get["rows"]}
