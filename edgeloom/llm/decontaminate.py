"""Benchmark decontamination with a positional inverted index (operator 8), DataFrame functions only.

The postings of the documents' words that occur in the benchmark are written once, with a
row for each document that holds its number of words. A window of benchmark words starts
from the postings of its rarest word in the corpus; what the second rarest confirms at its
offset is then checked against all other words of the window. With a slop, words may
lie so many places off their offset from the rarest one.

Defined results: null and wordless texts have no words and are clean. Rows that repeat a
doc_id keep a row each; rows that repeat the text too have equal results. A null doc_id
stays null. A null item_id counts as the item named by the empty string; items with the
same item_id are one item. Without items or documents there are no hits or no rows. Other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import broadcast_if_small, id_and_text
from edgeloom.session import cut_lineage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for a null doc_id in joins; `key` tells it from a document that has this id.
NO_ID = -(1 << 63)
#: Rows of a few numbers that are sent to all executors, some 10 MB; a larger benchmark is joined by shuffles.
SMALL = 200_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, UPPER.lower()), F.lit(WORD), F.lit(0))


def windows(items: DataFrame, width: int = 10) -> DataFrame:
    """(item, window_id, terms): each run of `width` words, or the whole of an item of fewer."""
    split = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1))))
    runs = split.select("item", "w", starts.alias("s")).select("item", F.slice("w", F.col("s"), F.lit(width)).alias("terms"))
    return runs.select("item", F.xxhash64("terms").alias("window_id"), F.transform("terms", lambda t: F.xxhash64(t)).alias("terms")).distinct()


@dataclass
class Index:
    """postings: (doc, key, pos, term). lengths: (doc, key, n_words), a row for each document row."""

    postings: DataFrame
    lengths: DataFrame


def build_index(docs: DataFrame, terms: DataFrame) -> Index:
    """Postings of the words whose hashes `terms` (term) has, in the shared folder."""
    texts = id_and_text(docs).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("doc_id", "text").alias("key"), words(F.col("text")).alias("w")
    )
    # The null after the last word stands at the number of words.
    placed = texts.select("doc", "key", F.posexplode(F.concat("w", F.array(F.lit(None).cast("string")))).alias("pos", "word"))
    placed = placed.select("doc", "key", "pos", F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("term"), F.col("word").isNull().alias("end"))
    wanted = broadcast_if_small(terms.select(F.col("term").alias("known")), SMALL)
    kept = cut_lineage(placed.join(wanted, F.col("term") == F.col("known"), "left").where("end or known is not null").drop("known"))
    return Index(kept.where("not end").drop("end"), kept.where("end").select("doc", "key", F.col("pos").alias("n_words")))


def find(index: Index, sought: DataFrame, slop: int = 0) -> DataFrame:
    """(doc, key, window_id, start, width) where a window (window_id, terms) occurs.

    start is where its first word stands, or would stand next to the rarest one.
    """
    frequency = index.postings.groupBy("term").count()
    placed = sought.select("window_id", F.size("terms").alias("width"), F.posexplode("terms").alias("off", "term"))
    counted = placed.join(frequency, "term")
    rarity = Window.partitionBy("window_id").orderBy("count", "off")
    whole = Window.partitionBy("window_id")
    # A window with a word that no document has can't occur.
    ordered = counted.withColumn("rank", F.row_number().over(rarity)).withColumn("n", F.count("*").over(whole)).where("n = width").drop("n", "count")
    ordered = cut_lineage(ordered)
    first = broadcast_if_small(ordered.where("rank = 1").select("term", "window_id", "width", "off"), SMALL)
    found = index.postings.join(first, "term").select("doc", "key", "window_id", "width", (F.col("pos") - F.col("off")).alias("start"))
    if not slop:
        found = found.where("start >= 0")
    # As a stage table, for the next step reads them twice and its plan would hold all this twice.
    found = cut_lineage(found.distinct())
    found = cut_lineage(_confirm(index, found, ordered.where("rank = 2"), slop))
    return cut_lineage(_confirm(index, found, ordered.where("rank > 2"), slop))


def _confirm(index: Index, found: DataFrame, terms: DataFrame, slop: int) -> DataFrame:
    """Candidates for which the postings hold all these terms of their windows, at the offsets give or take the slop."""
    each = terms.groupBy("window_id").agg(F.sort_array(F.collect_list(F.struct("off", "term"))).alias("rest"))
    asked = found.join(each, "window_id", "left")
    due = asked.where("rest is not null").select("doc", "key", "window_id", "width", "start", F.size("rest").alias("n"), F.explode("rest").alias("t"))
    shifts = F.explode(F.sequence(F.lit(-slop), F.lit(slop))) if slop else F.lit(0)
    due = due.select("doc", "key", "window_id", "width", "start", "n", F.col("t.off").alias("off"), F.col("t.term").alias("term"), shifts.alias("shift"))
    due = due.withColumn("pos", F.col("start") + F.col("off") + F.col("shift"))
    held = index.postings.join(broadcast_if_small(terms.select("term").distinct(), SMALL), "term", "left_semi")
    met = due.join(held, ["doc", "key", "pos", "term"]).select("doc", "key", "window_id", "width", "start", "n", "off").distinct()
    whole = met.groupBy("doc", "key", "window_id", "width", "start", "n").count().where("count = n").drop("n", "count")
    return asked.where("rest is null").drop("rest").unionByName(whole)


def occurrences(docs: DataFrame, sought: DataFrame) -> tuple[Index, DataFrame]:
    """The index for the windows (item, window_id, terms) and where they occur, as `find` gives it."""
    distinct = sought.select("window_id", "terms").distinct()
    terms = cut_lineage(distinct.select(F.explode("terms").alias("term")).distinct())
    index = build_index(docs, terms)
    return index, find(index, distinct)


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and the document's key)."""
    sought = cut_lineage(windows(items, width))
    index, found = occurrences(docs, sought)
    # Words that a window covers and none that starts before it does.
    order = Window.partitionBy("doc", "key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("doc", "key", "start", (F.col("start") + F.col("width")).alias("end")).distinct()
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(order), F.lit(0))))
    hits = spans.withColumn("new", new).groupBy("doc", "key").agg(F.sum("new").alias("n_hit"))
    # A set has at most as many members as the benchmark has items.
    named = found.select("doc", "key", "window_id").join(sought.select("window_id", "item"), "window_id").groupBy("doc", "key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    seen = hits.join(named, ["doc", "key"])
    out = index.lengths.join(seen, ["doc", "key"], "left")
    return out.select(
        F.expr(f"nullif(doc, {NO_ID + 1} - 1)").alias("doc_id"),
        F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        "key",
    )


def clean_only(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns."""
    _, found = occurrences(docs, cut_lineage(windows(items, width)))
    dirty = cut_lineage(found.select("key").distinct())
    key = F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))
    return rows.join(broadcast_if_small(dirty, SMALL), "key", "left_anti").select("row.*")
