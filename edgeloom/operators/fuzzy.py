"""Fuzzy merge of near-equal organization names.

Two names merge when their token-sorted forms are at least 97 % alike, counting
insertions and deletions against both lengths, so the edits allowed grow with the names.

Equal names are one name until the end. Pairs that may be one edit apart, up to 33
characters, meet where one is the other without a character, so only such pairs meet, however
frequent their parts. Candidates of longer names come from a prefix filter. An edit touches at
most q of a name's q-grams, so of two names within k edits each holds all but q*k grams of the
other, and the q*k + 1 rarest grams of both have one in common. A name thus has about a fifth
as many keys as characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.constants import FUZZY_MIN_LENGTH, FUZZY_MIN_RATIO
from edgeloom.functions.names import qualifiers_differ, token_sorted
from edgeloom.session import cut_lineage

GRAM = 3


def edit_budget(total_length: Column) -> Column:
    """Insertions and deletions that two names of this joint length may need (in whole numbers: ratio in percent)."""
    return F.floor(total_length * (100 - FUZZY_MIN_RATIO) / F.lit(100)).cast("int")


def own_budget(length: Column) -> Column:
    """Largest budget any partner of a name of this length can bring: the partner is longer by at most the budget."""
    return F.floor(length * (2 * (100 - FUZZY_MIN_RATIO)) / F.lit(FUZZY_MIN_RATIO)).cast("int")


def rare_grams(names: DataFrame) -> DataFrame:
    """org_id, gram, place, size and budget: of each name the q*k + 1 grams that fewest names have.

    Repeats of a gram within a name are told apart by their number.
    """
    grams = F.transform(F.sequence(F.lit(1), F.length("t") - (GRAM - 1)), lambda i: F.substring("t", i, F.lit(GRAM)))
    placed = names.select("org_id", "budget", F.length("t").alias("size"), F.posexplode(grams).alias("place", "text"))
    again = F.row_number().over(Window.partitionBy("org_id", "text").orderBy("place"))
    numbered = placed.withColumn("gram", F.concat_ws("|", "text", again.cast("string"))).drop("text")
    counted = numbered.join(numbered.groupBy("gram").count(), "gram")
    rarest = F.row_number().over(Window.partitionBy("org_id").orderBy("count", "gram"))
    return counted.withColumn("_rank", rarest).where(F.col("_rank") <= F.col("budget") * GRAM + 1).drop("_rank", "count")


def one_edit_pairs(names: DataFrame) -> DataFrame:
    """Pairs (smaller id first) of equal forms, and those where one is the other without a character.

    These are all pairs with a budget of one edit at most. The longer name of such a pair has a
    partner length that no name of two edits has, so only such names give their shorter forms.
    """
    size = F.length("t")
    cut = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substring("t", F.lit(1), i - 1), F.substring("t", i + 1, size)))
    whole = names.select(F.col("org_id").alias("other_id"), F.col("t").alias("form"))
    shorter = names.where((F.col("budget") >= 1) & (own_budget(size - 1) <= 1)).select("org_id", F.explode(F.array_distinct(cut)).alias("form"))
    met = shorter.unionByName(names.select("org_id", F.col("t").alias("form"))).join(whole, "form").where("org_id <> other_id")
    return met.select(F.least("org_id", "other_id").alias("low_id"), F.greatest("org_id", "other_id").alias("high_id"))


def candidate_pairs(names: DataFrame) -> DataFrame:
    """Pairs (smaller id first) that may be similar."""
    return one_edit_pairs(names).unionByName(rare_gram_pairs(names.where("budget >= 2"))).distinct()


def rare_gram_pairs(names: DataFrame) -> DataFrame:
    """Pairs (smaller id first) with a rare gram in common, at nearly the same place in names of nearly the same length."""
    left = rare_grams(names)
    right = left.select("gram", *[F.col(c).alias(f"other_{c}") for c in ("org_id", "budget", "size", "place")])
    slack = F.greatest("budget", "other_budget")
    near = (F.abs(F.col("size") - F.col("other_size")) <= slack) & (F.abs(F.col("place") - F.col("other_place")) <= slack)
    met = left.join(right, "gram").where((F.col("org_id") < F.col("other_org_id")) & near)
    return met.select(F.col("org_id").alias("low_id"), F.col("other_org_id").alias("high_id"))


def _common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    mask = (1 << len(a)) - 1
    v = mask
    for ch in b:
        u = v & places.get(ch, 0)
        v = ((v + u) | (v - u)) & mask
    return len(a) - bin(v).count("1")


def _ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        values = [200.0 * _common_length(a, b) / (len(a) + len(b)) for a, b in zip(batch["a"], batch["b"])]
        yield batch[["low_id", "high_id"]].assign(ratio=values)


def similar_names(kept: DataFrame) -> DataFrame:
    """Pairs of organizations (smaller id first) with similar names, and how similar they are in percent."""
    names = kept.where(F.length("clean_name") >= FUZZY_MIN_LENGTH).select("org_id", "clean_name", token_sorted("clean_name").alias("t"))
    names = names.withColumn("budget", own_budget(F.length("t")))
    pairs = candidate_pairs(names)

    def side(s: str, p: str) -> DataFrame:
        return names.select(F.col("org_id").alias(f"{s}_id"), F.col("t").alias(p), F.col("clean_name").alias(f"name_{p}"))

    texts = pairs.join(side("low", "a"), "low_id").join(side("high", "b"), "high_id").where(~qualifiers_differ("name_a", "name_b"))
    # Plain edit distance never exceeds the insert/delete distance, so this drops far pairs inside the JVM.
    near = texts.where(F.levenshtein("a", "b") <= edit_budget(F.length("a") + F.length("b")))
    rated = near.select("low_id", "high_id", "a", "b").mapInPandas(_ratios, "low_id string, high_id string, ratio double")
    return rated.where(F.col("ratio") >= FUZZY_MIN_RATIO)


def fuzzy_merge(kept: DataFrame) -> DataFrame:
    """Removed organizations with the survivor that takes them over: old_org_id, survivor_id, ratio.

    Going by id, a name survives unless a surviving earlier name is similar; it
    goes to the earliest such survivor. That is settled in rounds: a name
    survives once all its earlier neighbours are gone, and is gone once one of
    them survives. Every round settles at least the earliest open name of each
    cluster, so the number of rounds is that of the longest chain. Equal names share their
    neighbours, so the first of them stands for all: the others go where it goes, or to it.
    """
    long = kept.where(F.length("clean_name") >= FUZZY_MIN_LENGTH).select("org_id", "clean_name")
    firsts = cut_lineage(long.groupBy("clean_name").agg(F.min("org_id").alias("org_id")))
    merged = _merge_distinct(firsts)
    owner = firsts.withColumnRenamed("org_id", "first_id").join(merged.withColumnRenamed("old_org_id", "first_id"), "first_id", "left")
    others = long.join(owner, "clean_name").where("org_id <> first_id").select(
        F.col("org_id").alias("old_org_id"), F.coalesce("survivor_id", "first_id").alias("survivor_id"), F.coalesce("ratio", F.lit(100.0)).alias("ratio"))
    return merged.unionByName(others)


def _merge_distinct(kept: DataFrame) -> DataFrame:
    edges = cut_lineage(similar_names(kept))
    nodes = edges.select(F.col("low_id").alias("id")).unionByName(edges.select(F.col("high_id").alias("id"))).distinct()
    state = nodes.withColumn("state", F.lit("open"))
    while not state.where("state = 'open'").isEmpty():
        earlier = edges.join(state.select(F.col("id").alias("low_id"), F.col("state").alias("low_state")), "low_id")
        seen = earlier.groupBy(F.col("high_id").alias("id")).agg(
            F.bool_or(F.col("low_state") == "kept").alias("beaten"), F.bool_or(F.col("low_state") == "open").alias("waiting")
        )
        no = F.lit(False)
        state = cut_lineage(state.join(seen, "id", "left").select("id", F.when(F.col("state") != "open", F.col("state"))
                            .when(F.coalesce("beaten", no), "gone").when(F.coalesce("waiting", no), "open").otherwise("kept").alias("state")))
    kept_ids = state.where("state = 'kept'").select(F.col("id").alias("low_id"))
    gone_ids = state.where("state = 'gone'").select(F.col("id").alias("high_id"))
    return edges.join(kept_ids, "low_id", "left_semi").join(gone_ids, "high_id", "left_semi").groupBy(F.col("high_id").alias("old_org_id")).agg(
        F.min_by(F.struct(F.col("low_id").alias("survivor_id"), "ratio"), "low_id").alias("s")
    ).select("old_org_id", "s.survivor_id", "s.ratio")
