"""Stages joined up: feeds to graph, graph to checked graph."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from edgeloom.constants import STATUS_THRESHOLDS
from edgeloom.operators import baselines, candidates, constraints, edges, facts, inventory, intervals, pairs, scoring, update
from edgeloom.session import cut_lineage
from edgeloom.functions.names import light_name, lookup_name
from edgeloom.operators.dictionary import feed_a_dictionary, feed_b_dictionary, hot_names


@dataclass
class Graph:
    """Edges from two feeds and an organization table.

    Frames are built on first use. With `cut`, the tables that several later
    stages read (fused edges, intervals, pair counts, candidate pool, final constraints,
    conflicts, updated edges) are written to the checkpoint folder, so the feeds are read once; without it only the counts of events are.
    With `spread`, names that hold very many events of a feed are found first and looked up by broadcast.
    """

    feed_a: DataFrame
    feed_b: DataFrame
    organizations: DataFrame
    aliases: DataFrame | None = None
    spread: bool = False
    cut: bool = False

    def stage(self, df: DataFrame) -> DataFrame:
        return cut_lineage(df) if self.cut else df

    def _hot(self, names: DataFrame) -> list[str]:
        return sorted({n for found in hot_names(names, "s", "o").values() for n in found}) if self.spread else []

    @cached_property
    def a_dictionary(self) -> DataFrame:
        return feed_a_dictionary(self.organizations, self.aliases)

    @cached_property
    def b_dictionary(self) -> DataFrame:
        return feed_b_dictionary(self.organizations)

    @cached_property
    def a_hot(self) -> list[str]:
        events = facts.standard_feed_a(self.feed_a)
        return self._hot(events.select(lookup_name("source_name").alias("s"), lookup_name("target_name").alias("o")))

    @cached_property
    def b_hot(self) -> list[str]:
        return self._hot(self.feed_b.select(light_name("Actor1Name").alias("s"), light_name("Actor2Name").alias("o")))

    @cached_property
    def facts(self) -> DataFrame:
        return facts.event_facts(self.feed_a, self.a_dictionary)

    @cached_property
    def seed(self) -> DataFrame:
        return facts.seed_edges(self.feed_a, self.a_dictionary, self.a_hot)

    @cached_property
    def classified(self) -> DataFrame:
        return edges.classified_events(self.feed_b, self.b_dictionary, self.b_hot)

    @cached_property
    def classified_months(self) -> DataFrame:
        """As `classified`, with months for days: far fewer rows where a pair meets on many days."""
        return edges.classified_events(self.feed_b, self.b_dictionary, self.b_hot, by_month=True)

    @cached_property
    def edges(self) -> DataFrame:
        return self.stage(edges.fused_edges(self.seed, self.classified_months))

    @cached_property
    def scored(self) -> DataFrame:
        return scoring.score_edges(self.edges)

    @cached_property
    def interval_table(self) -> DataFrame:
        return self.stage(intervals.edge_intervals(self.scored))

    @cached_property
    def intervals(self) -> DataFrame:
        return intervals.numbered(self.interval_table)

    @cached_property
    def pair_counts(self) -> DataFrame:
        return self.stage(pairs.pair_counts(self.intervals))

    @cached_property
    def inventory(self) -> DataFrame:
        return inventory.relation_inventory(self.scored, self.intervals)

    @cached_property
    def pair_summary(self) -> DataFrame:
        return pairs.pair_summary(self.intervals, self.pair_counts)

    @cached_property
    def pool(self) -> DataFrame:
        # The pool reads only code and interval_count, so column pruning drops the example texts.
        return self.stage(candidates.candidate_pool(self.inventory, self.pair_summary))

    @cached_property
    def weights(self) -> DataFrame:
        return scoring.source_weights(self.scored)


@dataclass
class Check:
    """Candidate constraints scored on a graph and applied to its edges."""

    graph: Graph
    candidates: DataFrame
    manual: DataFrame | None = None
    thresholds: dict | None = None

    @cached_property
    def scored(self) -> DataFrame:
        g = self.graph
        return constraints.score_constraints(
            g.intervals, self.candidates, g.weights, g.pair_counts, self.thresholds or STATUS_THRESHOLDS
        )

    @cached_property
    def final(self) -> DataFrame:
        return self.graph.stage(constraints.final_constraints(self.scored, self.manual))

    @cached_property
    def entries(self) -> DataFrame:
        # The one window over edges: conflicts, decisions and updated edges are all read from its result.
        return self.graph.stage(update.edge_entries(self.graph.scored, self.final))

    @cached_property
    def sides(self) -> DataFrame:
        return update.edge_sides(self.entries)

    @cached_property
    def conflicts(self) -> DataFrame:
        return self.graph.stage(update.conflicts(self.sides))

    @cached_property
    def decisions(self) -> DataFrame:
        return update.decisions(self.entries)

    @cached_property
    def after(self) -> DataFrame:
        return self.graph.stage(update.legacy_edges(update.updated_edges(self.entries)))

    @cached_property
    def methods(self) -> DataFrame:
        return baselines.compare_methods(self.graph.edges, self.candidates, self.after)
