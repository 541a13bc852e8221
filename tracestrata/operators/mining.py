"""Dependency-graph discovery after the published heuristics miner (2006).

All inputs here are flow tables: at most activities squared rows per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracestrata.operators.eventlog import directly_follows, occurrences
from tracestrata.settings import MinerSettings

BY = ("archetype",)


def dependency_scores(flow: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Directly-follows pairs with their dependency and length-two-loop measures.

    Both directions of a pair meet in one window over (group, unordered pair),
    so no self join is needed.
    """
    both = W.partitionBy(*by, F.least("source", "target"), F.greatest("source", "target"))
    loop = F.col("source") == F.col("target")
    count = F.col("frequency")
    total = F.sum("frequency").over(both)
    total_loops = F.sum("two_loop").over(both)
    return directly_follows(flow).withColumns(
        {
            "dependency": F.when(loop, count / (count + 1.0)).otherwise(
                (2 * count - total) / (total + 1.0)
            ),
            "loop_two": F.when(~loop, total_loops / (total_loops + 1.0)),
        }
    )


def discover_net(
    flow: DataFrame, settings: MinerSettings = MinerSettings(), by: Sequence[str] = BY
) -> DataFrame:
    """Edges of the dependency graph: (group, source, target, frequency,
    mean_seconds, dependency, kind), kind being dependency, self_loop or two_loop.
    """
    loop = F.col("source") == F.col("target")
    self_count = F.max(F.when(loop, F.col("frequency")).otherwise(0))
    keeps_self = (self_count >= settings.min_edge) & (
        self_count / (self_count + 1.0) >= settings.dependency
    )
    activities = (
        flow.groupBy(*by, F.col("source").alias("activity"))
        .agg(F.sum("frequency").alias("occurrences"), keeps_self.alias("self_loop"))
        .where(F.col("occurrences") >= settings.min_activity)
        .drop("occurrences")
    )

    def end(role: str) -> DataFrame:
        return activities.select(
            *by,
            F.col("activity").alias(role),
            F.col("self_loop").alias(f"{role}_loops"),
        )

    frequent = dependency_scores(flow, by).where(F.col("frequency") >= settings.min_edge)
    scored = frequent.join(end("source"), [*by, "source"]).join(end("target"), [*by, "target"])
    two_loop = (
        (F.col("loop_two") >= settings.loop_two)
        & ~F.col("source_loops")
        & ~F.col("target_loops")
    )
    strong = F.col("dependency") >= settings.dependency
    kind = (
        F.when(strong & loop, "self_loop").when(strong, "dependency").when(two_loop, "two_loop")
    )
    return (
        scored.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(
            *by, "source", "target", "frequency", "mean_seconds", "dependency", "kind"
        )
    )


def net_nodes(edges: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Activities touched by an edge of the net."""
    ends = F.explode(F.array("source", "target")).alias("activity")
    return edges.select(*by, ends).distinct()


def model_nodes(
    flow: DataFrame, edges: DataFrame, by: Sequence[str] = BY
) -> DataFrame:
    """Every activity of the log with its count and whether the net contains it."""
    counts = occurrences(flow, by)
    inside = net_nodes(edges, by).withColumn("in_net", F.lit(True))
    return counts.join(inside, [*by, "activity"], "left").withColumn(
        "in_net", F.coalesce("in_net", F.lit(False))
    )


def concurrency(
    flow: DataFrame,
    edges: DataFrame,
    settings: MinerSettings = MinerSettings(),
    by: Sequence[str] = BY,
) -> DataFrame:
    """AND measure of each two outgoing edges of one activity.

    Pairs are of net edges: their number is bounded by the activity vocabulary
    of a group, whatever the size of its log.
    """
    together = (
        directly_follows(flow)
        .where(F.col("source") != F.col("target"))
        .groupBy(
            *by,
            F.least("source", "target").alias("first"),
            F.greatest("source", "target").alias("second"),
        )
        .agg(F.sum("frequency").alias("crossings"))
    )

    def branch(role: str) -> DataFrame:
        return edges.select(
            *by,
            "source",
            F.col("target").alias(role),
            F.col("frequency").alias(f"{role}_frequency"),
        )

    splits = branch("first").join(branch("second"), [*by, "source"])
    splits = splits.where(F.col("first") < F.col("second"))
    measured = splits.join(together, [*by, "first", "second"], "left").withColumn(
        "and_measure",
        F.coalesce("crossings", F.lit(0))
        / (F.col("first_frequency") + F.col("second_frequency") + 1.0),
    )
    return measured.select(
        *by,
        "source",
        "first",
        "second",
        "and_measure",
        (F.col("and_measure") >= settings.and_measure).alias("concurrent"),
    )
