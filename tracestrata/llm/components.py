"""Connected components of a graph given as links, as rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracestrata import materialize
from tracestrata.llm.joins import tasks_for

_SUM = "decimal(38,0)"


def _state(links: DataFrame) -> tuple:
    """What tells two sets of links apart: their number and a checksum."""
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast(_SUM))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of `links` (a, b).

    Alternates large-star and small-star rounds until no link changes; then
    every node links to the smallest of its component. Rows never leave the
    executors but for a count and a checksum per round. Each step goes on in as
    many partitions as the counted links are worth (a round at most doubles them).
    """
    links = materialize(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b").distinct()
    )
    before = _state(links)
    # Every round that changes a link brings some closer to the smallest, so this ends.
    while before[0]:
        tasks = tasks_for(2 * before[0])
        links = links.coalesce(tasks)
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Larger neighbours of each node link to its smallest neighbour or itself.
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .coalesce(tasks).distinct().coalesce(tasks)
        )
        # Smaller neighbours of each node, and the node, link to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = materialize(
            small.union(low.select("a", F.col("m").alias("b"))).where("a <> b")
            .coalesce(tasks).distinct().coalesce(tasks)
        )
        after = _state(links)
        if after == before:
            break
        before = after
    links = links.coalesce(tasks_for(before[0]))
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(links.select("b", "b")).distinct()
