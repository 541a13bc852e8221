"""Repository metrics from daily states, merged over any window without the events.

A day's state is two tables. `sums` has one row per repository and day: additive
measures, the earliest creation, whether a human was seen, and a sketch of its
collaborators. `actors` has one row per repository, day and collaborator, which is
what an exact count of distinct people needs and no sum can replace. Both are
aggregates of that day alone, so a day is added, or replaced, without touching
others, and days are merged by the same aggregates.

The sketch (HyperLogLog, 2^12 registers) merges as well and is far smaller; its
relative standard error is about 1.04 / sqrt(2^12), that is 1.6 %. `exact=False` uses it.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracestrata import contracts as C
from tracestrata.functions import predicates as P
from tracestrata.functions import scalars as S
from tracestrata.operators import metrics

SKETCH_BITS = 12
_SUMS = ("workload_cum", "external_popularity_cum", "community_engagement_cum")


def _day() -> Column:
    return F.make_date("anno", "mese", "giorno")


def day_sums(events: DataFrame) -> DataFrame:
    """(repo_id, day, sums, created, seen_human, collaborators) of each repository and day."""
    C.require_columns(events, (*C.METRIC_EVENTS, "timestamp", "create_ref_type", "anno", "mese", "giorno"), "events")
    human = P.is_human()
    volume, popularity, engagement, _ = metrics.measures(
        P.is_popularity(), P.is_engagement(), P.is_collaboration(), human
    )
    author = F.when(human & P.is_collaboration(), F.col("actor_id"))
    return events.where(F.col("repo_id").isNotNull()).groupBy("repo_id", _day().alias("day")).agg(
        volume,
        popularity,
        engagement,
        F.min(F.when(P.is_repo_creation(), F.col("timestamp").cast("timestamp"))).alias("created"),
        F.max(human).alias("seen_human"),
        F.hll_sketch_agg(author, F.lit(SKETCH_BITS)).alias("collaborators"),
    )


def day_actors(events: DataFrame) -> DataFrame:
    """(repo_id, day, actor_id) of everybody who collaborated, once a day; an unknown actor is null."""
    acted = events.where(P.is_human() & P.is_collaboration() & F.col("repo_id").isNotNull())
    return acted.select("repo_id", _day().alias("day"), "actor_id").distinct()


def repo_metrics_from_days(
    sums: DataFrame, actors: DataFrame | None, end: str, first: date | None = None, last: date | None = None
) -> DataFrame:
    """The metrics of the repositories created in the days from `first` to `last` (all: None).

    Same rows as `metrics.repo_metrics_of_born` over the events of these days. Without
    `actors` the number of collaborators is the sketch's estimate.
    """
    def within(table: DataFrame) -> DataFrame:
        table = table if first is None else table.where(F.col("day") >= F.lit(first))
        return table if last is None else table.where(F.col("day") <= F.lit(last))

    merged = within(sums).groupBy("repo_id").agg(
        *(F.sum(c).alias(c) for c in _SUMS),
        F.min("created").alias("repo_creation_date"),
        F.max("seen_human").alias("seen_human"),
        F.hll_sketch_estimate(F.hll_union_agg("collaborators")).alias("collaboration_intensity_cum"),
    )
    born = merged.where(F.col("seen_human") & F.col("repo_creation_date").isNotNull()).drop("seen_human")
    if actors is not None:
        people = within(actors).groupBy("repo_id").agg(
            (F.count_distinct("actor_id") + F.max(F.col("actor_id").isNull().cast("int"))).alias("people")
        )
        exact = F.coalesce("people", F.lit(0)).cast("long").alias("collaboration_intensity_cum")
        names = [c for c in born.columns if c != "collaboration_intensity_cum"]
        born = born.join(people, "repo_id", "left").select(*names, exact)
    return metrics.with_rates(born, end)
