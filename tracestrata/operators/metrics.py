"""Repository lookup and per-repository metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracestrata import contracts as C
from tracestrata.functions import predicates as P
from tracestrata.functions import scalars as S
from tracestrata.functions import vocabulary as V


def creation_lookup(creation_events: DataFrame) -> DataFrame:
    """One row per repository: its earliest creation event."""
    C.require_columns(creation_events, C.CREATION_EVENTS, "creation events")
    return creation_events.groupBy("repo_id").agg(
        F.min(F.col("timestamp").cast("timestamp")).alias("repo_creation_date")
    )


def creation_events(events: DataFrame) -> DataFrame:
    """The creation events among canonical events."""
    C.require_columns(events, C.CORE_EVENTS, "core events")
    return events.where(P.is_repo_creation()).select("repo_id", "timestamp")


def dataset_counts(events: DataFrame) -> DataFrame:
    """One row: events, repositories seen, and repositories created."""
    return events.groupBy("repo_id").agg(
        F.count("*").alias("n"), F.max(P.is_repo_creation()).alias("born")
    ).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("events"),
        F.count("repo_id").alias("repositories"),
        F.count_if("born").alias("created"),
    )


def measures(
    popularity: Column, engagement: Column, collaboration: Column, counted: Column
) -> list[Column]:
    """Aggregates per repository over the events for which `counted` holds.

    An actor without id counts as one more collaborator.
    """
    push = counted & (F.col("activity") == "PushEvent")
    author = F.when(counted & collaboration, F.col("actor_id"))
    nameless = F.max(F.when(counted & collaboration & F.col("actor_id").isNull(), 1))

    def hits(flag: Column) -> Column:
        return F.sum(F.when(counted & flag, 1).otherwise(0))

    volume = F.sum(F.when(push, F.col("push_size").cast("double")))
    return [
        F.coalesce(volume, F.lit(0.0)).alias("workload_cum"),
        hits(popularity).alias("external_popularity_cum"),
        hits(engagement).alias("community_engagement_cum"),
        (F.count_distinct(author) + F.coalesce(nameless, F.lit(0))).alias(
            "collaboration_intensity_cum"
        ),
    ]


def with_rates(sums: DataFrame, end: str) -> DataFrame:
    """Add the age and the per-day rates; repositories younger than a day drop out."""
    age = S.whole_days(F.col("repo_creation_date"), S.utc_timestamp(S.parse_utc(end)))
    aged = sums.withColumn("age_in_days", age).where(F.col("age_in_days") > 0)
    rates = {
        f"{d}_norm": F.coalesce(F.try_divide(F.col(f"{d}_cum"), F.col("age_in_days")), F.lit(0.0))
        for d in V.DIMENSIONS
    }
    return aged.withColumns(rates)


def repo_metrics(
    events: DataFrame,
    lookup: DataFrame,
    end: str,
    popularity: Column | None = None,
    engagement: Column | None = None,
    collaboration: Column | None = None,
) -> DataFrame:
    """Cumulative and per-day metrics of the repositories in `lookup`.

    Events are summed per repository before the lookup is joined, so a giant
    repository is combined map-side and raw events are never shuffled to the
    join. Distinct collaborators are first spread by (repository, actor).
    """
    C.require_columns(events, C.METRIC_EVENTS, "events")
    C.require_columns(lookup, C.LOOKUP, "lookup")
    S.parse_utc(end)
    sums = (
        events.where(P.is_human())
        .groupBy("repo_id")
        .agg(
            *measures(
                P.is_popularity() if popularity is None else popularity,
                P.is_engagement() if engagement is None else engagement,
                P.is_collaboration() if collaboration is None else collaboration,
                F.lit(True),
            )
        )
    )
    dated = lookup.select(
        "repo_id", F.col("repo_creation_date").cast("timestamp").alias("repo_creation_date")
    )
    return with_rates(sums.join(dated, "repo_id"), end)


def repo_metrics_of_born(
    events: DataFrame,
    end: str,
    popularity: Column | None = None,
    engagement: Column | None = None,
    collaboration: Column | None = None,
) -> DataFrame:
    """Same rows as `repo_metrics` with the lookup drawn from the same events.

    The creation date is one more conditional aggregate, which leaves a single
    scan and no join at all.
    """
    C.require_columns(events, (*C.METRIC_EVENTS, "timestamp", "create_ref_type"), "events")
    S.parse_utc(end)
    born = F.min(F.when(P.is_repo_creation(), F.col("timestamp").cast("timestamp")))
    human = P.is_human()
    sums = (
        events.groupBy("repo_id")
        .agg(
            *measures(
                P.is_popularity() if popularity is None else popularity,
                P.is_engagement() if engagement is None else engagement,
                P.is_collaboration() if collaboration is None else collaboration,
                human,
            ),
            born.alias("repo_creation_date"),
            F.max(human).alias("seen_human"),
        )
        .where(F.col("seen_human") & F.col("repo_creation_date").isNotNull())
        .drop("seen_human")
    )
    return with_rates(sums.where(F.col("repo_id").isNotNull()), end)
