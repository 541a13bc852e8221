"""Event logs: traces of named steps, their neighbours, and the flow table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracestrata import contracts as C
from tracestrata.functions import predicates as P
from tracestrata.functions import scalars as S
from tracestrata.errors import ContractError
from tracestrata.operators import skew, traces
from tracestrata.settings import HOT_KEY_ROWS


def named_events(events: DataFrame) -> DataFrame:
    """Human core-workflow events with their step name; nameless steps drop out."""
    columns = events.columns
    core = events.where(P.is_human() & P.is_core_workflow() & P.has_step_name(columns))
    return core.withColumn("step", P.step_name(columns))


def event_log(
    events: DataFrame,
    membership: DataFrame | None = None,
    by: str = "archetype",
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Flat log (group, case_id, activity, timestamp, resource, event_seq).

    With a membership table (repo_id, group) every group's log is built in one
    pass over the events; a repository in two groups contributes to both.
    Without one, the input must already carry the group column.
    """
    C.require_columns(events, C.LOG_EVENTS, "events")
    named = named_events(events).where(
        F.col("actor_id").isNotNull() & F.col("repo_id").isNotNull()
    )
    if membership is not None:
        needed = named.select(
            "repo_id", "actor_id", "step", "timestamp", "actor_login", "event_seq"
        )
        named = skew.keyed_join(needed, membership, "repo_id", min_rows=hot_rows)
    return named.select(
        by,
        S.case_key().alias("case_id"),
        F.col("step").alias("activity"),
        F.col("timestamp").cast("timestamp").alias("timestamp"),
        F.col("actor_login").alias("resource"),
        "event_seq",
    )


def successors(
    log: DataFrame,
    case: Sequence[str] = ("archetype", "case_id"),
    order: Sequence[str] = ("timestamp", "event_seq"),
    carried: Sequence[str] = ("activity", "timestamp"),
    chunk: Column | None = None,
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Every event with the next two events of its case.

    Adds the structs ``next`` and ``next2`` holding the `carried` columns, null
    past the end of the case. `order` must be total within a case.

    Cases with `hot_rows` events or more, too large for one task, are ordered by
    range partitioning instead (`traces.neighbours`), which may cut them anywhere; so
    `chunk`, where earlier versions cut them, is no longer needed and has no effect.
    """
    step = F.struct(*(F.col(c) for c in carried))

    def with_leads(df: DataFrame) -> DataFrame:
        window = W.partitionBy(*case).orderBy(*order)
        return df.withColumns(
            {"next": F.lead(step, 1).over(window), "next2": F.lead(step, 2).over(window)}
        )

    hot = skew.hot_keys(log, case, hot_rows)
    if not hot:
        return with_leads(log)
    ordinary, large = skew.split(log, case, hot)
    return with_leads(ordinary).unionByName(traces.neighbours(large, case, order, carried, hot_rows))


def flow_table(
    steps: DataFrame,
    by: Sequence[str] = ("archetype",),
    activity: str = "activity",
    time: str | None = "timestamp",
    statistic: str = "mean",
) -> DataFrame:
    """All counts a process model needs, from one pass over `successors`.

    (group, source, target, frequency, mean_seconds, two_loop): one row per
    directly-follows pair, plus one row with a null target per activity that
    ends cases. ``two_loop`` counts how often source, target, source follow.
    """
    if statistic not in ("mean", "median"):
        raise ContractError(f"unknown statistic {statistic}")
    target = F.col(f"next.{activity}")
    measures = [F.count("*").alias("frequency")]
    if time is None:
        measures.append(F.lit(None).cast("double").alias("mean_seconds"))
    else:
        ahead, here = F.col(f"next.{time}"), F.col(time)
        seconds = (F.unix_micros(ahead) - F.unix_micros(here)) / 1_000_000
        summary = F.avg(seconds) if statistic == "mean" else F.percentile_approx(seconds, 0.5)
        measures.append(summary.alias("mean_seconds"))
    back = (F.col(f"next2.{activity}") == F.col(activity)) & (target != F.col(activity))
    measures.append(F.count_if(back).alias("two_loop"))
    return steps.groupBy(
        *by, F.col(activity).alias("source"), target.alias("target")
    ).agg(*measures)


def directly_follows(flow: DataFrame) -> DataFrame:
    """The directly-follows pairs of a flow table."""
    return flow.where(F.col("target").isNotNull())


def occurrences(flow: DataFrame, by: Sequence[str] = ("archetype",)) -> DataFrame:
    """Events per activity: each one either has a successor or ends its case."""
    return flow.groupBy(*by, F.col("source").alias("activity")).agg(
        F.sum("frequency").alias("occurrences")
    )


def activity_counts(
    log: DataFrame, by: Sequence[str] = ("archetype",), activity: str = "activity"
) -> DataFrame:
    """Events per activity, straight from a log."""
    return log.groupBy(*by, F.col(activity).alias("activity")).agg(
        F.count("*").alias("occurrences")
    )


def _edge_activities(
    log: DataFrame,
    pick: str,
    by: Sequence[str],
    case: Sequence[str],
    order: Sequence[str],
    activity: str,
) -> DataFrame:
    rank = F.struct(*order)
    choose = F.min_by if pick == "first" else F.max_by
    ends = log.groupBy(*dict.fromkeys([*by, *case])).agg(choose(activity, rank).alias("activity"))
    return ends.groupBy(*by, "activity").agg(F.count("*").alias("cases"))


def start_activities(
    log: DataFrame,
    by: Sequence[str] = ("archetype",),
    case: Sequence[str] = ("archetype", "case_id"),
    order: Sequence[str] = ("timestamp", "event_seq"),
    activity: str = "activity",
) -> DataFrame:
    """How many cases begin with each activity; a map-side aggregate, no sort."""
    return _edge_activities(log, "first", by, case, order, activity)


def end_activities(
    log: DataFrame,
    by: Sequence[str] = ("archetype",),
    case: Sequence[str] = ("archetype", "case_id"),
    order: Sequence[str] = ("timestamp", "event_seq"),
    activity: str = "activity",
) -> DataFrame:
    """How many cases end with each activity."""
    return _edge_activities(log, "last", by, case, order, activity)
