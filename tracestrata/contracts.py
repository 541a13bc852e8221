"""Column contracts checked before a plan is built."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from tracestrata.errors import AnalyticsError, ContractError

# Columns that stored tables and callers must provide.
CORE_EVENTS = ("repo_id", "activity", "timestamp")
CREATION_EVENTS = ("repo_id", "timestamp")
METRIC_EVENTS = ("repo_id", "activity", "actor_login", "push_size", "actor_id")
LOOKUP = ("repo_id", "repo_creation_date")
STRATIFIED = ("repo_id", "strato_id", "age_in_days")
LOG_EVENTS = (
    "repo_id", "actor_id", "activity", "timestamp", "action", "pr_merged",
    "review_state", "create_ref_type", "delete_ref_type", "actor_login",
    "event_seq",
)


def require_columns(
    df: DataFrame,
    columns: Iterable[str],
    what: str,
    error: type[AnalyticsError] = ContractError,
) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise error(f"{what}: missing columns {missing}")
    return df
