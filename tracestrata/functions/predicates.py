"""Boolean column expressions over canonical events.

They follow three-valued logic: a null predicate drops the row in ``where`` and
takes the ``otherwise`` branch in ``when``.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracestrata.functions import vocabulary as V

Rules = Mapping[str, tuple[str, list[str]] | None]


def matches(rules: Rules, activity: str = "activity") -> Column:
    """True for events of a listed type whose qualifier has an accepted value."""

    def one(name: str, qualifier: tuple[str, list[str]] | None) -> Column:
        is_type = F.col(activity) == name
        if qualifier is None:
            return is_type
        column, accepted = qualifier
        return is_type & F.col(column).isin(accepted)

    return reduce(or_, (one(name, qualifier) for name, qualifier in rules.items()))


def is_repo_creation() -> Column:
    return matches(V.CREATION)


def is_popularity() -> Column:
    return matches(V.POPULARITY)


def is_engagement() -> Column:
    return matches(V.ENGAGEMENT)


def is_collaboration() -> Column:
    return matches(V.COLLABORATION)


def is_core_workflow() -> Column:
    return matches(V.CORE_WORKFLOW)


def is_bot(login: str = "actor_login") -> Column:
    """An unknown login counts as human."""
    return F.coalesce(F.col(login).endswith(V.BOT_SUFFIX), F.lit(False))


def is_human(login: str = "actor_login") -> Column:
    return ~is_bot(login)


def _suffix(column: str, present: Collection[str]) -> Column:
    """The naming suffix, or its stand-in when the input lacks the column."""
    if column in present:
        return F.col(column)
    return F.col("action") if column == "review_state" else F.lit("ref")


def step_name(columns: Collection[str], activity: str = "activity") -> Column:
    """Event type refined by what happened; null when its suffix is null.

    `columns` are those the input has. Without a review state the action names
    the review, without a ref type the suffix is the constant ``ref``, and
    without a merge flag closed pull requests stay ``closed``.
    """
    kind = F.col(activity)
    outcome = F
    if "pr_merged" in columns:
        closed = (kind == "PullRequestEvent") & (F.col("action") == "closed")
        outcome = F.when(closed & F.col("pr_merged"), "PullRequestEvent_merged").when(
            closed & ~F.col("pr_merged"), "PullRequestEvent_rejected"
        )
    for column, names in _suffixed_by().items():
        name = F.concat(kind, F.lit("_"), _suffix(column, columns))
        outcome = outcome.when(kind.isin(names), name)
    return outcome.otherwise(kind)


def has_step_name(columns: Collection[str], activity: str = "activity") -> Column:
    """Whether `step_name` is non-null, without building the name."""
    kind = F.col(activity)
    named = kind.isNotNull()
    for column, names in _suffixed_by().items():
        named = named & (~kind.isin(names) | _suffix(column, columns).isNotNull())
    return named


def _suffixed_by() -> dict[str, list[str]]:
    groups: dict[str, list[str]] = {}
    for name, column in V.STEP_SUFFIX.items():
        groups.setdefault(column, []).append(name)
    return groups


def has_required_fields() -> Column:
    """A raw event is usable when these are present; null parents count as empty."""
    required = ("repo.name", "type", "created_at", "actor.id")
    return reduce(lambda a, b: a & b, (F.col(name).isNotNull() for name in required))


def archetypes_of() -> Column:
    """Array of every archetype whose category table the row satisfies."""

    def satisfied(table: Mapping[str, list[str]]) -> Column:
        tests = (F.col(f"{d}_norm_cat").isin(accepted) for d, accepted in table.items())
        return reduce(lambda a, b: a & b, tests)

    names = [F.when(satisfied(table), name) for name, table in V.ARCHETYPES.items()]
    return F.array_compact(F.array(*names))
