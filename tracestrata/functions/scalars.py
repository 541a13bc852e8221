"""Scalar projections: hour stamps, ages, bins, labels."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracestrata.errors import ContractError
from tracestrata.functions import vocabulary as V

MICROS_PER_DAY = 86_400_000_000

# Shape of an hour stamp, unpadded hour, and the years accepted.
HOUR_STAMP = r"^(\d{4})-(\d{2})-(\d{2})-(\d|[1-9]\d)$"
HOUR_YEARS = (2000, 2100)

# An hour stamp in a landed file's path: the file's own name or its folder.
_HOUR_IN_PATH = r"(?:^|[/=])(\d{4}-\d{2}-\d{2}-\d{1,2})(?:\.json[^/]*|/[^/]+)$"


def payload_name(activity: Column) -> Column:
    """Short payload name of an event type; unknown types give null."""
    pairs = [F.lit(x) for pair in V.PAYLOAD_NAMES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), activity)


def parse_utc(text: str) -> datetime:
    """The instant of an ISO date or date-time; one without an offset is in UTC."""
    try:
        moment = datetime.fromisoformat(text)
    except ValueError as error:
        raise ContractError(f"not an ISO date: {text!r}") from error
    return moment.astimezone(timezone.utc) if moment.tzinfo else moment.replace(tzinfo=timezone.utc)


def utc_timestamp(moment: datetime) -> Column:
    """Literal instant that does not depend on the driver's time zone."""
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    delta = moment.astimezone(timezone.utc) - epoch
    micros = (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds
    return F.timestamp_micros(F.lit(micros))


def whole_days(start: Column, end: Column) -> Column:
    """Elapsed time in complete days, truncated toward zero (not calendar days)."""
    elapsed = F.unix_micros(end) - F.unix_micros(start)
    return ((elapsed - elapsed % MICROS_PER_DAY) / MICROS_PER_DAY).cast("long")


def hour_time(stamp: Column) -> Column:
    """Instant of a valid hour stamp, null for every other text.

    Valid means: `YYYY-MM-DD-H`, no leading zero in a two-digit hour, a real
    date, hour 0 to 23 and a year within `HOUR_YEARS`.
    """
    padded = F.regexp_replace(stamp, r"-(\d)$", "-0$1")
    moment = F.try_to_timestamp(padded, F.lit("yyyy-MM-dd-HH"))
    ok = stamp.rlike(HOUR_STAMP) & F.year(moment).between(*HOUR_YEARS)
    return F.when(ok, moment)


def hour_stamp(moment: Column) -> Column:
    """Hour stamp of an instant; the hour is not padded."""
    return F.concat(
        F.date_format(moment, "yyyy-MM-dd"), F.lit("-"), F.hour(moment).cast("string")
    )


def hour_of_path(path: Column) -> Column:
    return F.regexp_extract(path, _HOUR_IN_PATH, 1)


def day_columns(day: Column) -> dict[str, Column]:
    """Partition columns of the event dataset."""
    return {"anno": F.year(day), "mese": F.month(day), "giorno": F.dayofmonth(day)}


def category(value: Column, cuts: Sequence[Column], labels: Sequence[str]) -> Column:
    """Zero, then the first label whose cut is not exceeded, else the last label."""
    if len(labels) != len(cuts) + 1:
        raise ContractError("binning needs one label more than it has cuts")
    result = F.when(value == 0, "Zero")
    for cut, label in zip(cuts, labels):
        result = result.when(value <= cut, label)
    return result.otherwise(labels[-1])


def percentage(part: Column, total: Column) -> Column:
    return F.round(part * 100.0 / total, 2)


def case_key(actor: str = "actor_id", repo: str = "repo_id") -> Column:
    return F.concat(F.col(actor).cast("string"), F.lit("_"), F.col(repo).cast("string"))


def activity_label(activity: Column, count: Column) -> Column:
    return F.format_string("%s (%d)", activity, count)


def edge_label(source: Column, target: Column, seconds: Column) -> Column:
    """An unknown time, stored as -1 second, reads as negative zero hours."""
    text = F.when((seconds < 0) & (hours(seconds) == 0), "-0.0").otherwise(
        hours(seconds).cast("string")
    )
    return F.concat(source, F.lit("->"), target, F.lit(" ("), text, F.lit("h)"))


def hours(seconds: Column) -> Column:
    return F.round(seconds / 3600.0, 2)


def minutes(seconds: Column) -> Column:
    return seconds / 60.0


def visible(value: Column, floor: float = 1e-9) -> Column:
    """Null for values too small to show."""
    return F.when(value > floor, value)
