"""Time coverage of a dataset, from its hour ledger.

Input rows are hours (or days); all windows here run over calendar days, whose
number does not depend on how many events a day holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracestrata.functions import scalars as S

HOURS_PER_DAY = 24


def hours_per_day(hours: DataFrame, hour: str = "hour") -> DataFrame:
    """(day, hours) for days with at least one processed hour.

    The day is the date part of the stamp, whatever its year.
    """
    day = F.try_to_date(F.substring(hour, 1, 10))
    return (
        hours.select(day.alias("day"), F.col(hour).alias("hour"))
        .where(F.col("day").isNotNull())
        .groupBy("day")
        .agg(F.count_distinct("hour").alias("hours"))
    )


def incomplete_days(days: DataFrame) -> DataFrame:
    return days.where(F.col("hours") < HOURS_PER_DAY)


def missing_days(days: DataFrame) -> DataFrame:
    """Calendar days between the first and the last day that have no data."""
    span = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where("lo is not null")
    calendar = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return calendar.join(days, "day", "left_anti")


def contiguous_periods(days: DataFrame) -> DataFrame:
    """(first_day, last_day, days) of every unbroken run of days."""
    position = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("day"))
    runs = days.select("day").distinct().withColumn("run", F.date_sub("day", position))
    return runs.groupBy("run").agg(
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count("*").alias("days"),
    ).drop("run")


def longest_periods(periods: DataFrame, n: int = 5) -> DataFrame:
    return periods.orderBy(F.desc("days"), "first_day").limit(n)


def recommended_window(periods: DataFrame) -> DataFrame:
    """Analysis bounds of the longest unbroken period, as ISO instants."""
    return longest_periods(periods, 1).select(
        F.date_format("first_day", "yyyy-MM-dd'T00:00:00Z'").alias("start_date"),
        F.date_format("last_day", "yyyy-MM-dd'T23:59:59Z'").alias("end_date"),
        "days",
    )


def coverage_summary(hours: DataFrame, hour: str = "hour") -> DataFrame:
    """First and last hour, hours found and possible, and their percentage.

    Invalid stamps do not count; without a valid one there is no row.
    """
    moment = S.hour_time(F.col(hour))
    found = hours.select(moment.alias("moment")).agg(
        F.min("moment").alias("lo"),
        F.max("moment").alias("hi"),
        F.count_distinct("moment").alias("found_hours"),
    )
    span = (F.unix_seconds("hi") - F.unix_seconds("lo")) / 3600 + 1
    return found.where("lo is not null").select(
        F.date_format("lo", "yyyy-MM-dd-HH").alias("min_hour"),
        F.date_format("hi", "yyyy-MM-dd-HH").alias("max_hour"),
        "found_hours",
        span.cast("long").alias("possible_hours"),
        (F.col("found_hours") / span * 100).alias("found_pct"),
    )


def day_span(days: DataFrame) -> DataFrame:
    """Headline of the coverage report: range, days found, missing, incomplete."""
    found = days.agg(
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count("*").alias("days_found"),
        F.count_if(F.col("hours") < HOURS_PER_DAY).alias("days_incomplete"),
    ).where("first_day is not null")
    total = F.date_diff("last_day", "first_day") + 1
    missing = F.col("total_days") - F.col("days_found")
    return found.withColumn("total_days", total.cast("long")).withColumns(
        {"days_missing": missing, "missing_pct": missing * 100.0 / F.col("total_days")}
    )
