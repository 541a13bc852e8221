"""Coverage report of a dataset, from its ledger and from what its store holds.

Nothing here reads an event. The ledger tells which hours were processed and how
many events each gave; the store's own folders and the footers of its Parquet files
tell how many rows lie there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracestrata.errors import MissingDataError
from tracestrata.functions import vocabulary as W
from tracestrata.operators import coverage as V
from tracestrata.settings import Store
from tracestrata.sources import dataset, files, ledger, snapshots, tables


@dataclass(frozen=True)
class CoverageReport:
    span: DataFrame
    incomplete: DataFrame
    missing: DataFrame
    periods: DataFrame
    recommended: DataFrame


def coverage_report(hours: DataFrame, hour: str = "hour", top: int = 5) -> CoverageReport:
    """All tables of the report; `hours` has one row per processed hour."""
    days = V.hours_per_day(hours, hour)
    if days.isEmpty():
        raise MissingDataError("the ledger lists no processed hour")
    periods = V.contiguous_periods(days)
    return CoverageReport(
        span=V.day_span(days),
        incomplete=V.incomplete_days(days).orderBy("day"),
        missing=V.missing_days(days).orderBy("day"),
        periods=V.longest_periods(periods, top),
        recommended=V.recommended_window(periods),
    )


def stored_rows(spark: SparkSession, store: Store) -> DataFrame:
    """(day, rows, consolidated) of the store's folders, counted from Parquet footers.

    No column is read; a day may be there twice, consolidated and with late hours.
    """
    seen = snapshots.current(spark, store.events)
    parts = [
        (True, dataset.live_rows(spark, store.events, seen) if seen is not None or files.exists(spark, store.events) else None),
        (False, spark.read.parquet(store.hourly) if files.matching(spark, store.hourly, "anno=*/mese=*/giorno=*/hour=*") else None),
    ]
    found = spark.createDataFrame([], "day date, rows long, consolidated boolean")
    for consolidated, stored in parts:
        if stored is not None:
            counted = stored.groupBy(*dataset.DAY).agg(F.count("*").alias("rows"))
            found = found.unionByName(
                counted.select(F.make_date(*dataset.DAY).alias("day"), "rows", F.lit(consolidated).alias("consolidated"))
            )
    return found


def validate_store(spark: SparkSession, store: Store) -> DataFrame:
    """One row per day: what the ledger says, what is stored, and whether they agree.

    (day, processed, not_found, ledger_rows, consolidated_rows, waiting_rows, complete, matches).
    Days that only the ledger or only the store knows have zeros on the other side.
    """
    done = F.col("status") == W.PROCESSED
    said = ledger.read(spark, store).groupBy("day").agg(
        F.count_if(done).alias("processed"),
        F.count_if(~done).alias("not_found"),
        F.sum(F.when(done, F.col("distilled")).otherwise(0)).alias("ledger_rows"),
    )

    def rows(wanted: bool):
        return F.sum(F.when(F.col("consolidated") == wanted, F.col("rows")).otherwise(0))

    there = stored_rows(spark, store).groupBy("day").agg(
        rows(True).alias("consolidated_rows"), rows(False).alias("waiting_rows")
    )
    counts = ("processed", "not_found", "ledger_rows", "consolidated_rows", "waiting_rows")
    both = said.join(there, "day", "full").select(
        "day", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts)
    )
    return both.withColumns(
        {
            "complete": F.col("processed") + F.col("not_found") == V.HOURS_PER_DAY,
            "matches": F.col("ledger_rows") == F.col("consolidated_rows") + F.col("waiting_rows"),
        }
    )


def run_validation(spark: SparkSession, store: Store, output: str, top: int = 5) -> DataFrame:
    """Write the tables of the report, and the store against its ledger; returns the latter.

    The hours come from the ledger. A store that has none is an error.
    """
    done = ledger.read(spark, store).where(F.col("status") == W.PROCESSED)
    report = coverage_report(done, top=top)
    for name in ("span", "incomplete", "missing", "periods", "recommended"):
        tables.write_report(getattr(report, name), f"{output}/coverage_{name}.csv")
    days = validate_store(spark, store)
    tables.write_report(days, f"{output}/store_days.csv", ["day"])
    return days


def run_document_validation(spark: SparkSession, base: str, output: str, top: int = 5) -> DataFrame:
    """The report of a dataset whose ledger is one `index.json` document a day; returns the span."""
    done = ledger.read_documents(spark, base).where(F.col("status") == W.PROCESSED)
    report = coverage_report(done, top=top)
    for name in ("span", "incomplete", "missing", "periods", "recommended"):
        tables.write_report(getattr(report, name), f"{output}/coverage_{name}.csv")
    return report.span
