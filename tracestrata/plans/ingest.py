"""Ingest of landed hours, consolidation of days, and the dataset report.

Data is written before the ledger, and an hour is always written as a whole
partition, so forcing, retrying or replaying an hour cannot duplicate it. With
every hour the ledger records the files it was read from, as they were listed
before they were read. An hour has news if a file is landed that is not among
them; no clock is asked, so a file that lands while its hour is read, or that is
copied with its old time, is found by the next run.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import timedelta

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracestrata.errors import ContractError
from tracestrata.functions import scalars as S
from tracestrata.functions import vocabulary as V
from tracestrata.operators import coverage
from tracestrata.schemas import DEFECT, FILE
from tracestrata.session import scratch_dir
from tracestrata.settings import Store
from tracestrata.sources import archive, dataset, files, ledger, snapshots

_OUTCOME = (
    "hour string, outcome string, total long, distilled long, bad long, malformed long, cause string"
)
_FILES = f"array<{FILE.simpleString()}>"
# What Spark says when a landed file cannot be read, as opposed to written rows.
_UNREADABLE = "FAILED_READ_FILE"


def hour_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Hours from `start` to `end`, both inclusive; the range spans an hour at least."""
    bounds = spark.range(1).select(
        S.hour_time(F.lit(start)).alias("lo"), S.hour_time(F.lit(end)).alias("hi")
    )
    row = bounds.first()
    if row["lo"] is None or row["hi"] is None:
        raise ContractError(f"invalid hour range {start} .. {end}")
    if row["hi"] < row["lo"] + timedelta(hours=1):
        raise ContractError("the hour range is shorter than one hour")
    steps = F.sequence("lo", "hi", F.expr("interval 1 hour"))
    return bounds.select(F.explode(steps).alias("moment")).select(
        S.hour_stamp(F.col("moment")).alias("hour")
    )


def hour_list(spark: SparkSession, hours: Iterable[str]) -> DataFrame:
    """The distinct valid stamps among `hours`, in order."""
    given = spark.createDataFrame([(h,) for h in hours], "hour string")
    return given.where(S.hour_time(F.col("hour")).isNotNull()).distinct().orderBy("hour")


def plan_hours(
    requested: DataFrame, state: DataFrame, landed: DataFrame, force: bool = False
) -> DataFrame:
    """(hour, outcome, cause, files): what to do with each requested hour.

    `state` has hour, status and the files of each settled hour (null: not known);
    `landed` has hour, path, length and, if contents are to be compared as well,
    checksum. The outcome is already known for hours to skip and for hours without a
    landed file; it is null for hours to read, with all their landed files. A settled
    hour is read again if one of those is not among the files it was read from. If
    some of the latter have gone, what they held would be lost, so that hour fails
    (unless forced) and stays as it is.
    """
    by_content = "checksum" in landed.columns
    names = ["path", "length", *(["checksum"] if by_content else [])]
    listed = landed.select("hour", F.struct("path", "length", *names[2:]).alias("file"))
    present = listed.groupBy("hour").agg(F.array_sort(F.collect_set("file")).alias("landed"))
    settled = state.select("hour", "status", "files")
    joined = requested.join(settled, "hour", "left").join(present, "hour", "left")

    def of(file):
        return F.struct(*(file[n].alias(n) for n in names))

    known = F.transform(F.col("files"), of)
    fresh = F.array_except("landed", known)
    # A file that was replaced under its name is not gone.
    gone = F.array_except(F.transform(F.col("files"), lambda f: f["path"]), F.transform(F.col("landed"), lambda f: f["path"]))
    news = F.coalesce(F.size(fresh) > 0, F.lit(False))
    told = joined.withColumns({"news": news, "gone": F.coalesce(gone, F.array().cast("array<string>"))})
    skip = F.lit(not force) & ~F.col("news")
    unsafe = F.lit(not force) & F.col("news") & (F.col("status") == V.PROCESSED) & (F.size("gone") > 0)
    outcome = (
        F.when(skip & (F.col("status") == V.PROCESSED), V.SKIPPED_PROCESSED)
        .when(skip & (F.col("status") == V.NOT_FOUND), V.SKIPPED_404)
        .when(F.col("landed").isNull(), V.FAILED_404)
        .when(unsafe, V.FAILED_OTHER)
    )
    cause = F.when(unsafe, F.concat(F.lit("files have gone: "), F.array_join("gone", ", ")))
    whole = F.transform(
        F.col("landed"),
        lambda f: F.struct(
            f["path"].alias("path"), f["length"].cast("long").alias("length"),
            (f["checksum"] if by_content else F.lit(None).cast("string")).alias("checksum"),
        ),
    )
    return told.select(
        "hour", outcome.alias("outcome"), F.when(outcome == V.FAILED_OTHER, cause).alias("cause"),
        whole.cast(_FILES).alias("files"),
    )


def write_hours(
    flagged: DataFrame, store: Store, manifest: DataFrame, record_empty: bool = True
) -> list:
    """Write the hours of a flagged batch, record them, and return their counts.

    `manifest` (hour, files) names the hours to record, unless told otherwise even if no
    line of theirs is well-formed, and what they are read from. The batch is parsed once, into a
    folder that all executors share.
    """
    spark = flagged.sparkSession
    parsed = scratch_dir(spark, "batch")
    flagged.write.option("compression", "zstd").parquet(parsed)
    batch = spark.read.schema(flagged.schema).parquet(parsed)
    counted = manifest.join(archive.hour_counts(batch.where("not malformed")), "hour", "left").join(
        batch.where("malformed").groupBy("hour").agg(
            F.count("*").alias("malformed"), F.collect_set("path").alias("odd")
        ),
        "hour", "left",
    )
    zero = F.lit(0).cast("long")
    counts = ("total", "distilled", "bad", "malformed")
    hours = counted.select("hour", "files", "odd", *(F.coalesce(c, zero).alias(c) for c in counts))
    listed = [row.asDict(recursive=True) for row in hours.orderBy("hour").collect()]
    if not record_empty:
        listed = [row for row in listed if row["total"]]
    dataset.overwrite_partitions(
        batch.where("valid").drop("valid", "malformed", "path"), store.hourly, dataset.HOUR
    )
    empty = [row["hour"] for row in listed if row["distilled"] == 0]
    dataset.drop_hours(spark, store.hourly, [(*_day_of(h), h) for h in empty])
    record_defects(spark, store, [path for row in listed for path in row["odd"] or []], [row["hour"] for row in listed])
    table = spark.createDataFrame(
        [(row["hour"], row["total"], row["distilled"], row["bad"], row["files"]) for row in listed],
        f"hour string, total long, distilled long, bad long, files {_FILES}",
    )
    ledger.append(ledger.record(table, V.PROCESSED), store)
    files.remove(spark, [parsed])
    return [(row["hour"], *(row[c] for c in counts)) for row in listed]


def record_defects(spark: SparkSession, store: Store, paths: Sequence[str], hours: Sequence[str]) -> None:
    """Replace what is known to be wrong with the files of `hours` by what is wrong with `paths` of them."""
    known = {folder.removeprefix("hour=") for folder in files.matching(spark, store.defects, "hour=*")}
    files.remove(spark, (f"{store.defects}/hour={hour}" for hour in known & set(hours)))
    if paths:
        found = archive.defects(spark, paths)
        (
            found.withColumn("stamp", F.col("hour")).repartition("hour").write.mode("append")
            .partitionBy("hour").parquet(store.defects)
        )


def read_defects(spark: SparkSession, store: Store) -> DataFrame:
    """What is wrong with landed files: hour, path, cause, line, offset."""
    if not files.matching(spark, store.defects, "hour=*"):
        return spark.createDataFrame([], DEFECT)
    return spark.read.parquet(store.defects).select(F.col("stamp").alias("hour"), *DEFECT.names[1:])


def _day_of(hour: str) -> tuple[int, int, int]:
    anno, mese, giorno, _ = (int(part) for part in hour.split("-"))
    return anno, mese, giorno


def ingest_files(
    spark: SparkSession, work: Sequence[tuple[str, list]], store: Store, record_empty: bool = True
) -> list:
    """Outcomes (hour, outcome, counts, cause) of reading hours from their files.

    If a file cannot be read, all files of the batch are looked through once, the hours
    of those that are broken are left out with the cause, and the rest is read again.
    Every other error, such as one while writing, is raised.
    """
    manifest = _with_checksums(spark, work)
    paths = [file["path"] for _, listed in work for file in listed]
    try:
        flagged = archive.flag_and_flatten(archive.scan_archive(spark, paths))
        rows = write_hours(flagged, store, manifest, record_empty)
        return [(hour, V.SUCCESS, *counts, None) for hour, *counts in rows]
    except (Py4JJavaError, PySparkException) as error:
        if _UNREADABLE not in str(error):
            raise
        broken = {
            row["path"]: f"{row['cause']} after {row['offset']} bytes: {row['path']}"
            for row in archive.broken_files(spark, paths).collect()
        }
        if not broken:
            raise
    failed = {
        hour: "; ".join(broken[f["path"]] for f in listed if f["path"] in broken) for hour, listed in work
    }
    failed = {hour: cause for hour, cause in failed.items() if cause}
    record_defects(spark, store, sorted(broken), sorted(failed))
    rest = [(hour, listed) for hour, listed in work if hour not in failed]
    done = ingest_files(spark, rest, store, record_empty) if rest else []
    return done + [(hour, V.FAILED_OTHER, 0, 0, 0, 0, cause) for hour, cause in sorted(failed.items())]


def _with_checksums(spark: SparkSession, work: Sequence[tuple[str, list]]) -> DataFrame:
    """(hour, files), each file with the checksum it has before it is read."""
    listed = [(hour, f["path"], f["length"]) for hour, found in work for f in found]
    table = spark.createDataFrame(listed, "hour string, path string, length long")
    found = table.join(archive.checksums(spark, [path for _, path, _ in listed]), "path", "left")
    entry = F.array_sort(F.collect_list(F.struct("path", "length", "checksum")))
    rows = [(r["hour"], [f.asDict() for f in r["files"]]) for r in found.groupBy("hour").agg(entry.alias("files")).collect()]
    return spark.createDataFrame(rows, f"hour string, files {_FILES}")


def ingest_hours(
    spark: SparkSession,
    landing: str,
    store: Store,
    requested: DataFrame,
    force: bool = False,
    batch_hours: int = 720,
    compare_contents: bool = False,
) -> DataFrame:
    """Ingest the requested hours; returns (hour, outcome, total, distilled, bad, malformed, cause).

    The driver handles hour stamps and file names only. Hours that fail for
    another reason than a missing file are not recorded and so are retried by
    the next run. Files are told apart by path and length; `compare_contents` reads
    the landed files of settled hours as well, and notices one that was replaced by
    another of the same length.
    """
    landed = archive.list_hours(spark, landing)
    if compare_contents:
        asked = landed.join(requested, "hour", "left_semi")
        paths = [row["path"] for row in asked.select("path").collect()]
        if paths:
            landed = asked.join(archive.checksums(spark, paths), "path")
    planned = plan_hours(requested, ledger.read_manifest(spark, store), landed, force).collect()
    results = [(p["hour"], p["outcome"], 0, 0, 0, 0, p["cause"]) for p in planned if p["outcome"]]
    absent = [p["hour"] for p in planned if p["outcome"] == V.FAILED_404]
    if absent:
        rows = [(h, 0, 0, 0, []) for h in absent]
        table = spark.createDataFrame(
            rows, f"hour string, total long, distilled long, bad long, files {_FILES}"
        )
        ledger.append(ledger.record(table, V.NOT_FOUND), store)
    work = sorted(
        ((p["hour"], p["files"]) for p in planned if not p["outcome"]),
        key=lambda w: (_day_of(w[0]), int(w[0].rsplit("-", 1)[1])),
    )
    for first in range(0, len(work), batch_hours):
        results += ingest_files(spark, work[first : first + batch_hours], store)
    return spark.createDataFrame(results, _OUTCOME).orderBy("hour")


def consolidate_days(spark: SparkSession, store: Store) -> list[str]:
    """Move the hourly partitions of complete days into the day dataset.

    A day that was consolidated before keeps its other hours when a late hour
    arrives. Spark's rebalancing sizes the files, splitting a day that holds
    most of the rows. Readers of the dataset see all these days before or after.
    Returns the consolidated days.
    """
    if not files.exists(spark, store.hourly):
        return []
    staged = spark.read.parquet(store.hourly)
    staged = staged.withColumn("hour", F.col("hour").cast("string"))
    waiting = staged.select(*dataset.HOUR).distinct()
    ready = (
        waiting.withColumn("day", F.make_date(*dataset.DAY))
        .join(ledger.complete_days(ledger.read(spark, store)), "day", "left_semi")
        .select("day", *dataset.HOUR)
        .collect()
    )
    if not ready:
        return []
    days = sorted({row["day"] for row in ready})
    merged = staged.where(F.make_date(*dataset.DAY).isin(days))
    seen = snapshots.current(spark, store.events)
    if seen is not None or files.exists(spark, store.events):
        hours = spark.createDataFrame([(row["hour"],) for row in ready], "hour string")
        kept = (
            dataset.read_events(spark, store.events)
            .where(F.make_date(*dataset.DAY).isin(days))
            .join(F.broadcast(hours), "hour", "left_anti")
        )
        merged = merged.unionByName(kept.select(*merged.columns))
    dataset.replace_days(merged.hint("rebalance", *dataset.DAY), store.events, days, seen)
    dataset.drop_hours(
        spark,
        store.hourly,
        [(row["anno"], row["mese"], row["giorno"], row["hour"]) for row in ready],
    )
    return [day.isoformat() for day in days]


def compact_days(spark: SparkSession, store: Store, start: str, end: str) -> list[str]:
    """Rewrite the days from `start` to `end` with files of a good size, while readers go on.

    Rows stay as they are; ordered by repository and time, so that a scan for a few
    repositories skips most row groups. Returns the days that were rewritten.
    """
    seen = snapshots.current(spark, store.events)
    if seen is None:
        return []
    first, last = S.parse_utc(start).date(), S.parse_utc(end).date()
    days = sorted({d for d in map(dataset.day_of_folder, seen.folders) if first <= d <= last})
    if days:
        rows = dataset.read_events(spark, store.events, start, end).drop("case_id")
        packed = rows.hint("rebalance", *dataset.DAY).sortWithinPartitions(*dataset.DAY, "repo_id", "timestamp")
        dataset.replace_days(packed, store.events, days, seen)
    return [day.isoformat() for day in days]


def ingest_range(
    spark: SparkSession, landing: str, store: Store, start: str, end: str, force: bool = False
) -> DataFrame:
    """Ingest a range of hours and consolidate the days it completes."""
    outcome = ingest_hours(spark, landing, store, hour_range(spark, start, end), force)
    consolidate_days(spark, store)
    return outcome


def range_totals(spark: SparkSession, store: Store, start: str, end: str) -> DataFrame:
    """One row: events parsed, distilled and bad in the processed hours from `start` to `end`."""
    return ledger.totals(ledger.read(spark, store), start, end)


def dataset_info(spark: SparkSession, store: Store) -> DataFrame:
    """One row: path, size, and coverage (null while no hour is processed)."""
    done = ledger.read(spark, store).where(F.col("status") == V.PROCESSED)
    size = dataset.size_mb(spark, store.root).withColumn("path", F.lit(store.root))
    summary = coverage.coverage_summary(done).withColumn("path", F.lit(store.root))
    return size.join(summary, "path", "left")
