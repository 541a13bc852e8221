"""The hour ledger: one current state per archive hour, and the files it came from.

Records are only ever added; the latest record of an hour is its state, so an
hour is processed or not found but never both, and a crash between writing data
and recording it merely repeats the hour. Each batch of records is a folder of
its own that a snapshot names, and the snapshot's version orders the records. When
there are many folders they are rewritten as one, in place: readers see the table
before or after that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracestrata.functions import scalars as S
from tracestrata.functions import vocabulary as V
from tracestrata.schemas import LEDGER, LEDGER_DOCUMENT, LEDGER_STORED
from tracestrata.settings import Store
from tracestrata.sources import files, snapshots

# Folders of records at which the ledger is rewritten as one.
COMPACT_AT = 64


def read_records(spark: SparkSession, store: Store) -> DataFrame:
    seen = snapshots.current(spark, store.ledger)
    reader = spark.read.schema(LEDGER_STORED)
    if seen is not None:
        return reader.parquet(*snapshots.paths(store.ledger, seen.folders)) if seen.folders else _nothing(spark)
    # A ledger of plain files, from before there were snapshots.
    return reader.parquet(store.ledger) if files.exists(spark, store.ledger) else _nothing(spark)


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER_STORED)


def current(records: DataFrame) -> DataFrame:
    """Latest record of each hour; of records of one instant, a processed one with the most rows."""
    fields = [name for name in records.columns if name != "hour"]
    newest = [F.coalesce("version", F.lit(0))] if "version" in records.columns else []
    rank = F.struct(*newest, "updated_at", F.col("status") == V.PROCESSED, "total", "distilled", "bad")
    latest = F.max_by(F.struct(*fields), rank).alias("latest")
    return records.groupBy("hour").agg(latest).select("hour", "latest.*")


def read(spark: SparkSession, store: Store) -> DataFrame:
    """The state of every hour (the ledger's seven columns)."""
    return read_manifest(spark, store).select(*LEDGER.names)


def read_manifest(spark: SparkSession, store: Store) -> DataFrame:
    """The state of every hour with the files it was read from (null: not known)."""
    return current(read_records(spark, store)).drop("version")


def record(hours: DataFrame, status: str) -> DataFrame:
    """Ledger rows for (hour, total, distilled, bad) and, if there, files."""
    known = F.col("files") if "files" in hours.columns else F.lit(None)
    return hours.select(
        "hour",
        F.to_date(S.hour_time(F.col("hour"))).alias("day"),
        F.lit(status).alias("status"),
        "total",
        "distilled",
        "bad",
        F.current_timestamp().alias("updated_at"),
        known.cast(LEDGER_STORED["files"].dataType).alias("files"),
    )


def append(records: DataFrame, store: Store) -> None:
    """Add records, and rewrite the ledger if it has become many small folders."""
    spark = records.sparkSession
    seen = snapshots.current(spark, store.ledger)
    kept = list(seen.folders) if seen else []
    if seen is None and files.exists(spark, store.ledger):
        kept.append(_write(read_records(spark, store), store, 0))
    version = seen.version + 1 if seen else 1
    made = snapshots.commit(spark, store.ledger, seen, [*kept, _write(records, store, version)])
    if len(made.folders) >= COMPACT_AT:
        compact(spark, store)


def _write(records: DataFrame, store: Store, version: int) -> str:
    folder = snapshots.new_folder("batch")
    stored = records if "version" in records.columns else records.withColumn("version", F.lit(version).cast("long"))
    stored.select(*LEDGER_STORED.names).coalesce(1).write.parquet(*snapshots.paths(store.ledger, [folder]))
    return folder


def compact(spark: SparkSession, store: Store, target: Store | None = None) -> None:
    """One record per hour: in place, while readers go on, or into another store."""
    if target is not None:
        state = read_manifest(spark, store)
        return append(state, target)
    seen = snapshots.current(spark, store.ledger)
    if seen is not None and seen.folders:
        state = current(spark.read.schema(LEDGER_STORED).parquet(*snapshots.paths(store.ledger, seen.folders)))
        snapshots.commit(spark, store.ledger, seen, [_write(state, store, seen.version)])


def vacuum(spark: SparkSession, store: Store, keep: int = 2) -> list[str]:
    """Remove folders that the last `keep` snapshots do not name."""
    return snapshots.vacuum(spark, store.ledger, "batch=*", keep)


def read_documents(spark: SparkSession, base: str) -> DataFrame:
    """Ledger rows from the nested `index.json` documents of a day-folder layout.

    Unreadable documents count as empty.
    """
    documents = (
        spark.read.schema(LEDGER_DOCUMENT)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "index.json")
        .json(base)
    )
    done = documents.select(F.explode("hours_processed").alias("hour", "counts")).select(
        "hour", F.lit(V.PROCESSED).alias("status"), "counts.total", "counts.distilled", "counts.bad"
    )
    zero = F.lit(0).cast("long")
    absent = documents.select(F.explode("hours_not_found").alias("hour")).select(
        "hour",
        F.lit(V.NOT_FOUND).alias("status"),
        zero.alias("total"),
        zero.alias("distilled"),
        zero.alias("bad"),
    )
    day = F.to_date(S.hour_time(F.col("hour")))
    return done.unionByName(absent).withColumn("day", day)


def as_documents(ledger: DataFrame) -> DataFrame:
    """The nested form, one row per day: hours processed and hours not found."""
    done = F.col("status") == V.PROCESSED
    entry = F.struct("hour", F.struct("total", "distilled", "bad"))
    return ledger.groupBy("day").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(done, entry)))).alias(
            "hours_processed"
        ),
        F.array_sort(F.collect_list(F.when(~done, F.col("hour")))).alias("hours_not_found"),
    )


def merge_counts(counts: DataFrame, more: DataFrame, key: str = "key") -> DataFrame:
    """Add two tables of counters key by key."""
    return counts.unionByName(more).groupBy(key).agg(F.sum("n").alias("n"))


def totals(ledger: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Parsed, distilled and bad events over the processed hours, or those from `start` to `end`."""
    hours = ledger.where(F.col("status") == V.PROCESSED)
    if start is not None and end is not None:
        bounds = [S.hour_time(F.lit(stamp)) for stamp in (start, end)]
        hours = hours.where(S.hour_time(F.col("hour")).between(*bounds))
    return hours.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "distilled", "bad"))
    )


def complete_days(ledger: DataFrame) -> DataFrame:
    """Days whose 24 hours are all settled, at least one of them with data."""
    done = F.count_if(F.col("status") == V.PROCESSED)
    return (
        ledger.groupBy("day")
        .agg(F.count("*").alias("settled"), done.alias("processed"))
        .where("settled = 24 and processed > 0")
        .select("day")
    )
