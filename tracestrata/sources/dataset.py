"""The day-partitioned event dataset."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracestrata import contracts as C
from tracestrata.errors import DataPreparationError, MissingDataError
from tracestrata.functions import scalars as S
from tracestrata.schemas import EVENT
from tracestrata.sources import files, snapshots

DAY = ("anno", "mese", "giorno")
HOUR = (*DAY, "hour")
# Where the data folders of a day lie below the dataset.
DAY_FOLDERS = "anno=*/mese=*/giorno=*/version=*"
_OLDER = "*.parquet"


def read_events(
    spark: SparkSession, base: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Events of the days from `start` to `end`, both inclusive.

    A dataset with snapshots is read through the newest one: only the live folders
    of the wanted days are named, and what is compacted or replaced meanwhile does
    not show. Any other dataset is read as it lies; the bound is a predicate on the
    partition columns, so other days are not listed as input and days without a
    folder are simply absent. Columns a dataset lacks are added as null; without an
    ``event_seq`` the position in the file orders events of equal time.
    """
    window = None
    if start is not None and end is not None:
        window = S.parse_utc(start).date(), S.parse_utc(end).date()
    seen = snapshots.current(spark, base)
    try:
        stored = spark.read.parquet(base) if seen is None else _live(spark, base, seen, window)
    except AnalysisException as error:
        raise MissingDataError(f"no event dataset at {base}") from error
    C.require_columns(stored, [*C.CORE_EVENTS, *DAY], base, DataPreparationError)
    if window is not None:
        stored = stored.where(F.make_date(*DAY).between(*(F.lit(day) for day in window)))
    return _conform(stored)


def live_rows(spark: SparkSession, base: str, seen: snapshots.Snapshot | None) -> DataFrame:
    """The stored rows of a dataset as they lie, through its snapshot if it has one."""
    return spark.read.parquet(base) if seen is None else _live(spark, base, seen, None)


def day_of_folder(folder: str) -> date:
    """The day of a data folder of the dataset."""
    parts = dict(part.split("=", 1) for part in folder.split("/") if "=" in part)
    return date(*(int(parts[name]) for name in DAY))


def _live(
    spark: SparkSession, base: str, seen: snapshots.Snapshot, window: tuple[date, date] | None
) -> DataFrame:
    chosen = [f for f in seen.folders if window is None or window[0] <= day_of_folder(f) <= window[1]]
    if not chosen:
        return spark.createDataFrame([], EVENT)
    # Days from before there were snapshots have no folder of their own.
    older = [f for f in chosen if f.endswith(_OLDER)]
    parts = [
        spark.read.option("basePath", base).parquet(*snapshots.paths(base, group))
        for group in ([f for f in chosen if f not in older], older) if group
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _conform(stored: DataFrame) -> DataFrame:
    present = set(stored.columns)

    def column(name, kind):
        if name in present:
            return F.col(name).cast(kind)
        if name == "event_seq":
            # The file comes first: row numbers alone repeat from file to file.
            file = F.pmod(F.xxhash64("_metadata.file_path"), F.lit(1 << 29))
            return F.shiftleft(file, 33).bitwiseOR(F.col("_metadata.row_index")).cast(kind)
        return F.lit(None).cast(kind)

    columns = [column(f.name, f.dataType).alias(f.name) for f in EVENT.fields]
    return stored.select(*columns).withColumn("case_id", F.col("repo_name"))


def overwrite_partitions(df: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    """Replace exactly the partitions that `df` has rows for."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*columns)
        .parquet(path)
    )


def replace_days(
    df: DataFrame, base: str, days: Sequence[date], seen: snapshots.Snapshot | None
) -> snapshots.Snapshot:
    """Make the rows of `df` the whole content of `days`; other days stay as they were `seen`.

    The new folders are written first and become visible by one snapshot, so a
    reader sees all of these days before or after the change, and a crash before
    the snapshot changes nothing.
    """
    spark = df.sparkSession
    version = snapshots.new_folder("version")
    name, value = version.split("=")
    (
        df.drop(name).withColumn(name, F.lit(value))
        .write.mode("append").option("compression", "zstd").partitionBy(*DAY, name).parquet(base)
    )
    made = [f"anno={d.year}/mese={d.month}/giorno={d.day}" for d in days]
    made = [f"{day}/{version}" for day in made]
    made = [folder for folder in made if files.exists(spark, f"{base}/{folder}")]
    replaced = set(days)
    kept = _known(spark, base) if seen is None else seen.folders
    kept = [folder for folder in kept if day_of_folder(folder) not in replaced]
    return snapshots.commit(spark, base, seen, [*kept, *made])


def _known(spark: SparkSession, base: str) -> list[str]:
    """The days of a dataset from before it had snapshots, as patterns of their files."""
    found = files.matching(spark, base, f"anno=*/mese=*/giorno=*/{_OLDER}", folders=False)
    return sorted({f"{file.rsplit('/', 1)[0]}/{_OLDER}" for file in found})


def vacuum(spark: SparkSession, base: str, keep: int = 2) -> list[str]:
    """Remove day folders that the last `keep` snapshots do not name."""
    return snapshots.vacuum(spark, base, DAY_FOLDERS, keep)


def drop_hours(spark: SparkSession, base: str, hours: list[tuple[int, int, int, str]]) -> None:
    """Remove hour partitions (anno, mese, giorno, hour) of the hourly dataset."""
    files.remove(
        spark,
        (f"{base}/anno={anno}/mese={mese}/giorno={giorno}/hour={hour}" for anno, mese, giorno, hour in hours),
    )


def size_mb(spark: SparkSession, path: str) -> DataFrame:
    """One row: total size of the files below `path` in MiB, 0.0 if there are none.

    Contents are not read.
    """
    if not files.exists(spark, path):
        return spark.range(1).select(F.lit(0.0).alias("size_mb"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    total = F.coalesce(F.sum("length"), F.lit(0)) / 1048576
    return found.agg(total.alias("size_mb"))
