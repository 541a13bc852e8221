"""Incremental ingest of newly landed hours with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracestrata.plans.ingest import ingest_files
from tracestrata.settings import Store
from tracestrata.sources import archive, ledger


def stream_ingest(
    spark: SparkSession,
    landing: str,
    store: Store,
    checkpoint: str,
    files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Process every file that landed since the last run, then stop.

    The stream carries names and lengths of files, not their content. An hour with news
    is read again from the new files and those that the ledger says it was read from,
    and overwritten as a whole; the landing folder is not listed again. So files of an
    hour may arrive in any order and in any batches, and replaying a batch after a
    failure changes nothing. An hour with a broken file is left as it is, with the
    cause among the store's defects, and does not stop the stream; `ingest_hours` takes
    it up when the file has been replaced. Files without a line record nothing.
    """

    def commit(batch: DataFrame, _: int) -> None:
        news = batch.select("hour", "path", "length").distinct().collect()
        if not news:
            return
        session = batch.sparkSession
        found: dict[str, dict[str, dict]] = {}
        hours = sorted({row["hour"] for row in news})
        known = ledger.read_manifest(session, store).where(F.col("hour").isin(hours))
        for row in known.select("hour", "files").collect():
            found[row["hour"]] = {f["path"]: f.asDict() for f in row["files"] or []}
        for row in news:
            file = {"path": row["path"], "length": row["length"]}
            found.setdefault(row["hour"], {})[row["path"]] = file
        work = [(hour, [found[hour][path] for path in sorted(found[hour])]) for hour in hours]
        ingest_files(session, work, store, record_empty=False)

    return (
        archive.stream_hours(spark, landing, files_per_trigger)
        .writeStream.foreachBatch(commit)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
