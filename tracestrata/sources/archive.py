"""Hourly archive files (gzip, one JSON object per line) and their distillation."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracestrata.functions import predicates as P
from tracestrata.functions import scalars as S
from tracestrata.schemas import CORRUPT, DEFECT, EVENT, RAW_ARCHIVE

# Tasks carry the functions they run, so executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SEQ_BITS = 33
# A file's bytes go to the careful reader in pieces of this size, so a batch of them is bounded.
_PIECE = 8 << 10
_LINES_BYTES = 4 << 20


def list_hours(spark: SparkSession, landing: str) -> DataFrame:
    """(hour, path, length) of every landed file with a valid hour stamp.

    Only file metadata is read.
    """
    return _stamped(
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(landing)
    )


def stream_hours(
    spark: SparkSession, landing: str, files_per_trigger: int | None = None
) -> DataFrame:
    """`list_hours` as a stream of newly landed files; their content is not read."""
    reader = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", True)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _stamped(reader.load(landing))


_FILE = "path string, modificationTime timestamp, length long, content binary"


def _stamped(files: DataFrame) -> DataFrame:
    found = files.select(S.hour_of_path(F.col("path")).alias("hour"), "path", "length")
    return found.where(S.hour_time(F.col("hour")).isNotNull())


def checksums(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, checksum) of files: SHA-256 of their bytes as they lie."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select("path", F.sha2("content", 256).alias("checksum"))


def scan_archive(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Raw events with the hour, day and path of their file; `_corrupt` holds a malformed line.

    A gzip file is read by one task, and all that follows is map-only. Rows of files
    without a valid stamp are left out.
    """
    paths = paths if isinstance(paths, str) else list(paths)
    raw = (
        spark.read.schema(RAW_ARCHIVE)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("recursiveFileLookup", True)
        .json(paths)
    )
    placed = raw.withColumn("path", F.col("_metadata.file_path"))
    return placed.join(F.broadcast(file_hours(spark, paths)), "path")


def file_hours(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, hour, anno, mese, giorno) of the files with a valid stamp.

    A stamp is parsed once for each file, since doing so for every event costs several
    times as much as parsing the event. Contents are not read; the path is written as
    that of a scanned row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    named = files.select(F.col("_metadata.file_path").alias("path"))
    # An aggregate: Spark would carry a filter on the path itself over to the scanned rows.
    stamped = named.groupBy("path").agg(F.max(S.hour_of_path(F.col("path"))).alias("hour"))
    moment = S.hour_time(F.col("hour"))
    return stamped.where(moment.isNotNull()).withColumns(S.day_columns(moment))


def flag_and_flatten(raw: DataFrame) -> DataFrame:
    """Canonical columns of every raw event, and what it is.

    ``malformed``: the line is no JSON object; such lines count neither as parsed
    nor as bad. ``valid``: the event has the required fields. The archive's own event
    id orders events within equal times; events without one keep their order within
    their file, and the files an order of their own.
    """
    kind = F.col("type")
    payload = F.col("payload")
    file = F.pmod(F.xxhash64("path"), F.lit(1 << (63 - _SEQ_BITS - 1)))
    row = F.monotonically_increasing_id().bitwiseAND((1 << _SEQ_BITS) - 1)
    position = F.shiftleft(file, _SEQ_BITS).bitwiseOR(row)

    def only(event: str, value):
        return F.when(kind == event, value)

    values = {
        "repo_id": F.col("repo.id").try_cast("long"),
        "repo_name": F.col("repo.name"),
        "actor_id": F.col("actor.id").try_cast("long"),
        "actor_login": F.col("actor.login"),
        "activity": kind,
        "payload_type": S.payload_name(kind),
        "timestamp": F.try_to_timestamp("created_at"),
        "action": payload["action"],
        "push_size": only("PushEvent", payload["size"].try_cast("double")),
        "create_ref_type": only("CreateEvent", payload["ref_type"]),
        "delete_ref_type": only("DeleteEvent", payload["ref_type"]),
        "review_state": payload["review"]["state"],
        "pr_merged": payload["pull_request"]["merged"].try_cast("boolean"),
        "event_seq": F.coalesce(F.col("id").try_cast("long"), position),
        **{name: F.col(name) for name in ("hour", "anno", "mese", "giorno")},
    }
    columns = [values[f.name].cast(f.dataType).alias(f.name) for f in EVENT.fields]
    malformed = F.col(CORRUPT).isNotNull()
    return raw.select(
        *columns, "path", malformed.alias("malformed"), (P.has_required_fields() & ~malformed).alias("valid")
    )


def distill(raw: DataFrame) -> DataFrame:
    """Canonical events of the usable raw events."""
    return flag_and_flatten(raw).where("valid").drop("valid", "malformed", "path")


def hour_counts(flagged: DataFrame) -> DataFrame:
    """Parsed, distilled and bad events per archive hour."""
    return flagged.groupBy("hour").agg(
        F.count("*").alias("total"),
        F.count_if("valid").alias("distilled"),
        F.count_if(~F.col("valid")).alias("bad"),
    )


# --- reading with care -------------------------------------------------------


class Unpacker:
    """Bytes of a file, piece by piece: what could be unpacked, and why no more.

    Files that do not begin like gzip are taken as they are.
    """

    def __init__(self):
        self.inner = None
        self.plain: bool | None = None
        self.head = b""
        self.size = 0
        self.cause: str | None = None

    def take(self, piece: bytes) -> bytes:
        if self.cause:
            return b""
        if self.plain is None:
            self.head += piece
            if len(self.head) < 2:
                return b""
            self.plain = self.head[:2] != b"\x1f\x8b"
            piece = self.head
        out = piece if self.plain else self._inflate(piece)
        self.size += len(out)
        return out

    def _inflate(self, piece: bytes) -> bytes:
        out = []
        while piece:
            if self.inner is None:
                self.inner = zlib.decompressobj(31)
            try:
                out.append(self.inner.decompress(piece))
            except zlib.error as error:
                self.cause = f"broken gzip: {error}"
                break
            piece = b""
            if self.inner.eof:  # another member may follow
                piece, self.inner = self.inner.unused_data.lstrip(b"\0"), None
        return b"".join(out)

    def end(self) -> bytes:
        """Whatever is left; sets the cause if the file is cut."""
        if self.plain is None:
            self.size = len(self.head)
            return self.head
        if not self.plain and self.inner is not None and not self.cause:
            self.cause = "truncated gzip"
        return b""


_LINE = pa.schema(
    [("path", pa.string()), ("line", pa.int64()), ("offset", pa.int64()), ("value", pa.string()), ("cause", pa.string())]
)


def _unpack(whole: bool):
    """Lines of files (unless only the `whole` file is asked for), and a last row for each file."""

    def task(batches):
        rows: list[tuple] = []
        held = 0
        path, unpacker, rest, line, offset = None, None, b"", 0, 0

        def lines(data: bytes, last: bool):
            nonlocal rest, line, offset, held
            if whole:
                return
            parts = (rest + data).split(b"\n")
            rest = b"" if last else parts.pop()
            for part in parts:
                if part.strip():
                    rows.append((path, line, offset, part.decode("utf-8", "replace"), None))
                    held += len(part)
                line, offset = line + 1, offset + len(part) + 1

        def finish():
            lines(unpacker.end(), True)
            rows.append((path, None, unpacker.size, None, unpacker.cause))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LINE)], schema=_LINE)

        for pieces in batches:
            for name, piece in zip(pieces.column("path").to_pylist(), pieces.column("piece")):
                if name != path:
                    if unpacker is not None:
                        finish()
                    path, unpacker, rest, line, offset = name, Unpacker(), b"", 0, 0
                lines(unpacker.take(piece.as_py() or b""), False)
                if held > _LINES_BYTES:
                    yield batch()
                    rows, held = [], 0
        if unpacker is not None:
            finish()
        if rows:
            yield batch()

    return task


def _pieces(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    files = spark.read.format("binaryFile").load(list(paths))
    last = F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / _PIECE).cast("int")
    steps = F.sequence(F.lit(0), last)
    cut = F.transform(steps, lambda k: F.substring(F.col("content"), k * _PIECE + 1, F.lit(_PIECE)))
    return files.select("path", F.explode(cut).alias("piece"))


def broken_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, cause, offset) of the files that cannot be unpacked to their end."""
    found = _pieces(spark, paths).mapInArrow(
        _unpack(True), "path string, line long, offset long, value string, cause string"
    )
    return found.where(F.col("cause").isNotNull()).select("path", "cause", "offset")


def defects(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """What is wrong with files: malformed lines with their places, and where a file breaks off.

    The line that a broken file ends in counts as malformed only if it is one.
    """
    found = _pieces(spark, paths).mapInArrow(
        _unpack(False), "path string, line long, offset long, value string, cause string"
    )
    parsed = F.from_json("value", RAW_ARCHIVE, {"columnNameOfCorruptRecord": CORRUPT})
    judged = found.select("*", parsed[CORRUPT].isNotNull().alias("malformed"))
    cause = F.coalesce("cause", F.when(F.col("malformed"), "malformed line"))
    hour = S.hour_of_path(F.col("path"))
    told = judged.select(hour.alias("hour"), "path", cause.alias("cause"), "line", "offset")
    return told.where(F.col("cause").isNotNull()).select(*DEFECT.names)
