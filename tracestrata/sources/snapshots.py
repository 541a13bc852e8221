"""Which folders of a table are live: a list that is replaced as a whole.

Data folders are never changed once they are written. A snapshot is one small file
with a version and the folders that make up the table; it appears by a single
rename, so a reader sees the old list or the new one. Folders that no list names
(left by a crash, or replaced) are invisible, and readers that began with an older
list go on reading its folders until `vacuum` removes them.

One writer at a time is meant to change a table. Two that try at once are told
apart by the version: the second one finds its version taken and fails without
having changed anything.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracestrata.errors import ConcurrentWriteError
from tracestrata.sources import files

_SCHEMA = "version long, folders array<string>"


@dataclass(frozen=True)
class Snapshot:
    """A version of a table; folders are relative to its base."""

    version: int
    folders: tuple[str, ...]


def _home(base: str) -> str:
    return f"{base.rstrip('/')}_snapshots"


def _listed(spark: SparkSession, base: str):
    return spark.read.schema(_SCHEMA).option("recursiveFileLookup", True).json(_home(base))


def current(spark: SparkSession, base: str) -> Snapshot | None:
    """The newest snapshot; none if the table has never had one."""
    try:
        row = _listed(spark, base).orderBy(F.desc("version")).first()
    except AnalysisException:  # no such folder
        return None
    return None if row is None else Snapshot(row["version"], tuple(row["folders"]))


def commit(spark: SparkSession, base: str, seen: Snapshot | None, folders: Iterable[str]) -> Snapshot:
    """Make `folders` the table, provided that it is still as it was `seen`."""
    made = Snapshot((seen.version if seen else 0) + 1, tuple(sorted(folders)))
    row = spark.createDataFrame([(made.version, list(made.folders))], _SCHEMA)
    try:
        row.coalesce(1).write.mode("error").json(f"{_home(base)}/version={made.version}")
    except AnalysisException as error:
        raise ConcurrentWriteError(f"version {made.version} of {base} exists already") from error
    return made


def new_folder(kind: str) -> str:
    """The name of a data folder that nothing else has."""
    return f"{kind}={uuid.uuid4().hex}"


def paths(base: str, folders: Sequence[str]) -> list[str]:
    return [f"{base.rstrip('/')}/{folder}" for folder in folders]


def vacuum(spark: SparkSession, base: str, pattern: str, keep: int = 2) -> list[str]:
    """Remove data folders (those that match `pattern`) that the last `keep` snapshots do not name.

    To be run by the writer, when no reader holds an older list any more.
    Returns the folders removed.
    """
    rows = _listed(spark, base).orderBy(F.desc("version")).collect()
    live = {folder for row in rows[:keep] for folder in row["folders"]}
    there = files.matching(spark, base, pattern)
    gone = [folder for folder in there if folder not in live]
    files.remove(spark, paths(base, gone))
    files.remove(spark, [f"{_home(base)}/version={row['version']}" for row in rows[keep:]])
    return gone
