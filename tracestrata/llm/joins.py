"""Joins and shuffles of tables whose size is counted first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from tracestrata import scratch_dir

# A table of at most this many rows, which together take at most this much, is broadcast.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def _width(kind: DataType, column: Column) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (StringType, BinaryType)):
        return 16 + F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(kind, ArrayType):
        inner = F.transform(column, lambda x: _width(kind.elementType, x).cast("long"))
        return 16 + F.coalesce(F.aggregate(inner, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    if isinstance(kind, StructType):
        return 8 + sum((_width(f.dataType, column[f.name]) for f in kind.fields), F.lit(0))
    return F.lit(8)


def sized(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """`table` marked for broadcast if its rows and their bytes are counted to be few; else as it is.

    Give it a stored table: it is read once to be counted.
    """
    width = sum((_width(f.dataType, F.col(f.name)) for f in table.schema.fields), F.lit(16))
    counted = table.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(width.cast("long")).alias("size")).first()
    return F.broadcast(table) if counted["n"] <= rows and (counted["size"] or 0) <= size else table


def stored(table: DataFrame) -> DataFrame:
    """`table` as a written table in the shared folder: like a checkpoint, but compressed, in columns."""
    where = scratch_dir(table.sparkSession, "table")
    table.write.option("compression", "zstd").parquet(where)
    return table.sparkSession.read.schema(table.schema).parquet(where)


# A counted table goes on in partitions of about so many narrow rows, in FEWEST of them at least.
TASK_ROWS = 50_000
FEWEST = 4


def tasks_for(rows: int) -> int:
    """How many partitions a table of so many narrow rows is worth."""
    return max(FEWEST, -(-rows // TASK_ROWS))


def compact(table: DataFrame) -> DataFrame:
    """A stored table in as many partitions as its count is worth, so that a small one
    does not make every later shuffle write a file for each of hundreds of empty parts.

    Partitions are put together where they lie; nothing is shuffled, and a large table
    stays as it is.
    """
    return table.coalesce(tasks_for(table.count()))
