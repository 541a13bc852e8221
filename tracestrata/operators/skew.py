"""Finding keys that hold too many rows for one task, and joining around them.

Which keys are found only decides how work is split, never what the result is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracestrata.settings import HOT_KEY_ROWS

# A narrow table of this many rows is small enough to send to every executor.
BROADCAST_ROWS = 1_000_000


def key_hash(columns: Sequence[str]) -> Column:
    return F.xxhash64(*(F.col(c) for c in columns))


def hot_keys(df: DataFrame, columns: Sequence[str], min_rows: int = HOT_KEY_ROWS) -> list[int]:
    """Hashes of all keys with at least `min_rows` rows, the largest first.

    Rows are counted exactly: partial counts are made where the rows are, and
    only those are shuffled. At most rows / `min_rows` numbers come back to the
    driver. Fetching them once keeps every later use of the set identical, even
    after a retry. A table with fewer rows in all is only looked at, not counted by key.
    """
    if df.select(F.lit(1)).limit(min_rows).count() < min_rows:
        return []
    counts = df.select(key_hash(columns).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    found = counts.where(F.col("n") >= min_rows).orderBy(F.desc("n"), "key")
    return [row["key"] for row in found.select("key").collect()]


def split(df: DataFrame, columns: Sequence[str], hot: list[int]) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of hot keys)."""
    known = df.sparkSession.createDataFrame([(h,) for h in hot], "_hot long")
    same = key_hash(columns) == F.col("_hot")
    return (
        df.join(F.broadcast(known), same, "left_anti"),
        df.join(F.broadcast(known), same, "left_semi"),
    )


def keyed_join(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "inner",
    min_rows: int = HOT_KEY_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Equi-join of many `rows` with a `table` holding a few rows per key.

    A table counted to have at most `broadcast_rows` rows is broadcast. Beyond
    that, ordinary keys take whatever join Spark picks. Rows of hot keys are
    still not shuffled as long as the table's rows for those keys, again by
    count, are few enough to broadcast; otherwise Spark splits the skewed
    partitions of its own join.
    """

    def small(df: DataFrame) -> bool:
        return df.limit(broadcast_rows + 1).count() <= broadcast_rows

    if small(table):
        return rows.join(F.broadcast(table), key, how)
    hot = hot_keys(rows, [key], min_rows)
    if not hot:
        return rows.join(table, key, how)
    rows_cold, rows_hot = split(rows, [key], hot)
    table_cold, table_hot = split(table, [key], hot)
    if not small(table_hot):
        return rows.join(table, key, how)
    return rows_cold.join(table_cold, key, how).unionByName(
        rows_hot.join(F.broadcast(table_hot), key, how)
    )
