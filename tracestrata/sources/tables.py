"""Stored results of the analysis jobs: readers with checks, and writers."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracestrata import contracts as C
from tracestrata.errors import ContractError, DataPreparationError, MissingDataError
from tracestrata.operators import skew
from tracestrata.schemas import MODEL_EDGES, MODEL_NODES
from tracestrata.settings import HOT_KEY_ROWS
from tracestrata.sources import files

MODEL_TYPES = ("frequency", "performance")


def write_table(df: DataFrame, path: str) -> None:
    """Parquet when the path ends in ``.parquet``, else CSV with a header."""
    writer = df.write.mode("overwrite")
    if path.endswith(".parquet"):
        writer.option("compression", "zstd").parquet(path)
    else:
        writer.option("header", True).csv(path)


def one_file(df: DataFrame, order: Sequence[str | Column] = ()) -> DataFrame:
    """A result of bounded size in a single sorted partition.

    Repartitioning, unlike coalescing, leaves the aggregation below parallel.
    """
    single = df.repartition(1)
    return single.sortWithinPartitions(*order) if order else single


def write_report(df: DataFrame, path: str, order: Sequence[str | Column] = ()) -> None:
    """A table of bounded size, as a single file."""
    write_table(one_file(df, order), path)


def write_thresholds(thresholds: DataFrame, path: str) -> None:
    one_file(thresholds, ["metric"]).write.mode("overwrite").json(path)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("metric string, thresholds map<string,double>").json(path)


def read_stratified(spark: SparkSession, path: str) -> DataFrame:
    try:
        table = spark.read.parquet(path)
    except AnalysisException as error:
        raise MissingDataError(f"no stratified repositories at {path}") from error
    return C.require_columns(table, C.STRATIFIED, path, DataPreparationError)


def write_by_group(df: DataFrame, path: str, by: str = "archetype") -> None:
    """Parquet with one folder per group; what another run left there is replaced as a whole."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .option("compression", "zstd")
        .partitionBy(by)
        .parquet(path)
    )


def _table_name(path: str) -> str:
    return f"tracestrata_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def _declare(spark: SparkSession, path: str, columns: str, by: str, key: str, order: Sequence[str], buckets: int) -> str:
    """A table of this session over the files at `path`, bucketed by `key`."""
    name = _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY ({by}) "
        f"CLUSTERED BY ({key}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return name


def write_log(
    log: DataFrame, path: str, buckets: int, by: str = "archetype", key: str = "case_id",
    order: Sequence[str] = ("timestamp", "event_seq"), hot_rows: int = HOT_KEY_ROWS,
) -> None:
    """An event log with one folder per group, in buckets of cases sorted by case and time.

    A bucket is written by one task into one file a group, so that it is read back
    without a shuffle; cases of `hot_rows` events and more are dealt over several tasks.
    """
    spark = log.sparkSession
    files.remove(spark, [path])
    bucket = F.pmod(F.hash(key), F.lit(buckets))
    hot = skew.hot_keys(log, [key], hot_rows)
    known = spark.createDataFrame([(h,) for h in hot], "_hot long")
    marked = log.join(F.broadcast(known), skew.key_hash([key]) == F.col("_hot"), "left") if hot else log.withColumn("_hot", F.lit(None).cast("long"))
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*order), F.lit(_HOT_PARTS))).otherwise(F.lit(0))
    dealt = marked.withColumn("_salt", salt).repartition(buckets, bucket, "_salt").drop("_hot", "_salt")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema if f.name != by)
    kind = log.schema[by].dataType.simpleString()
    name = _declare(spark, path, f"{columns}, {by} {kind}", by, key, [key, *order], buckets)
    kept = [f.name for f in log.schema if f.name != by]
    (
        dealt.select(*kept, by).write.mode("append").format("parquet").option("compression", "zstd")
        .partitionBy(by).bucketBy(buckets, key).sortBy(key, *order).saveAsTable(name)
    )


def read_log(
    spark: SparkSession, path: str, schema: StructType, buckets: int, by: str = "archetype", key: str = "case_id",
    order: Sequence[str] = ("timestamp", "event_seq"),
) -> DataFrame:
    """A log as `write_log` left it; what groups it by case needs no shuffle."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema if f.name != by)
    kind = schema[by].dataType.simpleString()
    name = _declare(spark, path, f"{columns}, {by} {kind}", by, key, [key, *order], buckets)
    spark.sql(f"MSCK REPAIR TABLE {name}")  # finds the groups' folders
    return spark.table(name)


# Tasks that write a hot case.
_HOT_PARTS = 32


def write_matrices(matrix: DataFrame, path: str, by: str = "archetype") -> None:
    """Wide matrices as CSV, one folder and one file per group."""
    (
        matrix.repartition(by)
        .sortWithinPartitions(by, "activity")
        .write.mode("overwrite")
        .option("header", True)
        .partitionBy(by)
        .csv(path)
    )


def write_model(nodes: DataFrame, edges: DataFrame, output: str, by: str = "archetype") -> None:
    write_by_group(one_file(nodes), f"{output}/model_nodes", by)
    write_by_group(one_file(edges), f"{output}/model_edges", by)


def read_model(
    spark: SparkSession, output: str, archetype: str | None = None, kind: str = "performance"
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one archetype or all; an absent model gives no rows.

    A ``frequency`` model is the same net without durations.
    """
    if kind not in MODEL_TYPES:
        raise ContractError(f"model type must be one of {MODEL_TYPES}")

    def load(name, schema):
        path = f"{output}/{name}"
        if not files.exists(spark, path):
            return spark.createDataFrame([], schema)
        table = spark.read.schema(schema).parquet(path)
        return table if archetype is None else table.where(F.col("archetype") == archetype)

    nodes, edges = load("model_nodes", MODEL_NODES), load("model_edges", MODEL_EDGES)
    return nodes, edges if kind == "performance" else edges.drop("mean_seconds")
