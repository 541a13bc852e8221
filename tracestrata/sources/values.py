"""Values stored for exact quantiles: a histogram per day, and files clustered by bin.

Adding a day writes its values, sorted by metric and bin, and the few counts of its
histogram. Quantiles over any days merge those histograms, which tells the bins that
hold the wanted ranks; then only these bins' values are read, and Parquet's minima and
maxima skip the row groups of the others. No value of another day is sorted again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracestrata.functions import vocabulary as V
from tracestrata.operators import quantiles as Q
from tracestrata.settings import QUANTILES
from tracestrata.sources import dataset


def add_days(metrics: DataFrame, base: str, names: Sequence[str] = V.METRICS) -> None:
    """Store the positive values of the metrics of some days (column `day`); their former values are replaced."""
    binned = Q.binned(metrics, names, ("day",)).where("value is not null")
    counts = binned.groupBy("day", "metric", "bin").agg(F.count("*").alias("n"))
    order = ("day", "metric", "bin")
    clustered = binned.repartitionByRange(*order).sortWithinPartitions(*order, "value")
    dataset.overwrite_partitions(clustered.select("day", "metric", "bin", "value"), f"{base}/values", ("day", "metric"))
    # The histogram last: a day without one is not there yet.
    dataset.overwrite_partitions(counts.repartition("day"), f"{base}/histogram", ("day",))


def _of(spark: SparkSession, path: str, schema: str, days: Sequence[str] | None) -> DataFrame:
    stored = spark.read.schema(schema).parquet(path)
    return stored if days is None else stored.where(F.col("day").isin(*days))


def needed_bins(
    spark: SparkSession, base: str, days: Sequence[str] | None = None, quantiles: Sequence[float] = QUANTILES
) -> DataFrame:
    """(metric, bin, before): the bins that hold wanted ranks, and how many values lie below each."""
    counts = _of(spark, f"{base}/histogram", "metric string, bin long, n long, day string", days)
    return Q.bins_holding(counts.groupBy("metric", "bin").agg(F.sum("n").alias("n")), quantiles)


def stored_values(spark: SparkSession, base: str, bins: list, days: Sequence[str] | None = None) -> DataFrame:
    """The stored values of some bins: (metric, bin, value); only their files and row groups are read."""
    stored = _of(spark, f"{base}/values", "bin long, value double, day string, metric string", days)
    wanted = F.lit(False)
    for metric in sorted({row["metric"] for row in bins}):
        own = sorted({row["bin"] for row in bins if row["metric"] == metric})
        wanted = wanted | ((F.col("metric") == metric) & F.col("bin").isin(*own))
    return stored.where(wanted).select("metric", "bin", "value")


def thresholds(
    spark: SparkSession, base: str, days: Sequence[str] | None = None, quantiles: Sequence[float] = QUANTILES,
    names: Sequence[str] = V.METRICS,
) -> DataFrame:
    """One row per metric, as `quantiles.thresholds` gives for all values of these days."""
    needed = needed_bins(spark, base, days, quantiles).collect()  # two per metric and quantile at most
    if not needed:
        return spark.createDataFrame([], "metric string, thresholds map<string,double>")
    values = stored_values(spark, base, needed, days)
    return Q.from_bins(values, spark.createDataFrame(needed), quantiles, names)
