"""Quantile thresholds over the positive values of each metric."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracestrata.errors import CalculationError, ContractError
from tracestrata.functions import vocabulary as V
from tracestrata.settings import QUANTILES

# Logarithmic histogram resolution: about 0.1 % of relative width per bin.
_BINS_PER_E = 1024


def quantile_key(q: float) -> str:
    return f"Q{q * 100:g}"


def _labelled(values: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """(metric, values array) -> (metric, thresholds map), 0.0 where undefined."""
    keys = F.array(*(F.lit(quantile_key(q)) for q in quantiles))
    filled = F.array(
        *(F.coalesce(F.get("values", i), F.lit(0.0)) for i in range(len(quantiles)))
    )
    return values.select("metric", F.map_from_arrays(keys, filled).alias("thresholds"))


def _long(metrics: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(metric, value): positive values, and null for all others; beside the columns to `keep`."""
    doubles = metrics.select(*keep, *(F.col(m).cast("double").alias(m) for m in names))
    long = doubles.unpivot(list(keep), list(names), "metric", "value")
    return long.select(*keep, "metric", F.when(F.col("value") > 0, F.col("value")).alias("value"))


def thresholds(
    metrics: DataFrame,
    quantiles: Sequence[float] = QUANTILES,
    names: Sequence[str] = V.METRICS,
    method: str = "exact",
) -> DataFrame:
    """One row per metric: a map from quantile name to threshold.

    Values are interpolated linearly over the positive values of the metric; a
    metric without any gets 0.0. An empty input gives no rows.

    ``exact`` never gathers a metric's values in one task. A logarithmic
    histogram, whose size does not depend on the row count, shows which bins
    hold the wanted ranks. All values of the other bins are then replaced by one
    value inside their bin, which leaves the value at every wanted rank as it
    was and bounds what the final aggregate has to hold. ``approx`` uses a rank
    sketch and does not interpolate.
    """
    long = _long(metrics, names)
    wanted = F.array(*(F.lit(float(q)) for q in quantiles))
    if method == "approx":
        summary = F.percentile_approx("value", wanted, 10_000)
        return _labelled(long.groupBy("metric").agg(summary.alias("values")), quantiles)
    if method != "exact":
        raise ContractError(f"unknown quantile method {method!r}")

    bins = _with_bin(long)
    counts = bins.where(F.col("bin").isNotNull()).groupBy("metric", "bin").agg(F.count("*").alias("n"))
    # At most two bins per metric and quantile are needed: broadcast is bounded.
    needed = bins_holding(counts, quantiles).select("metric", "bin", F.lit(True).alias("needed"))
    middle = F.exp((F.col("bin") + 0.5) / _BINS_PER_E)
    compact = bins.join(F.broadcast(needed), ["metric", "bin"], "left").select(
        "metric", F.when(F.col("needed"), F.col("value")).otherwise(middle).alias("value")
    )
    summary = F.percentile("value", wanted)
    return _labelled(compact.groupBy("metric").agg(summary.alias("values")), quantiles)


def _with_bin(long: DataFrame) -> DataFrame:
    return long.withColumn("bin", F.floor(F.log("value") * _BINS_PER_E))


def binned(
    metrics: DataFrame, names: Sequence[str] = V.METRICS, keep: Sequence[str] = ()
) -> DataFrame:
    """(metric, value, bin) of every metric of every row; value and bin are null unless positive."""
    return _with_bin(_long(metrics, names, keep))


def bins_holding(counts: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """(metric, bin, before, total) of the bins of a histogram that contain a rank next to a wanted quantile."""
    upto = F.sum("n").over(W.partitionBy("metric").orderBy("bin"))
    total = F.sum("n").over(W.partitionBy("metric"))
    first, last, end = F.col("upto") - F.col("n"), F.col("upto") - 1, F.col("total") - 1
    holds = reduce(
        or_, ((first <= F.ceil(end * q)) & (last >= F.floor(end * q)) for q in quantiles)
    )
    ranked = counts.select("metric", "bin", "n", upto.alias("upto"), total.alias("total"))
    return ranked.where(holds).select("metric", "bin", (F.col("upto") - F.col("n")).alias("before"), "total")


def from_bins(
    values: DataFrame, needed: DataFrame, quantiles: Sequence[float], names: Sequence[str] = V.METRICS
) -> DataFrame:
    """Thresholds from the values of the needed bins alone (`needed` as `bins_holding` gives it).

    A wanted rank lies in a needed bin, so its place there follows from the number of
    values below the bin. Equal values are counted, not listed.
    """
    spark = values.sparkSession
    rank = W.partitionBy("metric", "bin").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    counted = values.groupBy("metric", "bin", "value").agg(F.count("*").alias("n"))
    placed = counted.select("metric", "bin", "value", "n", F.coalesce(F.sum("n").over(rank), F.lit(0)).alias("below"))
    start = F.col("before") + F.col("below")
    placed = placed.join(F.broadcast(needed), ["metric", "bin"]).select(
        "metric", "value", "total", start.alias("first"), (start + F.col("n") - 1).alias("last")
    )
    found = []
    for q in quantiles:
        place = (F.col("total") - 1) * F.lit(float(q))
        low, high = F.floor(place), F.ceil(place)

        def at(rank):
            return F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col("value")))

        found.append(F.struct(at(low).alias("low"), at(high).alias("high"), F.max(place - low).alias("part")))
    listed = placed.groupBy("metric").agg(F.array(*found).alias("found"))
    every = spark.createDataFrame([(n,) for n in names], "metric string")
    values = F.transform("found", lambda f: f["low"] + (f["high"] - f["low"]) * f["part"])
    return _labelled(every.join(F.broadcast(listed), "metric", "left").select("metric", values.alias("values")), quantiles)


def threshold_values(table: DataFrame) -> dict[str, dict[str, float]]:
    """The few threshold rows as a dict; an empty metrics table is an error."""
    found = {row["metric"]: dict(row["thresholds"]) for row in table.collect()}
    if not found:
        raise CalculationError("no repository metrics to compute thresholds from")
    return found
