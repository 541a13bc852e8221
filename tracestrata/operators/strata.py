"""Categories, strata and archetypes of repositories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracestrata import contracts as C
from tracestrata.errors import ContractError
from tracestrata.functions import predicates as P
from tracestrata.functions import scalars as S
from tracestrata.functions import vocabulary as V
from tracestrata.settings import LABELS


def _literal_cuts(
    table: Mapping[str, Mapping[str, float]], names: Sequence[str], count: int
) -> dict[str, list[Column]]:
    if not table:
        raise ContractError("thresholds are empty")
    cuts = {}
    for m in names:
        if m not in table or len(table[m]) != count:
            raise ContractError(f"{m}: expected {count} thresholds")
        cuts[m] = [F.lit(float(v)) for v in sorted(table[m].values())]
    return cuts


def classify(
    metrics: DataFrame,
    thresholds: DataFrame | Mapping[str, Mapping[str, float]],
    labels: Sequence[str] = LABELS,
    names: Sequence[str] = V.METRICS,
) -> DataFrame:
    """Add one category per metric and the stratum id that joins them.

    A table of thresholds (one row per metric) enters as a scalar subquery that
    Spark evaluates once, so the classification stays map-only either way.
    """
    C.require_columns(metrics, names, "metrics")
    count = len(labels) - 1
    columns = metrics.columns
    if isinstance(thresholds, DataFrame):
        ascending = F.array_sort(F.map_values("thresholds"))
        complete = F.lit(True)
        for m in names:
            complete &= F.coalesce(F.size(F.try_element_at("cuts", F.lit(m))) == count, F.lit(False))
        fault = F.raise_error(F.lit(f"every metric needs {count} thresholds"))
        packed = thresholds.agg(
            F.map_from_entries(F.collect_list(F.struct("metric", ascending))).alias("cuts")
        ).select(F.when(complete, F.col("cuts")).otherwise(fault.cast("map<string,array<double>>")))
        metrics = metrics.withColumn("_cuts", packed.scalar())
        cuts = {
            m: [F.get(F.try_element_at("_cuts", F.lit(m)), F.lit(i)) for i in range(count)]
            for m in names
        }
    else:
        cuts = _literal_cuts(thresholds, names, count)
    categories = [f"{m}_cat" for m in names]
    return metrics.select(
        *columns,
        *(S.category(F.col(m), cuts[m], labels).alias(c) for m, c in zip(names, categories)),
    ).withColumn("strato_id", F.concat_ws("|", *categories))


def strata_distribution(stratified: DataFrame) -> DataFrame:
    """Repositories per stratum and their share, largest stratum first.

    The total is taken over the strata, of which there are at most
    categories ** metrics, not over the repositories.
    """
    C.require_columns(stratified, ["strato_id"], "stratified repositories")
    counts = stratified.groupBy("strato_id").agg(F.count("*").alias("num_repo"))
    total = F.sum("num_repo").over(W.partitionBy(F.lit(0)))
    share = S.percentage(F.col("num_repo"), total).alias("perc_tot")
    return counts.select("strato_id", "num_repo", share).orderBy(
        F.desc("num_repo"), "strato_id"
    )


def archetype_members(stratified: DataFrame) -> DataFrame:
    """(repo_id, archetype) for every archetype a repository satisfies."""
    C.require_columns(stratified, [f"{d}_norm_cat" for d in V.DIMENSIONS], "stratified")
    return stratified.select("repo_id", F.explode(P.archetypes_of()).alias("archetype"))
