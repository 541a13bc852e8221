"""The three analysis jobs: stratification, process discovery, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracestrata.errors import MissingDataError
from tracestrata.functions import scalars as S
from tracestrata.operators import comparison as K
from tracestrata.operators import eventlog, membership, metrics, mining, quantiles, strata
from tracestrata.session import ensure_utc
from tracestrata.settings import AnalysisSettings
from tracestrata.sources import dataset, tables

# Names under which the results of a study are looked for.
REPOSITORIES = "analyzable_repositories.csv"
METRICS = "metrics_raw.parquet"
THRESHOLDS = "stratification_thresholds.json"
STRATIFIED = "repositories_stratified.parquet"
DISTRIBUTION = "group_distribution.csv"
EVENT_LOG = "event_log"
FLOW = "flow"
CONCURRENCY = "model_concurrency"
IDENTIKIT = "archetypes_structural_identikit.csv"
SIMILARITY = "similarity.csv"
DISTANCES = "structural_distance_metrics.csv"
DELTAS = "delta_matrices"
COUNTS = "activity_counts.csv"
SKELETON = "activity_skeleton.csv"
TOP_ACTIVITIES = "top_activities.csv"
PROFILE = "ratio_profile.csv"
DISPLAY = "adjacency_display"

# Column titles of the two published report tables.
_IDENTIKIT_TITLES = {
    "archetype": "Archetype",
    "num_nodes": "Num_Nodes",
    "num_edges": "Num_Edges",
    "density": "Density",
    "cyclomatic_complexity": "Cyclomatic_Complexity",
    "avg_degree": "Avg_Degree",
    "most_freq_activity": "Most_Freq_Activity",
    "slowest_edge": "Slowest_Edge",
}
_DISTANCE_TITLES = {
    "group_a": "Archetype_A",
    "group_b": "Archetype_B",
    "metric": "Metric",
    "manhattan": "Manhattan_Dist",
    "tvd": "TVD",
}


def _titled(df: DataFrame, titles: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(name).alias(title) for name, title in titles.items()))


def run_stratification(spark: SparkSession, settings: AnalysisSettings) -> DataFrame:
    """Metrics, thresholds, strata and their distribution; returns the distribution.

    Metrics are stored once and read back, so the events are aggregated a
    single time; everything after that works on one row per repository.
    """
    ensure_utc(spark)
    S.parse_utc(settings.end)
    events = dataset.read_events(spark, settings.dataset, settings.start, settings.end)
    lookup = metrics.creation_lookup(metrics.creation_events(events))
    tables.write_table(lookup.select("repo_id"), settings.path(REPOSITORIES))
    if spark.read.schema("repo_id long").csv(settings.path(REPOSITORIES), header=True).isEmpty():
        raise MissingDataError("no repository was created within the window")

    # Repositories born before the window are most of those with events; they are dropped
    # while scanning instead of after all their events have been aggregated and shuffled.
    born = membership.may_contain(lookup, "repo_id")
    tables.write_table(
        metrics.repo_metrics_of_born(events.where(born(F.col("repo_id"))), settings.end),
        settings.path(METRICS),
    )
    measured = spark.read.parquet(settings.path(METRICS))
    found = quantiles.thresholds(measured, settings.quantiles, method=settings.quantile_method)
    tables.write_thresholds(found, settings.path(THRESHOLDS))
    cuts = quantiles.threshold_values(
        tables.read_thresholds(spark, settings.path(THRESHOLDS))
    )
    tables.write_table(
        strata.classify(measured, cuts, settings.labels), settings.path(STRATIFIED)
    )
    stratified = tables.read_stratified(spark, settings.path(STRATIFIED))
    tables.write_report(
        strata.strata_distribution(stratified),
        settings.path(DISTRIBUTION),
        [F.desc("num_repo"), "strato_id"],
    )
    return strata.strata_distribution(stratified)


def run_discovery(spark: SparkSession, settings: AnalysisSettings) -> None:
    """Event log and model of every archetype that has repositories, in one job each."""
    ensure_utc(spark)
    stratified = tables.read_stratified(spark, settings.path(STRATIFIED))
    if stratified.isEmpty():
        raise MissingDataError("the table of stratified repositories is empty")
    events = dataset.read_events(spark, settings.dataset, settings.start, settings.end)
    members = strata.archetype_members(stratified)
    log = eventlog.event_log(events, members, hot_rows=settings.hot_rows)
    buckets = settings.log_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables.write_log(log, settings.path(EVENT_LOG), buckets, hot_rows=settings.hot_rows)
    stored = tables.read_log(spark, settings.path(EVENT_LOG), log.schema, buckets)
    steps = eventlog.successors(stored, hot_rows=settings.hot_rows)
    tables.write_by_group(tables.one_file(eventlog.flow_table(steps)), settings.path(FLOW))
    flow = spark.read.parquet(settings.path(FLOW))
    edges = mining.discover_net(flow, settings.miner)
    nodes = mining.model_nodes(flow, edges)
    tables.write_model(nodes, edges, settings.output)
    tables.write_by_group(
        tables.one_file(mining.concurrency(flow, edges, settings.miner)),
        settings.path(CONCURRENCY),
    )


def _shown(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Performance matrices as they are shown: minutes, null where there is no time to speak of."""
    matrix = K.adjacency(groups, edges, "performance")
    return matrix.withColumn("value", S.minutes(S.visible(F.col("value"))))


def run_comparison(spark: SparkSession, settings: AnalysisSettings) -> DataFrame:
    """All comparison tables over the five archetypes; returns the identikit."""
    ensure_utc(spark)
    nodes, edges = tables.read_model(spark, settings.output)
    groups = K.models(nodes)
    for metric in K.ABSENT:
        matrix = K.adjacency(groups, edges, metric)
        tables.write_matrices(K.wide_matrix(matrix), settings.path(f"adjacency_{metric}"))
        scaled = K.wide_matrix(K.normalised(matrix))
        tables.write_matrices(scaled, settings.path(f"adjacency_{metric}_normalised"))
    tables.write_matrices(K.wide_matrix(_shown(groups, edges)), settings.path(DISPLAY))
    profile = K.identikit(nodes, edges)
    tables.write_report(K.ratio_to_max(profile), settings.path(PROFILE), ["archetype"])
    tables.write_report(K.activity_skeleton(nodes), settings.path(SKELETON), ["activity"])
    tables.write_report(K.top_activities(nodes), settings.path(TOP_ACTIVITIES), ["activity", "archetype"])
    tables.write_report(_titled(profile, _IDENTIKIT_TITLES), settings.path(IDENTIKIT))
    tables.write_report(nodes.select("archetype", "activity", "occurrences"), settings.path(COUNTS))

    alike = K.similarity(nodes, edges, K.ordered_pairs(spark))
    tables.write_report(alike, settings.path(SIMILARITY))
    pairs = K.modelled_pairs(K.unordered_pairs(spark), groups)
    distances = K.manhattan_tvd(edges, groups, pairs)
    tables.write_report(_titled(distances, _DISTANCE_TITLES), settings.path(DISTANCES))
    deltas = [
        K.delta_matrix(K.cells(edges, metric), pairs, metric).withColumn("metric", F.lit(metric))
        for metric in K.ABSENT
    ]
    tables.write_by_group(
        tables.one_file(deltas[0].unionByName(deltas[1])), settings.path(DELTAS), by="metric"
    )
    return profile
