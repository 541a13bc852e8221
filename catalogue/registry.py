"""Every registered query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue import inputs, sql
from tracestrata import MinerSettings, Store, materialize, scratch_dir
from tracestrata.functions import predicates as P
from tracestrata.functions import scalars as S
from tracestrata.functions import vocabulary as V
from tracestrata.operators import comparison as K
from tracestrata.operators import coverage as H
from tracestrata.operators import eventlog as L
from tracestrata.operators import metrics as M
from tracestrata.operators import mining, quantiles, strata
from tracestrata.operators.skew import keyed_join
from tracestrata.plans import ingest
from tracestrata.settings import QUANTILES
from tracestrata.sources import archive, dataset, ledger, tables
from tracestrata.streaming.ingest import stream_ingest

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

REFERENCE_MINER = MinerSettings()
RELAXED_MINER = MinerSettings(0.1, 0.1, 0.5, 50, 5)
ARCHETYPE_MINER = MinerSettings(0.1, 0.1, 0.5, 5, 2)


def _miner(m: MinerSettings) -> tuple:
    return (m.dependency, m.and_measure, m.loop_two, m.min_activity, m.min_edge)


def register(name: str, oracle: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return query

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(
        *(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes)
    )


def _round(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


# --- predicates and names ----------------------------------------------------

_EVENT_COLUMNS = "event_seq, repo_id, activity, action"


def _filtered(predicate: Callable) -> Query:
    def run(spark, folder):
        return inputs.events(spark, folder).where(predicate()).select(
            "event_seq", "repo_id", "activity", "action"
        )

    return run


for _name, _predicate, _where in (
    ("pred_human_events", P.is_human, sql.HUMAN),
    ("pred_repo_creation", P.is_repo_creation, sql.CREATION),
    ("pred_popularity", P.is_popularity, sql.POPULARITY),
    ("pred_engagement", P.is_engagement, sql.ENGAGEMENT),
    ("pred_collaboration", P.is_collaboration, sql.COLLABORATION),
    ("pred_core_workflow", P.is_core_workflow, sql.CORE),
):
    register(_name, sql.query(f"SELECT {_EVENT_COLUMNS} FROM ev WHERE {_where}"))(
        _filtered(_predicate)
    )


@register("core_events_named", sql.query("SELECT event_seq, repo_id, step FROM named "
                                         "WHERE step IS NOT NULL"))
def core_events_named(spark, folder):
    return L.named_events(inputs.events(spark, folder)).select("event_seq", "repo_id", "step")


@register(
    "payload_type_map",
    sql.query(
        "SELECT activity, CASE activity WHEN 'IssuesEvent' THEN 'Issue' "
        "ELSE replace(activity, 'Event', '') END AS payload_type, count(*) AS n "
        "FROM ev GROUP BY ALL"
    ),
)
def payload_type_map(spark, folder):
    return inputs.events(spark, folder).groupBy("activity", "payload_type").agg(
        F.count("*").alias("n")
    )


@register(
    "required_fields",
    sql.query(
        "SELECT strftime(timestamp, '%Y-%m-%d-') || extract(hour FROM timestamp) AS hour, "
        "count(*) AS total, count(*) FILTER (WHERE value >= 2) AS distilled, "
        "count(*) FILTER (WHERE value < 2) AS bad FROM ev GROUP BY 1"
    ),
)
def required_fields(spark, folder):
    flagged = inputs.archive_lines(spark, folder).select(
        "hour", P.has_required_fields().alias("valid")
    )
    return archive.hour_counts(flagged)


@register(
    "hour_stamp_valid",
    sql.query(
        "SELECT strftime(timestamp, '%Y-%m-%d-') || extract(hour FROM timestamp) AS stamp, "
        "min(date_trunc('hour', timestamp)) AS moment, count(*) AS n, FALSE AS padded_valid "
        "FROM ev GROUP BY 1"
    ),
)
def hour_stamp_valid(spark, folder):
    stamp = S.hour_stamp(F.col("timestamp"))
    stamped = inputs.events(spark, folder).groupBy(stamp.alias("stamp")).agg(
        F.count("*").alias("n")
    )
    padded = F.concat("stamp", F.lit(":00"))
    return stamped.select(
        "stamp",
        S.hour_time(F.col("stamp")).cast("timestamp_ntz").alias("moment"),
        "n",
        S.hour_time(padded).isNotNull().alias("padded_valid"),
    )


# --- lookup and metrics ------------------------------------------------------


@register("creation_lookup", sql.query("SELECT repo_id, created AS repo_creation_date FROM lookup"))
def creation_lookup(spark, folder):
    lookup = M.creation_lookup(M.creation_events(inputs.events(spark, folder)))
    return lookup.withColumn("repo_creation_date", F.col("repo_creation_date").cast("timestamp_ntz"))


@register(
    "events_of_born_repos",
    sql.query(
        f"SELECT {_EVENT_COLUMNS} FROM ev WHERE repo_id IN (SELECT repo_id FROM lookup)"
    ),
)
def events_of_born_repos(spark, folder):
    events = inputs.events(spark, folder)
    lookup = materialize(M.creation_lookup(M.creation_events(events)))
    born = keyed_join(
        events.select("event_seq", "repo_id", "activity", "action"), lookup, "repo_id", "left_semi"
    )
    return born.select("event_seq", "repo_id", "activity", "action")


@register(
    "dataset_counts",
    sql.query(
        "SELECT count(*) AS events, count(DISTINCT repo_id) AS repositories, "
        f"count(DISTINCT CASE WHEN {sql.CREATION} THEN repo_id END) AS created FROM ev"
    ),
)
def dataset_counts(spark, folder):
    return M.dataset_counts(inputs.events(spark, folder))


_METRIC_COLUMNS = ["repo_id", "age_in_days", *V.METRICS]
_COUNTS = ("collaboration_intensity_cum", "community_engagement_cum", "external_popularity_cum")
_METRICS_SQL = sql.query(
    f"SELECT repo_id, age_in_days, {', '.join(_COUNTS)}, "
    + _round("workload_cum", *(f"{d}_norm" for d in V.DIMENSIONS))
    + " FROM metrics"
)


def _metrics(spark, folder) -> DataFrame:
    return M.repo_metrics_of_born(inputs.events(spark, folder), inputs.END)


@register("repo_metrics", _METRICS_SQL)
def repo_metrics(spark, folder):
    events = inputs.events(spark, folder)
    lookup = M.creation_lookup(M.creation_events(events))
    return rounded(M.repo_metrics(events, lookup, inputs.END).select(_METRIC_COLUMNS))


@register("repo_metrics_one_scan", _METRICS_SQL)
def repo_metrics_one_scan(spark, folder):
    return rounded(_metrics(spark, folder).select(_METRIC_COLUMNS))


@register(
    "repo_metrics_norm",
    sql.query(
        "SELECT repo_id, " + _round(*(f"{d}_norm" for d in V.DIMENSIONS)) + " FROM metrics"
    ),
)
def repo_metrics_norm(spark, folder):
    return rounded(
        _metrics(spark, folder).select("repo_id", *(f"{d}_norm" for d in V.DIMENSIONS))
    )


@register(
    "distinct_collaborators",
    sql.query("SELECT repo_id, collaboration_intensity_cum AS collaborators FROM metrics"),
)
def distinct_collaborators(spark, folder):
    return _metrics(spark, folder).select(
        "repo_id", F.col("collaboration_intensity_cum").alias("collaborators")
    )


@register("repo_age_days", sql.query("SELECT repo_id, age_in_days FROM metrics"))
def repo_age_days(spark, folder):
    return _metrics(spark, folder).select("repo_id", "age_in_days")


# --- stratification ----------------------------------------------------------


def _threshold_sql(qs) -> str:
    keys = [quantiles.quantile_key(q).lower() for q in qs]
    rows = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, "
        + ", ".join(f"round(q_{m}[{i + 1}], 6) AS {k}" for i, k in enumerate(keys))
        + " FROM cuts"
        for m in V.METRICS
    )
    return sql.query(rows, quantiles=qs)


def _threshold_rows(table: DataFrame, qs) -> DataFrame:
    keys = [quantiles.quantile_key(q) for q in qs]
    return rounded(
        table.select("metric", *(F.col("thresholds")[k].alias(k.lower()) for k in keys))
    )


@register("thresholds", _threshold_sql(QUANTILES))
def thresholds(spark, folder):
    measured = materialize(_metrics(spark, folder))
    return _threshold_rows(quantiles.thresholds(measured), QUANTILES)


@register("thresholds_quartile", _threshold_sql(inputs.QUARTILES))
def thresholds_quartile(spark, folder):
    measured = materialize(_metrics(spark, folder))
    return _threshold_rows(quantiles.thresholds(measured, inputs.QUARTILES), inputs.QUARTILES)


@register("thresholds_approx")
def thresholds_approx(spark, folder):
    measured = _metrics(spark, folder)
    return _threshold_rows(quantiles.thresholds(measured, method="approx"), QUANTILES)


def _stratified(spark, folder, qs=QUANTILES) -> DataFrame:
    measured = materialize(_metrics(spark, folder))
    return strata.classify(measured, quantiles.threshold_values(quantiles.thresholds(measured, qs)))


def _members(spark, folder, qs=QUANTILES) -> DataFrame:
    return materialize(strata.archetype_members(_stratified(spark, folder, qs)))


_CATS = [f"{m}_cat" for m in V.METRICS]


@register("repo_categories", sql.query(f"SELECT repo_id, {', '.join(_CATS)} FROM strata"))
def repo_categories(spark, folder):
    """Thresholds stay in the plan, as a scalar subquery."""
    measured = materialize(_metrics(spark, folder))
    return strata.classify(measured, quantiles.thresholds(measured)).select("repo_id", *_CATS)


@register("strata", sql.query("SELECT repo_id, age_in_days, strato_id FROM strata"))
def strata_ids(spark, folder):
    return _stratified(spark, folder).select("repo_id", "age_in_days", "strato_id")


@register(
    "strata_distribution",
    sql.query(
        "SELECT strato_id, count(*) AS num_repo, "
        "round(count(*) * 100.0 / (SELECT count(*) FROM strata), 2) AS perc_tot "
        "FROM strata GROUP BY strato_id"
    ),
)
def strata_distribution(spark, folder):
    return strata.strata_distribution(_stratified(spark, folder))


@register("archetype_members", sql.query("SELECT repo_id, archetype FROM members"))
def archetype_members(spark, folder):
    return strata.archetype_members(_stratified(spark, folder))


@register(
    "archetype_members_quartile",
    sql.query("SELECT repo_id, archetype FROM members", quantiles=inputs.QUARTILES),
)
def archetype_members_quartile(spark, folder):
    return strata.archetype_members(_stratified(spark, folder, inputs.QUARTILES))


@register(
    "archetype_sizes",
    sql.query(
        "SELECT archetype, count(*) AS repos FROM members GROUP BY archetype",
        quantiles=inputs.QUARTILES,
    ),
)
def archetype_sizes(spark, folder):
    members = strata.archetype_members(_stratified(spark, folder, inputs.QUARTILES))
    return members.groupBy("archetype").agg(F.count("*").alias("repos"))


# --- event logs --------------------------------------------------------------

_COHORT = {"group": "cohort", "miner": _miner(RELAXED_MINER)}
_ARCHETYPE = {"quantiles": inputs.QUARTILES, "miner": _miner(ARCHETYPE_MINER)}


def _cohort_log(spark, folder) -> DataFrame:
    log = L.event_log(inputs.events(spark, folder), by="cohort")
    return log.withColumnRenamed("cohort", "archetype")


def _archetype_log(spark, folder) -> DataFrame:
    members = _members(spark, folder, inputs.QUARTILES)
    return L.event_log(inputs.events(spark, folder), members)


def _flow(log: DataFrame, **options) -> DataFrame:
    return L.flow_table(L.successors(log), **options)


@register(
    "event_log",
    sql.query(
        "SELECT grp AS archetype, case_id, activity, timestamp, resource, event_seq FROM log",
        **_ARCHETYPE,
    ),
)
def event_log(spark, folder):
    return _archetype_log(spark, folder).withColumn(
        "timestamp", F.col("timestamp").cast("timestamp_ntz")
    )


def _ends_sql(edge: str) -> str:
    return sql.query(
        f"SELECT grp AS archetype, activity, count(*) AS cases FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY grp, case_id "
        f"ORDER BY timestamp {edge}, event_seq {edge}) AS r FROM log) WHERE r = 1 GROUP BY ALL",
        **_COHORT,
    )


@register("case_starts", _ends_sql("ASC"))
def case_starts(spark, folder):
    return L.start_activities(_cohort_log(spark, folder))


@register("case_ends", _ends_sql("DESC"))
def case_ends(spark, folder):
    return L.end_activities(_cohort_log(spark, folder))


@register(
    "activity_occurrences",
    sql.query("SELECT grp AS archetype, activity, occurrences FROM occ", **_COHORT),
)
def activity_occurrences(spark, folder):
    return L.activity_counts(_cohort_log(spark, folder))


@register(
    "dfg_frequency",
    sql.query("SELECT grp AS archetype, source, target, frequency FROM dfg", **_COHORT),
)
def dfg_frequency(spark, folder):
    follows = L.directly_follows(_flow(_cohort_log(spark, folder)))
    return follows.select("archetype", "source", "target", "frequency")


@register(
    "dfg_performance",
    sql.query(
        "SELECT grp AS archetype, source, target, frequency, "
        + _round("mean_seconds")
        + " FROM dfg",
        **_ARCHETYPE,
    ),
)
def dfg_performance(spark, folder):
    follows = L.directly_follows(_flow(_archetype_log(spark, folder)))
    return rounded(follows.select("archetype", "source", "target", "frequency", "mean_seconds"))


@register("dfg_conversations", sql.sequence_dfg("conversations", "conv_id", "role", "turn"))
def dfg_conversations(spark, folder):
    steps = L.successors(
        inputs.conversation_log(spark, folder),
        order=["turn"],
        carried=["activity"],
    )
    return L.flow_table(steps, time=None).select("source", "target", "frequency", "two_loop")


@register(
    "dfg_orders",
    sql.sequence_dfg("orders", "o_custkey", "o_orderstatus", "o_orderdate, o_orderkey"),
)
def dfg_orders(spark, folder):
    flow = _flow(inputs.order_log(spark, folder))
    return flow.select("source", "target", "frequency", "two_loop")


# --- mining ------------------------------------------------------------------


@register(
    "two_loop_patterns",
    sql.query("SELECT grp AS archetype, source, target, two_loop FROM loops", **_COHORT),
)
def two_loop_patterns(spark, folder):
    flow = _flow(_cohort_log(spark, folder)).where(F.col("two_loop") > 0)
    return flow.select("archetype", "source", "target", "two_loop")


@register(
    "dependency_measure",
    sql.query(
        "SELECT grp AS archetype, source, target, frequency, "
        + _round("dependency", "loop_two")
        + " FROM scored",
        **_COHORT,
    ),
)
def dependency_measure(spark, folder):
    scores = mining.dependency_scores(_flow(_cohort_log(spark, folder)))
    return rounded(
        scores.select("archetype", "source", "target", "frequency", "dependency", "loop_two")
    )


def _model(spark, folder, cohort: bool = True, miner: MinerSettings | None = None):
    """(flow, nodes, edges); all of them small, and computed once."""
    log = _cohort_log(spark, folder) if cohort else _archetype_log(spark, folder)
    settings = miner or (RELAXED_MINER if cohort else ARCHETYPE_MINER)
    flow = materialize(_flow(log))
    edges = materialize(mining.discover_net(flow, settings))
    return flow, materialize(mining.model_nodes(flow, edges)), edges


_EDGE_SQL = (
    "SELECT grp AS archetype, source, target, frequency, "
    + _round("mean_seconds", "dependency")
    + ", kind FROM edges"
)


@register(
    "net_edges",
    sql.query(
        _EDGE_SQL.replace("grp AS archetype, ", ""),
        group="'all'",
        miner=_miner(REFERENCE_MINER),
    ),
)
def net_edges(spark, folder):
    """The net of all repositories at the default thresholds."""
    everything = inputs.events(spark, folder).withColumn("archetype", F.lit("all"))
    flow = materialize(_flow(L.event_log(everything)))
    return rounded(mining.discover_net(flow, REFERENCE_MINER).drop("archetype"))


@register("net_edges_relaxed", sql.query(_EDGE_SQL, **_COHORT))
def net_edges_relaxed(spark, folder):
    _, _, edges = _model(spark, folder)
    return rounded(edges)


@register("net_edges_archetype", sql.query(_EDGE_SQL, **_ARCHETYPE))
def net_edges_archetype(spark, folder):
    _, _, edges = _model(spark, folder, cohort=False)
    return rounded(edges)


_CONVERSATION_SQL = (
    "WITH f AS ("
    + sql.sequence_dfg("conversations", "conv_id", "role", "turn")
    + "), s AS (SELECT a.source, a.target, a.frequency, "
    "CASE WHEN a.source = a.target THEN a.frequency / (a.frequency + 1.0) "
    "ELSE (a.frequency - coalesce(b.frequency, 0)) "
    "/ (a.frequency + coalesce(b.frequency, 0) + 1.0) END AS dependency, "
    "(a.two_loop + coalesce(b.two_loop, 0)) / (a.two_loop + coalesce(b.two_loop, 0) + 1.0) "
    "AS loop_two FROM f a LEFT JOIN f b ON a.source = b.target AND a.target = b.source "
    "WHERE a.target IS NOT NULL) "
    "SELECT source, target, frequency, round(dependency, 6) AS dependency, "
    "CASE WHEN dependency >= 0.9 AND source = target THEN 'self_loop' "
    "WHEN dependency >= 0.9 THEN 'dependency' ELSE 'two_loop' END AS kind FROM s "
    "WHERE frequency >= 5 AND (dependency >= 0.9 OR (source <> target AND loop_two >= 0.7 "
    "AND NOT EXISTS (SELECT 1 FROM s t WHERE t.source = t.target AND t.frequency >= 5 "
    "AND t.dependency >= 0.9 AND t.source IN (s.source, s.target))))"
)


@register("net_edges_conversations", _CONVERSATION_SQL)
def net_edges_conversations(spark, folder):
    """Alternating roles: the natural length-two loop."""
    steps = L.successors(
        inputs.conversation_log(spark, folder),
        order=["turn"],
        carried=["activity"],
    )
    flow = materialize(L.flow_table(steps, time=None))
    edges = mining.discover_net(flow, MinerSettings(0.9, 0.8, 0.7, 5, 5))
    return rounded(edges.drop("archetype", "mean_seconds"))


@register(
    "net_nodes",
    sql.query("SELECT grp AS archetype, activity, occurrences, in_net FROM nodes", **_COHORT),
)
def net_nodes(spark, folder):
    _, nodes, _ = _model(spark, folder)
    return nodes


@register(
    "and_measure",
    sql.query(
        "SELECT a.grp AS archetype, a.source, a.target AS first, b.target AS second, "
        "round((coalesce(f.frequency, 0) + coalesce(r.frequency, 0)) "
        "/ (a.frequency + b.frequency + 1.0), 6) AS and_measure, "
        "(coalesce(f.frequency, 0) + coalesce(r.frequency, 0)) "
        "/ (a.frequency + b.frequency + 1.0) >= 0.1 AS concurrent "
        "FROM edges a JOIN edges b ON a.grp = b.grp AND a.source = b.source "
        "AND a.target < b.target "
        "LEFT JOIN dfg f ON f.grp = a.grp AND f.source = a.target AND f.target = b.target "
        "LEFT JOIN dfg r ON r.grp = a.grp AND r.source = b.target AND r.target = a.target",
        **_COHORT,
    ),
)
def and_measure(spark, folder):
    flow, _, edges = _model(spark, folder)
    return rounded(mining.concurrency(flow, edges, RELAXED_MINER))


# --- model metrics -----------------------------------------------------------


@register(
    "model_size",
    sql.query("SELECT grp AS archetype, num_nodes, num_edges FROM size", **_COHORT),
)
def model_size(spark, folder):
    _, nodes, edges = _model(spark, folder)
    return K.model_size(nodes, edges)


@register(
    "model_complexity",
    sql.query(
        "SELECT grp AS archetype, num_nodes, num_edges, "
        + _round("density", "avg_degree", "cyclomatic_complexity")
        + " FROM complexity",
        **_COHORT,
    ),
)
def model_complexity(spark, folder):
    _, nodes, edges = _model(spark, folder)
    return rounded(K.model_complexity(K.model_size(nodes, edges)))


@register(
    "top_activity",
    sql.query("SELECT grp AS archetype, top_activity, top_count FROM top", **_COHORT),
)
def top_activity(spark, folder):
    _, nodes, _ = _model(spark, folder)
    return K.top_activity(nodes)


@register(
    "slowest_edge",
    sql.query(
        "SELECT grp AS archetype, slow_source, slow_target, "
        + _round("slow_seconds")
        + " FROM slow",
        **_COHORT,
    ),
)
def slowest_edge(spark, folder):
    _, nodes, edges = _model(spark, folder)
    return rounded(K.slowest_edge(nodes, edges))


_PROFILE_SQL = (
    "SELECT grp AS archetype, num_nodes, num_edges, "
    + _round("density", "cyclomatic_complexity", "avg_degree")
    + ", most_freq_activity, slowest_edge FROM profile"
)


@register("identikit", sql.query(_PROFILE_SQL, **_ARCHETYPE))
def identikit(spark, folder):
    _, nodes, edges = _model(spark, folder, cohort=False)
    profile = K.identikit(nodes, edges)
    return rounded(
        profile.drop("top_activity", "top_count", "slow_source", "slow_target", "slow_seconds")
    )


@register("identikit_cohort", sql.query(_PROFILE_SQL, **_COHORT))
def identikit_cohort(spark, folder):
    _, nodes, edges = _model(spark, folder)
    profile = K.identikit(nodes, edges)
    return rounded(
        profile.drop("top_activity", "top_count", "slow_source", "slow_target", "slow_seconds")
    )


@register(
    "ratio_to_max",
    sql.query(
        "SELECT grp AS archetype, "
        + ", ".join(
            f"round({m} / (CASE WHEN max({m}) OVER () = 0 THEN 1 ELSE max({m}) OVER () END), 6) "
            f"AS {m}"
            for m in K.PROFILE_MEASURES
        )
        + " FROM complexity WHERE grp IN ('Giant_All', 'Giant_Pop_LowCollab')",
        **_ARCHETYPE,
    ),
)
def ratio_to_max(spark, folder):
    _, nodes, edges = _model(spark, folder, cohort=False)
    return rounded(K.ratio_to_max(K.identikit(nodes, edges)))


@register(
    "top_activities",
    sql.query(
        "SELECT grp AS archetype, activity, occurrences FROM nodes WHERE activity IN "
        "(SELECT activity FROM nodes GROUP BY activity "
        "ORDER BY sum(occurrences) DESC, activity LIMIT 5)",
        **_COHORT,
    ),
)
def top_activities(spark, folder):
    _, nodes, _ = _model(spark, folder)
    return K.top_activities(nodes, 5)


@register(
    "activity_skeleton", sql.query("SELECT DISTINCT activity FROM nodes", **_ARCHETYPE)
)
def activity_skeleton(spark, folder):
    _, nodes, _ = _model(spark, folder, cohort=False)
    return K.activity_skeleton(nodes)


def _matrix_sql(name: str, settings: dict) -> str:
    return sql.query(
        f"SELECT grp AS archetype, source, target, {_round('value')} FROM {name}", **settings
    )


@register("adjacency_frequency", _matrix_sql("freq", _ARCHETYPE))
def adjacency_frequency(spark, folder):
    _, nodes, edges = _model(spark, folder, cohort=False)
    return rounded(K.adjacency(K.models(nodes), edges, "frequency"))


@register("adjacency_performance", _matrix_sql("perf", _ARCHETYPE))
def adjacency_performance(spark, folder):
    _, nodes, edges = _model(spark, folder, cohort=False)
    return rounded(K.adjacency(K.models(nodes), edges, "performance"))


@register("adjacency_normalised", _matrix_sql("freq_norm", _COHORT))
def adjacency_normalised(spark, folder):
    _, nodes, edges = _model(spark, folder)
    return rounded(K.normalised(K.adjacency(K.models(nodes), edges, "frequency")))


@register(
    "adjacency_display",
    sql.query(
        "SELECT grp AS archetype, source, target, "
        "round(CASE WHEN value > 1e-9 THEN value END / 60.0, 6) AS minutes, "
        "round(round(CASE WHEN value > 1e-9 THEN value END / 3600.0, 2), 6) AS hours FROM perf",
        **_COHORT,
    ),
)
def adjacency_display(spark, folder):
    _, nodes, edges = _model(spark, folder)
    shown = S.visible(F.col("value"))
    return rounded(
        K.adjacency(K.models(nodes), edges, "performance").select(
            "archetype",
            "source",
            "target",
            S.minutes(shown).alias("minutes"),
            S.hours(shown).alias("hours"),
        )
    )


@register(
    "adjacency_wide",
    sql.query(
        "SELECT grp AS archetype, source AS activity, "
        + ", ".join(
            f"max(CASE WHEN target = '{a}' THEN value END) AS {a}" for a in V.SKELETON
        )
        + " FROM freq GROUP BY 1, 2",
        **_COHORT,
    ),
)
def adjacency_wide(spark, folder):
    _, nodes, edges = _model(spark, folder)
    return K.wide_matrix(K.adjacency(K.models(nodes), edges, "frequency"))


@register("stored_model", sql.query(_EDGE_SQL, **_COHORT))
def stored_model(spark, folder):
    """The model tables after a round trip through storage."""
    _, nodes, edges = _model(spark, folder)
    output = scratch_dir(spark, "model")
    tables.write_model(nodes, edges, output)
    columns = ["archetype", "source", "target", "frequency", "mean_seconds", "dependency", "kind"]
    return rounded(tables.read_model(spark, output)[1].select(columns))


@register("stored_strata", sql.query("SELECT repo_id, age_in_days, strato_id FROM strata"))
def stored_strata(spark, folder):
    """Stratified repositories after a round trip through storage."""
    path = f"{scratch_dir(spark, 'strata')}/repositories.parquet"
    tables.write_table(_stratified(spark, folder), path)
    return tables.read_stratified(spark, path).select("repo_id", "age_in_days", "strato_id")


# --- comparison --------------------------------------------------------------


def _cohort_names() -> list[str]:
    return [f"cohort{i}" for i in range(inputs.COHORTS)]


@register(
    "jaccard_nodes",
    sql.query(f"SELECT group_a, group_b, {_round('similarity')} FROM jac_nodes", **_ARCHETYPE),
)
def jaccard_nodes(spark, folder):
    _, nodes, _ = _model(spark, folder, cohort=False)
    return rounded(K.jaccard(nodes, K.ordered_pairs(spark), ["activity"]))


@register(
    "jaccard_edges",
    sql.query(f"SELECT group_a, group_b, {_round('similarity')} FROM jac_edges", **_ARCHETYPE),
)
def jaccard_edges(spark, folder):
    _, _, edges = _model(spark, folder, cohort=False)
    return rounded(K.jaccard(edges, K.ordered_pairs(spark), ["source", "target"]))


@register(
    "frobenius_frequency",
    sql.query(f"SELECT group_a, group_b, {_round('distance')} FROM frob_freq", **_ARCHETYPE),
)
def frobenius_frequency(spark, folder):
    _, nodes, edges = _model(spark, folder, cohort=False)
    return rounded(
        K.frobenius(K.cells(edges, "frequency"), K.models(nodes), K.ordered_pairs(spark))
    )


@register(
    "frobenius_performance",
    sql.query(f"SELECT group_a, group_b, {_round('distance')} FROM frob_perf", **_ARCHETYPE),
)
def frobenius_performance(spark, folder):
    _, nodes, edges = _model(spark, folder, cohort=False)
    groups = K.models(nodes)
    dense = K.adjacency(groups, edges, "performance")
    return rounded(K.frobenius(dense, groups, K.ordered_pairs(spark)))


@register(
    "delta_matrix",
    sql.query(
        f"SELECT group_a, group_b, metric, source, target, {_round('delta')} FROM deltas",
        **_ARCHETYPE,
    ),
)
def delta_matrix(spark, folder):
    _, nodes, edges = _model(spark, folder, cohort=False)
    pairs = K.modelled_pairs(K.unordered_pairs(spark), K.models(nodes))
    both = [
        K.delta_matrix(K.cells(edges, metric), pairs, metric).withColumn(
            "metric", F.lit(metric.capitalize())
        )
        for metric in K.ABSENT
    ]
    return rounded(both[0].unionByName(both[1]))


@register(
    "manhattan_tvd",
    sql.query(
        "SELECT group_a, group_b, metric, round(sum(abs(delta)), 6) AS manhattan, "
        "round(sum(abs(delta)) / 2, 6) AS tvd FROM deltas GROUP BY ALL",
        **_ARCHETYPE,
    ),
)
def manhattan_tvd(spark, folder):
    _, nodes, edges = _model(spark, folder, cohort=False)
    return rounded(K.manhattan_tvd(edges, K.models(nodes), K.unordered_pairs(spark)))


_SIMILARITY_SQL = (
    "SELECT group_a, group_b, round(n.similarity, 6) AS jaccard_nodes, "
    "round(e.similarity, 6) AS jaccard_edges, round(f.distance, 6) AS frobenius_frequency, "
    "round(p.distance, 6) AS frobenius_performance FROM jac_nodes n "
    "JOIN jac_edges e USING (group_a, group_b) JOIN frob_freq f USING (group_a, group_b) "
    "JOIN frob_perf p USING (group_a, group_b)"
)


@register("similarity_all", sql.query(_SIMILARITY_SQL, **_ARCHETYPE))
def similarity_all(spark, folder):
    """Quartile archetypes: every one of the five has a model."""
    _, nodes, edges = _model(spark, folder, cohort=False)
    return rounded(K.similarity(nodes, edges, K.ordered_pairs(spark)))


@register("similarity_missing_models", sql.query(_SIMILARITY_SQL, miner=_miner(ARCHETYPE_MINER)))
def similarity_missing_models(spark, folder):
    """Default quantiles: archetypes without repositories still take part."""
    members = _members(spark, folder)
    flow = materialize(_flow(L.event_log(inputs.events(spark, folder), members)))
    edges = mining.discover_net(flow, ARCHETYPE_MINER)
    nodes = mining.model_nodes(flow, edges)
    return rounded(K.similarity(nodes, edges, K.ordered_pairs(spark)))


@register("similarity_cohorts", sql.query(_SIMILARITY_SQL, **_COHORT))
def similarity_cohorts(spark, folder):
    _, nodes, edges = _model(spark, folder)
    return rounded(K.similarity(nodes, edges, K.ordered_pairs(spark, _cohort_names())))


# --- coverage ----------------------------------------------------------------


@register("hours_per_day", sql.query("SELECT day, hours FROM days"))
def hours_per_day(spark, folder):
    return H.hours_per_day(inputs.bot_hours(spark, folder))


@register("incomplete_days", sql.query("SELECT day, hours FROM days WHERE hours < 24"))
def incomplete_days(spark, folder):
    return H.incomplete_days(H.hours_per_day(inputs.bot_hours(spark, folder)))


@register(
    "first_incomplete_days",
    sql.query("SELECT day, hours FROM days WHERE hours < 24 ORDER BY day LIMIT 5"),
)
def first_incomplete_days(spark, folder):
    """The report's short list: the first five in date order."""
    days = H.incomplete_days(H.hours_per_day(inputs.bot_hours(spark, folder)))
    return days.orderBy("day").limit(5)


@register(
    "missing_days",
    sql.query(
        "SELECT CAST(day AS DATE) AS day FROM (SELECT unnest(generate_series("
        "(SELECT CAST(min(day) AS TIMESTAMP) FROM order_days), "
        "(SELECT CAST(max(day) AS TIMESTAMP) FROM order_days), "
        "INTERVAL 1 DAY)) AS day) WHERE CAST(day AS DATE) NOT IN (SELECT day FROM order_days)"
    ),
)
def missing_days(spark, folder):
    return H.missing_days(H.hours_per_day(inputs.order_hours(spark, folder)))


@register("contiguous_periods", sql.query("SELECT first_day, last_day, days FROM periods"))
def contiguous_periods(spark, folder):
    return H.contiguous_periods(H.hours_per_day(inputs.order_hours(spark, folder)))


@register(
    "longest_periods",
    sql.query(
        "SELECT first_day, last_day, days FROM periods ORDER BY days DESC, first_day LIMIT 5"
    ),
)
def longest_periods(spark, folder):
    days = H.hours_per_day(inputs.order_hours(spark, folder))
    return H.longest_periods(H.contiguous_periods(days))


@register(
    "recommended_window",
    sql.query(
        "SELECT strftime(first_day, '%Y-%m-%dT00:00:00Z') AS start_date, "
        "strftime(last_day, '%Y-%m-%dT23:59:59Z') AS end_date, days "
        "FROM periods ORDER BY days DESC, first_day LIMIT 1"
    ),
)
def recommended_window(spark, folder):
    days = H.hours_per_day(inputs.order_hours(spark, folder))
    return H.recommended_window(H.contiguous_periods(days))


@register(
    "coverage_summary",
    sql.query(
        "SELECT strftime(min(moment), '%Y-%m-%d-%H') AS min_hour, "
        "strftime(max(moment), '%Y-%m-%d-%H') AS max_hour, count(*) AS found_hours, "
        "date_diff('hour', min(moment), max(moment)) + 1 AS possible_hours, "
        "round(count(*) / (date_diff('hour', min(moment), max(moment)) + 1) * 100, 6) "
        "AS found_pct FROM hours"
    ),
)
def coverage_summary(spark, folder):
    return rounded(H.coverage_summary(inputs.bot_hours(spark, folder)))


@register(
    "coverage_span",
    sql.query(
        "SELECT min(day) AS first_day, max(day) AS last_day, count(*) AS days_found, "
        "count(*) FILTER (WHERE hours < 24) AS days_incomplete, "
        "date_diff('day', min(day), max(day)) + 1 AS total_days, "
        "date_diff('day', min(day), max(day)) + 1 - count(*) AS days_missing, "
        "round((date_diff('day', min(day), max(day)) + 1 - count(*)) * 100.0 "
        "/ (date_diff('day', min(day), max(day)) + 1), 6) AS missing_pct FROM order_days"
    ),
)
def coverage_span(spark, folder):
    return rounded(H.day_span(H.hours_per_day(inputs.order_hours(spark, folder))))


# --- ingest ------------------------------------------------------------------
# The raw archive files are derived from the `events` table, in a new folder.


# Landing is preparation and happens once per session; the store that several
# queries only read is likewise filled once.


@cache
def _landed(spark: SparkSession, folder: str) -> str:
    landing = scratch_dir(spark, "landing")
    inputs.land_archive(spark, folder, landing)
    return landing


def _new_store(spark: SparkSession) -> Store:
    return Store(scratch_dir(spark, "store"))


def _all_hours(spark: SparkSession, landing: str) -> DataFrame:
    return archive.list_hours(spark, landing).select("hour").distinct()


@cache
def _ingested(spark: SparkSession, folder: str) -> Store:
    landing, store = _landed(spark, folder), _new_store(spark)
    ingest.ingest_hours(spark, landing, store, _all_hours(spark, landing))
    return store


@register(
    "reprocess_gate",
    sql.query(
        "SELECT strftime(r.moment, '%Y-%m-%d-') || extract(hour FROM r.moment) AS hour, "
        "CASE WHEN h.moment IS NOT NULL AND (p.moment IS NULL OR p.n = p.known) "
        "THEN 'SKIPPED_PROCESSED' WHEN p.moment IS NULL THEN 'FAILED_404' ELSE 'to read' END AS outcome "
        "FROM (SELECT unnest(generate_series((SELECT date_trunc('hour', min(timestamp)) FROM ev), "
        "(SELECT date_trunc('hour', max(timestamp)) FROM ev), INTERVAL 1 HOUR)) AS moment) r "
        "LEFT JOIN hours h USING (moment) LEFT JOIN (SELECT "
        "date_trunc('hour', timestamp) AS moment, count(*) AS n, "
        "count(*) FILTER (WHERE event_seq % 5 <> 0) AS known "
        "FROM ev WHERE activity = 'PushEvent' GROUP BY 1) p USING (moment)"
    ),
)
def reprocess_gate(spark, folder):
    """All hours are requested; those with bots are processed, those with pushes have a file.

    A file's length is its number of pushes. Files of processed hours were read before
    the pushes whose number divides by five were there, so some of them have news.
    """
    events = inputs.events(spark, folder)
    span = events.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    steps = F.sequence(
        F.date_trunc("hour", "lo"), F.date_trunc("hour", "hi"), F.expr("interval 1 hour")
    )
    requested = span.select(F.explode(steps).alias("t")).select(
        S.hour_stamp(F.col("t")).alias("hour")
    )
    pushes = events.where(F.col("activity") == "PushEvent")
    landed = pushes.groupBy(S.hour_stamp(F.col("timestamp")).alias("hour")).agg(
        F.count("*").alias("length"), F.count_if(F.col("event_seq") % 5 != 0).alias("known")
    ).withColumn("path", F.col("hour"))
    read = F.array(F.struct("path", F.col("known").alias("length"), F.lit(None).cast("string").alias("checksum")))
    state = inputs.bot_hours(spark, folder).join(landed, "hour", "left").select(
        "hour", F.lit(V.PROCESSED).alias("status"), F.when(F.col("path").isNotNull(), read).otherwise(F.array()).alias("files")
    )
    planned = ingest.plan_hours(requested, state, landed.select("hour", "path", "length"))
    return planned.select("hour", F.coalesce("outcome", F.lit("to read")).alias("outcome"))


@register(
    "complete_days",
    sql.query(
        "SELECT day FROM (SELECT CAST(timestamp AS DATE) AS day, "
        "count(DISTINCT date_trunc('hour', timestamp)) AS n FROM ev GROUP BY 1) WHERE n = 24"
    ),
)
def complete_days(spark, folder):
    """Days whose 24 hours all have events."""
    hour = S.hour_stamp(F.col("timestamp")).alias("hour")
    settled = inputs.events(spark, folder).select(hour).distinct().select(
        "hour",
        F.to_date(S.hour_time(F.col("hour"))).alias("day"),
        F.lit(V.PROCESSED).alias("status"),
    )
    return ledger.complete_days(settled)


_DISTILLED_SQL = sql.query(
    "SELECT event_seq, repo_id, repo_name, actor_id, actor_login, activity, action, "
    "CASE activity WHEN 'IssuesEvent' THEN 'Issue' ELSE replace(activity, 'Event', '') END "
    "AS payload_type, round(push_size, 6) AS push_size, create_ref_type, pr_merged, "
    "strftime(timestamp, '%Y-%m-%d-') || extract(hour FROM timestamp) AS hour, "
    "strftime(date_trunc('second', timestamp), '%Y-%m-%d %H:%M:%S') AS created "
    "FROM ev WHERE value >= 2"
)


def _distilled(stored: DataFrame) -> DataFrame:
    return rounded(
        stored.select(
            "event_seq", "repo_id", "repo_name", "actor_id", "actor_login", "activity",
            "action", "payload_type", "push_size", "create_ref_type", "pr_merged",
            F.col("hour").cast("string").alias("hour"),
            F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("created"),
        )
    )


@register("ingest_distilled", _DISTILLED_SQL)
def ingest_distilled(spark, folder):
    return _distilled(spark.read.parquet(_ingested(spark, folder).hourly))


@register("ingest_twice", _DISTILLED_SQL)
def ingest_twice(spark, folder):
    """Forcing every hour again leaves the same rows."""
    landing, store = _landed(spark, folder), _ingested(spark, folder)
    ingest.ingest_hours(spark, landing, store, _all_hours(spark, landing), force=True)
    return _distilled(spark.read.parquet(store.hourly))


@register("stream_ingest", _DISTILLED_SQL)
def stream_ingest_query(spark, folder):
    """Incremental ingest gives the rows of the batch job."""
    landing, store = _landed(spark, folder), _new_store(spark)
    for _ in range(2):
        stream_ingest(spark, landing, store, f"{store.root}/progress").awaitTermination()
    return _distilled(spark.read.parquet(store.hourly))


_LEDGER_SQL = sql.query(
    "SELECT strftime(timestamp, '%Y-%m-%d-') || extract(hour FROM timestamp) AS hour, "
    "CAST(timestamp AS DATE) AS day, 'processed' AS status, count(*) AS total, "
    "count(*) FILTER (WHERE value >= 2) AS distilled, count(*) FILTER (WHERE value < 2) AS bad "
    "FROM ev GROUP BY ALL"
)


@register("ingest_ledger", _LEDGER_SQL)
def ingest_ledger(spark, folder):
    return ledger.read(spark, _ingested(spark, folder)).drop("updated_at")


@register(
    "ingest_totals",
    sql.query(
        "SELECT count(*) AS total, count(*) FILTER (WHERE value >= 2) AS distilled, "
        "count(*) FILTER (WHERE value < 2) AS bad FROM ev"
    ),
)
def ingest_totals(spark, folder):
    return ledger.totals(ledger.read(spark, _ingested(spark, folder)))


@register(
    "ledger_merge",
    sql.query(
        "SELECT strftime(timestamp, '%Y-%m-%d-') || extract(hour FROM timestamp) AS hour, "
        "CASE WHEN bool_or(NOT " + "(" + sql.HUMAN + ")) THEN 'processed' ELSE 'not_found' END "
        "AS status, CASE WHEN bool_or(NOT (" + sql.HUMAN + ")) THEN count(*) ELSE 0 END AS total "
        "FROM ev GROUP BY 1"
    ),
)
def ledger_merge(spark, folder):
    """Every hour is first not found; those with automated activity arrive later."""
    events = inputs.events(spark, folder)
    hour = S.hour_stamp(F.col("timestamp")).alias("hour")
    counted = events.groupBy(hour).agg(
        F.count("*").alias("total"), F.max(P.is_bot()).alias("late")
    )
    zero = F.lit(0).cast("long")
    first = counted.select(
        "hour",
        F.to_date(S.hour_time(F.col("hour"))).alias("day"),
        F.lit(V.NOT_FOUND).alias("status"),
        zero.alias("total"),
        zero.alias("distilled"),
        zero.alias("bad"),
        F.timestamp_seconds(F.lit(0)).alias("updated_at"),
    )
    second = counted.where("late").select(
        "hour",
        F.to_date(S.hour_time(F.col("hour"))).alias("day"),
        F.lit(V.PROCESSED).alias("status"),
        "total",
        F.col("total").alias("distilled"),
        zero.alias("bad"),
        F.timestamp_seconds(F.lit(1)).alias("updated_at"),
    )
    return ledger.current(first.unionByName(second)).select("hour", "status", "total")


@register(
    "counter_merge",
    sql.query("SELECT activity AS key, count(*) AS n FROM ev GROUP BY 1"),
)
def counter_merge(spark, folder):
    events = inputs.events(spark, folder)

    def counts(rows):
        return rows.groupBy(F.col("activity").alias("key")).agg(F.count("*").alias("n"))

    return ledger.merge_counts(counts(events.where(P.is_bot())), counts(events.where(P.is_human())))


@register(
    "day_window_scan",
    sql.query(
        "SELECT activity, count(*) AS n FROM ev WHERE value >= 2 "
        "AND CAST(timestamp AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' "
        "GROUP BY activity"
    ),
)
def day_window_scan(spark, folder):
    """Consolidated days, scanned through the day window of an analysis."""
    store = _new_store(spark)
    ingest_every_hour(spark, _landed(spark, folder), store)
    events = dataset.read_events(
        spark, store.events, "2024-01-03T00:00:00Z", "2024-01-20T23:59:59Z"
    )
    return events.groupBy("activity").agg(F.count("*").alias("n"))


def ingest_every_hour(spark: SparkSession, landing: str, store: Store) -> None:
    """Ingest the days with landed files and consolidate them.

    Hours without an archive file are requested as well, so that days are complete.
    """
    span = archive.list_hours(spark, landing).select(S.hour_time(F.col("hour")).alias("t"))
    days = span.agg(
        F.date_trunc("day", F.min("t")).alias("lo"), F.date_trunc("day", F.max("t")).alias("hi")
    )
    every = F.sequence("lo", F.col("hi") + F.expr("interval 23 hours"), F.expr("interval 1 hour"))
    hours = days.select(F.explode(every).alias("t")).select(
        S.hour_stamp(F.col("t")).alias("hour")
    )
    ingest.ingest_hours(spark, landing, store, hours)
    ingest.consolidate_days(spark, store)


@register("dataset_size")
def dataset_size(spark, folder):
    """Path, size and coverage of an ingested store."""
    return rounded(ingest.dataset_info(spark, _ingested(spark, folder)))


# Rows about stores, files and further adapters register themselves.
from catalogue import stores  # noqa: E402, F401
