"""Registered queries about what is written and read back, about days, and about all event types."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue import inputs, registry, sql
from catalogue.registry import register, rounded
from tracestrata import Store, materialize, scratch_dir
from tracestrata.functions import predicates as P
from tracestrata.functions import scalars as S
from tracestrata.functions import vocabulary as V
from tracestrata.operators import comparison as K
from tracestrata.operators import daily, membership, quantiles, strata
from tracestrata.operators import eventlog as L
from tracestrata.operators import metrics as M
from tracestrata.plans import ingest, validate
from tracestrata.sources import dataset, ledger, tables, values
from tracestrata.streaming.ingest import stream_ingest

_HOUR = "strftime(timestamp, '%Y-%m-%d-') || extract(hour FROM timestamp)"


# --- every event type --------------------------------------------------------


def _listed(names: tuple) -> str:
    return "[" + ", ".join("NULL" if n is None else repr(n) if isinstance(n, str) else str(n).upper() for n in names) + "]"


def _dealt(names: tuple, place: str) -> str:
    return f"({_listed(names)})[{place} % {len(names)} + 1]"


_PAYLOADS = "CASE activity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.PAYLOAD_NAMES.items()) + " END"


def _all_types(final: str) -> str:
    return (
        "WITH dealt AS (SELECT event_id AS event_seq, user_id AS repo_id, "
        f"{_dealt(inputs.TYPES, 'event_id')} AS activity, "
        f"CASE WHEN event_id % 11 <> 0 THEN {_dealt(inputs.ACTIONS, 'k')} END AS action, "
        f"{_dealt(inputs.REVIEWS, 'event_id')} AS review_state, "
        f"{_dealt(inputs.CREATED, 'k')} AS create_ref_type, {_dealt(inputs.DELETED, 'k')} AS delete_ref_type, "
        f"{_dealt(inputs.MERGED, 'k')} AS pr_merged, {_dealt(inputs.LOGINS, 'k')} AS actor_login "
        "FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)), "
        f"typed AS (SELECT *, {_PAYLOADS} AS payload_type FROM dealt) {final}"
    )


for _name, _predicate, _where in (
    ("all_types_human", P.is_human, sql.HUMAN),
    ("all_types_creation", P.is_repo_creation, sql.CREATION),
    ("all_types_popularity", P.is_popularity, sql.POPULARITY),
    ("all_types_engagement", P.is_engagement, sql.ENGAGEMENT),
    ("all_types_collaboration", P.is_collaboration, sql.COLLABORATION),
    ("all_types_core", P.is_core_workflow, sql.CORE),
):

    def _chosen(spark, folder, predicate=_predicate):
        return inputs.all_types(spark, folder).where(predicate()).select("event_seq", "repo_id", "activity", "action")

    register(_name, _all_types(f"SELECT event_seq, repo_id, activity, action FROM typed WHERE {_where}"))(_chosen)


@register(
    "all_types_named",
    _all_types(f"SELECT event_seq, {sql.STEP} AS step FROM typed WHERE activity IS NOT NULL AND {sql.STEP} IS NOT NULL"),
)
def all_types_named(spark, folder):
    events = inputs.all_types(spark, folder)
    named = events.where(P.has_step_name(events.columns))
    return named.select("event_seq", P.step_name(events.columns).alias("step"))


@register("all_types_payload", _all_types("SELECT activity, payload_type, count(*) AS n FROM typed GROUP BY ALL"))
def all_types_payload(spark, folder):
    return inputs.all_types(spark, folder).groupBy("activity", "payload_type").agg(F.count("*").alias("n"))


# Stamps written in eight ways, by the number of the event; only the first two are valid.
_STAMPS = (
    "strftime(timestamp, '%Y-%m-%d-') || extract(hour FROM timestamp)",
    "strftime(timestamp, '%Y-%m-%d-') || (10 + extract(hour FROM timestamp) % 10)",
    "strftime(timestamp, '%Y-%m-%d-') || '0' || (extract(hour FROM timestamp) % 10)",
    "strftime(timestamp, '%Y/%m/%d-') || extract(hour FROM timestamp)",
    "strftime(timestamp, '%Y-%m-%d-') || (24 + extract(hour FROM timestamp))",
    "strftime(timestamp, '%Y') || '-02-30-' || extract(hour FROM timestamp)",
    "'1999' || strftime(timestamp, '-%m-%d-') || extract(hour FROM timestamp)",
    "'at ' || strftime(timestamp, '%Y-%m-%d-') || extract(hour FROM timestamp)",
)


@register(
    "hour_stamp_forms",
    sql.query(
        "SELECT event_seq, CASE event_seq % 8 "
        + " ".join(f"WHEN {i} THEN {form}" for i, form in enumerate(_STAMPS))
        + " END AS stamp, event_seq % 8 < 2 AS valid FROM ev"
    ),
)
def hour_stamp_forms(spark, folder):
    events = inputs.events(spark, folder)
    day, hour = F.date_format("timestamp", "yyyy-MM-dd-"), F.hour("timestamp")
    forms = (
        S.hour_stamp(F.col("timestamp")),
        F.concat(day, (10 + hour % 10).cast("string")),
        F.concat(day, F.lit("0"), (hour % 10).cast("string")),
        F.concat(F.date_format("timestamp", "yyyy/MM/dd-"), hour.cast("string")),
        F.concat(day, (24 + hour).cast("string")),
        F.concat(F.date_format("timestamp", "yyyy"), F.lit("-02-30-"), hour.cast("string")),
        F.concat(F.lit("1999"), F.date_format("timestamp", "-MM-dd-"), hour.cast("string")),
        F.concat(F.lit("at "), day, hour.cast("string")),
    )
    stamped = events.select("event_seq", F.get(F.array(*forms), (F.col("event_seq") % 8).cast("int")).alias("stamp"))
    return stamped.withColumn("valid", S.hour_time(F.col("stamp")).isNotNull())


@register(
    "hour_requests",
    sql.query(f"SELECT DISTINCT {_HOUR} AS hour FROM ev WHERE NOT ({sql.HUMAN})"),
)
def hour_requests(spark, folder):
    """A list of requested hours, each twice, padded and unpadded, among words that are none."""
    asked = [row["hour"] for row in inputs.bot_hours(spark, folder).collect()]
    return ingest.hour_list(spark, [*asked, *(h + ":00" for h in asked), *reversed(asked), "soon", ""])


# --- cases and days ----------------------------------------------------------

_COHORT = registry._COHORT
_SPLIT_ROWS = 20


def _split_flow(spark, folder) -> DataFrame:
    """The flow table with every case of 20 events and more laid out in range partitions."""
    log = materialize(registry._cohort_log(spark, folder))
    return L.flow_table(L.successors(log, hot_rows=_SPLIT_ROWS))


@register(
    "dfg_split_cases",
    sql.query("SELECT grp AS archetype, source, target, frequency, round(mean_seconds, 3) AS mean_seconds FROM dfg", **_COHORT),
)
def dfg_split_cases(spark, folder):
    follows = L.directly_follows(_split_flow(spark, folder))
    return rounded(follows.select("archetype", "source", "target", "frequency", "mean_seconds"), 3)


@register("two_loop_split_cases", sql.query("SELECT grp AS archetype, source, target, two_loop FROM loops", **_COHORT))
def two_loop_split_cases(spark, folder):
    return _split_flow(spark, folder).where("two_loop > 0").select("archetype", "source", "target", "two_loop")


def _with_days(events: DataFrame) -> DataFrame:
    return events.withColumns(S.day_columns(F.col("timestamp")))


@cache
def _states(spark: SparkSession, folder: str) -> str:
    """Daily states of all events, stored by day."""
    events = _with_days(inputs.events(spark, folder))
    home = scratch_dir(spark, "states")
    for name, state in (("sums", daily.day_sums(events)), ("actors", daily.day_actors(events))):
        dataset.overwrite_partitions(state, f"{home}/{name}", ("day",))
    return home


@register("repo_metrics_from_days", registry._METRICS_SQL)
def repo_metrics_from_days(spark, folder):
    home = _states(spark, folder)
    sums, actors = (spark.read.parquet(f"{home}/{name}") for name in ("sums", "actors"))
    found = daily.repo_metrics_from_days(sums, actors, inputs.END)
    return rounded(found.select(registry._METRIC_COLUMNS))


@register("repo_metrics_sketched")
def repo_metrics_sketched(spark, folder):
    """Collaborators estimated from the merged sketches of the days."""
    sums = spark.read.parquet(f"{_states(spark, folder)}/sums")
    return rounded(daily.repo_metrics_from_days(sums, None, inputs.END).select(registry._METRIC_COLUMNS))


@register("repo_metrics_filtered", registry._METRICS_SQL)
def repo_metrics_filtered(spark, folder):
    """Events of repositories that were not created in the window are dropped while scanning."""
    events = inputs.events(spark, folder)
    born = membership.may_contain(M.creation_lookup(M.creation_events(events)), "repo_id")
    found = M.repo_metrics_of_born(events.where(born(F.col("repo_id"))), inputs.END)
    return rounded(found.select(registry._METRIC_COLUMNS))


_DAILY_SQL = (
    "SELECT strftime(timestamp, '%Y-%m-%d') AS day, repo_id, count(*) AS events, "
    "sum(CASE WHEN value > 0 THEN value ELSE 0 END) AS weight FROM ev GROUP BY ALL"
)


@register(
    "thresholds_from_days",
    sql.query(
        " UNION ALL ".join(
            f"SELECT '{m}' AS metric, "
            + ", ".join(
                f"round(coalesce(quantile_cont({m}, {q}) FILTER (WHERE {m} > 0), 0), 6) AS {quantiles.quantile_key(q).lower()}"
                for q in inputs.QUARTILES
            )
            + f" FROM ({_DAILY_SQL})"
            for m in ("events", "weight")
        )
    ),
)
def thresholds_from_days(spark, folder):
    """Quantiles of per-day measures of repositories, from stored days and a merged histogram."""
    measured = materialize(
        inputs.events(spark, folder, "value")
        .groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "repo_id")
        .agg(F.count("*").alias("events"), F.sum(F.when(F.col("value") > 0, F.col("value")).otherwise(0.0)).alias("weight"))
    )
    home = scratch_dir(spark, "values")
    names = ("events", "weight")
    values.add_days(measured, home, names)
    found = values.thresholds(spark, home, None, inputs.QUARTILES, names)
    return registry._threshold_rows(found, inputs.QUARTILES)


# --- ingest ------------------------------------------------------------------


def _new_store(spark: SparkSession) -> Store:
    return registry._new_store(spark)


@register("ingest_late_file", registry._DISTILLED_SQL)
def ingest_late_file(spark, folder):
    """Every hour gets a second file after it was ingested; no hour is forced."""
    landing, store = scratch_dir(spark, "landing"), _new_store(spark)
    for part in (0, 1):
        inputs.land_archive(spark, folder, f"{landing}/{part}", part)
        ingest.ingest_hours(spark, landing, store, registry._all_hours(spark, landing))
    return registry._distilled(spark.read.parquet(store.hourly))


@register("stream_ingest_split_hours", registry._DISTILLED_SQL)
def stream_ingest_split_hours(spark, folder):
    """The files of an hour land in two runs of the stream."""
    landing, store = scratch_dir(spark, "landing"), _new_store(spark)
    for part in (0, 1):
        inputs.land_archive(spark, folder, f"{landing}/{part}", part)
        stream_ingest(spark, landing, store, f"{store.root}/progress").awaitTermination()
    return registry._distilled(spark.read.parquet(store.hourly))


@cache
def _with_defects(spark: SparkSession, folder: str) -> tuple[Store, DataFrame]:
    landing, store = scratch_dir(spark, "landing"), _new_store(spark)
    inputs.land_with_defects(spark, folder, landing)
    return store, materialize(ingest.ingest_hours(spark, landing, store, registry._all_hours(spark, landing)))


_CUT = f"hour IN (SELECT DISTINCT {_HOUR} AS h FROM ev ORDER BY h LIMIT 3)"


@register(
    "ingest_defects",
    sql.query(
        f"SELECT hour, CASE WHEN {_CUT} THEN 'FAILED_OTHER' ELSE 'SUCCESS' END AS outcome, "
        + ", ".join(f"CASE WHEN {_CUT} THEN 0 ELSE {c} END AS {c}" for c in ("total", "distilled", "bad", "malformed"))
        + f", CASE WHEN {_CUT} THEN 'truncated gzip' END AS cause FROM (SELECT {_HOUR} AS hour, "
        "count(*) FILTER (WHERE event_seq % 7 <> 0) AS total, "
        "count(*) FILTER (WHERE event_seq % 7 <> 0 AND value >= 2) AS distilled, "
        "count(*) FILTER (WHERE event_seq % 7 <> 0 AND value < 2) AS bad, "
        "count(*) FILTER (WHERE event_seq % 7 = 0) AS malformed FROM ev GROUP BY 1)"
    ),
)
def ingest_defects(spark, folder):
    """An archive with broken lines, and three files that end too early."""
    outcome = _with_defects(spark, folder)[1]
    return outcome.withColumn("cause", F.regexp_extract("cause", "^[a-z ]+(?= after )", 0))


@register(
    "malformed_lines",
    sql.query(
        f"SELECT hour, n FROM (SELECT {_HOUR} AS hour, count(*) FILTER (WHERE event_seq % 7 = 0) AS n FROM ev GROUP BY 1) "
        f"WHERE n > 0 AND NOT {_CUT}"
    ),
)
def malformed_lines(spark, folder):
    """Broken lines as they are kept, each with its place, of the hours that could be read."""
    found = ingest.read_defects(spark, _with_defects(spark, folder)[0])
    lines = found.where("cause = 'malformed line'")
    broken = found.where("line is null").select("path").distinct()
    return lines.join(broken, "path", "left_anti").groupBy("hour").agg(F.count_distinct("path", "line").alias("n"))


@register(
    "validate_store",
    sql.query(
        "SELECT CAST(timestamp AS DATE) AS day, count(DISTINCT date_trunc('hour', timestamp)) AS processed, "
        "0 AS not_found, count(*) FILTER (WHERE value >= 2) AS ledger_rows, "
        "CASE WHEN count(DISTINCT date_trunc('hour', timestamp)) = 24 THEN count(*) FILTER (WHERE value >= 2) ELSE 0 END "
        "AS consolidated_rows, "
        "CASE WHEN count(DISTINCT date_trunc('hour', timestamp)) = 24 THEN 0 ELSE count(*) FILTER (WHERE value >= 2) END "
        "AS waiting_rows, "
        "count(DISTINCT date_trunc('hour', timestamp)) = 24 AS complete, true AS matches FROM ev GROUP BY 1"
    ),
)
def validate_store(spark, folder):
    """Footers of the stored files against the ledger, after complete days were consolidated."""
    return validate.validate_store(spark, _consolidated(spark, folder))


@cache
def _consolidated(spark: SparkSession, folder: str) -> Store:
    landing, store = registry._landed(spark, folder), _new_store(spark)
    ingest.ingest_hours(spark, landing, store, registry._all_hours(spark, landing))
    ingest.consolidate_days(spark, store)
    return store


@register(
    "compacted_days",
    sql.query(f"SELECT event_seq, repo_id, activity, {_HOUR} AS hour FROM ev WHERE value >= 2"),
)
def compacted_days(spark, folder):
    """Days rewritten in place; a reader that began before that must see the same rows."""
    store = _new_store(spark)
    registry.ingest_every_hour(spark, registry._landed(spark, folder), store)
    before = dataset.read_events(spark, store.events)
    ingest.compact_days(spark, store, "2000-01-01", "2100-01-01")
    columns = ["event_seq", "repo_id", "activity", "hour"]
    after = dataset.read_events(spark, store.events).select(columns)
    return after.intersect(before.select(columns))


@register("ledger_compacted", registry._LEDGER_SQL)
def ledger_compacted(spark, folder):
    """The ledger of many small batches, rewritten in place while it is read, and cleared of old folders."""
    store, source = _new_store(spark), ledger.read_manifest(spark, registry._ingested(spark, folder))
    for k in range(3):
        ledger.append(source.where(F.pmod(F.xxhash64("hour"), F.lit(3)) == k), store)
    ledger.compact(spark, store)
    ledger.vacuum(spark, store, keep=1)
    return ledger.read(spark, store).drop("updated_at")


@register(
    "ledger_documents",
    sql.query(
        f"SELECT {_HOUR} AS hour, CAST(timestamp AS DATE) AS day, 'processed' AS status, "
        "count(*) AS total, count(*) FILTER (WHERE value >= 2) AS distilled, count(*) FILTER (WHERE value < 2) AS bad "
        "FROM ev GROUP BY ALL"
    ),
)
def ledger_documents(spark, folder):
    """The ledger as one document a day, written and read back."""
    home = scratch_dir(spark, "documents")
    documents = ledger.as_documents(ledger.read(spark, registry._ingested(spark, folder)))
    rows = documents.select("day", F.to_json(F.struct("hours_processed", "hours_not_found")).alias("text"))
    for row in rows.collect():  # one small document a day
        inputs.land_bytes(spark, f"{home}/{row['day']:%Y/%m/%d}/index.json", row["text"].encode())
    return ledger.read_documents(spark, home)


@register(
    "range_totals",
    sql.query(
        "SELECT count(*) AS total, count(*) FILTER (WHERE value >= 2) AS distilled, "
        "count(*) FILTER (WHERE value < 2) AS bad FROM ev "
        "WHERE timestamp >= TIMESTAMP '2024-01-05 06:00:00' AND timestamp < TIMESTAMP '2024-01-09 18:00:00'"
    ),
)
def range_totals(spark, folder):
    return ingest.range_totals(spark, registry._ingested(spark, folder), "2024-01-05-6", "2024-01-09-17")


@register(
    "ingest_range_outcomes",
    sql.query(
        "SELECT strftime(r.moment, '%Y-%m-%d-') || extract(hour FROM r.moment) AS hour, "
        "CASE WHEN e.total IS NULL THEN 'FAILED_404' ELSE 'SUCCESS' END AS outcome, coalesce(e.total, 0) AS total, "
        "coalesce(e.distilled, 0) AS distilled, coalesce(e.bad, 0) AS bad "
        "FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-02 00:00:00', TIMESTAMP '2024-01-03 23:00:00', "
        "INTERVAL 1 HOUR)) AS moment) r LEFT JOIN (SELECT date_trunc('hour', timestamp) AS moment, count(*) AS total, "
        "count(*) FILTER (WHERE value >= 2) AS distilled, count(*) FILTER (WHERE value < 2) AS bad FROM ev GROUP BY 1) e "
        "USING (moment)"
    ),
)
def ingest_range_outcomes(spark, folder):
    """The job over a range of hours, some of which may have no file."""
    landing, store = registry._landed(spark, folder), _new_store(spark)
    outcome = ingest.ingest_range(spark, landing, store, "2024-01-02-0", "2024-01-03-23")
    return outcome.select("hour", "outcome", "total", "distilled", "bad")


@register(
    "dataset_info",
    sql.query(
        "SELECT strftime(min(timestamp), '%Y-%m-%d-%H') AS min_hour, strftime(max(timestamp), '%Y-%m-%d-%H') AS max_hour, "
        "count(DISTINCT date_trunc('hour', timestamp)) AS found_hours, true AS has_size FROM ev"
    ),
)
def dataset_info(spark, folder):
    info = ingest.dataset_info(spark, registry._ingested(spark, folder))
    return info.select("min_hour", "max_hour", "found_hours", (F.col("size_mb") > 0).alias("has_size"))


# --- results written and read back -------------------------------------------


@register("metrics_rescan", registry._METRICS_SQL)
def metrics_rescan(spark, folder):
    path = f"{scratch_dir(spark, 'metrics')}/metrics.parquet"
    tables.write_table(registry._metrics(spark, folder), path)
    return rounded(spark.read.parquet(path).select(registry._METRIC_COLUMNS))


@register(
    "stored_report",
    sql.query(
        "SELECT strato_id, count(*) AS num_repo, "
        "round(count(*) * 100.0 / (SELECT count(*) FROM strata), 2) AS perc_tot FROM strata GROUP BY strato_id"
    ),
)
def stored_report(spark, folder):
    """The distribution as a CSV report."""
    path = f"{scratch_dir(spark, 'report')}/distribution.csv"
    tables.write_report(strata.strata_distribution(registry._stratified(spark, folder)), path, [F.desc("num_repo"), "strato_id"])
    return spark.read.schema("strato_id string, num_repo long, perc_tot double").csv(path, header=True)


@register("stored_thresholds", registry._threshold_sql(inputs.QUARTILES))
def stored_thresholds(spark, folder):
    path = f"{scratch_dir(spark, 'thresholds')}/thresholds.json"
    measured = materialize(registry._metrics(spark, folder))
    tables.write_thresholds(quantiles.thresholds(measured, inputs.QUARTILES), path)
    return registry._threshold_rows(tables.read_thresholds(spark, path), inputs.QUARTILES)


@register("stored_matrices", registry.ORACLES["adjacency_wide"])
def stored_matrices(spark, folder):
    """One CSV matrix per group, read back."""
    _, nodes, edges = registry._model(spark, folder)
    path = scratch_dir(spark, "matrices")
    tables.write_matrices(K.wide_matrix(K.adjacency(K.models(nodes), edges, "frequency")), path)
    schema = "activity string, " + ", ".join(f"{a} double" for a in V.SKELETON) + ", archetype string"
    return spark.read.schema(schema).csv(path, header=True).select("archetype", "activity", *V.SKELETON)


@register("stored_event_log", registry.ORACLES["event_log"])
def stored_event_log(spark, folder):
    """The event log in buckets of cases, read back."""
    log = registry._archetype_log(spark, folder)
    path = scratch_dir(spark, "log")
    tables.write_log(log, path, 4, hot_rows=200)
    stored = tables.read_log(spark, path, log.schema, 4)
    return stored.select(log.columns).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@register("dfg_stored_log", registry.ORACLES["dfg_performance"])
def dfg_stored_log(spark, folder):
    """Directly-follows pairs from the stored log, which needs no shuffle of events."""
    log = registry._archetype_log(spark, folder)
    path = scratch_dir(spark, "log")
    tables.write_log(log, path, 4)
    follows = L.directly_follows(L.flow_table(L.successors(tables.read_log(spark, path, log.schema, 4))))
    return rounded(follows.select("archetype", "source", "target", "frequency", "mean_seconds"))


@register(
    "empty_windows",
    sql.query(
        "SELECT k, NOT EXISTS (SELECT 1 FROM ev WHERE CAST(timestamp AS DATE) = DATE '2023-12-30' + CAST(k * 4 AS INTEGER) "
        f"AND {sql.CREATION}) AS empty FROM (SELECT unnest(range(0, 10)) AS k)"
    ),
)
def empty_windows(spark, folder):
    """Whether a day has a creation at all, asked for ten days; each answer stops at the first row."""
    born = M.creation_events(inputs.events(spark, folder))
    found = []
    for k in range(10):
        day = F.date_add(F.lit("2023-12-30").cast("date"), 4 * k)
        found.append((k, born.where(F.to_date("timestamp") == day).isEmpty()))
    return spark.createDataFrame(found, "k long, empty boolean")


@register(
    "reported_periods",
    sql.query("SELECT first_day, last_day, days FROM periods ORDER BY days DESC, first_day LIMIT 5"),
)
def reported_periods(spark, folder):
    """The report of a table of hours; its longest periods."""
    report = validate.coverage_report(inputs.order_hours(spark, folder))
    return report.periods

