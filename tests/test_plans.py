"""The physical plans that make the operators scale."""

import re
from datetime import datetime

import pytest

from tracestrata.operators import eventlog, metrics, quantiles, strata
from tracestrata.sources import dataset


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)  # print pushed filters whole
    path = str(tmp_path_factory.mktemp("stored") / "events")
    frame = spark.range(2000).selectExpr(
        "id % 50 as repo_id", "concat('r', id % 50) as repo_name", "id % 3 as actor_id",
        "concat('u', id % 3) as actor_login",
        "if(id < 50, 'CreateEvent', 'PushEvent') as activity",
        "'x' as payload_type", "timestamp'2024-01-01' + make_interval(0,0,0,0,0,id) as timestamp",
        "cast(null as string) as action", "1d as push_size",
        "if(id < 50, 'repository', null) as create_ref_type",
        "cast(null as string) as delete_ref_type", "cast(null as string) as review_state",
        "cast(null as boolean) as pr_merged", "id as event_seq", "'2024-01-01-0' as hour",
        "2024 as anno", "1 as mese", "cast(1 + id % 3 as int) as giorno",
    )
    dataset.overwrite_partitions(frame, path, dataset.DAY)
    return lambda *window: dataset.read_events(spark, path, *window)


def test_creation_events_read_four_columns_and_push_the_filter(stored):
    plan = plan_of(metrics.creation_events(stored()))
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert {f.split(":")[0] for f in schema.split(",")} == {
        "repo_id", "activity", "timestamp", "create_ref_type",
    }
    assert "EqualTo(activity,CreateEvent)" in plan
    assert "EqualTo(create_ref_type,repository)" in plan


def test_day_window_prunes_partitions(stored):
    window = stored("2024-01-02T00:00:00Z", "2024-01-02T23:59:59Z")
    assert "make_date" in re.search(r"PartitionFilters: \[(.*?)\], Pushed", plan_of(window)).group(1)
    assert {r["giorno"] for r in window.select("giorno").distinct().collect()} == {2}


def test_metrics_scan_once_without_joins(stored):
    plan = plan_of(metrics.repo_metrics_of_born(stored(), "2024-02-01"))
    assert plan.count("FileScan") == 1
    assert "Join" not in plan
    assert "review_state" not in plan and "repo_name" not in plan


def test_metrics_join_after_aggregating(stored):
    events = stored()
    lookup = metrics.creation_lookup(metrics.creation_events(events))
    df = metrics.repo_metrics(events, lookup, "2024-02-01")
    plan = plan_of(df)
    assert plan.index("Join") < plan.index("HashAggregate")  # the join sits above


def test_classification_is_map_only(spark, stored):
    measured = metrics.repo_metrics_of_born(stored(), "2024-02-01")
    cuts = {m: {"a": 1.0, "b": 2.0, "c": 3.0} for m in quantiles.V.METRICS}
    before = plan_of(measured).count("Exchange")
    assert plan_of(strata.classify(measured, cuts)).count("Exchange") == before


def test_event_log_of_few_members_does_not_shuffle(spark, stored):
    members = spark.createDataFrame([(1, "x"), (2, "y")], "repo_id long, archetype string")
    plan = plan_of(eventlog.event_log(stored(), members))
    assert "BroadcastHashJoin" in plan
    assert "Exchange hashpartitioning" not in plan


def test_flow_needs_one_sort_and_two_shuffles(spark, stored):
    members = spark.createDataFrame([(1, "x"), (2, "y")], "repo_id long, archetype string")
    flow = eventlog.flow_table(eventlog.successors(eventlog.event_log(stored(), members)))
    plan = plan_of(flow)
    assert plan.count("Exchange hashpartitioning") == 2
    assert len(re.findall(r"(?<!\w)Sort \[", plan)) == 1


def test_quantiles_merge_map_side(spark, stored):
    measured = metrics.repo_metrics_of_born(stored(), "2024-02-01")
    plan = plan_of(quantiles.thresholds(measured))
    assert "partial_percentile" in plan and "partial_count" in plan
    assert "BroadcastHashJoin" in plan


def test_no_python_in_any_plan(spark, stored):
    flow = eventlog.flow_table(
        eventlog.successors(eventlog.event_log(stored().selectExpr("*", "'all' as archetype")))
    )
    assert "Python" not in plan_of(flow) and "Pandas" not in plan_of(flow)


def test_dates_are_utc(stored):
    first = stored().agg({"timestamp": "min"}).first()[0]
    assert first == datetime(2024, 1, 1)
