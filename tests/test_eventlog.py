from datetime import datetime, timedelta
import random

import pytest
from pyspark.sql import functions as F

from tracestrata import MinerSettings
from tracestrata.operators import eventlog as L
from tracestrata.operators import mining, skew

START = datetime(2024, 1, 1)
LOG = "archetype string, case_id string, activity string, timestamp timestamp, event_seq long"


def log_of(rows, traces, group="g", step=60):
    """Traces as strings: one letter is one event."""
    data, seq = [], 0
    for case, trace in enumerate(traces):
        for i, letter in enumerate(trace):
            data.append((group, f"c{case}", letter, START + timedelta(seconds=i * step), seq))
            seq += 1
    return rows(data, LOG)


def flow_of(rows, traces, **options):
    return L.flow_table(L.successors(log_of(rows, traces, **options)))


def pairs(flow, *columns):
    return {(r["source"], r["target"]): tuple(r[c] for c in columns) for r in flow.collect()}


def test_flow_counts(rows):
    flow = flow_of(rows, ["abab", "ab", "aa"])
    assert pairs(flow, "frequency", "mean_seconds", "two_loop") == {
        ("a", "b"): (3, 60.0, 1),
        ("b", "a"): (1, 60.0, 1),
        ("a", "a"): (1, 60.0, 0),
        ("b", None): (2, None, 0),
        ("a", None): (1, None, 0),
    }
    counts = {r["activity"]: r["occurrences"] for r in L.occurrences(flow).collect()}
    assert counts == {"a": 5, "b": 3}
    direct = L.activity_counts(log_of(rows, ["abab", "ab", "aa"])).collect()
    assert {r["activity"]: r["occurrences"] for r in direct} == counts


def test_median_performance(rows):
    flow = L.flow_table(L.successors(log_of(rows, ["ab", "ab"])), statistic="median")
    assert pairs(L.directly_follows(flow), "mean_seconds") == {("a", "b"): (60.0,)}


def test_starts_and_ends(rows):
    log = log_of(rows, ["abc", "ab", "b"])
    starts = {r["activity"]: r["cases"] for r in L.start_activities(log).collect()}
    ends = {r["activity"]: r["cases"] for r in L.end_activities(log).collect()}
    assert starts == {"a": 2, "b": 1}
    assert ends == {"c": 1, "b": 2}


def test_equal_times_are_ordered_by_sequence(rows):
    flow = flow_of(rows, ["abc"], step=0)
    assert set(pairs(L.directly_follows(flow), "frequency")) == {("a", "b"), ("b", "c")}


@pytest.mark.parametrize("step", [1, 1300, 4000, 90000])
def test_split_cases_give_the_same_neighbours(rows, step):
    """One case holds most rows; chunked processing must not show in the result."""
    rng = random.Random(step)
    traces = ["".join(rng.choices("abcd", k=300))]
    traces += ["".join(rng.choices("abcd", k=n)) for n in (1, 2, 3, 5, 8)]
    log = log_of(rows, traces, step=step)
    found = skew.hot_keys(log, ["archetype", "case_id"], 100)
    assert len(found) == 1

    def result(hot_rows):
        steps = L.successors(log, hot_rows=hot_rows)
        return sorted(
            (r["event_seq"], r["next"] and r["next"]["activity"], r["next2"] and r["next2"]["activity"])
            for r in steps.collect()
        )

    whole = result(10_000)
    assert len(whole) == sum(map(len, traces))
    assert result(100) == whole
    assert result(1) == whole


def test_split_join_equals_plain_join(rows, spark):
    data = [(1, i) for i in range(200)] + [(k, k) for k in range(2, 40)] + [(None, 7)]
    big = rows(data, "repo_id long, x long")
    table = rows([(k, a) for k in (1, 2, 3, 50) for a in ("p", "q")], "repo_id long, archetype string")
    plain = big.join(table, "repo_id").select("repo_id", "x", "archetype")
    for broadcast_rows, min_rows in ((100, 5), (4, 100), (1, 100), (1, 10_000)):
        got = skew.keyed_join(big, table, "repo_id", "inner", min_rows, broadcast_rows)
        got = got.select("repo_id", "x", "archetype")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    semi = skew.keyed_join(big, table, "repo_id", "left_semi", 100, 1)
    assert semi.count() == 202


def test_event_log_for_overlapping_groups(events, rows):
    df = events(
        {"repo_id": 1, "actor_id": 5, "actor_login": "u", "activity": "PushEvent", "timestamp": START},
        {"repo_id": 1, "actor_id": 6, "actor_login": "b[bot]", "activity": "PushEvent", "timestamp": START},
        {"repo_id": 1, "actor_id": 5, "activity": "WatchEvent", "action": "started", "timestamp": START},
        {"repo_id": 2, "actor_id": 5, "activity": "IssuesEvent", "action": "opened", "timestamp": START},
        {"repo_id": 1, "actor_id": 5, "activity": "PullRequestReviewEvent", "timestamp": START},
        {"repo_id": 3, "actor_id": 5, "activity": "PushEvent", "timestamp": START},
    )
    members = rows([(1, "x"), (1, "y"), (2, "x")], "repo_id long, archetype string")
    log = L.event_log(df, members)
    got = sorted((r["archetype"], r["case_id"], r["activity"], r["resource"]) for r in log.collect())
    assert got == [
        ("x", "5_1", "PushEvent", "u"),
        ("x", "5_2", "IssuesEvent_opened", None),
        ("y", "5_1", "PushEvent", "u"),
    ]


def test_dependency_formula(rows):
    flow = flow_of(rows, ["ab"] * 9 + ["ba"] + ["aa"] * 3)
    scores = pairs(mining.dependency_scores(flow), "dependency")
    assert scores[("a", "b")][0] == pytest.approx((9 - 1) / (9 + 1 + 1))
    assert scores[("b", "a")][0] == pytest.approx((1 - 9) / (9 + 1 + 1))
    assert scores[("a", "a")][0] == pytest.approx(3 / 4)


def net_of(flow, *settings):
    edges = mining.discover_net(flow, MinerSettings(*settings))
    return {(r["source"], r["target"]): r["kind"] for r in edges.collect()}


def test_thresholds_are_inclusive_and_activities_must_be_frequent(rows):
    flow = flow_of(rows, ["ab"] * 9 + ["cd"] * 4)
    assert net_of(flow, 0.9, 0.8, 0.7, 9, 9) == {("a", "b"): "dependency"}
    assert net_of(flow, 0.9001, 0.8, 0.7, 9, 9) == {}
    assert net_of(flow, 0.8, 0.8, 0.7, 1, 4) == {("a", "b"): "dependency", ("c", "d"): "dependency"}
    assert net_of(flow, 0.8, 0.8, 0.7, 5, 1) == {("a", "b"): "dependency"}


def test_filtered_activities_do_not_make_neighbours(rows):
    flow = flow_of(rows, ["axb"] * 10)
    assert net_of(flow, 0.5, 0.8, 0.7, 10, 1) == {("a", "x"): "dependency", ("x", "b"): "dependency"}
    rare = flow_of(rows, ["axb"] * 3 + ["a", "b"] * 10)
    assert net_of(rare, 0.5, 0.8, 0.7, 10, 1) == {}


def test_length_two_loops(rows):
    flow = flow_of(rows, ["abababab"] * 5)
    assert net_of(flow, 0.95, 0.8, 0.7, 1, 1) == {("a", "b"): "two_loop", ("b", "a"): "two_loop"}
    with_self = flow_of(rows, ["abababab"] * 5 + ["a" * 40])
    assert net_of(with_self, 0.95, 0.8, 0.7, 1, 1) == {("a", "a"): "self_loop"}


def test_groups_do_not_mix(rows):
    one = log_of(rows, ["ab"] * 10, group="one")
    two = log_of(rows, ["ba"] * 10, group="two")
    flow = L.flow_table(L.successors(one.unionByName(two)))
    edges = mining.discover_net(flow, MinerSettings(0.9, 0.8, 0.7, 1, 1))
    got = {(r["archetype"], r["source"], r["target"]) for r in edges.collect()}
    assert got == {("one", "a", "b"), ("two", "b", "a")}


def test_model_nodes_keep_activities_outside_the_net(rows):
    flow = flow_of(rows, ["ab"] * 10 + ["z"])
    edges = mining.discover_net(flow, MinerSettings(0.9, 0.8, 0.7, 5, 5))
    nodes = {r["activity"]: (r["occurrences"], r["in_net"]) for r in mining.model_nodes(flow, edges).collect()}
    assert nodes == {"a": (10, True), "b": (10, True), "z": (1, False)}


def test_concurrency(rows):
    flow = flow_of(rows, ["abc"] * 10 + ["acb"] * 10)
    settings = MinerSettings(0.8, 0.8, 0.7, 1, 1)
    edges = mining.discover_net(flow, settings)
    got = mining.concurrency(flow, edges, settings).where(F.col("source") == "a").collect()
    assert len(got) == 1
    assert (got[0]["first"], got[0]["second"]) == ("b", "c")
    assert got[0]["and_measure"] == pytest.approx(20 / 21)
    assert got[0]["concurrent"]


def test_logs_without_times(rows):
    log = log_of(rows, ["ab", "ab"]).drop("timestamp")
    steps = L.successors(log, order=["event_seq"], carried=["activity"], chunk=F.floor(F.col("event_seq") / 2), hot_rows=1)
    flow = L.flow_table(steps, time=None)
    assert pairs(L.directly_follows(flow), "frequency", "mean_seconds") == {("a", "b"): (2, None)}


def test_every_key_above_the_limit_is_found(spark):
    """However well the rows compress and however many the keys are."""
    rows = spark.range(3000 * 4).selectExpr("id % 3000 AS key")
    assert len(skew.hot_keys(rows, ["key"], 4)) == 3000 and skew.hot_keys(rows, ["key"], 5) == []


def test_cases_are_cut_anywhere(spark):
    """One case in one instant fills all partitions; cuts fall between any two of its events."""
    from tracestrata.operators import traces

    data = [("g", None if i % 7 == 0 else f"c{i % 2}" if i < 30 else "big", "abcd"[i % 4] if i % 5 else None, START, i) for i in range(200)]
    log = spark.createDataFrame(data, "archetype string, case_id string, activity string, timestamp timestamp, event_seq long")
    case, order, carried = ["archetype", "case_id"], ["timestamp", "event_seq"], ["activity", "event_seq"]

    def rows_of(df):
        return sorted((r["event_seq"], r["next"] and tuple(r["next"]), r["next2"] and tuple(r["next2"])) for r in df.collect())

    whole = rows_of(L.successors(log, case, order, carried))
    for size in (1, 3, 40):
        assert rows_of(traces.neighbours(log, case, order, carried, size)) == whole
    assert traces.neighbours(log.limit(0), case, order, carried, 5).count() == 0
    same = traces.neighbours(log, case, order, carried, 40)
    assert [f.name for f in same.schema] == [f.name for f in L.successors(log, case, order, carried).schema]


def test_halo_rows_skip_short_partitions():
    from tracestrata.operators import traces

    rows = [{"_part": p, "x": x} for p, x in ((0, 1), (0, 2), (2, 3), (5, 4), (5, 5))]
    halos = traces._halos(rows)
    assert {p: [r["x"] for r in after] for p, after in halos.items()} == {0: [3, 4], 2: [4, 5], 5: []}
