"""Snapshots, file manifests, careful reading, and what is stored by day."""

import gzip
import os
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from test_ingest import land, outcomes, raw
from tracestrata import ConcurrentWriteError, Store
from tracestrata.functions import vocabulary as V
from tracestrata.operators import comparison, daily, membership, metrics, quantiles
from tracestrata.operators import eventlog as L
from tracestrata.plans import ingest, validate
from tracestrata.schemas import LEDGER
from tracestrata.sources import archive, dataset, ledger, snapshots, tables, values
from tracestrata.streaming.ingest import stream_ingest


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "landing"), Store(str(tmp_path / "store"))


def hourly_ids(spark, store):
    return sorted(r["event_seq"] for r in spark.read.parquet(store.hourly).collect())


# --- manifests ---------------------------------------------------------------

H = "2024-01-01-10"


def planned(spark, state, landed, force=False, content=False):
    files = "array<struct<path: string, length: long, checksum: string>>"
    state = spark.createDataFrame([(H, s, f) for s, f in state], f"hour string, status string, files {files}")
    landed = spark.createDataFrame([(H, *f) for f in landed], "hour string, path string, length long, checksum string")
    asked = spark.createDataFrame([(H,)], "hour string")
    row = ingest.plan_hours(asked, state, landed if content else landed.drop("checksum"), force).first()
    return row["outcome"], row["files"] and [f["path"] for f in row["files"]], row["cause"]


A, B, A2, A_SAME = ("a", 5, "x"), ("b", 5, "y"), ("a", 6, "z"), ("a", 5, "w")


@pytest.mark.parametrize(
    "state, landed, force, content, outcome, files",
    [
        ([], [A], False, False, None, ["a"]),
        ([], [], False, False, V.FAILED_404, None),
        ([("processed", [A])], [A], False, False, V.SKIPPED_PROCESSED, ["a"]),
        ([("processed", [A])], [A], True, False, None, ["a"]),
        ([("processed", [A])], [B, A], False, False, None, ["a", "b"]),
        ([("processed", [A])], [A2], False, False, None, ["a"]),
        ([("processed", [A])], [], False, False, V.SKIPPED_PROCESSED, None),
        ([("processed", None)], [A], False, False, V.SKIPPED_PROCESSED, ["a"]),
        ([("processed", [A])], [A_SAME], False, False, V.SKIPPED_PROCESSED, ["a"]),
        ([("processed", [A])], [A_SAME], False, True, None, ["a"]),
        ([("processed", [A])], [A], False, True, V.SKIPPED_PROCESSED, ["a"]),
        ([("not_found", [])], [], False, False, V.SKIPPED_404, None),
        ([("not_found", [])], [A], False, False, None, ["a"]),
        ([("not_found", [])], [], True, False, V.FAILED_404, None),
    ],
)
def test_hours_are_planned_by_their_files(spark, state, landed, force, content, outcome, files):
    got = planned(spark, state, landed, force, content)
    assert got[0] == outcome and got[2] is None and (outcome is not None or got[1] == files)


def test_files_that_have_gone_keep_their_hour_as_it_is(spark):
    outcome, _, cause = planned(spark, [("processed", [A])], [B])
    assert outcome == V.FAILED_OTHER and cause == "files have gone: a"
    assert planned(spark, [("processed", [A])], [B], force=True)[0] is None


def test_a_file_that_lands_while_its_hour_is_read(spark, place, monkeypatch):
    landing, store = place
    land(f"{landing}/a", H, [raw(1)])
    asked = ingest.hour_list(spark, [H])
    whole = ingest.write_hours

    def late(*args, **kwargs):
        land(f"{landing}/b", H, [raw(2)])
        old = datetime(2001, 1, 1).timestamp()
        os.utime(f"{landing}/b/{H}.json.gz", (old, old))
        return whole(*args, **kwargs)

    monkeypatch.setattr(ingest, "write_hours", late)
    ingest.ingest_hours(spark, landing, store, asked)
    assert hourly_ids(spark, store) == [1]
    monkeypatch.setattr(ingest, "write_hours", whole)
    assert outcomes(ingest.ingest_hours(spark, landing, store, asked))[H][0] == "SUCCESS"
    assert hourly_ids(spark, store) == [1, 2]
    assert outcomes(ingest.ingest_hours(spark, landing, store, asked))[H][0] == "SKIPPED_PROCESSED"
    manifest = ledger.read_manifest(spark, store).first()["files"]
    assert [os.path.basename(os.path.dirname(f["path"])) for f in manifest] == ["a", "b"]
    assert all(len(f["checksum"]) == 64 and f["length"] > 0 for f in manifest)


def test_replaced_content_of_the_same_length(spark, place):
    landing, store = place
    asked = ingest.hour_list(spark, [H])
    os.makedirs(landing)
    path = os.path.join(landing, f"{H}.json")
    import json

    for k in (1, 2):
        with open(path, "w") as out:
            out.write(json.dumps(raw(k)) + "\n")
        done = ingest.ingest_hours(spark, landing, store, asked, compare_contents=True)
        assert outcomes(done)[H][0] == "SUCCESS" and hourly_ids(spark, store) == [k]
    assert outcomes(ingest.ingest_hours(spark, landing, store, asked, compare_contents=True))[H][0] == "SKIPPED_PROCESSED"


# --- careful reading ---------------------------------------------------------


def test_defects_have_their_places(spark, place):
    landing, store = place
    good, bad = '{"type": "PushEvent"}', '{"type": "Push'
    land(landing, H, [good, bad, "", "é not json", good])
    land(landing, "2024-01-01-11", [raw(7, "2024-01-01-11")] * 400)
    cut = os.path.join(landing, "2024-01-01-11.json.gz")
    content = open(cut, "rb").read()
    with open(cut, "wb") as out:
        out.write(content[:-20])
    with open(os.path.join(landing, "2024-01-01-12.json.gz"), "wb") as out:
        out.write(b"\x1f\x8b no gzip at all")
    with open(os.path.join(landing, "2024-01-01-13.json.gz"), "wb") as out:
        out.write(gzip.compress(b'{"a": 1}\n') + gzip.compress(b"broken\n"))
    hours = ["2024-01-01-%d" % h for h in (10, 11, 12, 13)]
    done = ingest.ingest_hours(spark, landing, store, ingest.hour_list(spark, hours))
    got = {r["hour"]: (r["outcome"], r["total"], r["malformed"], r["cause"]) for r in done.collect()}
    assert got[H] == ("SUCCESS", 2, 2, None) and got["2024-01-01-13"] == ("SUCCESS", 1, 1, None)
    assert got["2024-01-01-11"][0] == got["2024-01-01-12"][0] == "FAILED_OTHER"
    assert re.match(r"truncated gzip after \d+ bytes: file:.*-11.json.gz$", got["2024-01-01-11"][3])
    assert re.match(r"broken gzip: .* after 0 bytes: file:.*-12.json.gz$", got["2024-01-01-12"][3])
    found = {}
    for r in ingest.read_defects(spark, store).collect():
        found.setdefault(r["hour"][11:], []).append((r["line"], r["offset"], r["cause"]))
    first = len(good) + 1
    assert sorted(found["10"]) == [(1, first, "malformed line"), (3, first + len(bad) + 2, "malformed line")]
    assert found["13"] == [(1, 9, "malformed line")]
    assert [c for _, _, c in found["12"]][0].startswith("broken gzip")
    # A clean file takes the place of the defects.
    land(landing, H, [raw(1)])
    ingest.ingest_hours(spark, landing, store, ingest.hour_list(spark, [H]), force=True)
    assert "10" not in {r["hour"][11:] for r in ingest.read_defects(spark, store).collect()}


def test_hours_are_parsed_once_for_each_file(spark, tmp_path):
    """No row of a file parses its path, whatever characters are in it."""
    home = str(tmp_path / "a b%20c+d")
    land(home, H, [raw(1), "broken"])
    land(f"{home}/2024-01-02-3", "part", [raw(2, "2024-01-02-3")])
    land(home, "2024-02-30-1", [raw(3)])
    land(home, "notes", [raw(4)])
    land(home, "2024-01-01-11", [])
    for given in (home, [f"{home}/{H}.json.gz"]):
        found = archive.flag_and_flatten(archive.scan_archive(spark, given))
        scanned = plan_of(found).split("BroadcastExchange")[0]
        assert "FileScan json" in scanned and "regexp" not in scanned and "gettimestamp" not in scanned
    found = archive.flag_and_flatten(archive.scan_archive(spark, home))
    got = sorted((r["hour"], r["anno"], r["mese"], r["giorno"], r["malformed"], r["event_seq"] if r["valid"] else None) for r in found.collect())
    assert got == [(H, 2024, 1, 1, False, 1), (H, 2024, 1, 1, True, None), ("2024-01-02-3", 2024, 1, 2, False, 2)]


def test_errors_while_writing_are_raised(spark, place, monkeypatch):
    from pyspark.errors import AnalysisException

    landing, store = place
    land(landing, H, [raw(1)])
    calls = []

    def full(*_):
        calls.append(1)
        raise AnalysisException("no space left")

    monkeypatch.setattr(dataset, "overwrite_partitions", full)
    with pytest.raises(AnalysisException, match="no space"):
        ingest.ingest_hours(spark, landing, store, ingest.hour_range(spark, "2024-01-01-8", "2024-01-01-12"))
    assert len(calls) == 1 and ledger.read(spark, store).where("status = 'processed'").isEmpty()


def test_a_broken_file_does_not_stop_the_stream(spark, place, tmp_path):
    landing, store = place
    land(landing, H, [raw(1)])
    os.makedirs(landing, exist_ok=True)
    with open(os.path.join(landing, "2024-01-01-11.json.gz"), "wb") as out:
        out.write(gzip.compress(b'{"a": 1}\n' * 5000)[:-9])
    progress = str(tmp_path / "progress")
    stream_ingest(spark, landing, store, progress).awaitTermination()
    land(landing, "2024-01-01-12", [raw(3, "2024-01-01-12")])
    stream_ingest(spark, landing, store, progress).awaitTermination()
    assert hourly_ids(spark, store) == [1, 3]
    assert [r["cause"] for r in ingest.read_defects(spark, store).where("line is null").collect()] == ["truncated gzip"]


def test_events_without_id_have_different_places(spark, place):
    landing, store = place
    for h in (1, 2, 3):
        land(landing, f"2024-01-01-{h}", [raw(k, f"2024-01-01-{h}", id=None) for k in range(3)])
    ingest.ingest_hours(spark, landing, store, ingest.hour_range(spark, "2024-01-01-1", "2024-01-01-3"))
    assert len(set(hourly_ids(spark, store))) == 9 and min(hourly_ids(spark, store)) >= 0


# --- snapshots ---------------------------------------------------------------


def records(spark, hours, at=datetime(2024, 1, 2)):
    rows = [(h, date(2024, 1, 1), "processed", n, n, 0, at) for h, n in hours]
    return spark.createDataFrame(rows, LEDGER).withColumn("files", F.lit(None).cast("array<struct<path:string,length:long,checksum:string>>"))


def state_of(df):
    return {r["hour"]: r["total"] for r in df.collect()}


def test_compaction_while_readers_go_on(spark, place):
    _, store = place
    for k in range(3):
        ledger.append(records(spark, [(f"2024-01-01-{k}", k), ("2024-01-01-9", 10 + k)], datetime(2024, 1, 9 - k)), store)
    expected = {"2024-01-01-0": 0, "2024-01-01-1": 1, "2024-01-01-2": 2, "2024-01-01-9": 12}  # by version, not by clock
    reader = ledger.read(spark, store)
    ledger.compact(spark, store)
    assert state_of(reader) == state_of(ledger.read(spark, store)) == expected
    assert ledger.read_records(spark, store).count() == 4
    assert len(ledger.vacuum(spark, store, keep=1)) == 3 and state_of(ledger.read(spark, store)) == expected
    ledger.append(records(spark, [("2024-01-01-9", 1)]), store)
    assert state_of(ledger.read(spark, store))["2024-01-01-9"] == 1


def test_a_crash_before_the_swap_changes_nothing(spark, place, monkeypatch):
    _, store = place
    ledger.append(records(spark, [("2024-01-01-0", 1)]), store)
    whole = snapshots.commit

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(snapshots, "commit", crash)
    for act in (lambda: ledger.compact(spark, store), lambda: ledger.append(records(spark, [("2024-01-01-0", 2)]), store)):
        with pytest.raises(RuntimeError):
            act()
    monkeypatch.setattr(snapshots, "commit", whole)
    assert state_of(ledger.read(spark, store)) == {"2024-01-01-0": 1}
    ledger.append(records(spark, [("2024-01-01-0", 3)]), store)
    assert state_of(ledger.read(spark, store)) == {"2024-01-01-0": 3}
    assert len(ledger.vacuum(spark, store, keep=1)) == 2  # what the crashes left


def test_two_writers(spark, place):
    _, store = place
    ledger.append(records(spark, [("2024-01-01-0", 1)]), store)
    seen = snapshots.current(spark, store.ledger)
    snapshots.commit(spark, store.ledger, seen, seen.folders)
    with pytest.raises(ConcurrentWriteError):
        snapshots.commit(spark, store.ledger, seen, [])
    assert snapshots.current(spark, store.ledger).version == 2


def test_many_batches_are_put_together(spark, place, monkeypatch):
    _, store = place
    monkeypatch.setattr(ledger, "COMPACT_AT", 3)
    for k in range(4):
        ledger.append(records(spark, [(f"2024-01-01-{k}", k)]), store)
    assert len(snapshots.current(spark, store.ledger).folders) == 2
    assert state_of(ledger.read(spark, store)) == {f"2024-01-01-{k}": k for k in range(4)}


def some_events(spark, n=240):
    return spark.range(n).selectExpr(
        "id % 20 as repo_id", "concat('r', id % 20) as repo_name", "id % 3 as actor_id", "concat('u', id % 3) as actor_login",
        "case when id < 10 then 'CreateEvent' when id % 3 = 0 then 'PullRequestEvent' else 'PushEvent' end as activity",
        "'x' as payload_type", "timestamp'2024-01-01' + make_interval(0,0,0,0,id) as timestamp",
        "if(id % 3 = 0, 'opened', null) as action", "1d as push_size", "if(id < 10, 'repository', null) as create_ref_type",
        "cast(null as string) as delete_ref_type", "cast(null as string) as review_state", "cast(null as boolean) as pr_merged",
        "id as event_seq", "'2024-01-01-0' as hour",
    ).selectExpr("*", "year(timestamp) as anno", "month(timestamp) as mese", "day(timestamp) as giorno")


def test_days_are_compacted_in_place(spark, place):
    _, store = place
    events = some_events(spark)
    older = events.where("giorno <= 2")
    dataset.overwrite_partitions(older, store.events, dataset.DAY)  # from before there were snapshots
    dataset.replace_days(events.where("giorno >= 2").repartition(5), store.events, [date(2024, 1, d) for d in range(2, 11)], None)
    ids = list(range(240))
    reader = dataset.read_events(spark, store.events)
    assert sorted(r["event_seq"] for r in reader.collect()) == ids
    days = ingest.compact_days(spark, store, "2024-01-01", "2024-01-03T00:00:00Z")
    assert days == ["2024-01-01", "2024-01-02", "2024-01-03"]
    for df in (reader, dataset.read_events(spark, store.events)):
        assert sorted(r["event_seq"] for r in df.collect()) == ids
    window = dataset.read_events(spark, store.events, "2024-01-02T00:00:00Z", "2024-01-03T00:00:00Z")
    assert sorted(r["event_seq"] for r in window.collect()) == list(range(24, 72))
    assert len(window.inputFiles()) <= 2 * 4 and all("giorno=2" in f or "giorno=3" in f for f in window.inputFiles())
    dataset.vacuum(spark, store.events, keep=1)
    assert sorted(r["event_seq"] for r in dataset.read_events(spark, store.events).collect()) == ids


def test_a_crash_while_days_are_replaced(spark, place, monkeypatch):
    _, store = place
    events = some_events(spark, 48)
    dataset.replace_days(events, store.events, [date(2024, 1, 1), date(2024, 1, 2)], None)

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(snapshots, "commit", crash)
        with pytest.raises(RuntimeError):
            ingest.compact_days(spark, store, "2024-01-01", "2024-01-02")
    assert dataset.read_events(spark, store.events).count() == 48
    assert len(dataset.vacuum(spark, store.events)) == 2
    assert dataset.read_events(spark, store.events).count() == 48


def test_validation_reads_footers_only(spark, place, tmp_path):
    landing, store = place
    for h in range(24):
        land(landing, f"2024-01-01-{h}", [raw(h, f"2024-01-01-{h}"), raw(100 + h, f"2024-01-01-{h}", repo=None)])
    land(landing, "2024-01-02-3", [raw(50, "2024-01-02-3")])
    ingest.ingest_range(spark, landing, store, "2024-01-01-0", "2024-01-02-4")
    plan = plan_of(validate.stored_rows(spark, store))
    assert re.findall(r"ReadSchema: struct<(.*?)>", plan) == ["", ""]
    got = [tuple(r) for r in validate.run_validation(spark, store, str(tmp_path / "report")).orderBy("day").collect()]
    assert got == [
        (date(2024, 1, 1), 24, 0, 24, 24, 0, True, True),
        (date(2024, 1, 2), 1, 4, 1, 0, 1, False, True),
    ]
    assert sorted(os.listdir(tmp_path / "report")) == sorted(
        ["store_days.csv", *(f"coverage_{n}.csv" for n in ("span", "incomplete", "missing", "periods", "recommended"))]
    )
    # Rows that were lost show.
    dataset.drop_hours(spark, store.hourly, [(2024, 1, 2, "2024-01-02-3")])
    assert [r["matches"] for r in validate.validate_store(spark, store).orderBy("day").collect()] == [True, False]
    assert tuple(ingest.range_totals(spark, store, "2024-01-01-5", "2024-01-01-6").first()) == (4, 2, 2)


# --- days and filters --------------------------------------------------------


def test_states_of_days_merge_over_any_window(spark):
    events = some_events(spark)
    sums, actors = daily.day_sums(events), daily.day_actors(events)
    for first, last in ((None, None), (date(2024, 1, 1), date(2024, 1, 4)), (date(2024, 1, 2), None)):
        own = events
        if first:
            own = own.where(F.to_date("timestamp") >= F.lit(first))
        if last:
            own = own.where(F.to_date("timestamp") <= F.lit(last))
        whole = metrics.repo_metrics_of_born(own, "2024-02-01")
        for people in (actors, None):  # so few that the sketch is exact
            got = daily.repo_metrics_from_days(sums, people, "2024-02-01", first, last).select(whole.columns)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_the_sketch_is_as_good_as_it_says(spark):
    events = spark.range(30_000).selectExpr(
        "0L as repo_id", "id as actor_id", "'u' as actor_login", "'PullRequestEvent' as activity", "'opened' as action",
        "0d as push_size", "timestamp'2024-01-01' + make_interval(0,0,0,id % 5) as timestamp", "'x' as create_ref_type",
        "2024 as anno", "1 as mese", "cast(1 + id % 5 as int) as giorno",
    )
    born = events.limit(1).withColumns({"activity": F.lit("CreateEvent"), "create_ref_type": F.lit("repository")})
    sums = daily.day_sums(events.unionByName(born))
    estimate = daily.repo_metrics_from_days(sums, None, "2024-02-01").first()["collaboration_intensity_cum"]
    assert abs(estimate / 30_000 - 1) < 4 * 1.04 / 2 ** (daily.SKETCH_BITS / 2)


def test_the_filter_drops_rows_before_the_shuffle(spark, tmp_path):
    rows = spark.range(50_000).selectExpr("id % 5000 as repo_id", "id as x")
    keys = spark.range(0, 5000, 50).withColumnRenamed("id", "repo_id")
    passes = membership.may_contain(keys, "repo_id")
    kept = rows.where(passes(F.col("repo_id")))
    found = kept.groupBy("repo_id").agg(F.count("*").alias("n"))
    got = {r["repo_id"]: r["n"] for r in found.collect()}
    assert {k: n for k, n in got.items() if k % 50 == 0} == dict.fromkeys(range(0, 5000, 50), 10)
    assert len(got) < 100 + 0.05 * 4900  # few others pass
    plan = plan_of(found)
    assert plan.rindex("Filter") > plan.rindex("Exchange")  # in the stage of the scan
    none = membership.may_contain(keys.where("repo_id < 0"), "repo_id")
    assert rows.where(none(F.col("repo_id"))).isEmpty()
    strings = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    assert sorted(r["k"] for r in strings.where(membership.may_contain(strings, "k")(F.col("k"))).collect()) == ["a", "b"]


def test_thresholds_read_the_needed_bins_only(spark, tmp_path):
    names = ("m", "n")
    frame = spark.range(4000).selectExpr(
        "concat('2024-01-0', 1 + id % 4) as day", "cast(id % 700 as double) * 1.5 as m", "if(id % 9 = 0, exp(id / 500), 0) as n"
    )
    home = str(tmp_path / "values")
    values.add_days(frame, home, names)
    values.add_days(frame.where("day = '2024-01-02'"), home, names)  # a day is replaced, not added

    def of(df):
        return {r["metric"]: r["thresholds"] for r in df.collect()}

    wanted = (0.1, 0.5, 0.9, 0.99)
    for days in (None, ["2024-01-01", "2024-01-03"]):
        own = frame if days is None else frame.where(F.col("day").isin(*days))
        exact = of(quantiles.thresholds(own, wanted, names))
        stored = of(values.thresholds(spark, home, days, wanted, names))
        assert stored.keys() == exact.keys()
        for m in names:
            assert stored[m] == pytest.approx(exact[m], rel=1e-12)
    needed = values.needed_bins(spark, home, ["2024-01-01"], (0.5,)).collect()
    assert len(needed) <= 4
    read = values.stored_values(spark, home, needed, ["2024-01-01"])
    assert "day#" in plan_of(read) and re.search(r"PushedFilters: \[.*bin", plan_of(read))
    assert read.count() < 60
    assert of(values.thresholds(spark, home, ["2024-01-01"], (0.5,), ("m", "none")))["none"] == {"Q50": 0.0}


def test_bucketed_logs_need_no_shuffle(spark, tmp_path):
    data = [(f"g{i % 2}", f"c{i % 7}" if i < 200 else "big", "abcd"[i % 4], datetime(2024, 1, 1) + timedelta(hours=i), f"u{i}", i) for i in range(400)]
    log = spark.createDataFrame(data, "archetype string, case_id string, activity string, timestamp timestamp, resource string, event_seq long")
    path = str(tmp_path / "log")
    tables.write_log(log, path, 3, hot_rows=100)
    stored = tables.read_log(spark, path, log.schema, 3)
    assert sorted(map(tuple, stored.select(log.columns).collect())) == sorted(data)
    steps = L.successors(stored)
    assert "Exchange" not in plan_of(steps) and "Window" in plan_of(steps)
    keep = ["archetype", "case_id", "event_seq", "next", "next2"]
    assert sorted(map(str, steps.select(keep).collect())) == sorted(map(str, L.successors(log).select(keep).collect()))


def test_distances_need_few_shuffles(spark):
    nodes = spark.createDataFrame([(g, a, 5, True) for g in "xyz" for a in V.SKELETON[:4]], "archetype string, activity string, occurrences long, in_net boolean")
    edges = spark.createDataFrame(
        [(g, V.SKELETON[i], V.SKELETON[i + 1], 3 + i, float(i), 0.9, "dependency") for g, n in (("x", 3), ("y", 2)) for i in range(n)],
        "archetype string, source string, target string, frequency long, mean_seconds double, dependency double, kind string",
    )
    pairs = spark.createDataFrame([("x", "y"), ("y", "z"), ("x", "w"), ("w", "v")], "group_a string, group_b string")
    moved = comparison.manhattan_tvd(edges, comparison.models(nodes), pairs)
    assert plan_of(moved).count("Exchange") <= 4
    assert {(r["group_a"], r["group_b"]) for r in moved.collect()} == {("x", "y"), ("y", "z")}
    alike = comparison.similarity(nodes, edges, pairs)
    assert plan_of(alike).count("Exchange") <= 8
    got = {(r["group_a"], r["group_b"]): r for r in alike.collect()}
    assert got["x", "y"]["jaccard_nodes"] == 1.0 and got["x", "y"]["jaccard_edges"] == pytest.approx(2 / 3)
    assert got["x", "w"]["jaccard_nodes"] == 0.0 and got["x", "w"]["frobenius_frequency"] == 0.0
    assert got["w", "v"]["jaccard_edges"] == 1.0
    # The operators cell by cell say the same.
    for metric in comparison.ABSENT:
        matrix = comparison.cells(edges, metric)
        if metric == "performance":
            matrix = comparison.adjacency(comparison.models(nodes), edges, metric)
        for r in comparison.frobenius(matrix, comparison.models(nodes), pairs).collect():
            assert got[r["group_a"], r["group_b"]][f"frobenius_{metric}"] == pytest.approx(r["distance"], abs=1e-9)
        known = comparison.modelled_pairs(pairs, comparison.models(nodes))
        delta = comparison.delta_matrix(comparison.cells(edges, metric), known, metric)
        plain = {(r[0], r[1]): r[2] for r in delta.groupBy("group_a", "group_b").agg(F.sum(F.abs("delta"))).collect()}
        for r in moved.where(F.col("metric") == metric.capitalize()).collect():
            assert r["manhattan"] == pytest.approx(plain.get((r["group_a"], r["group_b"]), 0.0), abs=1e-9)
