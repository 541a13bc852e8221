import gzip
import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracestrata import ContractError, MissingDataError, DataPreparationError, Store
from tracestrata.plans import ingest
from tracestrata.plans.validate import coverage_report
from tracestrata.sources import dataset, ledger
from tracestrata.streaming.ingest import stream_ingest


def raw(event_id, hour="2024-01-01-10", kind="PushEvent", **more):
    return {
        "id": str(event_id), "type": kind, "created_at": f"{hour[:10]}T{int(hour[11:]):02d}:00:00Z",
        "actor": {"id": 1, "login": "u"}, "repo": {"id": 2, "name": "u/r"},
        "payload": {"size": 3}, **more,
    }


def land(folder, hour, lines):
    os.makedirs(folder, exist_ok=True)
    with gzip.open(os.path.join(folder, f"{hour}.json.gz"), "wt") as out:
        for line in lines:
            out.write((line if isinstance(line, str) else json.dumps(line)) + "\n")


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "landing"), Store(str(tmp_path / "store"))


def outcomes(df):
    return {r["hour"]: (r["outcome"], r["total"], r["distilled"], r["bad"]) for r in df.collect()}


def hourly(spark, store):
    return spark.read.parquet(store.hourly).withColumn("hour", F.col("hour").cast("string"))


def test_distilled_fields(spark, place):
    landing, store = place
    merged = {"action": "closed", "pull_request": {"merged": True}}
    land(landing, "2024-01-01-10", [
        raw(1),
        raw(2, kind="PullRequestEvent", payload=merged),
        raw(3, kind="CreateEvent", payload={"ref_type": "branch"}),
        raw(4, kind="DeleteEvent", payload={"ref_type": "tag"}),
        raw(5, kind="PullRequestReviewEvent", payload={"action": "created", "review": {"state": "approved"}}),
        raw(6, kind="FutureEvent", payload={"size": "odd", "action": {"nested": 1}}),
    ])
    ingest.ingest_hours(spark, landing, store, ingest.hour_list(spark, ["2024-01-01-10"]))
    got = {r["event_seq"]: r for r in hourly(spark, store).collect()}
    assert len(got) == 6
    push = got[1]
    assert (push["activity"], push["payload_type"], push["push_size"]) == ("PushEvent", "Push", 3.0)
    assert (push["repo_id"], push["repo_name"], push["actor_id"], push["actor_login"]) == (2, "u/r", 1, "u")
    assert push["timestamp"] == datetime(2024, 1, 1, 10)
    assert (push["anno"], push["mese"], push["giorno"], push["hour"]) == (2024, 1, 1, "2024-01-01-10")
    assert got[2]["pr_merged"] is True and got[2]["push_size"] is None
    assert (got[3]["create_ref_type"], got[3]["delete_ref_type"]) == ("branch", None)
    assert (got[4]["create_ref_type"], got[4]["delete_ref_type"]) == (None, "tag")
    assert got[5]["review_state"] == "approved"
    assert got[6]["payload_type"] is None and got[6]["push_size"] is None


def test_counters_and_malformed_lines(spark, place):
    landing, store = place
    land(landing, "2024-01-01-10", [
        raw(1), '{"type": "PushEvent", "actor": {', "not json", "",
        raw(2, repo=None), raw(3, actor={"login": "x"}), raw(4, created_at=None),
    ])
    done = ingest.ingest_hours(spark, landing, store, ingest.hour_list(spark, ["2024-01-01-10"]))
    assert outcomes(done) == {"2024-01-01-10": ("SUCCESS", 4, 1, 3)}
    assert tuple(ledger.totals(ledger.read(spark, store)).first()) == (4, 1, 3)


def test_skip_force_and_not_found(spark, place):
    landing, store = place
    land(landing, "2024-01-01-0", [raw(1, "2024-01-01-0"), raw(2, "2024-01-01-0")])
    hours = ingest.hour_range(spark, "2024-01-01-0", "2024-01-01-1")
    first = outcomes(ingest.ingest_hours(spark, landing, store, hours))
    assert first == {"2024-01-01-0": ("SUCCESS", 2, 2, 0), "2024-01-01-1": ("FAILED_404", 0, 0, 0)}
    again = outcomes(ingest.ingest_hours(spark, landing, store, hours))
    assert {h: o[0] for h, o in again.items()} == {
        "2024-01-01-0": "SKIPPED_PROCESSED", "2024-01-01-1": "SKIPPED_404",
    }
    land(landing, "2024-01-01-1", [raw(3, "2024-01-01-1")])
    forced = outcomes(ingest.ingest_hours(spark, landing, store, hours, force=True))
    assert {h: o[0] for h, o in forced.items()} == {"2024-01-01-0": "SUCCESS", "2024-01-01-1": "SUCCESS"}
    assert sorted(r["event_seq"] for r in hourly(spark, store).collect()) == [1, 2, 3]
    state = {r["hour"]: r["status"] for r in ledger.read(spark, store).collect()}
    assert state == {"2024-01-01-0": "processed", "2024-01-01-1": "processed"}


def test_forced_hour_that_became_empty_leaves_no_old_rows(spark, place):
    landing, store = place
    hours = ingest.hour_list(spark, ["2024-01-01-4", "2024-01-01-5"])
    land(landing, "2024-01-01-4", [raw(1, "2024-01-01-4")])
    land(landing, "2024-01-01-5", [raw(2, "2024-01-01-5")])
    ingest.ingest_hours(spark, landing, store, hours)
    land(landing, "2024-01-01-5", ["broken"])
    forced = outcomes(ingest.ingest_hours(spark, landing, store, hours, force=True))
    assert forced["2024-01-01-5"] == ("SUCCESS", 0, 0, 0)
    assert [r["event_seq"] for r in hourly(spark, store).collect()] == [1]


def test_corrupt_file_fails_alone_and_is_retried(spark, place):
    landing, store = place
    for h in range(4):
        land(landing, f"2024-01-01-{h}", [raw(h, f"2024-01-01-{h}")])
    path = os.path.join(landing, "2024-01-01-2.json.gz")
    whole = open(path, "rb").read()
    with open(path, "wb") as out:
        out.write(whole[: len(whole) // 2])
    hours = ingest.hour_range(spark, "2024-01-01-0", "2024-01-01-3")
    got = {h: o[0] for h, o in outcomes(ingest.ingest_hours(spark, landing, store, hours)).items()}
    assert got == {
        "2024-01-01-0": "SUCCESS", "2024-01-01-1": "SUCCESS",
        "2024-01-01-2": "FAILED_OTHER", "2024-01-01-3": "SUCCESS",
    }
    assert ledger.read(spark, store).count() == 3
    with open(path, "wb") as out:
        out.write(whole)
    again = {h: o[0] for h, o in outcomes(ingest.ingest_hours(spark, landing, store, hours)).items()}
    assert again["2024-01-01-2"] == "SUCCESS" and again["2024-01-01-0"] == "SKIPPED_PROCESSED"
    assert sorted(r["event_seq"] for r in hourly(spark, store).collect()) == [0, 1, 2, 3]


def test_requests(spark):
    hours = ingest.hour_list(spark, ["2024-01-01-5", "bad", "2024-01-01-05", "2024-01-01-10", "2024-01-01-5"])
    assert sorted(r["hour"] for r in hours.collect()) == ["2024-01-01-10", "2024-01-01-5"]
    span = ingest.hour_range(spark, "2024-01-01-22", "2024-01-02-1")
    assert [r["hour"] for r in span.collect()] == [
        "2024-01-01-22", "2024-01-01-23", "2024-01-02-0", "2024-01-02-1",
    ]
    for start, end in (("2024-01-01-5", "2024-01-01-5"), ("2024-01-02-0", "2024-01-01-0"), ("x", "2024-01-01-0")):
        with pytest.raises(ContractError):
            ingest.hour_range(spark, start, end)


def full_day(landing, day, missing=()):
    for h in range(24):
        if h not in missing:
            land(landing, f"{day}-{h}", [raw(h, f"{day}-{h}")])


def test_consolidation_and_late_hours(spark, place):
    landing, store = place
    full_day(landing, "2024-01-01", missing=(7,))
    full_day(landing, "2024-01-02", missing=range(20, 24))
    ingest.ingest_hours(spark, landing, store, ingest.hour_range(spark, "2024-01-01-0", "2024-01-02-19"))
    assert ingest.consolidate_days(spark, store) == ["2024-01-01"]
    assert ingest.consolidate_days(spark, store) == []
    events = dataset.read_events(spark, store.events)
    assert sorted(r["event_seq"] for r in events.collect()) == [h for h in range(24) if h != 7]
    assert not os.path.exists(f"{store.hourly}/anno=2024/mese=1/giorno=1/hour=2024-01-01-3")
    assert {r["giorno"] for r in hourly(spark, store).select("giorno").distinct().collect()} == {2}

    land(landing, "2024-01-01-7", [raw(700, "2024-01-01-7")])
    late = ingest.hour_range(spark, "2024-01-01-6", "2024-01-01-7")
    ingest.ingest_hours(spark, landing, store, late, force=True)
    assert ingest.consolidate_days(spark, store) == ["2024-01-01"]
    found = sorted(r["event_seq"] for r in dataset.read_events(spark, store.events).collect())
    assert found == [h for h in range(24) if h != 7] + [700]


def test_range_job_and_info(spark, place):
    landing, store = place
    empty = ingest.dataset_info(spark, store).first()
    assert empty["size_mb"] == 0.0 and empty["min_hour"] is None
    full_day(landing, "2024-01-01")
    ingest.ingest_range(spark, landing, store, "2024-01-01-0", "2024-01-01-23")
    info = ingest.dataset_info(spark, store).first()
    files = [os.path.join(r, f) for r, _, fs in os.walk(store.root) for f in fs if not f.startswith((".", "_"))]
    assert info["size_mb"] == pytest.approx(sum(map(os.path.getsize, files)) / 2**20)
    assert (info["min_hour"], info["max_hour"]) == ("2024-01-01-00", "2024-01-01-23")
    assert (info["found_hours"], info["possible_hours"], info["found_pct"]) == (24, 24, 100.0)


def test_day_window(spark, place):
    landing, store = place
    for day in ("2024-01-01", "2024-01-02", "2024-01-04"):
        full_day(landing, day)
    ingest.ingest_range(spark, landing, store, "2024-01-01-0", "2024-01-04-23")
    window = dataset.read_events(spark, store.events, "2024-01-02T00:00:00Z", "2024-01-03T23:59:59Z")
    assert {r["giorno"] for r in window.select("giorno").distinct().collect()} == {2}
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "make_date" in plan
    assert window.select("case_id").first()["case_id"] == "u/r"
    with pytest.raises(MissingDataError):
        dataset.read_events(spark, store.root + "/nowhere")


def test_foreign_dataset_layout(spark, tmp_path):
    """Zero-padded folders, fewer columns, no sequence: the file order counts."""
    schema = "activity string, timestamp timestamp, actor_id long, repo_id long, push_size long"
    at = datetime(2023, 1, 1, 10)
    for day in ("01", "02"):
        data = [(k, at, 10, 101, 5) for k in ("CreateEvent", "PushEvent")]
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(
            str(tmp_path / "anno=2023" / "mese=01" / f"giorno={day}")
        )
    events = dataset.read_events(spark, str(tmp_path), "2023-01-01", "2023-01-03")
    got = events.orderBy("giorno", "event_seq").collect()
    assert [(r["giorno"], r["activity"]) for r in got] == [
        (1, "CreateEvent"), (1, "PushEvent"), (2, "CreateEvent"), (2, "PushEvent"),
    ]
    assert len({r["event_seq"] for r in got}) == 4  # row numbers repeat from file to file
    assert dict(events.dtypes)["push_size"] == "double"
    bare = tmp_path / "bare"
    spark.range(1).selectExpr("id as repo_id", "1 as anno", "1 as mese", "1 as giorno").write.parquet(str(bare))
    with pytest.raises(DataPreparationError):
        dataset.read_events(spark, str(bare))


def test_stream_equals_batch_and_is_incremental(spark, place, tmp_path):
    landing, store = place
    progress = str(tmp_path / "progress")

    def run():
        stream_ingest(spark, landing, store, progress).awaitTermination()
        return sorted(r["event_seq"] for r in hourly(spark, store).collect())

    land(landing, "2024-01-01-0", [raw(1, "2024-01-01-0"), raw(2, "2024-01-01-0", repo=None)])
    assert run() == [1]
    assert run() == [1]
    land(landing, "2024-01-01-1", [raw(3, "2024-01-01-1")])
    assert run() == [1, 3]
    batch_store = Store(str(tmp_path / "batch"))
    ingest.ingest_hours(spark, landing, batch_store, ingest.hour_range(spark, "2024-01-01-0", "2024-01-01-1"))
    columns = [c for c in hourly(spark, store).columns]
    same = hourly(spark, store).select(columns).exceptAll(hourly(spark, batch_store).select(columns))
    assert same.isEmpty()
    keep = ["hour", "status", "total", "distilled", "bad"]
    assert sorted(map(tuple, ledger.read(spark, store).select(keep).collect())) == sorted(
        map(tuple, ledger.read(spark, batch_store).select(keep).collect())
    )


def test_ledger_documents(spark, tmp_path):
    folder = tmp_path / "2024" / "01" / "02"
    os.makedirs(folder)
    document = {
        "hours_processed": {"2024-01-02-3": {"total": 5, "distilled": 4, "bad": 1}},
        "hours_not_found": ["2024-01-02-4"],
        "daily_counts": {},
    }
    (folder / "index.json").write_text(json.dumps(document, indent=4))
    other = tmp_path / "2024" / "01" / "03"
    os.makedirs(other)
    (other / "index.json").write_text("{broken")
    got = {r["hour"]: (r["status"], r["total"], str(r["day"])) for r in ledger.read_documents(spark, str(tmp_path)).collect()}
    assert got == {
        "2024-01-02-3": ("processed", 5, "2024-01-02"),
        "2024-01-02-4": ("not_found", 0, "2024-01-02"),
    }
    back = ledger.as_documents(ledger.read_documents(spark, str(tmp_path))).first()
    assert back["hours_not_found"] == ["2024-01-02-4"]
    assert back["hours_processed"]["2024-01-02-3"].asDict() == {"total": 5, "distilled": 4, "bad": 1}


def test_ledger_compaction_keeps_the_state(spark, place, tmp_path):
    landing, store = place
    land(landing, "2024-01-01-0", [raw(1, "2024-01-01-0")])
    hours = ingest.hour_range(spark, "2024-01-01-0", "2024-01-01-1")
    ingest.ingest_hours(spark, landing, store, hours)
    ingest.ingest_hours(spark, landing, store, hours, force=True)
    compact = Store(str(tmp_path / "compact"))
    ledger.compact(spark, store, compact)
    assert ledger.read_records(spark, store).count() == 4
    assert ledger.read_records(spark, compact).count() == 2


def test_merge_counts(rows):
    got = ledger.merge_counts(rows([("a", 1), ("b", 2)], "key string, n long"), rows([("b", 3)], "key string, n long"))
    assert {r["key"]: r["n"] for r in got.collect()} == {"a": 1, "b": 5}


def test_coverage_report(rows):
    stamps = [f"2024-01-{d:02d}-{h}" for d in (1, 2, 5, 6, 9) for h in range(24)]
    stamps += [f"2024-01-11-{h}" for h in range(3)] + ["2024-01-01-0", "junk"]
    report = coverage_report(rows([(s,) for s in stamps], "hour string"))
    span = report.span.first()
    assert (span["total_days"], span["days_found"], span["days_missing"], span["days_incomplete"]) == (11, 6, 5, 1)
    assert [(str(r["day"]), r["hours"]) for r in report.incomplete.collect()] == [("2024-01-11", 3)]
    assert [r["day"].day for r in report.missing.collect()] == [3, 4, 7, 8, 10]
    assert [(r["first_day"].day, r["last_day"].day, r["days"]) for r in report.periods.collect()] == [
        (1, 2, 2), (5, 6, 2), (9, 9, 1), (11, 11, 1),
    ]
    window = report.recommended.first()
    assert (window["start_date"], window["end_date"]) == ("2024-01-01T00:00:00Z", "2024-01-02T23:59:59Z")
    with pytest.raises(MissingDataError):
        coverage_report(rows([], "hour string"))


def test_hour_in_path(rows, spark):
    paths = {
        "/a/2024-01-01-5.json.gz": "2024-01-01-5",
        "s3://b/2024-01-01-15.json": "2024-01-01-15",
        "/a/hour=2024-01-01-5/part-0.json.gz": "2024-01-01-5",
        "/a/readme.txt": "",
    }
    from tracestrata.functions import scalars as S

    df = rows([(p,) for p in paths], "p string").select("p", S.hour_of_path(F.col("p")).alias("h"))
    assert {r["p"]: r["h"] for r in df.collect()} == paths


def test_files_of_an_hour_in_any_batches(spark, place, tmp_path):
    """Two files per hour, one file per batch, and a file without a stamp."""
    landing, store = place
    hours = ["2024-01-01-0", "2024-01-01-1"]
    for i, part in enumerate("ab"):
        for hour in hours:
            land(f"{landing}/{part}", hour, [raw(100 * i + 10 * int(hour[-1]) + k, hour) for k in range(3)])
    land(landing, "notes", [raw(999)])
    land(landing, "2024-01-01-2", [])
    stream_ingest(spark, landing, store, str(tmp_path / "progress"), 1).awaitTermination()
    assert hourly(spark, store).groupBy("hour").count().collect() and hourly(spark, store).count() == 12
    state = {r["hour"]: r["total"] for r in ledger.read(spark, store).collect()}
    assert state == dict.fromkeys(hours, 6)


def test_a_late_file_is_planned_again(spark, place):
    landing, store = place
    asked = ingest.hour_list(spark, ["2024-01-01-10"])
    land(f"{landing}/a", "2024-01-01-10", [raw(1)])
    ingest.ingest_hours(spark, landing, store, asked)
    assert outcomes(ingest.ingest_hours(spark, landing, store, asked))["2024-01-01-10"][0] == "SKIPPED_PROCESSED"
    land(f"{landing}/b", "2024-01-01-10", [raw(2), raw(3)])
    late = datetime.now().timestamp() + 60
    os.utime(f"{landing}/b/2024-01-01-10.json.gz", (late, late))
    assert outcomes(ingest.ingest_hours(spark, landing, store, asked))["2024-01-01-10"] == ("SUCCESS", 3, 3, 0)
    assert hourly(spark, store).count() == 3


def test_records_of_one_instant(spark):
    at = datetime(2024, 1, 1)
    rows = [("2024-01-01-1", at.date(), status, n, n, 0, at) for status, n in (("processed", 5), ("not_found", 0), ("processed", 8))]
    for given in (rows, rows[::-1]):
        state = ledger.current(spark.createDataFrame(given, ledger.LEDGER)).collect()
        assert [(r["status"], r["total"]) for r in state] == [("processed", 8)]
