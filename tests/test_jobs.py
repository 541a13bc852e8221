import csv
import glob
import json
import random
from datetime import datetime, timedelta

import pytest

from tracestrata import AnalysisSettings, ContractError, MinerSettings, MissingDataError
from tracestrata.functions import vocabulary as V
from tracestrata.plans import analysis
from tracestrata.sources import dataset, tables

START = datetime(2023, 1, 1)


@pytest.fixture
def study(events, tmp_path):
    """300 repositories with random activity, stored as a day-partitioned dataset."""
    rng = random.Random(3)
    kinds = [
        {"activity": "PushEvent", "push_size": 2.0},
        {"activity": "WatchEvent", "action": "started"},
        {"activity": "IssuesEvent", "action": "opened"},
        {"activity": "PullRequestEvent", "action": "opened"},
        {"activity": "PullRequestEvent", "action": "closed", "pr_merged": True},
    ]
    given = []
    for repo in range(300):
        given.append({
            "repo_id": repo, "activity": "CreateEvent", "create_ref_type": "repository",
            "timestamp": START + timedelta(hours=rng.randrange(24)), "actor_id": 1, "actor_login": "u1",
        })
        for _ in range(rng.randrange(1, 25)):
            actor = rng.randrange(3)
            given.append({
                "repo_id": repo, "timestamp": START + timedelta(hours=24 + rng.randrange(200)),
                "actor_id": actor, "actor_login": f"u{actor}", **rng.choice(kinds),
            })
    path = str(tmp_path / "events")
    frame = events(*given).selectExpr(
        "*", "year(timestamp) as anno", "month(timestamp) as mese", "day(timestamp) as giorno"
    )
    dataset.overwrite_partitions(frame, path, dataset.DAY)
    return AnalysisSettings(
        path, str(tmp_path / "out"), "2023-01-01T00:00:00Z", "2023-01-31T23:59:59Z",
        quantiles=(0.25, 0.5, 0.75), miner=MinerSettings(0.1, 0.1, 0.5, 2, 2),
    )


def read_csv(path):
    lines = []
    for name in sorted(glob.glob(f"{path}/*.csv")):
        with open(name) as source:
            lines += list(csv.DictReader(source))
    return lines


def test_the_three_jobs(spark, study):
    distribution = analysis.run_stratification(spark, study)
    assert sum(r["num_repo"] for r in distribution.collect()) == 300
    assert len(read_csv(study.path(analysis.REPOSITORIES))) == 300
    assert spark.read.parquet(study.path(analysis.METRICS)).count() == 300
    with open(glob.glob(study.path(analysis.THRESHOLDS) + "/*.json")[0]) as source:
        thresholds = {r["metric"]: r["thresholds"] for r in map(json.loads, source)}
    assert list(thresholds) == sorted(V.METRICS)
    assert all(set(t) == {"Q25", "Q50", "Q75"} for t in thresholds.values())
    report = read_csv(study.path(analysis.DISTRIBUTION))
    counts = [int(r["num_repo"]) for r in report]
    assert counts == sorted(counts, reverse=True) and sum(counts) == 300

    analysis.run_discovery(spark, study)
    log = spark.read.parquet(study.path(analysis.EVENT_LOG))
    assert {"archetype", "case_id", "activity", "timestamp", "resource"} <= set(log.columns)
    names = {r["archetype"] for r in log.select("archetype").distinct().collect()}
    assert names and names <= set(V.ARCHETYPE_NAMES)
    nodes, edges = tables.read_model(spark, study.output)
    assert sum(r["occurrences"] for r in nodes.collect()) == log.count()
    assert not edges.isEmpty()
    assert "mean_seconds" not in tables.read_model(spark, study.output, kind="frequency")[1].columns
    assert all(t.isEmpty() for t in tables.read_model(spark, study.output, "No_Such"))
    with pytest.raises(ContractError):
        tables.read_model(spark, study.output, kind="cost")

    profile = analysis.run_comparison(spark, study)
    assert {r["archetype"] for r in profile.collect()} == names
    identikit = read_csv(study.path(analysis.IDENTIKIT))
    assert list(identikit[0]) == [
        "Archetype", "Num_Nodes", "Num_Edges", "Density", "Cyclomatic_Complexity",
        "Avg_Degree", "Most_Freq_Activity", "Slowest_Edge",
    ]
    assert len(read_csv(study.path(analysis.SIMILARITY))) == 25
    distances = read_csv(study.path(analysis.DISTANCES))
    assert len(distances) == len(names) * (len(names) - 1)
    for row in distances:
        assert float(row["TVD"]) == pytest.approx(float(row["Manhattan_Dist"]) / 2)
    matrices = glob.glob(study.path("adjacency_frequency") + "/archetype=*/*.csv")
    assert len(matrices) == len(names)
    assert len(read_csv(matrices[0].rsplit("/", 1)[0])) == 19


def test_discovery_with_split_repositories_gives_the_same_model(spark, study, tmp_path):
    analysis.run_stratification(spark, study)
    analysis.run_discovery(spark, study)
    whole = {tuple(r) for r in tables.read_model(spark, study.output)[1].collect()}
    from dataclasses import replace

    split = replace(study, hot_rows=3)
    analysis.run_discovery(spark, split)
    assert {tuple(r) for r in tables.read_model(spark, split.output)[1].collect()} == whole


def test_windows_without_creations_are_an_error(spark, study):
    from dataclasses import replace

    late = replace(study, start="2023-01-05T00:00:00Z")
    with pytest.raises(MissingDataError):
        analysis.run_stratification(spark, late)
    with pytest.raises(MissingDataError):
        analysis.run_discovery(spark, replace(study, output=study.output + "-none"))


def test_single_event_study(spark, events, tmp_path):
    frame = events(
        {"repo_id": 1, "activity": "CreateEvent", "create_ref_type": "repository",
         "timestamp": START, "actor_id": 1, "actor_login": "user_a"},
        {"repo_id": 1, "activity": "PushEvent", "push_size": 10.0, "actor_id": 1,
         "actor_login": "user_a", "timestamp": datetime(2023, 1, 15)},
    ).selectExpr("*", "year(timestamp) as anno", "month(timestamp) as mese", "day(timestamp) as giorno")
    dataset.overwrite_partitions(frame, str(tmp_path / "e"), dataset.DAY)
    settings = AnalysisSettings(str(tmp_path / "e"), str(tmp_path / "o"), "2023-01-01", "2023-01-31T00:00:00Z")
    got = [tuple(r) for r in analysis.run_stratification(spark, settings).collect()]
    assert got == [("Low|Zero|Zero|Zero|Low|Zero|Zero|Zero", 1, 100.0)]
