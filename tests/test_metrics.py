from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracestrata import CalculationError, ContractError
from tracestrata.functions import vocabulary as V
from tracestrata.operators import metrics as M
from tracestrata.operators import quantiles as Q
from tracestrata.operators import strata as T

END = "2024-01-11T00:00:00Z"


def ts(text):
    return datetime.fromisoformat(text)


def test_lookup_keeps_the_first_creation(rows):
    raw = rows(
        [(1, ts("2023-01-01")), (1, ts("2023-01-05")), (2, ts("2023-01-02")),
         (3, ts("2023-01-03")), (2, ts("2023-01-04"))],
        "repo_id long, timestamp timestamp_ntz",
    )
    lookup = M.creation_lookup(raw)
    assert set(lookup.columns) == {"repo_id", "repo_creation_date"}
    found = {
        r["repo_id"]: r["d"]
        for r in lookup.select("repo_id", F.date_format("repo_creation_date", "yyyy-MM-dd").alias("d")).collect()
    }
    assert found == {1: "2023-01-01", 2: "2023-01-02", 3: "2023-01-03"}
    assert M.creation_lookup(raw.where("false")).isEmpty()
    with pytest.raises(ContractError):
        M.creation_lookup(raw.drop("timestamp"))


@pytest.fixture
def core(events):
    def event(repo, activity, day, login, actor, size=0.0, **more):
        return {
            "repo_id": repo, "activity": activity, "timestamp": ts(f"2024-01-{day:02d}"),
            "actor_login": login, "actor_id": actor, "push_size": size, **more,
        }

    return events(
        event(10, "CreateEvent", 1, "user_a", 1),
        event(10, "PushEvent", 5, "user_a", 1, 10.0),
        event(10, "WatchEvent", 5, "user_b", 2),
        event(20, "PushEvent", 2, "user_c", 3, 5.0),
        event(20, "ForkEvent", 6, "user_c", 3),
        event(30, "PushEvent", 15, "user_d", 4, 15.0),
    )


def lookup_of(rows, **days):
    return rows(
        [(int(k[1:]), ts(v)) for k, v in days.items()],
        "repo_id long, repo_creation_date timestamp",
    )


def by_repo(df):
    return {r["repo_id"]: r for r in df.collect()}


def test_metrics(core, rows):
    lookup = lookup_of(rows, r10="2024-01-01", r20="2024-01-02", r30="2024-01-10")
    got = by_repo(M.repo_metrics(core, lookup, END))
    assert (got[10]["age_in_days"], got[10]["workload_cum"], got[10]["workload_norm"]) == (10, 10, 1.0)
    assert (got[30]["age_in_days"], got[30]["workload_cum"], got[30]["workload_norm"]) == (1, 15, 15.0)
    assert got[10]["external_popularity_cum"] == 0  # a watch without its action
    assert got[20]["external_popularity_cum"] == 1


def test_metrics_with_another_predicate(core, rows):
    lookup = lookup_of(rows, r10="2024-01-01", r20="2024-01-01", r30="2024-01-01")
    pushes = F.col("activity") == "PushEvent"
    got = by_repo(M.repo_metrics(core, lookup, "2024-01-31T00:00:00Z", collaboration=pushes))
    assert [got[r]["collaboration_intensity_cum"] for r in (10, 20, 30)] == [1, 1, 1]


def test_metrics_reject_bad_input(core, rows):
    lookup = lookup_of(rows, r10="2024-01-01")
    with pytest.raises(ContractError):
        M.repo_metrics(core, lookup, "yesterday")
    with pytest.raises(ContractError):
        M.repo_metrics(core.drop("actor_id"), lookup, END)
    with pytest.raises(ContractError):
        M.repo_metrics(core, lookup.drop("repo_creation_date"), END)


def test_edge_rows(events, rows):
    """Null logins and sizes, actors without id, bots, young and future repositories."""
    pr = {"activity": "PullRequestEvent", "action": "opened", "timestamp": ts("2024-01-02")}
    born = {"activity": "CreateEvent", "create_ref_type": "repository"}
    df = events(
        {"repo_id": 1, **born, "timestamp": ts("2024-01-01"), "actor_login": "x[bot]", "actor_id": 9},
        {"repo_id": 1, **pr, "actor_id": 1},
        {"repo_id": 1, **pr, "actor_id": 1, "actor_login": "a"},
        {"repo_id": 1, **pr},
        {"repo_id": 1, **pr, "actor_id": 7, "actor_login": "y[bot]"},
        {"repo_id": 1, "activity": "PushEvent", "actor_id": 1, "timestamp": ts("2024-01-03")},
        {"repo_id": 2, **born, "timestamp": ts("2024-01-10 12:00:00"), "actor_id": 1},
        {"repo_id": 3, **born, "timestamp": ts("2024-01-12"), "actor_id": 1},
        {"repo_id": 4, **born, "timestamp": ts("2024-01-01"), "actor_login": "x[bot]", "actor_id": 9},
        {"repo_id": 5, **pr, "actor_id": 1},
    )
    lookup = M.creation_lookup(M.creation_events(df))
    two_step = by_repo(M.repo_metrics(df, lookup, END))
    one_scan = by_repo(M.repo_metrics_of_born(df, END))
    assert set(two_step) == set(one_scan) == {1}
    assert two_step[1]["collaboration_intensity_cum"] == 2  # actor 1 and the nameless one
    assert two_step[1]["workload_cum"] == 0.0
    for name in (*V.METRICS, "age_in_days"):
        assert two_step[1][name] == one_scan[1][name]


@pytest.fixture
def measured(rows):
    columns = {
        "workload_cum": [10.0 * i for i in range(1, 11)],
        "collaboration_intensity_cum": [0, 0, 0, 0, 2, 3, 4, 5, 6, 7],
        "community_engagement_cum": [5] * 10,
        "external_popularity_cum": [0] * 9 + [10],
        "workload_norm": [float(i) for i in range(10)],
        "collaboration_intensity_norm": [0.0] * 10,
        "community_engagement_norm": [1.0] * 10,
        "external_popularity_norm": [0.0] * 10,
    }
    names = list(columns)
    data = [
        (i + 1, *(float(columns[n][i]) for n in names)) for i in range(10)
    ]
    return rows(data, "repo_id long, " + ", ".join(f"{n} double" for n in names))


def test_quantiles(measured):
    got = Q.threshold_values(Q.thresholds(measured))
    assert got["workload_cum"]["Q50"] == pytest.approx(55.0)
    assert got["workload_cum"]["Q90"] == pytest.approx(91.0)
    assert got["workload_cum"]["Q99"] == pytest.approx(99.1)
    assert got["collaboration_intensity_cum"]["Q50"] == pytest.approx(4.5)
    assert got["collaboration_intensity_norm"]["Q50"] == 0.0
    assert set(got) == set(V.METRICS)
    with pytest.raises(CalculationError):
        Q.threshold_values(Q.thresholds(measured.where("false")))
    with pytest.raises(ContractError):
        Q.thresholds(measured, method="guess")


@pytest.mark.parametrize("shape", ["uniform", "clustered", "ties", "wide", "one"])
def test_exact_quantiles_equal_brute_force(rows, shape):
    rng = np.random.default_rng(7)
    values = {
        "uniform": rng.uniform(0, 1000, 3000),
        "clustered": 1e6 + rng.uniform(0, 1, 3000),
        "ties": rng.integers(-2, 4, 3000).astype(float),
        "wide": np.exp(rng.uniform(-300, 300, 3000)),
        "one": np.array([3.5]),
    }[shape]
    df = rows([(float(v),) for v in values], "workload_cum double")
    qs = (0.01, 0.25, 0.5, 0.9, 0.99)
    got = Q.threshold_values(Q.thresholds(df, qs, ["workload_cum"]))["workload_cum"]
    expected = np.quantile(values[values > 0], qs)
    assert [got[Q.quantile_key(q)] for q in qs] == pytest.approx(list(expected), rel=1e-12)


def test_approximate_quantiles_are_values_near_the_rank(rows):
    df = rows([(float(i),) for i in range(1, 1001)], "workload_cum double")
    got = Q.threshold_values(Q.thresholds(df, names=["workload_cum"], method="approx"))
    assert got["workload_cum"] == {"Q50": 500.0, "Q90": 900.0, "Q99": 990.0}


def test_classification_from_table_and_from_values(measured):
    table = Q.thresholds(measured)
    lazy = {r["repo_id"]: r["strato_id"] for r in T.classify(measured, table).collect()}
    values = Q.threshold_values(table)
    eager = {r["repo_id"]: r["strato_id"] for r in T.classify(measured, values).collect()}
    assert lazy == eager
    # workload_cum, collaboration, engagement, popularity, then the four rates
    assert eager[1] == "Low|Zero|Low|Zero|Zero|Zero|Low|Zero"
    assert eager[10] == "Giant|Giant|Low|Low|Giant|Zero|Low|Zero"
    # 90 <= 91.0, 6 <= 6.5 and 8 <= 8.2: all below the 0.9 quantile
    assert eager[9] == "Medium|Medium|Low|Zero|Medium|Zero|Low|Zero"


def test_nan_and_null_fall_to_the_last_label(rows):
    df = rows(
        [(1, float("nan")), (2, None), (3, 0.0), (4, 1.0), (5, 2.5)], "repo_id long, m double"
    )
    cuts = {"m": {"Q100": 3.0, "Q9": 1.0, "Q50": 2.0}}
    got = {r["repo_id"]: r["m_cat"] for r in T.classify(df, cuts, names=["m"]).collect()}
    assert got == {1: "Giant", 2: "Giant", 3: "Zero", 4: "Low", 5: "High"}
    with pytest.raises(ContractError):
        T.classify(df, {"m": {"Q50": 1.0}}, names=["m"])
    with pytest.raises(ContractError):
        T.classify(df, {}, names=["m"])


def test_distribution(rows):
    df = rows([(i, "b" if i < 2 else "a" if i < 4 else "c") for i in range(7)], "repo_id long, strato_id string")
    got = [tuple(r) for r in T.strata_distribution(df).collect()]
    assert got == [("c", 3, 42.86), ("a", 2, 28.57), ("b", 2, 28.57)]
    assert T.strata_distribution(df.where("false")).isEmpty()
    with pytest.raises(ContractError):
        T.strata_distribution(df.drop("strato_id"))


@pytest.mark.parametrize("cuts", [{}, {"Q1": 1.0}])
def test_threshold_tables_are_checked(spark, cuts):
    from tracestrata.functions import vocabulary as V
    from tracestrata.operators import strata

    table = spark.createDataFrame([(m, cuts) for m in V.METRICS], "metric string, thresholds map<string,double>")
    measured = spark.createDataFrame([tuple(1.0 for _ in V.METRICS)], ", ".join(f"{m} double" for m in V.METRICS))
    for given in (table, table.limit(0)):
        with pytest.raises(Exception, match="thresholds"):
            strata.classify(measured, given).collect()
