from pyspark.sql import functions as F

from tracestrata.functions import predicates as P
from tracestrata.functions import scalars as S
from tracestrata.functions import vocabulary as V


def truth(df, predicate):
    return [r["p"] for r in df.orderBy("event_seq").select(predicate.alias("p")).collect()]


def test_creation(events):
    df = events(
        {"activity": "CreateEvent", "create_ref_type": "repository"},
        {"activity": "CreateEvent", "create_ref_type": "branch"},
        {"activity": "CreateEvent"},
        {"activity": "PushEvent"},
    )
    assert truth(df, P.is_repo_creation()) == [True, False, None, False]


def test_bots_and_unknown_logins(events):
    df = events({"actor_login": "ci[bot]"}, {"actor_login": "bot"}, {})
    assert truth(df, P.is_bot()) == [True, False, False]
    assert truth(df, P.is_human()) == [False, True, True]


def test_popularity(events):
    df = events(
        {"activity": "WatchEvent", "action": "started"},
        {"activity": "WatchEvent"},
        {"activity": "ForkEvent"},
        {"activity": "ReleaseEvent", "action": "published"},
        {"activity": "ReleaseEvent", "action": "edited"},
    )
    assert truth(df, P.is_popularity()) == [True, None, True, True, False]


def test_engagement(events):
    df = events(
        {"activity": "IssuesEvent", "action": "opened"},
        {"activity": "IssuesEvent", "action": "reopened"},
        {"activity": "IssuesEvent", "action": "closed"},
        {"activity": "IssueCommentEvent", "action": "created"},
        {"activity": "IssueCommentEvent", "action": "deleted"},
    )
    assert truth(df, P.is_engagement()) == [True, True, False, True, False]


def test_collaboration(events):
    df = events(
        {"activity": "PullRequestEvent", "action": "synchronize"},
        {"activity": "PullRequestEvent", "action": "closed"},
        {"activity": "PullRequestReviewEvent", "action": "submitted"},
        {"activity": "PullRequestReviewCommentEvent", "action": "created"},
        {"activity": "CommitCommentEvent", "action": "created"},
    )
    assert truth(df, P.is_collaboration()) == [True, False, True, True, True]


def test_core_workflow(events):
    df = events(
        {"activity": "PushEvent"},
        {"activity": "CreateEvent", "create_ref_type": "branch"},
        {"activity": "CreateEvent", "create_ref_type": "tag"},
        {"activity": "DeleteEvent", "delete_ref_type": "branch"},
        {"activity": "IssuesEvent", "action": "closed"},
        {"activity": "IssuesEvent", "action": "labeled"},
        {"activity": "PullRequestReviewEvent"},
        {"activity": "ReleaseEvent", "action": "published"},
        {"activity": "WatchEvent", "action": "started"},
    )
    kept = [p is True for p in truth(df, P.is_core_workflow())]
    assert kept == [True, True, False, True, True, False, True, True, False]


def test_step_names(events):
    pr = {"activity": "PullRequestEvent", "action": "closed"}
    df = events(
        {**pr, "pr_merged": True},
        {**pr, "pr_merged": False},
        pr,
        {"activity": "PullRequestEvent", "action": "opened"},
        {"activity": "IssuesEvent", "action": "opened"},
        {"activity": "PullRequestReviewEvent", "action": "created", "review_state": "approved"},
        {"activity": "PullRequestReviewEvent", "action": "created"},
        {"activity": "CreateEvent", "create_ref_type": "branch"},
        {"activity": "DeleteEvent", "delete_ref_type": "tag"},
        {"activity": "PushEvent", "action": "x"},
        {},
    )
    assert truth(df, P.step_name(df.columns)) == [
        "PullRequestEvent_merged",
        "PullRequestEvent_rejected",
        "PullRequestEvent_closed",
        "PullRequestEvent_opened",
        "IssuesEvent_opened",
        "PullRequestReviewEvent_approved",
        None,
        "CreateEvent_branch",
        "DeleteEvent_tag",
        "PushEvent",
        None,
    ]
    named = [n is not None for n in truth(df, P.step_name(df.columns))]
    assert truth(df, P.has_step_name(df.columns)) == named


def test_step_names_of_a_reduced_schema(events):
    df = events(
        {"activity": "PullRequestEvent", "action": "closed", "pr_merged": True},
        {"activity": "PullRequestReviewEvent", "action": "created", "review_state": "approved"},
        {"activity": "CreateEvent", "create_ref_type": "branch"},
        {"activity": "DeleteEvent"},
    ).drop("pr_merged", "review_state", "create_ref_type", "delete_ref_type")
    assert truth(df, P.step_name(df.columns)) == [
        "PullRequestEvent_closed",
        "PullRequestReviewEvent_created",
        "CreateEvent_ref",
        "DeleteEvent_ref",
    ]


def test_archetypes_are_multi_label(rows):
    cats = "repo_id long, " + ", ".join(f"{d}_norm_cat string" for d in V.DIMENSIONS)
    df = rows(
        [
            (1, "Giant", "Giant", "Giant", "Giant"),
            (2, "Medium", "Medium", "Medium", "Medium"),
            (3, "High", "Medium", "Medium", "High"),
            # order: workload, collaboration, engagement, popularity
            (4, "Giant", "Low", "Zero", "Giant"),
            (5, "Giant", "Giant", "Giant", "Zero"),
            (6, "Low", "Low", "Low", "Low"),
        ],
        cats,
    )
    found = {r["repo_id"]: r["a"] for r in df.select("repo_id", P.archetypes_of().alias("a")).collect()}
    assert found == {
        1: ["Giant_All"],
        2: ["High_Perf_Balanced", "Mid_Standard"],
        3: ["High_Perf_Balanced"],
        4: ["Giant_Pop_LowCollab"],
        5: ["Giant_Collab_LowPop"],
        6: [],
    }


def test_required_fields(rows):
    schema = (
        "type string, created_at string, actor struct<id:string,login:string>, "
        "repo struct<id:string,name:string>"
    )
    df = rows(
        [
            ("PushEvent", "2024-01-01T10:00:00Z", ("1", "u"), ("2", "u/r")),
            ("PushEvent", "2024-01-01T10:00:00Z", ("1", None), None),
            ("PushEvent", None, ("1", "u"), ("2", "u/r")),
            (None, "2024-01-01T10:00:00Z", ("1", "u"), ("2", "u/r")),
            ("PushEvent", "2024-01-01T10:00:00Z", (None, "u"), ("2", "u/r")),
        ],
        schema,
    )
    assert [r["p"] for r in df.select(P.has_required_fields().alias("p")).collect()] == [
        True, False, False, False, False,
    ]


def test_hour_stamps(rows):
    stamps = {
        "2024-01-01-1": True,
        "2024-01-01-10": True,
        "2024-01-01-0": True,
        "2024-01-01-23": True,
        "2024-01-01-24": False,
        "2024-01-01-01": False,
        "2024-01-01-00": False,
        "2024/01/01": False,
        "bad-format": False,
        "2024-02-30-10": False,
        "1999-12-31-5": False,
        "2100-01-01-5": True,
        "2101-01-01-5": False,
    }
    df = rows([(s,) for s in stamps], "s string")
    valid = df.select("s", S.hour_time(F.col("s")).alias("t")).collect()
    assert {r["s"]: r["t"] is not None for r in valid} == stamps
    again = df.select("s", S.hour_stamp(S.hour_time(F.col("s"))).alias("again")).collect()
    assert all(r["again"] == r["s"] for r in again if stamps[r["s"]])


def test_whole_days_truncate_toward_zero(rows):
    df = rows(
        [
            ("2024-01-01 00:00:01", "2024-01-03 00:00:00"),
            ("2024-01-01 00:00:00", "2024-01-03 00:00:00"),
            ("2024-01-03 00:00:00", "2024-01-01 12:00:00"),
        ],
        "a string, b string",
    )
    age = S.whole_days(F.to_timestamp("a"), F.to_timestamp("b"))
    assert [r["d"] for r in df.select(age.alias("d")).collect()] == [1, 2, -1]


def test_payload_names(rows):
    df = rows([("IssuesEvent",), ("PushEvent",), ("NewEvent",), (None,)], "a string")
    names = [r["n"] for r in df.select(S.payload_name(F.col("a")).alias("n")).collect()]
    assert names == ["Issue", "Push", None, None]


def test_labels(rows):
    df = rows([("A", "B", 3600.0, 12), ("None", "None", -1.0, -1)], "a string, b string, s double, n long")
    got = df.select(
        S.edge_label(F.col("a"), F.col("b"), F.col("s")).alias("e"),
        S.activity_label(F.col("a"), F.col("n")).alias("l"),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("A->B (1.0h)", "A (12)"),
        ("None->None (-0.0h)", "None (-1)"),
    ]
