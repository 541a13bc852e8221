"""The test tables seen as canonical events and as event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracestrata import ensure_utc
from tracestrata.functions import predicates as P
from tracestrata.functions import scalars as S
from tracestrata.functions import vocabulary as V

END = "2024-02-01T00:00:00Z"
QUARTILES = (0.25, 0.5, 0.75)
COHORTS = 5

_ACTIVITY = {
    "signup": "CreateEvent",
    "click": "PushEvent",
    "view": "WatchEvent",
    "error": "IssuesEvent",
    "purchase": "PullRequestEvent",
}
_ISSUE_ACTIONS = ("opened", "reopened", "closed")
_REQUEST_ACTIONS = ("opened", "reopened", "closed", "synchronize")


def _choose(value: Column, names: dict) -> Column:
    chosen = F
    for key, name in names.items():
        chosen = chosen.when(value == key, name)
    return chosen


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """Canonical events made from the `events` table, row by row.

    `extra` names columns of the table to keep beside the canonical ones.
    """
    ensure_utc(spark)
    k, kind = F.col("k"), F.col("event_type")
    action = (
        F.when(kind == "view", "started")
        .when(kind == "error", _choose(k % 3, dict(enumerate(_ISSUE_ACTIONS))))
        .when(kind == "purchase", _choose(k % 4, dict(enumerate(_REQUEST_ACTIONS))))
    )
    # Generated, not projected: a filter on a projected column is rewritten to
    # repeat the column's definition, JSON parsing included, at every mention.
    parsed = F.get_json_object("props", "$.k").cast("long").alias("k")
    derived = F.struct(_choose(kind, _ACTIVITY).alias("activity"), action.alias("action"))
    raw = (
        table(spark, folder, "events")
        .select("*", F.inline(F.array(F.struct(parsed))))
        .select("*", F.inline(F.array(derived)))
    )
    return raw.select(
        (F.col("user_id") * 4 + F.col("event_id") % 4).alias("repo_id"),
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("repo_name"),
        (k % 3).alias("actor_id"),
        F.when(k % 20 == 0, "ci[bot]")
        .otherwise(F.concat(F.lit("u"), (k % 3).cast("string")))
        .alias("actor_login"),
        "activity",
        S.payload_name(F.col("activity")).alias("payload_type"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        "action",
        F.when(kind == "click", F.col("value")).alias("push_size"),
        F.when(kind == "signup", F.when(k % 2 == 0, "repository").otherwise("branch")).alias(
            "create_ref_type"
        ),
        F.lit(None).cast("string").alias("delete_ref_type"),
        F.lit(None).cast("string").alias("review_state"),
        F.when((kind == "purchase") & (k % 4 == 2), k % 8 == 2).alias("pr_merged"),
        F.col("event_id").alias("event_seq"),
        F.concat(F.lit("cohort"), (F.col("user_id") % COHORTS).cast("string")).alias("cohort"),
        *extra,
    )


def bot_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Hours with automated activity: a ledger of hours with natural gaps."""
    active = events(spark, folder).where(P.is_bot())
    return active.select(S.hour_stamp(F.col("timestamp")).alias("hour")).distinct()


def order_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Hours with orders: a ledger of days with natural gaps."""
    ensure_utc(spark)
    ordered = F.col("o_orderdate").cast("timestamp")
    return table(spark, folder, "orders").select(S.hour_stamp(ordered).alias("hour")).distinct()


def conversation_log(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as a log without times: one group, roles as activities."""
    return table(spark, folder, "conversations").select(
        F.lit("all").alias("archetype"),
        F.col("conv_id").alias("case_id"),
        F.col("role").alias("activity"),
        "turn",
    )


def order_log(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of a customer as a log of order states."""
    ensure_utc(spark)
    return table(spark, folder, "orders").select(
        F.lit("all").alias("archetype"),
        F.col("o_custkey").alias("case_id"),
        F.col("o_orderstatus").alias("activity"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("o_orderkey").alias("event_seq"),
    )


# What `all_types` deals out.
TYPES = (*V.PAYLOAD_NAMES, "FutureEvent", None)
ACTIONS = ("started", "opened", "reopened", "closed", "synchronize", "created", "published", "submitted")
REVIEWS = ("approved", "commented", "changes_requested", None)
CREATED = ("repository", "branch", "tag", None)
DELETED = ("branch", "tag", None)
MERGED = (True, False, None)
LOGINS = ("x[bot]", None, "u1", "[bot]u", "u2")


def _dealt(names: tuple, place: Column) -> Column:
    return F.get(F.array(*(F.lit(n) for n in names)), (place % len(names)).cast("int"))


def all_types(spark: SparkSession, folder: str) -> DataFrame:
    """The `events` table as events of every type, known or not, with every qualifier."""
    ensure_utc(spark)
    parsed = F.get_json_object("props", "$.k").cast("long").alias("k")
    raw = table(spark, folder, "events").select("*", F.inline(F.array(F.struct(parsed))))
    e, k = F.col("event_id"), F.col("k")
    activity = _dealt(TYPES, e)
    return raw.select(
        e.alias("event_seq"),
        F.col("user_id").alias("repo_id"),
        activity.alias("activity"),
        F.when(e % 11 != 0, _dealt(ACTIONS, k)).alias("action"),
        _dealt(REVIEWS, e).alias("review_state"),
        _dealt(CREATED, k).alias("create_ref_type"),
        _dealt(DELETED, k).alias("delete_ref_type"),
        _dealt(MERGED, k).alias("pr_merged"),
        _dealt(LOGINS, k).alias("actor_login"),
        S.payload_name(activity).alias("payload_type"),
    )


def archive_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The same events as raw archive objects with their archive hour.

    Events worth less than 2 lack their repository, so that the required-field
    filter has something to discard.
    """
    e = events(spark, folder, "value")
    kind = F.col("activity")
    complete = F.col("value") >= 2
    return e.select(
        S.hour_stamp(F.col("timestamp")).alias("hour"),
        F.col("event_seq").cast("string").alias("id"),
        kind.alias("type"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.struct(F.col("actor_id").alias("id"), F.col("actor_login").alias("login")).alias(
            "actor"
        ),
        F.when(
            complete, F.struct(F.col("repo_id").alias("id"), F.col("repo_name").alias("name"))
        ).alias("repo"),
        F.struct(
            "action",
            F.col("push_size").alias("size"),
            F.col("create_ref_type").alias("ref_type"),
            F.when(
                kind == "PullRequestEvent", F.struct(F.col("pr_merged").alias("merged"))
            ).alias("pull_request"),
        ).alias("payload"),
    )


def land_archive(
    spark: SparkSession, folder: str, landing: str, part: int | None = None
) -> None:
    """Write the raw objects as one gzip file per hour, as the archive does.

    With a `part` (0 or 1), only every second event.
    """
    lines = archive_lines(spark, folder)
    if part is not None:
        lines = lines.where(F.col("id").cast("long") % 2 == part)
    (
        lines.repartition("hour")
        .write.partitionBy("hour")
        .option("compression", "gzip")
        .json(landing)
    )


def land_with_defects(spark: SparkSession, folder: str, landing: str) -> list[str]:
    """Land the archive with every seventh line broken, and cut the files of three hours in half.

    Returns the names of those hours, the first three.
    """
    lines = archive_lines(spark, folder)
    value = F.to_json(F.struct(*(c for c in lines.columns if c != "hour")))
    broken = F.col("id").cast("long") % 7 == 0
    text = lines.select("hour", F.when(broken, F.left(value, F.lit(20))).otherwise(value).alias("value"))
    text.repartition("hour").write.partitionBy("hour").option("compression", "gzip").text(landing)
    hours = [r["hour"] for r in text.select("hour").distinct().orderBy("hour").limit(3).collect()]
    cut = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(
        [f"{landing}/hour={hour}" for hour in hours]
    )
    for row in cut.select("path", "content").collect():
        content = bytes(row["content"])
        land_bytes(spark, row["path"], content[: len(content) // 2])
    return hours


def land_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """Replace a file by some bytes."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(target, True)
    out.write(bytearray(content), 0, len(content))
    out.close()
