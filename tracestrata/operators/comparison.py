"""Model metrics, adjacency matrices in long form, and distances between models.

Every operator takes the group column as a parameter, so the same code compares
five archetypes or thousands of cohorts. Matrices are rows of
(group, source, target, value); pairs of groups are rows of (group_a, group_b).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracestrata.errors import ContractError
from tracestrata.functions import scalars as S
from tracestrata.functions import vocabulary as V
from tracestrata.session import materialize

# Value of an absent cell, per metric.
ABSENT = {"frequency": 0.0, "performance": -1.0}
_MEASURE = {"frequency": "frequency", "performance": "mean_seconds"}

PROFILE_MEASURES = (
    "density", "num_nodes", "num_edges", "cyclomatic_complexity", "avg_degree",
)


def _measure(metric: str) -> str:
    if metric not in _MEASURE:
        raise ContractError("metric must be 'frequency' or 'performance'")
    return _MEASURE[metric]


# --- one model ---------------------------------------------------------------


def models(nodes: DataFrame, by: str = "archetype") -> DataFrame:
    """Groups that have a model, even one whose net is empty."""
    return nodes.select(by).distinct()


def model_size(nodes: DataFrame, edges: DataFrame, by: str = "archetype") -> DataFrame:
    """Node and edge counts of each net."""
    node_counts = nodes.groupBy(by).agg(F.count_if("in_net").alias("num_nodes"))
    edge_counts = edges.groupBy(by).agg(F.count("*").alias("num_edges"))
    return node_counts.join(edge_counts, by, "left").withColumn(
        "num_edges", F.coalesce("num_edges", F.lit(0))
    )


def model_complexity(size: DataFrame) -> DataFrame:
    """Add density, average degree and cyclomatic complexity to `model_size`.

    Nets of at most one node have zero in all three.
    """
    n, e = F.col("num_nodes"), F.col("num_edges")

    def unless_trivial(value: Column) -> Column:
        return F.when(n > 1, value).otherwise(0.0)

    return size.withColumns(
        {
            "density": unless_trivial(F.try_divide(e, n * (n - 1))),
            "avg_degree": unless_trivial(F.try_divide(e, n)),
            "cyclomatic_complexity": unless_trivial((e - n + 1).cast("double")),
        }
    )


def top_activity(nodes: DataFrame, by: str = "archetype") -> DataFrame:
    """Most frequent activity inside the net; ties go to the first by name."""
    ranked = F.struct((-F.col("occurrences")).alias("rank"), "activity", "occurrences")
    best = nodes.groupBy(by).agg(F.min(F.when(F.col("in_net"), ranked)).alias("best"))
    return best.select(
        by,
        F.coalesce("best.activity", F.lit("None")).alias("top_activity"),
        F.coalesce("best.occurrences", F.lit(-1)).alias("top_count"),
    )


def slowest_edge(nodes: DataFrame, edges: DataFrame, by: str = "archetype") -> DataFrame:
    """Net edge with the longest mean time; an unknown time counts as zero."""
    seconds = F.coalesce("mean_seconds", F.lit(0.0))
    slow = edges.groupBy(by).agg(
        F.min(
            F.struct((-seconds).alias("rank"), "source", "target", seconds.alias("seconds"))
        ).alias("slow")
    )
    return (
        models(nodes, by)
        .join(slow, by, "left")
        .select(
            by,
            F.coalesce("slow.source", F.lit("None")).alias("slow_source"),
            F.coalesce("slow.target", F.lit("None")).alias("slow_target"),
            F.coalesce("slow.seconds", F.lit(-1.0)).alias("slow_seconds"),
        )
    )


def identikit(nodes: DataFrame, edges: DataFrame, by: str = "archetype") -> DataFrame:
    """Structural profile of each model, one row per group."""
    profile = (
        model_complexity(model_size(nodes, edges, by))
        .join(top_activity(nodes, by), by)
        .join(slowest_edge(nodes, edges, by), by)
    )
    return profile.select(
        by,
        "num_nodes",
        "num_edges",
        "density",
        "cyclomatic_complexity",
        "avg_degree",
        S.activity_label(F.col("top_activity"), F.col("top_count")).alias("most_freq_activity"),
        S.edge_label(
            F.col("slow_source"), F.col("slow_target"), F.col("slow_seconds")
        ).alias("slowest_edge"),
        "top_activity",
        "top_count",
        "slow_source",
        "slow_target",
        "slow_seconds",
    )


def ratio_to_max(
    profile: DataFrame,
    groups: Sequence[str] | None = V.PROFILED_ARCHETYPES,
    by: str = "archetype",
    measures: Sequence[str] = PROFILE_MEASURES,
) -> DataFrame:
    """Each measure as a share of its maximum over `groups` (None: all groups)."""
    chosen = profile if groups is None else profile.where(F.col(by).isin(*groups))
    peaks = chosen.agg(F.struct(*(F.max(m).alias(m) for m in measures)).alias("peak"))
    peak = peaks.scalar()
    return chosen.select(by, *(F.col(m).cast("double").alias(m) for m in measures)).withColumns(
        {
            m: F.col(m) / F.when(peak.getField(m) == 0, 1.0).otherwise(peak.getField(m))
            for m in measures
        }
    )


def activity_skeleton(nodes: DataFrame) -> DataFrame:
    """All activities that occur in any model, sorted."""
    return nodes.select("activity").distinct().orderBy("activity")


def top_activities(nodes: DataFrame, n: int = 10, by: str = "archetype") -> DataFrame:
    """Rows of the `n` activities that are most frequent over all groups."""
    totals = nodes.groupBy("activity").agg(F.sum("occurrences").alias("total"))
    best = totals.orderBy(F.desc("total"), "activity").limit(n)
    return nodes.join(F.broadcast(best.select("activity")), "activity", "left_semi").select(
        by, "activity", "occurrences"
    )


# --- matrices ----------------------------------------------------------------


def cells(edges: DataFrame, metric: str, by: str = "archetype") -> DataFrame:
    """Stored cells of the adjacency matrix: net edges within the skeleton."""
    value = F.col(_measure(metric)).cast("double")
    return edges.where(
        F.col("source").isin(*V.SKELETON) & F.col("target").isin(*V.SKELETON) & value.isNotNull()
    ).select(by, "source", "target", value.alias("value"))


def adjacency(
    groups: DataFrame, edges: DataFrame, metric: str, by: str = "archetype"
) -> DataFrame:
    """Dense matrix over the skeleton; absent cells hold the metric's default."""
    names = F.array(*(F.lit(a) for a in V.SKELETON))
    grid = groups.select(by, F.explode(names).alias("source")).select(
        by, "source", F.explode(names).alias("target")
    )
    return grid.join(cells(edges, metric, by), [by, "source", "target"], "left").withColumn(
        "value", F.coalesce("value", F.lit(ABSENT[metric]))
    )


def normalised(matrix: DataFrame, by: str = "archetype") -> DataFrame:
    """Divide each cell by its matrix's total, unless the total is not positive.

    A group's window holds one matrix: at most activities squared rows.
    """
    value, total = F.col("value"), F.sum("value").over(W.partitionBy(by))
    scaled = F.when(total > 0, F.try_divide(value, total)).otherwise(value)
    return matrix.select(by, "source", "target", scaled.alias("value"))


def wide_matrix(matrix: DataFrame, by: str = "archetype") -> DataFrame:
    """Export form: one row per (group, source), one column per skeleton target."""
    wide = matrix.groupBy(by, F.col("source").alias("activity"))
    return wide.pivot("target", list(V.SKELETON)).agg(F.first("value"))


# --- pairs of models ---------------------------------------------------------


def _named_pairs(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    listed = F.array(*(F.lit(n) for n in names))
    return (
        spark.range(0, 1, 1, 1)
        .select(F.posexplode(listed).alias("i", "group_a"))
        .select("i", "group_a", F.posexplode(listed).alias("j", "group_b"))
    )


def ordered_pairs(spark: SparkSession, names: Sequence[str] = V.ARCHETYPE_NAMES) -> DataFrame:
    """Every ordered pair of a short list of names, including equal ones."""
    return _named_pairs(spark, names).select("group_a", "group_b")


def unordered_pairs(spark: SparkSession, names: Sequence[str] = V.ARCHETYPE_NAMES) -> DataFrame:
    """Each pair of different names once, in list order."""
    return _named_pairs(spark, names).where("i < j").select("group_a", "group_b")


def modelled_pairs(pairs: DataFrame, groups: DataFrame, by: str = "archetype") -> DataFrame:
    """The pairs whose groups both have a model."""
    for side in ("group_a", "group_b"):
        known = groups.select(F.col(by).alias(side))
        pairs = pairs.join(known, side, "left_semi")
    return pairs


def jaccard(
    items: DataFrame, pairs: DataFrame, columns: Sequence[str], by: str = "archetype"
) -> DataFrame:
    """Jaccard similarity of the groups' item sets; two empty sets are equal.

    Sets are never collected: an item of a pair's union occurs once or twice,
    twice if both groups have it.
    """
    members = items.select(by, *columns).distinct()

    def of(side: str) -> DataFrame:
        return pairs.join(members.withColumnRenamed(by, side), side).select(
            "group_a", "group_b", *columns
        )

    union = of("group_a").unionByName(of("group_b"))
    item_counts = union.groupBy("group_a", "group_b", *columns).agg(F.count("*").alias("owners"))
    shares = item_counts.groupBy("group_a", "group_b").agg(
        (F.count_if(F.col("owners") == 2) / F.count("*")).alias("similarity")
    )
    return pairs.join(shares, ["group_a", "group_b"], "left").withColumn(
        "similarity", F.coalesce("similarity", F.lit(1.0))
    )


def _differences(
    matrix: DataFrame, pairs: DataFrame, by: str, normalise: bool
) -> DataFrame:
    """(group_a, group_b, source, target, delta) over cells present in either matrix.

    The union of two matrices with zero fill is a signed sum: cells of the
    first count positive, cells of the second negative.
    """
    scaled = normalised(matrix, by) if normalise else matrix

    def signed(side: str, sign: int) -> DataFrame:
        return pairs.join(scaled.withColumnRenamed(by, side), side).select(
            "group_a", "group_b", "source", "target", (sign * F.col("value")).alias("value")
        )

    both = signed("group_a", 1).unionByName(signed("group_b", -1))
    return both.groupBy("group_a", "group_b", "source", "target").agg(
        F.sum("value").alias("delta")
    )


def frobenius(
    matrix: DataFrame,
    groups: DataFrame,
    pairs: DataFrame,
    by: str = "archetype",
    normalise: bool = True,
) -> DataFrame:
    """Frobenius distance of two matrices; 0.0 where a group has no model.

    Give dense performance matrices: their defaults take part in totals and
    differences. For frequencies the stored cells are enough.
    """
    squares = (
        _differences(matrix, modelled_pairs(pairs, groups, by), by, normalise)
        .groupBy("group_a", "group_b")
        .agg(F.sqrt(F.sum(F.col("delta") * F.col("delta"))).alias("distance"))
    )
    return pairs.join(squares, ["group_a", "group_b"], "left").withColumn(
        "distance", F.coalesce("distance", F.lit(0.0))
    )


def delta_matrix(
    matrix: DataFrame,
    pairs: DataFrame,
    metric: str,
    normalise: bool = True,
    by: str = "archetype",
) -> DataFrame:
    """Cellwise difference of two models, with absent cells counted as zero.

    Cells that both models lack have no row. Takes dense or stored cells, and
    pairs of groups that have a model.
    """
    _measure(metric)
    present = matrix.where(F.col("value") != ABSENT[metric])
    return _differences(present, pairs, by, normalise)


# --- all distances from one row per model ------------------------------------

_CELLS = len(V.SKELETON) ** 2


def profiles(nodes: DataFrame, edges: DataFrame, by: str = "archetype") -> DataFrame:
    """One row per group that has a model or edges: its sets and both its matrices.

    (group, modelled, activities, links, frequency, performance). The sets are sorted
    arrays. The matrices are arrays over the cells of the skeleton, null where a net
    has no edge, so a row is bounded by the skeleton and the group's own activities.
    Whatever compares two groups then needs their two rows and no further shuffle.
    """
    names = F.array(*(F.lit(a) for a in V.SKELETON))
    source, target = (F.array_position(names, F.col(c)).cast("int") for c in ("source", "target"))
    cell = F.when((source > 0) & (target > 0), (source - 1) * len(V.SKELETON) + target - 1)
    own = nodes.groupBy(by).agg(F.sort_array(F.collect_set("activity")).alias("activities"))
    linked = edges.groupBy(by).agg(
        F.sort_array(F.collect_set(F.struct("source", "target"))).alias("links"),
        F.collect_list(
            F.struct(
                cell.alias("cell"),
                *(F.col(c).cast("double").alias(m) for m, c in _MEASURE.items()),
            )
        ).alias("entries"),
    )

    def matrix(metric: str) -> Column:
        def value(i: Column) -> Column:
            here = F.filter("entries", lambda e: (e["cell"] == i) & e[metric].isNotNull())
            return F.aggregate(here, F.lit(None).cast("double"), lambda sum_, e: F.coalesce(sum_, F.lit(0.0)) + e[metric])

        return F.transform(F.sequence(F.lit(0), F.lit(_CELLS - 1)), value)

    joined = own.withColumn("modelled", F.lit(True)).join(linked, by, "full")
    return joined.select(
        by,
        F.coalesce("modelled", F.lit(False)).alias("modelled"),
        F.coalesce("activities", F.array().cast("array<string>")).alias("activities"),
        F.coalesce("links", F.array().cast("array<struct<source: string, target: string>>")).alias("links"),
        *(matrix(metric).alias(metric) for metric in _MEASURE),
    )


def _filled(matrix: Column, absent: float) -> Column:
    return F.transform(matrix, lambda v: F.coalesce(v, F.lit(absent)))


def _scaled(matrix: Column) -> Column:
    """A matrix divided by its total, unless that is not positive."""
    total = F.aggregate(matrix, F.lit(0.0), lambda sum_, v: sum_ + v)
    return _let(total, lambda t: F.when(t > 0, F.transform(matrix, lambda v: F.try_divide(v, t))).otherwise(matrix))


def _let(value: Column, body) -> Column:
    """`body` over `value`, which is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum_of(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda sum_, v: sum_ + v)


def _vectors(profile: DataFrame, by: str) -> DataFrame:
    """Profiles with the vectors that are compared, stored: one small row per group."""
    found = profile.select(
        by,
        "modelled",
        "activities",
        "links",
        _scaled(_filled(F.col("frequency"), 0.0)).alias("flow"),
        # Defaults take part in totals and differences of the Frobenius distance only.
        _scaled(_filled(F.col("performance"), ABSENT["performance"])).alias("dense"),
        _scaled(_filled(F.transform("performance", lambda v: F.when(v != ABSENT["performance"], v)), 0.0)).alias("times"),
    )
    return materialize(found)


def _side_by_side(pairs: DataFrame, vectors: DataFrame, by: str, how: str) -> DataFrame:
    """Each pair with the structs `a` and `b` of its groups."""
    row = F.struct(*(c for c in vectors.columns if c != by))
    for side, name in (("group_a", "a"), ("group_b", "b")):
        known = vectors.select(F.col(by).alias(side), row.alias(name))
        pairs = pairs.join(known, side, how)
    return pairs


def manhattan_tvd(
    edges: DataFrame, groups: DataFrame, pairs: DataFrame, by: str = "archetype"
) -> DataFrame:
    """Manhattan and total-variation distance of each requested pair, for both metrics."""
    nodes = groups.select(by, F.lit(None).cast("string").alias("activity"))
    vectors = _vectors(profiles(nodes, edges, by).where("modelled"), by)
    both = _side_by_side(pairs.select("group_a", "group_b"), vectors, by, "inner")

    def gap(name: str) -> Column:
        return _sum_of(F.col(f"a.{name}"), F.col(f"b.{name}"), lambda x, y: F.abs(x - y))

    told = F.array(
        F.struct(F.lit("Frequency").alias("metric"), gap("flow").alias("manhattan")),
        F.struct(F.lit("Performance").alias("metric"), gap("times").alias("manhattan")),
    )
    return both.select("group_a", "group_b", F.inline(told)).withColumn("tvd", F.col("manhattan") / 2)


def similarity(
    nodes: DataFrame, edges: DataFrame, pairs: DataFrame, by: str = "archetype"
) -> DataFrame:
    """The four global similarity matrices in long form, for every requested pair.

    Groups without a model have empty sets, and distance 0.0 to every other.
    """
    both = _side_by_side(pairs.select("group_a", "group_b"), _vectors(profiles(nodes, edges, by), by), by, "left")

    def alike(name: str) -> Column:
        kind = "array<string>" if name == "activities" else "array<struct<source: string, target: string>>"
        a, b = (F.coalesce(f"{side}.{name}", F.array().cast(kind)) for side in ("a", "b"))
        union = F.size(F.array_union(a, b))
        return F.when(union == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)), union))

    def distance(name: str) -> Column:
        squares = _sum_of(F.col(f"a.{name}"), F.col(f"b.{name}"), lambda x, y: (x - y) * (x - y))
        modelled = F.coalesce(F.col("a.modelled") & F.col("b.modelled"), F.lit(False))
        return F.when(modelled, F.sqrt(squares)).otherwise(0.0)

    return both.select(
        "group_a",
        "group_b",
        alike("activities").alias("jaccard_nodes"),
        alike("links").alias("jaccard_edges"),
        distance("flow").alias("frobenius_frequency"),
        distance("dense").alias("frobenius_performance"),
    )
