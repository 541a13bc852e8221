import pytest

from tracestrata import ContractError
from tracestrata.functions import vocabulary as V
from tracestrata.operators import comparison as K

A, B, C = "PushEvent", "PullRequestEvent_opened", "IssuesEvent_closed"
NODES = "archetype string, activity string, occurrences long, in_net boolean"
EDGES = (
    "archetype string, source string, target string, frequency long, mean_seconds double, "
    "dependency double, kind string"
)
CELLS = "archetype string, source string, target string, value double"


@pytest.fixture
def model(rows):
    nodes = rows([("m", A, 12, True), ("m", B, 17, True), ("m", C, 5, True)], NODES)
    edges = rows(
        [("m", A, B, 10, 3600.0, 0.9, "dependency"), ("m", B, C, 5, 1800.0, 0.9, "dependency"),
         ("m", B, A, 2, 10.0, 0.9, "dependency")],
        EDGES,
    )
    return nodes, edges


def only(df):
    found = df.collect()
    assert len(found) == 1
    return found[0]


def test_identikit(model):
    row = only(K.identikit(*model))
    assert (row["num_nodes"], row["num_edges"]) == (3, 3)
    assert (row["top_activity"], row["top_count"]) == (B, 17)
    assert (row["slow_source"], row["slow_target"], row["slow_seconds"]) == (A, B, 3600.0)
    assert (row["density"], row["cyclomatic_complexity"], row["avg_degree"]) == (0.5, 1.0, 1.0)
    assert row["most_freq_activity"] == f"{B} (17)"
    assert row["slowest_edge"] == f"{A}->{B} (1.0h)"


def test_one_node_and_empty_nets(rows):
    nodes = rows([("one", A, 3, True), ("none", A, 3, False)], NODES)
    edges = rows([("one", A, A, 2, 5.0, 0.7, "self_loop")], EDGES)
    got = {r["archetype"]: r for r in K.identikit(nodes, edges).collect()}
    assert (got["one"]["num_nodes"], got["one"]["num_edges"], got["one"]["density"]) == (1, 1, 0.0)
    assert (got["none"]["num_nodes"], got["none"]["num_edges"]) == (0, 0)
    assert got["none"]["most_freq_activity"] == "None (-1)"
    assert got["none"]["slowest_edge"] == "None->None (-0.0h)"


def test_ties_go_to_the_first_by_name(rows):
    nodes = rows([("m", B, 5, True), ("m", A, 5, True), ("m", C, 99, False)], NODES)
    edges = rows(
        [("m", B, A, 1, 7.0, 0.9, "dependency"), ("m", A, B, 1, 7.0, 0.9, "dependency"),
         ("m", A, A, 1, None, 0.9, "self_loop")],
        EDGES,
    )
    assert only(K.top_activity(nodes))["top_activity"] == B  # "PullRequest..." < "Push..."
    slow = only(K.slowest_edge(nodes, edges))
    assert (slow["slow_source"], slow["slow_target"]) == (B, A)


def test_adjacency(model):
    nodes, edges = model
    groups = K.models(nodes)
    freq = {(r["source"], r["target"]): r["value"] for r in K.adjacency(groups, edges, "frequency").collect()}
    assert len(freq) == 19 * 19
    assert (freq[A, B], freq[B, A], freq[A, C]) == (10.0, 2.0, 0.0)
    perf = {(r["source"], r["target"]): r["value"] for r in K.adjacency(groups, edges, "performance").collect()}
    assert (perf[A, B], perf[A, C]) == (3600.0, -1.0)
    wide = K.wide_matrix(K.adjacency(groups, edges, "frequency"))
    assert wide.columns == ["archetype", "activity", *V.SKELETON]
    assert wide.count() == 19


def test_edges_outside_the_skeleton_have_no_cell(rows):
    edges = rows([("m", A, "PullRequestReviewEvent_dismissed", 3, 1.0, 0.9, "dependency")], EDGES)
    assert K.cells(edges, "frequency").isEmpty()


def test_jaccard(rows, spark):
    data = [("x", n) for n in ("Push", "Review", "Issue")]
    data += [("y", n) for n in ("Push", "Review", "Merge", "Deploy")]
    nodes = rows(data, "archetype string, activity string")
    pairs = K.ordered_pairs(spark, ["x", "y", "gone", "lost"])
    got = {(r["group_a"], r["group_b"]): r["similarity"] for r in K.jaccard(nodes, pairs, ["activity"]).collect()}
    assert len(got) == 16
    assert got["x", "y"] == got["y", "x"] == pytest.approx(0.4)
    assert got["x", "x"] == 1.0
    assert got["gone", "lost"] == 1.0
    assert got["x", "gone"] == 0.0


def cells_of(rows, group, matrix):
    names = ["A", "B"]
    return [(group, names[i], names[j], float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row)]


def test_frobenius(rows, spark):
    matrix = rows(cells_of(rows, "x", [[10, 0], [0, 5]]) + cells_of(rows, "y", [[5, 0], [0, 10]]), CELLS)
    groups = rows([("x",), ("y",)], "archetype string")
    pairs = K.ordered_pairs(spark, ["x", "y", "gone"])
    got = {(r["group_a"], r["group_b"]): r["distance"] for r in K.frobenius(matrix, groups, pairs).collect()}
    assert got["x", "y"] == pytest.approx(0.4714045)
    assert got["x", "x"] == 0.0
    assert got["x", "gone"] == got["gone", "gone"] == 0.0
    raw = K.frobenius(matrix, groups, pairs, normalise=False).collect()
    assert {(r["group_a"], r["group_b"]): r["distance"] for r in raw}["x", "y"] == pytest.approx(50**0.5)


def test_empty_net_is_a_zero_matrix(rows, spark):
    matrix = rows(cells_of(rows, "x", [[3, 0], [0, 1]]), CELLS)
    groups = rows([("x",), ("empty",)], "archetype string")
    pairs = K.unordered_pairs(spark, ["x", "empty"])
    row = only(K.frobenius(matrix.where("value <> 0"), groups, pairs))
    assert row["distance"] == pytest.approx((0.75**2 + 0.25**2) ** 0.5)


def test_performance_defaults_take_part_in_frobenius(rows, spark):
    edges = rows(
        [("x", A, B, 10, 400.0, 0.9, "dependency"), ("y", A, B, 10, 1000.0, 0.9, "dependency")], EDGES
    )
    groups = rows([("x",), ("y",)], "archetype string")
    dense = K.adjacency(groups, edges, "performance")
    row = only(K.frobenius(dense, groups, K.unordered_pairs(spark, ["x", "y"])))
    tx, ty = 400.0 - 360, 1000.0 - 360
    expected = ((400 / tx - 1000 / ty) ** 2 + 360 * (-1 / tx + 1 / ty) ** 2) ** 0.5
    assert row["distance"] == pytest.approx(expected)


def test_delta(rows, spark):
    matrix = rows(cells_of(rows, "x", [[10, 20], [5, 5]]) + cells_of(rows, "y", [[10, 0], [0, 20]]), CELLS)
    pairs = K.unordered_pairs(spark, ["x", "y"])
    got = {(r["source"], r["target"]): r["delta"] for r in K.delta_matrix(matrix, pairs, "frequency").collect()}
    assert got == {
        ("A", "A"): pytest.approx(0.25 - 1 / 3),
        ("A", "B"): pytest.approx(0.5),
        ("B", "A"): pytest.approx(0.125),
        ("B", "B"): pytest.approx(0.125 - 2 / 3),
    }
    with pytest.raises(ContractError):
        K.delta_matrix(matrix, pairs, "cost")


def test_manhattan_and_tvd(rows, spark):
    edges = rows(
        [("x", A, B, 3, 100.0, 0.9, "dependency"), ("x", B, A, 1, 100.0, 0.9, "dependency"),
         ("y", A, B, 4, 50.0, 0.9, "dependency")],
        EDGES,
    )
    groups = rows([("x",), ("y",)], "archetype string")
    pairs = K.unordered_pairs(spark, ["x", "y", "gone"])
    got = {r["metric"]: (r["manhattan"], r["tvd"]) for r in K.manhattan_tvd(edges, groups, pairs).collect()}
    assert got == {"Frequency": (0.5, 0.25), "Performance": (1.0, 0.5)}


def test_ratio_to_max(rows):
    profile = rows(
        [("Giant_All", 6, 3, 0.0), ("Giant_Pop_LowCollab", 12, 3, 0.0), ("Mid_Standard", 99, 99, 9.0)],
        "archetype string, num_nodes long, num_edges long, density double",
    )
    measures = ("num_nodes", "num_edges", "density")
    got = {r["archetype"]: tuple(r)[1:] for r in K.ratio_to_max(profile, measures=measures).collect()}
    assert got == {"Giant_All": (0.5, 1.0, 0.0), "Giant_Pop_LowCollab": (1.0, 1.0, 0.0)}
    assert K.ratio_to_max(profile, None, measures=measures).count() == 3


def test_top_activities(rows):
    nodes = rows(
        [("x", A, 5, True), ("y", A, 5, True), ("x", B, 7, True), ("y", C, 1, False)], NODES
    )
    got = {(r["archetype"], r["activity"]) for r in K.top_activities(nodes, 2).collect()}
    assert got == {("x", A), ("y", A), ("x", B)}
    assert [r["activity"] for r in K.activity_skeleton(nodes).collect()] == [C, B, A]


def test_pairs(spark):
    assert K.ordered_pairs(spark).count() == 25
    halves = [tuple(r) for r in K.unordered_pairs(spark).collect()]
    assert len(halves) == 10
    assert ("Giant_All", "Mid_Standard") in halves and ("Mid_Standard", "Giant_All") not in halves


def test_similarity_lists_missing_models(model, spark):
    nodes, edges = model
    pairs = K.ordered_pairs(spark, ["m", "gone"])
    got = {(r["group_a"], r["group_b"]): tuple(r)[2:] for r in K.similarity(nodes, edges, pairs).collect()}
    assert got == {
        ("m", "m"): (1.0, 1.0, 0.0, 0.0),
        ("m", "gone"): (0.0, 0.0, 0.0, 0.0),
        ("gone", "m"): (0.0, 0.0, 0.0, 0.0),
        ("gone", "gone"): (1.0, 1.0, 0.0, 0.0),
    }
