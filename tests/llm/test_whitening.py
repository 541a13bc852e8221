"""Whitening against a dense decomposition of all rows."""

import math

import numpy as np
import pytest

from tests_shared import FOLDER  # noqa: I001
from tracestrata.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n long, deviation string"


def plain(rows, components=8):
    """Usable (vec_id, vector) -> (integers, components, variances, trace) by eigenvectors of the covariance."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], dtype=object)
    n = len(x)
    sums = x.sum(axis=0)
    deviations = [int(sum((n * a - s) ** 2 for a, s in zip(row, sums))) for row in x]
    centred = np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    return deviations, centred, values[order], vectors[:, order], values.sum()


def check(found, rows, close=1e-7):
    deviations, centred, values, vectors, trace = plain(rows)
    ids = [i for i, _ in rows]
    got = {}
    for r in found:
        got.setdefault(r["component"], {})[r["vec_id"]] = r
    kept = [k for k in range(len(values)) if values[k] > 1e-15 * values[0]]
    assert sorted(got) == [k + 1 for k in kept]
    white = []
    for k in kept:
        column = [got[k + 1][i] for i in ids]
        assert [r["deviation"] for r in column] == deviations and {r["n"] for r in column} == {len(rows)}
        assert abs(column[0]["explained"] / (values[k] / trace) - 1) < 1e-9
        assert column[0]["identity_error"] < 1e-8
        white.append([r["whitened"] for r in column])
        expected = centred @ vectors[:, k] / np.sqrt(values[k])
        if all(abs(values[k] - v) > 1e-6 * values[0] for j, v in enumerate(values) if j != k):
            sign = np.sign(expected @ white[-1])
            assert np.abs(np.array(white[-1]) * sign - expected).max() < close
    white = np.array(white)
    assert np.abs(white @ white.T / len(rows) - np.eye(len(kept))).max() < 1e-8


def run(spark, rows):
    return whitening.whiten(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)).collect()


def test_table(spark):
    if FOLDER is None:
        pytest.skip("no test tables")
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in table.collect()]
    check(whitening.whiten(table).collect(), rows)


def test_unusable_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(60)]
    bad = [(100, None), (101, [None] * 12), (102, [0.1] * 11 + [float("nan")]), (103, [float("inf")] * 12), (104, []), (105, [1.0, 2.0])]
    check(run(spark, bad[:3] + rows + bad[3:]), rows)
    assert run(spark, bad) == run(spark, []) == []


def test_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(5, 20))
    rows = [(i, (base[i % 5]).tolist()) for i in range(400)]  # four directions of variance
    check(run(spark, rows), rows)
    assert len({r["component"] for r in run(spark, rows)}) == 4
    # Equal variances: every choice of components is right, but all of them must be found.
    cross = [(2 * k + s, [(1 - 2 * s) * (k == j) * 3.0 for j in range(10)]) for k in range(10) for s in (0, 1)]
    check(run(spark, cross), cross)
    assert run(spark, [(1, [1.0, 2.0])]) == run(spark, [(i, [1.0, 2.0]) for i in range(5)]) == []
    twice = run(spark, [(None, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0])])
    assert sorted(str(r["vec_id"]) for r in twice) == ["7", "7", "None"]


@pytest.mark.parametrize("share", [1e-3, 1e-6])
def test_unequal_variances(spark, share):
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 16)) * np.geomspace(1, share, 16) * 1e3 @ turn)]
    check(run(spark, rows), rows, close=1e-5)


def test_stops_early_if_the_rest_is_too_little():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(500, 40)) * np.geomspace(1, 1e-9, 40)
    calls = []

    def passes(g, known):
        calls.append(1)
        u = rows @ g
        return (rows @ known).T @ u, float(u @ u), rows.T @ u

    vectors, squares = whitening.bidiagonalise(passes, 40, float((rows**2).sum()), 3)
    values = np.linalg.svd(rows)[1] ** 2
    assert np.allclose(squares[:3], values[:3], rtol=1e-12) and len(calls) < 40


def test_many_partitions_and_wide_entries(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) + 3e6).tolist()) for i in range(200)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(90)
    check(whitening.whiten(frame).collect(), rows, close=1e-6)
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e30]), (2, [1.0])])
