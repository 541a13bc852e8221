"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows A stay distributed. Starting from a unit vector v, the products
u = A v and A^T u alternate and turn A into a small upper bidiagonal matrix B
with A V = U B; its singular value decomposition gives the components
(V times its right vectors) and their deviations. Every new u and v is
orthogonalised against all earlier ones, u by sums over all rows.

The long vectors u are never stored: each is A g for a short vector g kept beside
V, so a pass over the rows recomputes those it needs, and a lost executor costs
the pass of its partitions only. One pass gives A g, its products with all
earlier u, and A^T of it: one job a step. Where orthogonalising takes away most of
a vector, the pass is made again. Steps go on until the wanted components have
converged and what is left of the trace can hide no larger one, or until V is
complete; a direction that ends early is replaced by a fresh one.

Bounds. The driver and each task hold some matrices of (dimensions)^2 numbers and
one block of rows. Sums of a task are added up in the driver, or, from many
partitions, first in groups of them.

Defined results. Rows whose vector is null, or holds a null, a NaN or an infinite
entry, are dropped; so are vectors of another length than the most common one (the
longer of two equally common) and empty vectors. A null or repeated vec_id is kept.
Components without variance are left out: one row alone, or equal rows, give no
component and hence no rows. Entries that are too large for exact longs raise an
error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracestrata import materialize
from tracestrata.llm.text import mix, seeds

# An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
BLOCK_BYTES = 1 << 20
# Partitions whose sums the driver adds up itself.
DIRECT = 64
# Relative to the largest singular value: what counts as converged, and as zero.
CONVERGED, ZERO = 1e-15, 1e-11


def _blocks(column: str):
    """Usable rows as blocks: their ids, the length of their vectors, and the entries as integers."""

    def task(batches):
        for batch in batches:
            vectors = batch.column(column)
            size = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0), np.int64)
            flat = vectors.flatten()  # without those of null vectors
            values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            usable = (size > 0) & (bad[ends] == bad[ends - size])
            for d in np.unique(size[usable]).tolist():
                rows = np.flatnonzero(usable & (size == d))
                step = max(1, BLOCK_BYTES // (8 * d))
                for first in range(0, len(rows), step):
                    part = rows[first : first + step]
                    x = np.floor(values[(ends - size)[part][:, None] + np.arange(d)] * SCALE)
                    if np.abs(x).max() >= 2.0**52:
                        raise OverflowError("an entry is too large to be an exact long")
                    x = x.astype(np.int64) + SHIFT
                    narrow = np.abs(x).max() < 2**31
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column("vec_id").take(pa.array(part)).to_pylist()], pa.list_(batch.column("vec_id").type)),
                         pa.array([d], pa.int32()), pa.array([bool(narrow)]),
                         pa.array([x.astype("<i4" if narrow else "<i8").tobytes()], pa.binary())],
                        names=["ids", "d", "narrow", "x"],
                    )

    return task


def _matrices(batches):
    """(ids, integers) of each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            d, narrow = batch.column("d")[k].as_py(), batch.column("narrow")[k].as_py()
            raw = batch.column("x")[k].as_buffer()
            x = np.frombuffer(raw, "<i4" if narrow else "<i8").astype(np.int64).reshape(-1, d)
            yield batch.column("ids")[k].values, x


def _totals(blocks: DataFrame, of: Callable[[np.ndarray], np.ndarray], kind: str = "<f8") -> np.ndarray:
    """The sum over all blocks of an array each gives."""

    def task(batches):
        total = None
        for _, x in _matrices(batches):
            got = of(x)
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(kind).tobytes()], pa.binary())], names=["sums"])

    def add(batches):
        total = None
        for batch in batches:
            for raw in batch.column("sums").to_pylist():
                got = np.frombuffer(raw, kind)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = blocks.mapInArrow(task, "sums binary")
    parts = blocks.rdd.getNumPartitions()
    if parts > DIRECT:
        sums = sums.repartition(int(parts**0.5) + 1).mapInArrow(add, "sums binary")
    return np.sum([np.frombuffer(r["sums"], kind) for r in sums.collect()], axis=0)


@dataclass
class Fit:
    """n rows, exact sums of their dimensions, components as columns, and each one's variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Exact, in units of 1 / n^2."""
        away = self.n * x - self.sums
        if (away.astype(np.float64) ** 2).sum(axis=1).max() >= 2.0**63:
            raise OverflowError("a deviation is too large to be a long")
        return (away * away).sum(axis=1)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.variances)


def _fresh(d: int, known: list[np.ndarray], number: int) -> np.ndarray:
    """A fixed unit vector orthogonal to all known ones."""
    while True:
        v = (mix(seeds(d, stream=number)) >> np.uint64(11)).astype(np.float64) / 2.0**53 - 0.5
        size = np.linalg.norm(v)
        for _ in range(3):
            for w in known:
                v = v - w * (w @ v)
        if np.linalg.norm(v) > 1e-6 * size:
            return v / np.linalg.norm(v)
        number += 1_000_003


def bidiagonalise(
    passes: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float, np.ndarray]], d: int, total: float, wanted: int
) -> tuple[np.ndarray, np.ndarray]:
    """(components as columns, squared singular values) of the rows, largest first.

    `passes(g, G)` gives (A G)^T (A g), |A g|^2 and A^T A g; `total` is the sum of all squares of A.
    """
    scale = np.sqrt(total)
    v_all = [_fresh(d, [], 0)]
    g_all: list[np.ndarray] = []
    back: list[np.ndarray] = []  # A^T u of each u
    b = np.zeros((d, d))
    beta = 0.0
    while True:
        k = len(v_all) - 1
        v = v_all[k]
        g = v - beta * g_all[-1] if k else v
        for _ in range(3):
            known = np.array(g_all).T if k else np.zeros((d, 0))
            c, square, z = passes(g, known)
            left = square - c @ c
            if k:
                g = g - known @ c
                z = z - np.array(back).T @ c
            if left > 0.5 * square or square <= (ZERO * scale) ** 2:
                break
        alpha = np.sqrt(max(left, 0.0))
        if alpha <= ZERO * scale:
            # v adds nothing new: its u is left empty.
            alpha, g, z = 0.0, np.zeros(d), np.zeros(d)
        else:
            g, z = g / alpha, z / alpha
        g_all.append(g)
        back.append(z)
        b[k, k] = alpha
        w = z - alpha * v
        for _ in range(2):
            for known_v in v_all:
                w = w - known_v * (known_v @ w)
        beta = np.linalg.norm(w)
        _, s, right = np.linalg.svd(b[: k + 1, : k + 1])
        if k + 1 == d or _settled(b[: k + 1, : k + 1], s, beta, total, wanted):
            return np.array(v_all).T @ right.T, s * s
        if alpha == 0.0 or beta <= ZERO * scale:
            beta = 0.0
            v_all.append(_fresh(d, v_all, k + 1))
        else:
            v_all.append(w / beta)
            b[k, k + 1] = beta


def _settled(b: np.ndarray, s: np.ndarray, beta: float, total: float, wanted: int) -> bool:
    """Whether the wanted values have converged and the rest of the trace is too little for a larger one."""
    if len(s) < wanted or total - (b * b).sum() >= s[wanted - 1] ** 2:
        return False
    left = np.linalg.svd(b)[0]
    return bool((beta * np.abs(left[-1, :wanted]) <= CONVERGED * s[0]).all())


def fit(blocks: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The components of stored blocks (of one length of vectors); none if there are no rows."""
    first = blocks.select("d").first()
    if first is None:
        return None
    d = first["d"]
    counted = _totals(blocks, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), "<i8")
    found = Fit(int(counted[0]), counted[1:], np.zeros((d, 0)), np.zeros(0), 0.0)
    total = float(_totals(blocks, lambda x: np.array([(found.centred(x) ** 2).sum()]))[0])
    if total <= 0:
        return found

    def passes(g: np.ndarray, known: np.ndarray):
        def of(x):
            rows = found.centred(x)
            u = rows @ g
            return np.concatenate([(rows @ known).T @ u, [u @ u], rows.T @ u])

        got = _totals(blocks, of)
        k = known.shape[1]
        return got[:k], float(got[k]), got[k + 1 :]

    vectors, squares = bidiagonalise(passes, d, total, min(components, d))
    keep = [k for k in range(min(components, len(squares))) if squares[k] > (ZERO**2) * squares[0]]
    return Fit(found.n, found.sums, vectors[:, keep], squares[keep] / found.n, total / found.n)


def identity_error(blocks: DataFrame, found: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(found.variances)

    def of(x):
        y = found.whitened(x)
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

    got = _totals(blocks, of)
    mean = got[:k] / found.n
    covariance = got[k:].reshape(k, k) / found.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


_ROWS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    ddl = f"vec_id {kind}, {_ROWS}"
    given = embeddings.select("vec_id", column)
    blocks = materialize(given.mapInArrow(_blocks(column), f"ids array<{kind}>, d int, narrow boolean, x binary"))
    lengths = blocks.groupBy("d").agg(F.sum(F.size("ids")).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).first()
    if lengths is None:
        return embeddings.sparkSession.createDataFrame([], ddl)
    blocks = blocks.where(F.col("d") == lengths["d"])
    found = fit(blocks, components)
    k = len(found.variances)
    if not k:
        return embeddings.sparkSession.createDataFrame([], ddl)
    error = identity_error(blocks, found)
    explained = found.variances / found.trace

    def task(batches):
        for ids, x in _matrices(batches):
            n = len(x)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                 pa.array(np.full(n * k, found.n, np.int64)), pa.array(np.repeat(found.deviation(x), k)),
                 pa.array(found.whitened(x).ravel()), pa.array(np.tile(explained, n)), pa.array(np.full(n * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return blocks.mapInArrow(task, ddl)
