"""Embedding whitening by shifted CholeskyQR.

Entries become integers, ``x = floor(scale * c) + offset``, so that sums and deviations are exact. The fit list is each distinct
``x`` once. Its centred rows ``A`` are orthogonalised in passes over the cluster:

    G = sum of q' q over the rows q = a R^-1,   R := chol(G) R

Each task solves its rows against the current ``R`` and adds up its own Gram matrix; one row of it after the other is summed by
Spark, so that a d x d matrix is all that reaches the driver. A shift of the first ``G`` keeps its factorisation possible for
nearly dependent columns; passes go on until the columns of ``A R^-1`` are orthonormal, apart from directions without variance,
which are told by their nil eigenvalue and left out of the final ``R``. The singular values and right vectors of the final ``R`` are those of ``A``: never is ``A'A`` itself decomposed, whose
small eigenvalues would be lost in rounding.

Defined results: rows whose vector is null, empty, or holds null, non-finite or so large entries that ``x`` leaves the range in which
doubles are exact are left out; so are those whose dimension is not the most frequent one (of equally frequent ones the lesser).
Components without variance have ``explained`` 0 and a null ``whitened`` and take no part in ``identity_error``; ``deviation`` is null
where it does not fit into a long. Repeated rows and null ids are treated each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybridge.operators.stored import Workspace

from .shipping import ship

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Largest magnitude of a scaled entry.
LARGEST = 1 << 52
#: Rows that a task holds as doubles at a time.
ROWS = 4_096
#: Columns count as orthonormal when no eigenvalue of their Gram matrix is further from one than this, apart from
#: those of directions without variance, which are below NIL.
ORTHONORMAL, NIL, MOST_PASSES = 1e-12, 1e-12, 12
_LONG = (1 << 63) - 1


@dataclass
class Whitening:
    """What a fit list says of its components."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # d x k, unit columns
    values: np.ndarray  # k eigenvalues, falling
    explained: np.ndarray
    identity_error: float | None

    @property
    def filled(self) -> np.ndarray:
        return self.values > 0


def integer_vectors(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """All columns of the usable rows and ``_x``, the vector of integers."""
    given = vectors[f"`{embedding}`"]
    usable = F.forall(
        given, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < LARGEST)
    )
    rows = vectors.where(given.isNotNull() & (F.size(given) > 0) & usable)
    rows = rows.withColumn("_x", F.transform(given, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET)))
    dimension = rows.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("_x") == (dimension["d"] if dimension else 0))


# -- sums over the cluster --------------------------------------------------------------------


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The vectors of the last column as matrices of longs of a bounded number of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.column(batch.num_columns - 1).slice(at, ROWS)
            yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Rows minus the mean, rounded once: ``(n x - S) / n`` with an exact numerator."""
    return _numerators(x, n, sums) / float(n)


def _numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S``, exact: longs where they suffice, else Python's integers, as doubles' nearest in the end."""
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
    if most < _LONG:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _total(rows: DataFrame, width: int, partial: Callable[[Iterator[np.ndarray]], np.ndarray]) -> np.ndarray:
    """The sum over all tasks of a matrix of ``width`` columns that ``partial`` makes of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = partial(_matrices(batches))
        if matrix is None:
            return
        flat = pa.array(matrix.ravel(), pa.float64())
        ends = pa.array(np.arange(0, matrix.size + 1, width, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(matrix)), pa.int32()), pa.ListArray.from_arrays(ends, flat)], names=["i", "row"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            for i, row in zip(batch.column(0).to_pylist(), values):
                sums[i] = sums[i] + row if i in sums else row.copy()
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([list(v) for v in sums.values()], pa.list_(pa.float64()))],
                names=["i", "row"],
            )

    kind = "i int, row array<double>"
    # Each of the few matrix rows is summed by one task, over one number list per task before.
    found = rows.mapInArrow(run, kind).repartition("i").mapInArrow(add, kind).collect()
    out = np.zeros((len(found), width))
    for r in found:
        out[r["i"]] = r["row"]
    return out


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows of the fit list and the sum of each dimension, exact."""
    places = fit.select(F.posexplode("_x").alias("i", "x"))
    found = places.groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count("x").alias("n")).collect()
    found.sort(key=lambda r: r["i"])
    return (found[0]["n"], [int(r["s"]) for r in found]) if found else (0, [])


# -- the factorisation -------------------------------------------------------------------------


def _solved(a: np.ndarray, r: np.ndarray | None) -> np.ndarray:
    """``a R^-1``, by forward substitution on blocks of columns."""
    if r is None:
        return a
    out = np.empty_like(a)
    step = 32
    for at in range(0, r.shape[0], step):
        to = min(at + step, r.shape[0])
        block = a[:, at:to] - out[:, :at] @ r[:at, at:to]
        out[:, at:to] = np.linalg.solve(r[at:to, at:to].T, block.T).T
    return out


def _gram(fit: DataFrame, n: int, sums: list[int], r: np.ndarray | None) -> np.ndarray:
    def partial(matrices):
        total = None
        for x in matrices:
            q = _solved(_centred(x, n, sums).astype(float), r)
            total = q.T @ q if total is None else total + q.T @ q
        return total

    return _total(fit, len(sums), partial)


def _cholesky(gram: np.ndarray, shift: float) -> np.ndarray:
    """The upper factor of a Gram matrix with the least shift from ``shift`` on that lets it exist."""
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(shift * 10, np.finfo(float).eps)


def orthogonalised(fit: DataFrame, n: int, sums: list[int]) -> tuple[np.ndarray, float]:
    """The ``R`` of the centred rows and the sum of their squares."""
    d = len(sums)
    gram = _gram(fit, n, sums, None)
    squares = float(np.trace(gram))
    if squares == 0:
        return np.zeros((d, d)), 0.0
    # The shift follows the rounding of a Gram matrix summed in blocks of ROWS rows.
    r = _cholesky(gram, 11 * d * np.finfo(float).eps * squares)
    for _ in range(MOST_PASSES):
        gram = _gram(fit, n, sums, r)
        eigen, directions = np.linalg.eigh(gram)
        empty = directions[:, eigen < NIL]
        nil = empty @ empty.T
        if np.abs(eigen[eigen >= NIL] - 1).max() < ORTHONORMAL:
            break
        r = _cholesky(gram + nil, 0.0) @ r  # a direction without variance stays as it is
    return r - nil @ r, squares


def fit_whitening(vectors: DataFrame, workspace: Workspace, components: int = COMPONENTS) -> Whitening:
    """Fit on each distinct ``_x`` of :func:`integer_vectors` once."""
    ship(vectors.sparkSession)
    fit = workspace.store(vectors.select("_x").distinct())
    n, sums = _sums(fit)
    if n == 0:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0), None)
    r, squares = orthogonalised(fit, n, sums)
    k = min(components, len(sums))
    _, singular, right = np.linalg.svd(r)
    nil = singular <= 1e-13 * len(sums) * singular.max()
    values = np.where(nil, 0.0, singular**2 / n)[:k]
    explained = values / (squares / n) if squares else np.zeros(k)
    model = Whitening(n, sums, right[:k].T.copy(), values, explained, None)
    if not model.filled.any():
        return model
    width = int(model.filled.sum())

    def partial(matrices):
        total = None
        for x in matrices:
            w = whitened(x, model)[:, model.filled]
            both = np.vstack([w.T @ w, w.sum(axis=0)])
            total = both if total is None else total + both
        return total

    moments = _total(fit, width, partial) / n
    covariance = moments[:width] - np.outer(moments[width], moments[width])
    model.identity_error = float(np.abs(covariance - np.eye(width)).max())
    return model


def whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    """The components of integer rows, each of unit variance over the fit list; nan without variance."""
    scale = np.where(model.filled, 1 / np.sqrt(np.where(model.filled, model.values, 1)), np.nan)
    return (_centred(x, model.n, model.sums).astype(float) @ model.vectors) * scale


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over the dimensions of ``(n x - S)^2`` of each row, exact; null where a long does not hold it."""
    off = _numerators(x, model.n, model.sums)
    most = max(abs(int(off.max())), abs(int(off.min())))
    if most * most * x.shape[1] <= _LONG:
        return (off * off).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in off.tolist()]
    return [v if v <= _LONG else None for v in exact]


def apply_whitening(vectors: DataFrame, model: Whitening, keep: list[str]) -> DataFrame:
    """A row per row of :func:`integer_vectors` and component: ``component, n, deviation, whitened, explained,
    identity_error`` beside the columns of ``keep``, which give way to added ones of the same name."""
    added = T.StructType.fromDDL(
        "component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    gone = {f.name.lower() for f in added.fields}
    kept = [c for c in keep if c.lower() not in gone]
    # Names of its own, as those given may hold dots.
    names = [f"c{i}" for i in range(len(kept))]
    rows = vectors.select(*[vectors[f"`{c}`"].alias(n) for c, n in zip(kept, names)], "_x")
    schema = T.StructType(rows.schema.fields[:-1] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.vectors.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                (x,) = _matrices([part])
                w, m = whitened(x, model).ravel(), len(x)
                per_row = pa.array(np.repeat(np.arange(m), k))
                new = [
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n, np.int64)),
                    pa.array(deviations(x, model), pa.int64()).take(per_row),
                    pa.array(w, pa.float64(), mask=np.isnan(w)),
                    pa.array(np.tile(model.explained, m)),
                    pa.array([model.identity_error] * (m * k), pa.float64()),
                ]
                old = [part.column(i).take(per_row) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays(old + new, names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*kept, *added.names)


def whiten(vectors: DataFrame, embedding: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """Fit on all usable rows and whiten them."""
    rows = integer_vectors(vectors, embedding)
    model = fit_whitening(rows, Workspace(vectors.sparkSession))
    return apply_whitening(rows, model, vectors.columns if keep is None else keep)
