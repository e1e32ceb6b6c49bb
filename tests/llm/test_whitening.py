"""Whitening beside numpy's own singular values."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tallybridge.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def brute(rows: list[list[float]]):
    """x, n, S, eigenvalues, components, trace of the given vectors."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in rows], dtype=object)
    fit = np.unique(x.astype(np.int64), axis=0)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    a = (fit * n - np.array(sums)) / n
    _, singular, right = np.linalg.svd(a, full_matrices=True)
    values = np.zeros(x.shape[1])
    values[: len(singular)] = singular**2 / n
    return x, n, sums, values, right, values.sum()


def check(result, ids, rows, rank=None):
    x, n, sums, values, right, trace = brute(rows)
    k = min(16, x.shape[1])
    got = {(r.vec_id, r.component): r for r in result}
    assert len(got) == len(result) == len(rows) * k
    off = np.array([[n * v - s for v, s in zip(row, sums)] for row in x], dtype=object)
    for i, vec_id in enumerate(ids):
        deviation = sum(v * v for v in off[i])
        for c in range(k):
            r = got[vec_id, c + 1]
            assert r.n == n
            assert r.deviation == (deviation if deviation < 1 << 63 else None)
            assert r.explained == pytest.approx(values[c] / trace if trace else 0, rel=1e-6, abs=1e-12)
            if rank is not None and c >= rank:
                assert r.whitened is None and r.explained == 0
                continue
            assert r.identity_error < 1e-8
            expected = float((off[i].astype(float) / n) @ right[c]) / math.sqrt(values[c])
            assert abs(r.whitened) == pytest.approx(abs(expected), rel=1e-5, abs=1e-5)


def frame(spark, rows, clash=False):
    df = spark.createDataFrame(
        [(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int"
    )
    return df.selectExpr("*", "'x' as N", "'y' as `whitened`", "'z' as `a.b`") if clash else df


def test_given_embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    found = queries.op13_embedding_whitening(spark, SF).collect()
    check(found, [r.vec_id for r in rows], [list(map(float, r.embedding)) for r in rows])


def test_one_sign_for_all_rows(spark):
    rng = np.random.default_rng(1)
    rows = (rng.normal(size=(400, 5)) * [9, 5, 3, 2, 1]).tolist()
    x, n, sums, values, right, _ = brute(rows)
    got = whitening.whiten(frame(spark, rows).repartition(7)).collect()
    for c in range(5):
        mine = np.array([r.whitened for r in sorted(got, key=lambda r: r.vec_id) if r.component == c + 1])
        theirs = ((x.astype(np.int64) * n - np.array(sums)) / n) @ right[c] / math.sqrt(values[c])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-8


def test_copies_count_once(spark):
    rows = [[0.0, 1.0], [2.0, 0.5], [1.0, -1.0]] + [[4.0, 4.0]] * 500
    check(whitening.whiten(frame(spark, rows), keep=["vec_id"]).collect(), range(len(rows)), rows)


@pytest.mark.parametrize("kind", ["same column", "sum of columns", "constant column", "few rows", "tiny"])
def test_directions_without_variance(spark, kind):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(300, 6))
    if kind == "same column":
        a[:, 3], rank = a[:, 0], 5
    elif kind == "sum of columns":
        a = rng.integers(-50, 50, size=(300, 6)).astype(float)
        a[:, 5], rank = a[:, 0] + a[:, 1], 5
    elif kind == "constant column":
        a[:, 2], rank = 3.0, 5
    elif kind == "few rows":
        a, rank = rng.normal(size=(4, 6)) * 5, 3
    else:  # of very little variance beside the others, yet some
        a = rng.integers(-1_000_000, 1_000_000, size=(300, 6)).astype(float)
        a[:, 4] = rng.integers(0, 2, size=300)
        rank = 6
    rows = a.tolist()
    check(whitening.whiten(frame(spark, rows)).collect(), range(len(rows)), rows, rank)


def test_no_variance_at_all(spark):
    got = whitening.whiten(frame(spark, [[1.0, 2.0]] * 3)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [
        (1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)] * 3


def test_unusable_rows_go_and_clashing_columns_give_way(spark):
    good = np.random.default_rng(3).normal(size=(50, 3)).tolist()
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [1e300, 0.0, 0.0], [1.0, 2.0]]
    df = whitening.whiten(frame(spark, good + bad, clash=True))
    assert df.columns[:4] == ["vec_id", "embedding", "label", "a.b"] and "N" not in df.columns
    check(df.collect(), range(50), good)


def test_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(df, keep=["vec_id"]).where("vec_id is null").count() == 4
    assert whitening.whiten(df.limit(0), keep=["vec_id"]).count() == 0


def test_exact_beyond_longs():
    model = whitening.Whitening(10**13, [10**19 + 7], np.ones((1, 1)), np.ones(1), np.ones(1), 0.0)
    x = np.array([[1_000_000], [1_900_000]], dtype=np.int64)
    assert whitening.deviations(x, model) == [49, None]


def test_solves_in_blocks():
    rng = np.random.default_rng(4)
    r = np.triu(rng.normal(size=(100, 100))) + 10 * np.eye(100)
    a = rng.normal(size=(7, 100))
    assert np.allclose(whitening._solved(a, r) @ r, a)
