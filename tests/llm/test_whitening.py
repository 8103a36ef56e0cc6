"""Whitening against a dense eigendecomposition of the distinct fixed-point vectors."""

from __future__ import annotations

import numpy as np
import pytest

from loomtab.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def table(spark, vectors, more=()):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], "c", "n") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows + list(more), SCHEMA).repartition(3)


def dense(vectors, want):
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    y = fit - sums / n
    values, u = np.linalg.eigh(y.T @ y / n)
    values, u = values[::-1], u[:, ::-1]
    keep = values[:want] > 1e-12 * values[0]
    z = ((x - sums / n) @ u[:, :want][:, keep]) / np.sqrt(values[:want][keep])
    return n, ((n * x - sums) ** 2).sum(axis=1), z, values[:want][keep] / values.sum()


def check(got, vectors, ids, want):
    n, deviation, z, shares = dense(vectors, want)
    rows = {(r["vec_id"], r["component"]): r for r in got}
    assert len(rows) == len(ids) * z.shape[1]
    w = np.array([[rows[i, c + 1]["whitened"] for c in range(z.shape[1])] for i in ids])
    sign = np.sign((w * z).sum(axis=0))
    assert np.abs(w * sign - z).max() < 1e-8
    assert {r["n"] for r in got} == {n} and all(rows[i, 1]["deviation"] == d for i, d in zip(ids, deviation.tolist()))
    assert max(r["identity_error"] for r in got) < 1e-8
    assert np.allclose([rows[ids[0], c + 1]["explained"] for c in range(len(shares))], shares, rtol=1e-10)


@pytest.mark.parametrize(("width", "want"), [(6, 16), (40, 4)])
def test_components_equal_a_dense_decomposition(spark, width, want):
    draw = np.random.default_rng(width)
    spread = draw.standard_normal((90, width)) * np.linspace(3, 0.3, width) + 5
    vectors = [*spread, spread[0], spread[0], spread[5] * 50]
    got = wh.whiten(table(spark, vectors), want).collect()
    check(got, vectors, range(len(vectors)), want)


def test_unusable_rows_go_and_repeats_are_fitted_once(spark):
    draw = np.random.default_rng(2)
    good = draw.standard_normal((30, 5)).tolist()
    bad = [None, [], [1.0, None, 2, 3, 4], [1.0, float("nan"), 2, 3, 4], [float("inf"), 0, 0, 0, 0], [1.0, 2.0], [1e30, 0, 0, 0, 0]]
    vectors = good + bad
    got = wh.whiten(table(spark, vectors, [(None, good[0], None, None), (3, good[3], None, None)])).collect()
    assert {r["vec_id"] for r in got} == {*range(30), None} and len(got) == 32 * 5
    check([r for r in got if r["vec_id"] is not None], good, range(30), 16)


def test_null_directions_have_no_component(spark):
    draw = np.random.default_rng(4)
    flat = np.concatenate([draw.standard_normal((40, 3)), np.ones((40, 2))], axis=1)
    got = wh.whiten(table(spark, flat)).collect()
    assert {r["component"] for r in got} == {1, 2, 3}
    assert wh.whiten(table(spark, [[1.0, 2.0]] * 4)).count() == 0 and wh.whiten(table(spark, [])).count() == 0


def test_vectors_pack_by_width():
    rows = np.array([[1, -2], [40000, 0], [-32768, 32767], [1 << 40, -5]])
    blobs = wh.packed(rows)
    assert [len(b) for b in blobs] == [4, 8, 4, 16] and (wh.unpacked(blobs, 2) == rows).all()


def test_iteration_finds_the_top_of_a_flat_spectrum():
    draw = np.random.default_rng(5)
    basis = np.linalg.qr(draw.standard_normal((120, 120)))[0]
    values = np.concatenate([[2.0, 1.2, 1.19999], np.linspace(1.0, 0.9, 117)])
    matrix = basis * values @ basis.T
    got, vectors = wh.leading_components(lambda q: matrix @ q, 120, 3)
    assert np.allclose(got, values[:3], rtol=1e-12) and np.abs(np.abs((basis[:, :3] * vectors).sum(axis=0)) - 1).max() < 1e-8
