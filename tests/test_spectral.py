"""Krylov methods and randomised components against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators import components, matrix, spectral

G = ("g",)


def cells(spark, matrices):
    rows = [(g, i, j, float(x[i, j])) for g, x in matrices.items() for i in range(len(x)) for j in range(len(x)) if x[i, j]]
    return spark.createDataFrame(rows, "g string, i long, j long, value double")


@pytest.mark.parametrize("group_cells", [10_000, 0, 30])
def test_lanczos_finds_the_largest_magnitude(spark, group_cells):
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((14, 14)), rng.random((6, 6))
    c = np.diag([3.0, -5.0, 1.0, 0.0])
    found = {"a": a + a.T, "b": b + b.T, "c": c}
    got = {}
    for r in spectral.lanczos(cells(spark, found), steps=20, tolerance=1e-10, group=G, group_cells=group_cells).collect():
        got.setdefault(r.g, {})[r.bin] = r
    for g, x in found.items():
        values, vectors = np.linalg.eigh(x)
        k = np.argmax(np.abs(values))
        v = np.array([got[g][i].value if i in got[g] else 0.0 for i in range(len(x))])
        one = next(iter(got[g].values()))
        assert one.eigenvalue == pytest.approx(values[k], rel=1e-9) and one.residual < 1e-8
        assert abs(v @ vectors[:, k]) == pytest.approx(1, abs=1e-9)
    assert spectral.lanczos(cells(spark, {"a": c * 0 + np.eye(4)}).limit(0), group=G).count() == 0


def test_newton_balances_to_one(spark):
    rng = np.random.default_rng(1)
    a = rng.random((9, 9)) + 0.05
    b = np.triu(rng.random((12, 12)) < 0.4) * rng.random((12, 12)) * 50 + np.diag(rng.random(12) + 1)
    found = {"a": a + a.T, "b": b + b.T}
    m = cells(spark, found)
    scale = {(r.g, r.i): r.scale for r in spectral.balance_newton(m, 1e-9, group=G).collect()}
    damped = {(r.g, r.i): r.scale for r in matrix.balance_roots(m.where("g = 'a'"), 60, G, tolerance=1e-6).collect()}
    for g, x in found.items():
        s = np.array([scale[g, i] for i in range(len(x))])
        assert (s > 0).all() and np.abs((x * s[:, None] * s).sum(1) - 1).max() < 1e-8
    assert all(scale[k] == pytest.approx(v, rel=1e-4) for k, v in damped.items())
    with pytest.raises(ValueError, match="row sums"):
        spectral.balance_newton(cells(spark, {"x": np.array([[0, 1, 1], [1, 0, 0], [1, 0, 0.0]])}), outer=2, inner=3, group=G)


@pytest.mark.parametrize("joined", [False, True])
def test_components_equal_numpy(spark, monkeypatch, joined):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 8)) @ np.diag([9, 7, 5, 3, 0.02, 0.01, 0.01, 0.01]) @ rng.standard_normal((8, 30)) + 4
    x[np.abs(x) < 1.0] = 0.0
    x = np.where(rng.random(x.shape) < 0.02, 0.0, x)
    rows = [(i, f"gene{j:02d}", float(x[i, j])) for i in range(60) for j in range(30) if x[i, j]] + [(99, "gene00", None)]
    x = np.concatenate([x, np.zeros((1, 30))])
    if joined:
        monkeypatch.setattr(components, "MOST_NUMBERS", 0)
    scores, loadings = components.randomised_pca(spark.createDataFrame(rows, "id long, column string, value double"), 4, more=12, rounds=5 if joined else 10)
    c = x - x.mean(0)
    _, s, v = np.linalg.svd(c, full_matrices=False)
    got = np.zeros((30, 4))
    variance = {}
    for r in loadings.collect():
        got[int(r.column[4:]), r.r] = r.loading
        variance[r.r] = r.variance
    assert [variance[r] for r in range(4)] == pytest.approx((s[:4] ** 2 / 60).tolist(), rel=1e-4 if joined else 1e-8)
    cosine = np.linalg.svd(got.T @ v[:4].T, compute_uv=False)
    assert np.sqrt(max(0.0, 1 - cosine.min() ** 2)) < (1e-2 if joined else 1e-6)
    told = np.zeros((61, 4))
    for r in scores.collect():
        told[60 if r.id == 99 else r.id, r.r] = r.value
    assert np.allclose(told, c @ got, atol=1e-6)
    assert all(got[np.abs(got[:, r]).argmax(), r] > 0 for r in range(4))
    few, _ = components.randomised_pca(spark.createDataFrame(rows[:0], "id long, column string, value double"), 3)
    assert few.count() == 0


@pytest.mark.parametrize("centre", [False, True])
def test_row_products_over_tiles(spark, monkeypatch, centre):
    from tensorloom.operators import tiles

    monkeypatch.setattr(tiles, "TILE", 4)
    monkeypatch.setattr(tiles, "PIECE", 5)
    rng = np.random.default_rng(6)
    found = {g: (rng.random((11, 11)) < 0.3) * rng.normal(size=(11, 11)) for g in "ab"}
    found["b"][5] = 0.0
    m = cells(spark, found)
    got = {(r.g, r.i, r.j): r.value for r in tiles.row_products(m, 11, G, centre).collect()}
    want = {}
    for g, x in found.items():
        c = x - x.mean(1, keepdims=True) if centre else x
        for i in range(11):
            for j in range(i, 11):
                if (x[i].any() and x[j].any()) if centre else ((x[i] != 0) & (x[j] != 0)).any():
                    want[g, i, j] = c[i] @ c[j]
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())


def test_wide_components_are_never_written_by_columns(spark, monkeypatch):
    """More columns than can be sent: no table of columns by components is laid out, only ones as tall as the rows."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(12, 2)) * [30, 15] @ rng.normal(size=(2, 150)) + rng.normal(size=(12, 150))
    monkeypatch.setattr(components, "MOST_NUMBERS", 24)
    written, real = [], components.checkpoint

    def spy(df, name):
        out = real(df, name)
        if "x" in out.columns:
            written.append(out.select(F.sum(F.size("x"))).first()[0])
        return out

    monkeypatch.setattr(components, "checkpoint", spy)
    rows = [(i, f"c{j:03d}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row)]
    scores, _ = components.randomised_pca(spark.createDataFrame(rows, "id long, column string, value double"), 2, more=4, rounds=2)
    assert written and max(written) <= 12 * 6
    c = x - x.mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    told = np.zeros((12, 2))
    for r in scores.collect():
        told[r.id, r.r] = r.value
    assert np.allclose(np.linalg.norm(told, axis=0), s[:2], rtol=1e-3)
    assert np.abs(np.linalg.svd(u[:, :2].T @ (told / np.linalg.norm(told, axis=0)), compute_uv=False)).min() > 0.99
