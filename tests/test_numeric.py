"""Statistics and factorisations against hand values and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators import boundaries, expression, factor, matrix, stats, tensor
from tensorloom.plans.catalog import queries
from tests.conftest import DATA


def test_ks_p_values():
    assert stats.ks_exact(3, 3, 1.0) == pytest.approx(2 / math.comb(6, 3))
    assert stats.ks_exact(2, 3, 0.1) == pytest.approx(1.0)
    assert stats.kolmogorov_tail(1.36) == pytest.approx(0.0495, abs=1e-3)


def test_ks_statistic(spark):
    s = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 2.0), (1, 2.0), (1, 5.0)], "i long, value double")
    d = stats.ks_pvalues(stats.ks_statistic(s, spark.createDataFrame([(0, 1)], "i long, j long"))).first()
    assert d["d"] == pytest.approx(0.5) and 0 < d["p"] <= 1


def test_t_and_normal_tails(spark):
    assert stats.student_tail(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert stats.student_tail(0.0, 5) == pytest.approx(1.0)
    p = spark.createDataFrame([(1.959963985,)], "z double").select(stats.normal_tail(F.col("z"))).first()[0]
    assert p == pytest.approx(0.05, abs=1e-8)


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("g", i, p) for i, p in enumerate((0.01, 0.04, 0.03, 0.5))], "g string, k int, p double")
    got = {r.k: r.p_adjusted for r in stats.benjamini_hochberg(df, "p", ["g"], ["k"]).collect()}
    assert got == pytest.approx({0: 0.04, 2: 0.04 * 4 / 3, 1: 0.04 * 4 / 3, 3: 0.5})


def test_ks_distances_of_many_samples_and_ranges(spark, monkeypatch):
    """All pairs over several ranges of values with ties, a sample without values, and pairs in either order."""
    rng = np.random.default_rng(9)
    own = {i: np.round(rng.normal(i / 3, 1 + i / 5, 40 + 30 * i), 1) for i in range(5)}
    s = spark.createDataFrame([(i, float(v)) for i, x in own.items() for v in x] + [(7, None), (None, 1.0)], "i long, value double")
    pairs = spark.createDataFrame([(i, j) for i in range(5) for j in range(5)] + [(0, 7), (8, 9)], "i long, j long")
    monkeypatch.setattr(stats, "GAP_ROWS", 3)
    got = {(r.i, r.j): (r.n, r.m, r.d) for r in stats.ks_statistic(s, pairs).collect()}
    assert got.keys() == {(i, j) for i in range(5) for j in range(5)}
    for (i, j), (n, m, d) in got.items():
        at = np.unique(np.concatenate([own[i], own[j]]))
        share = lambda x: np.searchsorted(np.sort(x), at, side="right") / len(x)
        assert (n, m) == (len(own[i]), len(own[j])) and d == pytest.approx(np.abs(share(own[i]) - share(own[j])).max(), abs=1e-12)


def test_planted_nmf_is_recovered(spark):
    rng = np.random.default_rng(2)
    m = rng.random((12, 2)) @ rng.random((2, 10))
    t = spark.createDataFrame([("g", i, j, float(m[i, j])) for i in range(12) for j in range(10)], "g string, i long, j long, value double")
    modes, seen = [("i", "W"), ("j", "H")], []
    for steps in (1, 3, 6):
        seen.append(factor.loss(t, ["g"], modes, factor.factorise(t, ["g"], modes, 2, steps)).first()["loss"])
    assert seen[0] >= seen[1] >= seen[2] and seen[2] < 0.05
    w, h = (factor.factorise(t, ["g"], modes, 2, 2)[n] for n in "WH")
    assert w.where("value < 0").count() == 0
    assert factor.reconstruct(w, h, ["g"]).count() == 120


def test_tied_triple_loss_does_not_rise(spark):
    rng = np.random.default_rng(3)
    u = rng.random((6, 2))
    x = np.einsum("ir,jr,kr->ijk", u, u, u)
    t = spark.createDataFrame([("g", i, j, k, float(x[i, j, k])) for i in range(6) for j in range(6) for k in range(6)], "g string, i long, j long, k long, value double")
    a, b = (factor.loss(t, ["g"], factor.FULL_SYM, factor.factorise(t, ["g"], factor.FULL_SYM, 2, s)).first()["loss"] for s in (1, 3))
    assert b <= a + 1e-12


def test_downsample_keeps_an_exact_number(spark):
    m = spark.createDataFrame([("s", i, j, 1.0) for i in range(5) for j in range(5)], "sample string, i long, j long, value double")
    assert tensor.downsample(m, ["i", "j"], 50, F.lit(25), ["sample"], 1).count() == 12


def test_blocks_of_100(spark):
    assert expression.blocks(spark.range(250).withColumn("g", F.lit("a")), ["g"], "id", 100).count() == 200


def test_ks_exact_counts_paths():
    """Against all interleavings of two small samples."""
    from itertools import combinations

    for n, m in ((3, 4), (5, 2), (4, 4)):
        far = []
        for own in combinations(range(n + m), n):
            x = y = d = 0
            for k in range(n + m):
                x, y = (x + 1, y) if k in own else (x, y + 1)
                d = max(d, abs(x / n - y / m))
            far.append(d)
        for d in {round(v, 12) for v in far}:
            assert stats.ks_exact(n, m, d) == pytest.approx(sum(v >= d - 1e-9 for v in far) / len(far))


def symmetric(spark, x):
    return spark.createDataFrame([("s", "c", i, j, float(x[i, j])) for i in range(len(x)) for j in range(len(x))], "sample string, chrom string, i long, j long, value double")


def test_balanced_matrices_have_equal_row_sums(spark):
    x = np.random.default_rng(1).random((7, 7)) + 0.1
    x = x + x.T
    sums = [r.s for r in matrix.balance(symmetric(spark, x), 30, tolerance=1e-3).groupBy("i").agg(F.sum("value").alias("s")).collect()]
    assert max(sums) / min(sums) < 1.003
    scale = np.array([r.scale for r in matrix.balance_roots(symmetric(spark, x), 60, tolerance=1e-6).orderBy("i").collect()])
    assert np.allclose((x * scale[:, None] * scale).sum(axis=1), 1, atol=1e-5)


def test_leading_eigenvector_settles(spark):
    x = np.random.default_rng(2).standard_normal((6, 6))
    x = x + x.T
    got = np.array([r.value for r in matrix.leading_eigenvector(matrix.squared(symmetric(spark, x)), 300, tolerance=1e-9).orderBy("bin").collect()])
    values, vectors = np.linalg.eigh(x)
    assert abs(got @ vectors[:, np.argmax(np.abs(values))]) == pytest.approx(1, abs=1e-4)


def test_rank_sum_of_all_genes_is_brute_force(spark):
    rng = np.random.default_rng(4)
    x, grp = rng.integers(0, 4, (9, 5)), ["a", "b", "a", "c", "b", "a", "c", "a", "b"]
    counts = spark.createDataFrame([(i, f"g{j}", float(x[i, j])) for i in range(9) for j in range(5) if x[i, j]], "cell long, gene string, value double")
    got = {(r.gene, r.grp): r.u for r in stats.rank_sum(counts, spark.createDataFrame(list(enumerate(grp)), "cell long, grp string")).collect()}
    for j in range(5):
        for g in "abc":
            own, rest = [x[i, j] for i in range(9) if grp[i] == g], [x[i, j] for i in range(9) if grp[i] != g]
            assert got[f"g{j}", g] == pytest.approx(sum((a > b) + (a == b) / 2 for a in own for b in rest))


def test_a_part_of_the_cells_is_masked_and_downsampled_the_same_way_twice(spark):
    m = spark.createDataFrame([("s", i, j, 1.0) for i in range(60) for j in range(60)], "sample string, i long, j long, value double")
    kept = {(r.i, r.j) for r in tensor.random_mask(m, ["sample", "i", "j"], 0.1, 7).collect()}
    assert abs(len(kept) - 360) < 4 * 18 and kept == {(r.i, r.j) for r in tensor.random_mask(m.repartition(5), ["sample", "i", "j"], 0.1, 7).collect()}
    both = tensor.downsample_slices(m, ["i", "j"], 30, F.lit(3600), ["sample"], 3)
    assert both.where("slice = 0").count() == 3600 and both.where("slice = 1").count() == 1080


def test_calls_follow_the_best_factor(spark):
    got = queries()["ab_calls"](spark, DATA).collect()
    by = {}
    for r in got:
        by.setdefault((r.sample, r.chrom), []).append(r)
    assert by and all(len({r.bin for r in v}) == len(v) and len({(r.r, r.sign, r.corr) for r in v}) == 1 for v in by.values())
    for v in by.values():
        mean = np.mean([r.value for r in v])
        assert all(r.call == ("A" if r.value > mean else "B") for r in v if abs(r.value - mean) > 1e-12)
        assert -1 <= v[0].corr <= 1


def test_principal_components_and_clusters(spark):
    points = spark.createDataFrame([(i, [float(i // 10 * 50 + i % 3), float(i % 5), 0.0]) for i in range(20)], "id long, x array<double>")
    x = np.array([r.x for r in points.orderBy("id").collect()])
    x = x - x.mean(axis=0)
    got = {(r.id, r.r): r.value for r in expression.pca(points, 2).collect()}
    first = np.array([got[i, 0] for i in range(20)])
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(first), np.abs(x @ vt[0]))
    cluster = {r.id: r.cluster for r in expression.kmeans(points, 2).collect()}
    assert len({cluster[i] for i in range(10)}) == 1 and len({cluster[i] for i in range(10, 20)}) == 1 and cluster[0] != cluster[15]


def test_insulation_windows_are_single_insulations(spark):
    m = spark.createDataFrame([("s", i, j, float((i * 7 + j) % 5 + 1)) for i in range(20) for j in range(i, 20)], "sample string, i long, j long, value double")
    both = {(r.width, r.bin): r.value for r in boundaries.insulation_windows(m, [3, 6], 20, ["sample"]).collect()}
    for w in (3, 6):
        assert {b: v for (k, b), v in both.items() if k == w} == pytest.approx({r.bin: r.value for r in boundaries.insulation(m, w, 20, ["sample"]).collect()})
