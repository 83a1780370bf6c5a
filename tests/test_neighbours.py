"""Nearest neighbours through the index, interval pairs over the hierarchy, quantiles by selection and densities on a grid against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.functions.numeric import quantiles
from tensorloom.operators import intervals, neighbours, stats

SMALL = "/root/testdata/sf0.1"


def brute(x, ids, k, asked):
    out = {}
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = sorted((d[p], ids[p]) for p in range(len(x)) if p != q)[:k]
        out[ids[q]] = [i for _, i in order]
    return out


def rows(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.query, {})[r.place] = r.neighbour
    return {q: [places[p] for p in sorted(places)] for q, places in out.items()}


def test_index_is_exact_on_clustered_points_with_ties(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.2, (60, 5)) for c in range(4)] + [np.ones((30, 5))])  # thirty equal points
    p = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")
    got = rows(neighbours.knn_index(p, 7))
    assert got == brute(x, list(range(len(x))), 7, range(len(x)))
    assert rows(neighbours.knn_index(p, 7, p.where("id % 50 = 0"), cells=3)) == brute(x, list(range(len(x))), 7, range(0, len(x), 50))
    few = p.where("id < 3")
    assert {q: len(v) for q, v in rows(neighbours.knn_index(few, 7)).items()} == {0: 2, 1: 2, 2: 2}
    assert neighbours.knn_index(p.limit(0), 3).count() == 0


def test_index_blocks_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (200, 3))
    p = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    assert rows(neighbours.knn_index(p, 5, cells=4)) == brute(x, list(range(200)), 5, range(200))


def test_recall_of_few_probes_and_of_all(spark):
    """Three probes find clustered neighbours; the given embeddings have no clusters, and there the second round makes the result exact."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(rng.normal(0, 3, 16), 0.5, (50, 16)) for _ in range(20)])
    p = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")
    want = brute(x, list(range(1000)), 15, range(0, 1000, 10))
    got = rows(neighbours.knn_index(p, 15, p.where("id % 10 = 0"), exact=False))
    assert np.mean([len(set(got[q]) & set(v)) / 15 for q, v in want.items()]) >= 0.95
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x")).orderBy("id").collect()
    x, ids = np.array([r.x for r in e]), [r.id for r in e]
    q = spark.createDataFrame(e)
    assert rows(neighbours.knn_index(q, 15, q.where("id % 100 = 0"))) == brute(x, ids, 15, [k for k, i in enumerate(ids) if i % 100 == 0])


def test_interval_pairs_of_all_lengths(spark):
    rng = np.random.default_rng(3)

    def table(n, top):
        start = rng.integers(0, 3000, n)
        return [(f"c{i % 2}", int(s), int(s + rng.integers(0, top)), i) for i, s in enumerate(start)]

    a, b = table(150, 40) + [("c0", 0, 1 << 40, 900), ("c1", 7, 8, 901), ("c0", 5, 5, 902)], table(150, 900) + [("c0", 1 << 39, (1 << 39) + 1, 900)]
    schema = "chrom string, start long, end long, id long"
    got = intervals.overlap_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()
    want = {(x[3], y[3], min(x[2], y[2]) - max(x[1], y[1])) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[2] > x[1] and y[2] > y[1]}
    assert len(got) == len(want) and {(r.a_id, r.b_id, r.lap) for r in got} == want
    none = spark.createDataFrame([], schema)
    assert intervals.overlap_pairs(none, spark.createDataFrame(b, schema)).count() == 0
    long = spark.createDataFrame([("c", 0, 1 << 34, 1)], schema)
    assert intervals._laid(intervals._levelled(long), "a", intervals._levelled(long), 2, False).count() == 1


def test_quantiles_by_selection(spark):
    rng = np.random.default_rng(5)
    rows_ = [(int(g), float(v), int(c)) for g, v, c in zip(rng.integers(0, 5, 400), rng.integers(0, 30, 400), rng.integers(1, 4, 400), strict=True)]
    df = spark.createDataFrame([*rows_, (9, 1.5, 1), (0, None, 3)], "g long, v double, c long")
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r.q for r in quantiles(df, ["g"], "v", shares, "c").collect()}
    for g in range(5):
        assert got[g] == pytest.approx(np.quantile(np.repeat([v for k, v, _ in rows_ if k == g], [c for k, _, c in rows_ if k == g]), shares).tolist())
    assert got[9] == [1.5] * 5
    assert quantiles(df, [], "v", [0.5]).first().q == pytest.approx([np.median([v for _, v, _ in rows_] + [1.5])])


def test_density_grid_is_within_its_bound(spark):
    rng = np.random.default_rng(7)
    xy = np.concatenate([rng.normal((0, 0), (1, 3), (300, 2)), rng.normal((4, 9), 0.3, (100, 2)), [[50.0, -20.0]]])
    xy[:, 1] += 2 * xy[:, 0]
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double")
    got = {r.id: r.density for r in stats.density_grid(p).collect()}
    exact = {r.id: r.density for r in stats.density_2d(p.drop("id"), p).collect()}
    cov = np.cov(xy.T) * len(xy) ** (-1 / 3)
    peak = 1 / (2 * np.pi * np.sqrt(np.linalg.det(cov)))
    assert got.keys() == exact.keys() and max(abs(got[i] - exact[i]) for i in exact) < 0.0013 * peak
    assert np.median([abs(got[i] / exact[i] - 1) for i in exact]) < 1e-3
    assert stats.density_grid(p.limit(0)).count() == 0
    assert {r.density for r in stats.density_grid(p.where("id < 1")).collect()} == {None}


def test_points_without_clusters_meet_in_tiles(spark, monkeypatch):
    """Open cells hold most pairs there: strips of queries meet streams of points, and a task holds a strip and a tile."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(0, 1, (500, 12)), np.ones((40, 12)), 1e6 + rng.normal(0, 1e-3, (60, 12))])
    ids = [int(i) for i in rng.permutation(600) * 7]
    p = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "id long, x array<double>")
    for name, least in (("TILE", 700), ("MEASURED", 50), ("OPEN", 0.0)):
        monkeypatch.setattr(neighbours, name, least)
    monkeypatch.setattr(neighbours, "_strip_rows", lambda width: 90)
    held = []
    laid = neighbours._tiles
    monkeypatch.setattr(neighbours, "_tiles", lambda asked, met, k, batch=None: held.append(met.count()) or laid(asked, met, k, batch))
    assert rows(neighbours.knn_index(p, 5)) == brute(x, ids, 5, range(600))
    assert held == [566]  # of forty equal points the six smallest ids


def test_stated_queries_by_batch(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x, batch = rng.normal(0, 1, (400, 4)), rng.integers(0, 3, 400)
    x[:100] = x[0]
    p = spark.createDataFrame([(i, [float(v) for v in row], None if b == 2 else f"b{b}") for i, (row, b) in enumerate(zip(x, batch, strict=True))], "id long, x array<double>, batch string")
    monkeypatch.setattr(neighbours, "TILE", 300)
    got = {}
    for r in neighbours.knn_tiles(p, p.drop("batch").where("id % 40 = 0"), 3, "batch").collect():
        got.setdefault((r.query, r.batch), []).append((r.place, r.neighbour, r.distance))
    assert len(got) == 10 * 3
    for (q, name), found in got.items():
        of = [i for i in range(400) if batch[i] == {"b0": 0, "b1": 1, None: 2}[name] and i != q]
        want = sorted((float(np.sqrt(((x[i] - x[q]) ** 2).sum())), i) for i in of)[:3]
        assert [(k + 1, i) for k, (_, i) in enumerate(want)] == [f[:2] for f in sorted(found)]
        assert np.allclose([d for d, _ in want], [f[2] for f in sorted(found)])
    assert neighbours.knn_tiles(p.limit(0), p, 3).count() == 0 and neighbours.knn_tiles(p, p.limit(0), 3).count() == 0


def test_density_counts_equal_places_once(spark, monkeypatch):
    """Copies of a place are one row with a count; strips of queries meet streams of points."""
    rng = np.random.default_rng(13)
    xy = np.repeat(rng.normal(0, [3, 400], (60, 2)) @ [[1, 20], [0, 1]], 50, axis=0)
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)] + [(9000, None, 1.0)], "id long, x double, y double")
    monkeypatch.setattr(neighbours, "TILE", 5)
    written, real = {}, stats.checkpoint
    monkeypatch.setattr(stats, "checkpoint", lambda df, name: written.setdefault(name, real(df, name)))
    got = {r.id: r.density for r in stats.density_2d(p.drop("id"), p.where("id % 7 = 0 or x is null")).collect()}
    assert written["points"].count() == 60 and got.pop(9000) is None and len(got) == 429
    spread = np.cov(xy.T)
    spread[1, 1] = np.var([*xy[:, 1], 1.0], ddof=1)  # as in SQL
    inverse = np.linalg.inv(spread * 3001 ** (-1 / 3))
    for i, density in got.items():
        d = xy - xy[i]
        want = np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, inverse, d)).sum() * np.sqrt(np.linalg.det(inverse)) / (2 * np.pi * 3001)
        assert density == pytest.approx(want, rel=1e-10)
    flat = p.withColumn("y", F.lit(1.0)).where("x is not null")
    assert [r.density for r in stats.density_2d(flat.drop("id"), flat.limit(3)).collect()] == [None] * 3
    assert stats.density_2d(p.drop("id").limit(0), p).count() == 0


def test_overlaps_are_counted_without_laying_out_pairs(spark, monkeypatch):
    """Ids with several intervals, equal, empty and null ones, against brute force; two crowded places have 4 * 10**10 pairs."""
    rng = np.random.default_rng(14)
    schema = "chrom string, start long, end long, id long"

    def table(n, top):
        start = rng.integers(0, 200, n)
        kept = [(f"c{i % 3}", int(s), int(s + rng.integers(0, top)), int(rng.integers(0, n // 2))) for i, s in enumerate(start)]
        return kept + kept[:5] + [(None, 0, 300, 9000), ("c0", None, 9, 9001), ("c1", 5, 9, None), ("lone", 1, 2, 9002), ("c0", 7, 7, 9003)]

    for n, top in ((60, 4), (90, 40)):
        a, b = table(n, top), table(n, 6)[:-2] + [("other", 1, 2, 9002)]
        full = lambda t: [x for x in t if None not in x[:3] and x[1] < x[2]]
        pairs = [(x[3], y[3]) for x in full(a) for y in full(b) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2]]
        want = (*(len({x[3] for x in t} - {None}) - len({p[k] for p in pairs} - {None}) for k, t in enumerate((a, b))), len(pairs))
        assert tuple(intervals.overlap_counts(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).first()) == want
    none = spark.createDataFrame([], schema)
    assert tuple(intervals.overlap_counts(none, spark.createDataFrame([("c", 1, 2, 5)], schema)).first()) == (0, 1, 0)
    crowd = spark.range(200_000).select(F.lit("c").alias("chrom"), (F.col("id") % 2).alias("start"), F.lit(9).cast("long").alias("end"), "id")
    assert tuple(intervals.overlap_counts(crowd, crowd).first()) == (0, 0, 200_000**2)
