"""Whole factorisation runs: planted factors, both ways of running, and calls from written factors against SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.functions.numeric import checkpoint
from tensorloom.operators import compartments, factor
from tensorloom.plans import demo_data as D
from tensorloom.plans import q_factor
from tests.conftest import DATA

SYM3 = factor.SYM3


def tensor(spark, x, columns, group="g"):
    """A dense array as rows of (g, columns.., value)."""
    rows = [(group, *map(int, at), float(x[at])) for at in np.ndindex(x.shape)]
    return spark.createDataFrame(rows, "g string, " + ", ".join(f"{c} long" for c in columns) + ", value double")


@pytest.mark.parametrize(
    "modes,shape,rank",
    [([("i", "W"), ("j", "H")], (20, 15), 3), (SYM3, (2, 12), 2), (factor.FULL_SYM, (10,), 2), (factor.FOUR_WAY, (3, 2, 8), 3), (q_factor.PLAIN, (3, 8, 9), 3)],
)
def test_planted_factors_are_recovered(spark, modes, shape, rank):
    rng = np.random.default_rng(4)
    names = list(dict.fromkeys(n for _, n in modes))
    planted = {n: rng.random((s, rank)) ** 2 for n, s in zip(names, shape, strict=True)}
    letters = "abcdef"[: len(modes)]
    x = np.einsum(",".join(f"{c}r" for c in letters) + "->" + letters, *(planted[n] for _, n in modes))
    t = tensor(spark, x, [c for c, _ in modes])
    done = factor.fits(t, ["g"], modes, [rank], steps=500, tolerance=1e-9).collect()
    loss = next(r.value for r in done if r.name is None)
    assert loss < 0.01
    found = {n: np.zeros((s, rank)) for n, s in zip(names, shape, strict=True)}
    for r in done:
        if r.name:
            found[r.name][int(r.idx), r.r] = r.value
    assert all((f >= 0).all() for f in found.values())
    again = np.einsum(",".join(f"{c}r" for c in letters) + "->" + letters, *(found[n] for _, n in modes))
    assert ((x - again) ** 2).sum() / (x**2).sum() == pytest.approx(loss, abs=1e-6)
    once, more = (factor.fits(t, ["g"], modes, [rank], steps=s, tolerance=0).where("name is null").first().value for s in (3, 40))
    assert more <= once


@pytest.mark.parametrize("modes", [[("i", "W"), ("j", "H")], SYM3])
def test_joins_and_tasks_run_alike(spark, modes):
    """The same start, updates and end whether a group is gathered or its cells stay where they are; absent cells are zeros."""
    rng = np.random.default_rng(6)
    columns = [c for c, _ in modes]
    shape = (9, 7) if len(modes) == 2 else (2, 7, 7)
    x = rng.random(shape)
    x = x + x.transpose(0, 2, 1) if len(modes) == 3 else x
    both = tensor(spark, x, columns, "a").unionByName(tensor(spark, x * x, columns, "b")).where("value > 0.3")
    near = factor.fits(both, ["g"], modes, [2], steps=4, tolerance=0.0)
    far = factor.fits(both, ["g"], modes, [2], steps=4, tolerance=0.0, group_cells=0)
    key = lambda r: (r.g, r.rank, r.name or "", r.idx or "", r.r or 0)
    a, b = ({key(r) if r.name else (r.g,): r.value for r in df.collect()} for df in (near, far))
    assert a.keys() == b.keys() and len(a) == 2 * (1 + 2 * sum(dict(zip((n for _, n in modes), shape, strict=True)).values()))
    assert all(b[k] == pytest.approx(v, rel=1e-6, abs=1e-12) for k, v in a.items())
    mixed = factor.fits(both.where("g = 'a' or i < 2"), ["g"], modes, [2], steps=2, tolerance=0.0, group_cells=both.where("g = 'a'").count() - 1)
    assert {r.g for r in mixed.collect()} == {"a", "b"}


def test_loss_is_within_a_hundredth_of_numpy(spark):
    """The contact matrices of one sample against coordinate descent on dense arrays from the same start."""
    m = D.contacts(spark, DATA).where("sample = 'A'")
    from tensorloom.operators.matrix import symmetrize

    t = checkpoint(symmetrize(m))
    got = {r.chrom: r.value for r in factor.fits(t, ["chrom"], [("i", "W"), ("j", "H")], [2]).where("name is null").collect()}
    for chrom, value in got.items():
        x = np.zeros((D.N_BINS, D.N_BINS))
        for r in t.where(F.col("chrom") == chrom).collect():
            x[r.i, r.j] = r.value
        best = np.inf
        for seed in range(3):
            rng = np.random.default_rng(seed)
            w, h = rng.random((D.N_BINS, 2)), rng.random((D.N_BINS, 2))
            for _ in range(400):
                w *= (x @ h) / (w @ (h.T @ h) + 1e-12)
                h *= (x.T @ w) / (h @ (w.T @ w) + 1e-12)
            best = min(best, ((x - w @ h.T) ** 2).sum() / (x**2).sum())
        assert value <= best * 1.01


def test_calls_follow_written_factors(spark):
    """Best factor, sign and calls in SQL over the factors that a converged run has written."""
    v = checkpoint(factor.factorise(q_factor.ab_tensor(spark, DATA), q_factor.SC, SYM3, 2)["V"].select("sample", "chrom", F.col("idx").alias("bin"), "r", "value"))
    bulk = checkpoint(D.bulk(spark, DATA))
    best = compartments.best_factor(v, bulk, q_factor.SC)
    got = compartments.calls(compartments.pick_factor(v, best, q_factor.SC), q_factor.SC).collect()
    con = duckdb.connect()
    con.register("v", v.toPandas())
    con.register("bulk", bulk.toPandas())
    want = con.execute(
        """with c as (select sample, chrom, r, corr(v.value, b.value) as c from v join bulk b using (chrom, bin) group by all),
        s as (select *, case when c < 0 then -1 else 1 end as sign from c where c is not null),
        b as (select * from s qualify row_number() over (partition by sample, chrom order by abs(c) desc, r) = 1),
        p as (select v.sample, v.chrom, v.bin, v.value * sign as value from v join b using (sample, chrom, r))
        select sample, chrom, bin, value, case when value > avg(value) over w then 'A' when value < avg(value) over w then 'B' else 'none' end as call from p window w as (partition by sample, chrom)"""
    ).fetchall()
    calls = {(r.sample, r.chrom, r.bin): (round(r.value, 9), r.call) for r in got}
    assert calls == {(s, c, b): (round(x, 9), call) for s, c, b, x, call in want} and {c for _, c in calls.values()} >= {"A", "B"}


def test_no_cells(spark):
    t = spark.createDataFrame([], "g string, i long, j long, value double")
    assert factor.fits(t, ["g"], [("i", "W"), ("j", "H")], [2]).count() == 0
    zeros = spark.createDataFrame([("g", 0, 0, 0.0), ("g", 1, 1, 0.0)], "g string, i long, j long, value double")
    assert {r.value for r in factor.fits(zeros, ["g"], [("i", "W"), ("j", "H")], [2]).where("name is null").collect()} == {0.0}
