"""Eigenvectors and balancing of symmetric matrices by Krylov methods: one join of the cells with a vector a step.

Matrices are full COO tables (group.., i, j, value), vectors tables (group.., i, ..). All groups step together; their scalars are rows of small tables, and one number
a step reaches the driver, the worst group's residual. Every step's vectors are written, so no plan grows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.numeric import checkpoint, discard

GROUP = ("sample", "chrom")
GROUP_CELLS = 2_000_000


def times(m: DataFrame, v: DataFrame, value: Column, group=GROUP) -> DataFrame:
    """(group, i, _w): the matrix times `value` of v(group, i, ..)."""
    side = v.select(*group, F.col("i").alias("j"), value.alias("_v"))
    return m.join(side, [*group, "j"]).groupBy(*group, "i").agg(F.sum(F.col("value") * F.col("_v")).alias("_w"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _start(i: Column) -> Column:
    """An entry in [0.1, 1.1) by the hash of its index, so that no symmetry of the matrix hides an eigenvector from it."""
    return F.crc32(i.cast("string").cast("binary")) % 1_000_003 / 1_000_003.0 + 0.1


RITZ = "struct<eigenvalue:double,y:array<double>,left:double>"


def _ritz(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The eigenvalue of largest magnitude of each tridiagonal matrix, its vector, and the bound of its residual."""
    rows = []
    for diagonal, beside in zip(a, b, strict=True):
        t = np.diag(np.asarray(diagonal, float)) + np.diag(np.asarray(beside[:-1], float), 1) + np.diag(np.asarray(beside[:-1], float), -1)
        values, vectors = np.linalg.eigh(t)
        k = int(np.argmax(np.abs(values)))
        rows.append((float(values[k]), vectors[:, k].tolist(), float(abs(beside[-1] * vectors[-1, k]))))
    return pd.DataFrame(rows, columns=["eigenvalue", "y", "left"])


def _krylov(i: np.ndarray, j: np.ndarray, value: np.ndarray, start: np.ndarray, steps: int, tolerance: float) -> tuple[np.ndarray, float, float]:
    """(vector, eigenvalue, residual) of one matrix, by the steps of `lanczos`."""
    product = lambda v: np.bincount(i, value * v[j], len(v))
    basis, diagonal, beside = [start / np.linalg.norm(start)], [], []
    for _ in range(min(steps, len(start))):
        w, q = product(basis[-1]), np.array(basis)
        own = 0.0
        for _ in (0, 1):
            c = q @ w
            w = w - c @ q
            own += c[-1]
        diagonal.append(float(own))
        beside.append(float(np.linalg.norm(w)))
        value_, y, left = _ritz(pd.Series([diagonal]), pd.Series([beside])).iloc[0]
        if left <= tolerance * max(abs(value_), 1e-300) or beside[-1] <= 1e-13 * max(abs(diagonal[0]), 1e-300):
            break
        basis.append(w / beside[-1])
    v = np.asarray(y) @ np.array(basis[: len(y)])
    return v, value_, float(np.linalg.norm(product(v) - value_ * v))


def _gathered(m: DataFrame, steps: int, tolerance: float, g: list[str]) -> DataFrame:
    """`lanczos` of small matrices, each in one task."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in m.select(*g).schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate([pdf["i"], pdf["j"]]), return_inverse=True)
        start = np.array([zlib.crc32(str(x).encode()) % 1_000_003 / 1_000_003.0 + 0.1 for x in ids.tolist()])
        v, eigenvalue, residual = _krylov(at[: len(pdf)], at[len(pdf) :], pdf["value"].to_numpy(float), start, steps, tolerance)
        return pd.DataFrame({c: [pdf[c].iloc[0]] * len(ids) for c in g} | {"bin": ids, "value": v, "eigenvalue": eigenvalue, "residual": residual})

    return m.groupBy(*g).applyInPandas(run, f"{kinds}{', ' if g else ''}bin {dict(m.dtypes)['i']}, value double, eigenvalue double, residual double")


def lanczos(m: DataFrame, steps: int = 60, tolerance: float = 1e-9, group=GROUP, look_every: int = 4, group_cells: int = GROUP_CELLS) -> DataFrame:
    """(group, bin, value, eigenvalue, residual): the unit eigenvector of the eigenvalue of largest magnitude of each full symmetric matrix, and |A v - l v|.

    Lanczos steps with full re-orthogonalisation, twice a step: the basis is one array per index, its products with the new vector one sum a group. Every `look_every`
    steps the small tridiagonal matrices are solved; it ends when the residual bound of every group is under the tolerance times its eigenvalue. Zero cells may be
    absent; an index without cells has no row; an empty table gives no rows. The sign is open.

    Matrices of up to `group_cells` stored cells, by a count, are gathered and go through the same steps in one task each; larger ones stay where they are."""
    g = list(group)
    m = checkpoint(m.where("value != 0").select(*g, "i", "j", F.col("value").cast("double").alias("value")), "matrix")
    large = checkpoint(m.groupBy(*g).agg(F.count("*").alias("_n")).where(F.col("_n") > group_cells).drop("_n"), "large") if g else m.limit(int(m.count() > group_cells)).select()
    if large.isEmpty():
        return _gathered(m, steps, tolerance, g)
    if g and group_cells:
        few, m = m.join(large, g, "left_anti"), checkpoint(m.join(large, g, "left_semi"), "matrix")
        return _gathered(few, steps, tolerance, g).unionByName(lanczos(m, steps, tolerance, group, look_every, 0))
    ids = m.select(*g, "i").distinct().withColumn("_s", _start(F.col("i")))
    norm = ids.groupBy(*g).agg(F.sqrt(F.sum(F.col("_s") * F.col("_s"))).alias("_n"))
    basis = checkpoint(ids.join(norm, g).select(*g, "i", F.array(F.col("_s") / F.col("_n")).alias("q")), "basis")
    sides = checkpoint(norm.select(*g, F.array().cast("array<double>").alias("a"), F.array().cast("array<double>").alias("b")), "sides")
    for k in range(steps):
        w = w0 = checkpoint(basis.join(times(m, basis, F.col("q")[k], group), [*g, "i"], "left").withColumn("_w", F.coalesce("_w", F.lit(0.0))), "product")
        own = None
        for again in (False, True):
            c = w.groupBy(*g).agg(F.array(*(F.sum(F.col("_w") * F.col("q")[t]) for t in range(k + 1))).alias("_c"))
            w = w.join(c, g).withColumn("_w", F.col("_w") - _dot(F.col("_c"), F.col("q"))).drop("_c")
            own = c.select(*g, F.col("_c")[k].alias("_a")) if own is None else own.join(c.select(*g, F.col("_c")[k].alias("_b")), g).select(*g, (F.col("_a") + F.col("_b")).alias("_a"))
        w = checkpoint(w, "rest")
        length = w.groupBy(*g).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_n"))
        # own reads the product, so the sides come before it goes
        new_sides = checkpoint(sides.join(own, g).join(length, g).select(*g, F.array_append("a", F.col("_a")).alias("a"), F.array_append("b", F.col("_n")).alias("b")), "sides")
        discard(w0, sides)
        sides = new_sides
        if (k + 1) % look_every == 0 or k + 1 == steps:
            found = checkpoint(sides.withColumn("_r", F.pandas_udf(_ritz, RITZ)("a", "b")).select(*g, "_r.*"), "ritz")
            worst = found.agg(F.max(F.col("left") / F.greatest(F.abs("eigenvalue"), F.lit(1e-300)))).first()[0]
            if worst is None or worst <= tolerance or k + 1 == steps:
                break
        # a vector that is spent goes on as zeros
        unit = F.when(F.col("_n") > 1e-13 * F.greatest(F.abs(F.col("a")[0]), F.lit(1e-300)), F.col("_w") / F.col("_n")).otherwise(0.0)
        last = sides.select(*g, F.element_at("b", -1).alias("_n"), "a")
        longer = checkpoint(w.join(last, g).select(*g, "i", F.array_append("q", unit).alias("q")), "basis")
        discard(w, basis)
        basis = longer
    v = checkpoint(basis.join(found, g).select(*g, "i", _dot(F.col("y"), F.col("q")).alias("value"), "eigenvalue"), "vectors")
    off = v.join(times(m, v, F.col("value"), group), [*g, "i"], "left").withColumn("_e", F.coalesce("_w", F.lit(0.0)) - F.col("eigenvalue") * F.col("value"))
    residual = off.groupBy(*g).agg(F.sqrt(F.sum(F.col("_e") * F.col("_e"))).alias("residual"))
    return v.join(residual, g).select(*g, F.col("i").alias("bin"), "value", "eigenvalue", "residual")


def balance_newton(m: DataFrame, tolerance: float = 1e-9, outer: int = 20, inner: int = 40, group=GROUP) -> DataFrame:
    """(group, i, scale): the positive vector x with x_i * sum_j a_ij x_j = 1 for a full symmetric non-negative matrix, as `matrix.balance_roots` finds it, by the
    Newton steps of Knight and Ruiz with an inner conjugate gradient.

    A step solves (diag(x A x) + X A X) y = 1 - x A x, one join a gradient step, until the squared rest has fallen to a hundredth of the square of the outer one,
    and scales x by 1 + y, by a tenth at least so that it stays positive. It ends when every row sum of every group is within the tolerance of 1; groups that
    are there already stand still. Raises an error when `outer` steps do not suffice, as for a matrix without such a scaling. Rows without cells have none."""
    g = list(group)
    m = checkpoint(m.where("value > 0").select(*g, "i", "j", F.col("value").cast("double").alias("value")), "matrix")
    sums = m.groupBy(*g, "i").agg(F.sum("value").alias("_s"))
    total = sums.groupBy(*g).agg(F.sum("_s").alias("_t"), F.count("*").alias("_n"))
    # equal entries that make the mean row sum one
    x = checkpoint(sums.join(total, g).select(*g, "i", F.sqrt(F.col("_n") / F.col("_t")).alias("x")), "scales")
    for step in range(outer + 1):
        state = x.join(times(m, x, F.col("x"), group), [*g, "i"]).withColumn("v", F.col("x") * F.col("_w")).drop("_w")
        rest = 1 - F.col("v")
        state = checkpoint(state.select(*g, "i", "x", "v", F.lit(0.0).alias("y"), rest.alias("r"), rest.alias("p")), "state")
        far, first = state.agg(F.max(F.abs("r")), F.sum(F.col("r") * F.col("r"))).first()
        if far is None or far <= tolerance:
            return x.select(*g, "i", F.col("x").alias("scale"))
        if step == outer:
            raise ValueError(f"row sums are within {far:.3g} of one after {outer} steps, not {tolerance:.3g}")
        ap0, s0 = state, state
        for _ in range(inner):
            ap = state.join(times(m, state, F.col("x") * F.col("p"), group), [*g, "i"]).withColumn("_ap", F.col("v") * F.col("p") + F.col("x") * F.col("_w")).drop("_w")
            before, ap = (ap0, s0), checkpoint(ap, "gradient")
            discard(*before)
            s = ap.groupBy(*g).agg(*(F.sum(F.col(a) * F.col(b)).alias(n) for a, b, n in (("p", "_ap", "_pap"), ("r", "r", "_rr"), ("r", "_ap", "_rap"), ("_ap", "_ap", "_apap"))))
            s = s.withColumn("_alpha", F.when(F.col("_pap") > 0, F.col("_rr") / F.col("_pap")).otherwise(0.0))
            s = s.withColumn("_next", F.greatest(F.col("_rr") - 2 * F.col("_alpha") * F.col("_rap") + F.col("_alpha") * F.col("_alpha") * F.col("_apap"), F.lit(0.0)))
            s = checkpoint(s.select(*g, "_alpha", "_next", F.when(F.col("_rr") > 0, F.col("_next") / F.col("_rr")).otherwise(0.0).alias("_beta")), "scalars")
            r = F.col("r") - F.col("_alpha") * F.col("_ap")
            state = ap.join(s, g).select(*g, "i", "x", "v", (F.col("y") + F.col("_alpha") * F.col("p")).alias("y"), r.alias("r"), (r + F.col("_beta") * F.col("p")).alias("p"))
            ap0, s0 = ap, s
            if s.agg(F.sum("_next")).first()[0] <= max(1e-4 * first * min(first, 1.0), 1e-26):
                break
        x = checkpoint(state.select(*g, "i", (F.col("x") * F.greatest(1 + F.col("y"), F.lit(0.1))).alias("x")), "scales")
        discard(ap0, s0)
    raise AssertionError("unreachable")
