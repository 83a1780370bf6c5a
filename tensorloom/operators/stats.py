"""Statistics over groups: rank tests, fits, densities, correlations."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.functions.numeric import checkpoint, pearson, ranged, running_total


def mid_ranks(df: DataFrame, value: str, group: list[str], out: str, count: str | None = None) -> DataFrame:
    """Adds `out`, the rank from 1 within the group, ties sharing the mean of their places: a running total over the counts of distinct values. `count` says how often
    a row counts."""
    counted = running_total(df.groupBy(*group, value).agg((F.sum(count) if count else F.count("*")).alias("_c")), group, [F.col(value)], F.col("_c"), "_upto")
    return df.join(counted.select(*group, value, (F.col("_upto") - (F.col("_c") - 1) / 2).alias(out)), [*group, value])


def spearman(df: DataFrame, x: str, y: str, group: list[str], count: str | None = None) -> DataFrame:
    """(group, value): the correlation of the ranks of x and y; `count` says how often a row counts."""
    columns = [*group, F.col(x).alias("_a"), F.col(y).alias("_b"), *([F.col(count).alias("_times")] if count else [])]
    both = checkpoint(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*columns), "pairs")
    times = "_times" if count else None
    ranked = mid_ranks(mid_ranks(both, "_a", group, "_x", times), "_b", group, "_y", times)
    if not count:
        return ranked.groupBy(*group).agg(pearson("_x", "_y").alias("value"))
    # both means are half the number of rows and one more
    middle = (ranked.groupBy(*group).agg(F.sum("_times").alias("_rows"))).withColumn("_rows", (F.col("_rows") + 1) / 2)
    gaps = ranked.join(middle, group) if group else ranked.crossJoin(F.broadcast(middle))
    dx, dy, n = F.col("_x") - F.col("_rows"), F.col("_y") - F.col("_rows"), F.col("_times")
    return gaps.groupBy(*group).agg(F.try_divide(F.sum(n * dx * dy), F.sqrt(F.sum(n * dx * dx)) * F.sqrt(F.sum(n * dy * dy))).alias("value"))


def _largest_gaps(batches: Iterator[pd.DataFrame], at_once: int) -> Iterator[pd.DataFrame]:
    """Reads (_k, i, value, share) by range and value, each range led by a row a sample with a null value, its share of the ranges before: for each range the
    largest distance of the running shares of every two samples. Shares of `at_once` values are laid out at once."""
    names: dict = {}
    now = best = None
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = None

    def lay_out() -> None:
        nonlocal now, best
        if not held:
            return
        value, who, share = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        steps, row = np.unique(value, return_inverse=True)
        for lo in range(0, len(steps), at_once):
            inside = (row >= lo) & (row < lo + at_once)
            f = np.zeros((min(at_once, len(steps) - lo), len(names)))
            np.add.at(f, (row[inside] - lo, who[inside]), share[inside])
            f = np.cumsum(f, axis=0) + now
            now = f[-1].copy()
            for k in range(len(names) - 1):
                np.maximum(best[k, k + 1 :], np.abs(f[:, k + 1 :] - f[:, k : k + 1]).max(axis=0), out=best[k, k + 1 :])

    def result() -> pd.DataFrame:
        order, (a, b) = list(names), np.triu_indices(len(names), 1)
        return pd.DataFrame({"a": [order[k] for k in a], "b": [order[k] for k in b], "d": best[a, b]})

    for pdf in batches:
        for k, part in pdf.groupby("_k", sort=False):
            if k != at:
                if at is not None:
                    lay_out()
                    yield result()
                at, names, now, best = k, {}, None, None
            lead = part[part["value"].isna()]
            rest = part[part["value"].notna()]
            if len(lead):
                now = np.concatenate([[] if now is None else now, lead["share"].to_numpy(float)])
                for i in lead["i"]:
                    names[i] = len(names)
            if not len(rest):
                continue
            if best is None:
                best = np.zeros((len(names), len(names)))
            value = rest["value"].to_numpy(float)
            if held and value[0] != held[-1][0][-1] and sum(len(h[0]) for h in held) >= 4 * at_once:
                lay_out()
            held.append((value, np.fromiter((names[i] for i in rest["i"]), np.int64, len(rest)), rest["share"].to_numpy(float)))
    if at is not None:
        if best is None:
            best = np.zeros((len(names), len(names)))
        lay_out()
        yield result()


#: values whose running shares are laid out at once, by all samples
GAP_ROWS = 512


def ks_statistic(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance for pairs(i, j) of samples(i, value): (i, j, n, m, d).

    The values of all samples are put in one order, in ranges; a range takes the shares of the ranges before it and finds the largest distance of the running shares
    of every two samples inside. So a value moves once, however many partners its sample has, and what ranges pass on is a number a pair. Pairs in either
    order and with themselves are allowed; pairs with a sample that has no values are left out, as are null values."""
    # counts per value come first, so that copies of a value are one row
    counted = checkpoint(samples.where(F.col("value").isNotNull() & F.col("i").isNotNull()).groupBy("i", F.col("value").cast("double").alias("value")).agg(F.count("*").alias("k")), "counts")
    sizes = checkpoint(counted.groupBy("i").agg(F.sum("k").alias("n")), "sizes")
    parts = ranged(counted, [], [F.col("value")]).join(sizes, "i").withColumn("share", F.col("k") / F.col("n"))
    parts = checkpoint(parts.select("_k", "i", "value", "share"), "shares")
    grid = parts.select("_k").distinct().crossJoin(F.broadcast(sizes.select("i")))  # a row a sample and range
    sums = grid.join(parts.groupBy("_k", "i").agg(F.sum("share").alias("share")), ["_k", "i"], "left").fillna(0.0, ["share"])
    before = F.coalesce(F.sum("share").over(Window.partitionBy("i").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    lead = sums.select("_k", "i", F.lit(None).cast("double").alias("value"), before.alias("share"))
    laid = parts.unionByName(lead).repartition("_k").sortWithinPartitions("_k", F.asc_nulls_first("value"))
    kind = dict(samples.dtypes)["i"]
    gaps = laid.mapInPandas(lambda batches, n=GAP_ROWS: _largest_gaps(batches, n), f"a {kind}, b {kind}, d double").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("d").alias("d"))
    wanted = pairs.join(sizes, "i").join(sizes.select(F.col("i").alias("j"), F.col("n").alias("m")), "j")
    j = wanted.join(gaps, (F.least("i", "j") == F.col("a")) & (F.greatest("i", "j") == F.col("b")), "left")
    return j.where("d is not null or i = j").select("i", "j", "n", "m", F.coalesce("d", F.lit(0.0)).alias("d"))


def kolmogorov_tail(x: float) -> float:
    """The limiting chance that the scaled distance exceeds x."""
    if x <= 0:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


@functools.lru_cache(maxsize=100_000)
def ks_exact(n: int, m: int, d: float) -> float:
    """Chance that two samples of n and m from one distribution lie at least d apart: lattice paths from (0, 0) to (n, m) that stay within d, counted as
    shares, one diagonal of n + 1 points after another."""
    limit = d - 1e-9 / (n * m)
    i = np.arange(n + 1)
    share = np.where(i == 0, 1.0, 0.0) * (limit > 0)
    for s in range(1, n + m + 1):
        j = s - i
        stepped = share * j / s
        stepped[1:] += share[:-1] * i[1:] / s
        share = np.where((j >= 0) & (j <= m) & (np.abs(i / n - j / m) < limit), stepped, 0.0)
    return float(min(1.0, max(0.0, 1.0 - share[n])))


def ks_pvalues(d: DataFrame, exact_up_to: int = 10_000) -> DataFrame:
    """Adds `p`: exact for samples of at most `exact_up_to` values each, else the limiting series."""

    @F.pandas_udf("double")
    def p(n: pd.Series, m: pd.Series, x: pd.Series) -> pd.Series:
        out = []
        for a, b, v in zip(n, m, x, strict=True):
            out.append(ks_exact(int(a), int(b), v) if max(a, b) <= exact_up_to else kolmogorov_tail(v * math.sqrt(a * b / (a + b))))
        return pd.Series(out)

    return d.withColumn("p", p(F.col("n"), F.col("m"), F.col("d")))


def normal_tail(z: Column) -> Column:
    """Two-sided chance of a standard normal beyond |z|."""

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v == v else None).astype("float64")

    return tail(z)


def rank_sum(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Wilcoxon rank-sum of each gene for each group of cells(cell, grp) against the rest, for stored values > 0 of counts(cell, gene, value).

    Absent cells are zeros: they hold the lowest places, and their share of ranks and ties is added without laying them out. Returns
    (gene, grp, n1, n2, u, z, log_fold_change); z is tie-corrected and null where all values agree."""
    stored = counts.where("value > 0").join(cells, "cell").groupBy("gene", "value", "grp").agg(F.count("*").alias("k"))
    stored = checkpoint(stored, "stored")
    total = cells.agg(F.count("*").alias("N"))
    sizes = cells.groupBy("grp").agg(F.count("*").alias("n1"))
    distinct = stored.groupBy("gene", "value").agg(F.sum("k").alias("t"))
    ranks = running_total(distinct, ["gene"], [F.col("value")], F.col("t"), "_upto").withColumn("_r", F.col("_upto") - (F.col("t") - 1) / 2)
    ranks = checkpoint(ranks, "ranks")
    t = F.col("t")
    per_gene = ranks.groupBy("gene").agg(F.sum("t").alias("nz"), F.sum(t * F.col("value")).alias("all_sum"), F.sum(t * t * t - t).cast("double").alias("ties"))
    zeros = per_gene.crossJoin(F.broadcast(total)).withColumn("z0", F.col("N") - F.col("nz"))
    met = stored.join(ranks.select("gene", "value", "_r"), ["gene", "value"])
    sums = met.groupBy("gene", "grp").agg(F.sum(F.col("k") * F.col("_r")).alias("rs"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("value")).alias("own_sum"))
    grid = zeros.crossJoin(F.broadcast(sizes))  # a gene meets a few groups
    j = grid.join(sums, ["gene", "grp"], "left").fillna(0, ["rs", "k", "own_sum"])
    n2 = F.col("N") - F.col("n1")
    rank_of_group = F.col("rs") + F.col("k") * F.col("z0") + (F.col("n1") - F.col("k")) * (F.col("z0") + 1) / 2
    u = rank_of_group - F.col("n1") * (F.col("n1") + 1) / 2
    z0 = F.col("z0").cast("double")
    ties = F.col("ties") + z0 * z0 * z0 - z0
    big = F.col("N").cast("double")
    var = F.col("n1") * n2 / 12.0 * ((big + 1) - F.try_divide(ties, big * (big - 1)))
    z = F.try_divide(u - F.col("n1") * n2 / 2, F.sqrt(F.greatest(var, F.lit(0.0))))
    fold = F.log2(F.try_divide(F.col("own_sum"), F.col("n1")) + 1e-9) - F.log2(F.try_divide(F.col("all_sum") - F.col("own_sum"), n2) + 1e-9)
    return j.select("gene", "grp", "n1", n2.alias("n2"), u.alias("u"), z.alias("z"), fold.alias("log_fold_change"))


def benjamini_hochberg(df: DataFrame, p: str, group: list[str], order: list[str]) -> DataFrame:
    """Adds `p_adjusted`: the least of p * n / rank over this and later ranks, at most 1. Ranks and least values run inside ranges of p and are carried over
    from one range to the next."""
    by = [F.col(p), *(F.col(c) for c in order)]
    parts = ranged(df, group, by)
    sizes = parts.groupBy(*group, "_k").agg(F.count("*").alias("_rows"), F.count(p).alias("_known"))
    w = Window.partitionBy(*group)
    ahead = F.coalesce(F.sum("_rows").over(w.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*group, "_k", ahead.alias("_before"), F.sum("_known").over(w).alias("_n"))
    inside = Window.partitionBy(*group, "_k").orderBy(*by)
    step = parts.withColumn("_i", F.row_number().over(inside)).join(sizes, [*group, "_k"])
    step = checkpoint(step.withColumn("_s", F.col(p) * F.col("_n") / (F.col("_i") + F.col("_before"))), "steps")
    least = step.groupBy(*group, "_k").agg(F.min("_s").alias("_m"))
    later = least.select(*group, "_k", F.min("_m").over(w.orderBy("_k").rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    # from the end backwards: a frame that grows costs one step a row, one that shrinks costs its length
    onward = Window.partitionBy(*group, "_k").orderBy(F.desc(p), *(F.desc(c) for c in order))
    own = F.min("_s").over(onward.rowsBetween(Window.unboundedPreceding, 0))
    out = step.withColumn("_own", own).join(later, [*group, "_k"]).withColumn("p_adjusted", F.least("_own", "_later", F.lit(1.0)))
    return out.drop("_k", "_i", "_before", "_n", "_s", "_own", "_later")


def linear_fit(df: DataFrame, x: str, y: str, group: list[str]) -> DataFrame:
    """(group, slope, intercept) by least squares; null where x is constant."""
    slope = F.try_divide(F.covar_pop(y, x), F.var_pop(x))
    return df.groupBy(*group).agg(slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"))


def hist2d(df: DataFrame, x: str, y: str, cells: int = 20) -> DataFrame:
    """(cx, cy, density): shares per area over an even grid from least to largest; the largest values fall in the last cell."""
    b = df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"), F.count("*").alias("_n"))
    wx, wy = (F.col("_x1") - F.col("_x0")) / cells, (F.col("_y1") - F.col("_y0")) / cells
    cx = F.least(F.floor((F.col(x) - F.col("_x0")) / wx), F.lit(cells - 1)).cast("long")
    cy = F.least(F.floor((F.col(y) - F.col("_y0")) / wy), F.lit(cells - 1)).cast("long")
    laid = df.crossJoin(F.broadcast(b)).select(cx.alias("cx"), cy.alias("cy"), (F.lit(1.0) / (F.col("_n") * wx * wy)).alias("_d"))
    return laid.groupBy("cx", "cy").agg(F.sum("_d").alias("density"))


def group_stats(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def welch_t(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    """Welch's t and degrees of freedom from two group_stats tables."""
    j = a.select(*group, F.col("n").alias("n1"), F.col("mean").alias("m1"), (F.col("var") / F.col("n")).alias("s1")).join(
        b.select(*group, F.col("n").alias("n2"), F.col("mean").alias("m2"), (F.col("var") / F.col("n")).alias("s2")), group
    )
    s = F.col("s1") + F.col("s2")
    df = F.try_divide(s * s, F.try_divide(F.col("s1") * F.col("s1"), F.col("n1") - 1) + F.try_divide(F.col("s2") * F.col("s2"), F.col("n2") - 1))
    return j.select(*group, F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(s)).alias("t"), df.alias("df"))


def student_tail(t: float, df: float) -> float:
    """Two-sided chance of Student's t beyond |t|: the regularised incomplete beta by its continued fraction."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(x, a, b) / a
    return 1 - front * _fraction(1 - x, b, a) / b


def _fraction(x: float, a: float, b: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def t_pvalue(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def p(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([student_tail(a, b) if a == a and b == b else None for a, b in zip(x, n, strict=True)], dtype="float64")

    return p(t, df)


#: pairs of a query and a point whose kernel is laid out at once
KERNEL_TILE = 65_536


def density_2d(points: DataFrame, at: DataFrame) -> DataFrame:
    """Gaussian kernel density of points(x, y) at at(id, x, y), with the full covariance times n^(-1/3).

    Every query place meets every place of a point, which the kernel asks for: equal places are counted first, then strips of queries meet streams of points, a tile
    at a time, and sums of the parts of the points are added up. Coordinates are turned so that the kernel is the standard normal one. Rows without x or y
    count in n only; a query without them has no density, nor has any where the points don't spread in two directions."""
    from tensorloom.operators.neighbours import strips_and_parts

    x, y = F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")
    c = points.agg(F.count("*").alias("n"), F.var_samp("x").alias("a"), F.var_samp("y").alias("b"), F.covar_samp("x", "y").alias("c"), F.avg("x").alias("mx"), F.avg("y").alias("my")).first()
    if not c["n"]:
        return at.select("id", F.lit(None).cast("double").alias("density")).limit(0)
    rest = c["b"] - c["c"] * c["c"] / c["a"] if c["a"] and c["b"] is not None else None
    if rest is None or rest <= 0:
        return at.select("id").distinct().withColumn("density", F.lit(None).cast("double"))
    h, slope = c["n"] ** (-1.0 / 6), c["c"] / c["a"]
    sx, sy, mx, my = math.sqrt(c["a"]) * h, math.sqrt(rest) * h, c["mx"], c["my"]
    scale = c["n"] * 2 * math.pi * sx * sy
    known = "x is not null and y is not null"
    counted = checkpoint(points.where(known).groupBy(x, y).agg(F.count("*").cast("double").alias("w")), "points")
    asked = checkpoint(at.where(known).select(x, y).distinct(), "queries")
    strips, parts = strips_and_parts(points.sparkSession, asked.count(), counted.count(), 65_536)
    own = lambda n: F.pmod(F.xxhash64("x", "y"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    queries = asked.withColumn("_p", each(parts)).select((own(strips) * parts + F.col("_p")).alias("_k"), F.lit(0).alias("_kind"), "x", "y", F.lit(0.0).alias("w"))
    met = counted.withColumn("_s", each(strips)).select((F.col("_s") * parts + own(parts)).alias("_k"), F.lit(1).alias("_kind"), "x", "y", "w")
    laid = queries.unionByName(met).repartition(strips * parts, "_k").sortWithinPartitions("_k", "_kind")

    def turned(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        dx = rows["x"].to_numpy(float) - mx
        return dx / sx, (rows["y"].to_numpy(float) - my - slope * dx) / sy

    def sums(batches: Iterator[pd.DataFrame], tile: int = KERNEL_TILE) -> Iterator[pd.DataFrame]:
        key, strip, total = None, [], None

        def result() -> Iterator[pd.DataFrame]:
            if total is not None:
                yield pd.concat(strip)[["x", "y"]].assign(density=total / scale)

        for pdf in batches:
            for k, of in pdf.groupby("_k", sort=False):
                if k != key:
                    yield from result()
                    key, strip, total = k, [], None
                new = of[of["_kind"] == 0]
                if len(new):
                    strip.append(new)
                rest = of[of["_kind"] == 1]
                if not len(rest) or not strip:
                    continue
                if total is None:
                    u, v = turned(pd.concat(strip))
                    total = np.zeros(len(u))
                pu, pv, w = *turned(rest), rest["w"].to_numpy(float)
                step = max(1, tile // len(pu))
                for lo in range(0, len(u), step):
                    d = u[lo : lo + step, None] - pu
                    d *= d
                    e = v[lo : lo + step, None] - pv
                    e *= e
                    d += e
                    d *= -0.5
                    total[lo : lo + step] += np.exp(d, out=d) @ w
        yield from result()

    found = laid.mapInPandas(sums, "x double, y double, density double").groupBy("x", "y").agg(F.sum("density").alias("density"))
    return at.select("id", x, y).join(found, ["x", "y"], "left").groupBy("id").agg(F.sum("density").alias("density"))


def density_grid(points: DataFrame, width: float = 0.125, reach: float = 5.0) -> DataFrame:
    """(id, density): the Gaussian kernel density of points(id, x, y) at every one of them, with the bandwidth of `density_2d` (Scott's rule, full covariance).

    Coordinates are turned so that the kernel is the standard normal one, and laid on a grid of cells `width` wide. A cell keeps its count and the first and second
    moments of its points around its centre. The kernel is a product over the two axes, so the moments are convolved with it and its derivatives along one axis
    and then along the other, over `reach` to either side; a point then takes the second-order expansion around the centre of its cell. Nothing meets in pairs of
    points: a cell is laid out 2 * reach / width + 1 times an axis.

    Error of a density, as a share of the kernel's peak and of all points: at most 1.4 * (sqrt(2) * width)**3 / 6 + exp(-(reach - width)**2 / 2), 0.0013 with the
    defaults; as the third-order terms mostly cancel it is far less. Rows without x or y are left out; without a spread in two directions densities are null.
    """
    known = checkpoint(points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "points")
    k = known.agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("a"), F.var_samp("y").alias("b"), F.covar_samp("x", "y").alias("c")
    ).withColumn("h", F.pow(F.col("n").cast("double"), F.lit(-1.0 / 6)))
    # the covariance as a product of triangular factors: u along x, v along what x leaves of y
    k = k.withColumn("sx", F.sqrt("a") * F.col("h")).withColumn("slope", F.try_divide("c", F.col("a")))
    k = k.withColumn("sy", F.sqrt(F.greatest(F.col("b") - F.col("slope") * F.col("c"), F.lit(0.0))) * F.col("h"))
    placed = known.crossJoin(F.broadcast(k)).withColumn("u", F.try_divide(F.col("x") - F.col("mx"), F.col("sx")))
    placed = placed.withColumn("v", F.try_divide(F.col("y") - F.col("my") - F.col("slope") * (F.col("x") - F.col("mx")), F.col("sy")))
    for axis, cell, off in (("u", "cu", "eu"), ("v", "cv", "ev")):
        placed = placed.withColumn(cell, F.floor(F.col(axis) / width)).withColumn(off, F.col(axis) - (F.col(cell) + 0.5) * width)
    placed = checkpoint(placed.select("id", "n", (2 * math.pi * F.col("sx") * F.col("sy")).alias("area"), "cu", "cv", "eu", "ev"), "cells")
    eu, ev = F.col("eu"), F.col("ev")
    cells = checkpoint(
        placed.where("cu is not null and cv is not null").groupBy("cu", "cv").agg(
            F.count("*").cast("double").alias("m"), F.sum(eu).alias("mu"), F.sum(ev).alias("mv"), F.sum(eu * eu).alias("muu"), F.sum(eu * ev).alias("muv"), F.sum(ev * ev).alias("mvv")
        ), "moments",
    )
    steps = F.explode(F.sequence(F.lit(-math.ceil(reach / width)), F.lit(math.ceil(reach / width))))
    z = F.col("step") * width
    g = F.exp(-z * z / 2)
    g1, g2 = -z * g, (z * z - 1) * g

    def laid(axis: str) -> DataFrame:
        return cells.withColumn("step", steps).withColumn("to", F.col(axis) + F.col("step"))

    along = {"m0": F.col("m") * g, "m1": F.col("m") * g1, "m2": F.col("m") * g2, "u1": F.col("mu") * g1, "u2": F.col("mu") * g2, "v0": F.col("mv") * g, "v1": F.col("mv") * g1,
             "uu2": F.col("muu") * g2, "uv1": F.col("muv") * g1, "vv0": F.col("mvv") * g}
    first = laid("cu").groupBy(F.col("to").alias("cu"), "cv").agg(*(F.sum(e).alias(n) for n, e in along.items()))
    # only columns of cells that hold points, and rows near to them, are asked for
    asked = cells.select("cu", F.col("cv").alias("at")).withColumn("step", steps).withColumn("cv", F.col("at") - F.col("step"))
    met = asked.join(first, ["cu", "cv"])
    c = F.col
    terms = {
        "f": c("m0") * g - c("u1") * g - c("v0") * g1 + c("uu2") * g / 2 + c("uv1") * g1 + c("vv0") * g2 / 2,
        "fu": c("m1") * g - c("u2") * g - c("v1") * g1, "fv": c("m0") * g1 - c("u1") * g1 - c("v0") * g2,
        "fuu": c("m2") * g, "fuv": c("m1") * g1, "fvv": c("m0") * g2,
    }
    field = met.groupBy("cu", F.col("at").alias("cv")).agg(*(F.sum(e).alias(n) for n, e in terms.items()))
    value = c("f") + eu * c("fu") + ev * c("fv") + eu * eu * c("fuu") / 2 + eu * ev * c("fuv") + ev * ev * c("fvv") / 2
    return placed.join(field, ["cu", "cv"], "left").select("id", F.try_divide(value, c("n") * c("area")).alias("density"))



def pearson_pairs(rows: DataFrame, group: list[str]) -> DataFrame:
    """log10(1 + r + 1e-10) for pairs i <= j of row arrays rows(group, i, x); r is 0 where a row is constant."""
    from tensorloom.operators.matrix import centred, dot, strip_join

    n = F.size("x")
    c = checkpoint(rows.withColumn("x", centred(F.col("x"), n)).withColumn("_q", F.sqrt(dot(F.col("x"), F.col("x")))), "rows")
    other = c.select(*group, F.col("i").alias("j"), F.col("x").alias("y"), F.col("_q").alias("_p"))
    r = F.coalesce(F.try_divide(dot(F.col("x"), F.col("y")), F.col("_q") * F.col("_p")), F.lit(0.0))
    return strip_join(c, other, "i", "j", group).select(*group, "i", "j", F.log10(1 + r + 1e-10).alias("value"))


