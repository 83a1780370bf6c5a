"""Contact matrices as tables (sample, chrom, i, j, value): build, symmetrise, weigh, normalise, correlate, balance.

An upper triangle holds i <= j; what is absent is zero. `group` names the columns that tell matrices apart, so all of them run in one job.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.functions.numeric import checkpoint
from tensorloom.operators.tiles import row_products

GROUP = ("sample", "chrom")
STRIP = 64


def bin_pairs(pairs: DataFrame, resolution: int) -> DataFrame:
    """Contact pairs(sample, chrom, pos1, pos2) counted per pair of bins, upper triangle."""
    a, b = (F.floor(F.col(c) / resolution).cast("long") for c in ("pos1", "pos2"))
    return pairs.groupBy("sample", "chrom", F.least(a, b).alias("i"), F.greatest(a, b).alias("j")).agg(F.count("*").cast("double").alias("value"))


def symmetrize(m: DataFrame, group=GROUP) -> DataFrame:
    """The full matrix of an upper triangle: off-diagonal cells mirrored, duplicates summed."""
    own, flipped = F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    both = m.select(*group, F.explode(F.when(F.col("i") == F.col("j"), F.array(own)).otherwise(F.array(own, flipped))).alias("_c"), "value")
    return both.groupBy(*group, "_c.i", "_c.j").agg(F.sum("value").alias("value"))


def emphasize(m: DataFrame, cap: int, plus: int = 1) -> DataFrame:
    """Cells weighed by their distance from the diagonal up to `cap`, plus one; plus=0 leaves the diagonal out."""
    weight = plus + F.least(F.abs(F.col("i") - F.col("j")), F.lit(cap))
    return m.withColumn("value", F.col("value") * weight).where("value != 0")


def row_stats(m: DataFrame, n: int, group=GROUP) -> DataFrame:
    """(group, i, mu, sd) over all n cells of each row of a full matrix, absent cells as zeros."""
    s = m.groupBy(*group, "i").agg(F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_q"))
    mu = F.col("_s") / n
    return s.select(*group, "i", mu.alias("mu"), F.sqrt(F.greatest(F.col("_q") / n - mu * mu, F.lit(0.0))).alias("sd"))


def sparse_pearson(m: DataFrame, n: int, group=GROUP, floor: float = 0.0) -> DataFrame:
    """Correlation-like matrix of the rows of a full matrix: stored cells standardised by their row's mean and deviation over n cells (absent cells stay
    zero), products over shared columns, scaled to a unit diagonal; upper triangle. Rows without deviation give nothing, or are floored.

    The products are made by dense tiles (`tiles.row_products`).
    """
    m = checkpoint(m, "matrix")
    stats = row_stats(m, n, group)
    sd = F.greatest(F.col("sd"), F.lit(floor)) if floor else F.col("sd")
    z = m.join(stats, [*group, "i"]).where(sd > 0).select(*group, "i", "j", ((F.col("value") - F.col("mu")) / sd).alias("z"))
    z = checkpoint(z, "standardised")
    dots = row_products(z.withColumnRenamed("z", "value"), n, group).withColumnRenamed("j", "i2").withColumnRenamed("value", "dot")
    norms = z.groupBy(*group, F.col("i").alias("_k")).agg(F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("_n"))
    a = norms.select(*group, F.col("_k").alias("i"), F.col("_n").alias("na"))
    b = norms.select(*group, F.col("_k").alias("i2"), F.col("_n").alias("nb"))
    c = F.coalesce(F.try_divide("dot", F.col("na") * F.col("nb")), F.lit(0.0))
    return dots.join(a, [*group, "i"]).join(b, [*group, "i2"]).select(*group, "i", F.col("i2").alias("j"), c.alias("value"))


def rows_as_arrays(m: DataFrame, n: int, group=GROUP) -> DataFrame:
    """(group, i, x): each row of a full matrix as an array of n numbers."""
    cells = m.groupBy(*group, "i").agg(F.map_from_entries(F.collect_list(F.struct(F.col("j").cast("int"), "value"))).alias("_m"))
    return cells.select(*group, "i", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(F.try_element_at("_m", j), F.lit(0.0))).alias("x"))


def centred(x: Column, n: int) -> Column:
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    return F.transform(x, lambda v: v - mean)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)


def strip_join(left: DataFrame, right: DataFrame, a: str, b: str, group=GROUP) -> DataFrame:
    """Pairs a <= b of the rows of each matrix. The left rows lie in strips of STRIP; a right row goes to each strip up to its own, so the rows of one matrix meet in
    as many groups as it has strips, and none holds more than STRIP rows against the rest."""
    own = left.withColumn("_strip", F.floor(F.col(a) / STRIP))
    laid = right.withColumn("_strip", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col(b) / STRIP))))
    return own.join(laid, [*group, "_strip"]).where(F.col(a) <= F.col(b)).drop("_strip")


def corr_matrix(m: DataFrame, n: int, group=GROUP, shift: bool = False) -> DataFrame:
    """Pearson correlation of all pairs of rows of a full matrix, upper triangle; null where a row is constant. shift: raised by the matrix's
    minimum when that is negative."""
    dots = checkpoint(row_products(m, n, group, centre=True), "products")
    own = dots.where("i = j").select(*group, "i", F.sqrt("value").alias("_q"))
    other = own.select(*group, F.col("i").alias("j"), F.col("_q").alias("_r"))
    out = dots.join(own, [*group, "i"]).join(other, [*group, "j"]).select(*group, "i", "j", F.try_divide("value", F.col("_q") * F.col("_r")).alias("value"))
    return shift_min(out, group) if shift else out


def shift_min(m: DataFrame, group=GROUP) -> DataFrame:
    """Values raised by the group's minimum where that is negative."""
    m = checkpoint(m, "values")
    low = m.groupBy(*group).agg(F.greatest(-F.min("value"), F.lit(0.0)).alias("_low"))
    return m.join(low, list(group)).withColumn("value", F.col("value") + F.col("_low")).drop("_low")


def normalize(m: DataFrame, by: list[str]) -> DataFrame:
    """Values over the L2 norm of their group; all-zero groups stay zero."""
    m = checkpoint(m, "values")
    norm = m.groupBy(*by).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_norm"))
    return m.join(norm, by).withColumn("value", F.coalesce(F.try_divide("value", F.col("_norm")), F.lit(0.0))).drop("_norm")


def normalize_strict(m: DataFrame, by: list[str]) -> DataFrame:
    """As normalize, with an error for a group of norm zero."""
    m = checkpoint(m, "values")
    norm = m.groupBy(*by).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_norm"))
    checked = F.when(F.col("_norm") > 0, F.col("value") / F.col("_norm")).otherwise(F.raise_error(F.lit("a vector of norm zero")).cast("double"))
    return m.join(norm, by).withColumn("value", checked).drop("_norm")


def normalize_rows_sum1(m: DataFrame, by: list[str]) -> DataFrame:
    total = F.sum("value").over(Window.partitionBy(*by))
    return m.withColumn("value", F.coalesce(F.try_divide("value", total), F.lit(0.0)))


def outer_product(v: DataFrame, group=GROUP, limit: int | None = None) -> DataFrame:
    """The centred vector times itself, upper triangle; groups of more than `limit` bins are left out if a limit is given."""
    w = Window.partitionBy(*group)
    c = v.withColumn("_c", F.col("value") - F.avg("value").over(w))
    if limit is not None:
        c = c.withColumn("_n", F.count("*").over(w)).where(F.col("_n") <= limit)
    c = checkpoint(c, "vectors")
    a = c.select(*group, F.col("bin").alias("i"), F.col("_c").alias("a"))
    b = c.select(*group, F.col("bin").alias("j"), F.col("_c").alias("b"))
    return strip_join(a, b, "i", "j", group).select(*group, "i", "j", (F.col("a") * F.col("b")).alias("value"))


def observed_over_expected(m: DataFrame, n: int, group=GROUP) -> DataFrame:
    """Upper-triangle cells over the mean of their diagonal, absent cells counted as zeros."""
    m = checkpoint(m, "matrix")
    d = F.col("j") - F.col("i")
    mean = m.groupBy(*group, d.alias("_d")).agg((F.sum("value") / (F.lit(n) - F.first(d))).alias("_e"))
    return m.withColumn("_d", d).join(mean, [*group, "_d"]).withColumn("value", F.try_divide("value", F.col("_e"))).drop("_d", "_e")


def balance(m: DataFrame, steps: int, group=GROUP, cut_every: int = 5, tolerance: float = 0.0) -> DataFrame:
    """Iterative correction of a full matrix: cells over the product of their row's and column's sums, each over the mean row sum, at most `steps` times. With a
    tolerance it ends when no row sum of any matrix is further than that from its mean, relatively."""
    m = checkpoint(m, "matrix")
    for k in range(steps):
        s = m.groupBy(*group, "i").agg(F.sum("value").alias("_s"))
        b = s.select(*group, "i", (F.col("_s") / F.avg("_s").over(Window.partitionBy(*group))).alias("_b"))
        if tolerance:
            b = checkpoint(b, "bias")
            far = b.agg(F.max(F.abs(F.col("_b") - 1))).first()[0]
            if far is None or far <= tolerance:
                break
        c = b.select(*group, F.col("i").alias("j"), F.col("_b").alias("_c"))
        m = m.join(b, [*group, "i"]).join(c, [*group, "j"]).select(*group, "i", "j", F.try_divide("value", F.col("_b") * F.col("_c")).alias("value"))
        if (k + 1) % (1 if tolerance else cut_every) == 0 and k + 1 < steps:
            m = checkpoint(m, "matrix")
    return m


def balance_roots(m: DataFrame, steps: int, group=GROUP, tolerance: float = 1e-6) -> DataFrame:
    """(group, i, scale): the vector x with x_i * sum_j a_ij x_j = 1 for a full symmetric matrix, the scaling whose cells a_ij x_i x_j have unit row sums. Damped
    fixed-point steps x <- sqrt(x / (A x)) until no row is further than the tolerance from 1; rows without cells have none."""
    m = checkpoint(m.where("value > 0"), "matrix")
    x = m.select(*group, "i").distinct().withColumn("scale", F.lit(1.0))
    for _ in range(steps):
        moved = m.join(x.select(*group, F.col("i").alias("j"), F.col("scale").alias("_x")), [*group, "j"])
        sums = moved.groupBy(*group, "i").agg(F.sum(F.col("value") * F.col("_x")).alias("_a"))
        x = checkpoint(x.join(sums, [*group, "i"]).withColumn("_r", F.col("scale") * F.col("_a")), "scales")
        far = x.agg(F.max(F.abs(F.col("_r") - 1))).first()[0]
        if far is None or far <= tolerance:
            break
        x = x.select(*group, "i", F.sqrt(F.col("scale") / F.col("_a")).alias("scale"))
    return x.select(*group, "i", "scale")


def leading_eigenvector(m: DataFrame, steps: int, group=GROUP, cut_every: int = 5, tolerance: float = 0.0) -> DataFrame:
    """Power iteration on a full symmetric matrix from a vector of ones, at most `steps` times: (group, bin, value) of unit length. With a tolerance it ends when no
    entry moves by more than that. The sign is open: `compartments.orient` turns it by a mark."""
    m = checkpoint(m, "matrix")
    v = m.select(*group, F.col("i").alias("bin")).distinct().withColumn("value", F.lit(1.0))
    for k in range(steps):
        moved = m.join(v.select(*group, F.col("bin").alias("j"), F.col("value").alias("_v")), [*group, "j"])
        new = normalize(moved.groupBy(*group, F.col("i").alias("bin")).agg(F.sum(F.col("value") * F.col("_v")).alias("value")), list(group))
        if tolerance:
            new = checkpoint(new, "vector")
            far = new.join(v.withColumnRenamed("value", "_v"), [*group, "bin"]).agg(F.max(F.abs(F.col("value") - F.col("_v")))).first()[0]
            v = new
            if far is None or far <= tolerance:
                break
        else:
            v = checkpoint(new, "vector") if (k + 1) % cut_every == 0 and k + 1 < steps else new
    return v


def squared(m: DataFrame, group=GROUP) -> DataFrame:
    """A full symmetric matrix times itself, whose largest eigenvalue is never negative, so power iteration settles."""
    m = checkpoint(m, "matrix")
    other = m.select(*group, F.col("i").alias("j"), F.col("j").alias("k"), F.col("value").alias("_o"))
    return m.join(other, [*group, "j"]).groupBy(*group, "i", F.col("k").alias("j")).agg(F.sum(F.col("value") * F.col("_o")).alias("value"))


def impute(m: DataFrame, n: int, restart: float = 0.5, steps: int = 1, pad: int = 1, top: int | None = None, group=GROUP, std: float | None = None, sqrtvc: bool = False) -> DataFrame:
    """A full matrix smoothed over (2 pad + 1)² cells by their mean, or by a Gaussian of deviation `std`, made a transition matrix P, and walked:
    Q = (1 - restart) Q P + restart I, only the `top` cells of a row kept where given. sqrtvc: cells of Q over the roots of their row's and column's sums."""
    side = F.sequence(F.lit(-pad), F.lit(pad))
    weigh = (lambda a: math.exp(-a * a / (2 * std * std))) if std else (lambda a: 1.0)
    whole = sum(weigh(a) for a in range(-pad, pad + 1)) ** 2
    share = (F.exp(-(F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b")) / (2 * std * std)) if std else F.lit(1.0)) / whole
    wide = m.withColumn("_a", F.explode(side)).withColumn("_b", F.explode(side)).select(*group, (F.col("i") + F.col("_a")).alias("i"), (F.col("j") + F.col("_b")).alias("j"), (F.col("value") * share).alias("value"))
    smooth = wide.where(F.col("i").between(0, n - 1) & F.col("j").between(0, n - 1)).groupBy(*group, "i", "j").agg(F.sum("value").alias("value"))
    p = checkpoint(normalize_rows_sum1(smooth, [*group, "i"]))
    eye = p.select(*group, "i").distinct().select(*group, "i", F.col("i").alias("j"), F.lit(1.0).alias("value"))
    q = eye
    for k in range(steps):
        moved = q.select(*group, "i", F.col("j").alias("k"), F.col("value").alias("q")).join(p.select(*group, F.col("i").alias("k"), "j", F.col("value").alias("p")), [*group, "k"])
        walked = moved.groupBy(*group, "i", "j").agg((F.sum(F.col("q") * F.col("p")) * (1 - restart)).alias("value"))
        q = walked.unionByName(eye.withColumn("value", F.lit(restart))).groupBy(*group, "i", "j").agg(F.sum("value").alias("value"))
        if top is not None:
            w = Window.partitionBy(*group, "i").orderBy(F.desc("value"), "j")
            q = q.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")
        if k + 1 < steps:
            q = checkpoint(q)
    if sqrtvc:
        q = checkpoint(q)
        rows = q.groupBy(*group, "i").agg(F.sum("value").alias("_r"))
        columns = q.groupBy(*group, "j").agg(F.sum("value").alias("_c"))
        q = q.join(rows, [*group, "i"]).join(columns, [*group, "j"]).select(*group, "i", "j", F.try_divide("value", F.sqrt(F.col("_r") * F.col("_c"))).alias("value"))
    return q


def neighbourhood(m: DataFrame, width: int, group=GROUP) -> DataFrame:
    """The cells within `width` of a non-zero cell, as (group, i, j): each cell lays out its square, an equality instead of a range condition."""
    side = F.sequence(F.lit(-width), F.lit(width))
    out = m.where("value != 0").withColumn("_a", F.explode(side)).withColumn("_b", F.explode(side))
    return out.select(*group, (F.col("i") + F.col("_a")).alias("i"), (F.col("j") + F.col("_b")).alias("j")).distinct()


def mask_neighbourhood(values: DataFrame, m: DataFrame, width: int, group=GROUP) -> DataFrame:
    return values.join(neighbourhood(m, width, group), [*group, "i", "j"], "left_semi")


def short_score_lines(m: DataFrame, resolution: int) -> DataFrame:
    """(value): one text line per non-zero cell of the upper triangle."""
    line = F.format_string("0 %s %d 0 0 %s %d 1 %.5f", "chrom", F.col("i") * resolution, "chrom", F.col("j") * resolution, "value")
    return m.where("i <= j and value != 0").select(line.alias("value"))


def weighted_rows(m: DataFrame, density: DataFrame, average: bool = False, group=GROUP) -> DataFrame:
    """The rows of a full matrix times a density per bin(chrom, bin, value), over the row's sum if average: (group, bin, value)."""
    d = density.select("chrom", F.col("bin").alias("j"), F.col("value").alias("_d"))
    s = F.sum(F.col("value") * F.col("_d"))
    return m.join(d, ["chrom", "j"]).groupBy(*group, F.col("i").alias("bin")).agg((F.try_divide(s, F.sum("value")) if average else s).alias("value"))


def stats(m: DataFrame, n: int, group=GROUP) -> DataFrame:
    """Least and largest value, non-zero cells, Frobenius norm and mean over all n² cells."""
    filled = F.count("*") >= n * n
    return m.groupBy(*group).agg(
        F.when(filled, F.min("value")).otherwise(F.least(F.min("value"), F.lit(0.0))).alias("low"), F.when(filled, F.max("value")).otherwise(F.greatest(F.max("value"), F.lit(0.0))).alias("high"),
        F.count_if(F.col("value") != 0).alias("nonzero"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), (F.sum("value") / (n * n)).alias("mean"),
    )
