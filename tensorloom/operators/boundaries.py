"""Domain boundaries on per-bin curves: extrema, crossings, insulation, smoothing. `group` tells curves apart; bins are consecutive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.functions.numeric import pearson


def _w(group: list[str]):
    return Window.partitionBy(*group).orderBy("bin")


def _after(group: list[str]):
    """The rows behind this one, nearest last: a frame that grows backwards costs one step a row."""
    return Window.partitionBy(*group).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)


def local_extrema(curve: DataFrame, group: list[str]) -> DataFrame:
    """Adds `extremum`: "min" or "max" where the value is strictly below or above both neighbours; the ends have none."""
    w = _w(group)
    before, after = F.lag("value").over(w), F.lead("value").over(w)
    kind = F.when((F.col("value") < before) & (F.col("value") < after), "min").when((F.col("value") > before) & (F.col("value") > after), "max")
    return curve.withColumn("extremum", kind)


def neighbours_of_minima(curve: DataFrame, group: list[str]) -> DataFrame:
    """(group, bin, value, left_max, right_min, left_value, right_value) of each minimum: bin and value of the last maximum before and of the next
    minimum after it, null where there is none."""
    w = _w(group)
    e = local_extrema(curve, group)
    top, low = F.struct("bin", "value"), F.struct("bin", "value")
    left = F.last(F.when(F.col("extremum") == "max", top), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    right = F.last(F.when(F.col("extremum") == "min", low), True).over(_after(group))
    out = e.withColumn("_l", left).withColumn("_r", right).where("extremum = 'min'")
    return out.select(*group, "bin", "value", F.col("_l.bin").alias("left_max"), F.col("_r.bin").alias("right_min"), F.col("_l.value").alias("left_value"), F.col("_r.value").alias("right_value"))


def filter_minima(curve: DataFrame, group: list[str], least: float, by: str = "value") -> DataFrame:
    """(group, bin, strength): minima whose left maximum less right minimum is over `least`; 0 where either is absent. by="index" subtracts bins."""
    m = neighbours_of_minima(curve, group)
    a, b = ("left_value", "right_value") if by == "value" else ("left_max", "right_min")
    return m.select(*group, "bin", F.coalesce((F.col(a) - F.col(b)).cast("double"), F.lit(0.0)).alias("strength")).where(F.col("strength") > least)


def minima_flags(curve: DataFrame, group: list[str]) -> DataFrame:
    m = neighbours_of_minima(curve, group)
    return m.select(*group, "bin", F.col("left_max").isNotNull().alias("has_left"), F.col("right_min").isNotNull().alias("has_right"))


def boundaries_scan(curve: DataFrame, group: list[str], reach: int = 5, least: float = 0.2) -> DataFrame:
    """(group, bin, strength): minima where the largest of the `reach` values before less the smallest of this and the reach - 1 after is at least `least`;
    within the first `reach` bins the own value stands for the largest."""
    w = _w(group)
    before = F.when(F.col("bin") <= reach, F.col("value")).otherwise(F.max("value").over(w.rowsBetween(-reach, -1)))
    after = F.min("value").over(w.rowsBetween(0, reach - 1))
    e = local_extrema(curve, group).withColumn("strength", before - after)
    return e.where((F.col("extremum") == "min") & (F.col("strength") >= least)).select(*group, "bin", "strength")


def boundaries_delta(curve: DataFrame, group: list[str]) -> DataFrame:
    """(group, bin, strength): where the difference to the next bin changes sign between neighbours; strength is the largest difference before less the
    smallest after, 0 standing for none."""
    w = _w(group)
    d = curve.withColumn("_d", F.lead("value").over(w) - F.col("value")).where("_d is not null")
    change = (F.signum("_d") != F.signum(F.lead("_d").over(w))) & F.lead("_d").over(w).isNotNull()
    top = F.coalesce(F.max("_d").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    low = F.coalesce(F.min("_d").over(_after(group)), F.lit(0.0))
    return d.select(*group, "bin", change.alias("_c"), (top - low).alias("strength")).where("_c").drop("_c")


def moving_average(group: list[str], k: int) -> Column:
    """Mean over k bins around, zeros beyond the ends, always over k."""
    return F.sum("value").over(_w(group).rowsBetween(-(k // 2), (k - 1) // 2)) / k


def insulation(m: DataFrame, width: int, n: int, group: list[str]) -> DataFrame:
    """(group, bin, value): `insulation_windows` for one width."""
    return insulation_windows(m, [width], n, group).drop("width")


def insulation_windows(m: DataFrame, widths: list[int], n: int, group: list[str]) -> DataFrame:
    """(group, width, bin, value): log2 of the contacts across each bin start, rows in [b - width, b), columns in [b, b + width), over the mean of the group and
    width; bins near the ends and bins without contacts have none.

    The bins that a cell above the diagonal counts for follow one another, so a cell is two steps, up where they begin and down behind them, however wide the window;
    steps are summed by bin with map-side combine, and a running sum over the bins of a group gives the windows. Cells are counted beside their values, so
    a bin without contacts is told exactly."""
    low = lambda w: F.greatest(F.col("i") + 1, F.col("j") - w + 1)
    high = lambda w: F.least(F.col("j"), F.col("i") + w)
    steps = []
    for w in widths:
        for at, sign in ((low(w), 1), (high(w) + 1, -1)):
            steps.append(F.when(low(w) <= high(w), F.struct(F.lit(w).alias("width"), at.cast("long").alias("bin"), F.lit(sign).alias("n"), (F.col("value") * sign).alias("v"))))
    laid = m.where(F.col("i") < F.col("j")).select(*group, F.explode(F.array_compact(F.array(*steps))).alias("_e"))
    per = laid.groupBy(*group, "_e.width", "_e.bin").agg(F.sum("_e.n").alias("_n"), F.sum("_e.v").alias("_v"))
    # every bin of a group and width gets a row, so a step holds until the next one
    bins = per.select(*group, "width").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long"))))
    upto = Window.partitionBy(*group, "width").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    full = bins.join(per, [*group, "width", "bin"], "left").fillna(0, ["_n", "_v"])
    sums = full.withColumn("_c", F.sum("_n").over(upto)).withColumn("_s", F.sum("_v").over(upto))
    sums = sums.where(F.col("bin").between(F.col("width"), n - F.col("width")) & (F.col("_c") > 0))
    mean = F.avg("_s").over(Window.partitionBy(*group, "width"))
    return sums.select(*group, "width", "bin", F.log2(F.try_divide("_s", mean)).alias("value"))


def best_curve(factors: DataFrame, curve: DataFrame, group: list[str]) -> DataFrame:
    """(group, r, corr): the factor that correlates best with the curve."""
    j = factors.join(curve.select(*group, "bin", F.col("value").alias("_c")), [*group, "bin"])
    c = j.groupBy(*group, "r").agg(pearson("value", "_c").alias("corr")).where("corr is not null")
    top = c.groupBy(*group).agg(F.max(F.struct("corr", (-F.col("r")).alias("a"))).alias("t"))
    return top.select(*group, (-F.col("t.a")).alias("r"), F.col("t.corr").alias("corr"))


def smoothing_grid(factors: DataFrame, curve: DataFrame, lengths: list[int], group: list[str]) -> DataFrame:
    """(group, r, k, k2, corr): over moving averages of the factors by k and of the curve by k2 the best correlation; ties go to small r, k, k2.

    All lengths are windows of one pass; the grid is laid out as rows of smoothed values."""
    def smooth(t: DataFrame, keys: list[str], name: str) -> DataFrame:
        for k in lengths:
            t = t.withColumn(f"_v{k}", moving_average(keys, k))
        values = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"_v{k}").alias("v")) for k in lengths))
        return t.withColumn("_s", F.explode(values)).select(*keys, "bin", F.col("_s.k").alias(name), F.col("_s.v").alias(f"{name}_v"))

    j = smooth(factors, [*group, "r"], "k").join(smooth(curve, group, "k2"), [*group, "bin"])
    c = j.groupBy(*group, "r", "k", "k2").agg(pearson("k_v", "k2_v").alias("corr")).where("corr is not null")
    top = c.groupBy(*group).agg(F.max(F.struct("corr", (-F.col("r")).alias("a"), (-F.col("k")).alias("b"), (-F.col("k2")).alias("c"))).alias("t"))
    return top.select(*group, (-F.col("t.a")).alias("r"), (-F.col("t.b")).alias("k"), (-F.col("t.c")).alias("k2"), F.col("t.corr").alias("corr"))


def boundary_bed(boundaries: DataFrame, resolution: int) -> DataFrame:
    """chrom, start, end, ".", score, "+" of boundaries(chrom, bin, strength)."""
    return boundaries.select("chrom", (F.col("bin") * resolution).alias("start"), ((F.col("bin") + 1) * resolution).alias("end"), F.lit(".").alias("name"), F.col("strength").alias("score"), F.lit("+").alias("strand"))
