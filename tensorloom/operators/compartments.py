"""A/B compartments: orientation, best factors, summaries by cell type, differential and stable bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.functions.numeric import checkpoint, pearson, quantiles, scaled
from tensorloom.operators.matrix import strip_join


def with_corr(v: DataFrame, reference: DataFrame, group: list[str]) -> DataFrame:
    """(group, corr) of vectors(.., chrom, bin, value) with reference(chrom, bin, value), pairs with a missing side left out."""
    r = reference.select("chrom", "bin", F.col("value").alias("_ref"))
    return v.join(r, ["chrom", "bin"]).groupBy(*group).agg(pearson("value", "_ref").alias("corr"))


def orient(v: DataFrame, mark: DataFrame, group: list[str]) -> DataFrame:
    """Vectors with their sign turned where they correlate negatively with the active mark."""
    sign = with_corr(v, mark, group).select(*group, F.when(F.col("corr") < 0, -1.0).otherwise(1.0).alias("_sign"))
    return v.join(sign, group).withColumn("value", F.col("value") * F.col("_sign")).drop("_sign")


def best_factor(factors: DataFrame, bulk: DataFrame, group: list[str]) -> DataFrame:
    """(group, r, sign, corr): over factors r and both signs the largest correlation with the bulk vector; constant factors take no part; ties go to the
    smaller r and the plain sign."""
    c = with_corr(factors, bulk, [*group, "r"]).where("corr is not null")
    both = c.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("corr", F.col("corr") * F.col("sign"))
    top = both.groupBy(*group).agg(F.max(F.struct("corr", (-F.col("r")).alias("a"), F.col("sign").alias("b"))).alias("t"))
    return top.select(*group, (-F.col("t.a")).alias("r"), F.col("t.b").alias("sign"), F.col("t.corr").alias("corr"))


def pick_factor(factors: DataFrame, best: DataFrame, group: list[str]) -> DataFrame:
    """The vectors of the chosen factors, with the chosen sign; groups without a choice are zeros."""
    chosen = factors.join(best.select(*group, "r", "sign"), [*group, "r"]).select(*group, "bin", (F.col("value") * F.col("sign")).alias("value"))
    rest = factors.join(best.select(*group), group, "left_anti").select(*group, "bin", F.lit(0.0).alias("value")).distinct()
    return chosen.unionByName(rest)


def calls(v: DataFrame, group: list[str]) -> DataFrame:
    """Adds `call`: A above the vector's mean, B below, none at it."""
    mean = v.groupBy(*group).agg(F.avg("value").alias("_mean"))
    call = F.when(F.col("value") > F.col("_mean"), "A").when(F.col("value") < F.col("_mean"), "B").otherwise("none")
    return v.join(mean, group).withColumn("call", call).drop("_mean")


def active_factor(factors: DataFrame, mark: DataFrame, group: list[str]) -> DataFrame:
    """(group, r, corr, active): the factor with the largest correlation with an active mark is active, the others passive."""
    c = with_corr(factors, mark, [*group, "r"])
    w = Window.partitionBy(*group).orderBy(F.desc("corr"), "r")
    return c.withColumn("active", F.row_number().over(w) == 1)


def factor_bin_norm(factors: DataFrame, group: list[str]) -> DataFrame:
    """Factor values over their L2 norm across r in each bin, then scaled; bins of zeros give the scale's centre."""
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(*group, "bin")))
    return factors.withColumn("value", scaled(F.coalesce(F.try_divide("value", norm), F.lit(0.0))))


def summary_by_type(corr: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean correlations of corr(chrom, cell_type, own, other) by chromosome and type, and their means by type."""
    per = corr.groupBy("chrom", "cell_type").agg(F.avg("own").alias("own"), F.avg("other").alias("other"))
    return per, per.groupBy("cell_type").agg(F.avg("own").alias("own"), F.avg("other").alias("other"))


def type_bin_mean(v: DataFrame, types: DataFrame) -> DataFrame:
    return v.join(types, "sample").groupBy("cell_type", "chrom", "bin").agg(F.avg("value").alias("value"))


def differential_ratio(a: DataFrame, b: DataFrame, least: float = 40.0, cap: float = 70.0) -> DataFrame:
    """(chrom, bin, first, ratio): bins where one mean is over `least` times the other, the ratio capped; the first is tried before the second."""
    j = a.select("chrom", "bin", F.col("value").alias("x")).join(b.select("chrom", "bin", F.col("value").alias("y")), ["chrom", "bin"])
    up, down = F.try_divide("x", "y"), F.try_divide("y", "x")
    first = F.when(up > least, True).when(down > least, False)
    out = j.select("chrom", "bin", first.alias("first"), F.least(F.when(first, up).otherwise(down), F.lit(cap)).alias("ratio"))
    return out.where("first is not null")


def stable_compartments(v: DataFrame, types: DataFrame, bins: DataFrame, high: float = 0.03) -> DataFrame:
    """(cell_type, chrom, bin, median, a, b): median over all samples of a type, missing values as 0; A above `high`, B under its negative."""
    # missing samples are zeros by count: a bin's median is selected from its distinct values with their counts, zeros added where samples lack it
    sizes = types.groupBy("cell_type").agg(F.count("*").alias("_n"))
    seen = v.join(types, "sample").groupBy("cell_type", "chrom", "bin", F.coalesce("value", F.lit(0.0)).alias("value")).agg(F.count("*").alias("_c"))
    found = seen.groupBy("cell_type", "chrom", "bin").agg(F.sum("_c").alias("_found"))
    grid = bins.select("chrom", "bin").crossJoin(F.broadcast(sizes))  # a row for each type, of which there are few
    absent = grid.join(found, ["cell_type", "chrom", "bin"], "left").select("cell_type", "chrom", "bin", F.lit(0.0).alias("value"), (F.col("_n") - F.coalesce("_found", F.lit(0))).alias("_c"))
    full = seen.unionByName(absent.where("_c > 0"))
    m = quantiles(full, ["cell_type", "chrom", "bin"], "value", [0.5], "_c").select("cell_type", "chrom", "bin", F.col("q")[0].alias("median"))
    return m.withColumn("a", (F.col("median") > high).cast("long")).withColumn("b", (F.col("median") < -high).cast("long"))


def stable_counts(stable: DataFrame) -> DataFrame:
    return stable.groupBy("cell_type", "chrom").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def differential_compartments(stable: DataFrame, one: str, two: str) -> DataFrame:
    """(chrom, bin, a_to_b): bins that are A in the first type and B in the second, or the other way round."""
    x = stable.where(F.col("cell_type") == one).select("chrom", "bin", F.col("a").alias("a1"), F.col("b").alias("b1"))
    y = stable.where(F.col("cell_type") == two).select("chrom", "bin", F.col("a").alias("a2"), F.col("b").alias("b2"))
    j = x.join(y, ["chrom", "bin"])
    return j.where("(a1 = 1 and b2 = 1) or (b1 = 1 and a2 = 1)").select("chrom", "bin", (F.col("a1") == 1).alias("a_to_b"))


def same_category(bins: DataFrame, category: str) -> DataFrame:
    """(chrom, i, j): pairs i <= j of the bins of one chromosome and category, joined in strips."""
    c = checkpoint(bins.select("chrom", F.col("bin").alias("i"), F.col(category).alias("_c")), "categories")
    return strip_join(c, c.withColumnRenamed("i", "j"), "i", "j", ["chrom", "_c"]).select("chrom", "i", "j")


def isochore(gc: str):
    """Class of a GC percentage: ends 38, 42, 47 and 52."""
    c = F.col(gc)
    return F.when(c < 38, "L1").when(c < 42, "L2").when(c < 47, "H1").when(c <= 52, "H2").otherwise("H3")
