"""Filters and masks over reads, bins, vectors and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.functions.numeric import quantiles
from tensorloom.operators.bins import is_autosome, reindex


def good_read(mapq: Column, flag: Column, least: int = 30) -> Column:
    return (mapq >= least) & (flag.bitwiseAND(1) == 1) & (flag.bitwiseAND(1804) == 0)


def cell_filter(reads: DataFrame, chroms: DataFrame, least: int) -> DataFrame:
    """(sample, total): samples with good reads on every autosome of `chroms` and at least `least` in all."""
    wanted = chroms.where(is_autosome(F.col("chrom"))).select("chrom").distinct()
    n = wanted.agg(F.count("*").alias("_need"))
    good = reads.where(good_read(F.col("mapq"), F.col("flag"))).join(F.broadcast(wanted), "chrom", "left_semi")
    per = good.groupBy("sample", "chrom").count().groupBy("sample").agg(F.sum("count").alias("total"), F.count("*").alias("_have"))
    return per.crossJoin(F.broadcast(n)).where((F.col("_have") == F.col("_need")) & (F.col("total") >= least)).select("sample", "total")


def drop_small_add_diagonal(m: DataFrame, group: list[str], small: float = 1e-10, add: float = 1e-5) -> DataFrame:
    """Cells under `small` go, then `add` is put on the diagonal of every row and column in use."""
    kept = m.where(F.col("value") >= small)
    diagonal = m.select(*group, F.explode(F.array("i", "j")).alias("i")).distinct().select(*group, "i", F.col("i").alias("j"), F.lit(add).alias("value"))
    return kept.select(*group, "i", "j", "value").unionByName(diagonal).groupBy(*group, "i", "j").agg(F.sum("value").alias("value"))


def mask_bins(v: DataFrame, dark: DataFrame) -> DataFrame:
    """Values of dark bins (chrom, bin) set to null; dark bins outside the vector change nothing."""
    marks = dark.select("chrom", "bin").distinct().withColumn("_dark", F.lit(True))
    return v.join(marks, ["chrom", "bin"], "left").withColumn("value", F.when(F.col("_dark").isNull(), F.col("value"))).drop("_dark")


def remove_bins(m: DataFrame, dark: DataFrame, bins: DataFrame) -> DataFrame:
    """A matrix without the rows and columns of dark bins, the rest numbered anew from 0."""
    left = reindex(bins.join(dark, ["chrom", "bin"], "left_anti").select("chrom", "bin", F.col("bin").alias("_old")), ["chrom"])
    a = left.select("chrom", F.col("_old").alias("i"), F.col("bin").alias("_i"))
    b = left.select("chrom", F.col("_old").alias("j"), F.col("bin").alias("_j"))
    others = [c for c in m.columns if c not in ("i", "j")]
    return m.join(a, ["chrom", "i"]).join(b, ["chrom", "j"]).select(*others, F.col("_i").alias("i"), F.col("_j").alias("j"))


def remove_vector_bins(v: DataFrame, dark: DataFrame, group: list[str]) -> DataFrame:
    return reindex(v.join(dark.select("chrom", "bin").distinct(), ["chrom", "bin"], "left_anti"), group)


def sparse_rows(m: DataFrame, bins: DataFrame, samples: DataFrame, n: int, share: float = 0.95) -> DataFrame:
    """(sample, chrom, bin, filled): rows of full matrices with at least `share` zeros among n cells."""
    filled = m.where("value != 0").groupBy("sample", "chrom", F.col("i").alias("bin")).agg(F.count("*").alias("filled"))
    units = samples.crossJoin(F.broadcast(bins.select("chrom").distinct()))  # a few chromosomes
    grid = units.join(bins.select("chrom", "bin"), "chrom")
    return grid.join(filled, ["sample", "chrom", "bin"], "left").select("sample", "chrom", "bin", F.coalesce("filled", F.lit(0)).alias("filled")).where(F.col("filled") <= n * (1 - share) + 1e-9)


def clip_deviations(v: DataFrame, group: list[str], t: float = 3.0) -> DataFrame:
    """Values clipped at mean ± t population deviations, then over their L2 norm; an error for a zero vector."""
    w = Window.partitionBy(*group)
    m, s = F.avg("value").over(w), F.stddev_pop("value").over(w)
    cut = v.withColumn("value", F.least(F.greatest(F.col("value"), m - t * s), m + t * s))
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(w))
    return cut.withColumn("value", F.when(norm > 0, F.col("value") / norm).otherwise(F.raise_error(F.lit("a zero vector")).cast("double")))


def drop_z_outliers(df: DataFrame, columns: list[str], t: float = 3.0) -> DataFrame:
    """Rows within t population deviations of the mean in every column; a constant column drops nothing."""
    stats = df.agg(*(x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))))
    keep = F.lit(True)
    for c in columns:
        keep = keep & (F.coalesce(F.abs(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}"))), F.lit(0.0)) <= t)
    return df.crossJoin(F.broadcast(stats)).where(keep).select(*df.columns)


def drop_iqr_outliers(df: DataFrame, columns: list[str], reach: float = 1.5) -> DataFrame:
    """Rows within reach times the interquartile range of the quartiles in every column. The quartiles of all columns are selected together, by counts."""
    laid = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_x")) for c in columns))).alias("_s")).select("_s.*")
    stats = quantiles(laid, ["_name"], "_x", [0.25, 0.75]).groupBy().agg(*(F.max(F.when(F.col("_name") == c, F.col("q"))).alias(f"_q_{c}") for c in columns))
    keep = F.lit(True)
    for c in columns:
        lo, hi = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
        keep = keep & F.col(c).between(lo - reach * (hi - lo), hi + reach * (hi - lo))
    return df.crossJoin(F.broadcast(stats)).where(keep).select(*df.columns)


def crop(m: DataFrame, n: int | Column) -> DataFrame:
    return m.where((F.col("i") < n) & (F.col("j") < n))


def two_way(df: DataFrame, x: str, y: str, group: list[str]) -> Column:
    """"x" where x is above and y below its mean, "y" the other way round, else "none"."""
    w = Window.partitionBy(*group)
    above_x, above_y = F.col(x) > F.avg(x).over(w), F.col(y) > F.avg(y).over(w)
    below_x, below_y = F.col(x) < F.avg(x).over(w), F.col(y) < F.avg(y).over(w)
    return F.when(above_x & below_y, x).when(above_y & below_x, y).otherwise("none")


def quadrants(factor: Column, mean: Column, eigenvector: Column) -> Column:
    return F.concat(F.when(factor > mean, "high").otherwise("low"), F.lit("_"), F.when(eigenvector > 0, "A").otherwise("B"))


def audit(df: DataFrame, column: str, group: list[str]) -> DataFrame:
    """Counts of zeros, nulls or NaNs, and infinities."""
    c = F.col(column)
    return df.groupBy(*group).agg(
        F.count_if(c == 0).alias("zeros"), F.count_if(c.isNull() | F.isnan(c)).alias("missing"), F.count_if(F.abs(c) == F.lit(float("inf"))).alias("infinite"), F.count("*").alias("n")
    )


def finite_mean(df: DataFrame, column: str, group: list[str]) -> DataFrame:
    c = F.col(column)
    return df.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))).groupBy(*group).agg(F.avg(column).alias("mean"))


def keep_missing(samples: DataFrame, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples with input, samples without)."""
    have = inputs.select("sample").distinct()
    return samples.join(have, "sample", "left_semi"), samples.join(have, "sample", "left_anti")


def one_hot(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    return df.select("*", *((F.col(column) == n).cast("long").alias(f"is_{n}") for n in names))


def first_of_duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def stack_modalities(a: DataFrame, b: DataFrame, bins: DataFrame) -> DataFrame:
    """Two modalities of (sample, chrom, i, j, value) as one table with `modality`; a (sample, chrom) of b without contacts in a gets the identity."""
    missing = b.select("sample", "chrom").distinct().join(a.select("sample", "chrom").distinct(), ["sample", "chrom"], "left_anti")
    eye = missing.join(bins.select("chrom", "bin"), "chrom").select("sample", "chrom", F.col("bin").alias("i"), F.col("bin").alias("j"), F.lit(1.0).alias("value"))
    first = a.select("sample", "chrom", "i", "j", "value").unionByName(eye).withColumn("modality", F.lit("contacts"))
    return first.unionByName(b.select("sample", "chrom", "i", "j", "value").withColumn("modality", F.lit("signal")))
