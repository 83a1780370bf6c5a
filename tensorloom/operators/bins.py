"""Bins, resolutions and genome coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_resolution(text: Column) -> Column:
    """struct(resolution, label) of "value:label"; an error for a text without a colon or with a value that is no integer."""
    value = F.split(text, ":", 2)[0].try_cast("long")
    bad = F.raise_error(F.concat(F.lit("not a resolution: "), text))
    return F.when(F.contains(text, F.lit(":")) & value.isNotNull(), F.struct(value.alias("resolution"), F.element_at(F.split(text, ":", 2), -1).alias("label"))).otherwise(bad)


def bin_of(position: Column, resolution: int, shift: int = 0) -> Column:
    return F.floor(position / resolution).cast("long") + shift


def mid_bin(start: Column, end: Column, resolution: int) -> Column:
    """One plus the bin of the mid-point."""
    return F.floor((start + end) / 2 / resolution).cast("long") + 1


def bin_count(length: Column, resolution: int, mode: str = "ceil") -> Column:
    if mode == "plus1":
        return F.floor(length / resolution).cast("long") + 1
    return {"ceil": F.ceil, "floor": F.floor}[mode](length / resolution).cast("long")


def make_bins(sizes: DataFrame, resolution: int, mode: str = "ceil") -> DataFrame:
    """bins(chrom, bin, start, end) of chrom_sizes(chrom, length): the last bin ends with the chromosome; mode "plus1" adds a bin, empty when the length is a multiple."""
    n = bin_count(F.col("length"), resolution, mode)
    laid = sizes.where(n > 0).select("chrom", "length", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("bin"))
    return laid.select("chrom", "bin", (F.col("bin") * resolution).alias("start"), F.least((F.col("bin") + 1) * resolution, "length").alias("end"))


def natural_order(chrom: Column) -> Column:
    """A sort key: numbered chromosomes by number, X after them, others last."""
    number = F.regexp_extract(chrom, r"^(?:chr)?(\d+)$", 1)
    return F.when(number != "", number.cast("int")).when(F.regexp_like(chrom, F.lit(r"^(chr)?X$")), F.lit(1000)).otherwise(F.lit(2000))


def is_autosome(chrom: Column) -> Column:
    return F.regexp_like(chrom, F.lit(r"^(chr)?[0-9]+$"))


def reindex(vectors: DataFrame, group: list[str]) -> DataFrame:
    """Bins numbered anew from 0 in their order within each group, after rows were removed."""
    return vectors.withColumn("bin", (F.row_number().over(Window.partitionBy(*group).orderBy("bin")) - 1).cast("long"))


def chrom_offsets(sizes: DataFrame) -> DataFrame:
    """(chrom, offset): the summed lengths of the chromosomes before it in natural order. One row a chromosome, so one small window."""
    w = Window.orderBy(natural_order(F.col("chrom")), "chrom").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("chrom", F.coalesce(F.sum("length").over(w), F.lit(0)).alias("offset"))


def genome_position(bins: DataFrame, offsets: DataFrame, resolution: int) -> DataFrame:
    return bins.join(F.broadcast(offsets), "chrom").withColumn("position", F.col("offset") + F.col("bin") * resolution).drop("offset")


def genome_vector(vectors: DataFrame, group: list[str]) -> DataFrame:
    """Vectors of all chromosomes after one another: `place` counts on in natural order, from the bins of each chromosome."""
    per = vectors.groupBy(*group, "chrom").agg((F.max("bin") + 1).alias("_n"))
    w = Window.partitionBy(*group).orderBy(natural_order(F.col("chrom")), "chrom").rowsBetween(Window.unboundedPreceding, -1)
    base = per.withColumn("_at", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    return vectors.join(base, [*group, "chrom"]).withColumn("place", F.col("_at") + F.col("bin")).drop("_at")


def split_genome(values: DataFrame, sizes: DataFrame, resolution: int, mode: str = "floor") -> DataFrame:
    """Genome-long values(.., place, value) cut back to (.., chrom, bin, value) by the bin counts of the chromosomes: a range join with one row a chromosome.
    Other columns ride along."""
    n = sizes.select("chrom", bin_count(F.col("length"), resolution, mode).alias("n"))
    w = Window.orderBy(natural_order(F.col("chrom")), "chrom").rowsBetween(Window.unboundedPreceding, -1)
    at = n.select("chrom", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("at"))
    inside = (F.col("place") >= F.col("at")) & (F.col("place") < F.col("at") + F.col("n"))
    rest = [c for c in values.columns if c not in ("place", "value")]
    return values.join(F.broadcast(at), inside).select(*rest, "chrom", (F.col("place") - F.col("at")).alias("bin"), "value")
