"""Text and table readers. Numbers that do not parse are null; NaN becomes null at the door.

`sample` and `chrom` come from the file's name where a reader says so: <folder>/<sample>_<chrom>.<anything>; for part files, from their folder's name,
<sample>_<chrom> or <column>=<sample>_<chrom>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str, pattern: str = r"\s+") -> DataFrame:
    """(value, f, _file): trimmed lines split into fields."""
    lines = spark.read.text(path).select(F.trim(F.translate("value", "\r", "")).alias("value"), F.input_file_name().alias("_file"))
    return lines.withColumn("f", F.split("value", pattern))


def number(text: Column) -> Column:
    """A double, null for what is no number and for NaN."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x), x)


def _from_name(part: int) -> Column:
    folder = F.regexp_extract("_file", r"/(?:[^/=]*=)?([^/]+)/part-[^/]*$", 1)
    name = F.when(folder != "", folder).otherwise(F.regexp_extract("_file", r"([^/]+)$", 1))
    return F.regexp_extract(name, r"^(.*)_([^_.]+)(?:\..*)?$", part)


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """contacts(sample, chrom, i, j, value) of white-space triplets; lines with another number of fields are dropped."""
    t = _fields(spark, path).where(F.size("f") == 3)
    return t.select(_from_name(1).alias("sample"), _from_name(2).alias("chrom"), F.col("f")[0].try_cast("long").alias("i"), F.col("f")[1].try_cast("long").alias("j"), number(F.col("f")[2]).alias("value"))


def read_contacts_strict(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): non-negative integer triplets, and the other lines with their place in the file: a running number over the file's parts."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"))
    t = lines.withColumn("f", F.split(F.trim("value"), r"\s+"))
    n = [F.get("f", F.lit(k)).try_cast("long") for k in range(3)]
    ok = (F.size("f") == 3) & F.coalesce((n[0] >= 0) & (n[1] >= 0) & (n[2] >= 0), F.lit(False))
    good = t.where(ok).select(n[0].alias("i"), n[1].alias("j"), n[2].alias("value"))
    first = t.groupBy("file").agg(F.min("place").alias("_first"))
    bad = t.where(~ok).join(first, "file").select("file", (F.col("place") - F.col("_first") + 1).alias("line"), "value")
    return good, bad


def read_pairs7(spark: SparkSession, path: str) -> DataFrame:
    """pairs(chrom1, pos1, chrom2, pos2) of 7-column tab lines, "chr" put before the names."""
    t = _fields(spark, path, "\t").where(F.size("f") >= 7)
    chr_ = lambda k: F.concat(F.lit("chr"), F.regexp_replace(F.col("f")[k], "^chr", ""))
    return t.select(chr_(1).alias("chrom1"), F.col("f")[2].try_cast("long").alias("pos1"), chr_(5).alias("chrom2"), F.col("f")[6].try_cast("long").alias("pos2"))


def read_signal_bed4(spark: SparkSession, path: str, chroms: list[str] | None = None) -> DataFrame:
    """signal(chrom, start, end, value); short and unparsable lines are dropped, chromosomes are chosen on reading."""
    t = _fields(spark, path).where(F.size("f") >= 4)
    if chroms is not None:
        t = t.where(F.col("f")[0].isin(chroms))
    s = t.select(F.col("f")[0].alias("chrom"), F.col("f")[1].try_cast("long").alias("start"), F.col("f")[2].try_cast("long").alias("end"), number(F.col("f")[3]).alias("value"))
    return s.dropna()


def read_bed_score(spark: SparkSession, path: str) -> DataFrame:
    """signal of BED lines, `track` and # lines skipped, the value from the fifth field or else 1."""
    t = _fields(spark, path).where(~F.regexp_like("value", F.lit(r"^(track|#|browser)|^$")) & (F.size("f") >= 3))
    return t.select(F.col("f")[0].alias("chrom"), F.col("f")[1].try_cast("long").alias("start"), F.col("f")[2].try_cast("long").alias("end"), F.coalesce(number(F.get("f", F.lit(4))), F.lit(1.0)).alias("value"))


def read_bed10(spark: SparkSession, path: str) -> DataFrame:
    """signal of 10-column BED lines with the score in the fifth; short lines are dropped."""
    t = _fields(spark, path).where(F.size("f") >= 10)
    return t.select(F.col("f")[0].alias("chrom"), F.col("f")[1].try_cast("long").alias("start"), F.col("f")[2].try_cast("long").alias("end"), number(F.col("f")[4]).alias("value"))


def read_methyl_pairs(spark: SparkSession, path: str, samples: list[str]) -> DataFrame:
    """methyl(sample, chrom, start, end, num, den): numerator and denominator columns from the seventh on, one pair a sample."""
    t = _fields(spark, path).where(F.size("f") >= 6 + 2 * len(samples))
    pairs = F.array(*(F.struct(F.lit(s).alias("sample"), number(F.col("f")[6 + 2 * k]).alias("num"), number(F.col("f")[7 + 2 * k]).alias("den")) for k, s in enumerate(samples)))
    laid = t.withColumn("p", F.explode(pairs))
    return laid.select("p.sample", F.col("f")[0].alias("chrom"), F.col("f")[1].try_cast("long").alias("start"), F.col("f")[2].try_cast("long").alias("end"), "p.num", "p.den")


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    t = _fields(spark, path).where(F.size("f") >= 2)
    return t.select(F.col("f")[0].alias("chrom"), F.col("f")[1].try_cast("long").alias("length")).dropna()


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path).where("value <> ''").select(F.col("value").alias("sample"))


def read_cell_labels(spark: SparkSession, path: str, kinds: dict[str, str]) -> DataFrame:
    """labels(sample, cell_type) of "ordinal cell colour" lines, the type by colour."""
    colour = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    t = _fields(spark, path).where(F.size("f") >= 3)
    return t.select(F.col("f")[1].alias("sample"), F.try_element_at(colour, F.col("f")[2]).alias("cell_type"))


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """vector(bin, value): one value a line of one file, the line's number is the bin. Row order is data here, so places come from zipWithIndex."""
    rows = spark.read.text(path).rdd.zipWithIndex().map(lambda x: (x[1], x[0][0]))
    return spark.createDataFrame(rows, "bin long, text string").select("bin", number(F.trim("text")).alias("value"))


def read_counts_wide(spark: SparkSession, path: str, gene: str, separator: str = ",") -> DataFrame:
    """counts(gene, name, value) of a table of genes by samples with a header."""
    t = spark.read.option("header", True).option("sep", separator).csv(path)
    long = t.unpivot([gene], [c for c in t.columns if c != gene], "name", "text")
    return long.select(F.col(gene).alias("gene"), "name", number(F.col("text")).alias("value"))


def read_10x(spark: SparkSession, matrix: str, barcodes: str, features: str) -> DataFrame:
    """counts(cell, gene, value) of a coordinate matrix with 1-based gene and cell numbers: comment lines and the size line are left out."""
    def listed(path: str, name: str) -> DataFrame:
        rows = spark.read.text(path).rdd.zipWithIndex().map(lambda x: (x[1] + 1, x[0][0].split("\t")))
        return spark.createDataFrame(rows, "n long, f array<string>").select("n", F.coalesce(F.get("f", F.lit(1)), F.col("f")[0]).alias(name) if name == "gene" else F.col("f")[0].alias(name))

    lines = spark.read.text(matrix).rdd.filter(lambda r: not r[0].startswith("%")).zipWithIndex().filter(lambda x: x[1] > 0).map(lambda x: (x[0][0],))
    f = spark.createDataFrame(lines, "value string").select(F.split(F.trim("value"), r"\s+").alias("f"))
    cells = f.select(F.col("f")[0].try_cast("long").alias("g"), F.col("f")[1].try_cast("long").alias("c"), number(F.col("f")[2]).alias("value"))
    genes, names = listed(features, "gene"), listed(barcodes, "cell")
    return cells.join(genes, cells.g == genes.n).drop("n").join(names, F.col("c") == names.n).select("cell", "gene", "value")
