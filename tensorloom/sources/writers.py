"""Text and Parquet sinks, and the idempotent re-run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def write_matrix(m: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Cells by chromosome folder; an overwrite replaces only the chromosomes written."""
    m.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("chrom").parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_triplets(m: DataFrame, path: str) -> None:
    m.select("i", "j", "value").write.mode("overwrite").option("sep", "\t").csv(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """One text line per row of (value)."""
    lines.select("value").write.mode("overwrite").text(path)


def write_bed(bed: DataFrame, path: str) -> None:
    """Interval rows as tab-separated lines."""
    bed.write.mode("overwrite").option("sep", "\t").csv(path)


def write_curve(curve: DataFrame, path: str, resolution: int) -> None:
    """Fixed-step track: chrom, start, end and value of each bin."""
    rows = curve.select("chrom", (F.col("bin") * resolution).alias("start"), ((F.col("bin") + 1) * resolution).alias("end"), "value")
    rows.sortWithinPartitions("chrom", "start").write.mode("overwrite").option("sep", "\t").csv(path)


def write_calls(calls: DataFrame, summary: DataFrame, path: str) -> None:
    """Compartment vectors and the table of samples beside them."""
    calls.write.mode("overwrite").partitionBy("chrom").parquet(f"{path}/calls")
    summary.write.mode("overwrite").parquet(f"{path}/summary")


def write_factors(factors: DataFrame, path: str) -> None:
    factors.write.mode("overwrite").partitionBy("r", "chrom").parquet(path)


def write_blocks(m: DataFrame, path: str, size: int = 500) -> None:
    """A matrix in square blocks, one folder a block row."""
    m.withColumn("bi", F.floor(F.col("i") / size)).withColumn("bj", F.floor(F.col("j") / size)).write.mode("overwrite").partitionBy("bi", "bj").parquet(path)


def skip_existing(units: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The units whose keys are not in the table at `path`; all of them where there is no table."""
    try:
        done = units.sparkSession.read.parquet(path).select(*keys).distinct()
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return units
    return units.join(done, keys, "left_anti")
