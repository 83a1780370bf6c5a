"""Column helpers and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that the driver and all executors see: spark.checkpoint.dir, or the session's checkpoint folder.

    With neither, a session on one machine gets a temporary folder, as in tests; elsewhere that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current, master = spark.sparkContext._jsc.sc().getCheckpointDir(), spark.sparkContext.master
        if current.isDefined():
            root = current.get()
        elif master == "local" or master.startswith("local["):
            root = "file://" + tempfile.mkdtemp(prefix="tensorloom-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the session's file system closes."""
    path = f"{shared_folder(spark)}/tensorloom-{os.getpid()}-{uuid.uuid4().hex[:12]}-{name}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(target)
    return path


def checkpoint(df: DataFrame, name: str = "step") -> DataFrame:
    """`df` written to the shared folder and read again: its lineage ends here, a lost executor costs no earlier step, later scans read the columns
    they need, and joins know its size. For tables that an operator uses more than once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `checkpoint` returned, as soon as the ones made of them are written: rounds of an iteration don't pile up. Nothing may read them any more."""
    for t in tables:
        path = t.__dict__.pop("_scratch", None)
        if path:
            spark = t.sparkSession
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def ranged(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """`df` laid out by ranges of (group, order) and written, with the range's number as `_k`. Rows that are equal in both share a range, and ranges follow one
    another, so a running sum of a large group needs its ranges one by one and a sum a range."""
    laid = df.repartitionByRange(*group, *order).withColumn("_k", F.spark_partition_id())
    return checkpoint(laid, "ranges")


def _ahead(parts: DataFrame, group: list[str], value: Column) -> DataFrame:
    """(group, _k, _before): the sum of `value` over the ranges before. One row a range meets for a group."""
    sums = parts.groupBy(*group, "_k").agg(F.sum(value).alias("_n"))
    w = Window.partitionBy(*group).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*group, "_k", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))


def running_total(df: DataFrame, group: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds `out`, the sum of `value` over the rows of the group before and equal to this one in `order`."""
    parts = ranged(df, group, order)
    inside = F.sum(value).over(Window.partitionBy(*group, "_k").orderBy(*order))
    return parts.withColumn("_in", inside).join(_ahead(parts, group, value), [*group, "_k"]).withColumn(out, F.col("_in") + F.col("_before")).drop("_in", "_before", "_k")


def row_numbers(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """Adds `out`, the rows of the group numbered from 1 in `order`."""
    parts = ranged(df, group, order)
    inside = F.row_number().over(Window.partitionBy(*group, "_k").orderBy(*order))
    return parts.withColumn("_in", inside).join(_ahead(parts, group, F.lit(1)), [*group, "_k"]).withColumn(out, F.col("_in") + F.col("_before")).drop("_in", "_before", "_k")


def quantiles(df: DataFrame, group: list[str], value: str, shares: list[float], count: str | None = None) -> DataFrame:
    """(group, q): exact quantiles at `shares` as an array, interpolated between the two places around (n - 1) * share; nulls are left out, `count` says how often a
    row counts. Selection by counts: distinct values are counted, their places come from a running total by ranges, and of a group only the values at the wanted
    places go on, so no state holds a group's values."""
    known = df.where(F.col(value).isNotNull())
    distinct = known.groupBy(*group, F.col(value).cast("double").alias("_v")).agg((F.sum(count) if count else F.count("*")).cast("long").alias("_c")).where("_c > 0")
    placed = checkpoint(running_total(checkpoint(distinct, "distinct"), group, [F.col("_v")], F.col("_c"), "_upto"), "places")
    sizes = placed.groupBy(*group).agg(F.max("_upto").alias("_n"))
    j = placed.join(sizes, group) if group else placed.crossJoin(F.broadcast(sizes))
    picks = []
    for k, share in enumerate(shares):
        at = (F.col("_n") - 1) * F.lit(float(share))
        for name, place in (("a", F.floor(at)), ("b", F.ceil(at))):
            picks.append(F.max(F.when((place >= F.col("_upto") - F.col("_c")) & (place < F.col("_upto")), F.col("_v"))).alias(f"_{name}{k}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_f{k}"))
    got = j.groupBy(*group).agg(*picks)
    return got.select(*group, F.array(*(F.col(f"_a{k}") + (F.col(f"_b{k}") - F.col(f"_a{k}")) * F.col(f"_f{k}") for k in range(len(shares)))).alias("q"))


def pearson(a: str, b: str) -> Column:
    """Aggregate: Pearson correlation of two columns over rows where both are there; null when either is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def tri_level(value: Column, high: float, low: float) -> Column:
    """`high` above high, -1 below zero by more than `low`, else 0."""
    return F.when(value > high, F.lit(high)).when((value < 0) & (F.abs(value) > low), F.lit(-1.0)).otherwise(F.lit(0.0))


def clip(value: Column, low: float | None, high: float | None, high_to: float | None = None) -> Column:
    """Values below `low` become low; those above `high` become high, or `high_to`."""
    out = value
    if high is not None:
        out = F.when(value > high, F.lit(high if high_to is None else high_to)).otherwise(out)
    if low is not None:
        out = F.when(value < low, F.lit(low)).otherwise(out)
    return out


def methyl_ratio(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def scaled(value: Column) -> Column:
    """A unit-norm value into a narrow range around zero."""
    return value * 0.02 - 0.01
