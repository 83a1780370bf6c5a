"""Shared helpers of the training-data operators: reading tables, shared scratch space."""

from __future__ import annotations

import ctypes
import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.numeric import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder `sf_dir`, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the session's file system closes."""
    path = f"{shared_folder(spark)}/tensorloom-{os.getpid()}-{uuid.uuid4().hex[:12]}-{name}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(target)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs only the tasks it was running, and a table used
    by several later jobs is computed once.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text"):
    """The text column with null read as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


NO_ID = -(2**63)


def id_or_none(column: str = "doc_id"):
    """The id as a long, with the smallest long standing for null: null-free longs pass through pandas exactly."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID).cast("long"))


def none_again(column: str = "doc_id"):
    """Undoes id_or_none."""
    return F.nullif(F.col(column), F.lit(NO_ID).cast("long"))


def give_back() -> None:
    """Returns memory that a Python worker has freed to the machine: Spark keeps workers, and a kept one should not hold what its last task used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
