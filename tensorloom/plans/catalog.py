"""All registered queries of the genomic operators, with the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tensorloom.plans import q_bins, q_factor, q_expression, q_boundaries, q_compartments, q_stats, q_tensor, q_intervals, q_filters, q_matrix, q_sources  # noqa: F401
from tensorloom.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
