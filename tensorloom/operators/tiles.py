"""Products of all pairs of rows of matrices by dense tiles.

A matrix is cut into tiles of TILE rows by TILE columns. For two strips of rows the tiles of the same columns meet in one task, one pair of tiles after the other, and
their products are added up in place: n / TILE copies of each tile are moved, not a copy of a row for every few partners, and a task holds three dense tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.numeric import checkpoint

GROUP = ("sample", "chrom")
TILE = 1024
#: rows of a result that go to Spark at once
PIECE = 200_000


def _tile(row, n: int, mean: bool, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """(a dense tile, which cells of it are stored; with means, in the first column, which rows the matrix has)."""
    width = min(tile, n - row.chunk * tile)
    out, stored = np.zeros((tile, width)), np.zeros((tile, 1 if mean else width), np.float32)
    if mean:
        at = np.asarray(row.rows, np.int64)
        stored[at] = 1
        out[at] -= np.asarray(row.means, float)[:, None]
    if row.i is not None and len(row.i):
        i, j = np.asarray(row.i, np.int64), np.asarray(row.j, np.int64)
        np.add.at(out, (i, j), np.asarray(row.v, float))
        if not mean:
            stored[i, j] = 1
    return out, stored


def row_products(m: DataFrame, n: int, group=GROUP, centre: bool = False) -> DataFrame:
    """(group, i, j, value) for i <= j: the sum over all columns of the products of rows i and j of a full matrix (group, i, j, value) of n columns, absent cells
    zero. centre: rows less their mean over n cells, for all pairs of rows that have cells; else for pairs that share a column."""
    g, size, piece = list(group), max(1, min(TILE, n)), PIECE
    strips = -(-n // size)
    m = checkpoint(m.select(*g, "i", "j", F.col("value").cast("double").alias("value")), "cells") if centre else m
    strip, chunk = F.floor(F.col("i") / size).cast("int"), F.floor(F.col("j") / size).cast("int")
    cell = F.struct((F.col("i") % size).cast("int").alias("i"), (F.col("j") % size).cast("int").alias("j"), F.col("value").cast("double").alias("v"))
    packed = m.groupBy(*g, strip.alias("strip"), chunk.alias("chunk")).agg(F.collect_list(cell).alias("c"))
    packed = packed.select(*g, "strip", "chunk", *(F.col(f"c.{k}").alias(k) for k in "ijv"))
    if centre:
        mean = m.groupBy(*g, "i").agg((F.sum("value") / n).alias("mean")).withColumn("strip", strip)
        rows = mean.groupBy(*g, "strip").agg(F.collect_list(F.struct((F.col("i") % size).cast("int").alias("at"), "mean")).alias("m"))
        grid = rows.select(*g, "strip", F.transform("m", lambda x: x["at"]).alias("rows"), F.transform("m", lambda x: x["mean"]).alias("means"), F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("chunk"))
        packed = grid.join(packed, [*g, "strip", "chunk"], "left")
    tiles = checkpoint(packed, "tiles")
    more = ["chunk", *(["rows", "means"] if centre else []), "i", "j", "v"]
    left = tiles.select(*g, F.col("strip").alias("a"), F.explode(F.sequence("strip", F.lit(strips - 1))).alias("b"), F.lit(0).alias("side"), *more)
    right = tiles.select(*g, F.explode(F.sequence(F.lit(0), F.col("strip"))).alias("a"), F.col("strip").alias("b"), F.lit(1).alias("side"), *more)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in m.select(*g).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = total = shared = first = None

        def result() -> Iterator[pd.DataFrame]:
            i, j = np.nonzero(shared)
            if at[-2] == at[-1]:
                i, j = i[i <= j], j[i <= j]
            for lo in range(0, len(i), piece):
                x, y = i[lo : lo + piece], j[lo : lo + piece]
                out = {name: [value] * len(x) for name, value in zip(g, at, strict=False)}
                yield pd.DataFrame(out | {"i": x + at[-2] * size, "j": y + at[-1] * size, "value": total[x, y]})

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                key = (*(getattr(row, c) for c in g), row.a, row.b)
                if key != at:
                    if at is not None:
                        yield from result()
                    at, total, shared, first = key, np.zeros((size, size)), np.zeros((size, size), bool), None
                tile, stored = _tile(row, n, centre, size)
                if row.side == 0:
                    first = (row.chunk, tile, stored)
                elif first is not None and first[0] == row.chunk:
                    total += first[1] @ tile.T
                    shared |= first[2] @ stored.T > 0
        if at is not None:
            yield from result()

    laid = left.unionByName(right).repartition(*g, "a", "b").sortWithinPartitions(*g, "a", "b", "chunk", "side")
    return laid.mapInPandas(run, f"{kinds}{', ' if g else ''}i long, j long, value double")
