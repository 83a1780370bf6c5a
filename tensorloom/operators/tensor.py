"""Tensors as tables: cell tensors of two modalities, third-order cumulants, masks and down-sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.functions.numeric import checkpoint, row_numbers, tri_level
from tensorloom.operators import matrix as M

GROUP = ("sample", "chrom")


def build_cell_tensor(contacts: DataFrame, signal: DataFrame, n: int, width: int = 2) -> DataFrame:
    """tensor(sample, chrom, modality, i, j, value) of upper-triangle contacts and signal products: the last bin dropped, signal kept near contacts, contacts turned
    into correlations, both made non-negative, normalised by column and by modality."""
    last = n - 1
    full = checkpoint(M.symmetrize(contacts.where((F.col("i") < last) & (F.col("j") < last))), "matrix")
    other = M.symmetrize(signal.where((F.col("i") < last) & (F.col("j") < last)))
    near = M.mask_neighbourhood(other, full, width)
    cor = M.symmetrize(M.sparse_pearson(full, last))
    stacked = cor.withColumn("modality", F.lit("contacts")).unionByName(near.withColumn("modality", F.lit("signal")))
    keys = ["sample", "chrom", "modality"]
    raised = M.shift_min(stacked, keys)
    return M.normalize(M.normalize(raised, [*keys, "j"]), keys).select("sample", "chrom", "modality", "i", "j", "value")


def bin_triples(ids: DataFrame, group=GROUP) -> DataFrame:
    """(group, i, j, k): i <= j <= k of ids(group, i), by two joins in strips."""
    pairs = M.strip_join(ids.select(*group, "i"), ids.select(*group, F.col("i").alias("j")), "i", "j", group)
    return M.strip_join(pairs, ids.select(*group, F.col("i").alias("k")), "j", "k", group)


def third_cumulant(m: DataFrame, n: int, group=GROUP, kind: str = "standardised") -> DataFrame:
    """(group, i, j, k, value) for i <= j <= k over the rows of a full matrix.

    standardised: mean of the centred triple product over the product of deviations; hypercorrelation: its sum over the root of the product of
    the sums of squares; null where a row is constant. raw: the mean triple product with raw-mean terms taken off the centred moments, a variant kept by name.
    """
    rows = M.rows_as_arrays(m, n, group)
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / n
    c = rows.withColumn("_mu", mean).withColumn("x", M.centred(F.col("x"), n)).withColumn("_v", M.dot(F.col("x"), F.col("x")) / n)
    c = checkpoint(c, "rows")
    own = lambda s, x: c.select(*group, F.col("i").alias(s), F.col("x").alias(x), F.col("_mu").alias(f"_m{s}"), F.col("_v").alias(f"_v{s}"))
    # a pair carries the product of its rows as one array, and a triple none
    pairs = M.strip_join(own("i", "x"), own("j", "y"), "i", "j", group).withColumn("_p", F.zip_with("x", "y", lambda a, b: a * b))
    pairs = pairs.withColumn("_xy", F.aggregate("_p", F.lit(0.0), lambda a, v: a + v) / n).drop("x", "y")
    means = pairs.select(*group, "i", "j", "_xy")
    t = M.strip_join(pairs, own("k", "z"), "j", "k", group).withColumn("_e", M.dot(F.col("_p"), F.col("z")) / n).drop("_p", "z")
    if kind == "raw":
        for a, b, name in (("i", "k", "_xz"), ("j", "k", "_yz")):
            t = t.join(means.select(*group, F.col("i").alias(a), F.col("j").alias(b), F.col("_xy").alias(name)), [*group, a, b])
    if kind == "raw":
        value = F.col("_e") - F.col("_mi") * F.col("_yz") - F.col("_mj") * F.col("_xz") - F.col("_mk") * F.col("_xy") + 2 * F.col("_mi") * F.col("_mj") * F.col("_mk")
    else:
        scale = F.sqrt("_vi") * F.sqrt("_vj") * F.sqrt("_vk")
        value = F.try_divide("_e", scale * (F.sqrt(F.lit(float(n))) if kind == "hypercorrelation" else F.lit(1.0)))
    return t.select(*group, "i", "j", "k", value.alias("value"))


def cumulant_slices(c: DataFrame, group=GROUP) -> DataFrame:
    """A cumulant of i <= j <= k as full slices over k, each over its Frobenius norm, added up: (group, i, j, value)."""
    full = expand3(c, group)
    return M.normalize(full, [*group, "k"]).groupBy(*group, "i", "j").agg(F.sum("value").alias("value"))


def expand3(c: DataFrame, group=GROUP) -> DataFrame:
    """All orders of the indices of a fully symmetric tensor."""
    orders = F.array_distinct(F.array(*(F.struct(F.col(a).alias("i"), F.col(b).alias("j"), F.col(d).alias("k")) for a, b, d in ("ijk", "ikj", "jik", "jki", "kij", "kji"))))
    return c.withColumn("_o", F.explode(orders)).select(*group, "_o.i", "_o.j", "_o.k", "value")


def collapse3(c: DataFrame, group=GROUP) -> DataFrame:
    """A cumulant summed over its third index."""
    return expand3(c, group).groupBy(*group, "i", "j").agg(F.sum("value").alias("value"))


def mask3(values: DataFrame, near: DataFrame, width: int = 1, group=GROUP) -> DataFrame:
    """Cells of (i, j, k) within `width` in each index of a non-zero cell of `near`."""
    side = F.sequence(F.lit(-width), F.lit(width))
    laid = near.where("value != 0").withColumn("_a", F.explode(side)).withColumn("_b", F.explode(side)).withColumn("_c", F.explode(side))
    cells = laid.select(*group, (F.col("i") + F.col("_a")).alias("i"), (F.col("j") + F.col("_b")).alias("j"), (F.col("k") + F.col("_c")).alias("k")).distinct()
    return values.join(cells, [*group, "i", "j", "k"], "left_semi")


def combine_cumulants(a: DataFrame, b: DataFrame, n: int, high: float, low: float, group=GROUP) -> DataFrame:
    """Two full cumulants cropped to n, the second cut to three levels and kept near the first, both over their norm, non-negative and stacked."""
    inside = "i < {0} and j < {0} and k < {0}".format(n)
    a, b = checkpoint(a.where(inside), "cumulant"), b.where(inside).withColumn("value", tri_level(F.col("value"), high, low)).where("value != 0")
    stacked = a.withColumn("modality", F.lit("contacts")).unionByName(mask3(b, a, 1, group).withColumn("modality", F.lit("signal")))
    keys = [*group, "modality"]
    return M.shift_min(M.normalize(stacked, keys), keys)


def _hash_order(columns: list[str], seed: int) -> Column:
    """A seeded order of cells that any engine can state: the MD5 of the seed and the keys, in hex."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)).cast("binary"))


def downsample(m: DataFrame, keys: list[str], percent: int, total: Column, group: list[str], seed: int) -> DataFrame:
    """Exactly floor(total * percent / 100) cells of each group in the order of a seeded hash, fewer only if the group has fewer."""
    hashed = m.withColumn("_h", _hash_order([*group, *keys], seed))
    ranked = row_numbers(hashed, group, [F.col("_h"), *(F.col(k) for k in keys)], "_r").withColumn("_n", F.floor(total * percent / 100))
    return ranked.where("_r <= _n").drop("_r", "_n", "_h")


def downsample_slices(m: DataFrame, keys: list[str], percent: int, total: Column, group: list[str], seed: int) -> DataFrame:
    """The matrix as slice 0 with its down-sampled copy as slice 1."""
    m = checkpoint(m, "matrix")
    few = downsample(m, keys, percent, total, group, seed)
    return m.withColumn("slice", F.lit(0)).unionByName(few.withColumn("slice", F.lit(1)))


def random_mask(m: DataFrame, keys: list[str], share: float, seed: int) -> DataFrame:
    """Cells whose seeded hash falls under `share`: repeatable, independent of how the table is split."""
    return m.where(F.left(_hash_order(keys, seed), F.lit(8)) < f"{int(share * 16**8):08x}")


def unfold(t: DataFrame, keys: list[str]) -> DataFrame:
    """tensor(sample, keys.., value) as a matrix of samples by cells: (sample, cell, value), a cell being the struct of its keys."""
    return t.select("sample", F.struct(*keys).alias("cell"), "value")


def unfold_columns(t: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., col): the distinct cells numbered from 0 in the order of their keys."""
    cells = checkpoint(t.select(*keys).distinct(), "cells")
    return row_numbers(cells, [], [F.col(k) for k in keys], "col").withColumn("col", F.col("col") - 1)


def unfold_numbered(t: DataFrame, keys: list[str]) -> DataFrame:
    """(sample, col, value): the unfolded tensor with the columns of `unfold_columns`."""
    t = checkpoint(t, "tensor")
    return t.join(unfold_columns(t, keys), keys).select("sample", "col", "value")


def concat_sample_factors(f: DataFrame, keys: list[str]) -> DataFrame:
    """(sample, col, value): the sample factors of all keys side by side as numbered columns, each of unit length."""
    return unfold_numbered(M.normalize(f, keys), keys)


def flat_corr(a: DataFrame, b: DataFrame, keys: list[str], cells: int, group: list[str]) -> DataFrame:
    """Pearson correlation of two tensors over all `cells` of a group, absent cells as zeros: from sums over the stored cells."""
    j = a.withColumnRenamed("value", "x").join(b.withColumnRenamed("value", "y"), [*group, *keys], "full").fillna(0.0, ["x", "y"])
    s = j.groupBy(*group).agg(*(F.sum(e).alias(n) for n, e in (("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("syy", F.col("y") * F.col("y")), ("sxy", F.col("x") * F.col("y")))))
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / cells
    scale = F.sqrt((F.col("sxx") - F.col("sx") * F.col("sx") / cells) * (F.col("syy") - F.col("sy") * F.col("sy") / cells))
    return s.select(*group, F.try_divide(cov, scale).alias("value"))
