"""Non-negative factorisation of matrices and tensors, single steps as joins and sums, whole runs by coordinate descent (HALS).

A tensor is a table of group columns, one index column per mode and `value`; absent cells are zeros. Factors are tables (group, idx, r, value) by name; modes that
share a name share a factor. All groups are factorised in the same job: the group columns ride along in every join.

A run goes two ways, with the same start, the same updates and the same end. Groups of up to GROUP_CELLS stored cells, by a count, are gathered, each in one
task, and run there to convergence: thousands of small tensors are one shuffle. The cells of larger groups stay where they are: factors are packed as one array per
index, a sweep joins the cells to them once per mode (sent to all tasks up to MOST_NUMBERS numbers, by a count; by a shuffle beyond), sums the products by index with
map-side combine and updates the packed rows by array; every sweep's factors are written, so no lineage grows.
"""

from __future__ import annotations

import functools
import operator
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.numeric import checkpoint, discard

EPS = 1e-12
GROUP_CELLS = 2_000_000
MOST_NUMBERS = 2_000_000


def start_value(columns: list[Column], seed: int) -> Column:
    """A number in [0.1, 1.1) from the hash of the columns and a seed."""
    return F.crc32(F.concat_ws(":", *(c.cast("string") for c in columns), F.lit(str(seed))).cast("binary")) % 1_000_003 / 1_000_003.0 + 0.1


def start_factors(t: DataFrame, group: list[str], modes: list[tuple[str, str]], rank: int, seed: int) -> dict[str, DataFrame]:
    """Start values for each factor over all its indices. modes: (index column, factor name)."""
    out: dict[str, DataFrame] = {}
    for name in dict.fromkeys(n for _, n in modes):
        ids = None
        for column in (c for c, n in modes if n == name):
            found = t.select(*group, F.col(column).alias("idx"))
            ids = found if ids is None else ids.unionByName(found)
        laid = ids.distinct().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rank - 1))))
        out[name] = laid.withColumn("value", start_value([F.lit(name), F.col("idx").cast("string"), F.col("r")], seed))
    return out


def _mttkrp(t: DataFrame, group: list[str], modes: list[tuple[str, str]], factors: dict[str, DataFrame], at: int) -> DataFrame:
    """(group, idx, r, num): the tensor times the factors of all modes but one."""
    cells, first = t, True
    for k, (column, name) in enumerate(modes):
        if k == at:
            continue
        f = factors[name].select(*group, F.col("idx").alias(column), F.col("r"), F.col("value").alias("_f"))
        cells = cells.join(f, [*group, column] if first else [*group, column, "r"])
        cells = cells.withColumn("value", F.col("value") * F.col("_f")).drop("_f")
        first = False
    return cells.groupBy(*group, F.col(modes[at][0]).alias("idx"), "r").agg(F.sum("value").alias("num"))


def _gram(group: list[str], factor: DataFrame) -> DataFrame:
    other = factor.select(*group, "idx", F.col("r").alias("s"), F.col("value").alias("_o"))
    return factor.join(other, [*group, "idx"]).groupBy(*group, "r", "s").agg(F.sum(F.col("value") * F.col("_o")).alias("gram"))


def _grams(group: list[str], modes: list[tuple[str, str]], factors: dict[str, DataFrame], at: int | None) -> DataFrame:
    out = None
    for k, (_, name) in enumerate(modes):
        if k == at:
            continue
        g = _gram(group, factors[name])
        out = g if out is None else out.join(g.withColumnRenamed("gram", "_g"), [*group, "r", "s"]).withColumn("gram", F.col("gram") * F.col("_g")).drop("_g")
    return out


def update(t: DataFrame, group: list[str], modes: list[tuple[str, str]], factors: dict[str, DataFrame], name: str) -> DataFrame:
    """One multiplicative step of one factor. A factor shared by p modes moves by the p-th root of the ratio, which keeps the loss from rising."""
    at = next(k for k, (_, n) in enumerate(modes) if n == name)
    factors = dict(factors)
    tied = sum(n == name for _, n in modes)
    f = factors[name]
    den = f.select(*group, "idx", F.col("r").alias("s"), F.col("value").alias("_v")).join(_grams(group, modes, factors, at), [*group, "s"])
    den = den.groupBy(*group, "idx", "r").agg(F.sum(F.col("_v") * F.col("gram")).alias("den"))
    j = f.join(den, [*group, "idx", "r"]).join(_mttkrp(t, group, modes, factors, at), [*group, "idx", "r"], "left")
    ratio = F.coalesce("num", F.lit(0.0)) / (F.col("den") + EPS)
    return j.select(*group, "idx", "r", (F.col("value") * (F.pow(ratio, F.lit(1.0 / tied)) if tied > 1 else ratio)).alias("value"))


def loss(t: DataFrame, group: list[str], modes: list[tuple[str, str]], factors: dict[str, DataFrame]) -> DataFrame:
    """(group, loss): squared error relative to the squared norm, from sums over the stored cells: |T|² - 2 <T, model> + |model|²."""
    square = t.groupBy(*group).agg(F.sum(F.col("value") * F.col("value")).alias("_t"))
    f = factors[modes[0][1]]
    inner = f.join(_mttkrp(t, group, modes, factors, 0), [*group, "idx", "r"]).groupBy(*group).agg(F.sum(F.col("value") * F.col("num")).alias("_i"))
    model = _grams(group, modes, factors, None).groupBy(*group).agg(F.sum("gram").alias("_m"))
    j = square.join(inner, group).join(model, group) if group else square.crossJoin(F.broadcast(inner)).crossJoin(F.broadcast(model))
    return j.select(*group, F.greatest((F.col("_t") - 2 * F.col("_i") + F.col("_m")) / F.col("_t"), F.lit(0.0)).alias("loss"))


def hals(rows: np.ndarray, product: np.ndarray, gram: np.ndarray, tied: int = 1) -> np.ndarray:
    """New rows of a factor by coordinate descent: one component after the other takes its best non-negative value for the others as they are. product: the
    tensor times the factors of the other modes, gram: their Gram matrices' product. A factor of `tied` modes goes the tied-th part of the way, the Newton step
    of a product of so many equal factors."""
    new = rows.copy()
    for _ in range(2):
        for r in range(rows.shape[1]):
            if gram[r, r] > EPS:
                new[:, r] = np.maximum(new[:, r] + (product[:, r] - new @ gram[:, r]) / gram[r, r], 0.0)
    return np.maximum(rows + (new - rows) / tied, 1e-16)


def multiplicative(rows: np.ndarray, product: np.ndarray, gram: np.ndarray, tied: int = 1) -> np.ndarray:
    """New rows by the multiplicative step, which never raises the loss: the way out where coordinate descent of a tied factor does."""
    return rows * (np.maximum(product, 0.0) / (rows @ gram + EPS)) ** (1.0 / tied)


def _solve(cells: np.ndarray, at: list[np.ndarray], names: list[str], start: dict[str, np.ndarray], steps: int, tolerance: float) -> tuple[dict[str, np.ndarray], float, int]:
    """(factors, loss, sweeps) of one tensor of stored cells with index numbers `at` by mode."""
    factors, square, rank = dict(start), float(cells @ cells), next(iter(start.values())).shape[1]
    grams = {n: f.T @ f for n, f in factors.items()}
    # for each mode the cells by its index, and where each index begins
    order = [np.argsort(i, kind="stable") for i in at]
    starts = [np.flatnonzero(np.diff(i[o], prepend=-1)) for i, o in zip(at, order, strict=True)]
    step = max(1, 2_000_000 // rank)
    untied = names.count(names[-1]) == 1
    last: list[np.ndarray] = []

    def product(mode: int) -> np.ndarray:
        out = np.zeros_like(factors[names[mode]])
        o, own, begins = order[mode], at[mode][order[mode]], starts[mode]
        rest = [(factors[n], i[o]) for k, (n, i) in enumerate(zip(names, at, strict=True)) if k != mode]
        for lo in range(0, len(o), step):
            w = cells[o[lo : lo + step], None]
            for f, i in rest:
                w = w * f[i[lo : lo + step]]
            cut = np.unique(np.append(0, begins[(begins > lo) & (begins < lo + step)] - lo))
            out[own[lo + cut]] += np.add.reduceat(w, cut, axis=0)
        return out

    def others(mode: int) -> np.ndarray:
        return functools.reduce(operator.mul, (grams[n] for k, n in enumerate(names) if k != mode))

    def sweep(step: Callable) -> None:
        for n in factors:
            mode = names.index(n)
            p = product(mode)
            factors[n] = step(factors[n], p, others(mode), names.count(n))
            grams[n] = factors[n].T @ factors[n]
            last[:] = [p]

    def loss() -> float:
        # the product that a factor of one mode was just made of still holds
        mode, p = (len(names) - 1, last[0]) if untied and last else (0, product(0))
        inner = float(np.sum(factors[names[mode]] * p))
        return max((square - 2 * inner + float(np.sum(others(mode) * grams[names[mode]]))) / square, 0.0) if square else 0.0

    now, done = loss(), 0
    while done < steps:
        kept = dict(factors), dict(grams)
        sweep(hals)
        new = loss()
        if new > now:
            factors.update(kept[0]), grams.update(kept[1])
            sweep(multiplicative)
            new = loss()
        done += 1
        still = abs(now - new) <= tolerance * max(now, 1e-300)
        now = new
        if tolerance and still:
            break
    return factors, now, done


def _in_tasks(t: DataFrame, group: list[str], modes: list[tuple[str, str]], ranks: list[int], steps: int, seed: int, tolerance: float) -> DataFrame:
    """(group, rank, name, idx, r, value) of small groups, idx as text; a row without a name has the loss as value and the sweeps as r."""
    names = [n for _, n in modes]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.select(*group).schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, np.ndarray] = {n: np.array(sorted({str(x) for c, m in modes if m == n for x in pdf[c].unique()})) for n in names}
        at = [np.searchsorted(found[n], pdf[c].astype(str).to_numpy(dtype=str)) for c, n in modes]
        out = []
        for rank in ranks:
            start = {n: np.array([[zlib.crc32(f"{n}:{i}:{r}:{seed}".encode()) % 1_000_003 / 1_000_003.0 + 0.1 for r in range(rank)] for i in ids]) for n, ids in found.items()}
            factors, loss, sweeps = _solve(pdf["value"].to_numpy(float), at, names, start, steps, tolerance)
            out.append(pd.DataFrame({"rank": [rank], "name": [None], "idx": [None], "r": [sweeps], "value": [loss]}))
            for n, f in factors.items():
                out.append(pd.DataFrame({"rank": rank, "name": n, "idx": np.repeat(found[n], rank), "r": np.tile(np.arange(rank), len(f)), "value": f.ravel()}))
        made = pd.concat(out, ignore_index=True)
        for k, g in enumerate(group):
            made.insert(k, g, [pdf[g].iloc[0]] * len(made))
        return made

    return t.groupBy(*group).applyInPandas(run, f"{kinds}{', ' if group else ''}rank int, name string, idx string, r int, value double")


def _packed(f: DataFrame, group: list[str]) -> DataFrame:
    """(group, idx, f): a factor's rows as arrays by r."""
    return f.groupBy(*group, "idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]).alias("_row"))


def _packed_gram(f: DataFrame, group: list[str], rank: int) -> DataFrame:
    """(group, g): the Gram matrix as one array."""
    cells = [F.sum(F.col("_row")[a] * F.col("_row")[b]) for a in range(rank) for b in range(rank)]
    return f.groupBy(*group).agg(F.array(*cells).alias("_gram"))


def _joined(t: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return t.join(other, on) if on else t.crossJoin(other)  # one row where there is no group


def _packed_product(t: DataFrame, group: list[str], modes: list[tuple[str, str]], factors: dict[str, DataFrame], small: dict[str, bool], rank: int, at: int) -> DataFrame:
    """(group, idx, p): the tensor times the factors of the other modes, one join a mode and one sum by index."""
    cells = t
    for k, (column, name) in enumerate(modes):
        if k != at:
            f = factors[name].select(*group, F.col("idx").alias(column), F.col("_row").alias(f"_f{k}"))
            cells = cells.join(F.broadcast(f) if small[name] else f, [*group, column])
    each = [functools.reduce(operator.mul, (F.col(f"_f{k}")[r] for k in range(len(modes)) if k != at), F.col("value")) for r in range(rank)]
    return cells.groupBy(*group, F.col(modes[at][0]).alias("idx")).agg(F.array(*(F.sum(e) for e in each)).alias("_prod"))


def _packed_others(group: list[str], modes: list[tuple[str, str]], grams: dict[str, DataFrame], at: int | None) -> DataFrame:
    out = None
    for k, (_, name) in enumerate(modes):
        if k != at:
            g = grams[name]
            out = g if out is None else _joined(out, g.withColumnRenamed("_gram", "_other"), group).withColumn("_gram", F.zip_with("_gram", "_other", lambda x, y: x * y)).drop("_other")
    return out


def _rows_by(step: Callable, tied: int):
    """A pandas UDF over packed rows, products and Gram matrices: rows that share a matrix are updated together."""

    def run(f: pd.Series, p: pd.Series, g: pd.Series) -> pd.Series:
        rows, products, grams = (np.stack(x.to_numpy()).astype(float) for x in (f, p, g))
        new = np.empty_like(rows)
        kinds, which = np.unique(grams, axis=0, return_inverse=True)
        for k, gram in enumerate(kinds):
            own = which.ravel() == k
            new[own] = step(rows[own], products[own], gram.reshape(rows.shape[1], -1), tied)
        return pd.Series(list(new))

    run.__annotations__ = {"f": pd.Series, "p": pd.Series, "g": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<double>")


def _in_joins(t: DataFrame, group: list[str], modes: list[tuple[str, str]], rank: int, steps: int, seed: int, tolerance: float) -> tuple[dict[str, DataFrame], DataFrame]:
    """(packed factors by name, (group, loss)) of large groups. One number a sweep reaches the driver, the mean loss; a group whose loss a sweep raised keeps its
    factors of before for one multiplicative sweep."""
    names = list(dict.fromkeys(n for _, n in modes))
    factors = {n: checkpoint(_packed(f, group), "factor") for n, f in start_factors(t, group, modes, rank, seed).items()}
    small = {n: f.count() * rank <= MOST_NUMBERS for n, f in factors.items()}
    square = checkpoint(t.groupBy(*group).agg(F.sum(F.col("value") * F.col("value")).alias("_t")), "square")
    zeros = F.array(*[F.lit(0.0)] * rank)

    def losses(fs: dict[str, DataFrame], grams: dict[str, DataFrame]) -> DataFrame:
        f, p = fs[modes[0][1]], _packed_product(t, group, modes, fs, small, rank, 0)
        inner = f.join(p, [*group, "idx"]).groupBy(*group).agg(F.sum(F.aggregate(F.zip_with("_row", "_prod", lambda x, y: x * y), F.lit(0.0), operator.add)).alias("_i"))
        model = _packed_others(group, modes, grams, None).select(*group, F.aggregate("_gram", F.lit(0.0), operator.add).alias("_m"))
        j = _joined(_joined(square, inner, group), model, group)
        return checkpoint(j.select(*group, F.greatest(F.coalesce(F.try_divide(F.col("_t") - 2 * F.col("_i") + F.col("_m"), F.col("_t")), F.lit(0.0)), F.lit(0.0)).alias("loss")), "loss")

    def sweep(fs: dict[str, DataFrame], grams: dict[str, DataFrame], step: Callable) -> tuple[dict, dict]:
        fs, grams = dict(fs), dict(grams)
        for n in names:
            mode, tied = next(k for k, (_, m) in enumerate(modes) if m == n), sum(m == n for _, m in modes)
            p = _packed_product(t, group, modes, fs, small, rank, mode)
            j = _joined(fs[n].join(p, [*group, "idx"], "left").withColumn("_prod", F.coalesce("_prod", zeros)), _packed_others(group, modes, grams, mode), group)
            fs[n] = checkpoint(j.select(*group, "idx", _rows_by(step, tied)("_row", "_prod", "_gram").alias("_row")), "factor")
            grams[n] = checkpoint(_packed_gram(fs[n], group, rank), "gram")
        return fs, grams

    grams = {n: checkpoint(_packed_gram(f, group, rank), "gram") for n, f in factors.items()}
    now = losses(factors, grams)
    for _ in range(steps):
        new, new_grams = sweep(factors, grams, hals)
        after = losses(new, new_grams)
        was = now.withColumnRenamed("loss", "_was")
        both = _joined(after, was, group)
        moved, rose = both.agg(F.max(F.abs(F.col("loss") - F.col("_was")) / F.greatest("_was", F.lit(1e-300))), F.count_if(F.col("loss") > F.col("_was"))).first()
        if rose:
            back, back_grams = sweep(factors, grams, multiplicative)
            up = checkpoint(both.select(*group, (F.col("loss") > F.col("_was")).alias("_up")), "rose")
            pick = lambda a, b: _joined(a.withColumn("_up", F.lit(False)).unionByName(b.withColumn("_up", F.lit(True))), up.withColumnRenamed("_up", "_u"), group).where("_up = _u").drop("_up", "_u")
            new = {n: checkpoint(pick(new[n], back[n]), "factor") for n in names}
            new_grams = {n: checkpoint(pick(new_grams[n], back_grams[n]), "gram") for n in names}
            after = losses(new, new_grams)
            moved = _joined(after, was, group).agg(F.max(F.abs(F.col("loss") - F.col("_was")) / F.greatest("_was", F.lit(1e-300)))).first()[0]
        discard(*factors.values(), *grams.values(), now)
        factors, grams, now = new, new_grams, after
        if tolerance and (moved or 0.0) <= tolerance:
            break
    return factors, now


def _index_types(t: DataFrame, modes: list[tuple[str, str]]) -> dict[str, str]:
    kinds = dict(t.dtypes)
    return {n: "string" if len({kinds[c] for c, m in modes if m == n}) > 1 else kinds[next(c for c, m in modes if m == n)] for n in dict.fromkeys(n for _, n in modes)}


def fits(t: DataFrame, group: list[str], modes: list[tuple[str, str]], ranks: list[int], steps: int = 500, seed: int = 0, tolerance: float = 1e-6, group_cells: int = GROUP_CELLS) -> DataFrame:
    """(group, rank, name, idx, r, value) after at most `steps` sweeps for each rank, ended when the loss of a group changes by under `tolerance` in a sweep,
    relatively; idx as text. The rows without a name have the loss as value. An empty table gives no rows."""
    t = checkpoint(t.select(*group, *dict.fromkeys(c for c, _ in modes), F.col("value").cast("double").alias("value")), "tensor")
    sizes = checkpoint(t.groupBy(*group).agg(F.count("*").alias("_cells")), "sizes")
    large = sizes.where(F.col("_cells") > group_cells).drop("_cells")
    if large.isEmpty():
        return _in_tasks(t, group, modes, ranks, steps, seed, tolerance)
    if group:
        few, many = t.join(large, group, "left_anti"), checkpoint(t.join(large, group, "left_semi"), "tensor")
    else:
        few, many = t.limit(0), t
    out = _in_tasks(few, group, modes, ranks, steps, seed, tolerance) if group else None
    for rank in ranks:
        factors, loss = _in_joins(many, group, modes, rank, steps, seed, tolerance)
        told = [loss.select(*group, F.lit(rank).alias("rank"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("idx"), F.lit(None).cast("int").alias("r"), F.col("loss").alias("value"))]
        told += [f.select(*group, F.lit(rank).alias("rank"), F.lit(n).alias("name"), F.col("idx").cast("string").alias("idx"), F.posexplode("_row").alias("r", "value")) for n, f in factors.items()]
        for part in told:
            out = part if out is None else out.unionByName(part)
    return out


def factorise(t: DataFrame, group: list[str], modes: list[tuple[str, str]], rank: int, steps: int = 500, seed: int = 0, tolerance: float = 1e-6, group_cells: int = GROUP_CELLS) -> dict[str, DataFrame]:
    """Factors (group, idx, r, value) by name of one run of `fits`, written once."""
    done = checkpoint(fits(t, group, modes, [rank], steps, seed, tolerance, group_cells), "fit")
    return {n: done.where(F.col("name") == n).select(*group, F.col("idx").cast(kind).alias("idx"), "r", "value") for n, kind in _index_types(t, modes).items()}


def nmf(m: DataFrame, group: list[str], rank: int, steps: int = 500, seed: int = 0) -> dict[str, DataFrame]:
    """W and H of a matrix (group, i, j, value)."""
    return factorise(m, group, [("i", "W"), ("j", "H")], rank, steps, seed)


def reconstruct(w: DataFrame, h: DataFrame, group: list[str]) -> DataFrame:
    a = w.select(*group, F.col("idx").alias("i"), "r", F.col("value").alias("_w"))
    b = h.select(*group, F.col("idx").alias("j"), "r", F.col("value").alias("_h"))
    return a.join(b, [*group, "r"]).groupBy(*group, "i", "j").agg(F.sum(F.col("_w") * F.col("_h")).alias("value"))


#: tied structures: three modes with a symmetric pair, a symmetric triple, four modes with a symmetric pair or triple, per modality
SYM3 = [("modality", "U"), ("i", "V"), ("j", "V")]
FULL_SYM = [("i", "U"), ("j", "U"), ("k", "U")]
FOUR_WAY = [("sample", "W"), ("modality", "U"), ("i", "V"), ("j", "V")]
FOUR_WAY_TRIPLE = [("modality", "U"), ("i", "V"), ("j", "V"), ("k", "V")]
PER_MODALITY = [("sample", "V"), ("i", "U"), ("j", "U")]


def rank_sweep(t: DataFrame, group: list[str], modes: list[tuple[str, str]], ranks: list[int], steps: int = 500, seed: int = 0, tolerance: float = 1e-6) -> DataFrame:
    """(group, rank, loss) for each rank, all ranks of the small groups in one job."""
    done = fits(t, group, modes, ranks, steps, seed, tolerance)
    return done.where("name is null").select(*group, "rank", F.col("value").alias("loss"))
