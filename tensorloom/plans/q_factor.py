"""Queries of factorisations: one update step from stated start values, held against SQL, and whole runs to convergence."""

from pyspark.sql import functions as F

from tensorloom.functions.numeric import checkpoint
from tensorloom.operators import compartments as C
from tensorloom.operators import factor as X
from tensorloom.operators import matrix as M
from tensorloom.operators import tensor as T
from tensorloom.plans import demo_data as D
from tensorloom.plans.demo_data import sql
from tensorloom.plans.q_matrix import SYM, rounded
from tensorloom.plans.q_tensor import CUM, FULL, NV, _signal_products, _small
from tensorloom.plans.registry import query

SC = ["sample", "chrom"]


def _stated(t, group, modes, rank):
    """Start values that SQL can state too: 0.5 and a share by index and component."""
    start = X.start_factors(t, group, modes, rank, 0)
    return {n: f.withColumn("value", 0.5 + (F.col("idx") * 7 + F.col("r") * 3) % 11 / 22) for n, f in start.items()}


def _f(t, column, name):
    return f"{name} as (select sample, chrom, idx, r, 0.5 + (idx * 7 + r * 3) % 11 / 22 as v from (select distinct sample, chrom, {column} as idx from {t}), (select unnest([0, 1]) as r))"


NMF = f"{SYM}, {_f('sym', 'i', 'w')}, {_f('sym', 'j', 'h')}, gm as (select a.sample, a.chrom, a.r, b.r as s, sum(a.v * b.v) as g from h a join h b on a.sample = b.sample and a.chrom = b.chrom and a.idx = b.idx group by all), dn as (select w.sample, w.chrom, w.idx, g.r, sum(w.v * g.g) as den from w join gm g on g.sample = w.sample and g.chrom = w.chrom and g.s = w.r group by all), nm as (select m.sample, m.chrom, m.i as idx, h.r, sum(m.value * h.v) as num from sym m join h on h.sample = m.sample and h.chrom = m.chrom and h.idx = m.j group by all)"


@query("nmf_step1", sql(f"+{NMF} select w.sample, w.chrom, w.idx, w.r, round(w.v * n.num / (d.den + 1e-12), 8) as value from w join dn d using (sample, chrom, idx, r) join nm n using (sample, chrom, idx, r)", "contacts"))
def nmf_step1(spark, d):
    m = checkpoint(M.symmetrize(D.contacts(spark, d)), "matrix")
    modes = [("i", "W"), ("j", "H")]
    return rounded(X.update(m, SC, modes, _stated(m, SC, modes, 2), "W"), 8)


PAIR = f"t as (select sample, chrom, i, j, value, modality from (select *, 0 as modality from sym union all select sample, chrom, i, j, value * (1 + (i + j) % 3), 1 from sym)), {_f('t', 'i', 'v')}, u as (select sample, chrom, idx, r, 0.5 + (idx * 7 + r * 3) % 11 / 22 as v from (select distinct sample, chrom, modality as idx from t), (select unnest([0, 1]) as r)), gv as (select a.sample, a.chrom, a.r, b.r as s, sum(a.v * b.v) as g from v a join v b on a.sample = b.sample and a.chrom = b.chrom and a.idx = b.idx group by all), gu as (select a.sample, a.chrom, a.r, b.r as s, sum(a.v * b.v) as g from u a join u b on a.sample = b.sample and a.chrom = b.chrom and a.idx = b.idx group by all), gm as (select gv.sample, gv.chrom, gv.r, gv.s, gv.g * gu.g as g from gv join gu using (sample, chrom, r, s)), dn as (select v.sample, v.chrom, v.idx, g.r, sum(v.v * g.g) as den from v join gm g on g.sample = v.sample and g.chrom = v.chrom and g.s = v.r group by all), nm as (select t.sample, t.chrom, t.i as idx, v.r, sum(t.value * v.v * u.v) as num from t join v on v.sample = t.sample and v.chrom = t.chrom and v.idx = t.j join u on u.sample = t.sample and u.chrom = t.chrom and u.idx = t.modality and u.r = v.r group by all)"


def _two(spark, d):
    m = checkpoint(M.symmetrize(D.contacts(spark, d)), "matrix")
    second = m.withColumn("value", F.col("value") * (1 + (F.col("i") + F.col("j")) % 3)).withColumn("modality", F.lit(1))
    return checkpoint(m.withColumn("modality", F.lit(0)).unionByName(second))


@query("ncp_sym3_step1", sql(f"+{SYM}, {PAIR} select v.sample, v.chrom, v.idx, v.r, round(v.v * sqrt(n.num / (d.den + 1e-12)), 8) as value from v join dn d using (sample, chrom, idx, r) join nm n using (sample, chrom, idx, r)", "contacts"))
def ncp_sym3_step1(spark, d):
    t = _two(spark, d)
    return rounded(X.update(t, SC, X.SYM3, _stated(t, SC, X.SYM3, 2), "V"), 8)


def _cum(spark, d):
    full = T.expand3(M.shift_min(T.third_cumulant(_small(spark, d), NV, ["chrom"]), ["chrom"]), ["chrom"])
    return checkpoint(full)


def step_sql(group: list[str], modes: list[tuple[str, str]], name: str, rank: int = 2) -> str:
    """One update of a factor over the table t, from the stated start values, as common table expressions and a query."""
    g, columns = ", ".join(group), {}
    for column, n in modes:
        columns.setdefault(n, []).append(column)
    at = next(k for k, (_, n) in enumerate(modes) if n == name)
    on = lambda a, b, *more: " and ".join(f"{a}.{c} = {b}.{c}" for c in [*group, *more])
    parts = []
    for n, found in columns.items():
        ids = " union ".join(f"select {g}, {c} as idx from t" for c in found)
        parts.append(f"start_{n} as (select {g}, idx, r, 0.5 + (idx * 7 + r * 3) % 11 / 22 as v from (select distinct * from ({ids})), (select unnest(range({rank})) as r))")
        parts.append(f"gram_{n} as (select {', '.join('a.' + c for c in group)}, a.r, b.r as s, sum(a.v * b.v) as g from start_{n} a join start_{n} b on {on('a', 'b', 'idx')} group by all)")
    others = [n for k, (_, n) in enumerate(modes) if k != at]
    grams = " ".join(f"join gram_{n} x{k} on {on('x0', f'x{k}', 'r', 's')}" for k, n in enumerate(others) if k)
    parts.append(f"gm as (select {', '.join('x0.' + c for c in group)}, x0.r, x0.s, {' * '.join(f'x{k}.g' for k in range(len(others)))} as g from gram_{others[0]} x0 {grams})")
    parts.append(f"dn as (select {', '.join('f.' + c for c in group)}, f.idx, m.r, sum(f.v * m.g) as den from start_{name} f join gm m on {on('f', 'm')} and m.s = f.r group by all)")
    terms = [(f"y{k}", c, n) for k, (c, n) in enumerate(modes) if k != at]
    joins = " ".join(f"join start_{n} {y} on {on('t', y)} and {y}.idx = t.{c}" + ("" if not k else f" and {y}.r = {terms[0][0]}.r") for k, (y, c, n) in enumerate(terms))
    parts.append(f"nm as (select {', '.join('t.' + c for c in group)}, t.{modes[at][0]} as idx, {terms[0][0]}.r, sum(t.value * {' * '.join(f'{y}.v' for y, _, _ in terms)}) as num from t {joins} group by all)")
    tied = len(columns[name])
    value = f"round(f.v * power(coalesce(n.num, 0) / (d.den + 1e-12), 1.0 / {tied}), 8)"
    return f"{', '.join(parts)} select {', '.join('f.' + c for c in group)}, f.idx, f.r, {value} as value from start_{name} f join dn d on {on('f', 'd', 'idx', 'r')} left join nm n on {on('f', 'n', 'idx', 'r')}"


def _one_step(t, group, modes, name):
    return rounded(X.update(t, group, modes, _stated(t, group, modes, 2), name), 8)


CUBE = f"{CUM}, {FULL}, t as (select chrom, i, j, k, value + greatest(-min(value) over (partition by chrom), 0) as value from fu)"


@query("ncp_full_sym_step1", f"{CUBE}, {step_sql(['chrom'], X.FULL_SYM, 'U')}")
def ncp_full_sym_step1(spark, d):
    return _one_step(_cum(spark, d), ["chrom"], X.FULL_SYM, "U")


#: samples and modalities as numbers, cells of both modalities
FOUR = "t as (select chrom, ascii(sample) % 5 as sample, modality, i, j, case modality when 0 then value else value * (1 + (i + j) % 3) end as value from sym, (select unnest([0, 1]) as modality))"


def _four(spark, d):
    return checkpoint(_two(spark, d).withColumn("sample", F.ascii("sample") % 5))


@query("ncp_4way_step1", sql(f"+{SYM}, {FOUR}, {step_sql(['chrom'], X.FOUR_WAY, 'V')}", "contacts"))
def ncp_4way_step1(spark, d):
    return _one_step(_four(spark, d), ["chrom"], X.FOUR_WAY, "V")


def _triple(spark, d):
    """Two cumulants side by side, the second weighed by its indices."""
    c = _cum(spark, d)
    second = c.withColumn("value", F.col("value") * (1 + (F.col("i") + F.col("j") + F.col("k")) % 3)).withColumn("modality", F.lit(1))
    return checkpoint(c.withColumn("modality", F.lit(0)).unionByName(second))


@query("ncp_4way_triple_step1", f"{CUBE.replace('t as (', 'c0 as (')}, t as (select chrom, modality, i, j, k, case modality when 0 then value else value * (1 + (i + j + k) % 3) end as value from c0, (select unnest([0, 1]) as modality)), {step_sql(['chrom'], X.FOUR_WAY_TRIPLE, 'V')}")
def ncp_4way_triple_step1(spark, d):
    return _one_step(_triple(spark, d), ["chrom"], X.FOUR_WAY_TRIPLE, "V")


@query("ncp_per_modality_step1", sql(f"+{SYM}, {FOUR}, {step_sql(['chrom', 'modality'], X.PER_MODALITY, 'U')}", "contacts"))
def ncp_per_modality_step1(spark, d):
    return _one_step(_four(spark, d), ["chrom", "modality"], X.PER_MODALITY, "U")


PLAIN = [("modality", "A"), ("i", "B"), ("j", "C")]


@query("ncp_step1", sql(f"+{SYM}, {FOUR.replace('ascii(sample) % 5 as sample', 'sample')}, {step_sql(SC, PLAIN, 'B')}", "contacts"))
def ncp_step1(spark, d):
    return _one_step(_two(spark, d), SC, PLAIN, "B")


@query("nmf_reconstruct", sql(f"+{NMF} select w.sample, w.chrom, w.idx as i, h.idx as j, round(sum(w.v * h.v), 8) as value from w join h using (sample, chrom, r) group by all", "contacts"))
def nmf_reconstruct(spark, d):
    m = checkpoint(M.symmetrize(D.contacts(spark, d)), "matrix")
    f = _stated(m, SC, [("i", "W"), ("j", "H")], 2)
    return rounded(X.reconstruct(f["W"], f["H"], SC), 8)


@query("nmf_fitted")
def nmf_fitted(spark, d):
    """Contact matrices and the product of their fitted factors of rank 2, side by side: (sample, chrom, i, j, value, fitted)."""
    m = checkpoint(M.symmetrize(D.contacts(spark, d)), "matrix")
    f = X.nmf(m, SC, 2)
    return m.join(X.reconstruct(f["W"], f["H"], SC).withColumnRenamed("value", "fitted"), [*SC, "i", "j"], "left").select(*SC, "i", "j", "value", "fitted")


def _run_loss(t, group, modes, rank):
    """(group, loss) of a run to a relative change of 1e-6 a sweep."""
    return X.rank_sweep(t, group, modes, [rank]).drop("rank")


@query("ncp_full_sym_loss")
def ncp_full_sym_loss(spark, d):
    t = _cum(spark, d)
    return _run_loss(t, ["chrom"], X.FULL_SYM, 2)


@query("ncp_4way_loss")
def ncp_4way_loss(spark, d):
    t = _two(spark, d)
    return _run_loss(t, ["chrom"], X.FOUR_WAY, 10)


@query("ncp_4way_triple_loss")
def ncp_4way_triple_loss(spark, d):
    t = _triple(spark, d)
    return _run_loss(t, ["chrom"], X.FOUR_WAY_TRIPLE, 2)


@query("ncp_per_modality_loss")
def ncp_per_modality_loss(spark, d):
    t, g = _two(spark, d), ["chrom", "modality"]
    return _run_loss(t, g, X.PER_MODALITY, 4)


#: the surveyed ranks, and the surveyed 200 sweeps at most
RANKS = [1, 2, 3, 4, 10, 50, 100]


@query("ncp_rank_sweep")
def ncp_rank_sweep(spark, d):
    return X.rank_sweep(_two(spark, d), SC, PLAIN, RANKS, 200)


@query("unfolded_nmf_loss")
def unfolded_nmf_loss(spark, d):
    """The matrix of samples by cells that a tensor unfolds to, factorised like any other: (chrom, loss)."""
    flat = T.unfold(D.contacts(spark, d), ["chrom", "i", "j"]).select("cell.chrom", F.col("sample").alias("i"), F.concat_ws(":", "cell.i", "cell.j").alias("j"), "value")
    return _run_loss(flat, ["chrom"], [("i", "W"), ("j", "H")], 2)


def ab_tensor(spark, d):
    """The normalised tensor of both modalities, its modalities as numbers."""
    t = T.build_cell_tensor(D.sparse(spark, d), _signal_products(spark, d), D.N_BINS)
    return checkpoint(t.withColumn("modality", F.when(F.col("modality") == "contacts", 0).otherwise(1)))


@query("ab_calls")
def ab_calls(spark, d):
    """The flow from contacts and signal to compartments: tensor, rank-2 factors of {U, V, V}, the factor and sign that correlate best with the bulk vector, its values and
    calls by sign around the vector's mean: (sample, chrom, bin, r, sign, corr, value, call)."""
    v = X.factorise(ab_tensor(spark, d), SC, X.SYM3, 2)["V"].select(*SC, F.col("idx").alias("bin"), "r", "value")
    best = checkpoint(C.best_factor(v, D.bulk(spark, d), SC), "best")
    calls = C.calls(C.pick_factor(v, best, SC), SC)
    return calls.join(best, SC, "left").select(*SC, "bin", "r", "sign", "corr", "value", "call")


@query("ab_summary")
def ab_summary(spark, d):
    """Counts of calls and the mean best correlation by chromosome and call."""
    return ab_calls(spark, d).groupBy("chrom", "call").agg(F.count("*").alias("bins"), F.avg("corr").alias("corr"))
