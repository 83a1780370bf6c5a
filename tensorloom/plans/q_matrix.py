"""Queries of contact matrices."""

from pyspark.sql import functions as F

from tensorloom.functions.numeric import checkpoint
from tensorloom.operators import matrix as M
from tensorloom.plans import demo_data as D
from tensorloom.plans.demo_data import sql
from tensorloom.plans.registry import query

SYM = "sym as (select sample, chrom, i, j, value from contacts union all select sample, chrom, j, i, value from contacts where i <> j)"
SP = "sp as (select sample, chrom, i, j, value from sparse union all select sample, chrom, j, i, value from sparse where i <> j)"
OUT = "sample, chrom, i, j, round(value, 6) as value"


def rounded(df, digits=6, *columns):
    for c in columns or ("value",):
        df = df.withColumn(c, F.round(c, digits))
    return df


def _sym(spark, d):
    return M.symmetrize(D.contacts(spark, d))


def _sp(spark, d):
    return M.symmetrize(D.sparse(spark, d))


@query("bin_pairs", sql("select sample, chrom, i, j, value from contacts", "contacts"))
def bin_pairs(spark, d):
    return D.contacts(spark, d)


@query("build_matrix", sql(f"+{SYM} select {OUT} from sym", "contacts"))
def build_matrix(spark, d):
    return rounded(_sym(spark, d))


@query("symmetrize_upper", sql(f"+{SP} select {OUT} from sp", "sparse"))
def symmetrize_upper(spark, d):
    return rounded(_sp(spark, d))


@query("emphasize", sql("select sample, chrom, i, j, value * (1 + least(abs(i - j), 11)) as value from contacts", "contacts"))
def emphasize(spark, d):
    return M.emphasize(D.contacts(spark, d), 11)


@query("emphasize_imputed", sql("select sample, chrom, i, j, value * least(abs(i - j), 11) as value from contacts where i <> j", "contacts"))
def emphasize_imputed(spark, d):
    return M.emphasize(D.contacts(spark, d), 11, 0)


@query("sparse_rows", sql(f"+{SP} select s.sample, b.chrom, b.bin, coalesce(n, 0) as filled from (select distinct sample from lp) s cross join bins b left join (select sample, chrom, i, count(*) as n from sp group by all) x on x.sample = s.sample and x.chrom = b.chrom and x.i = b.bin where coalesce(n, 0) <= 40 * 0.8", "sparse", "bins"))
def sparse_rows(spark, d):
    from tensorloom.operators.filters import sparse_rows as op

    samples = D.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("sample")).distinct()
    return op(_sp(spark, d), D.bins(spark, d), samples, D.N_BINS, share=0.2)


SPEAR = """st as (select sample, chrom, i, sum(value) / 40 as mu, sqrt(greatest(sum(value * value) / 40 - (sum(value) / 40) * (sum(value) / 40), 0)) as sd from {t} group by all),
z as (select t.sample, t.chrom, t.i, t.j, (value - mu) / {sd} as z from {t} t join st on t.sample = st.sample and t.chrom = st.chrom and t.i = st.i where {sd} > 0),
dots as (select a.sample, a.chrom, a.i, b.i as j, sum(a.z * b.z) as dot from z a join z b on a.sample = b.sample and a.chrom = b.chrom and a.j = b.j and a.i <= b.i group by all),
cor as (select d.sample, d.chrom, d.i, d.j, coalesce(d.dot / nullif(sqrt(x.dot) * sqrt(y.dot), 0), 0) as value from dots d join dots x on x.sample = d.sample and x.chrom = d.chrom and x.i = d.i and x.j = d.i join dots y on y.sample = d.sample and y.chrom = d.chrom and y.i = d.j and y.j = d.j)"""


@query("sparse_pearson", sql(f"+{SP}, {SPEAR.format(t='sp', sd='sd')} select {OUT} from cor", "sparse"))
def sparse_pearson(spark, d):
    return rounded(M.sparse_pearson(_sp(spark, d), D.N_BINS))


@query("sparse_pearson_floor", sql(f"+{SP}, {SPEAR.format(t='sp', sd='greatest(sd, 1e-10)')} select {OUT} from cor", "sparse"))
def sparse_pearson_floor(spark, d):
    return rounded(M.sparse_pearson(_sp(spark, d), D.N_BINS, floor=1e-10))


CORR = """ctr as (select s.sample, b.chrom, b.bin as i, c.bin as j, coalesce(value, 0) - avg(coalesce(value, 0)) over (partition by s.sample, b.chrom, b.bin) as v from (select distinct sample from lp) s cross join bins b join bins c on b.chrom = c.chrom left join sym m on m.sample = s.sample and m.chrom = b.chrom and m.i = b.bin and m.j = c.bin),
pr as (select a.sample, a.chrom, a.i, b.i as j, sum(a.v * b.v) as dot from ctr a join ctr b on a.sample = b.sample and a.chrom = b.chrom and a.j = b.j and a.i <= b.i group by all),
cm as (select p.sample, p.chrom, p.i, p.j, p.dot / nullif(sqrt(x.dot) * sqrt(y.dot), 0) as value from pr p join pr x on x.sample = p.sample and x.chrom = p.chrom and x.i = p.i and x.j = p.i join pr y on y.sample = p.sample and y.chrom = p.chrom and y.i = p.j and y.j = p.j)"""


@query("corr_matrix", sql(f"+{SYM}, {CORR} select {OUT} from cm", "contacts", "bins"))
def corr_matrix(spark, d):
    return rounded(M.corr_matrix(_sym(spark, d), D.N_BINS))


@query("pearson_of_matrix", sql(f"+{SYM}, {CORR} select sample, chrom, i, j, round(value + greatest(-min(value) over (partition by sample, chrom), 0), 6) as value from cm", "contacts", "bins"))
def pearson_of_matrix(spark, d):
    return rounded(M.corr_matrix(_sym(spark, d), D.N_BINS, shift=True))


@query("shift_plus_one", sql("select sample, chrom, i, j, value + 1 as value from contacts", "contacts"))
def shift_plus_one(spark, d):
    return D.contacts(spark, d).withColumn("value", F.col("value") + 1)


@query("shift_min", sql("select chrom, bin, round(value + greatest(-min(value) over (partition by chrom), 0), 4) as value from bulk", "bulk"))
def shift_min(spark, d):
    return rounded(M.shift_min(D.bulk(spark, d), ["chrom"]), 4)


@query("normalize_columns", sql(f"+{SYM} select sample, chrom, i, j, round(coalesce(value / nullif(sqrt(sum(value * value) over (partition by sample, chrom, j)), 0), 0), 8) as value from sym", "contacts"))
def normalize_columns(spark, d):
    return rounded(M.normalize(_sym(spark, d), ["sample", "chrom", "j"]), 8)


@query("normalize_columns_strict", sql("select sample, chrom, bin, r, round(value / sqrt(sum(value * value) over (partition by sample, chrom, r)), 8) as value from cells", "cells"))
def normalize_columns_strict(spark, d):
    return rounded(M.normalize_strict(D.cells(spark, d), ["sample", "chrom", "r"]), 8)


@query("normalize_frobenius", sql("select sample, chrom, i, j, round(value / sqrt(sum(value * value) over (partition by sample, chrom)), 8) as value from contacts", "contacts"))
def normalize_frobenius(spark, d):
    return rounded(M.normalize(D.contacts(spark, d), ["sample", "chrom"]), 8)


@query("normalize_rows_sum1", sql(f"+{SYM} select sample, chrom, i, j, round(coalesce(value / nullif(sum(value) over (partition by sample, chrom, i), 0), 0), 8) as value from sym", "contacts"))
def normalize_rows_sum1(spark, d):
    return rounded(M.normalize_rows_sum1(_sym(spark, d), ["sample", "chrom", "i"]), 8)


CENTRE = "c as (select sample, chrom, bin, value - avg(value) over (partition by sample, chrom) as v from vector)"


@query("outer_product", sql(f"+{CENTRE} select a.sample, a.chrom, a.bin as i, b.bin as j, round(a.v * b.v, 9) as value from c a join c b on a.sample = b.sample and a.chrom = b.chrom and a.bin <= b.bin", "vector"))
def outer_product(spark, d):
    return rounded(M.outer_product(D.vector(spark, d), limit=10_000), 9)


@query("observed_over_expected", sql("select sample, chrom, i, j, round(value / (sum(value) over (partition by sample, chrom, j - i) / (40 - (j - i))), 6) as value from contacts", "contacts"))
def observed_over_expected(spark, d):
    return rounded(M.observed_over_expected(D.contacts(spark, d), D.N_BINS))


@query("balance_step1", sql(f"+{SYM}, s as (select sample, chrom, i, sum(value) as s from sym group by all), b as (select *, s / avg(s) over (partition by sample, chrom) as b from s) select m.sample, m.chrom, m.i, m.j, round(value / (x.b * y.b), 6) as value from sym m join b x on x.sample = m.sample and x.chrom = m.chrom and x.i = m.i join b y on y.sample = m.sample and y.chrom = m.chrom and y.i = m.j", "contacts"))
def balance_step1(spark, d):
    return rounded(M.balance(_sym(spark, d), 1))


@query("leading_eigenvector_step1", sql(f"+{SYM}, v as (select sample, chrom, i as bin, sum(value) as v from sym group by all) select sample, chrom, bin, round(v / sqrt(sum(v * v) over (partition by sample, chrom)), 8) as value from v", "contacts"))
def leading_eigenvector_step1(spark, d):
    return rounded(M.leading_eigenvector(_sym(spark, d), 1), 8)


@query("impute_step1", sql(f"+{SP}, w as (select sample, chrom, i + a as i, j + b as j, sum(value) / 9 as v from sp, (select unnest([-1, 0, 1]) as a), (select unnest([-1, 0, 1]) as b) where i + a between 0 and 39 and j + b between 0 and 39 group by all), p as (select *, v / sum(v) over (partition by sample, chrom, i) as p from w) select sample, chrom, i, j, round(sum(value), 11) as value from (select sample, chrom, i, j, p * 0.5 as value from p union all select distinct sample, chrom, i, i, 0.5 from p) group by all", "sparse"))
def impute_step1(spark, d):
    return rounded(M.impute(_sp(spark, d), D.N_BINS), 11)


GAUSS = f"{SP}, w as (select sample, chrom, i + a as i, j + b as j, sum(value * exp(-(a * a + b * b) / 2.0) / power(1 + 2 * exp(-0.5), 2)) as v from sp, (select unnest([-1, 0, 1]) as a), (select unnest([-1, 0, 1]) as b) where i + a between 0 and 39 and j + b between 0 and 39 group by all), p as (select *, v / sum(v) over (partition by sample, chrom, i) as p from w), q as (select sample, chrom, i, j, sum(value) as value from (select sample, chrom, i, j, p * 0.5 as value from p union all select distinct sample, chrom, i, i, 0.5 from p) group by all)"


@query("impute_gauss_sqrtvc", sql(f"+{GAUSS} select sample, chrom, i, j, round(value / sqrt(sum(value) over (partition by sample, chrom, i) * sum(value) over (partition by sample, chrom, j)), 9) as value from q", "sparse"))
def impute_gauss_sqrtvc(spark, d):
    return rounded(M.impute(_sp(spark, d), D.N_BINS, std=1.0, sqrtvc=True), 9)


@query("balance_converged")
def balance_converged(spark, d):
    return M.balance(_sym(spark, d), 30, tolerance=1e-3)


@query("balance_roots")
def balance_roots(spark, d):
    return M.balance_roots(_sym(spark, d), 40, tolerance=1e-4)


@query("balance_newton")
def balance_newton(spark, d):
    """The same scaling by Newton steps, to 1e-9."""
    from tensorloom.operators.spectral import balance_newton as op

    return op(_sym(spark, d))


@query("balance_newton_sums", sql(f"+{SYM} select distinct sample, chrom, i, 1.0::double as row_sum from sym", "contacts"))
def balance_newton_sums(spark, d):
    """The row sums of the matrices so scaled: one each."""
    from tensorloom.operators.spectral import balance_newton as op
    from tensorloom.operators.spectral import times

    m = checkpoint(_sym(spark, d), "matrix")
    x = checkpoint(op(m), "scales")
    return rounded(x.join(times(m, x, F.col("scale")), ["sample", "chrom", "i"]).select("sample", "chrom", "i", (F.col("scale") * F.col("_w")).alias("row_sum")), 7, "row_sum")


@query("leading_eigenvector")
def leading_eigenvector(spark, d):
    """The first eigenvector of each correlation matrix, with the sign that agrees with the mark, its eigenvalue and residual."""
    from tensorloom.operators.compartments import orient
    from tensorloom.operators.spectral import lanczos

    cor = M.symmetrize(M.corr_matrix(_sym(spark, d), D.N_BINS).where("value is not null"))
    v = checkpoint(lanczos(cor), "vectors")
    facts = v.select("sample", "chrom", "eigenvalue", "residual").distinct()
    return orient(v.select("sample", "chrom", "bin", "value"), D.mark(spark, d), ["sample", "chrom"]).join(facts, ["sample", "chrom"])


NEAR = "near as (select distinct sample, chrom, i + a as i, j + b as j from sparse, (select unnest(range(-2, 3)) as a), (select unnest(range(-2, 3)) as b))"


@query("neighbourhood_mask", sql(f"+{NEAR} select c.sample, c.chrom, c.i, c.j, c.value from contacts c semi join near n on n.sample = c.sample and n.chrom = c.chrom and n.i = c.i and n.j = c.j", "contacts", "sparse"))
def neighbourhood_mask(spark, d):
    return M.mask_neighbourhood(D.contacts(spark, d), D.sparse(spark, d), 2)


@query("short_score_lines", sql("select printf('0 %s %d 0 0 %s %d 1 %.5f', chrom, i * 1000, chrom, j * 1000, value) as value from contacts", "contacts"))
def short_score_lines(spark, d):
    return M.short_score_lines(D.contacts(spark, d), D.RESOLUTION)


@query("cpg_compartment", sql(f"+{SYM} select sample, m.chrom, i as bin, round(sum(m.value * d.value) / sum(m.value), 8) as value from sym m join mark d on d.chrom = m.chrom and d.bin = m.j group by all", "contacts", "mark"))
def cpg_compartment(spark, d):
    return rounded(M.weighted_rows(_sym(spark, d), D.mark(spark, d), average=True), 8)


@query("matrix_stats", sql("select sample, chrom, case when count(*) >= 1600 then min(value) else least(min(value), 0) end as low, case when count(*) >= 1600 then max(value) else greatest(max(value), 0) end as high, count(*) filter (where value <> 0) as nonzero, round(sqrt(sum(value * value)), 6) as norm, round(sum(value) / 1600, 6) as mean from contacts group by all", "contacts"))
def matrix_stats(spark, d):
    return rounded(M.stats(D.contacts(spark, d), D.N_BINS), 6, "norm", "mean")


@query("bin_pairs_triangle", sql("select a.chrom, a.bin as i, b.bin as j from bins a join bins b on a.chrom = b.chrom and a.bin <= b.bin", "bins"))
def bin_pairs_triangle(spark, d):
    b = D.bins(spark, d)
    return M.strip_join(b.select("chrom", F.col("bin").alias("i")), b.select("chrom", F.col("bin").alias("j")), "i", "j", ["chrom"])
