"""Queries of statistics."""

from pyspark.sql import functions as F

from tensorloom.functions.numeric import pearson
from tensorloom.operators import stats as S
from tensorloom.plans import demo_data as D
from tensorloom.plans.demo_data import sql
from tensorloom.plans.q_matrix import rounded
from tensorloom.plans.registry import query

MR = "rank() over (partition by {g} order by {v}) + (count(*) over (partition by {g}, {v}) - 1) / 2"


@query("corr_pair", sql("select v.sample, v.chrom, round(covar_pop(v.value, b.value) / nullif(stddev_pop(v.value) * stddev_pop(b.value), 0), 8) as value from cell_vector v join bulk b on v.chrom = b.chrom and v.bin = b.bin group by all", "cell_vector", "bulk"))
def corr_pair(spark, d):
    j = D.cell_vector(spark, d).join(D.bulk(spark, d).withColumnRenamed("value", "b"), ["chrom", "bin"])
    return rounded(j.groupBy("sample", "chrom").agg(pearson("value", "b").alias("value")), 8)


@query("mid_rank", f"select event_id, {MR.format(g='event_type', v='floor(value)')} as r from events")
def mid_rank(spark, d):
    e = D.read(spark, d, "events").withColumn("v", F.floor("value"))
    return S.mid_ranks(e, "v", ["event_type"], "r").select("event_id", "r")


@query("spearman", f"select l_linestatus as chrom, round(covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)), 8) as value from (select l_linestatus, {MR.format(g='l_linestatus', v='l_quantity')} as rx, {MR.format(g='l_linestatus', v='l_extendedprice')} as ry from lineitem) group by all")
def spearman(spark, d):
    return rounded(S.spearman(D.read(spark, d, "lineitem").withColumnRenamed("l_linestatus", "chrom"), "l_quantity", "l_extendedprice", ["chrom"]), 8)


KS = "s as (select p_size::bigint % 12 as i, p_retailprice as value from part), sz as (select i, count(*) as n from s group by all), st as (select a.i, b.i as j, a.n, b.n as m from sz a join sz b on a.i < b.i), u as (select st.*, value, sum(1.0::double / n) as w from st join s on s.i = st.i group by all union all select st.*, value, sum(-1.0::double / m) from st join s on s.i = st.j group by all), g as (select i, j, n, m, value, sum(w) as w from u group by all), d as (select i, j, n, m, max(abs(r)) as d from (select *, sum(w) over (partition by i, j order by value rows between unbounded preceding and current row) as r from g) group by all)"


def _ks(spark, d):
    s = D.read(spark, d, "part").select((F.col("p_size").cast("long") % 12).alias("i"), F.col("p_retailprice").alias("value"))
    ids = s.select("i").distinct()
    return S.ks_statistic(s, ids.join(ids.withColumnRenamed("i", "j"), F.col("i") < F.col("j")))


@query("ks_pairs", f"with {KS} select i, j, n, m, round(d, 8) as d, round(log10(d + 1e-10), 6) as log_d from d")
def ks_pairs(spark, d):
    return _ks(spark, d).select("i", "j", "n", "m", F.round("d", 8).alias("d"), F.round(F.log10(F.col("d") + 1e-10), 6).alias("log_d"))


@query("ks_pvalues")
def ks_pvalues(spark, d):
    return S.ks_pvalues(_ks(spark, d)).withColumn("log_p", F.log10(F.col("p") + 1e-10))


PP = "a as (select chrom, bin, value - avg(value) over (partition by chrom, bin // 4) as v, bin // 4 as i, bin % 4 as k from bulk), p as (select x.chrom, x.i, y.i as j, sum(x.v * y.v) as dot from a x join a y on x.chrom = y.chrom and x.k = y.k and x.i <= y.i group by all)"


@query("pearson_pairs", sql(f"+{PP} select p.chrom, p.i, p.j, round(log10(1 + coalesce(p.dot / nullif(sqrt(q.dot) * sqrt(r.dot), 0), 0) + 1e-10), 6) as value from p join p q on q.chrom = p.chrom and q.i = p.i and q.j = p.i join p r on r.chrom = p.chrom and r.i = p.j and r.j = p.j", "bulk"))
def pearson_pairs(spark, d):
    rows = D.bulk(spark, d).groupBy("chrom", F.expr("bin div 4").alias("i")).agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "value"))), lambda x: x["value"]).alias("x"))
    return rounded(S.pearson_pairs(rows, ["chrom"]))


@query("linear_fit", "select l_linestatus as chrom, round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept from lineitem group by all")
def linear_fit(spark, d):
    f = S.linear_fit(D.read(spark, d, "lineitem").withColumnRenamed("l_linestatus", "chrom"), "l_quantity", "l_extendedprice", ["chrom"])
    return rounded(rounded(f, 6, "slope"), 4, "intercept")


@query("hist2d", "with b as (select min(l_extendedprice) x0, max(l_extendedprice) x1, min(l_tax) y0, max(l_tax) y1, count(*) n from lineitem) select least(floor((l_extendedprice - x0) / ((x1 - x0) / 20)), 19)::bigint as cx, least(floor((l_tax - y0) / ((y1 - y0) / 20)), 19)::bigint as cy, round(sum(1.0::double / (n * ((x1 - x0) / 20) * ((y1 - y0) / 20))), 9) as density from lineitem, b group by all")
def hist2d(spark, d):
    return rounded(S.hist2d(D.read(spark, d, "lineitem"), "l_extendedprice", "l_tax"), 9, "density")


GS = "g as (select l_linestatus as chrom, l_returnflag = 'A' as side, count(*) as n, avg(l_quantity) as mean, var_samp(l_quantity) as var from lineitem group by all)"


@query("group_stats", f"with {GS} select chrom, side, n, round(mean, 6) as mean, round(var, 6) as var from g")
def group_stats(spark, d):
    return rounded(S.group_stats(_sides(spark, d), "l_quantity", ["chrom", "side"]), 6, "mean", "var")


def _sides(spark, d):
    return D.read(spark, d, "lineitem").select(F.col("l_linestatus").alias("chrom"), (F.col("l_returnflag") == "A").alias("side"), "l_quantity")


@query("welch_t", f"with {GS} select a.chrom, round((a.mean - b.mean) / sqrt(a.var / a.n + b.var / b.n), 6) as t, round(power(a.var / a.n + b.var / b.n, 2) / (power(a.var / a.n, 2) / (a.n - 1) + power(b.var / b.n, 2) / (b.n - 1)), 3) as df from g a join g b on a.chrom = b.chrom and a.side and not b.side")
def welch_t(spark, d):
    g = S.group_stats(_sides(spark, d), "l_quantity", ["chrom", "side"])
    return rounded(rounded(S.welch_t(g.where("side").drop("side"), g.where("not side").drop("side"), ["chrom"]), 6, "t"), 3, "df")


@query("density_2d", "with p as (select p_partkey, p_size::double as x, p_retailprice as y from part), k as (select count(*) n, var_samp(x) a, var_samp(y) b, covar_samp(x, y) c from p), f as (select n, a * b - c * c as det, power(n, -1.0 / 3) as h, a, b, c from k), g as (select n, b / det / h as ia, a / det / h as ib, -c / det / h as ic, 2 * pi() * sqrt(det) * h as area from f) select q.p_partkey as id, round(sum(exp(-0.5 * (ia * (p.x - q.x) * (p.x - q.x) + ib * (p.y - q.y) * (p.y - q.y) + 2 * ic * (p.x - q.x) * (p.y - q.y))) / (n * area)), 10) as density from p, p q, g where q.p_partkey % 100 = 0 group by all")
def density_2d(spark, d):
    p = D.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return rounded(S.density_2d(p.drop("id"), p.where("id % 100 = 0")), 10, "density")


@query("density_all")
def density_all(spark, d):
    """The density at every part, by the grid."""
    p = D.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return S.density_grid(p)


RS = """cl as (select doc_id as cell, lang as grp from documents), sz as (select grp, count(*) as n1 from cl group by all), tot as (select count(*) as n from cl),
ct as (select cell, gene, sum(value) as v from counts group by all), s as (select gene, grp, v, count(*) as k from ct join cl using (cell) group by all),
p as (select gene, v, sum(k) as t from s group by all), r as (select gene, v, t, sum(t) over (partition by gene order by v) - (t - 1) / 2 as mid from p),
g as (select gene, sum(t)::double as nz, sum(t * v) as all_sum, sum(t::double * t * t - t) as ties from p group by gene),
o as (select s.gene, s.grp, sum(k * mid) as rs, sum(k) as k, sum(k * v) as own from s join r using (gene, v) group by all),
j as (select g.gene, sz.grp, n1::double as n1, n::double as n, n - nz as z0, all_sum, ties, coalesce(rs, 0) as rs, coalesce(k, 0) as k, coalesce(own, 0) as own from g cross join sz cross join tot left join o on o.gene = g.gene and o.grp = sz.grp),
us as (select *, rs + k * z0 + (n1 - k) * (z0 + 1) / 2 - n1 * (n1 + 1) / 2 as u, n1 * (n - n1) / 12 * ((n + 1) - (ties + z0 * z0 * z0 - z0) / (n * (n - 1))) as var from j)"""


@query("rank_genes", sql(f"+{RS} select gene, grp, n1::bigint as n1, (n - n1)::bigint as n2, u, round((u - n1 * (n - n1) / 2) / nullif(sqrt(greatest(var, 0)), 0), 6) as z, round(log2(own / n1 + 1e-9) - log2((all_sum - own) / (n - n1) + 1e-9), 6) as log_fold_change from us", "counts"))
def rank_genes(spark, d):
    return rounded(_ranked(spark, d, _cell_counts(spark, d)), 6, "z", "log_fold_change")


def _cell_counts(spark, d):
    """(cell, gene, value), counted once by cell and gene."""
    return D.words(spark, d).groupBy(F.col("doc_id").alias("cell"), "gene").agg(F.count("*").cast("double").alias("value"))


def _ranked(spark, d, counts):
    cells = D.read(spark, d, "documents").select(F.col("doc_id").alias("cell"), F.col("lang").alias("grp"))
    return S.rank_sum(counts, cells)


@query("rank_genes_adjusted")
def rank_genes_adjusted(spark, d):
    p = _ranked(spark, d, _cell_counts(spark, d)).withColumn("p", S.normal_tail(F.col("z"))).where("p is not null")
    return S.benjamini_hochberg(p, "p", ["grp"], ["gene"]).where("p_adjusted < 0.05").withColumn("up", F.col("log_fold_change") > 0)
