"""Queries of tensors and cumulants."""

from pyspark.sql import functions as F

from tensorloom.functions.numeric import checkpoint
from tensorloom.operators import matrix as M
from tensorloom.operators import tensor as T
from tensorloom.plans import demo_data as D
from tensorloom.plans.demo_data import sql
from tensorloom.plans.q_matrix import SPEAR, rounded
from tensorloom.plans.registry import query

NV = 12
#: a small matrix per chromosome: mean quantity by 12 row and 12 column bins
SMALL = "small as (select l_linestatus as chrom, l_partkey % 12 as i, l_suppkey % 12 as j, avg(l_quantity) as value from lineitem group by all), ax as (select distinct chrom from small), grid as (select chrom, i, j, coalesce(value, 0) as v from (select chrom, a as i, b as j from ax, (select unnest(range(12)) as a), (select unnest(range(12)) as b)) left join small using (chrom, i, j)), ce as (select *, v - avg(v) over (partition by chrom, i) as c, avg(v) over (partition by chrom, i) as mu from grid), sd as (select chrom, i, any_value(mu) as mu, sum(c * c) / 12 as var from ce group by all)"
TRI = "tri as (select a.chrom, a.i, b.i as j, d.i as k, sum(a.c * b.c * d.c) / 12 as e, sum(a.c * b.c) / 12 as ab, sum(a.c * d.c) / 12 as ad, sum(b.c * d.c) / 12 as bd from ce a join ce b on a.chrom = b.chrom and a.j = b.j and a.i <= b.i join ce d on d.chrom = b.chrom and d.j = b.j and b.i <= d.i group by all), tj as (select t.*, x.mu as mi, y.mu as mj, z.mu as mk, x.var as vi, y.var as vj, z.var as vk from tri t join sd x on x.chrom = t.chrom and x.i = t.i join sd y on y.chrom = t.chrom and y.i = t.j join sd z on z.chrom = t.chrom and z.i = t.k)"
CUM = f"with {SMALL}, {TRI}, cum as (select chrom, i, j, k, e / nullif(sqrt(vi) * sqrt(vj) * sqrt(vk), 0) as value from tj)"
FULL = "pm as (select unnest([1, 2, 3, 4, 5, 6]) as p), fu as (select distinct chrom, case p when 1 then i when 2 then i when 3 then j when 4 then j when 5 then k else k end as i, case p when 1 then j when 2 then k when 3 then i when 4 then k when 5 then i else j end as j, case p when 1 then k when 2 then j when 3 then k when 4 then i when 5 then j else i end as k, value from cum, pm)"
G = ["chrom"]


def _small(spark, d):
    return D.read(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("chrom"), (F.col("l_partkey") % NV).alias("i"), (F.col("l_suppkey") % NV).alias("j")).agg(F.avg("l_quantity").alias("value"))


def _cum(spark, d, kind="standardised"):
    return T.third_cumulant(_small(spark, d), NV, G, kind)


@query("third_cumulant", f"{CUM} select chrom, i, j, k, round(value, 6) as value from cum")
def third_cumulant(spark, d):
    return rounded(_cum(spark, d))


@query("third_cumulant_raw", f"with {SMALL}, {TRI} select chrom, i, j, k, round(e - mi * bd - mj * ad - mk * ab + 2 * mi * mj * mk, 4) as value from tj")
def third_cumulant_raw(spark, d):
    return rounded(_cum(spark, d, "raw"), 4)


@query("hypercorrelation", f"with {SMALL}, {TRI} select chrom, i, j, k, round(12 * e / nullif(sqrt(12 * vi * 12 * vj * 12 * vk), 0), 6) as value from tj")
def hypercorrelation(spark, d):
    return rounded(_cum(spark, d, "hypercorrelation"))


@query("cumulant_shifted", f"{CUM} select chrom, i, j, k, round(value + greatest(-min(value) over (partition by chrom), 0), 6) as value from cum")
def cumulant_shifted(spark, d):
    return rounded(M.shift_min(_cum(spark, d), G))


@query("bin_triples", "select a.b as i, c.b as j, e.b as k from (select distinct p_size::bigint as b from part) a join (select distinct p_size::bigint as b from part) c on a.b <= c.b join (select distinct p_size::bigint as b from part) e on c.b <= e.b")
def bin_triples(spark, d):
    b = D.read(spark, d, "part").select(F.col("p_size").cast("long").alias("i")).distinct()
    return T.bin_triples(b.withColumn("g", F.lit(0)), ["g"]).select("i", "j", "k")


@query("cumulant_slices", f"{CUM}, {FULL} select chrom, i, j, round(sum(w), 6) as value from (select chrom, i, j, coalesce(value / nullif(sqrt(sum(value * value) over (partition by chrom, k)), 0), 0) as w from fu) group by all")
def cumulant_slices(spark, d):
    return rounded(T.cumulant_slices(_cum(spark, d), G))


@query("cumulant_collapse", f"{CUM}, {FULL} select chrom, i, j, round(sum(value), 6) as value from fu group by all")
def cumulant_collapse(spark, d):
    return rounded(T.collapse3(_cum(spark, d), G))


NEAR3 = "nr as (select distinct chrom, i + a as i, j + b as j, k + c as k from fu, (select unnest([-1, 0, 1]) as a), (select unnest([-1, 0, 1]) as b), (select unnest([-1, 0, 1]) as c) where abs(value) > 1.2)"


@query("mask3", f"{CUM}, {FULL}, {NEAR3} select f.chrom, f.i, f.j, f.k, round(f.value, 6) as value from fu f semi join nr on nr.chrom = f.chrom and nr.i = f.i and nr.j = f.j and nr.k = f.k")
def mask3(spark, d):
    full = T.expand3(_cum(spark, d), G)
    return rounded(T.mask3(full, full.where("abs(value) > 1.2"), 1, G))


@query("combine_cumulants", f"{CUM}, {FULL}, a as (select * from fu where i < 11 and j < 11 and k < 11), b as (select chrom, i, j, k, case when value > 0.5 then 0.5 when value < 0 and abs(value) > 0.4 then -1.0 else 0 end as value from fu where i < 11 and j < 11 and k < 11), nr as (select distinct chrom, i + x as i, j + y as j, k + z as k from a, (select unnest([-1, 0, 1]) as x), (select unnest([-1, 0, 1]) as y), (select unnest([-1, 0, 1]) as z)), st as (select *, 'contacts' as modality from a union all select b.*, 'signal' from b semi join nr on nr.chrom = b.chrom and nr.i = b.i and nr.j = b.j and nr.k = b.k where value <> 0), no as (select chrom, i, j, k, modality, value / sqrt(sum(value * value) over (partition by chrom, modality)) as v from st) select chrom, i, j, k, modality, round(v + greatest(-min(v) over (partition by chrom, modality), 0), 6) as value from no")
def combine_cumulants(spark, d):
    full = T.expand3(_cum(spark, d), G)
    return rounded(T.combine_cumulants(full, full, NV - 1, 0.5, 0.4, G))


TENSOR = f"""cc as (select sample, chrom, i, j, value from sparse where i < 39 and j < 39), sp as (select sample, chrom, i, j, value from cc union all select sample, chrom, j, i, value from cc where i <> j),
{SPEAR.format(t="sp", sd="sd").replace("/ 40", "/ 39")}, cf as (select sample, chrom, i, j, value from cor union all select sample, chrom, j, i, value from cor where i <> j),
sg as (select a.sample, a.chrom, a.bin as i, b.bin as j, (a.value - 25) * (b.value - 25) as value from sv a join sv b on a.sample = b.sample and a.chrom = b.chrom where a.bin < 39 and b.bin < 39),
nr as (select distinct sample, chrom, i + a as i, j + b as j from sp, (select unnest(range(-2, 3)) as a), (select unnest(range(-2, 3)) as b)),
stk as (select *, 'contacts' as modality from cf union all select sg.*, 'signal' from sg semi join nr on nr.sample = sg.sample and nr.chrom = sg.chrom and nr.i = sg.i and nr.j = sg.j),
ra as (select sample, chrom, modality, i, j, value + greatest(-min(value) over (partition by sample, chrom, modality), 0) as v from stk),
co as (select sample, chrom, modality, i, j, coalesce(v / nullif(sqrt(sum(v * v) over (partition by sample, chrom, modality, j)), 0), 0) as v from ra)"""
SV = "sv as (select l_returnflag as sample, l_linestatus as chrom, l_partkey * 40 // (select max(l_partkey) + 1 from lineitem) as bin, avg(l_quantity) as value from lineitem group by all)"


def _signal_products(spark, d):
    v = D._part_bin(D.read(spark, d, "lineitem")).groupBy(F.col("l_returnflag").alias("sample"), F.col("l_linestatus").alias("chrom"), "bin").agg((F.avg("l_quantity") - 25).alias("v"))
    v = checkpoint(v, "signal")
    a, b = v.select("sample", "chrom", F.col("bin").alias("i"), F.col("v").alias("a")), v.select("sample", "chrom", F.col("bin").alias("j"), F.col("v").alias("b"))
    return M.strip_join(a, b, "i", "j", ["sample", "chrom"]).select("sample", "chrom", "i", "j", (F.col("a") * F.col("b")).alias("value"))


@query("build_cell_tensor", sql(f"+{SV}, {TENSOR} select sample, chrom, modality, i, j, round(v / sqrt(sum(v * v) over (partition by sample, chrom, modality)), 8) as value from co", "sparse"))
def build_cell_tensor(spark, d):
    return rounded(T.build_cell_tensor(D.sparse(spark, d), _signal_products(spark, d), D.N_BINS), 8)


@query("downsample_slices", sql("select sample, chrom, i, j, value, 0 as slice from contacts union all select sample, chrom, i, j, value, 1 from (select *, row_number() over (partition by sample, chrom order by md5(concat_ws(':', '11', sample, chrom, i::varchar, j::varchar)), i, j) as n from contacts) where n <= 1600 * 30 // 100", "contacts"))
def downsample_slices(spark, d):
    return T.downsample_slices(D.contacts(spark, d), ["i", "j"], 30, F.lit(D.N_BINS**2), ["sample", "chrom"], 11).select("sample", "chrom", "i", "j", "value", "slice")


@query("unfold", sql("select sample, dense_rank() over (order by chrom, i, j) - 1 as col, value from contacts", "contacts"))
def unfold(spark, d):
    """The matrix of samples by numbered cells that the tensor unfolds to."""
    return T.unfold_numbered(D.contacts(spark, d), ["chrom", "i", "j"])


@query("unfold_columns", sql("select chrom, i, j, row_number() over (order by chrom, i, j) - 1 as col from (select distinct chrom, i, j from contacts)", "contacts"))
def unfold_columns(spark, d):
    """Which cell each column of the unfolded matrix is."""
    return T.unfold_columns(D.contacts(spark, d), ["chrom", "i", "j"])


@query("flat_corr", sql("+f as (select s.sample, b.chrom, b.bin as i, c.bin as j, coalesce(x.value, 0) as x, coalesce(y.value, 0) as y from (select distinct sample from lp) s cross join bins b join bins c on b.chrom = c.chrom left join contacts x on x.sample = s.sample and x.chrom = b.chrom and x.i = b.bin and x.j = c.bin left join sparse y on y.sample = s.sample and y.chrom = b.chrom and y.i = b.bin and y.j = c.bin) select sample, chrom, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) as value from f group by all", "contacts", "sparse", "bins"))
def flat_corr(spark, d):
    return rounded(T.flat_corr(D.contacts(spark, d), D.sparse(spark, d), ["i", "j"], D.N_BINS**2, ["sample", "chrom"]))


@query("concat_sample_factors", sql("select sample, dense_rank() over (order by chrom, r, bin) - 1 as col, round(value / sqrt(sum(value * value) over (partition by chrom, r, bin)), 8) as value from cells", "cells"))
def concat_sample_factors(spark, d):
    return rounded(T.concat_sample_factors(D.cells(spark, d), ["chrom", "r", "bin"]), 8)
