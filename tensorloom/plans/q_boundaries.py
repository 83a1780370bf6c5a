"""Queries of boundaries."""

from pyspark.sql import functions as F

from tensorloom.operators import boundaries as B
from tensorloom.plans import demo_data as D
from tensorloom.plans.demo_data import sql
from tensorloom.plans.q_matrix import rounded
from tensorloom.plans.registry import query

G = ["chrom"]
EX = "ex as (select *, case when value < lag(value) over w and value < lead(value) over w then 'min' when value > lag(value) over w and value > lead(value) over w then 'max' end as extremum from curve window w as (partition by chrom order by bin))"
NB = f"{EX}, nb as (select * from (select chrom, bin, value, extremum, last_value(case when extremum = 'max' then {{'bin': bin, 'value': value}} end ignore nulls) over (partition by chrom order by bin rows between unbounded preceding and 1 preceding) as l, first_value(case when extremum = 'min' then {{'bin': bin, 'value': value}} end ignore nulls) over (partition by chrom order by bin rows between 1 following and unbounded following) as r from ex) where extremum = 'min')"


@query("local_extrema", sql(f"+{EX} select chrom, bin, extremum from ex", "curve"))
def local_extrema(spark, d):
    return B.local_extrema(D.curve(spark, d), G).select("chrom", "bin", "extremum")


@query("neighbour_extrema", sql(f"+{NB} select chrom, bin, l.bin as left_max, r.bin as right_min from nb", "curve"))
def neighbour_extrema(spark, d):
    return B.neighbours_of_minima(D.curve(spark, d), G).select("chrom", "bin", "left_max", "right_min")


@query("filter_minima", sql(f"+{NB} select chrom, bin, round(strength, 6) as strength from (select chrom, bin, coalesce(l.value - r.value, 0) as strength from nb) where strength > 1", "curve"))
def filter_minima(spark, d):
    return rounded(B.filter_minima(D.curve(spark, d), G, 1.0), 6, "strength")


@query("filter_minima_index", sql(f"+{NB} select * from (select chrom, bin, coalesce(l.bin - r.bin, 0)::double as strength from nb) where strength > -5", "curve"))
def filter_minima_index(spark, d):
    return B.filter_minima(D.curve(spark, d), G, -5, by="index")


@query("minima_flags", sql(f"+{NB} select chrom, bin, l is not null as has_left, r is not null as has_right from nb", "curve"))
def minima_flags(spark, d):
    return B.minima_flags(D.curve(spark, d), G)


@query("boundaries_scan", sql(f"+{EX} select chrom, bin, round(strength, 6) as strength from (select chrom, bin, top - low as strength from (select *, case when bin <= 5 then value else max(value) over (partition by chrom order by bin rows between 5 preceding and 1 preceding) end as top, min(value) over (partition by chrom order by bin rows between current row and 4 following) as low from ex) where extremum = 'min') where strength >= 0.2", "curve"))
def boundaries_scan(spark, d):
    return rounded(B.boundaries_scan(D.curve(spark, d), G, least=0.2), 6, "strength")


DL = "dl as (select * from (select chrom, bin, lead(value) over (partition by chrom order by bin) - value as dv from curve) where dv is not null)"


@query("boundaries_delta", sql(f"+{DL} select chrom, bin, round(top - low, 6) as strength from (select *, sign(dv) <> sign(lead(dv) over (partition by chrom order by bin)) as ch, coalesce(max(dv) over (partition by chrom order by bin rows between unbounded preceding and 1 preceding), 0) as top, coalesce(min(dv) over (partition by chrom order by bin rows between 1 following and unbounded following), 0) as low from dl) where ch", "curve"))
def boundaries_delta(spark, d):
    return rounded(B.boundaries_delta(D.curve(spark, d), G), 6, "strength")


@query("boundary_bed", sql(f"+{DL} select chrom, bin * 7200 as start, (bin + 1) * 7200 as \"end\", '.' as name, round(top - low, 6) as score, '+' as strand from (select *, sign(dv) <> sign(lead(dv) over (partition by chrom order by bin)) as ch, coalesce(max(dv) over (partition by chrom order by bin rows between unbounded preceding and 1 preceding), 0) as top, coalesce(min(dv) over (partition by chrom order by bin rows between 1 following and unbounded following), 0) as low from dl) where ch", "curve"))
def boundary_bed(spark, d):
    return rounded(B.boundary_bed(B.boundaries_delta(D.curve(spark, d), G), 7200), 6, "score")


@query("moving_average", sql("select chrom, bin, round(sum(value) over (partition by chrom order by bin rows between 3 preceding and 3 following) / 7, 6) as value from curve", "curve"))
def moving_average(spark, d):
    return rounded(D.curve(spark, d).withColumn("value", B.moving_average(G, 7)))


@query("insulation", sql("+s as (select c.sample, c.chrom, b.bin, sum(value) as s from contacts c join bins b on b.chrom = c.chrom and b.bin between 5 and 35 and c.i >= b.bin - 5 and c.i < b.bin and c.j >= b.bin and c.j < b.bin + 5 group by all) select sample, chrom, bin, round(log2(s / avg(s) over (partition by sample, chrom)), 6) as value from s", "contacts", "bins"))
def insulation(spark, d):
    return rounded(B.insulation(D.contacts(spark, d), 5, D.N_BINS, ["sample", "chrom"]))


@query("insulation_windows", sql("+w as (select unnest([3, 5, 8]) as width), s as (select c.sample, c.chrom, width, b.bin, sum(value) as s from w join bins b on b.bin between width and 40 - width join contacts c on c.chrom = b.chrom and c.i >= b.bin - width and c.i < b.bin and c.j >= b.bin and c.j < b.bin + width group by all) select sample, chrom, width, bin, round(log2(s / avg(s) over (partition by sample, chrom, width)), 6) as value from s", "contacts", "bins"))
def insulation_windows(spark, d):
    return rounded(B.insulation_windows(D.contacts(spark, d), [3, 5, 8], D.N_BINS, ["sample", "chrom"]))


@query("best_curve", sql("+c as (select v.chrom, v.sample::bigint as r, covar_pop(v.value, b.value) / nullif(stddev_pop(v.value) * stddev_pop(b.value), 0) as corr from cell_vector v join bulk b on v.chrom = b.chrom and v.bin = b.bin group by all) select chrom, r, round(corr, 8) as corr from (select *, row_number() over (partition by chrom order by corr desc, r) as rn from c where corr is not null) where rn = 1", "cell_vector", "bulk"))
def best_curve(spark, d):
    f = D.cell_vector(spark, d).withColumn("r", F.col("sample").cast("long"))
    return rounded(B.best_curve(f, D.bulk(spark, d), G), 8, "corr")


@query("smoothing_grid", sql("+fs as (select chrom, sample::bigint as r, bin, unnest([{'k': 1, 'v': value}, {'k': 3, 'v': sum(value) over (partition by chrom, sample order by bin rows between 1 preceding and 1 following) / 3}, {'k': 5, 'v': sum(value) over (partition by chrom, sample order by bin rows between 2 preceding and 2 following) / 5}]) as s from cell_vector), cs as (select chrom, bin, unnest([{'k': 1, 'v': value}, {'k': 3, 'v': sum(value) over (partition by chrom order by bin rows between 1 preceding and 1 following) / 3}, {'k': 5, 'v': sum(value) over (partition by chrom order by bin rows between 2 preceding and 2 following) / 5}]) as s from bulk), c as (select f.chrom, f.r, f.s.k as k, c.s.k as k2, covar_pop(f.s.v, c.s.v) / nullif(stddev_pop(f.s.v) * stddev_pop(c.s.v), 0) as corr from fs f join cs c on f.chrom = c.chrom and f.bin = c.bin group by all) select chrom, r, k, k2, round(corr, 8) as corr from (select *, row_number() over (partition by chrom order by corr desc, r, k, k2) as rn from c) where rn = 1", "cell_vector", "bulk"))
def smoothing_grid(spark, d):
    f = D.cell_vector(spark, d).withColumn("r", F.col("sample").cast("long")).drop("sample")
    return rounded(B.smoothing_grid(f, D.bulk(spark, d), [1, 3, 5], G), 8, "corr")
