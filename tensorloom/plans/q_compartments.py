"""Queries of compartments."""

from pyspark.sql import functions as F

from tensorloom.operators import compartments as C
from tensorloom.plans import demo_data as D
from tensorloom.plans.demo_data import sql
from tensorloom.plans.q_matrix import rounded
from tensorloom.plans.registry import query

COR = "c as (select v.sample, v.chrom, v.r, covar_pop(v.value, b.value) / nullif(stddev_pop(v.value) * stddev_pop(b.value), 0) as corr from cells v join bulk b on v.chrom = b.chrom and v.bin = b.bin group by all)"
SC = ["sample", "chrom"]


@query("orient_by_reference", sql("+c as (select v.sample, v.chrom, covar_pop(v.value, b.value) / nullif(stddev_pop(v.value) * stddev_pop(b.value), 0) as corr from cell_vector v join mark b on v.chrom = b.chrom and v.bin = b.bin group by all) select v.sample, v.chrom, v.bin, round(v.value * case when corr < 0 then -1 else 1 end, 6) as value from cell_vector v join c on c.sample = v.sample and c.chrom = v.chrom", "cell_vector", "mark"))
def orient_by_reference(spark, d):
    return rounded(C.orient(D.cell_vector(spark, d), D.mark(spark, d), SC))


BEST = f"{COR}, s as (select sample, chrom, r, g as sign, corr * g as corr from c, (select unnest([1, -1]) as g) where corr is not null), best as (select * from (select *, row_number() over (partition by sample, chrom order by corr desc, r, sign desc) as rn from s) where rn = 1)"


@query("best_factor", sql(f"+{BEST} select sample, chrom, r, sign, round(corr, 8) as corr from best", "cells", "bulk"))
def best_factor(spark, d):
    return rounded(C.best_factor(D.cells(spark, d), D.bulk(spark, d), SC), 8, "corr")


@query("pick_factor", sql(f"+{BEST} select v.sample, v.chrom, v.bin, round(v.value * sign, 6) as value from cells v join best b on b.sample = v.sample and b.chrom = v.chrom and b.r = v.r", "cells", "bulk"))
def pick_factor(spark, d):
    f = D.cells(spark, d)
    return rounded(C.pick_factor(f, C.best_factor(f, D.bulk(spark, d), SC), SC))


@query("active_factor", sql(f"+{COR} select sample, chrom, r, round(corr, 8) as corr, row_number() over (partition by sample, chrom order by corr desc, r) = 1 as active from c", "cells", "bulk"))
def active_factor(spark, d):
    return rounded(C.active_factor(D.cells(spark, d), D.bulk(spark, d), SC), 8, "corr")


@query("factor_bin_norm", sql("select sample, chrom, bin, r, round(coalesce(value / nullif(sqrt(sum(value * value) over (partition by sample, chrom, bin)), 0), 0) * 0.02 - 0.01, 9) as value from cells", "cells"))
def factor_bin_norm(spark, d):
    return rounded(C.factor_bin_norm(D.cells(spark, d), SC), 9)


def _own_other(spark, d):
    v = D.cell_vector(spark, d)
    own = C.with_corr(v, D.bulk(spark, d), SC).withColumnRenamed("corr", "own")
    other = C.with_corr(v, D.mark(spark, d), SC).withColumnRenamed("corr", "other")
    return own.join(other, SC).join(D.types(spark, d), "sample")


CP = "covar_pop(v.value, {t}.value) / nullif(stddev_pop(v.value) * stddev_pop({t}.value), 0)"
OO = f"o as (select v.sample, v.chrom, t.cell_type, {CP.format(t='b')} as own, {CP.format(t='m')} as other from cell_vector v join bulk b on b.chrom = v.chrom and b.bin = v.bin join mark m on m.chrom = v.chrom and m.bin = v.bin join types t on t.sample = v.sample group by all)"


@query("summary_by_type", sql(f"+{OO} select chrom, cell_type, round(avg(own), 8) as own, round(avg(other), 8) as other from o group by all", "cell_vector", "bulk", "mark", "types"))
def summary_by_type(spark, d):
    return rounded(C.summary_by_type(_own_other(spark, d))[0], 8, "own", "other")


@query("summary_of_types", sql(f"+{OO} select cell_type, round(avg(own), 8) as own, round(avg(other), 8) as other from (select chrom, cell_type, avg(own) as own, avg(other) as other from o group by all) group by all", "cell_vector", "bulk", "mark", "types"))
def summary_of_types(spark, d):
    return rounded(C.summary_by_type(_own_other(spark, d))[1], 8, "own", "other")


TM = "m as (select cell_type, chrom, bin, avg(value) as value from vector v join types t on t.sample = v.sample group by all)"


@query("type_bin_mean", sql(f"+{TM} select cell_type, chrom, bin, round(value, 6) as value from m", "vector", "types"))
def type_bin_mean(spark, d):
    return rounded(C.type_bin_mean(D.vector(spark, d), D.types(spark, d)))


@query("differential_ratio", sql(f"+{TM}, j as (select a.chrom, a.bin, a.value / nullif(b.value, 0) as u, b.value / nullif(a.value, 0) as w from m a join m b on a.chrom = b.chrom and a.bin = b.bin and a.cell_type = 'alpha' and b.cell_type = 'beta') select chrom, bin, case when u > 1.05 then true else false end as first, round(least(case when u > 1.05 then u else w end, 1.5), 6) as ratio from j where u > 1.05 or w > 1.05", "vector", "types"))
def differential_ratio(spark, d):
    m = C.type_bin_mean(D.vector(spark, d), D.types(spark, d))
    return rounded(C.differential_ratio(m.where("cell_type = 'alpha'"), m.where("cell_type = 'beta'"), 1.05, 1.5), 6, "ratio")


STABLE = "st as (select t.cell_type, b.chrom, b.bin, median(coalesce(v.value, 0)) as median from types t cross join bins b left join sv v on v.sample = t.sample and v.chrom = b.chrom and v.bin = b.bin group by all), sb as (select *, (median > 0.3)::bigint as a, (median < -0.3)::bigint as b from st)"
SV = "sv as (select sample, chrom, bin, value - avg(value) over (partition by sample, chrom) as value from cell_vector)"


def _stable(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("sample", "chrom")
    v = D.cell_vector(spark, d).withColumn("value", F.col("value") - F.avg("value").over(w))
    return C.stable_compartments(v, D.types(spark, d), D.bins(spark, d), 0.3)


@query("stable_compartments", sql(f"+{SV}, {STABLE} select cell_type, chrom, bin, round(median, 6) as median, a, b from sb", "cell_vector", "bins", "types"))
def stable_compartments(spark, d):
    return rounded(_stable(spark, d), 6, "median")


@query("stable_counts", sql(f"+{SV}, {STABLE} select cell_type, chrom, sum(a)::bigint as a, sum(b)::bigint as b from sb group by all", "cell_vector", "bins", "types"))
def stable_counts(spark, d):
    return C.stable_counts(_stable(spark, d))


DIFF = "df as (select x.chrom, x.bin, x.a = 1 as a_to_b from sb x join sb y on x.chrom = y.chrom and x.bin = y.bin and x.cell_type = 'alpha' and y.cell_type = 'beta' where (x.a = 1 and y.b = 1) or (x.b = 1 and y.a = 1))"


@query("differential_compartments", sql(f"+{SV}, {STABLE}, {DIFF} select * from df", "cell_vector", "bins", "types"))
def differential_compartments(spark, d):
    return C.differential_compartments(_stable(spark, d), "alpha", "beta")


@query("differential_values", sql(f"+{SV}, {STABLE}, {DIFF} select v.sample, v.chrom, v.bin, round(v.value, 6) as value from cell_vector v join df on df.chrom = v.chrom and df.bin = v.bin", "cell_vector", "bins", "types"))
def differential_values(spark, d):
    return rounded(D.cell_vector(spark, d).join(C.differential_compartments(_stable(spark, d), "alpha", "beta"), ["chrom", "bin"], "left_semi").select("sample", "chrom", "bin", "value"))


@query("isochore", "select p_partkey, case when p_size + 20 < 38 then 'L1' when p_size + 20 < 42 then 'L2' when p_size + 20 < 47 then 'H1' when p_size + 20 <= 52 then 'H2' else 'H3' end as class from part")
def isochore(spark, d):
    return D.read(spark, d, "part").withColumn("gc", F.col("p_size") + 20).select("p_partkey", C.isochore("gc").alias("class"))


GC = "cl as (select chrom, bin, case when g < 38 then 'L1' when g < 42 then 'L2' when g < 47 then 'H1' when g <= 52 then 'H2' else 'H3' end as class from (select chrom, bin, 30 + bin * 7 % 29 as g from bins))"


@query("same_category", sql(f"+{GC} select a.chrom, a.bin as i, b.bin as j from cl a join cl b on a.chrom = b.chrom and a.class = b.class and a.bin <= b.bin", "bins"))
def same_category(spark, d):
    b = D.bins(spark, d).withColumn("gc", 30 + F.col("bin") * 7 % 29)
    return C.same_category(b.withColumn("class", C.isochore("gc")), "class")
