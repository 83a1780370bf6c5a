"""Queries of filters, masks, projections and joins."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tensorloom.functions import numeric as N
from tensorloom.functions.numeric import scratch_path
from tensorloom.operators import filters as P
from tensorloom.plans import demo_data as D
from tensorloom.plans.demo_data import sql
from tensorloom.plans.q_matrix import rounded
from tensorloom.plans.registry import query
from tensorloom.sources import writers as W

READS = "reads as (select (l_suppkey % 6)::varchar as sample, 'chr' || (l_partkey % 3 + 1)::varchar as chrom, l_orderkey % 61 as mapq, (l_orderkey * 7) % 2048 as flag from lineitem)"
DARK = "dark as (select chrom, bin from mark where bin % 7 = 3)"


def _reads(spark, d):
    return D.read(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 6).cast("string").alias("sample"), F.concat(F.lit("chr"), (F.col("l_partkey") % 3 + 1).cast("string")).alias("chrom"),
        (F.col("l_orderkey") % 61).alias("mapq"), (F.col("l_orderkey") * 7 % 2048).alias("flag"),
    )


def _dark(spark, d):
    return D.mark(spark, d).where("bin % 7 = 3").select("chrom", "bin")


@query("good_reads", f"with {READS} select sample, chrom, count(*) as n from reads where mapq >= 30 and flag & 1 = 1 and flag & 1804 = 0 group by all")
def good_reads(spark, d):
    r = _reads(spark, d)
    return r.where(P.good_read(F.col("mapq"), F.col("flag"))).groupBy("sample", "chrom").count().withColumnRenamed("count", "n")


@query("cell_filter", f"with {READS}, g as (select sample, chrom, count(*) as n from reads where mapq >= 30 and flag & 1 = 1 and flag & 1804 = 0 group by all) select sample, sum(n)::bigint as total from g group by sample having count(*) = (select count(distinct chrom) from reads) and sum(n) >= 1")
def cell_filter(spark, d):
    r = _reads(spark, d)
    return P.cell_filter(r, r.select("chrom").distinct(), 1)


@query("drop_small_add_diagonal", sql("+s as (select sample, chrom, i, j, value - 1 as value from sparse) select sample, chrom, i, j, round(sum(value), 8) as value from (select * from s where value >= 1e-10 union all select distinct sample, chrom, x, x, 1e-5 from (select sample, chrom, unnest([i, j]) as x from s)) group by all", "sparse"))
def drop_small_add_diagonal(spark, d):
    return rounded(P.drop_small_add_diagonal(D.sparse(spark, d).withColumn("value", F.col("value") - 1), ["sample", "chrom"]), 8)


@query("mask_dark_bins", sql(f"+{DARK} select v.sample, v.chrom, v.bin, case when k.bin is null then round(v.value, 6) end as value from cell_vector v left join dark k on k.chrom = v.chrom and k.bin = v.bin", "cell_vector", "mark"))
def mask_dark_bins(spark, d):
    return rounded(P.mask_bins(D.cell_vector(spark, d), _dark(spark, d)))


@query("remove_dark_bins", sql(f"+{DARK}, k as (select chrom, bin, row_number() over (partition by chrom order by bin) - 1 as n from bins b anti join dark x on x.chrom = b.chrom and x.bin = b.bin) select c.sample, c.chrom, a.n as i, b.n as j, value from contacts c join k a on a.chrom = c.chrom and a.bin = c.i join k b on b.chrom = c.chrom and b.bin = c.j", "contacts", "bins", "mark"))
def remove_dark_bins(spark, d):
    return P.remove_bins(D.contacts(spark, d), _dark(spark, d), D.bins(spark, d))


@query("remove_vector_bins", sql(f"+{DARK} select sample, v.chrom, row_number() over (partition by sample, v.chrom order by bin) - 1 as bin, round(value, 6) as value from cell_vector v anti join dark k on k.chrom = v.chrom and k.bin = v.bin", "cell_vector", "mark"))
def remove_vector_bins(spark, d):
    return rounded(P.remove_vector_bins(D.cell_vector(spark, d), _dark(spark, d), ["sample", "chrom"]))


@query("clip_deviations", sql("+c as (select chrom, bin, least(greatest(value, m - 1.5 * s), m + 1.5 * s) as v from (select *, avg(value) over (partition by chrom) as m, stddev_pop(value) over (partition by chrom) as s from bulk)) select chrom, bin, round(v / sqrt(sum(v * v) over (partition by chrom)), 8) as value from c", "bulk"))
def clip_deviations(spark, d):
    return rounded(P.clip_deviations(D.bulk(spark, d), ["chrom"], 1.5), 8)


@query("clip_fixed", "select event_id, case when value < 5 then 5.0 when value > 40 then 5.0 else value end as to_low, case when value < 5 then 5.0 when value > 40 then 40.0 else value end as to_bound from events")
def clip_fixed(spark, d):
    v = F.col("value")
    return D.read(spark, d, "events").select("event_id", N.clip(v, 5.0, 40.0, 5.0).alias("to_low"), N.clip(v, 5.0, 40.0).alias("to_bound"))


@query("drop_z_outliers", "select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem, (select avg(l_extendedprice) m, stddev_pop(l_extendedprice) s, avg(l_quantity) m2, stddev_pop(l_quantity) s2 from lineitem) where abs(l_extendedprice - m) / s <= 1.5 and abs(l_quantity - m2) / s2 <= 1.5")
def drop_z_outliers(spark, d):
    return P.drop_z_outliers(D.read(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"], 1.5).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("drop_iqr_outliers", "select event_id, value from events, (select quantile_cont(value, 0.25) a, quantile_cont(value, 0.75) b from events) where value between a - 1.5 * (b - a) and b + 1.5 * (b - a)")
def drop_iqr_outliers(spark, d):
    return P.drop_iqr_outliers(D.read(spark, d, "events").select("event_id", "value"), ["value"])


@query("tri_level", "select event_id, case when value - 50 > 20 then 20.0::double when value - 50 < 0 and abs(value - 50) > 30 then -1.0::double else 0.0::double end as level from events")
def tri_level(spark, d):
    return D.read(spark, d, "events").select("event_id", N.tri_level(F.col("value") - 50, 20.0, 30.0).alias("level"))


@query("pad_equal", sql("select coalesce(a.sample, b.sample) as sample, coalesce(a.chrom, b.chrom) as chrom, coalesce(a.i, b.i) as i, coalesce(a.j, b.j) as j, coalesce(a.value, 0) as a, coalesce(b.value, 0) as b from contacts a full join sparse b on a.sample = b.sample and a.chrom = b.chrom and a.i = b.i and a.j = b.j", "contacts", "sparse"))
def pad_equal(spark, d):
    a = D.contacts(spark, d).withColumnRenamed("value", "a")
    b = D.sparse(spark, d).withColumnRenamed("value", "b")
    return a.join(b, ["sample", "chrom", "i", "j"], "full").select("sample", "chrom", "i", "j", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))


@query("crop", sql("select * from contacts where i < 39 and j < 39", "contacts"))
def crop(spark, d):
    return P.crop(D.contacts(spark, d), D.N_BINS - 1)


@query("label_types", "select c_custkey, case upper(c_mktsegment) when 'BUILDING' then 'ALPHA' when 'MACHINERY' then 'BETA' else 'UNKNOWN' end as cell_type, case when upper(c_mktsegment) = 'BUILDING' then 1 else 0 end::bigint as is_alpha, case upper(c_mktsegment) when 'BUILDING' then 0 when 'MACHINERY' then 1 else 2 end::bigint as rank from customer")
def label_types(spark, d):
    s = F.upper("c_mktsegment")
    kind = F.coalesce(F.create_map(F.lit("BUILDING"), F.lit("ALPHA"), F.lit("MACHINERY"), F.lit("BETA"))[s], F.lit("UNKNOWN"))
    rank = F.when(kind == "ALPHA", 0).when(kind == "BETA", 1).otherwise(2).cast("long")
    return D.read(spark, d, "customer").select("c_custkey", kind.alias("cell_type"), (kind == "ALPHA").cast("long").alias("is_alpha"), rank.alias("rank"))


@query("parse_names", "select p_partkey, split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b, regexp_extract(p_brand, '#([0-9]+)', 1)::bigint as number from part")
def parse_names(spark, d):
    w = F.split("p_name", " ")
    return D.read(spark, d, "part").select("p_partkey", w[0].alias("a"), F.get(w, F.lit(1)).alias("b"), F.regexp_extract("p_brand", "#([0-9]+)", 1).cast("long").alias("number"))


@query("one_hot", "select l_orderkey, l_linenumber, l_partkey, (l_returnflag = 'A')::bigint as is_A, (l_returnflag = 'N')::bigint as is_N, (l_returnflag = 'R')::bigint as is_R from lineitem")
def one_hot(spark, d):
    return P.one_hot(D.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"), "l_returnflag", ["A", "N", "R"]).drop("l_returnflag")


XY = "xy as (select l_linestatus as chrom, l_partkey as bin, avg(l_quantity) as x, avg(l_discount) as y, avg(l_tax) - 0.04 as e from lineitem group by all)"


def _xy(spark, d):
    return D.read(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("chrom"), F.col("l_partkey").alias("bin")).agg(F.avg("l_quantity").alias("x"), F.avg("l_discount").alias("y"), (F.avg("l_tax") - 0.04).alias("e"))


@query("two_way_category", f"with {XY} select chrom, bin, case when x > avg(x) over w and y < avg(y) over w then 'x' when y > avg(y) over w and x < avg(x) over w then 'y' else 'none' end as category from xy window w as (partition by chrom)")
def two_way_category(spark, d):
    xy = _xy(spark, d)
    return xy.select("chrom", "bin", P.two_way(xy, "x", "y", ["chrom"]).alias("category"))


@query("quadrants", f"with {XY} select chrom, bin, case when x > avg(x) over (partition by chrom) then 'high' else 'low' end || case when e > 0 then '_A' else '_B' end as category from xy")
def quadrants(spark, d):
    mean = F.avg("x").over(Window.partitionBy("chrom"))
    return _xy(spark, d).select("chrom", "bin", P.quadrants(F.col("x"), mean, F.col("e")).alias("category"))


@query("missing_audit", "select event_type, count(*) filter (where v = 0) as zeros, count(*) filter (where v is null or isnan(v)) as missing, count(*) filter (where isinf(v)) as infinite, count(*) as n from (select event_type, case event_id % 10 when 0 then 0.0 when 1 then null when 2 then 'nan'::double when 3 then 'infinity'::double else value end as v from events) group by all")
def missing_audit(spark, d):
    return P.audit(_holes(spark, d), "v", ["event_type"])


def _holes(spark, d):
    k = F.col("event_id") % 10
    v = F.when(k == 0, 0.0).when(k == 1, F.lit(None)).when(k == 2, F.lit(float("nan"))).when(k == 3, F.lit(float("inf"))).otherwise(F.col("value"))
    return D.read(spark, d, "events").select("event_type", v.alias("v"))


@query("finite_mean", "select event_type, round(avg(v), 6) as mean from (select event_type, case event_id % 10 when 0 then 0.0 else value end as v from events where event_id % 10 not in (1, 2, 3)) group by all")
def finite_mean(spark, d):
    return rounded(P.finite_mean(_holes(spark, d), "v", ["event_type"]), 6, "mean")


@query("methyl_ratio", "select o_custkey % 6 as sample, month(o_orderdate)::bigint as bin, round(coalesce(count(*) filter (where o_orderstatus = 'F') / nullif(count(*) filter (where o_orderstatus <> 'O'), 0), 0), 8) as value from orders group by all")
def methyl_ratio(spark, d):
    o = D.read(spark, d, "orders").groupBy((F.col("o_custkey") % 6).alias("sample"), F.month("o_orderdate").cast("long").alias("bin"))
    c = o.agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"), F.count_if(F.col("o_orderstatus") != "O").alias("m"))
    return c.select("sample", "bin", F.round(N.methyl_ratio(F.col("n"), F.col("m")), 8).alias("value"))


@query("missing_inputs", "select s_suppkey as sample, exists (select 1 from lineitem where l_suppkey = s_suppkey and l_quantity = 1 and l_discount > 0.07) as present from supplier")
def missing_inputs(spark, d):
    samples = D.read(spark, d, "supplier").select(F.col("s_suppkey").alias("sample"))
    have, lost = P.keep_missing(samples, D.read(spark, d, "lineitem").where("l_quantity = 1 and l_discount > 0.07").select(F.col("l_suppkey").alias("sample")))
    return have.withColumn("present", F.lit(True)).unionByName(lost.withColumn("present", F.lit(False)))


@query("join_vectors", sql("select v.chrom, v.bin, round(v.value, 6) as a, round(m.value, 8) as b from bulk v join mark m on v.chrom = m.chrom and v.bin = m.bin where v.bin % 5 <> 0", "bulk", "mark"))
def join_vectors(spark, d):
    a = D.bulk(spark, d).withColumn("a", F.when(F.col("bin") % 5 != 0, F.round("value", 6))).drop("value")
    b = D.mark(spark, d).select("chrom", "bin", F.round("value", 8).alias("b"))
    return a.join(b, ["chrom", "bin"]).where(F.col("a").isNotNull() & F.col("b").isNotNull())


@query("first_of_duplicates", "select gene, size, k from (select p_type as gene, p_size::bigint as size, p_partkey as k, row_number() over (partition by p_type order by p_partkey) as rn from part) where rn = 1")
def first_of_duplicates(spark, d):
    p = D.read(spark, d, "part").select(F.col("p_type").alias("gene"), F.col("p_size").cast("long").alias("size"), F.col("p_partkey").alias("k"))
    return P.first_of_duplicates(p, ["gene"], ["k"])


@query("feature_subset", "select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey in (select p_partkey from part where p_size < 5)")
def feature_subset(spark, d):
    keep = D.read(spark, d, "part").where("p_size < 5").select(F.col("p_partkey").alias("l_partkey"))
    return D.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(keep, "l_partkey", "left_semi")


@query("stack_modalities", sql("+b as (select sample, chrom, i, j, value from contacts union all select sample, chrom, bin, bin, round(value, 6) from cell_vector), a as (select * from sparse) select sample, chrom, i, j, value, 'contacts' as modality from a union all select sample, k.chrom, bin, bin, 1.0, 'contacts' from (select distinct sample, chrom from b where (sample, chrom) not in (select distinct (sample, chrom) from a)) k join bins on bins.chrom = k.chrom union all select sample, chrom, i, j, value, 'signal' from b", "contacts", "sparse", "bins", "cell_vector"))
def stack_modalities(spark, d):
    # the samples of the vectors have no contacts and get the identity
    v = D.cell_vector(spark, d).select("sample", "chrom", F.col("bin").alias("i"), F.col("bin").alias("j"), F.round("value", 6).alias("value"))
    return P.stack_modalities(D.sparse(spark, d), D.contacts(spark, d).unionByName(v), D.bins(spark, d))


@query("reference_order", "select o_orderkey, coalesce(p.p_partkey, -1) as place from orders left join part p on p.p_partkey = o_custkey * 3")
def reference_order(spark, d):
    ref = D.read(spark, d, "part").select(F.col("p_partkey").alias("place"))
    o = D.read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 3).alias("want"))
    return o.join(ref, o.want == ref.place, "left").select("o_orderkey", F.coalesce("place", F.lit(-1)).alias("place"))


@query("order_by_type", sql("+m as (select v.sample, t.cell_type, round(avg(value), 6) as level from cell_vector v join types t on t.sample = v.sample group by all) select sample, cell_type, level, row_number() over (order by case cell_type when 'alpha' then 0 else 1 end, level desc, sample) as place from m", "cell_vector", "types"))
def order_by_type(spark, d):
    m = D.cell_vector(spark, d).join(D.types(spark, d), "sample").groupBy("sample", "cell_type").agg(F.round(F.avg("value"), 6).alias("level"))
    w = Window.orderBy(F.when(F.col("cell_type") == "alpha", 0).otherwise(1), F.desc("level"), "sample")
    return m.withColumn("place", F.row_number().over(w).cast("long")).orderBy("place")


@query("order_by_level", sql("+m as (select sample, round(avg(value), 6) as level from cell_vector group by all) select *, row_number() over (order by level desc, sample) as place from m", "cell_vector"))
def order_by_level(spark, d):
    m = N.checkpoint(D.cell_vector(spark, d).groupBy("sample").agg(F.round(F.avg("value"), 6).alias("level")), "levels")
    return N.row_numbers(m, [], [F.desc("level"), F.col("sample")], "place").orderBy("place")


@query("random_mask", sql("select sample, chrom, i, j, value from contacts where left(md5(concat_ws(':', '7', sample, chrom, i::varchar, j::varchar)), 8) < '19999999'", "contacts"))
def random_mask(spark, d):
    from tensorloom.operators.tensor import random_mask as op

    return op(D.contacts(spark, d), ["sample", "chrom", "i", "j"], 0.1, 7)


@query("block_ids", sql("select sample, chrom, i // 10 as bi, j // 10 as bj, i, j, value from contacts", "contacts"))
def block_ids(spark, d):
    path = scratch_path(spark, "blocks")
    W.write_blocks(D.contacts(spark, d), path, 10)
    return spark.read.parquet(path).select("sample", "chrom", F.col("bi").cast("long").alias("bi"), F.col("bj").cast("long").alias("bj"), "i", "j", "value")
