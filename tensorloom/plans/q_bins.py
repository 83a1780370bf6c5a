"""Queries of bins, sources' cleaning rules and set operations."""

from pyspark.sql import functions as F

from tensorloom.operators import bins as B
from tensorloom.plans import demo_data as D
from tensorloom.plans.demo_data import sql
from tensorloom.plans.registry import query

P = "select l_returnflag as chrom, 1000 + 10 * max(l_partkey) as length from lineitem group by l_returnflag"


def _chroms(spark, d):
    return D.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("chrom")).agg((F.max("l_partkey") * 10 + 1000).alias("length"))


@query("make_bins", f"with s as ({P}) select chrom, bin, bin * 700 as start, least((bin + 1) * 700, length) as \"end\" from (select chrom, length, unnest(range((length + 699) // 700)) as bin from s)")
def make_bins(spark, d):
    return B.make_bins(_chroms(spark, d), 700)


@query("make_bins_floor1", f"with s as ({P}) select chrom, bin, bin * 1000 as start, least((bin + 1) * 1000, length) as \"end\" from (select chrom, length, unnest(range(length // 1000 + 1)) as bin from s)")
def make_bins_floor1(spark, d):
    return B.make_bins(_chroms(spark, d), 1000, "plus1")


@query("bin_counts", f"with s as ({P}) select chrom, length // 700 + 1 as plus1, (length + 699) // 700 as ceil, length // 700 as floor from s")
def bin_counts(spark, d):
    return _chroms(spark, d).select("chrom", *(B.bin_count(F.col("length"), 700, m).alias(m) for m in ("plus1", "ceil", "floor")))


@query("bin_index", sql("select sample, chrom, start, start // 5000 as by_start, \"end\" // 5000 as by_end, (start + \"end\") // 10000 + 1 as by_mid from signal", "signal"))
def bin_index(spark, d):
    return D.signal(spark, d).select("sample", "chrom", "start", B.bin_of(F.col("start"), 5000).alias("by_start"), B.bin_of(F.col("end"), 5000).alias("by_end"), B.mid_bin(F.col("start"), F.col("end"), 5000).alias("by_mid"))


@query("parse_resolution", "select p_partkey, 1000 * (p_size + 1)::bigint as resolution, p_type as label from part")
def parse_resolution(spark, d):
    text = F.concat(((F.col("p_size") + 1) * 1000).cast("string"), F.lit(":"), F.col("p_type"))
    return D.read(spark, d, "part").select("p_partkey", B.parse_resolution(text).alias("x")).select("p_partkey", "x.resolution", "x.label")


@query("chromosome_selection", "select 'chr' || (o_custkey % 30)::varchar as chrom, count(*) as n from orders where o_custkey % 30 < 22 group by all")
def chromosome_selection(spark, d):
    named = D.read(spark, d, "orders").select(F.when(F.col("o_custkey") % 30 < 22, F.concat(F.lit("chr"), (F.col("o_custkey") % 30).cast("string"))).otherwise(F.concat(F.lit("chrUn_"), F.col("o_custkey").cast("string"))).alias("chrom"))
    return named.where(B.is_autosome(F.col("chrom"))).groupBy("chrom").count().withColumnRenamed("count", "n")


@query("natural_order", "select c, row_number() over (order by k, c) as place from (select distinct 'chr' || case when p_size % 24 = 23 then 'X' else (p_size % 24)::varchar end as c, case when p_size % 24 = 23 then 1000 else p_size % 24 end as k from part)")
def natural_order(spark, d):
    from pyspark.sql import Window

    k = F.col("p_size") % 24
    names = D.read(spark, d, "part").select(F.concat(F.lit("chr"), F.when(k == 23, "X").otherwise(k.cast("string"))).alias("c")).distinct()
    return names.select("c", F.row_number().over(Window.orderBy(B.natural_order(F.col("c")), "c")).cast("long").alias("place"))


@query("chrom_offsets", f"with s as (select 'chr' || (p_size % 24)::varchar as chrom, p_size % 24 as k, sum(p_partkey) as length from part group by all) select chrom, coalesce(sum(length) over (order by k rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from s")
def chrom_offsets(spark, d):
    s = D.read(spark, d, "part").groupBy(F.concat(F.lit("chr"), (F.col("p_size") % 24).cast("string")).alias("chrom")).agg(F.sum("p_partkey").alias("length"))
    return B.chrom_offsets(s)


@query("genome_position", sql("select b.chrom, bin, coalesce((select sum(length) from sizes s where s.chrom < b.chrom), 0)::bigint + bin * 1000 as position from bins b", "bins"))
def genome_position(spark, d):
    return B.genome_position(D.bins(spark, d).select("chrom", "bin"), B.chrom_offsets(D.sizes(spark, d)), D.RESOLUTION)


@query("genome_vector", sql("+n as (select sample, chrom, max(bin) + 1 as n from cell_vector group by all) select v.sample, v.chrom, v.bin, round(v.value, 6) as value, v.bin + coalesce((select sum(n) from n where n.sample = v.sample and n.chrom < v.chrom), 0)::bigint as place from cell_vector v", "cell_vector"))
def genome_vector(spark, d):
    return B.genome_vector(D.cell_vector(spark, d), ["sample"]).withColumn("value", F.round("value", 6))


@query("split_genome", sql("select sample, r, chrom, bin, round(value, 6) as value from cells", "cells"))
def split_genome(spark, d):
    offsets = B.chrom_offsets(D.sizes(spark, d).withColumn("length", F.lit(D.N_BINS)))
    place = D.cells(spark, d).join(F.broadcast(offsets), "chrom").select("sample", "r", (F.col("offset") + F.col("bin")).alias("place"), "value")
    return B.split_genome(place, D.sizes(spark, d), D.RESOLUTION).withColumn("value", F.round("value", 6))


@query("reindex", sql("select sample, chrom, row_number() over (partition by sample, chrom order by b) - 1 as bin, round(value, 6) as value from (select sample, chrom, start // 600 as b, avg(value) as value from signal group by all)", "signal"))
def reindex(spark, d):
    steps = D.signal(spark, d).groupBy("sample", "chrom", F.expr("start div 600").alias("bin")).agg(F.avg("value").alias("value"))  # ten minutes, many without a value
    return B.reindex(steps, ["sample", "chrom"]).withColumn("value", F.round("value", 6))


@query("work_grid", sql("select sample, chrom, resolution from (select distinct sample from types) cross join (select chrom from sizes) cross join (select unnest([1000, 5000]) as resolution)", "types", "sizes"))
def work_grid(spark, d):
    # the grid is the product of two lists of names and the resolutions: one row a unit of work
    units = D.types(spark, d).select("sample").crossJoin(D.sizes(spark, d).select("chrom"))
    return units.withColumn("resolution", F.explode(F.array(F.lit(1000), F.lit(5000))))


A, C = "select distinct l_partkey as gene from lineitem where l_quantity > 45", "select distinct l_partkey as gene from lineitem where l_discount > 0.08"


def _sets(spark, d):
    items = D.read(spark, d, "lineitem").select(F.col("l_partkey").alias("gene"), "l_quantity", "l_discount")
    return items.where("l_quantity > 45").select("gene").distinct(), items.where("l_discount > 0.08").select("gene").distinct()


@query("union_indices", f"{A} union {C}")
def union_indices(spark, d):
    a, b = _sets(spark, d)
    return a.union(b).distinct().orderBy("gene")


@query("intersect_genes", f"{A} intersect {C}")
def intersect_genes(spark, d):
    a, b = _sets(spark, d)
    return a.intersect(b)


@query("subtract_genes", f"{A} except {C}")
def subtract_genes(spark, d):
    a, b = _sets(spark, d)
    return a.subtract(b)


@query("venn_counts", f"select count(*) filter (where b.gene is null) as only_a, count(*) filter (where a.gene is null) as only_b, count(*) filter (where a.gene = b.gene) as both from ({A}) a full join ({C}) b on a.gene = b.gene")
def venn_counts(spark, d):
    a, b = _sets(spark, d)
    j = a.withColumnRenamed("gene", "a").join(b.withColumnRenamed("gene", "b"), F.col("a") == F.col("b"), "full")
    return j.agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("a") == F.col("b")).alias("both"))


@query("concat_rows", "select p_brand as name, p_size::bigint as size, null::double as balance from part union all by name select s_name as name, s_acctbal as balance from supplier")
def concat_rows(spark, d):
    a = D.read(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_size").cast("long").alias("size"))
    b = D.read(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)
