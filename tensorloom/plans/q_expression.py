"""Queries of expression operators."""

from statistics import median

from pyspark.sql import functions as F

from tensorloom.functions.numeric import checkpoint, row_numbers
from tensorloom.operators import expression as E
from tensorloom.operators.components import randomised_pca
from tensorloom.operators.neighbours import knn_index
from tensorloom.plans import demo_data as D
from tensorloom.plans.demo_data import sql
from tensorloom.plans.q_matrix import rounded
from tensorloom.plans.registry import query

QC = "per as (select dataset, cell, count(*) filter (where value > 0) as genes, sum(value) as total, coalesce(sum(value) filter (where gene like 'th%'), 0) as m, coalesce(sum(value) filter (where gene like 'in%'), 0) as r from counts group by all)"


@query("cell_qc", sql(f"+{QC} select dataset, cell, genes, total, round(m / total, 8) as mito, round(r / total, 8) as ribo from per where genes between 20 and 2000 and total between 50 and 5000 and m / total <= 0.2 and r / total <= 0.1", "counts"))
def cell_qc(spark, d):
    return rounded(E.cell_qc(D.counts(spark, d), ["dataset", "cell"], "th", "in", (20, 2000), (50, 5000), 0.2, 0.1), 8, "mito", "ribo")


@query("cell_qc_n_cells", sql(f"+{QC} select dataset, cell, genes, total, round(m / (select count(*) from per), 8) as mito, round(r / (select count(*) from per), 8) as ribo from per where genes between 20 and 2000 and total between 50 and 5000 and m / (select count(*) from per) <= 0.2 and r / (select count(*) from per) <= 0.1", "counts"))
def cell_qc_n_cells(spark, d):
    return rounded(E.cell_qc(D.counts(spark, d), ["dataset", "cell"], "th", "in", (20, 2000), (50, 5000), 0.2, 0.1, "n_cells"), 8, "mito", "ribo")


ZG = "select l_partkey as gene, l_returnflag as dataset, case when l_partkey % 9 = 0 then 0.0 else l_quantity end as value from lineitem"


def _zg(spark, d):
    return D.read(spark, d, "lineitem").select(F.col("l_partkey").alias("gene"), F.col("l_returnflag").alias("dataset"), F.when(F.col("l_partkey") % 9 == 0, 0.0).otherwise(F.col("l_quantity")).alias("value"))


@query("zero_genes", f"select gene from ({ZG}) group by gene having max(value) <= 0")
def zero_genes(spark, d):
    return E.zero_genes(_zg(spark, d))


@query("drop_zero_genes", f"with c as ({ZG}) select dataset, gene, value from c where gene not in (select gene from c group by gene having max(value) <= 0)")
def drop_zero_genes(spark, d):
    return E.drop_zero_genes(_zg(spark, d)).select("dataset", "gene", "value")


NT = "tt as (select dataset, cell, sum(value) as t from counts group by all), nt as (select c.dataset, c.grp, c.cell, gene, ln(1 + value * (select median(t) from tt) / t) as value from counts c join tt on tt.dataset = c.dataset and tt.cell = c.cell)"


@query("normalize_total", sql(f"+{NT} select dataset, grp, cell, gene, round(value, 6) as value from nt", "counts"))
def normalize_total(spark, d):
    return rounded(E.normalize_total(D.counts(spark, d), ["dataset", "cell"]).select("dataset", "grp", "cell", "gene", "value"))


RB = "c as (select l_returnflag as dataset, l_partkey % 40 as cell, l_suppkey % 15 as gene, sum(l_quantity) as value from lineitem group by all), g as (select dataset, cell, gene, coalesce(value, 0) as value from (select unnest(['A', 'N', 'R']) as dataset) cross join (select unnest(range(40)) as cell) cross join (select unnest(range(15)) as gene) left join c using (dataset, cell, gene)), q as (select dataset, quantile_cont(ln(1 + value), 0.25) as a, quantile_cont(ln(1 + value), 0.75) as b from g group by all)"


@query("robust_scale", f"with {RB} select c.dataset, cell, gene, round((ln(1 + value) - a) / (b - a + 1e-10), 6) as value from c join q on q.dataset = c.dataset")
def robust_scale(spark, d):
    c = D.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("dataset"), (F.col("l_partkey") % 40).alias("cell"), (F.col("l_suppkey") % 15).alias("gene")).agg(F.sum("l_quantity").alias("value"))
    cells = c.select("dataset").distinct().withColumn("total", F.lit(600))
    return rounded(E.robust_scale(c, ["dataset"], cells))


@query("global_minimum", "select round(min(l_extendedprice), 4) as low from lineitem")
def global_minimum(spark, d):
    return D.read(spark, d, "lineitem").agg(F.round(F.min("l_extendedprice"), 4).alias("low"))


@query("blocks", "select o_orderstatus as dataset, o_orderkey, n // 100 as block, n % 100 as place from (select *, row_number() over (partition by o_orderstatus order by o_orderkey) - 1 as n, count(*) over (partition by o_orderstatus) as c from orders) where n // 100 < c // 100")
def blocks(spark, d):
    o = D.read(spark, d, "orders").select(F.col("o_orderstatus").alias("dataset"), "o_orderkey")
    return E.blocks(o, ["dataset"], "o_orderkey", 100)


@query("align_min_rows", "select o_orderstatus as dataset, o_orderkey from (select *, row_number() over (partition by o_orderstatus order by o_orderkey) as n from orders) where n <= (select min(c) from (select count(*) as c from orders group by o_orderstatus))")
def align_min_rows(spark, d):
    return E.align_min_rows(D.read(spark, d, "orders").select(F.col("o_orderstatus").alias("dataset"), "o_orderkey"), ["dataset"], "o_orderkey")


@query("log_fold_change", sql("+s as (select *, value / sum(value) over (partition by tissue, age) * 1e4 as p from wide) select s.tissue, s.age, s.gene, round(log2(s.p / (b.p + 1e-6) + 1e-6), 6) as value from s join s b on b.tissue = s.tissue and b.gene = s.gene and b.age = 1996 where s.age <> 1996", "wide"))
def log_fold_change(spark, d):
    return rounded(E.log_fold_change(D.wide(spark, d), 1996))


@query("log_fold_plus_one", sql("select s.tissue, s.age, s.gene, round(log2((s.value + 1) / (b.value + 1)), 6) as value from wide s join wide b on b.tissue = s.tissue and b.gene = s.gene and b.age = 1996", "wide"))
def log_fold_plus_one(spark, d):
    return rounded(E.log_fold_plus_one(D.wide(spark, d), 1996))


@query("zscore", sql("select tissue, age, gene, round(coalesce((value - avg(value) over w) / nullif(stddev_pop(value) over w, 0), 0), 6) as value from wide window w as (partition by tissue, age)", "wide"))
def zscore(spark, d):
    return rounded(E.zscore(D.wide(spark, d), ["tissue", "age"]))


@query("everywhere_genes", sql("select gene from wide where value > 0 group by gene having count(distinct tissue) = (select count(distinct tissue) from wide)", "wide"))
def everywhere_genes(spark, d):
    return E.everywhere_genes(D.wide(spark, d))


@query("replicate_means", sql("select gene, flag, status, round(avg(value), 6) as value from replicates group by all", "replicates"))
def replicate_means(spark, d):
    return rounded(E.replicate_means(D.replicates(spark, d), ["gene", "flag", "status"]))


@query("split_names", "select name, round(avg(p_retailprice), 6) as price from (select unnest(string_split(p_name, ' ')) as name, p_retailprice from part) where name <> '' group by all")
def split_names(spark, d):
    p = D.read(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    return rounded(E.split_names(p, "name", " ", ["price"]), 6, "price")


@query("cluster_of", "select l_partkey as gene, case when count(distinct l_suppkey) > 1 then -1 else min(l_suppkey) end as cluster from lineitem group by all")
def cluster_of(spark, d):
    return E.cluster_of(D.read(spark, d, "lineitem").select(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("cluster")), "gene", "cluster")


@query("cluster_sizes", "select cluster, count(*) as n from (select l_partkey as gene, case when count(distinct l_suppkey) > 1 then -1 else min(l_suppkey) end as cluster from lineitem group by all) group by all")
def cluster_sizes(spark, d):
    return cluster_of(spark, d).groupBy("cluster").agg(F.count("*").alias("n"))


MK = "mk as (select gene, case when length(gene) % 3 = 0 then 'a' when length(gene) % 3 = 1 then 'b' else 'c' end as cell_type from (select gene from counts group by gene having count(*) >= 20))"


@query("marker_cell_type", sql(f"+{MK} select cell, cell_type, round(level, 8) as level from (select *, row_number() over (partition by cell order by level desc, cell_type) as rn from (select cell, cell_type, avg(value) as level from counts join mk using (gene) group by all)) where rn = 1", "counts"))
def marker_cell_type(spark, d):
    c = D.counts(spark, d)
    n = F.length("gene") % 3
    m = c.groupBy("gene").count().where("count >= 20").select("gene", F.when(n == 0, "a").when(n == 1, "b").otherwise("c").alias("cell_type"))
    return rounded(E.marker_cell_type(c, m, ["cell"]), 8, "level")


@query("quantile_uniform", sql("select sample, chrom, bin, round(case when min(value) over w = max(value) over w then 0.5 else percent_rank() over (partition by sample, chrom order by value) end, 8) as value from cell_vector window w as (partition by sample, chrom)", "cell_vector"))
def quantile_uniform(spark, d):
    return rounded(E.quantile_uniform(D.cell_vector(spark, d), ["sample", "chrom"]), 8)


@query("top_bottom_genes", "with p as (select p_brand as g, p_partkey as gene, p_retailprice as value from part) select g, gene, value, 'top' as side, row_number() over (partition by g order by value desc, gene) as place from p qualify place <= 10 union all select g, gene, value, 'bottom', row_number() over (partition by g order by value, gene) as place from p qualify place <= 10")
def top_bottom_genes(spark, d):
    p = D.read(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("gene"), F.col("p_retailprice").alias("value"))
    return E.top_bottom(p, "value", "gene", 10, ["g"])


@query("genes_by_factor", sql("+m as (select bin as gene, r, round(avg(value), 6) as value from cells group by all) select *, row_number() over (partition by r order by value desc, gene) as place from m", "cells"))
def genes_by_factor(spark, d):
    """The genes of each factor by falling value, with their places."""
    v = checkpoint(D.cells(spark, d).groupBy(F.col("bin").alias("gene"), "r").agg(F.round(F.avg("value"), 6).alias("value")), "loadings")
    return row_numbers(v, ["r"], [F.desc("value"), F.col("gene")], "place").orderBy("r", "place")


def _points(spark, d):
    return D.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label").cast("long").alias("batch"))


NEAR = "pt as (select vec_id as id, embedding::double[] as x, label::bigint as batch from embeddings), nn as (select q.id as query, p.id as neighbour, p.batch, sqrt(list_sum(list_transform(list_zip(p.x, q.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as distance from pt q, pt p where q.id % 100 = 0 and p.id <> q.id)"


@query("knn", f"with {NEAR} select query, neighbour, round(distance, 6) as distance, place from (select *, row_number() over (partition by query order by distance, neighbour) as place from nn) where place <= 15")
def knn(spark, d):
    p = _points(spark, d).drop("batch")
    return rounded(E.knn(p, p.where("id % 100 = 0"), 15), 6, "distance")


@query("knn_batches", f"with {NEAR} select query, neighbour, batch, round(distance, 6) as distance, place from (select *, row_number() over (partition by query, batch order by distance, neighbour) as place from nn) where place <= 3")
def knn_batches(spark, d):
    p = _points(spark, d)
    return rounded(E.knn(p, p.drop("batch").where("id % 100 = 0"), 3, "batch"), 6, "distance")


@query("knn_all", "with p as (select vec_id as id, embedding as x from embeddings), nn as (select a.id as query, b.id as neighbour, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))) as distance from p a join p b on a.id <> b.id) select query, neighbour, round(distance, 6) as distance, place from (select *, row_number() over (partition by query order by distance, neighbour) as place from nn) where place <= 15")
def knn_all(spark, d):
    """The 15 nearest neighbours of every point, through the index."""
    return rounded(knn_index(_points(spark, d).drop("batch"), 15), 6, "distance")


@query("pca")
def pca(spark, d):
    return E.pca(_points(spark, d).drop("batch"), 10)


@query("pca_genes")
def pca_genes(spark, d):
    """75 principal components of the cells over all genes, log(1 + count): (cell, r, value)."""
    c = D.words(spark, d).groupBy(F.col("doc_id").alias("id"), F.col("gene").alias("column")).agg(F.log1p(F.count("*").cast("double")).alias("value"))
    scores, _ = randomised_pca(c, 75, rounds=3)
    return scores.withColumnRenamed("id", "cell")


@query("kmeans")
def kmeans(spark, d):
    return E.kmeans(_points(spark, d).drop("batch"), 2)


@query("gbt_importance")
def gbt_importance(spark, d):
    """Ten seeded splits, the features' median places and the median Spearman correlation of the held-out tenths."""
    items = D.read(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    places, rho = E.gbt_regression(items, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", list(range(1, 11)))
    return places.withColumn("median_spearman", F.lit(median(rho))).orderBy("median_place", "feature").limit(20)
