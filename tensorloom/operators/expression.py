"""Single-cell and tissue expression: quality filters, normalisation, blocks, fold changes, markers, embeddings and regressions."""

from __future__ import annotations

import functools
import operator

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.functions.numeric import checkpoint, quantiles, row_numbers, running_total
from tensorloom.operators.neighbours import knn_tiles


def cell_qc(counts: DataFrame, cell: list[str], mito: str | list[str], ribo: str | list[str], genes=(500, 6000), total=(500, 40000), mito_most=0.10, ribo_most=0.40, denominator: str = "total") -> DataFrame:
    """(cell, genes, total, mito, ribo): cells within the bounds. The shares of genes by name prefix, or by any of several, are over the cell's total, or with
    denominator="n_cells" over the number of cells."""

    def share(prefixes: str | list[str]) -> Column:
        names = [prefixes] if isinstance(prefixes, str) else prefixes
        found = functools.reduce(operator.or_, (F.startswith("gene", F.lit(p)) for p in names))
        return F.coalesce(F.sum(F.when(found, F.col("value"))), F.lit(0.0))

    if denominator == "n_cells":
        counts = checkpoint(counts, "counts")
    per = counts.groupBy(*cell).agg(
        F.count_if(F.col("value") > 0).alias("genes"), F.sum("value").alias("total"),
        share(mito).alias("mito"), share(ribo).alias("ribo"),
    )
    if denominator == "n_cells":
        per = per.crossJoin(F.broadcast(counts.select(*cell).distinct().agg(F.count("*").cast("double").alias("_d"))))
    else:
        per = per.withColumn("_d", F.col("total"))
    per = per.withColumn("mito", F.try_divide("mito", F.col("_d"))).withColumn("ribo", F.try_divide("ribo", F.col("_d"))).drop("_d")
    return per.where(F.col("genes").between(*genes) & F.col("total").between(*total) & (F.col("mito") <= mito_most) & (F.col("ribo") <= ribo_most))


def zero_genes(counts: DataFrame) -> DataFrame:
    """(gene): genes without a value over zero in any dataset."""
    return counts.groupBy("gene").agg(F.max("value").alias("_m")).where("_m <= 0").select("gene")


def drop_zero_genes(counts: DataFrame) -> DataFrame:
    return counts.join(zero_genes(counts), "gene", "left_anti")


def normalize_total(counts: DataFrame, cell: list[str]) -> DataFrame:
    """log(1 + value scaled to the median of the cells' totals). The median is selected by counts of distinct totals."""
    counts = checkpoint(counts, "counts")
    totals = checkpoint(counts.groupBy(*cell).agg(F.sum("value").alias("_t")), "totals")
    target = quantiles(totals.where("_t > 0"), [], "_t", [0.5]).select(F.col("q")[0].alias("_m"))
    j = counts.join(totals, cell).crossJoin(F.broadcast(target))
    return j.withColumn("value", F.log1p(F.col("value") * F.col("_m") / F.col("_t"))).drop("_t", "_m")


def robust_scale(counts: DataFrame, group: list[str], cells: DataFrame) -> DataFrame:
    """log(1 + max(x, 0)) less the lower quartile over the interquartile range of a whole block, zeros included: cells(group, total cells × genes).

    The quartiles are those of the completed grid; they are interpolated between the two stored places around them, zeros below all others. Places come from a
    running total over the counts of distinct values, so no block is ordered in one task."""
    logs = checkpoint(counts.withColumn("value", F.log1p(F.greatest("value", F.lit(0.0)))), "logs")
    distinct = logs.where("value > 0").groupBy(*group, "value").agg(F.count("*").alias("_c"))
    placed = running_total(distinct, group, [F.col("value")], F.col("_c"), "_upto")
    stored = distinct.groupBy(*group).agg(F.sum("_c").alias("_nz"))
    base = cells.join(stored, group, "left").withColumn("_zero", F.col("total") - F.coalesce("_nz", F.lit(0)))
    for name, q in (("_p1", 0.25), ("_p3", 0.75)):
        base = base.withColumn(name, (F.col("total") - 1) * q)
    base = checkpoint(base, "blocks")
    wanted = {"a1": F.floor("_p1"), "b1": F.ceil("_p1"), "a3": F.floor("_p3"), "b3": F.ceil("_p3")}
    first, past = F.col("_zero") + F.col("_upto") - F.col("_c"), F.col("_zero") + F.col("_upto")
    got = placed.join(base, group).groupBy(*group).agg(*(F.max(F.when((e >= first) & (e < past), F.col("value"))).alias(t) for t, e in wanted.items()))
    q = base.join(got, group, "left").fillna(0.0, list(wanted)).select(
        *group, (F.col("a1") + (F.col("b1") - F.col("a1")) * (F.col("_p1") - F.floor("_p1"))).alias("_q1"), (F.col("a3") + (F.col("b3") - F.col("a3")) * (F.col("_p3") - F.floor("_p3"))).alias("_q3")
    )
    return logs.join(q, group).withColumn("value", (F.col("value") - F.col("_q1")) / (F.col("_q3") - F.col("_q1") + 1e-10)).drop("_q1", "_q3")


def blocks(rows: DataFrame, group: list[str], order: str, size: int) -> DataFrame:
    """Adds `block` and `place`: consecutive rows in order, the last incomplete block dropped."""
    n = F.col("_n") - 1
    b = row_numbers(rows, group, [F.col(order)], "_n").withColumn("block", F.floor(n / size).cast("long")).withColumn("place", (n % size).cast("long")).drop("_n")
    full = F.count("*").over(Window.partitionBy(*group, "block"))
    return b.withColumn("_f", full).where(F.col("_f") == size).drop("_f")


def align_min_rows(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """Every group cut to the rows of the smallest, in order."""
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n")).agg(F.min("n").alias("_least"))
    return row_numbers(rows, group, [F.col(order)], "_n").crossJoin(F.broadcast(sizes)).where("_n <= _least").drop("_n", "_least")


def log_fold_change(wide: DataFrame, base_age: int) -> DataFrame:
    """(tissue, age, gene, value): log2 of the gene's share × 10⁴ at an age over its share at the base age, both from sums within the tissue and age."""
    share = wide.withColumn("_p", F.col("value") / F.sum("value").over(Window.partitionBy("tissue", "age")) * 1e4)
    base = share.where(F.col("age") == base_age).select("tissue", "gene", F.col("_p").alias("_b"))
    j = share.where(F.col("age") != base_age).join(base, ["tissue", "gene"])
    return j.select("tissue", "age", "gene", F.log2(F.col("_p") / (F.col("_b") + 1e-6) + 1e-6).alias("value"))


def log_fold_plus_one(wide: DataFrame, base_age: int) -> DataFrame:
    """log2((x + 1) / (mean of the base age + 1))."""
    base = wide.where(F.col("age") == base_age).groupBy("tissue", "gene").agg(F.avg("value").alias("_b"))
    return wide.join(base, ["tissue", "gene"]).select("tissue", "age", "gene", F.log2((F.col("value") + 1) / (F.col("_b") + 1)).alias("value"))


def zscore(df: DataFrame, group: list[str]) -> DataFrame:
    w = Window.partitionBy(*group)
    z = F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_pop("value").over(w))
    return df.withColumn("value", F.coalesce(z, F.lit(0.0)))


def everywhere_genes(wide: DataFrame) -> DataFrame:
    """(gene): genes with a value over zero in every tissue."""
    tissues = wide.agg(F.count_distinct("tissue").alias("_n"))
    seen = wide.where("value > 0").groupBy("gene").agg(F.count_distinct("tissue").alias("_k"))
    return seen.crossJoin(F.broadcast(tissues)).where("_k = _n").select("gene")


def replicate_means(rep: DataFrame, keys: list[str]) -> DataFrame:
    return rep.groupBy(*keys).agg(F.avg("value").alias("value"))


def split_names(df: DataFrame, name: str, separator: str, values: list[str]) -> DataFrame:
    """Rows with several names laid out and averaged by name."""
    parts = df.withColumn("_n", F.explode(F.split(name, separator))).withColumn("_n", F.trim("_n")).where("_n <> ''")
    return parts.groupBy(F.col("_n").alias(name)).agg(*(F.avg(v).alias(v) for v in values))


def cluster_of(df: DataFrame, gene: str, cluster: str) -> DataFrame:
    """(gene, cluster): the one cluster of a gene, -1 if it has several."""
    return df.groupBy(gene).agg(F.when(F.count_distinct(cluster) > 1, -1).otherwise(F.min(cluster)).alias(cluster))


def marker_cell_type(counts: DataFrame, markers: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, cell_type, level): the type whose markers are highest on average over the cell's stored values; ties go to the first name."""
    mean = counts.join(markers, "gene").groupBy(*cell, "cell_type").agg(F.avg("value").alias("level"))
    w = Window.partitionBy(*cell).orderBy(F.desc("level"), "cell_type")
    return mean.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def quantile_uniform(v: DataFrame, group: list[str]) -> DataFrame:
    """Values as their rank share in [0, 1] within each group; 0.5 in constant groups."""
    w = Window.partitionBy(*group)
    flat = F.min("value").over(w) == F.max("value").over(w)
    return v.withColumn("value", F.when(flat, 0.5).otherwise(F.percent_rank().over(w.orderBy("value"))))


def top_bottom(df: DataFrame, value: str, tie: str, n: int, group: list[str]) -> DataFrame:
    """The n largest and smallest rows of each group with `side` and `place`. Either side is cut to n rows a group in each task before it is shuffled."""

    def side(name: str, first: Column) -> DataFrame:
        w = Window.partitionBy(*group).orderBy(first, tie)
        return df.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n).select(*df.columns, F.lit(name).alias("side"), "place")

    return side("top", F.desc(value)).unionByName(side("bottom", F.col(value)))


def knn(points: DataFrame, queries: DataFrame, k: int, batch: str | None = None) -> DataFrame:
    """(query, neighbour, place): the k nearest rows of points(id, x) to each row of queries(id, x) by distance, per batch if named; ties by id.

    A stated query set meets all rows, in tiles of a strip of queries and a stream of points."""
    return knn_tiles(points, queries, k, batch)


def pca(points: DataFrame, k: int) -> DataFrame:
    """(id, r, value): the first k principal components of points(id, x array), centred."""
    n = F.size("x")
    size = points.select(n.alias("n")).first()
    if size is None:
        return points.select("id", F.lit(0).alias("r"), F.lit(0.0).alias("value")).limit(0)
    means = points.agg(*(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(size["n"]))).select(F.array(*(f"m{i}" for i in range(size["n"]))).alias("_m"))
    centred = points.crossJoin(F.broadcast(means)).select("id", array_to_vector(F.zip_with("x", "_m", lambda a, b: a - b)).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(centred)
    return model.transform(centred).select("id", F.posexplode(vector_to_array("p")).alias("r", "value"))


def kmeans(points: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(id, cluster)."""
    v = points.select("id", array_to_vector("x").alias("features"))
    return KMeans(k=k, seed=seed).fit(v).transform(v).select("id", F.col("prediction").alias("cluster"))


def gbt_regression(df: DataFrame, features: list[str], label: str, seeds: list[int], trees: int = 5) -> tuple[DataFrame, list[float]]:
    """(feature, importance rank of each seed and their median), and the Spearman correlation on each seed's held-out tenth. The splits go by hash, not by
    partition.

    Rows that agree in features and label are counted once, and a seed is fitted on the mean label of each combination of features, weighted by its rows: squared
    losses within a combination are the same on both sides of any split, so gains, leaves and importances are those of the single rows. The correlations of all
    seeds are one job."""
    from tensorloom.operators.stats import spearman

    v = df.groupBy(*features, F.col(label).alias("_y")).agg(F.count("*").alias("_n")).withColumn("_h", F.xxhash64(*features, "_y"))
    v = checkpoint(v, "counted")
    if v.where(" or ".join(f"`{c}` is null" for c in [*features, "_y"])).limit(1).count():
        raise ValueError("features and label must be there in all rows")
    kept = lambda seed: F.pmod(F.xxhash64("_h", F.lit(seed)), F.lit(10)) > 0
    sums = [x for k, seed in enumerate(seeds) for x in (F.sum(F.when(kept(seed), F.col("_n"))).alias(f"_n{k}"), F.sum(F.when(kept(seed), F.col("_n") * F.col("_y"))).alias(f"_s{k}"))]
    combined = checkpoint(VectorAssembler(inputCols=features, outputCol="features").transform(v.groupBy(*features).agg(*sums)), "combinations")
    rows, told = [], combined
    for k, seed in enumerate(seeds):
        mean = combined.where(f"_n{k} is not null").select("features", (F.col(f"_s{k}") / F.col(f"_n{k}")).alias("label"), F.col(f"_n{k}").cast("double").alias("_w"))
        model = GBTRegressor(maxIter=trees, maxDepth=3, seed=seed, weightCol="_w").fit(mean)
        rows += [(f, seed, float(x)) for f, x in zip(features, model.featureImportances.toArray(), strict=True)]
        told = model.setPredictionCol(f"_p{k}").transform(told)
    # the lines of a combination take its predictions of the seeds that hold them out
    told = told.select(*features, F.array(*(f"_p{k}" for k in range(len(seeds)))).alias("_p"))
    out = F.explode(F.array_compact(F.array(*(F.when(~kept(seed), k) for k, seed in enumerate(seeds)))))
    lines = v.withColumn("_k", out).join(told, features).select(F.col("_k").alias("of"), F.col("_y").alias("label"), F.col("_p")[F.col("_k")].alias("prediction"), F.col("_n").alias("n"))
    found = {r["of"]: r["value"] for r in spearman(lines, "label", "prediction", ["of"], "n").collect()}
    rho = [float(found[k]) if found.get(k) is not None else 0.0 for k in range(len(seeds))]
    got = df.sparkSession.createDataFrame(rows, "feature string, seed int, importance double")
    ranked = got.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("importance"), "feature")))
    return ranked.groupBy("feature").agg(F.median("place").alias("median_place"), F.avg("importance").alias("importance")), rho
