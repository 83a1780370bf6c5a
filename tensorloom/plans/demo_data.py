"""The given tables read as genomic data: contacts, signals, vectors, factors, counts and intervals, as DataFrames and as SQL.

Every function takes (spark, sf_dir). BASE holds the same tables as SQL common table expressions; sql(body, names) puts the needed ones in front.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_BINS = 40
RESOLUTION = 1000

BASE = {
    "lp": "select l_orderkey as k, l_linenumber as n, l_returnflag as sample, l_linestatus as chrom, l_quantity as q, l_partkey * 40 // (select max(l_partkey) + 1 from lineitem) as b from lineitem",
    "contacts": "select a.sample, a.chrom, least(a.b, c.b) as i, greatest(a.b, c.b) as j, count(*)::double as value from lp a join lp c on a.k = c.k and a.n < c.n group by all",
    "sparse": "select a.sample, a.chrom, least(a.b, c.b) as i, greatest(a.b, c.b) as j, count(*)::double as value from lp a join lp c on a.k = c.k and a.n + 1 = c.n group by all",
    "sizes": "select distinct l_linestatus as chrom, 40000::bigint as length from lineitem",
    "bins": "select chrom, bin, bin * 1000 as start, (bin + 1) * 1000 as \"end\" from (select chrom, unnest(range(40)) as bin from sizes)",
    "signal": "select (user_id % 6)::varchar as sample, event_type as chrom, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 1000000 as start, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 1000000 + 3600 as \"end\", value from events",
    "vector": "select sample, chrom, start // 86400 as bin, avg(value) as value from signal group by all",
    "curve": "select chrom, row_number() over (partition by chrom order by b) - 1 as bin, value from (select chrom, start // 7200 as b, avg(value) as value from signal group by all)",
    "cells": "select (l_suppkey % 6)::varchar as sample, l_linestatus as chrom, l_partkey * 40 // (select max(l_partkey) + 1 from lineitem) as bin, (l_linenumber % 3)::bigint as r, avg(l_quantity) as value from lineitem group by all",
    "cell_vector": "select sample, chrom, bin, value from cells where r = 0",
    "bulk": "select chrom, bin, v - avg(v) over (partition by chrom) as value from (select l_linestatus as chrom, l_partkey * 40 // (select max(l_partkey) + 1 from lineitem) as bin, avg(l_extendedprice) as v from lineitem group by all)",
    "mark": "select l_linestatus as chrom, l_partkey * 40 // (select max(l_partkey) + 1 from lineitem) as bin, avg(l_discount) as value from lineitem group by all",
    "types": "select distinct (l_suppkey % 6)::varchar as sample, case when l_suppkey % 6 % 2 = 0 then 'alpha' else 'beta' end as cell_type from lineitem",
    "words": "select doc_id, lang, source, unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '')) as gene from documents",
    "counts": "select lang as dataset, source as grp, doc_id as cell, gene, count(*)::double as value from words group by all",
    "wide": "select c_mktsegment as tissue, year(o_orderdate)::bigint as age, c_nationkey::bigint as gene, sum(o_totalprice) / 1000 as value from orders join customer on o_custkey = c_custkey group by all",
    "replicates": "select l_partkey % 200 as gene, l_returnflag as flag, l_linestatus as status, (l_linenumber % 3)::bigint as rep, avg(l_quantity) as value from lineitem group by all",
    "points": "select vec_id, label::bigint as label, unnest(range(64)) as dim, unnest(embedding)::double as value from embeddings",
    "iva": "select o_orderstatus || '-' || (o_orderkey % 50)::varchar as chrom, (epoch_us(o_orderdate) // 3600000000) + o_orderkey % 24 as start, (epoch_us(o_orderdate) // 3600000000) + o_orderkey % 24 + 30 as \"end\", o_orderkey as id from orders",
    "ivb": "select l_linestatus || '-' || (l_orderkey % 50)::varchar as chrom, (epoch_us(l_shipdate) // 3600000000) + l_orderkey % 24 as start, (epoch_us(l_shipdate) // 3600000000) + l_orderkey % 24 + 7 as \"end\", l_orderkey * 100 + l_linenumber as id, l_quantity as value from lineitem",
}
NEEDS = {
    "contacts": ["lp"], "sparse": ["lp"], "bins": ["sizes"], "vector": ["signal"], "curve": ["signal"], "cell_vector": ["cells"], "counts": ["words"],
}


def sql(body: str, *names: str) -> str:
    """`body` with the named tables as common table expressions in front; a body that begins with a name and "as (" continues the list."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    head = ", ".join(f"{n} as ({BASE[n]})" for n in order)
    return f"with {head}{', ' if body.lstrip().startswith('+') else ' '}{body.lstrip().removeprefix('+')}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part_bin(items: DataFrame) -> DataFrame:
    # one number reaches the driver, so no scan meets another scan of the same table
    last = items.agg(F.max("l_partkey")).first()[0]
    return items.withColumn("bin", F.expr(f"l_partkey * 40 div {(last or 0) + 1}"))


def _pairs(spark, sf_dir, steps: bool) -> DataFrame:
    """The part bins of two lines of one order; with `steps` of two lines that follow one another, a thinner relation over the same whole table."""
    items = _part_bin(read(spark, sf_dir, "lineitem"))
    a = items.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("sample"), F.col("l_linestatus").alias("chrom"), F.col("bin").alias("x"))
    b = items.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("m"), F.col("bin").alias("y"))
    met = a.join(b.withColumn("n", F.col("m") - 1), ["k", "n"]) if steps else a.join(b, "k").where("n < m")
    return met.select("sample", "chrom", F.least("x", "y").alias("bin_i"), F.greatest("x", "y").alias("bin_j"))


def pairs(spark, sf_dir) -> DataFrame:
    """pairs(sample, chrom, pos1, pos2): the part bins of two lines of one order, as positions."""
    return _pairs(spark, sf_dir, False).select("sample", "chrom", (F.col("bin_i") * RESOLUTION).alias("pos1"), (F.col("bin_j") * RESOLUTION).alias("pos2"))


def contacts(spark, sf_dir) -> DataFrame:
    from tensorloom.operators.matrix import bin_pairs

    return bin_pairs(pairs(spark, sf_dir), RESOLUTION)


def sparse(spark, sf_dir) -> DataFrame:
    p = _pairs(spark, sf_dir, True)
    return p.groupBy("sample", "chrom", F.col("bin_i").alias("i"), F.col("bin_j").alias("j")).agg(F.count("*").cast("double").alias("value"))


def sizes(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("chrom")).distinct().withColumn("length", F.lit(N_BINS * RESOLUTION).cast("long"))


def bins(spark, sf_dir) -> DataFrame:
    from tensorloom.operators.bins import make_bins

    return make_bins(sizes(spark, sf_dir), RESOLUTION)


def signal(spark, sf_dir) -> DataFrame:
    start = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) div 1000000")
    e = read(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 6).cast("string").alias("sample"), F.col("event_type").alias("chrom"), start.alias("start"), (start + 3600).alias("end"), "value")


def vector(spark, sf_dir) -> DataFrame:
    return signal(spark, sf_dir).groupBy("sample", "chrom", F.expr("start div 86400").alias("bin")).agg(F.avg("value").alias("value"))


def curve(spark, sf_dir) -> DataFrame:
    from tensorloom.operators.bins import reindex

    c = signal(spark, sf_dir).groupBy("chrom", F.expr("start div 7200").alias("bin")).agg(F.avg("value").alias("value"))
    return reindex(c, ["chrom"])


def cells(spark, sf_dir) -> DataFrame:
    items = _part_bin(read(spark, sf_dir, "lineitem"))
    return items.groupBy((F.col("l_suppkey") % 6).cast("string").alias("sample"), F.col("l_linestatus").alias("chrom"), "bin", (F.col("l_linenumber") % 3).cast("long").alias("r")).agg(F.avg("l_quantity").alias("value"))


def cell_vector(spark, sf_dir) -> DataFrame:
    return cells(spark, sf_dir).where("r = 0").drop("r")


def bulk(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    v = _part_bin(read(spark, sf_dir, "lineitem")).groupBy(F.col("l_linestatus").alias("chrom"), "bin").agg(F.avg("l_extendedprice").alias("v"))
    return v.select("chrom", "bin", (F.col("v") - F.avg("v").over(Window.partitionBy("chrom"))).alias("value"))


def mark(spark, sf_dir) -> DataFrame:
    return _part_bin(read(spark, sf_dir, "lineitem")).groupBy(F.col("l_linestatus").alias("chrom"), "bin").agg(F.avg("l_discount").alias("value"))


def types(spark, sf_dir) -> DataFrame:
    s = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 6).alias("s")).distinct()
    return s.select(F.col("s").cast("string").alias("sample"), F.when(F.col("s") % 2 == 0, "alpha").otherwise("beta").alias("cell_type"))


def words(spark, sf_dir) -> DataFrame:
    w = F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != ""))
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", w.alias("gene"))


def counts(spark, sf_dir) -> DataFrame:
    return words(spark, sf_dir).groupBy(F.col("lang").alias("dataset"), F.col("source").alias("grp"), F.col("doc_id").alias("cell"), "gene").agg(F.count("*").cast("double").alias("value"))


def wide(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("tissue"), F.year("o_orderdate").cast("long").alias("age"), F.col("c_nationkey").cast("long").alias("gene")).agg((F.sum("o_totalprice") / 1000).alias("value"))


def replicates(spark, sf_dir) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    return items.groupBy((F.col("l_partkey") % 200).alias("gene"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), (F.col("l_linenumber") % 3).cast("long").alias("rep")).agg(F.avg("l_quantity").alias("value"))


def points(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("dim", "value"))
    return e.select("vec_id", "label", F.col("dim").cast("long").alias("dim"), F.col("value").cast("double").alias("value"))


def _hours(column: str):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz)) div 3600000000")


def iva(spark, sf_dir) -> DataFrame:
    start = _hours("o_orderdate") + F.col("o_orderkey") % 24
    return read(spark, sf_dir, "orders").select(F.concat("o_orderstatus", F.lit("-"), (F.col("o_orderkey") % 50).cast("string")).alias("chrom"), start.alias("start"), (start + 30).alias("end"), F.col("o_orderkey").alias("id"))


def ivb(spark, sf_dir) -> DataFrame:
    start = _hours("l_shipdate") + F.col("l_orderkey") % 24
    return read(spark, sf_dir, "lineitem").select(
        F.concat("l_linestatus", F.lit("-"), (F.col("l_orderkey") % 50).cast("string")).alias("chrom"), start.alias("start"), (start + 7).alias("end"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("value"),
    )
