"""Queries of readers and writers: files are written below the shared folder from a given table, read back and held against the table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.numeric import scratch_path
from tensorloom.plans import demo_data as D
from tensorloom.plans.demo_data import sql
from tensorloom.plans.q_matrix import rounded
from tensorloom.plans.registry import query
from tensorloom.sources import readers as R
from tensorloom.sources import writers as W


def _lines(df: DataFrame, columns: list, separator: str = "\t") -> str:
    """The path of text files with one line a row."""
    path = scratch_path(df.sparkSession, "lines")
    W.write_lines(df.select(F.concat_ws(separator, *columns).alias("value")), path)
    return path


def _one_file(df: DataFrame, order: list, value) -> str:
    """The path of one ordered text file, for lists whose row order is data: bins, genes and cells of a matrix."""
    path = scratch_path(df.sparkSession, "list")
    df.orderBy(*order).select(value.alias("value")).coalesce(1).write.text(path)
    return path


@query("read_contacts", sql("select sample, chrom, i, j, value from contacts", "contacts"))
def read_contacts(spark, d):
    path = scratch_path(spark, "contacts")
    unit = F.concat_ws("_", "sample", "chrom").alias("unit")
    D.contacts(spark, d).select(unit, F.concat_ws(" ", "i", "j", "value").alias("value")).write.partitionBy("unit").text(path)
    return R.read_contacts(spark, path)


STRICT = "s as (select l_partkey as i, l_suppkey as j, l_quantity::bigint - 5 as v from lineitem)"


@query("read_contacts_strict", f"with {STRICT} select i, j, v as value, null as line from s where v >= 0 union all select null, null, null, i || ' ' || j || ' ' || v from s where v < 0")
def read_contacts_strict(spark, d):
    items = D.read(spark, d, "lineitem")
    path = _lines(items, ["l_partkey", "l_suppkey", F.col("l_quantity").cast("long") - 5], " ")
    good, bad = R.read_contacts_strict(spark, path)
    return good.select("i", "j", "value", F.lit(None).cast("string").alias("line")).unionByName(bad.select(F.col("value").alias("line")), allowMissingColumns=True)


@query("read_pairs7", "select 'chr' || l_linestatus as chrom1, l_partkey as pos1, 'chr' || l_returnflag as chrom2, l_suppkey as pos2 from lineitem")
def read_pairs7(spark, d):
    zero = F.lit("0")
    return R.read_pairs7(spark, _lines(D.read(spark, d, "lineitem"), [zero, F.concat(F.lit("chr"), "l_linestatus"), "l_partkey", zero, zero, "l_returnflag", "l_suppkey", F.lit("1")]))


@query("read_signal_bed4", sql("select chrom, start, \"end\", value from signal where chrom <> 'click'", "signal"))
def read_signal_bed4(spark, d):
    s = D.signal(spark, d)
    # a field that is no number, and a line cut off, stand among the others
    spoilt = s.withColumn("line", F.explode(F.array(F.concat_ws("\t", "chrom", "start", "end", "value"), F.concat_ws("\t", "chrom", "start"), F.concat_ws("\t", "chrom", F.lit("x"), "end", "value"))))
    chroms = [r.chrom for r in s.select("chrom").distinct().where("chrom <> 'click'").collect()]  # names of chromosomes
    return R.read_signal_bed4(spark, _lines(spoilt, ["line"]), chroms)


@query("read_bed_score", sql("select chrom, start, \"end\", case when id % 2 = 0 then value else 1 end as value from ivb", "ivb"))
def read_bed_score(spark, d):
    line = F.when(F.col("id") % 2 == 0, F.concat_ws("\t", "chrom", "start", "end", F.lit("n"), "value")).otherwise(F.concat_ws("\t", "chrom", "start", "end"))
    both = D.ivb(spark, d).select(F.explode(F.array(line, F.lit("track name=x"), F.lit("# note"))).alias("line"))
    return R.read_bed_score(spark, _lines(both, ["line"]))


@query("read_bed10", sql("select chrom, start, \"end\", value from ivb where id % 3 > 0", "ivb"))
def read_bed10(spark, d):
    dot = F.lit(".")
    short = F.when(F.col("id") % 3 == 0, F.concat_ws("\t", "chrom", "start")).otherwise(F.concat_ws("\t", "chrom", "start", "end", dot, "value", dot, dot, dot, dot, dot))
    return R.read_bed10(spark, _lines(D.ivb(spark, d), [short]))


@query("read_methyl_pairs", sql("select s.sample, chrom, start, \"end\", case s.sample when 'x' then id % 7 else id % 5 end::double as num, case s.sample when 'x' then 7 else 5 end::double as den from iva cross join (select unnest(['x', 'y']) as sample) s", "iva"))
def read_methyl_pairs(spark, d):
    path = _lines(D.iva(spark, d), ["chrom", "start", "end", F.lit("a"), F.lit("b"), F.lit("c"), F.col("id") % 7, F.lit(7), F.col("id") % 5, F.lit(5)])
    return R.read_methyl_pairs(spark, path, ["x", "y"])


@query("read_chrom_sizes", "select 'chr' || p_partkey as chrom, p_size::bigint as length from part")
def read_chrom_sizes(spark, d):
    return R.read_chrom_sizes(spark, _lines(D.read(spark, d, "part"), [F.concat(F.lit("chr"), "p_partkey"), "p_size"]))


@query("read_samples", "select s_name as sample from supplier")
def read_samples(spark, d):
    both = D.read(spark, d, "supplier").select(F.explode(F.array("s_name", F.lit(""))).alias("line"))
    return R.read_samples(spark, _lines(both, ["line"]))


@query("read_cell_labels", "select 'c' || c_custkey as sample, case c_mktsegment when 'BUILDING' then 'alpha' when 'MACHINERY' then 'beta' end as cell_type from customer")
def read_cell_labels(spark, d):
    path = _lines(D.read(spark, d, "customer"), ["c_custkey", F.concat(F.lit("c"), "c_custkey"), "c_mktsegment"], " ")
    return R.read_cell_labels(spark, path, {"BUILDING": "alpha", "MACHINERY": "beta"})


@query("read_vector", sql("select row_number() over (order by chrom, bin) - 1 as bin, round(value, 6) as value from bulk", "bulk"))
def read_vector(spark, d):
    return rounded(R.read_vector(spark, _one_file(D.bulk(spark, d), ["chrom", "bin"], F.col("value").cast("string"))))


@query("read_counts_wide", sql("+g as (select distinct gene from wide), n as (select distinct tissue, age from wide) select g.gene::varchar as gene, n.tissue || '_' || n.age as name, round(w.value, 6) as value from g cross join n left join wide w on w.gene = g.gene and w.tissue = n.tissue and w.age = n.age", "wide"))
def read_counts_wide(spark, d):
    path = scratch_path(spark, "wide")
    named = D.wide(spark, d).withColumn("name", F.concat_ws("_", "tissue", "age"))
    named.groupBy("gene").pivot("name").agg(F.first("value")).write.option("header", True).csv(path)
    return rounded(R.read_counts_wide(spark, path, "gene"))


@query("read_10x", "with c as (select l_partkey % 40 as cell, l_suppkey % 15 as gene, sum(l_quantity) as value from lineitem group by all) select 'cell' || cell as cell, 'gene' || gene as gene, value from c")
def read_10x(spark, d):
    c = D.read(spark, d, "lineitem").groupBy((F.col("l_partkey") % 40).alias("cell"), (F.col("l_suppkey") % 15).alias("gene")).agg(F.sum("l_quantity").alias("value"))
    genes, cells = spark.range(15), spark.range(40)  # the names of the matrix's rows and columns
    cell = c.select(F.lit(2).alias("k"), F.concat_ws(" ", F.col("gene") + 1, F.col("cell") + 1, "value").alias("line"))
    head = genes.where("id < 2").select(F.col("id").cast("int").alias("k"), F.when(F.col("id") == 0, "% comment").otherwise("15 40 600").alias("line"))
    matrix = _one_file(head.unionByName(cell), ["k", "line"], F.col("line"))
    features = _one_file(genes, ["id"], F.concat(F.lit("id"), "id", F.lit("\tgene"), "id"))
    return R.read_10x(spark, matrix, _one_file(cells, ["id"], F.concat(F.lit("cell"), "id")), features)


@query("write_matrix", sql("select sample, chrom, i, j, value from contacts", "contacts"))
def write_matrix(spark, d):
    path = scratch_path(spark, "matrix")
    W.write_matrix(D.contacts(spark, d), path)
    return W.read_matrix(spark, path).select("sample", "chrom", "i", "j", "value")


@query("write_triplets", sql("select i, j, value from contacts", "contacts"))
def write_triplets(spark, d):
    path = scratch_path(spark, "triplets")
    W.write_triplets(D.contacts(spark, d), path)
    return spark.read.schema("i long, j long, value double").option("sep", "\t").csv(path)


@query("write_curve", sql("select chrom, bin * 7200 as start, (bin + 1) * 7200 as \"end\", round(value, 6) as value from curve", "curve"))
def write_curve(spark, d):
    path = scratch_path(spark, "curve")
    W.write_curve(D.curve(spark, d), path, 7200)
    return rounded(spark.read.schema("chrom string, start long, end long, value double").option("sep", "\t").csv(path))


@query("write_calls", sql("select v.sample, t.cell_type, v.chrom, v.bin, round(v.value, 6) as value from cell_vector v join types t on t.sample = v.sample", "cell_vector", "types"))
def write_calls(spark, d):
    path = scratch_path(spark, "calls")
    W.write_calls(D.cell_vector(spark, d), D.types(spark, d), path)
    return rounded(spark.read.parquet(f"{path}/calls").join(spark.read.parquet(f"{path}/summary"), "sample").select("sample", "cell_type", "chrom", "bin", "value"))


@query("write_factors", sql("select sample, chrom, bin, r, round(value, 6) as value from cells", "cells"))
def write_factors(spark, d):
    path = scratch_path(spark, "factors")
    W.write_factors(D.cells(spark, d), path)
    return rounded(spark.read.parquet(path).select("sample", "chrom", "bin", F.col("r").cast("long").alias("r"), "value"))


@query("skip_existing", "select distinct l_partkey % 97 as unit, l_linestatus as chrom from lineitem where l_partkey % 97 >= 50")
def skip_existing(spark, d):
    units = D.read(spark, d, "lineitem").select((F.col("l_partkey") % 97).alias("unit"), F.col("l_linestatus").alias("chrom")).distinct()
    path = scratch_path(spark, "done")
    W.skip_existing(units, path, ["unit", "chrom"]).where("unit < 50").write.parquet(path)  # the first run is cut short
    return W.skip_existing(units, path, ["unit", "chrom"])
