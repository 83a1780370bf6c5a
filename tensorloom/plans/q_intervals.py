"""Queries of interval operators."""

from pyspark.sql import functions as F

from tensorloom.functions.numeric import checkpoint, running_total
from tensorloom.operators import intervals as I
from tensorloom.plans import demo_data as D
from tensorloom.plans.demo_data import sql
from tensorloom.plans.q_matrix import rounded
from tensorloom.plans.registry import query

#: letters of a sequence in one row
CHUNK = 10_000

LAP = "a.chrom = b.chrom and a.start < b.\"end\" and b.start < a.\"end\""


@query("overlap_pairs", sql(f"select a.chrom, a.id as a_id, b.id as b_id, least(a.\"end\", b.\"end\") - greatest(a.start, b.start) as lap from iva a join ivb b on {LAP}", "iva", "ivb"))
def overlap_pairs(spark, d):
    return I.overlap_pairs(D.iva(spark, d), D.ivb(spark, d)).select("chrom", "a_id", "b_id", "lap")


COUNTS = f"select (select count(distinct id) from iva) - count(distinct a.id) as only_a, (select count(distinct id) from ivb) - count(distinct b.id) as only_b, count(*) as pairs from iva a join ivb b on {LAP}"


@query("overlap_counts", sql(COUNTS, "iva", "ivb"))
def overlap_counts(spark, d):
    return I.overlap_counts(D.iva(spark, d), D.ivb(spark, d))


@query("slop_overlap", sql(COUNTS.replace("iva a join", "(select chrom, greatest(start - 10, 0) as start, \"end\" + 10 as \"end\", id from iva) a join"), "iva", "ivb"))
def slop_overlap(spark, d):
    return I.overlap_counts(I.slop(D.iva(spark, d), 10), D.ivb(spark, d))


@query("slop", sql("select chrom, bin, greatest(start - 150, 0) as start, least(\"end\" + 150, 40000) as \"end\" from bins", "bins"))
def slop(spark, d):
    return I.slop(D.bins(spark, d), 150, D.sizes(spark, d))


@query("bin_mean", sql("select sample, chrom, start // 86400 as bin, round(avg(value), 6) as value from signal group by all", "signal"))
def bin_mean(spark, d):
    return rounded(I.bin_mean(D.signal(spark, d), 86400, ["sample", "chrom"]))


LAPS = "laps as (select *, least(\"end\", (bin + 1) * 7000) - greatest(start, bin * 7000) as lap from (select *, unnest(range(start // 7000, (\"end\" - 1) // 7000 + 1)) as bin from signal))"


@query("bin_average_dense", sql(f"+{LAPS} select sample, chrom, bin, round(sum(value * lap) / sum(lap), 6) as value from laps group by all", "signal"))
def bin_average_dense(spark, d):
    return rounded(I.bin_average_dense(D.signal(spark, d), 7000, ["sample", "chrom"]))


TRACK = "track as (select p_partkey * 10 as start, p_partkey * 10 + 10 as \"end\", 'chr1' as chrom, case when p_partkey % 11 = 0 or p_partkey // 30 = 2 then null else p_size / 60.0 end as value from part), tb as (select unnest(range((select max(\"end\") from track) // 300)) as bin), tl as (select start // 300 as bin, sum(value * 10) as s, count(value) * 10 as n from track group by all)"


def _track(spark, d):
    k = F.col("p_partkey")
    v = F.when((k % 11 == 0) | (F.expr("p_partkey div 30") == 2), F.lit(None)).otherwise(F.col("p_size") / 60.0)
    t = D.read(spark, d, "part").select((k * 10).alias("start"), (k * 10 + 10).alias("end"), F.lit("chr1").alias("chrom"), v.alias("value"))
    from tensorloom.operators.bins import make_bins

    return t, make_bins(t.agg(F.max("end").alias("length")).withColumn("chrom", F.lit("chr1")), 300, "floor")


@query("dark_bins", f"with {TRACK} select 'chr1' as chrom, bin from tb left join tl using (bin) where coalesce(s, 0) / 300 < 0.4")
def dark_bins(spark, d):
    t, b = _track(spark, d)
    return I.dark_bins(t, b, 300, 0.4)


@query("dark_bins_nan", f"with {TRACK} select 'chr1' as chrom, bin from tb left join tl using (bin) where s / nullif(n, 0) < 0.4")
def dark_bins_nan(spark, d):
    t, b = _track(spark, d)
    return I.dark_bins(t, b, 300, 0.4, missing_is_dark=False)


FRAG = "select l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_linestatus as chrom, (select count(*) from sites s where s.pos <= l.l_partkey * 7 + l.l_suppkey) as fragment from lineitem l"


@query("fragment_index", f"with sites as (select s_suppkey * 131 as pos from supplier) {FRAG}")
def fragment_index(spark, d):
    items = D.read(spark, d, "lineitem")
    reads = items.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_linestatus").alias("chrom"), (F.col("l_partkey") * 7 + F.col("l_suppkey")).alias("pos"))
    chroms = items.select(F.col("l_linestatus").alias("chrom")).distinct()
    sites = D.read(spark, d, "supplier").select((F.col("s_suppkey") * 131).alias("pos")).crossJoin(F.broadcast(chroms))  # a few chromosomes
    return I.fragment_index(reads, sites).drop("pos")


MATES = "r as (select l_returnflag as sample, l_orderkey as qname, l_partkey % 5 as chrom_idx, l_partkey // 50 as fragment, l_suppkey % 2 * 16 as flag, l_partkey as pos from lineitem)"


@query("pair_mates", f"with {MATES}, o as (select sample, qname, list({{'a': chrom_idx, 'b': fragment, 'c': flag & 16, 'd': pos}} order by chrom_idx, fragment, flag & 16, pos) as l from r group by all having count(*) = 2) select sample, qname, l[1].a as chrom_idx1, l[1].b as fragment1, l[1].c as strand1, l[1].d as pos1, l[2].a as chrom_idx2, l[2].b as fragment2, l[2].c as strand2, l[2].d as pos2 from o")
def pair_mates(spark, d):
    k = F.col("l_partkey")
    r = D.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("sample"), F.col("l_orderkey").alias("qname"), (k % 5).alias("chrom_idx"), F.expr("l_partkey div 50").alias("fragment"), (F.col("l_suppkey") % 2 * 16).alias("flag"), k.alias("pos"))
    return I.pair_mates(r)


@query("window_signal", sql(f"select a.chrom, a.id, (b.id % 3)::varchar as sample, count(*) as n, round(sum(b.value * (least(a.\"end\", b.\"end\") - greatest(a.start, b.start))) / sum(least(a.\"end\", b.\"end\") - greatest(a.start, b.start)), 6) as value from iva a join ivb b on {LAP} group by all", "iva", "ivb"))
def window_signal(spark, d):
    s = D.ivb(spark, d).withColumn("sample", (F.col("id") % 3).cast("string"))
    return rounded(I.window_signal(s, D.iva(spark, d)))


@query("gene_counts", sql(f"select gene, count(*) as n from (select b.id, min(a.id % 20) as gene, max(a.id % 20) as other from iva a join ivb b on {LAP} group by all) where gene = other group by all", "iva", "ivb"))
def gene_counts(spark, d):
    return I.gene_counts(D.ivb(spark, d), D.iva(spark, d).withColumn("gene", F.col("id") % 20))


@query("coverage_bins", sql("select chrom, bin, sum(least(\"end\", (bin + 1) * 100) - greatest(start, bin * 100))::bigint as depth from (select *, unnest(range(start // 100, (\"end\" - 1) // 100 + 1)) as bin from ivb) group by all", "ivb"))
def coverage_bins(spark, d):
    return I.coverage_bins(D.ivb(spark, d), 100)


@query("depth_segments", sql("select chrom, start, \"end\", depth::bigint as depth from (select chrom, pos as start, lead(pos) over w as \"end\", sum(d) over (partition by chrom order by pos) as depth from (select chrom, pos, sum(d) as d from (select chrom, start as pos, 1 as d from ivb union all select chrom, \"end\", -1 from ivb) group by all) window w as (partition by chrom order by pos)) where \"end\" is not null and depth > 0", "ivb"))
def depth_segments(spark, d):
    return I.depth_segments(D.ivb(spark, d))


@query("sub_bin_integral", sql("select chrom, start // 3600 as bin, round(case when count(*) = 1 then 0 else sum(value) - (arg_min(value, (start, value)) + arg_max(value, (start, value))) / 2 end, 4) as value from signal group by all", "signal"))
def sub_bin_integral(spark, d):
    return rounded(I.sub_bin_integral(D.signal(spark, d), 3600, ["chrom"]), 4)


@query("aligned_profile", sql("+an as (select event_type as chrom, event_id as anchor, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 1000000 as pos from events where event_id % 100 = 0), m as (select anchor, floor((s.start - pos) / 600)::bigint as \"offset\", avg(value) as value from an join signal s on s.chrom = an.chrom and s.start >= greatest(pos - 6000, 0) and s.start < pos + 6000 group by all), g as (select distinct anchor, unnest(range(-10, 10)) as \"offset\" from m) select g.anchor, g.\"offset\", round(coalesce(value, avg(value) over (partition by g.anchor)), 6) as value from g left join m on m.anchor = g.anchor and m.\"offset\" = g.\"offset\"", "signal"))
def aligned_profile(spark, d):
    s = D.signal(spark, d)
    pos = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) div 1000000")
    anchors = D.read(spark, d, "events").where("event_id % 100 = 0").select(F.col("event_type").alias("chrom"), F.col("event_id").alias("anchor"), pos.alias("pos"))
    return rounded(I.aligned_profile(s, anchors, 6000, 600))


@query("cpg_density", "with c as (select source as chrom, doc_id as k, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) as seq from documents), f as (select chrom, k, seq, coalesce(sum(length(seq)) over (partition by chrom order by k rows between unbounded preceding and 1 preceding), 0)::bigint as start, coalesce(left(lead(seq) over (partition by chrom order by k), 1), '') as nx from c where seq <> ''), p as (select chrom, start + i as pos, substr(seq || nx, i::int + 1, 2) = 'CH' as hit from (select *, unnest(range(length(seq))) as i from f)) select chrom, pos // 500 as bin, round(avg(hit::int), 8) as value from p group by all")
def cpg_density(spark, d):
    seq = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "HG", "GH")
    c = D.read(spark, d, "documents").select(F.col("source").alias("chrom"), "doc_id", seq.alias("seq")).where("seq <> ''")
    c = checkpoint(c, "sequences")
    ends = running_total(c.select("chrom", "doc_id", F.length("seq").alias("n")), ["chrom"], [F.col("doc_id")], F.col("n"), "end")
    whole = c.join(ends, ["chrom", "doc_id"]).withColumn("start", F.col("end") - F.col("n"))
    # sequences go in chunks, so that no row is long
    at = F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(CHUNK)))
    chunks = whole.withColumn("_at", at).select("chrom", (F.col("start") + F.col("_at")).alias("start"), F.substr("seq", F.col("_at") + 1, F.lit(CHUNK)).alias("seq"))
    return rounded(I.cpg_density(chunks, 500), 8)
