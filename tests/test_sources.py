"""Readers on files written here, sinks read back."""

import gzip

import pytest
from pyspark.sql import functions as F

from tensorloom.operators import bins as B
from tensorloom.operators import boundaries, filters, intervals, matrix
from tensorloom.sources import readers as R
from tensorloom.sources import writers as W


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_contacts(spark, tmp_path):
    (tmp_path / "cell1_chr1.txt").write_text("0 3 2.0\n1 2\n 4\t5 nan\r\n")
    assert set(rows(R.read_contacts(spark, str(tmp_path)).fillna(-9.0))) == {("cell1", "chr1", 0, 3, 2.0), ("cell1", "chr1", 4, 5, -9.0)}


def test_contacts_strict(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("0 1 5\n-1 2 5\n1 x 3\n2 2 2\n")
    good, bad = R.read_contacts_strict(spark, str(p))
    assert rows(good) == [(0, 1, 5), (2, 2, 2)]
    assert rows(bad.select("line", "value")) == [(2, "-1 2 5"), (3, "1 x 3")]


def test_pairs_signal_and_beds(spark, tmp_path):
    p = tmp_path / "p.txt"
    p.write_text("0\t1\t100\t1\t16\tchr1\t900\t4\n")
    assert rows(R.read_pairs7(spark, str(p))) == [("chr1", 100, "chr1", 900)]
    with gzip.open(tmp_path / "s.bed.gz", "wt") as f:
        f.write("chr1\t10\t20\t0.5\nchr2\t1\t2\t3\nchr1\t5\nchr1\ta\t6\t1\n")
    assert rows(R.read_signal_bed4(spark, str(tmp_path / "s.bed.gz"), ["chr1"])) == [("chr1", 10, 20, 0.5)]
    q = tmp_path / "q.bed"
    q.write_text("track name=x\n#c\nchr1\t1\t2\tn\t7\nchr1\t3\t4\n")
    assert rows(R.read_bed_score(spark, str(q))) == [("chr1", 1, 2, 7.0), ("chr1", 3, 4, 1.0)]
    q = tmp_path / "t.bed"
    q.write_text("chr1\t1\t2\tn\t7\t+\t1\t2\t3\t4\nchr1\t3\t4\n")
    assert rows(R.read_bed10(spark, str(q))) == [("chr1", 1, 2, 7.0)]


def test_lists_labels_vectors(spark, tmp_path):
    p = tmp_path / "m.bed"
    p.write_text("chr1\t0\t10\ta\tb\tc\t1\t2\t0\t0\n")
    assert rows(R.read_methyl_pairs(spark, str(p), ["x", "y"])) == [("x", "chr1", 0, 10, 1.0, 2.0), ("y", "chr1", 0, 10, 0.0, 0.0)]
    (tmp_path / "sizes").write_text("chr1 100\nchr2\t50\n")
    assert rows(R.read_chrom_sizes(spark, str(tmp_path / "sizes"))) == [("chr1", 100), ("chr2", 50)]
    (tmp_path / "list").write_text("a\n\nb\n")
    assert rows(R.read_samples(spark, str(tmp_path / "list"))) == [("a",), ("b",)]
    (tmp_path / "labels").write_text("1 s1 red\n2 s2 blue\n3 s3 green\n")
    assert set(rows(R.read_cell_labels(spark, str(tmp_path / "labels"), {"red": "A", "blue": "B"}).fillna("-"))) == {("s1", "A"), ("s2", "B"), ("s3", "-")}
    (tmp_path / "vec").write_text("0.5\nNaN\n-1\n")
    assert sorted((r.bin, r.value) for r in R.read_vector(spark, str(tmp_path / "vec")).collect() if r.value is not None) == [(0, 0.5), (2, -1.0)]


def test_counts_wide_and_10x(spark, tmp_path):
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("gene,a,b\ng1,1,NA\n")
    assert set(rows(R.read_counts_wide(spark, str(tmp_path / "c.csv.gz"), "gene").fillna(-1.0))) == {("g1", "a", 1.0), ("g1", "b", -1.0)}
    (tmp_path / "m.mtx").write_text("%%head\n%c\n2 2 2\n1 1 3\n2 2 4\n")
    (tmp_path / "b.tsv").write_text("AA\nCC\n")
    (tmp_path / "f.tsv").write_text("id1\tG1\nid2\tG2\n")
    got = R.read_10x(spark, str(tmp_path / "m.mtx"), str(tmp_path / "b.tsv"), str(tmp_path / "f.tsv"))
    assert rows(got) == [("AA", "G1", 3.0), ("CC", "G2", 4.0)]


def test_sinks_and_skip(spark, tmp_path):
    m = spark.createDataFrame([("s", "chr1", 0, 1, 2.0), ("s", "chr2", 0, 0, 1.0)], "sample string, chrom string, i long, j long, value double")
    W.write_matrix(m, str(tmp_path / "m"))
    W.write_matrix(m.where("chrom = 'chr1'").withColumn("value", F.lit(9.0)), str(tmp_path / "m"))
    assert {(r.chrom, r.value) for r in W.read_matrix(spark, str(tmp_path / "m")).collect()} == {("chr1", 9.0), ("chr2", 1.0)}
    units = spark.createDataFrame([("s", "chr1"), ("s", "chr3")], "sample string, chrom string")
    assert rows(W.skip_existing(units, str(tmp_path / "m"), ["sample", "chrom"])) == [("s", "chr3")]
    assert W.skip_existing(units, str(tmp_path / "none"), ["sample", "chrom"]).count() == 2
    W.write_triplets(m, str(tmp_path / "t"))
    assert {r.value for r in spark.read.text(str(tmp_path / "t")).collect()} == {"0\t1\t2.0", "0\t0\t1.0"}
    W.write_lines(matrix.short_score_lines(m, 10), str(tmp_path / "l"))
    assert "0 chr1 0 0 0 chr1 10 1 2.00000" in {r.value for r in spark.read.text(str(tmp_path / "l")).collect()}
    W.write_blocks(m, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2
    f = m.select("sample", "chrom", F.col("i").alias("idx"), F.lit(0).alias("r"), "value")
    W.write_factors(f, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2
    W.write_calls(m, units, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c" / "summary")).count() == 2
    curve = spark.createDataFrame([("chr1", 1, 0.5)], "chrom string, bin long, value double")
    W.write_curve(curve, str(tmp_path / "cu"), 10)
    assert [r.value for r in spark.read.text(str(tmp_path / "cu")).collect()] == ["chr1\t10\t20\t0.5"]
    W.write_bed(boundaries.boundary_bed(curve.withColumnRenamed("value", "strength"), 10), str(tmp_path / "bed"))
    assert [r.value for r in spark.read.text(str(tmp_path / "bed")).collect()] == ["chr1\t10\t20\t.\t0.5\t+"]


def test_hand_sized_cases(spark):
    m = spark.createDataFrame([("s", "c", 0, 1, 2.0), ("s", "c", 0, 0, 5.0)], "sample string, chrom string, i long, j long, value double")
    assert [r[2:] for r in rows(matrix.symmetrize(m))] == [(0, 0, 5.0), (0, 1, 2.0), (1, 0, 2.0)]
    d = spark.createDataFrame([("s", "c", 0, k, 1.0) for k in (0, 1, 2, 5)], "sample string, chrom string, i long, j long, value double")
    assert [r[4] for r in rows(matrix.emphasize(d, 2))] == [1, 2, 3, 3]
    assert [r[4] for r in rows(matrix.emphasize(d, 2, 0))] == [1, 2, 2]
    s = spark.createDataFrame([("a", 2_000_000), ("b", 2_000_001)], "chrom string, length long")
    assert [tuple(r) for r in s.select(*(B.bin_count(F.col("length"), 1_000_000, k) for k in ("ceil", "plus1", "floor"))).collect()] == [(2, 3, 2), (3, 3, 2)]
    curve = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate((3, 2, 1, 2, 3))], "chrom string, bin long, value double")
    assert rows(boundaries.boundaries_delta(curve, ["chrom"])) == [("c", 1, -2.0)]
    three = spark.createDataFrame([("c", i, 3.0) for i in range(3)], "chrom string, bin long, value double")
    assert [r.v for r in three.withColumn("v", boundaries.moving_average(["chrom"], 3)).orderBy("bin").collect()] == [2.0, 3.0, 2.0]
    sig = spark.createDataFrame([("c", 0, 1.0), ("c", 10, 1.0), ("c", 11, 2.0), ("c", 12, 3.0)], "chrom string, start long, value double")
    assert rows(intervals.sub_bin_integral(sig, 10, ["chrom"])) == [("c", 0, 0.0), ("c", 1, 4.0)]
    reads = spark.createDataFrame([("c", p) for p in (99, 100, 400)], "chrom string, pos long")
    sites = spark.createDataFrame([("c", p) for p in (100, 400)], "chrom string, pos long")
    assert rows(intervals.fragment_index(reads, sites)) == [("c", 99, 0), ("c", 100, 1), ("c", 400, 2)]
    b = B.make_bins(spark.createDataFrame([("c", 20)], "chrom string, length long"), 10)
    t = spark.createDataFrame([("c", 0, 10, 1.0), ("c", 10, 20, None)], "chrom string, start long, end long, value double")
    assert rows(intervals.dark_bins(t, b, 10)) == [("c", 1)] and rows(intervals.dark_bins(t, b, 10, 0.6, missing_is_dark=False)) == []
    with pytest.raises(Exception, match="not a resolution"):
        spark.createDataFrame([("100000",)], "t string").select(B.parse_resolution(F.col("t"))).collect()
    audit = filters.audit(spark.createDataFrame([("g", 0.0), ("g", float("nan")), ("g", float("inf"))], "g string, v double"), "v", ["g"]).first()
    assert tuple(audit) == ("g", 1, 1, 1, 3)
