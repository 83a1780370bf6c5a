"""Interval operators: half-open [start, end) on a chromosome, in positions from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.functions.numeric import checkpoint, ranged, running_total


def _levelled(t: DataFrame) -> DataFrame:
    """Non-empty intervals with `_level`: bins of 4 ** _level positions are the smallest that are no shorter than the interval."""
    bits = F.when(F.col("end") - F.col("start") == 1, 0).otherwise(F.length(F.bin(F.col("end") - F.col("start") - 1)))
    return t.where("end > start").withColumn("_level", F.ceil(bits / 2).cast("int"))


def _laid(t: DataFrame, mark: str, others: DataFrame, home: int, same: bool) -> DataFrame:
    """The rows of an interval: one or two bins of its own level, marked as its home, and those that hold its ends on each coarser level that the other table
    has, to meet that table's homes; with `same` also on its own level."""
    met = F.filter("_levels", lambda x: x >= F.col("_level") if same else x > F.col("_level"))
    meets = F.transform(met, lambda x: F.struct(x.alias("level"), F.lit(3 - home).alias("kind")))
    own = F.array(F.struct(F.col("_level").alias("level"), F.lit(home).alias("kind")))
    levels = others.agg(F.collect_set("_level").alias("_levels"))  # one row of at most 33 numbers
    columns = [c for c in t.columns if c not in ("chrom", "_level")]
    placed = t.crossJoin(F.broadcast(levels)).withColumn("_at", F.explode(F.concat(meets, own))).select("chrom", *columns, "_at.level", "_at.kind")
    spread = F.explode(F.expr("sequence(shiftright(cast(start as bigint), 2 * level), shiftright(cast(end as bigint) - 1, 2 * level))"))
    return placed.select("chrom", F.col("level").alias("_level"), F.col("kind").alias("_kind"), spread.alias("_bin"), *(F.col(c).alias(f"{mark}_{c}") for c in columns))


def overlap_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """All overlapping pairs of a(chrom, start, end, id) and b(chrom, start, end, id, ...): (chrom, a_id, b_id, lap, ...).

    A range join as an equality join over a hierarchy of bins: an interval is at home in one or two bins of the level of its own length, however long it is, and
    looks for longer intervals where they are at home. A pair meets on the level of its longer interval, in bins that both touch, and is kept in the bin that
    holds the later start, which needs no distinct. Candidates are a small multiple of the pairs that overlap, whatever mix of lengths the tables have. Bins
    can be split by Spark where one is hot. Empty intervals overlap nothing.
    """
    a, b = _levelled(a), _levelled(b)
    j = _laid(a, "a", b, 2, True).join(_laid(b, "b", a, 1, False), ["chrom", "_level", "_kind", "_bin"]).where("a_start < b_end and b_start < a_end")
    j = j.where(F.expr("_bin = shiftright(cast(greatest(a_start, b_start) as bigint), 2 * _level)"))
    return j.withColumn("lap", F.least("a_end", "b_end") - F.greatest("a_start", "b_start")).drop("_bin", "_level", "_kind")


def _spots(t: DataFrame) -> DataFrame:
    """The distinct non-empty intervals and how often each is there."""
    return checkpoint(t.where("end > start and chrom is not null").groupBy("chrom", "start", "end").agg(F.count("*").alias("_k")), "spots")


def _passed(a: DataFrame, b: DataFrame) -> DataFrame:
    """(chrom, pos, starts, ends, starts_b, ends_b, started, ended, started_b, ended_b) of two tables of _spots: those that start or end at a position, and those that
    started before it or ended up to it."""
    names = ["starts", "ends", "starts_b", "ends_b"]

    def steps(t: DataFrame, k: int) -> DataFrame:
        n = lambda at: [F.when(F.lit(at == c), F.col("_k")).otherwise(F.lit(0)).cast("long").alias(x) for c, x in enumerate(names)]
        both = F.explode(F.array(F.struct(F.col("start").cast("long").alias("pos"), *n(2 * k)), F.struct(F.col("end").cast("long").alias("pos"), *n(2 * k + 1))))
        return t.select("chrom", both.alias("_s")).select("chrom", "_s.*")

    at = steps(a, 0).unionByName(steps(b, 1)).groupBy("chrom", "pos").agg(*(F.sum(x).alias(x) for x in names))
    parts = ranged(at, ["chrom"], [F.col("pos")])
    before = Window.partitionBy("chrom").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.groupBy("chrom", "_k").agg(*(F.sum(x).alias(x) for x in names)).select("chrom", "_k", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"_{x}") for x in names))
    inside = Window.partitionBy("chrom", "_k").orderBy("pos")
    upto = {x: F.sum(x).over(inside).alias(f"_in_{x}") for x in names}
    laid = parts.select("*", *upto.values()).join(ahead, ["chrom", "_k"])
    total = {x: F.col(f"_in_{x}") + F.col(f"_{x}") for x in names}
    return checkpoint(laid.select(
        "chrom", "pos", *names, (total["starts"] - F.col("starts")).alias("started"), total["ends"].alias("ended"), (total["starts_b"] - F.col("starts_b")).alias("started_b"), total["ends_b"].alias("ended_b"),
    ), "passed")


def _with_partners(t: DataFrame, spots: DataFrame, passed: DataFrame, mark: str) -> DataFrame:
    """One row (_n, _met): the ids of a table, and those that overlap an interval of the other table, whose starts and ends `passed` names with `mark`."""
    last = passed.select("chrom", F.col("pos").alias("end"), F.col(f"started{mark}").alias("_started"))
    first = passed.select("chrom", F.col("pos").alias("start"), F.col(f"ended{mark}").alias("_ended"))
    lone = spots.join(last, ["chrom", "end"]).join(first, ["chrom", "start"]).where("_started = _ended").select("chrom", "start", "end", F.lit(False).alias("_hit"))
    lone = checkpoint(lone, "lone")
    met = F.coalesce(F.col("end") > F.col("start"), F.lit(False)) & F.col("chrom").isNotNull() & F.coalesce("_hit", F.lit(True))
    flagged = t.where("id is not null").select("chrom", "start", "end", "id").join(lone, ["chrom", "start", "end"], "left").select("id", met.alias("_met"))
    return flagged.groupBy("id").agg(F.max("_met").alias("_met")).agg(F.count("*").alias("_n"), F.count_if("_met").alias("_met"))


def overlap_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_a, only_b, pairs): intervals of one table without the other, and overlapping pairs.

    No pair is laid out: the intervals that overlap one from start to end are those that start before its end without those that end up to its start, and both are
    running totals over the positions of a chromosome, in ranges. Equal intervals are counted once before."""
    spots_a, spots_b = _spots(a), _spots(b)
    passed = _passed(spots_a, spots_b)
    pairs = passed.agg(F.coalesce(F.sum(F.col("ends") * F.col("started_b") - F.col("starts") * F.col("ended_b")), F.lit(0)).alias("pairs"))
    n, m = _with_partners(a, spots_a, passed, "_b"), _with_partners(b, spots_b, passed, "")
    both = pairs.crossJoin(F.broadcast(n.select((F.col("_n") - F.col("_met")).alias("only_a")))).crossJoin(F.broadcast(m.select((F.col("_n") - F.col("_met")).alias("only_b"))))
    return both.select("only_a", "only_b", "pairs")


def slop(t: DataFrame, by: int, sizes: DataFrame | None = None) -> DataFrame:
    """Intervals widened by `by` on both sides, within 0 and the chromosome's length where given."""
    out = t.withColumn("start", F.greatest(F.col("start") - by, F.lit(0)))
    if sizes is None:
        return out.withColumn("end", F.col("end") + by)
    return out.join(F.broadcast(sizes.select("chrom", "length")), "chrom").withColumn("end", F.least(F.col("end") + by, "length")).drop("length")


def bin_laps(signal: DataFrame, resolution: int) -> DataFrame:
    """Each interval cut at bin ends: adds `bin` and `lap`, the positions of it that lie in the bin."""
    spread = F.sequence(F.expr(f"start div {resolution}"), F.expr(f"(end - 1) div {resolution}"))
    cut = signal.where("end > start").withColumn("bin", F.explode(spread))
    return cut.withColumn("lap", F.least("end", (F.col("bin") + 1) * resolution) - F.greatest("start", F.col("bin") * resolution))


def bin_mean(signal: DataFrame, resolution: int, group: list[str], bins: DataFrame | None = None) -> DataFrame:
    """Mean of the values that start in a bin; bins without values are absent, or null where `bins` (chrom, bin) is given."""
    out = signal.groupBy(*group, F.expr(f"start div {resolution}").alias("bin")).agg(F.avg("value").alias("value"))
    return out if bins is None else out.join(bins, ["chrom", "bin"], "right")


def bin_average_dense(signal: DataFrame, resolution: int, group: list[str]) -> DataFrame:
    """Mean over the covered positions of each bin; missing values count as not covered; 0 for bins with none."""
    laps = bin_laps(signal, resolution)
    covered = F.sum(F.when(F.col("value").isNotNull(), F.col("lap")))
    return laps.groupBy(*group, "bin").agg(F.coalesce(F.try_divide(F.sum(F.col("value") * F.col("lap")), covered), F.lit(0.0)).alias("value"))


def dark_bins(mappability: DataFrame, bins: DataFrame, resolution: int, least: float = 0.5, missing_is_dark: bool = True) -> DataFrame:
    """(chrom, bin) with an average mappability under `least`: over the whole bin with missing positions as 0, or, with missing_is_dark=False, over the
    covered positions only, where a bin without any is not dark."""
    laps = bin_laps(mappability.where(F.col("value").isNotNull()), resolution).groupBy("chrom", "bin").agg(F.sum(F.col("value") * F.col("lap")).alias("_s"), F.sum("lap").alias("_n"))
    all_bins = bins.join(laps, ["chrom", "bin"], "left")
    mean = F.coalesce(F.col("_s"), F.lit(0.0)) / (F.col("end") - F.col("start")) if missing_is_dark else F.try_divide("_s", F.col("_n"))
    return all_bins.where(mean < least).select("chrom", "bin")


def fragment_index(reads: DataFrame, sites: DataFrame) -> DataFrame:
    """reads(chrom, pos, ...) with `fragment`, the number of sites (chrom, pos) at or before the position: a running count over reads and sites together,
    sites first where positions agree, in ranges of a chromosome."""
    columns = reads.columns
    tagged = reads.withColumn("_site", F.lit(0)).unionByName(sites.select("chrom", "pos").withColumn("_site", F.lit(1)), allowMissingColumns=True)
    counted = running_total(tagged, ["chrom"], [F.col("pos"), F.desc("_site")], F.col("_site"), "fragment")
    return counted.where("_site = 0").select(*columns, "fragment")


def pair_mates(reads: DataFrame) -> DataFrame:
    """Two reads(sample, qname, chrom_idx, fragment, flag, pos) of one name as a pair ordered by chromosome, fragment, strand and start; names with
    another number of reads give nothing. At most two reads of a name are carried past the count."""
    order = F.struct("chrom_idx", "fragment", F.col("flag").bitwiseAND(16).alias("strand"), "pos")
    got = reads.groupBy("sample", "qname").agg(F.count("*").alias("n"), F.min(order).alias("a"), F.max(order).alias("b")).where("n = 2")
    return got.select("sample", "qname", *(F.col(f"{s}.{c}").alias(f"{c}{i}") for i, s in ((1, "a"), (2, "b")) for c in ("chrom_idx", "fragment", "strand", "pos")))


def window_signal(signal: DataFrame, windows: DataFrame) -> DataFrame:
    """(chrom, id, sample, n, value): count and overlap-weighted mean of each sample's signal in each window."""
    s = signal.withColumn("id", F.lit(0))
    laps = overlap_pairs(windows.select("chrom", "start", "end", "id"), s)
    return laps.groupBy("chrom", F.col("a_id").alias("id"), F.col("b_sample").alias("sample")).agg(F.count("*").alias("n"), (F.sum(F.col("b_value") * F.col("lap")) / F.sum("lap")).alias("value"))


def gene_counts(reads: DataFrame, exons: DataFrame) -> DataFrame:
    """(gene, n): reads that touch exons(chrom, start, end, id, gene) of one gene only."""
    hits = overlap_pairs(reads.select("chrom", "start", "end", "id"), exons).groupBy("a_id").agg(F.min("b_gene").alias("gene"), F.max("b_gene").alias("_last"))
    return hits.where("gene = _last").groupBy("gene").agg(F.count("*").alias("n"))


def coverage_bins(t: DataFrame, resolution: int) -> DataFrame:
    """(chrom, bin, depth): depth of intervals summed over the positions of each bin. The depth of a bin is the sum of the overlaps with it."""
    return bin_laps(t, resolution).groupBy("chrom", "bin").agg(F.sum("lap").alias("depth"))


def depth_segments(t: DataFrame) -> DataFrame:
    """(chrom, start, end, depth): maximal segments of equal events, from a running sum of +1 at starts and -1 at ends, in ranges of a chromosome. Where a range ends,
    the next one's first position closes its last segment."""
    both = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d"))))
    steps = t.select("chrom", both.alias("_s")).groupBy("chrom", "_s.pos").agg(F.sum("_s.d").alias("d"))
    parts = ranged(steps, ["chrom"], [F.col("pos")])
    w = Window.partitionBy("chrom").orderBy("_k")
    edges = parts.groupBy("chrom", "_k").agg(F.min("pos").alias("_first"), F.sum("d").alias("_d"))
    edges = edges.select("chrom", "_k", F.lead("_first").over(w).alias("_next"), F.coalesce(F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("chrom", "_k").orderBy("pos")
    run = parts.withColumn("_end", F.lead("pos").over(inside)).withColumn("_depth", F.sum("d").over(inside)).join(edges, ["chrom", "_k"])
    out = run.select("chrom", F.col("pos").alias("start"), F.coalesce("_end", "_next").alias("end"), (F.col("_depth") + F.col("_before")).alias("depth"))
    return out.where("end is not null and depth > 0")


def sub_bin_integral(signal: DataFrame, sub: int, group: list[str]) -> DataFrame:
    """(group, bin, value): trapezoid of the values by start within bins of `sub` positions, unit spacing; a single value gives 0."""
    per = signal.groupBy(*group, F.expr(f"start div {sub}").alias("bin"))
    order = F.struct("start", "value")
    ends = (F.min(order)["value"] + F.max(order)["value"]) / 2
    return per.agg(F.when(F.count("*") == 1, 0.0).otherwise(F.sum("value") - ends).alias("value"))


def aligned_profile(signal: DataFrame, anchors: DataFrame, reach: int, step: int) -> DataFrame:
    """(anchor, offset, value): mean of the values that start within `reach` of an anchor (chrom, pos, anchor), by steps; missing steps take the anchor's mean."""
    near = anchors.select("chrom", "anchor", F.col("pos"), (F.col("pos") - reach).alias("start"), (F.col("pos") + reach).alias("end"), F.col("anchor").alias("id"))
    points = signal.select("chrom", "start", (F.col("start") + 1).alias("end"), F.lit(0).alias("id"), "value")
    hits = overlap_pairs(near.withColumn("start", F.greatest("start", F.lit(0))), points)
    off = F.floor((F.col("b_start") - F.col("a_pos")) / step).cast("long")
    means = hits.groupBy(F.col("a_anchor").alias("anchor"), off.alias("offset")).agg(F.avg("b_value").alias("value"))
    grid = means.select("anchor").distinct().withColumn("offset", F.explode(F.sequence(F.lit(-(reach // step)), F.lit(reach // step - 1)).cast("array<bigint>")))
    full = grid.join(means, ["anchor", "offset"], "left")
    return full.withColumn("value", F.coalesce("value", F.avg("value").over(Window.partitionBy("anchor"))))


def cpg_density(chunks: DataFrame, resolution: int) -> DataFrame:
    """(chrom, bin, value): share of "CG" starts per position of sequence chunks(chrom, start, seq); a pair split between two chunks that follow one another
    counts by the chunk before. Chunks meet the first letter of the next by position, and pairs are counted in a chunk's piece of each bin, not letter by letter."""
    size = F.length("seq")
    first = chunks.select("chrom", F.col("start").alias("_end"), F.left("seq", F.lit(1)).alias("_next")).where("_next <> ''")
    joined = chunks.withColumn("_end", F.col("start") + size).join(first, ["chrom", "_end"], "left")
    joined = joined.withColumn("_seq", F.upper(F.concat("seq", F.coalesce("_next", F.lit("")))))
    spread = F.sequence(F.expr(f"start div {resolution}"), F.expr(f"(_end - 1) div {resolution}"))
    cut = joined.where("_end > start").withColumn("bin", F.explode(spread))
    lo, hi = F.greatest("start", F.col("bin") * resolution), F.least("_end", (F.col("bin") + 1) * resolution)
    piece = F.substr("_seq", (lo - F.col("start") + 1).cast("int"), (hi - lo + 1).cast("int"))
    pairs = (F.length(piece) - F.length(F.replace(piece, F.lit("CG"), F.lit("")))) / 2
    return cut.groupBy("chrom", "bin").agg((F.sum(pairs) / F.sum(hi - lo)).alias("value"))
