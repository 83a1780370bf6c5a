"""I-Match document fingerprints, by DataFrame functions only.

The lexicon holds the terms whose inverse document frequency lies in a band: in at least one of RARE documents (and in two), and in at most one of
COMMON. A document has at most its number of distinct terms in it, so at most RARE times the mean number of distinct terms of a document reach the
band, however large the corpus: that bounds the broadcast.

A fingerprint is the hash of a text's sorted distinct lexicon terms, and hashes of its terms in randomised subsets of the lexicon: each subset takes
the terms whose hash falls in one of its cells, 1 in 16, 128 or 1024 of the lexicon. Small subsets survive edits of long texts, large ones tell short
texts apart. The likeness of two fingerprints is 1 if the first hashes agree, else the share of equal subsets among those not empty in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import id_or_none, materialize, none_again, text_or_empty

RARE = 500
COMMON = 10
#: (one subset holds one in so many lexicon terms, number of subsets)
SUBSETS = ((16, 8), (128, 32), (1024, 64))
NONE = "----"


def terms(text: Column) -> Column:
    """The distinct terms of a text (runs of letters and digits, in lower case) as 64-bit hashes."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term): hashes of the terms in the band, counted over all documents."""
    total = docs.count()
    low, high = max(2, -(-total // RARE)), total / COMMON
    seen = docs.select(F.explode(terms(text_or_empty(text_col))).alias("term"))
    return seen.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= low) & (F.col("df") <= high)).select("term")


def _bound(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda over an array of one element names it."""
    return F.transform(F.array(value), body)[0]


def _subsets(found: Column, seed: int, rate: int, count: int) -> Column:
    """A number from 1 to 65535 for each of `count` subsets of one in `rate` lexicon terms, from the sorted terms; 0 for an empty one."""
    celled = F.transform(found, lambda t: F.struct(F.pmod(F.xxhash64(t, F.lit(seed)), F.lit(rate)).alias("cell"), t.alias("term")))

    def number(own: Column) -> Column:
        hashed = F.pmod(F.xxhash64(F.transform(own, lambda x: x["term"])), F.lit(65535)) + 1
        return F.when(F.size(own) == 0, F.lit(0)).otherwise(hashed.cast("int"))

    def split(taken: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda j: number(F.filter(taken, lambda x: x["cell"] == j)))

    return _bound(F.filter(celled, lambda x: x["cell"] < count), split)


def subset_numbers(found: Column) -> Column:
    return F.concat(*(_subsets(found, seed, rate, count) for seed, (rate, count) in enumerate(SUBSETS)))


def compose(first: Column, parts: Column) -> Column:
    """The fingerprint as text: 16 hex digits, a dot, and four for each subset, dashes for an empty one."""
    digits = F.transform(parts, lambda n: F.when(n == 0, F.lit(NONE)).otherwise(F.lower(F.lpad(F.hex(n), 4, "0"))))
    return F.concat(F.lower(F.lpad(F.hex(first), 16, "0")), F.lit("."), F.array_join(digits, ""))


def likeness(first_a: Column, parts_a: Column, first_b: Column, parts_b: Column) -> Column:
    """0 to 1 for two fingerprints."""
    both = F.zip_with(parts_a, parts_b, lambda x, y: F.when((x == y) & (x != 0), 1001).when((x != 0) | (y != 0), 1000).otherwise(0))
    tally = F.aggregate(both, F.lit(0), lambda s, v: s + v)
    share = _bound(tally, lambda t: F.when(t == 0, F.lit(0.0)).otherwise((t % 1000) / F.floor(t / 1000)))
    return F.when(first_a == first_b, F.lit(1.0)).otherwise(share)


def fingerprint_rows(rows: DataFrame, words: DataFrame, key: str, versions: list[str], once: list[str]) -> DataFrame:
    """Fingerprints of several text columns of a table, one row per row: (key, once.., <version>_first, <version>_parts).

    The terms of all versions are laid out as rows, kept by a broadcast join with the lexicon and gathered again under the key and a row number,
    without a shuffle if the table is already partitioned by the key. Term 0 stands in for texts without lexicon terms; `once` columns ride on its
    row alone. A text without lexicon terms is told by all its terms.
    """

    def tagged(version: int):
        return lambda t: F.struct(F.lit(version).alias("v"), t.alias("term"))

    numbered, names = rows.withColumn("_row", F.monotonically_increasing_id()), versions
    for i, v in enumerate(names):
        numbered = numbered.withColumn(f"_t{i}", terms(F.col(v)))
    laid = numbered.select(
        key, "_row", *once,
        *(F.xxhash64(F.array_sort(f"_t{i}")).alias(f"_all{i}") for i in range(len(names))),
        F.explode(F.concat(F.array(tagged(-1)(F.lit(0).cast("long"))), *(F.transform(f"_t{i}", tagged(i)) for i in range(len(names))))).alias("_x"),
    )
    lead = F.col("_x.v") == -1
    alls = [f"_all{i}" for i in range(len(names))]
    slim = laid.select(key, "_row", *(F.when(lead, F.col(c)).alias(c) for c in [*once, *alls]), F.col("_x.v").alias("_v"), F.col("_x.term").alias("term"))
    kept = slim.join(F.broadcast(words.unionByName(words.sparkSession.range(1).select(F.lit(0).cast("long").alias("term"))).distinct()), "term")
    gathered = kept.groupBy(key, "_row").agg(
        *(F.max(c).alias(c) for c in [*once, *alls]),
        *(F.array_sort(F.collect_list(F.when(F.col("_v") == i, F.col("term")))).alias(f"_f{i}") for i in range(len(names))),
    )
    out = []
    for i, v in enumerate(names):
        found = F.col(f"_f{i}")
        out += [F.when(F.size(found) == 0, F.col(f"_all{i}")).otherwise(F.xxhash64(found)).alias(f"{v}_first"), subset_numbers(found).alias(f"{v}_parts")]
    return gathered.select(key, *once, *out)


def following(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id): for each distinct id the next lower one, and the highest for the lowest.

    Ids are sorted by ranges; a written table fixes each one's place within its range, and the counts of the ranges (as many as partitions) turn
    places into numbers, so no task sees more than a range."""
    ranged = ids.select("doc_id").distinct().repartitionByRange(F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id"))
    placed = materialize(ranged.withColumn("place", F.monotonically_increasing_id()), "places")
    part = F.shiftright("place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total")
    )
    numbered = placed.withColumn("part", part).join(F.broadcast(before), "part").select("doc_id", "total", (F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("number"))
    after = numbered.select(F.col("doc_id").alias("next_id"), F.col("number").alias("after"))
    return numbered.withColumn("after", (F.col("number") + 1) % F.col("total")).join(after, "after").select("doc_id", "next_id")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses: the columns of the contract, one row per row of `docs`.

    Null texts count as empty. A repeated id takes part as often as it comes; as "next document" it stands once, with its smallest text. A null id is
    the lowest and comes back as null. Other columns are ignored; an empty table gives no rows.
    """
    # one shuffle of the texts, shared by the documents as such and as givers of their first half
    base = docs.select(id_or_none().alias("doc_id"), text_or_empty().alias("text")).repartition("doc_id")
    slim = docs.select(id_or_none().alias("doc_id"), F.char_length(text_or_empty()).cast("long").alias("n_chars"))
    words = materialize(lexicon(docs), "lexicon")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    wants = slim.groupBy("doc_id").agg(F.max(half).alias("want")).join(following(slim), "doc_id")
    asked = wants.select(F.col("doc_id").alias("to"), F.col("next_id").alias("doc_id"), "want")
    giving = base.join(asked, "doc_id").withColumn("gift", F.substr("text", F.lit(1), F.col("want")))
    gifts = fingerprint_rows(giving, words, "doc_id", ["text"], ["to", "gift"]).select(
        F.col("to").alias("doc_id"), F.struct("gift", F.col("text_first").alias("first"), F.col("text_parts").alias("parts")).alias("next")
    )
    gifts = gifts.groupBy("doc_id").agg(F.min("next").alias("next"))
    rows = base.join(gifts, "doc_id").withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substr(F.col("next.gift"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    rows = rows.withColumn("next_first", F.col("next.first")).withColumn("next_parts", F.col("next.parts")).drop("next")
    done = fingerprint_rows(rows, words, "doc_id", ["text", "edited"], ["n_chars", "edited_sha256", "next_first", "next_parts"])
    own, other, after = ((F.col(f"{v}_first"), F.col(f"{v}_parts")) for v in ("text", "edited", "next"))
    return done.select(
        none_again().alias("doc_id"), "n_chars", "edited_sha256", compose(*own).alias("fingerprint"), compose(*other).alias("edited_fingerprint"),
        likeness(*own, *other).alias("near_edited"), likeness(*own, *after).alias("near_next"),
    )
