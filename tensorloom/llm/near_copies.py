"""Near-duplicate texts: wide SimHash fingerprints in a byte-position index find candidates, exact shingle sets verify them.

A text is its set of 5-word shingles (words as in `simhash.fingerprint`); texts with the same words are one node. The fingerprint is that of
`simhash.fingerprint`, a bit set when it is set in over half of the shingles' hashes, over distinct shingles and with more bits: at a Jaccard similarity
of 0.8 up to 15 % of the bits differ, 4 to 14 of 64, so that 64 bits need share no byte, while of `BYTES` positional bytes 27 % stay equal. A posting is
a block of two neighbouring positions with their bytes. A pair at similarity 0.8 shares none of 128 blocks with chance 7e-5, a closer one less; sets of fewer than
SMALL shingles, whose bits differ in up to 16 %, have 160 blocks (5e-5), and one set of up to nine shingles that is another one less a shingle, where 19 % can
differ, is found by an exact key instead.

Within a posting list pairs are tallied by 104 further bits (up to 19 % differ on average, half in texts that have nothing in common: `MOST_FILTER` is 5.7 deviations more),
then by all equal positional bytes, where LEAST_BYTES of 256 is over five deviations below the mean, and by differing bits, where MOST_DIFFER of 2048 is six above it
at 16 %; the rest is compared exactly. A list with more than `DENSE`
such pairs a member holds a group of near copies, whose pairs are never laid out: its members are compared with the one that meets most others over all
such lists, which joins groups of copies by one comparison a member. Then the members outside a list's largest group meet all that are not in their own group:
so every pair of a list is either joined already or looked at. A list of over LIST_LIMIT members goes the same way, without being held. Count filters stand before
the exact comparison there, too. One is exact: a text's shingles that occur in another text of an open list are counted, and a pair can't share more than the
smaller count, so texts that only have a passage in common fall out. The other goes by four bits of each of 192 minima: unequal minima differ in two of the bits on
average, 77 in all at 0.8 with a deviation of 13; `MOST_BITS` is six deviations more.

Ids and texts move only where they have to: a list of nodes of up to MOST_NODES, by its count, goes to all tasks; a longer one meets the texts in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import give_back, materialize, text_or_empty
from tensorloom.llm.connected import connected_components

NGRAM, LEAST = 5, 0.8
BANDS, ROWS = 32, 6
MOST_BITS = 153
MOST_NODES = 500_000
SMALL, FULL_BLOCKS, SMALL_BLOCKS = 64, 128, 160
BYTES = 2 * FULL_BLOCKS
WORDS = SMALL_BLOCKS // 4 + 2
FILTER_BITS, MOST_FILTER, LEAST_BYTES, MOST_DIFFER = 40, 36, 24, 430
LIST_LIMIT, DENSE, BATCH_ROWS = 2048, 3, 200_000
SKETCH = "node long, fp binary, size int"
POSTING = "posting long, more long, node long"
_rng = np.random.default_rng(42)
FACTORS = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
STEPS = _rng.integers(0, 1 << 64, WORDS, dtype=np.uint64)
LANES = np.uint64(0x0101010101010101)


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(text: str) -> np.ndarray:
    """The distinct hashes of the shingles; a text shorter than a shingle is one shingle."""
    words = _words(text)
    grams = [b" ".join(words)] if len(words) < NGRAM else map(b" ".join, zip(*(words[i:] for i in range(NGRAM)), strict=False))
    return np.unique(np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], dtype=np.uint64))


def _minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[start : start + 2048, None] * FACTORS + OFFSETS).min(axis=0))
    return least


def _bits(least: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, sixteen minima in a long."""
    four = (least >> np.uint64(20)) & np.uint64(15)
    return (four.reshape(-1, 16) << (np.uint64(4) * np.arange(16, dtype=np.uint64))).sum(axis=1, dtype=np.uint64).view(np.int64)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The wide SimHash of a set of shingle hashes: WORDS words, a bit set when it is set in over half of the hashes mixed with the word's own number."""
    ones = np.zeros((WORDS, 8, 8), dtype=np.int64)  # by word, byte and bit
    for start in range(0, len(hashes), 255):
        x = hashes[start : start + 255, None] + STEPS
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
        for bit in range(8):  # one bit of each byte, counted in bytes beside one another
            ones[:, :, bit] += ((x >> np.uint64(bit)) & LANES).sum(axis=0, dtype=np.uint64).view(np.uint8).reshape(WORDS, 8)
    return np.packbits(2 * ones > len(hashes), axis=2, bitorder="little").reshape(-1).view("<u8")


def _sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for t in texts:
            hashes = shingle_hashes(t)
            rows.append((xxhash.xxh3_64_intdigest(b" ".join(_words(t))), fingerprint(hashes).tobytes(), len(hashes)))
        nodes, prints, sizes = zip(*rows, strict=True) if rows else ((), (), ())
        yield pd.DataFrame({"node": np.array(nodes, dtype=np.uint64).view(np.int64), "fp": prints, "size": np.array(sizes, dtype=np.int32)})
    give_back()


def _prints(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u8").reshape(-1, WORDS)


def _postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each node under its blocks: a posting is the number of the block (8 bits), its two bytes and 40 bits of the filter; 64 more follow."""
    for pdf in batches:
        for start in range(0, len(pdf), 500):
            part = pdf.iloc[start : start + 500]
            fp = _prints(part["fp"])
            blocks = fp[:, : SMALL_BLOCKS // 4].copy().view("<u2").astype(np.uint64) | (np.arange(SMALL_BLOCKS, dtype=np.uint64) << np.uint64(16))
            blocks = (blocks << np.uint64(FILTER_BITS)) | (fp[:, -2:-1] >> np.uint64(64 - FILTER_BITS))
            held = (np.arange(SMALL_BLOCKS) < FULL_BLOCKS) | (part["size"].to_numpy()[:, None] < SMALL)
            times = held.sum(axis=1)
            yield pd.DataFrame({"posting": blocks[held].view(np.int64), "more": np.repeat(fp[:, -1].view(np.int64), times), "node": np.repeat(part["node"].to_numpy(np.int64), times)})
    give_back()


def _linked(posting: np.ndarray, more: np.ndarray, node: np.ndarray) -> pd.DataFrame:
    """Of whole lists sorted by posting: the pairs that pass the filter (kind 0, a and b); of lists with over DENSE such pairs a member, those that are in
    one (kind 1, a node and its list); of lists of over LIST_LIMIT all members."""
    slot = posting >> FILTER_BITS
    number = np.cumsum(np.concatenate(([0], slot[1:] != slot[:-1]))) if len(slot) else np.empty(0, np.int64)
    sizes = np.bincount(number)
    met = sizes[number] > LIST_LIMIT
    count, pairs, at, distance = np.where(sizes > LIST_LIMIT, DENSE * sizes + 1, 0), [], np.flatnonzero(~met), 1
    low = posting & ((1 << FILTER_BITS) - 1)
    while len(at := at[at + distance < len(slot)]) and len(at := at[slot[at] == slot[at + distance]]):
        differ = np.bitwise_count(low[at] ^ low[at + distance]).astype(np.int64) + np.bitwise_count(more[at] ^ more[at + distance])
        a = at[differ <= MOST_FILTER]
        met[a] = met[a + distance] = True
        np.add.at(count, number[a], 1)
        a = a[count[number[a]] <= DENSE * sizes[number[a]]]
        pairs.append((a, a + distance))
        distance += 1
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 2
    dense = count > DENSE * sizes
    thin = ~dense[number[a]]
    a, b = node[a[thin]], node[b[thin]]
    member = np.flatnonzero(met & dense[number])
    kind = np.repeat(np.array([0, 1], np.int8), [len(a), len(member)])
    return pd.DataFrame({"kind": kind, "a": np.concatenate((np.minimum(a, b), node[member])), "b": np.concatenate((np.maximum(a, b), slot[member]))})


def _link_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads postings sorted by list, and links whole lists once BATCH_ROWS rows are held. Of a list no more than that is held: the rest of a longer one
    goes on as it comes."""
    parts, held, over = [], 0, None
    for pdf in batches:
        rows = [pdf["posting"].to_numpy(np.int64), pdf["more"].to_numpy(np.int64).view(np.uint64), pdf["node"].to_numpy(np.int64)]
        if over is not None:
            cut = int(np.searchsorted(rows[0] >> FILTER_BITS, over, "right"))
            yield pd.DataFrame({"kind": np.int8(1), "a": rows[2][:cut], "b": np.full(cut, over, dtype=np.int64)})
            rows = [x[cut:] for x in rows]
        parts.append(rows)
        held += len(rows[0])
        if held < BATCH_ROWS:
            continue
        rows = [np.concatenate(x) for x in zip(*parts, strict=True)]
        slot = rows[0] >> FILTER_BITS
        cut, over = int(np.searchsorted(slot, slot[-1], "left")), None
        if len(slot) - cut > LIST_LIMIT:
            cut, over = len(slot), slot[-1]
        yield _linked(*(x[:cut] for x in rows))
        parts, held = [[x[cut:] for x in rows]], len(slot) - cut
    if parts:
        yield _linked(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    give_back()


def _found(nodes: DataFrame) -> DataFrame:
    """(kind, a, b), as in `_linked`, of nodes(node, fp, size)."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a number of partitions keeps the few bytes of the nodes from being laid out 128-fold in one task
    laid = nodes.repartition(n, "node").mapInPandas(_postings, POSTING)
    # the upper bits are the list: sorted by the posting, a list's rows stand together
    lists = laid.repartition(F.shiftright("posting", FILTER_BITS)).sortWithinPartitions("posting")
    return materialize(lists.mapInPandas(_link_lists, "kind byte, a long, b long"), "lists")


def _keys(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        sets = [shingle_hashes(t) for t in texts]
        whole = np.array([x.sum(dtype=np.uint64) for x in sets], dtype=np.uint64)
        yield pd.DataFrame({"whole": whole.view(np.int64), "less": [(w - x).view(np.int64) for w, x in zip(whole, sets, strict=True)]})


def _one_less(rows: DataFrame) -> DataFrame:
    """(a, b): texts of 5 to 9 shingles and those with the same ones but one, by the sum of the hashes. Of texts with the same shingles the smallest node stands for all."""
    keys = F.pandas_udf(_keys, "whole long, less array<long>")
    few = rows.where("_s.size between 4 and 9").groupBy("_node").agg(F.min("_s.size").alias("size"), F.min(text_or_empty()).alias("text"))
    few = materialize(few.select("_node", "size", keys("text").alias("k")), "keys")
    whole = few.groupBy(F.col("k.whole").alias("key"), F.col("size").alias("left")).agg(F.min("_node").alias("other"))
    less = few.where("size > 4").select("_node", (F.col("size") - 1).alias("left"), F.explode("k.less").alias("key"))
    return less.join(whole, ["key", "left"]).select(F.least("_node", "other").alias("a"), F.greatest("_node", "other").alias("b"))


def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether the equal positional bytes reach the minimum and the differing bits don't pass the limit."""
    if not len(a):
        return pd.Series([], dtype=bool)
    differ = (_prints(a) ^ _prints(b))[:, : BYTES // 8].copy()
    tally = (differ.view(np.uint8) == 0).sum(axis=1)
    return pd.Series((tally >= LEAST_BYTES) & (np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= MOST_DIFFER))


def _tallied(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose fingerprints are alike, by the count filter."""
    alike = F.pandas_udf(_alike, "boolean")
    both = pairs.join(nodes.select(F.col("node").alias("a"), F.col("fp").alias("fa")), "a")
    both = both.join(nodes.select(F.col("node").alias("b"), F.col("fp").alias("fb")), "b")
    return both.where(alike("fa", "fb")).select("a", "b")


def _shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([shingle_hashes(t).view(np.int64) for t in texts])
    give_back()


def _near_side(nodes: DataFrame) -> DataFrame:
    """The nodes, to be sent to all tasks where there are few."""
    return F.broadcast(nodes) if nodes.count() <= MOST_NODES else nodes


def _shingle_sets(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(_node, x): the shingle sets of the nodes(_node); rows(_node, text)."""
    shingles = F.pandas_udf(_shingles, "array<long>")
    texts = rows.join(_near_side(nodes), "_node", "left_semi").groupBy("_node").agg(F.min(text_or_empty()).alias("text"))
    return materialize(texts.select("_node", shingles("text").alias("x")), "shingles")


def _verified(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a similarity of LEAST or more; rows(_node, text)."""
    # each side is brought down to its distinct nodes before the two are put together
    asked = materialize(pairs.select(F.col("a").alias("_node")).distinct().unionByName(pairs.select(F.col("b").alias("_node")).distinct()).distinct(), "asked")
    sets = _shingle_sets(rows, asked)
    both = pairs.join(sets.select(F.col("_node").alias("a"), F.col("x").alias("xa")), "a")
    both = both.join(sets.select(F.col("_node").alias("b"), F.col("x").alias("xb")), "b")
    common = F.size(F.array_intersect("xa", "xb"))
    # common / union >= 4 / 5, in whole numbers
    return both.where(5 * common >= 4 * (F.size("xa") + F.size("xb") - common)).select("a", "b")


def _first_pairs(shared: DataFrame) -> DataFrame:
    """Each member of a list with the one that meets most others over all lists; ties go to the larger node."""
    weights = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    first = shared.join(weights, "node").groupBy("slot").agg(F.max(F.struct("weight", "node"))["node"].alias("first"))
    met = shared.join(first, "slot").where("node != first")
    return met.select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b")).distinct()


def _least_bits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for sets in batches:
        yield pd.Series([_bits(_minima(np.asarray(x, dtype=np.int64).view(np.uint64))) for x in sets])
    give_back()


def _across_groups(rows: DataFrame, shared: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs of the lists of shared(slot, node) in different groups of parts(node, component) that the count filters don't rule out: the members outside
    a list's largest group with all others, each pair once, in the first list that both are in. Each side is an ordinary join on the list, which Spark can
    split where a list is hot. A node meets its group as one row with its lists, of which it has at most SMALL_BLOCKS; they are laid out once."""
    slots = shared.groupBy("node").agg(F.collect_list(F.col("slot").cast("int")).alias("slots"))
    placed = slots.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("part"), "slots")
    placed = materialize(placed, "placed")
    held = materialize(placed.select(F.explode("slots").alias("slot"), "node", "part"), "held")
    sizes = held.groupBy("slot", "part").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("slot").agg(F.max(F.struct("k", "part"))["part"].alias("largest"), F.count("*").alias("parts")).where("parts > 1")
    open_lists = materialize(held.join(largest.drop("parts"), "slot"), "open_lists")
    nodes = materialize(open_lists.select(F.col("node").alias("_node")).distinct(), "open_nodes")
    sets = _shingle_sets(rows, nodes)
    laid = sets.select("_node", F.explode("x").alias("shingle"))
    met = laid.groupBy("shingle").agg(F.count("*").alias("k"), F.min("_node").alias("_node")).where("k = 1")
    alone = met.groupBy("_node").agg(F.count("*").alias("alone"))
    # two nodes of different groups have no closed list in common, so all lists of a node can stay
    facts = sets.select("_node", F.size("x").alias("size"), F.pandas_udf(_least_bits, "array<long>")("x").alias("bits"))
    facts = facts.join(placed.select(F.col("node").alias("_node"), "slots"), "_node")
    facts = facts.join(alone, "_node", "left").select(F.col("_node").alias("node"), "size", "bits", "slots", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("met"))
    # a text with over a fifth of its shingles for itself is near to none
    known = materialize(open_lists.join(facts.where("5 * met >= 4 * size"), "node"), "members")
    names = ("node", "part", "size", "bits", "slots", "met", "largest")
    few = known.where("part != largest").select("slot", *(F.col(c).alias(f"{c}1") for c in names))
    many = known.select("slot", *(F.col(c).alias(f"{c}2") for c in names))
    differ = sum((F.bit_count(F.col("bits1")[k].bitwiseXOR(F.col("bits2")[k])) for k in range(BANDS * ROWS // 16)), F.lit(0))
    # similarity of 4 / 5: 9 * common >= 4 * (size + size), and sizes no further apart than that
    near = (9 * F.least("met1", "met2", "size1", "size2") >= 4 * (F.col("size1") + F.col("size2"))) & (differ <= MOST_BITS)
    once = ((F.col("part2") == F.col("largest2")) | (F.col("node1") < F.col("node2"))) & (few.slot == F.array_min(F.array_intersect("slots1", "slots2")))
    pairs = few.join(many, (few.slot == many.slot) & (F.col("part1") != F.col("part2")) & near & once)
    return pairs.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b"))


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """One row of each group of `docs` joined over pairs with similarity 0.8 or more: the smallest doc_id, a null id after all others.
    Equal ids are told apart by text, and null and empty texts are alike. Of rows that agree in id and text the smallest in all columns stays; other columns
    pass through, whatever their names: they go as one struct; an empty table gives no rows."""
    sketch = F.pandas_udf(_sketch, SKETCH)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*(docs[f"`{c}`"] for c in others)) if others else F.lit(None).cast("boolean")
    rows = docs.select("doc_id", "text", rest.alias("rest"), sketch(text_or_empty()).alias("_s")).withColumn("_node", F.col("_s.node"))
    rows = materialize(rows, "sketches")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = rows.select(F.col("_node").alias("node"), "_s.fp", "_s.size").repartition(n, "node").dropDuplicates(["node"])
    nodes = materialize(nodes, "fingerprints")
    found = _found(nodes)
    members = found.where("kind = 1").select(F.col("b").alias("slot"), F.col("a").alias("node"))
    shared = materialize(members.join(members.groupBy("slot").agg(F.count("*").alias("n")), "slot"), "dense_lists")
    pairs = _tallied(found.where("kind = 0").select("a", "b").distinct(), nodes)
    pairs = materialize(pairs.unionByName(_first_pairs(shared)).unionByName(_one_less(rows)).distinct(), "candidates")
    links = materialize(_verified(rows, pairs), "near")
    parts = connected_components(links, "a", "b")
    rest = materialize(_across_groups(rows, shared.drop("n"), parts).join(pairs, ["a", "b"], "left_anti"), "candidates")
    if not rest.isEmpty():
        parts = connected_components(links.unionByName(_verified(rows, rest)), "a", "b")
    # rows alone in their group stay where they are; the others meet, copies of a text first by count
    counts = rows.groupBy("_node").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    labelled = counts.join(parts, counts._node == parts.node, "left").where("node is not null or n > 1")
    labelled = materialize(labelled.select("_node", "low", F.coalesce("component", "_node").alias("part")), "groups")
    involved = _near_side(labelled.select("_node"))
    key = F.struct(F.col("low").isNull().alias("none"), F.col("low").alias("low"), F.col("_node").alias("node"))
    best = labelled.groupBy("part").agg(F.min(key).alias("k")).select(F.col("k.node").alias("_n"), F.col("k.low").alias("_low"))
    several = rows.join(involved, "_node", "left_semi")
    held = several.join(best, (several._node == best._n) & several.doc_id.eqNullSafe(best._low), "left_semi")
    chosen = held.groupBy("_node").agg(F.min(F.struct("text", "rest", "doc_id")).alias("r")).select("r.doc_id", "r.text", "r.rest")
    kept = rows.join(involved, "_node", "left_anti").select("doc_id", "text", "rest").unionByName(chosen)
    return kept.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in docs.columns))
