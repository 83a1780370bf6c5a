"""SimHash near-duplicate detection.

Fingerprints are indexed by position and byte. Two 64-bit fingerprints that differ in at most three bits differ
in at most three of their eight bytes, so they share at least five positional bytes: the guaranteed minimum of
the count filter. A selective prefix of the index is enough to meet every such pair: a posting is a block of four positions
with its bytes, and the 14 blocks whose positions cancel out under exclusive or hold every choice of three positions exactly once, so any five
equal positions contain one block. Within a posting list the equal positional bytes of each pair are tallied over all eight positions; pairs
below the minimum (those that share the block and nothing else) fall out, pairs met before under an earlier block are skipped, and the rest
are verified by their number of differing bits.

A posting list of over `PAIR_LIMIT` members is never held or paired: it goes on under one more positional byte, for each of the four that are
left, as a pair that reaches the minimum shares one of them. These lists fix 40 of 64 bits, so they have at most 2**24 distinct members whatever
the input; the long ones among them are linked by looking up the 2,324 neighbours within three bits in a table of the free 24 bits instead of by
pairs (some 500 MB if all 2**24 were there). Each list gives one link per member, to the smallest member it reaches, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import give_back, id_or_none, materialize, none_again, text_or_empty
from tensorloom.llm.connected import connected_components

SEED = 42
MAX_BITS = 3
SHARED_BYTES = 8 - MAX_BITS
BLOCKS = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
PAIR_LIMIT = 512
BATCH_ROWS = 200_000


def fingerprint(text: str | None, ngram: int = 3) -> int:
    """The SimHash of a text as an unsigned integer: words between ASCII white space, A-Z lowered, `ngram`-word shingles with
    repeats, XXH64 with seed 42, a bit set when it is set in over half of the hashes. Without words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < ngram else map(b" ".join, zip(*(words[i:] for i in range(ngram)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 65536):
        part = hashes[start : start + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3) -> DataFrame:
    """(id, fp): one row per input row, fp the fingerprint as a signed long."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t, ngram) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"id": pdf["id"], "fp": fp})
        give_back()

    rows = docs.select(id_or_none(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(score, "id long, fp long").withColumn("id", none_again("id"))


def _slot(number: Column, places: tuple[int, ...]) -> Column:
    """A posting: the number of the places and the bytes of fp at them, in one long."""
    for place in places:
        number = F.shiftleft(number, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * place).bitwiseAND(F.lit(255)))
    return number


def _postings(fps: DataFrame) -> DataFrame:
    """(slot, fp): each fingerprint under every block."""
    return fps.select(F.explode(F.array(*(_slot(F.lit(n).cast("long"), b) for n, b in enumerate(BLOCKS)))).alias("slot"), "fp")


def _longer_postings(crowded: DataFrame) -> DataFrame:
    """(slot, fp) for crowded(fp, block): each fingerprint under its block and one more place. The number of a slot is 8 * block + place."""
    entries = F.array()
    for n, block in enumerate(BLOCKS):
        own = [_slot(F.lit(8 * n + p).cast("long"), (*block, p)) for p in range(8) if p not in block]
        entries = F.when(F.col("block") == n, F.array(*own)).otherwise(entries.cast("array<bigint>"))
    return crowded.select(F.explode(entries).alias("slot"), "fp")


def _near_masks(width: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for n in range(1, MAX_BITS + 1) for c in combinations(range(width), n)], dtype=np.int64)


def _settle(labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest label reached through the pairs of positions; labels start as 0..n-1."""
    if not pairs:
        return labels
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    while True:
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        labels = labels[labels]
        if np.array_equal(labels, before):
            return labels


def _link_large(fp: np.ndarray, number: int) -> np.ndarray:
    """Labels within one long list of five places: the 24 free bits of each member address a table, and every value within three bits of
    a member is looked up there."""
    fixed = (*BLOCKS[number >> 3], number & 7)
    free = [p for p in range(8) if p not in fixed]
    value = np.zeros(len(fp), dtype=np.int64)
    for place in free:
        value = (value << 8) | ((fp >> np.uint64(8 * place)) & np.uint64(255)).astype(np.int64)
    where = np.full(1 << (8 * len(free)), -1, dtype=np.int32)
    where[value] = np.arange(len(fp), dtype=np.int32)
    labels, masks = np.arange(len(fp)), _near_masks(8 * len(free))
    while True:
        before = labels.copy()
        for mask in masks:
            other = where[value ^ mask]
            hit = np.flatnonzero(other >= 0)
            if len(hit):
                labels[hit] = np.minimum(labels[hit], labels[other[hit]])
        labels = labels[labels]
        if np.array_equal(labels, before):
            return labels


def _equal_places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The places at which two fingerprints have the same byte, as eight bits."""
    return ((a ^ b).view(np.uint8).reshape(-1, 8) == 0) @ (1 << np.arange(8))


def _first_blocks() -> np.ndarray:
    """The earliest block within each set of equal places, or -1."""
    sets = [sum(1 << p for p in b) for b in BLOCKS]
    return np.array([next((n for n, b in enumerate(sets) if b & same == b), -1) for same in range(256)])


def reaching_pairs(slot: np.ndarray, fp: np.ndarray, blocks: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions of one list whose tally of equal positional bytes reaches the minimum, from rows sorted by slot: compares each row with the
    d-th after it while any list is that long. In lists of blocks a pair counts only under its first block."""
    first, at, distance = _first_blocks(), np.arange(len(slot)), 1
    while len(at := at[at + distance < len(slot)]) and len(at := at[slot[at] == slot[at + distance]]):
        equal = _equal_places(fp[at], fp[at + distance])
        keep = np.bitwise_count(equal.astype(np.uint8)) >= SHARED_BYTES
        if blocks:
            keep &= first[equal] == (slot[at] >> 32)
        if keep.any():
            yield at[keep], at[keep] + distance
        distance += 1


def _link_small(slot: np.ndarray, fp: np.ndarray, blocks: bool) -> np.ndarray:
    """Labels for many short lists at once: pairs that pass the count filter, verified by their differing bits."""
    pairs = []
    for a, b in reaching_pairs(slot, fp, blocks):
        near = np.bitwise_count(fp[a] ^ fp[b]) <= MAX_BITS
        pairs.append((a[near], b[near]))
    return _settle(np.arange(len(slot)), pairs)


def _linked(slot: np.ndarray, fp: np.ndarray, blocks: bool) -> pd.DataFrame:
    """Links (kind 0) of whole lists sorted by slot; lists of blocks that are too long go on as (fp, block) of kind 1."""
    starts = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(slot) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(slot)))
    labels = np.arange(len(slot))
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= PAIR_LIMIT), sizes))
    if len(at):
        labels[at] = at[_link_small(slot[at], fp[at], blocks)]
    long = np.flatnonzero(np.repeat(sizes > PAIR_LIMIT, sizes)) if blocks else np.empty(0, np.int64)
    if not blocks:
        for s, n in zip(starts[sizes > PAIR_LIMIT], sizes[sizes > PAIR_LIMIT], strict=True):
            labels[s : s + n] = s + _link_large(fp[s : s + n], int(slot[s] >> 40))
    moved = np.flatnonzero(labels != np.arange(len(slot)))
    return pd.DataFrame(
        {
            "kind": np.repeat(np.array([0, 1], np.int8), [len(moved), len(long)]),
            "a": np.concatenate((fp[moved], fp[long])).view(np.int64),
            "b": np.concatenate((fp[labels[moved]].view(np.int64), slot[long] >> 32)),
        }
    )


def _link_lists(batches: Iterator[pd.DataFrame], blocks: bool) -> Iterator[pd.DataFrame]:
    """Reads postings sorted by slot and fp, and links whole lists once BATCH_ROWS rows are held. Of a list of blocks no more than that is held: the
    rest of it goes on as it comes."""
    slots, fps, held = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    over = None  # the slot of a list that is going on
    for pdf in batches:
        slot, fp = pdf["slot"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64).view(np.uint64)
        if over is not None:
            cut = int(np.searchsorted(slot, over, "right"))
            yield pd.DataFrame({"kind": np.int8(1), "a": fp[:cut].view(np.int64), "b": np.full(cut, over >> 32)})
            slot, fp = slot[cut:], fp[cut:]
        slots.append(slot)
        fps.append(fp)
        held += len(slot)
        if held < BATCH_ROWS:
            continue
        slot, fp = np.concatenate(slots), np.concatenate(fps)
        cut = int(np.searchsorted(slot, slot[-1], "left"))
        if cut or blocks:
            over = int(slot[-1]) if blocks and len(slot) - cut > PAIR_LIMIT else None
            cut = len(slot) if over is not None else cut
            yield _linked(slot[:cut], fp[:cut], blocks)
        slots, fps, held = [slot[cut:]], [fp[cut:]], len(slot) - cut
    yield _linked(np.concatenate(slots), np.concatenate(fps), blocks)
    give_back()


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links that join all of fps(fp), distinct fingerprints, which differ in MAX_BITS bits or fewer, and no others."""
    schema, n = "kind byte, a long, b long", int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def through(postings: DataFrame, blocks: bool) -> DataFrame:
        lists = postings.repartition("slot").sortWithinPartitions("slot", "fp")
        return lists.mapInPandas(lambda batches: _link_lists(batches, blocks), schema)

    # a number of partitions keeps the few bytes of fps from being laid out 14-fold in one task
    found = materialize(through(_postings(fps.repartition(n, "fp")), True), "pairs")
    crowded = found.where("kind = 1").select(F.col("a").alias("fp"), F.col("b").alias("block"))
    return found.unionByName(through(_longer_postings(crowded), False)).where("kind = 0").select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3) -> DataFrame:
    """One row per row of `docs`: (doc_id, fingerprint, component_id).

    fingerprint is 16 lowercase hex digits; component_id the smallest id reachable over links of three or fewer differing bits,
    itself included. Null and empty texts, and texts without words, have fingerprint zero and link like any other. Equal
    fingerprints are one node of the index however often they occur; repeated rows come back as often as they came; rows with a null
    id keep the null and don't name a component unless no other member has an id. Columns besides the two named are ignored.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, ngram), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("id").alias("low"))
    parts = connected_components(links(nodes.select("fp")), "a", "b")
    labelled = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("part"))
    lowest = labelled.groupBy("part").agg(F.min("low").alias("component_id"))
    named = labelled.join(lowest, "part").select("fp", "component_id")
    return fps.join(named, "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
