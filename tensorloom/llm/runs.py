"""Runs of repeated words: stretches whose words come back at a fixed distance, found with an enhanced suffix array.

Texts are laid end to end in blocks, every text with words and an end mark of its own, so no repeat crosses texts. For a block: the suffix array by
prefix doubling over the groups still open, the common prefixes of neighbours from the ranks of each doubling, and one pass with a stack for the bounds of
every interval of suffixes that share `depth` words; no tree is built. A square (a word sequence twice in a row) that the next word does not continue
consists of two suffixes of one interval, `depth` apart, in different children of it. So for all children but the largest each suffix i asks whether the
ranks of i + depth and i - depth lie in the interval and outside its child: at most n log n questions, put by array. Each such square is then rotated
leftwards as far as it goes, which gives the run it ends; squares whose run is known under a divisor of their depth are the same run and merged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import give_back, id_or_none, none_again, text_or_empty

#: words of a block; a longer text is a block of its own
BLOCK_WORDS = 200_000
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def suffix_ranks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, ranks, common prefix with the suffix before) of word numbers whose last one is found nowhere else."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    first = np.ones(n, bool)
    first[1:] = ids[order][1:] != ids[order][:-1]
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int32)
    rank[order] = starts
    levels, width = [], 1
    while not first.all():
        levels.append(rank.copy())
        last = np.append(first[1:], True)
        at = np.flatnonzero(~(first & last))
        own, key = rank[order[at]].astype(np.int64), rank[order[at] + width]
        moved = np.lexsort((key, own))
        order[at], key, own = order[at][moved], key[moved], own[moved]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
        first[at] = fresh
        rank[order[at]] = np.maximum.accumulate(np.where(fresh, at, 0))
        width *= 2
    common = np.zeros(n, np.int32)
    for k in range(len(levels) - 1, -1, -1):
        a, b = order[:-1] + common[1:], order[1:] + common[1:]
        inside = np.flatnonzero(np.maximum(a, b) < n)
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        common[same + 1] += 1 << k
    return order, rank, common


def intervals(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, interval of each place, and per interval its left end, right end and depth). A place is a boundary between two neighbouring suffixes with a
    common prefix; it belongs to the widest interval around it in which no boundary is lower than its own."""
    owner = np.full(len(common), -1, np.int64)
    left, right, depth = [], [], []
    stack: list[tuple[int, int]] = []  # (depth, interval) of those still open
    for k, height in enumerate(common.tolist()):
        if not height and not stack:
            continue
        begins = k - 1
        while stack and stack[-1][0] > height:
            closed = stack.pop()[1]
            right[closed] = k - 1
            begins = left[closed]
        if height:
            if not stack or stack[-1][0] < height:
                stack.append((height, len(left)))
                left.append(begins)
                right.append(-1)
                depth.append(height)
            owner[k] = stack[-1][1]
    for _, still in stack:
        right[still] = len(common) - 1
    places = np.flatnonzero(owner >= 0)
    return places, owner[places], np.array(left, np.int64), np.array(right, np.int64), np.array(depth, np.int64)


def branching_squares(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every square in `ids` that the word behind it does not continue, by period; some twice."""
    order, rank, common = suffix_ranks(ids)
    places, owner, left, right, depth = intervals(common)
    if not len(places):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # the children of an interval begin at its left end and at its places
    child_of = np.concatenate([np.arange(len(left)), owner])
    begin = np.concatenate([left, places])
    by = np.lexsort((begin, child_of))
    child_of, begin = child_of[by], begin[by]
    end = np.empty_like(begin)
    end[:-1] = begin[1:]
    closes = np.append(child_of[1:] != child_of[:-1], True)
    end[closes] = right[child_of[closes]] + 1
    size = end - begin
    # one largest child of each interval asks nothing: its partners in smaller children do
    by_size = np.lexsort((-size, child_of))
    largest = by_size[np.append(True, child_of[by_size][1:] != child_of[by_size][:-1])]
    small = np.ones(len(size), bool)
    small[largest] = False
    kept = np.flatnonzero(small)
    child = np.repeat(kept, size[kept])
    place = np.arange(len(child)) - np.repeat(np.cumsum(size[kept]) - size[kept], size[kept]) + begin[child]
    i, q = order[place].astype(np.int64), depth[child_of[child]]
    found = []
    for other, start in ((i + q, i), (i - q, i - q)):
        valid = (other >= 0) & (other < len(ids))
        r = rank[np.where(valid, other, 0)]
        good = valid & (r >= left[child_of[child]]) & (r <= right[child_of[child]]) & ((r < begin[child]) | (r >= end[child]))
        found.append((start[good], q[good]))
    start, period = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    by = np.lexsort((start, period))
    return start[by], period[by]


def _reach(ids: np.ndarray, start: int, period: int) -> int:
    """How far left a stretch with this period that covers `start` goes: words are compared in steps that double."""
    step = 16
    while start > 0:
        low = max(0, start - step)
        differ = np.flatnonzero(ids[low:start] != ids[low + period : start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, step * 2
    return 0


def runs_of(ids: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least max(least, 2 * period) words, by start and period."""
    ends: dict[int, list[tuple[int, int]]] = {}
    for start, period in zip(*(x.tolist() for x in branching_squares(ids)), strict=True):
        known = ends.setdefault(start + 2 * period, [])
        if not any(low <= start and period % p == 0 for low, p in known):
            known.append((_reach(ids, start, period), period))
    return sorted((low, end - low, p) for end, known in ends.items() for low, p in known if end - low >= least)


def find_in_texts(texts: list[str], least: int) -> list[tuple[list[tuple[int, int, int]], str, int]]:
    """(runs, collapsed text, number of words) of each text: words are numbered anew in each text, and an end mark behind it is found nowhere else."""
    out: list[tuple[list[tuple[int, int, int]], str, int]] = []
    words_of, blocks, n = [], [], 0

    def flush() -> None:
        nonlocal n
        if n:
            ids = np.concatenate([b for _, b in blocks])
            offsets = np.cumsum([0, *(len(b) for _, b in blocks)])
            found = runs_of(ids, least)
            where = np.searchsorted(offsets, [s for s, _, _ in found], side="right") - 1
            per: dict[int, list] = {}
            for k, (start, length, period) in zip(where.tolist(), found, strict=True):
                per.setdefault(k, []).append((start - int(offsets[k]), length, period))
        for k, words in enumerate(words_of):
            runs = per.get(k, []) if n else []
            gone = np.zeros(len(words) + 1, np.int64)
            for start, length, period in runs:
                gone[start + period] += 1
                gone[start + length] -= 1
            kept = words if not runs else [w for w, g in zip(words, np.cumsum(gone)[:-1].tolist(), strict=True) if not g]
            out.append((runs, b" ".join(kept).decode("utf-8", "surrogatepass"), len(words)))
        words_of.clear()
        blocks.clear()
        n = 0

    high = 0
    for text in texts:
        # bytes.split takes exactly the ASCII white space that parts words here
        words = text.encode("utf-8", "surrogatepass").split()
        numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
        ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        if n and n + len(words) > BLOCK_WORDS:
            flush()
            high = 0
        words_of.append(words)
        blocks.append((len(words_of), np.append(ids + high, high + len(numbers))))
        high += len(numbers) + 1
        n += len(words) + 1
    flush()
    return out


def find_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: int = 12) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of each text as structs (start, length, period) by start and period, words numbered from 0, and the text
    with every run cut down to its first period, words joined by one space.

    A run is a stretch of words with smallest period q, at least max(least, 2 q) long, that no neighbouring word extends. Words are parted by ASCII white
    space. Map-only: a text meets no other. Null, empty and blank texts have no runs; null ids and repeated rows stay, each with its own result; further
    columns are ignored, whatever their names; no rows give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo : lo + 512]
                found = find_in_texts(part["text"].tolist(), least)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].to_numpy(), "n_words": [n for _, _, n in found],
                        "runs": [[{"start": s, "length": m, "period": p} for s, m, p in runs] for runs, _, _ in found], "collapsed": [c for _, c, _ in found],
                    }
                )
        give_back()

    rows = docs.select(id_or_none(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string").withColumn("doc_id", none_again())


def with_planted_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h the CRC-32 of the decimal id and g = h // 10, texts with h % 10 = 0 get a periodic end: from word a = g % n on, word i becomes word
    a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8). Other texts, and rows without an id, stay as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for i, text in zip(pdf["key"], pdf["text"], strict=True):
                h = zlib.crc32(i.encode()) if i else 1
                words = text.encode("utf-8", "surrogatepass").split() if h % 10 == 0 else []
                if words:
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    text = b" ".join(words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]).decode("utf-8", "surrogatepass")
                texts.append(text)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts})
        give_back()

    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    rows = docs.select(id_or_none().alias("doc_id"), text_or_empty().alias("text"), key.alias("key"))
    return rows.mapInPandas(run, "doc_id long, text string").withColumn("doc_id", none_again())


def run_digests(found: DataFrame) -> DataFrame:
    """What find_runs returns as numbers and digests: the longest run (then smallest start, then period), all runs as lines, and the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    length, period = F.col("_best.length"), -F.col("_best.p")

    def hexed(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.s")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * _best.length div (-_best.p)").alias("exponent_milli"), hexed(lines).alias("runs_sha256"), hexed(F.col("collapsed")).alias("collapsed_sha256"),
    )
