"""Packing documents into fixed token windows by Karmarkar-Karp multiway differencing.

Each task tokenizes the documents of its split and packs them as they pass, in chunks of `CHUNK_WINDOWS` windows: no shuffle,
and memory bounded by the chunk. Full windows are cut off a document first; what is left is cut into pieces of at most
`ITEM` tokens. Differencing starts with one partial partition per piece, always merges the two with the largest spread,
laying the fullest windows of one on the emptiest of the other, and so ends with near-equal windows. When one still
exceeds the capacity, the number of windows rises and the chunk is packed again.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import give_back, text_or_empty
from tensorloom.llm.word_ids import WordTokenizer

WINDOW = 2048
ITEM = 256
CHUNK_WINDOWS = 256
SLICE_BYTES = 1_000_000
TRIM_BYTES = 8_000_000
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp multiway differencing: indexes of `sizes` in `ways` groups of near-equal sums.

    A partial partition is (sums above its smallest, their members), largest first and as long as its non-zero sums; members
    are nested pairs, unfolded at the end.
    """
    if ways == 1:
        return [list(range(len(sizes)))]
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(b) > len(a):
            a, b = b, a
        room = ways - len(a)
        # the largest of b meet the empty windows of a, then the emptiest of those in use
        merged = a + b[:room] if room else a
        if len(b) > room:
            merged = a + b[:room]
            rest = b[room:]
            for k, (size, members) in enumerate(rest):
                at = len(a) - 1 - k
                merged[at] = (merged[at][0] + size, (merged[at][1], members))
        merged = sorted(merged, key=lambda x: -x[0])
        if len(merged) == ways:
            low = merged[-1][0]
            merged = [(size - low, members) for size, members in merged]
        spread = merged[0][0] - (merged[-1][0] if len(merged) == ways else 0)
        heapq.heappush(heap, (-spread, serial, merged))
        serial += 1
    groups = []
    for _, members in heap[0][2] if heap else []:
        flat, stack = [], [members]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            else:
                flat.append(x)
        groups.append(sorted(flat))
    return groups


def pack_sizes(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Groups of indexes, none over the capacity: as few windows as hold the sum, one more whenever differencing exceeds the capacity."""
    if not sizes:
        return []
    if max(sizes) > capacity:
        raise ValueError("a piece exceeds the capacity")
    ways = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        groups = difference(sizes, ways)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return groups
        ways += 1


def _pieces(n: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document of n ids: whole windows, then pieces of at most ITEM."""
    start = 0
    while n - start >= WINDOW:
        yield start, WINDOW
        start += WINDOW
    while start < n:
        yield start, min(ITEM, n - start)
        start += ITEM


def _by_bytes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about SLICE_BYTES of text; a longer text is a slice of its own."""
    upto = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SLICE_BYTES, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, with the CRC-32 of its ids.

    Null and empty texts are one piece, the end id alone. Repeated rows are packed as often as they come; a null id stays null.
    Sequence ids are unique: the task's number and a count within it. Extra columns are ignored; an empty table gives no rows.
    """
    path = tokenizer or tokenizer_path()
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer.load(path)
        sequence = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        items: list[tuple] = []
        held = passed = 0
        end = np.array([END_ID], dtype="<u4")

        def close() -> None:
            nonlocal sequence, held
            for group in pack_sizes([x[2] for x in items]):
                offset = 0
                for i in group:
                    rows.append((*items[i], sequence, offset))
                    offset += items[i][2]
                sequence += 1
            items.clear()
            held = 0

        def take() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)
            rows.clear()
            return out

        for batch in batches:
            for part in _by_bytes(batch):
                ids, cuts = words.encode(part.column("text"))
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    own = np.concatenate((ids[a:b], end))
                    for start, length in _pieces(len(own)):
                        piece = (doc_id, start, length, zlib.crc32(own[start : start + length]), len(own))
                        if length == WINDOW:
                            rows.append((*piece, sequence, 0))
                            sequence += 1
                        else:
                            items.append(piece)
                            held += length
                    if held >= CHUNK_WINDOWS * WINDOW:
                        close()
                if len(rows) >= 20_000:
                    yield take()
            # what slices have freed goes back while the task runs, not only at its end
            passed += batch.nbytes
            if passed >= TRIM_BYTES:
                give_back()
                passed = 0
        close()
        if rows:
            yield take()
        give_back()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(pack, SCHEMA)
