"""Exact repeated-passage removal by bucket-pointer refinement over suffixes, to a depth of one passage.

A byte goes when a string of `LENGTH` bytes that covers it also starts anywhere else, in the same text or another.
Suffixes of the corpus only need to be told apart by their first LENGTH bytes, so suffix order is refined to that depth:

1. Initial buckets. Each LENGTH-byte window is put in the bucket of one q-gram it contains, its leftmost smallest by hash (q = 64).
   Equal windows pick the same q-gram, and neighbouring windows mostly share theirs, so a text of n bytes gives about n / 69 bucket
   entries, each for a run of window starts. Buckets with one entry hold no repeat and leave here.
2. Entries of a bucket whose whole runs of text agree are one class: all their windows repeat. Classes are aggregates with
   map-side combine, so copies never meet in one task. Runs repeated inside one batch of texts are settled before any shuffle.
3. Refinement. One entry of each remaining class carries its text into a task of its bucket. There the bucket numbers of the window
   starts are refined by sorting on the pair (own bucket, bucket q bytes later), then again on the refined numbers of later offsets,
   until they stand for LENGTH bytes; only buckets with two or more members stay in the sort. Buckets with more than `HOT_CLASSES`
   classes are refined through a shuffle on the same pair of bucket numbers, at the start and at a later offset, instead of inside one task.

Texts are told apart by (id, 64-bit hash of the text); a text without an id has a second hash in the place of the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tensorloom.llm.common import give_back, materialize, text_or_empty

LENGTH = 200
Q = 64
BLOCK = 1 << 19
HOT_CLASSES = 4_000
BATCH_BYTES = 1_500_000
_BYTE = np.random.default_rng(20250101).integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP2 = 0xD6E8FEB86659FD93


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def qgram_buckets(data: np.ndarray, q: int = Q, step: int = int(_STEP)) -> np.ndarray:
    """The bucket number of the q-gram (q a power of two) at each position, by doubling: the number for 2d bytes comes from the numbers
    for d bytes at the position and d later."""
    h, n = _BYTE[data], 1
    while n < q:
        h = h[:-n] * np.uint64(step) + h[n:]
        step, n = step * step % (1 << 64), 2 * n
    return _mix(h)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x, n = np.minimum(x[:-n], x[n:]), 2 * n
    rest = width - n
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def bucket_entries(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, first window start, number of starts) of each run of windows of one text."""
    raw = np.frombuffer(data, dtype=np.uint8)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for base in range(0, max(0, len(raw) - LENGTH + 1), BLOCK):
        block = raw[base : base + BLOCK + LENGTH - 1]
        h = qgram_buckets(block)
        place = np.arange(len(h), dtype=np.uint64)
        chosen = _sliding_min((h & ~np.uint64((1 << 20) - 1)) | place, LENGTH - Q + 1) & np.uint64((1 << 20) - 1)
        first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        count = np.diff(np.append(first, len(chosen)))
        out.append((h[chosen[first]], first + base, count))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _run_hash(data: bytes, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hash of the text each run of windows covers (count + LENGTH - 1 bytes), from overlapping LENGTH-byte hashes."""
    raw = np.frombuffer(data, dtype=np.uint8)
    a = qgram_buckets(raw, 128, _STEP2)
    span = count + LENGTH - 1  # 200 to 336 bytes: covered by hashes at 0, 72, the end less 128 and the middle
    total = count.astype(np.uint64)
    for at in (first, first + LENGTH - 128, first + (span - 128) // 2, first + span - 128):
        total = _mix(total * _STEP + a[at])
    return total


def refine(data: np.ndarray, starts: np.ndarray, depth_ok: np.ndarray) -> np.ndarray:
    """Which of the window `starts` in `data` have a LENGTH-byte string that another start has too.

    depth_ok marks the positions whose next 128 bytes lie in one text. Two refinements: Q + Q bytes, then 128 + 72 bytes reusing the
    numbers of the first.
    """
    if not len(starts):
        return np.zeros(0, dtype=bool)
    bucket = qgram_buckets(data)
    second = np.zeros(len(data), dtype=np.int64)  # number for 128 bytes; 0 stands for a bucket of one
    at = np.flatnonzero(depth_ok)
    key = _mix(bucket[at] * _STEP + bucket[at + Q])
    second[at] = _numbers(key)
    live = np.flatnonzero((second[starts] > 0) & (second[starts + LENGTH - 128] > 0))
    found = np.zeros(len(starts), dtype=bool)
    if len(live):
        s = starts[live]
        pair = second[s] * np.int64(len(data) + 1) + second[s + LENGTH - 128]
        found[live] = _numbers(pair) > 0
    return found


def _numbers(keys: np.ndarray) -> np.ndarray:
    """Bucket numbers from 1 in key order; 0 for keys that occur once."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    number = np.cumsum(new)
    alone = new & np.concatenate((new[1:], [True]))
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.where(alone, 0, number)
    return out


def _intervals(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, count) of each run of consecutive numbers."""
    if len(starts):
        cut = np.flatnonzero(np.diff(starts) > 1) + 1
        for part in np.split(starts, cut):
            yield int(part[0]), len(part)


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bucket entries of each text. kind 0: an entry (settled 1 if its run is known to repeat); kind 1: a settled run."""
    for pdf in batches:
        for lo in range(0, len(pdf), 512):
            part = pdf.iloc[lo : lo + 512]
            rows: list[tuple[np.ndarray, ...]] = []
            for i, text in enumerate(part["text"]):
                data = text.encode("utf-8", "surrogatepass")
                bucket, first, count = bucket_entries(data)
                if len(bucket):
                    rows.append((bucket, _run_hash(data, first, count), np.full(len(bucket), i), first, count))
            if not rows:
                continue
            bucket, cover, row, first, count = (np.concatenate(x) for x in zip(*rows, strict=True))
            both = _mix(bucket * _STEP + cover)
            order = np.argsort(both, kind="stable")
            new = np.concatenate(([True], both[order][1:] != both[order][:-1]))
            alone = new & np.concatenate((new[1:], [True]))
            kept, repeats = np.sort(order[new]), np.sort(order[~alone])
            settled = np.zeros(len(both), dtype=np.int8)
            settled[repeats] = 1
            ids, marks = part["doc_id"].to_numpy(), part["mark"].to_numpy()
            for kind, at in ((0, kept), (1, repeats)):
                if len(at):
                    yield pd.DataFrame(
                        {
                            "kind": np.int8(kind), "bucket": bucket[at].view(np.int64), "cover": cover[at].view(np.int64),
                            "doc_id": ids[row[at]], "mark": marks[row[at]],
                            "run": (first[at] << 20) | count[at], "settled": settled[at],
                        }
                    )
    give_back()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, to move less when they are joined; the other columns pass by."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        body = pa.array([squeeze(t.as_py().encode("utf-8", "surrogatepass")) for t in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), batch.column("rest"), body], ["doc_id", "mark", "rest", "body"])
    give_back()


def _unpack(body: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 31) if body else b""


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The text of each wanted run; wanted holds (bucket, run, 2 * hot + settled) one after the other."""
    for pdf in batches:
        for lo in range(0, len(pdf), 256):
            part = pdf.iloc[lo : lo + 256]
            wanted = [np.asarray(w, dtype=np.int64).reshape(-1, 3) for w in part["wanted"]]
            texts = []
            for body, w in zip(part["body"], wanted, strict=True):
                data = _unpack(body)
                for run in w[:, 1].tolist():
                    texts.append(data[run >> 20 : (run >> 20) + (run & 0xFFFFF) + LENGTH - 1])
            sizes, rows = [len(w) for w in wanted], np.concatenate(wanted)
            yield pd.DataFrame(
                {
                    "bucket": rows[:, 0], "hot": rows[:, 2] >= 2, "run": rows[:, 1], "settled": (rows[:, 2] & 1).astype(np.int8), "body": texts,
                    "doc_id": np.repeat(part["doc_id"].to_numpy(), sizes), "mark": np.repeat(part["mark"].to_numpy(), sizes),
                }
            )
    give_back()


def _refine_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads entries sorted by bucket; whole buckets are refined together once BATCH_BYTES of text are held."""
    held: list[pd.DataFrame] = []
    size = 0

    def flush(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["body"].str.len().to_numpy()
        begin = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        data = np.frombuffer(b"".join(pdf["body"]), dtype=np.uint8)
        counts = lengths - LENGTH + 1
        entry = np.repeat(np.arange(len(pdf)), counts)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        deep = np.zeros(len(data), dtype=np.int64)  # positions with 128 bytes left in their text
        deep[begin] += 1
        np.subtract.at(deep, begin + lengths - 127, 1)
        found = refine(data, begin[entry] + within, np.cumsum(deep) > 0)
        rows = []
        ids, marks, runs, settled = (pdf[c].to_numpy() for c in ("doc_id", "mark", "run", "settled"))
        hit = np.flatnonzero(found & (settled[entry] == 0))
        if len(hit):
            edge = np.flatnonzero((np.diff(entry[hit]) != 0) | (np.diff(within[hit]) != 1)) + 1
            for group in np.split(hit, edge):
                e = entry[group[0]]
                rows.append((ids[e], marks[e], (((int(runs[e]) >> 20) + int(within[group[0]])) << 20) | len(group)))
        out = pd.DataFrame(rows, columns=["doc_id", "mark", "run"])
        return out.astype({"doc_id": "int64", "mark": "int64", "run": "int64"})

    for pdf in batches:
        held.append(pdf)
        size += int(pdf["body"].str.len().sum())
        if size >= BATCH_BYTES:
            whole = pd.concat(held, ignore_index=True)
            last = whole["bucket"] == whole["bucket"].iloc[-1]
            if not last.all():
                yield flush(whole[~last].reset_index(drop=True))
                whole = whole[last]
            held, size = [whole], int(whole["body"].str.len().sum())
    if held:
        yield flush(pd.concat(held, ignore_index=True))
    give_back()


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every window of the entries of a hot bucket as the pair its refinement sorts on: the numbers of its first and of its last 128 bytes."""
    for pdf in batches:
        for lo in range(0, len(pdf), 512):
            part = pdf.iloc[lo : lo + 512]
            counts = part["run"].to_numpy() & 0xFFFFF
            numbers = [qgram_buckets(np.frombuffer(body, dtype=np.uint8), 128) for body in part["body"]]
            own = lambda c: np.repeat(part[c].to_numpy(), counts)  # noqa: B023, E731
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pd.DataFrame(
                {
                    "head": np.concatenate([x[:n] for x, n in zip(numbers, counts, strict=True)]).view(np.int64),
                    "tail": np.concatenate([x[LENGTH - 128 : LENGTH - 128 + n] for x, n in zip(numbers, counts, strict=True)]).view(np.int64),
                    "doc_id": own("doc_id"), "mark": own("mark"), "run": (((own("run") >> 20) + within) << 20) | 1, "settled": own("settled"),
                }
            )
    give_back()


def repeated_runs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, runs) for docs(doc_id, mark, rest, text): the compressed texts, and per text the array of runs of repeated window starts
    (first start * 2**20 + number of starts)."""
    bodies = docs.mapInArrow(_pack, StructType([*docs.select("doc_id", "mark", "rest").schema.fields, StructField("body", BinaryType())]))
    found = materialize(
        docs.drop("rest").mapInPandas(_entries, "kind byte, bucket long, cover long, doc_id long, mark long, run long, settled byte"), "entries"
    )
    place = F.struct("settled", "doc_id", "mark", "run")
    entries = found.where("kind = 0").drop("kind")
    crowded = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    left = materialize(entries.join(crowded, "bucket"), "crowded")
    classes = materialize(left.groupBy("bucket", "cover").agg(F.count("*").alias("n"), F.max(place).alias("one")), "classes")
    copies = left.join(classes.where("n > 1").select("bucket", "cover"), ["bucket", "cover"])
    mixed = (
        classes.groupBy("bucket")
        .agg(F.count("*").alias("k"), F.max((F.col("n") == 1) & (F.col("one.settled") == 0)).alias("open"))
        .where("k > 1 and open")
        .select("bucket", (F.col("k") > HOT_CLASSES).alias("hot"))
    )
    doubtful = classes.join(mixed, "bucket").select(
        "bucket", "hot", "one.doc_id", "one.mark", "one.run", F.when(F.col("n") > 1, 1).otherwise(F.col("one.settled")).cast("byte").alias("settled")
    )
    ask = F.array("bucket", "run", (F.col("hot").cast("long") * 2 + F.col("settled")))
    wanted = doubtful.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list(ask)).alias("wanted"))
    asked = bodies.drop("rest").join(wanted, ["doc_id", "mark"])
    contexts = materialize(
        asked.mapInPandas(_contexts, "bucket long, hot boolean, run long, settled byte, body binary, doc_id long, mark long"), "contexts"
    )
    cold = contexts.where("not hot").drop("hot").repartition("bucket").sortWithinPartitions("bucket")
    refined = cold.mapInPandas(_refine_buckets, "doc_id long, mark long, run long")
    windows = contexts.where("hot").mapInPandas(_windows, "head long, tail long, doc_id long, mark long, run long, settled byte")
    shared = windows.groupBy("head", "tail").agg(F.count("*").alias("n")).where("n > 1").select("head", "tail")
    hot = windows.join(shared, ["head", "tail"]).where("settled = 0").select("doc_id", "mark", "run")
    settled = found.where("kind = 1").select("doc_id", "mark", "run").unionByName(copies.select("doc_id", "mark", "run"))
    runs = settled.unionByName(refined).unionByName(hot).groupBy("doc_id", "mark").agg(F.collect_list("run").alias("runs"))
    return bodies, runs


def _keep(data: bytes, runs) -> tuple[bytes, int]:
    """(what is left, number of removed runs of bytes)."""
    if runs is None or not len(runs):
        return data, 0
    edge = np.zeros(len(data) + 1, dtype=np.int64)
    runs = np.asarray(runs, dtype=np.int64)
    first = runs >> 20
    np.add.at(edge, first, 1)
    np.subtract.at(edge, first + (runs & 0xFFFFF) + LENGTH - 1, 1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return np.frombuffer(data, dtype=np.uint8)[~gone].tobytes(), spans


def _cut(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies, runs = batch.column("body"), batch.column("runs")
        for lo in range(0, len(batch), 512):
            rows = []
            for body, found in zip(bodies.slice(lo, 512), runs.slice(lo, 512), strict=True):
                data = _unpack(body.as_py())
                kept, spans = _keep(data, found.as_py())
                rows.append((len(data), len(data) - len(kept), spans, kept.decode("utf-8", "ignore") if as_text else kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary())
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rest").slice(lo, 512), *columns], ["rest", "n_bytes", "n_removed", "n_spans", "kept"])
    give_back()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """One row per row of `docs`: (doc_id, n_bytes, n_removed, n_spans, kept, rest) with kept the bytes that are left, as binary or, without the
    bytes of characters that were cut in part, as text, and rest a struct of the columns to `carry` along (null without).

    Null texts count as empty; texts under LENGTH bytes are left whole. Repeated rows are texts like any other, so both lose what they
    share. Rows with a null id keep it, and are told apart by their texts. Columns that aren't carried are ignored, whatever their names; an
    empty table gives no rows.
    """
    text = text_or_empty(text_col)
    known = F.col(id_col).cast("long")
    rest = F.struct(known.alias("id"), (F.struct(*carry) if carry else F.lit(None).cast("boolean")).alias("carried"))
    source = docs.select(F.coalesce(known, F.xxhash64(F.lit(77), text)).alias("doc_id"), F.xxhash64(text).alias("mark"), rest.alias("rest"), text.alias("text"))
    bodies, runs = repeated_runs(source)
    joined = bodies.join(runs, ["doc_id", "mark"], "left")
    counts = [StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    fields = [joined.schema["rest"], *counts, StructField("kept", StringType() if as_text else BinaryType())]
    done = joined.mapInArrow(lambda batches: _cut(batches, as_text), StructType(fields))
    return done.select(F.col("rest.id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", F.col("rest.carried").alias("rest"))


def digest(removed: DataFrame) -> DataFrame:
    """The result of remove_repeats with the SHA-256 of what is left in place of the bytes."""
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with the repeated passages cut out of its texts, and n_chars, if there, counted anew. Bytes of a character that was cut in part go too.
    A null text becomes empty."""
    removed = remove_repeats(docs, carry=[c for c in docs.columns if c != "text"], as_text=True)
    changed = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return removed.select(*((changed[c] if c in changed else F.col("rest")[c]).alias(c) for c in docs.columns))
