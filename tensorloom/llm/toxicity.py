"""Toxicity scores: a bag of subword embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (3 to 5 bytes, with < and > at the ends) and of the word itself, all hashed into
one table, so a misspelling shares most vectors with the word it comes from. A text is the mean of its words and
PAD_WORDS empty ones, which keeps a few words from deciding a short text; one linear softmax layer of two
classes reads it, and table and layer are trained together by Adagrad on the labelled sample. The network is linear in the table, so for
scoring the table and the layer fold into one number per bucket: a text's score is the sigmoid of a bias and the mean of its words' numbers.

Training takes a bounded sample: at most `max_train` labelled texts of at most `max_bytes` together (the smallest by hash of their id, all of them when
fewer), whole texts. Scoring reads every text whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import give_back, id_or_none, materialize, none_again, text_or_empty

BUCKETS = 1 << 18
DIM = 12
SIZES = (3, 4, 5)
STEPS = 64_000
MAX_TRAIN = 8_000
MAX_BYTES = 64_000_000
PAD_WORDS = 10
THRESHOLD = 0.7
_LETTER = np.random.default_rng(77).integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PUNCTUATION = bytes(c if chr(c).isalnum() or c >= 128 or c == 39 else 32 for c in range(256))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) & np.uint64(BUCKETS - 1)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket, weight, words) of a text: its subwords' buckets, each weighing one over the subwords of its word.

    Words are runs of letters, digits and apostrophes in lower case. They are laid out as "<word>" one after the other, and n-grams that
    cross a word's end are left out.
    """
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_PUNCTUATION).split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32), 0
    raw = np.frombuffer(b"<" + b"><".join(words) + b">", dtype=np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(raw))  # bytes from here to the end of the word
    letters = _LETTER[raw]
    hashes, owner = [], []
    h = letters
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * _STEP + letters[n - 1 :] if len(h) > 1 else h[:0]
        if n in SIZES and len(h):
            at = np.flatnonzero(left[: len(h)] >= n)
            hashes.append(_mix(h[at] + np.uint64(n)))
            owner.append(word[at])
    weights = _STEP ** (left.astype(np.uint64))
    with np.errstate(over="ignore"):
        whole = np.add.reduceat(letters * weights, ends - sizes)
    hashes.append(_mix(whole))
    owner.append(np.arange(len(words)))
    bucket, own = np.concatenate(hashes).astype(np.int64), np.concatenate(owner)
    parts = np.bincount(own, minlength=len(words))
    return bucket, (1.0 / parts[own]).astype(np.float32), len(words)


def fold(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """The features of a text in four bytes each: gaps between its sorted buckets, weights summed by bucket as half floats, and its words. A gap beyond two
    bytes is made in several steps of weight zero."""
    bucket, weight, words = features(text)
    ids, at = np.unique(bucket, return_inverse=True)
    weights = np.bincount(at, weight) if len(ids) else np.empty(0)
    gaps = np.diff(ids, prepend=0)
    while len(wide := np.flatnonzero(gaps > 0xFFFF)):
        gaps[wide] -= 0xFFFF
        gaps, weights = np.insert(gaps, wide, 0xFFFF), np.insert(weights, wide, 0.0)
    return gaps.astype(np.uint16), weights.astype(np.float16), words


def unfold(gaps: np.ndarray, weights: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights): each once, for a mean over the words and PAD_WORDS empty ones."""
    return np.cumsum(gaps, dtype=np.int32), weights.astype(np.float32) / np.float32(words + PAD_WORDS)


def train(texts: Iterable[str], labels: list[int], seed: int = 13) -> tuple[np.ndarray, float]:
    """(number per bucket, bias): the trained table and layer, folded. Needs texts of both labels; else the bias alone carries the label share."""
    y = np.asarray(labels, dtype=np.int64)
    share = float(y.mean()) if len(y) else 0.0
    if len(y) == 0 or share in (0.0, 1.0):
        return np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    rng = np.random.default_rng(seed)
    seen = [fold(t) for t in texts]
    give_back()  # what reading the texts took goes before the table comes
    table = np.empty((BUCKETS, DIM), np.float32)
    for lo in range(0, BUCKETS, 4096):
        table[lo : lo + 4096] = (rng.random((min(4096, BUCKETS - lo), DIM)) - 0.5) / DIM
    layer = ((rng.random((DIM, 2)) - 0.5) / DIM).astype(np.float32)
    bias = np.array([math.log(1 - share), math.log(share)], dtype=np.float32)
    table_sq = np.full(BUCKETS, 1e-6, np.float32)
    layer_sq, bias_sq = np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    class_weight = np.array([0.5 / (1 - share), 0.5 / share], dtype=np.float32) ** 0.5
    epochs = min(40, max(8, STEPS // len(y)))
    for epoch in range(epochs):
        rate = 0.5 * (1 - epoch / epochs) + 0.02
        for i in rng.permutation(len(seen)):
            ids, weight = unfold(*seen[i])
            hidden = weight @ table[ids] if len(ids) else np.zeros(DIM, np.float32)
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= class_weight[y[i]]
            back = layer @ p
            step = np.outer(hidden, p)
            layer_sq += step * step
            layer -= 0.2 * rate * step / np.sqrt(layer_sq)
            bias_sq += p * p
            bias -= 0.05 * rate * p / np.sqrt(bias_sq)
            if len(ids):
                table_sq[ids] += weight * weight * float(back @ back) / DIM
                table[ids] -= (rate * weight / np.sqrt(table_sq[ids]))[:, None] * back[None, :]
    return (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def score_text(text: str | None, numbers: np.ndarray, bias: float) -> float:
    """The softmax probability of the toxic class; a text without words has the bias alone."""
    bucket, weight, words = features(text)
    z = bias + (float(numbers[bucket] @ weight) / (words + PAD_WORDS) if words else 0.0)
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> tuple[np.ndarray, float]:
    """Train on at most `max_train` labelled texts whose id is not held out (crc32 of the id as text, modulo 3, is 1).

    Labels that are null or not 0 or 1, and ids without a text, are left out; of an id labelled twice the larger label counts, of an id with several
    texts the smallest text; null texts are empty. The sample ends before the text that would take it over `max_bytes`; texts of over a
    hundredth of that come last. Other columns are not read. Without labelled texts of both kinds every score is the share of label 1.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("label"))
    marks = marks.where("id is not null and label in (0, 1) and crc32(cast(id as string)) % 3 != 1")
    chosen = marks.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_train)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"))
    rows = materialize(texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")), "labelled")
    size = F.octet_length("text")
    # at most max_train ids and lengths meet in the window
    upto = F.sum("size").over(Window.orderBy(F.col("size") > max_bytes // 100, F.xxhash64("id"), "id"))
    within = rows.select("id", size.alias("size")).withColumn("upto", upto).where(F.col("upto") <= max_bytes).select("id")
    sample = rows.join(F.broadcast(within), "id", "left_semi").toArrow().sort_by("id")
    # texts are turned to features one by one and let go of when the last is read
    marked, texts = sample.column("label").to_pylist(), iter([sample.column("text")])
    del sample
    model = train((t.as_py() for column in texts for t in column), marked)
    give_back()
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (doc_id, held_out, score, predicted).

    Null and empty texts get the score of the bias; repeated rows and null ids come back as they came (a null id is not held out). Other
    columns, labels among them, are not read. The broadcast model has a fixed size (1 MB).
    """
    numbers, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": [score_text(t, shared.value, bias) for t in pdf["text"]]})
        give_back()

    rows = docs.select(id_or_none(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    scored = rows.mapInPandas(run, "doc_id long, score double").select(none_again().alias("doc_id"), "score")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The rows of `docs` that score under the threshold, with their columns as they were. The test runs beside the row, without a join. Null and empty
    texts have the score of the bias; repeated rows and null ids stay or go by their texts; an empty table gives no rows."""
    numbers, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([score_text(t, shared.value, bias) for t in texts], dtype="float64")
        give_back()

    return docs.where(toxicity(text_or_empty()) < THRESHOLD)
