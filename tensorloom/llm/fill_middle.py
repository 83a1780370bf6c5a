"""Fill-in-the-middle: texts cut in two places and laid out with marks, so that a model learns to write a middle from what stands around it.

Cuts are chosen in units (words, code points or bytes) and made in the UTF-8 bytes of a text. What a text's characters need beyond one byte is kept as a sparse
index: the positions of its multibyte characters and the excess bytes up to each. A binary search in the index turns a place counted in code points into one
counted in bytes, or back; between two entries one is the other plus a constant, and an ASCII text has an empty index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import give_back, id_or_none, none_again, text_or_empty

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
UNITS = ("word", "char", "byte")


@dataclass
class Exceptions:
    """The multibyte characters of a text: where each stands, in code points and in bytes, and the excess bytes before it; one entry more closes the list."""

    chars: np.ndarray
    bytes: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray) -> Exceptions:
        lead = np.flatnonzero(raw >= 0xC0)
        head = raw[lead]
        excess = 1 + (head >= 0xE0).astype(np.int64) + (head >= 0xF0)
        before = np.concatenate([[0], np.cumsum(excess)])
        return cls(lead - before[:-1], lead, before)

    def to_bytes(self, char: int) -> int:
        """The byte at which code point `char` begins."""
        return char + int(self.before[np.searchsorted(self.chars, char)])

    def to_chars(self, byte: int) -> int:
        """The code points that begin before `byte`; `byte` is one at which a code point begins, or the end."""
        return byte - int(self.before[np.searchsorted(self.bytes, byte)])

    def begins(self, byte: int) -> int:
        """The nearest byte at or before `byte` at which a code point begins."""
        k = int(np.searchsorted(self.bytes, byte, side="right")) - 1
        inside = k >= 0 and byte <= self.bytes[k] + self.before[k + 1] - self.before[k]
        return int(self.bytes[k]) if inside else byte


def word_ends(raw: np.ndarray) -> np.ndarray:
    """The byte behind each token: white space with the word behind it, or white space alone at the end."""
    if not len(raw):
        return np.empty(0, np.int64)
    space = SPACE[raw]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(raw))


def cut_points(raw: np.ndarray, index: Exceptions, unit: str, lower: int, upper: int) -> tuple[int, int, int]:
    """(units of the text, byte of the lower cut, byte of the upper): the cuts stand after `lower` and `upper` modulo one more than the units, in order.
    A cut counted in bytes that falls inside a character goes before it."""
    if unit == "word":
        ends = word_ends(raw)
        n = len(ends)
        at = lambda k: int(ends[k - 1]) if k else 0
    elif unit == "char":
        n = index.to_chars(len(raw))
        at = index.to_bytes
    else:
        n, at = len(raw), index.begins
    a, b = sorted((lower % (n + 1), upper % (n + 1)))
    return n, at(a), at(b)


def draws(doc_id: str, seed: int) -> tuple[int, ...]:
    """Four 32-bit numbers of a document: the first four groups of eight hex digits of the SHA-256 of the seed, a colon and the decimal id."""
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return tuple(int(h[k : k + 8], 16) for k in (0, 8, 16, 24))


def lay_out(text: bytes, doc_id: str, seed: int, rate: int, spm: int, unit: str) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, characters of the prefix and of the middle, output) of one text."""
    raw = np.frombuffer(text, np.uint8)
    h1, h2, h3, h4 = draws(doc_id, seed)
    index = Exceptions.of(raw)
    n, a, b = cut_points(raw, index, unit, h1, h2)
    if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    before, middle, after = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        form, out = "spm", SUFFIX + after + PREFIX + before + MIDDLE + middle
    else:
        form, out = "psm", PREFIX + before + SUFFIX + after + MIDDLE + middle
    lead = index.to_chars(a)
    return n, form, lead, index.to_chars(b) - lead, out


def fill_in_middle(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", unit: str = "word", rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): `rate` of a hundred texts are cut, after units drawn from the hash of the seed and the id, and `spm` of a
    hundred of those stand suffix first; the others are plain. n counts the units of the whole text: words (a word with the white space before it), code
    points or bytes.

    Map-only: a text meets no other. Empty texts and texts that hold a mark are plain; null texts are empty, a null id draws as the empty name, rows
    that repeat an id draw alike; further columns are ignored, whatever their names; no rows give no rows."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo : lo + 512]
                rows = [lay_out(t.encode("utf-8", "surrogatepass"), i, seed, rate, spm, unit) for t, i in zip(part["text"], part["key"], strict=True)]
                n, form, lead, middle, out = zip(*rows, strict=True)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].to_numpy(), "n": n, "form": form, "prefix_chars": pd.array(lead, "Int64"), "middle_chars": pd.array(middle, "Int64"),
                        "output": [o.decode("utf-8", "surrogatepass") for o in out],
                    }
                )
        give_back()

    key = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))
    rows = docs.select(id_or_none(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), key.alias("key"))
    return rows.mapInPandas(run, schema).withColumn("doc_id", none_again())


def restore(laid: DataFrame) -> DataFrame:
    """Adds `restored`, the text that an output and its form were made of, with Spark expressions. An output whose marks do not fit its form raises an error."""
    parts = F.split("output", "<P>|<S>|<M>", -1)
    sound = (F.size("_parts") == 4) & (F.col("_parts")[0] == "")
    psm, spm = (F.concat(*(F.col("_parts")[k] for k in order)) for order in ((1, 3, 2), (2, 3, 1)))
    marked = F.when(F.col("form") == "psm", psm).otherwise(spm)
    wrong = F.raise_error(F.concat(F.lit("marks do not fit the form "), F.coalesce("form", F.lit("null"))))
    restored = F.when(F.col("form") == "plain", F.col("output")).when(F.col("form").isin("psm", "spm") & sound, marked).otherwise(wrong.cast("string"))
    return laid.withColumn("_parts", F.when(F.col("form") != "plain", parts)).withColumn("restored", restored).drop("_parts")


def middle_digests(docs: DataFrame) -> DataFrame:
    """What fill_in_middle returns, its output and what restore rebuilds from it as digests."""
    hexed = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    laid = restore(fill_in_middle(docs))
    return laid.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hexed("output").alias("output_sha256"), hexed("restored").alias("restored_sha256"))
