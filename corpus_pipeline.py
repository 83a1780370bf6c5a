"""The corpus pipeline: toxicity, near-duplicates, repeated passages, mixture, packing; each stage works on all that the one before kept.

All stages take null ids and null texts (as empty texts), very long texts, ties, repeated rows and empty tables; all but the last return the columns of
their input, further ones included. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.common import materialize, table
from tensorloom.llm.mixing import mix
from tensorloom.llm.near_copies import keep_one_per_group
from tensorloom.llm.packing import pack_documents
from tensorloom.llm.suffix_dedup import without_repeats
from tensorloom.llm.toxicity import drop_toxic, fit


BATCH_ROWS, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
MOST_BYTES = 2 << 20


def _small_batches(spark: SparkSession) -> None:
    """Rows are whole texts, so those that go to a Python worker at once are 2,000, where the session has Spark's default of 10,000, and end with the one that
    takes them to 2 MB, where it allows more: the memory of tasks beside one another goes by it, on both sides."""
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "2000")
    most = spark.conf.get(BATCH_BYTES).removesuffix("b")
    if most.isdigit() and int(most) > MOST_BYTES:
        spark.conf.set(BATCH_BYTES, str(MOST_BYTES))


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring 0.7 or more go; the classifier learns from the labelled documents of this stage's input. Empty texts have the score of the
    bias; without labels of both kinds every text has the share of toxic labels as its score."""
    _small_batches(spark)
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more over 5-word shingles stays, the one with the smallest id, a null id after
    all others; rows that repeat an id are told apart by their texts, and empty and null texts are one group. SimHash fingerprints in a byte-position index
    with a count filter find the pairs, an exact check of the shingles follows."""
    _small_batches(spark)
    return keep_one_per_group(docs)


def stage_suffix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes that start in more than one place go; the documents stay, a null text as an empty one."""
    _small_batches(spark)
    return without_repeats(docs)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture to target weights; a document taken in two epochs comes twice. Null languages and sources are the empty name."""
    _small_batches(spark)
    return mix(docs).select(*docs.columns)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in sequences of 2048 tokens; empty texts are their end id alone, repeated rows are packed as often as they come."""
    _small_batches(spark)
    return pack_documents(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("simhash_near_dedup", stage_simhash),
    ("suffix_array_dedup", stage_suffix),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

#: A trained classifier, a tokenizer and windows are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
