"""Further columns with the names that operators use inside come back as they were, or are ignored."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tensorloom.llm import fill_middle, licenses, media, mixing, near_copies, packing, runs, simhash, suffix_dedup, toxicity
from tensorloom.llm.common import table
from tests.conftest import DATA

NAMES = (
    "_whole _last _times _lang _source _domain0 _left _all _budget _bucket _key _node _s _n _low whole last times row tokens domain left_over bucket key upto before budget cap weight "
    "node slots slot size bits part k component rest mark body runs run cover kept n_bytes fp id low text_first gift term place label hash gram words template start end copies score"
).split()


@pytest.fixture(scope="session")
def crowded(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60")
    return docs.select("*", *(F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in NAMES))


def same(crowded, out):
    """Every further column of `out` says its own name and the row's id."""
    rows = out.select("doc_id", *NAMES).collect()
    assert rows and all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in NAMES)


def test_stages_keep_columns_of_any_name(spark, crowded):
    model = toxicity.fit(crowded, table(spark, DATA, "labels"))
    same(crowded, toxicity.drop_toxic(crowded, model))
    same(crowded, near_copies.keep_one_per_group(crowded))
    same(crowded, suffix_dedup.without_repeats(crowded))
    mixed = mixing.mix(crowded)
    same(crowded, mixed)
    assert mixed.columns == [*crowded.columns, "_domain", "_epoch", "_tokens"]
    assert P.stage_mixing(spark, crowded, DATA).columns == crowded.columns
    plain = crowded.select("doc_id", "text", "lang", "source", "n_chars")
    assert sorted(map(tuple, mixing.mix(plain).select("doc_id", "_epoch").collect())) == sorted(map(tuple, mixed.select("doc_id", "_epoch").collect()))


@pytest.mark.parametrize(
    "operator",
    [simhash.near_duplicates, packing.pack_documents, media.media_digests, lambda d: suffix_dedup.digest(suffix_dedup.remove_repeats(d)), lambda d: runs.run_digests(runs.find_runs(d)), fill_middle.middle_digests, licenses.license_labels],
)
def test_operators_ignore_columns_of_any_name(spark, crowded, operator):
    plain = operator(crowded.select("doc_id", "text"))
    told = operator(crowded)
    assert told.columns == plain.columns
    keys = [c for c in plain.columns if c not in ("sequence_id", "offset")]
    assert sorted(map(str, told.select(*keys).collect())) == sorted(map(str, plain.select(*keys).collect()))
