"""Each stage of the pipeline against a plain version, on its own input."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

import corpus_pipeline as P
from tensorloom.llm import mixing, packing, toxicity
from tensorloom.llm.common import materialize
from tests.conftest import DATA
from tests.llm.test_near_copies import lowest
from tests.llm.test_operators import brute_removed


def plain_kept(text, size=200):
    """What brute force leaves of each text, with the bytes of characters that were cut in part gone too."""
    raw = [t.encode() for t in text]
    seen = Counter(t[k : k + size] for t in raw for k in range(len(t) - size + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for k in range(len(t) - size + 1):
            if seen[t[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        out.append(bytes(c for c, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


def test_stages(spark):
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, stages = docs.columns, dict(P.STAGES)

    def through(name):
        out = materialize(stages[name](spark, docs, DATA), name)
        assert out.columns == columns and out.dtypes == docs.dtypes
        return docs.collect(), out.collect(), out

    before, after, docs = through("toxicity")
    model = toxicity.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    assert Counter(after) == Counter(r for r in before if toxicity.score_text(r.text, *model) < 0.7)

    before, after, docs = through("simhash_near_dedup")
    keep = lowest({r.doc_id: r.text for r in before})
    assert Counter(after) == Counter(r for r in before if r.doc_id in keep)

    before, after, docs = through("suffix_array_dedup")
    want = dict(zip([r.doc_id for r in before], plain_kept([r.text for r in before]), strict=True))
    assert {r.doc_id: (r.text, r.n_chars, r.lang, r.source) for r in after} == {r.doc_id: (want[r.doc_id], len(want[r.doc_id]), r.lang, r.source) for r in before}
    assert any(want[r.doc_id] != r.text for r in before) and len(after) == len(before)
    assert sum(n for n, *_ in brute_removed([r.text.encode() for r in before])) == sum(len(r.text.encode()) for r in before)

    before, after, docs = through("mixing")
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(before, docs.schema).toPandas())
    taken = Counter(i for (i,) in con.execute(f"select doc_id from ({mixing.MIXTURE_SQL})").fetchall())
    assert Counter(after) == Counter({r: taken[r.doc_id] for r in before if taken[r.doc_id]})

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    packed = P.STAGES[-1][1](spark, docs, DATA).toPandas()
    copies = Counter(r.doc_id for r in after)
    for i, n in copies.items():
        ids = tok.encode(next(r.text for r in after if r.doc_id == i), add_special_tokens=False).ids + [1]
        own = packed[packed.doc_id == i]
        assert own.length.sum() == n * len(ids) and (own.doc_tokens == len(ids)).all()
        assert all(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in own.itertuples())
    fill = packed.groupby("sequence_id").length.sum()
    assert set(packed.doc_id) == set(copies) and fill.max() <= 2048 and fill.sum() / 2048 / len(fill) > 0.95


def test_no_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    """1,500 texts of 10 kB in one partition reach Python workers in several batches, in every stage."""
    long = spark.range(0, 1500, 1, 1).selectExpr("id as doc_id", "repeat(cast(id % 10 as string), 10000) as text", "'en' as lang", "'web' as source", "10000L as n_chars")
    for _, stage in P.STAGES:
        for key in (P.BATCH_ROWS, P.BATCH_BYTES):
            spark.conf.unset(key)
        stage(spark, long.limit(0), DATA)
        most = long.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
        assert len(most) >= 7 and max(n for (n,) in most) < 2 * P.MOST_BYTES
