"""Queries without SQL against plain versions on the given tables, and what must not matter to them."""

import hashlib
import html
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tensorloom.llm import chat, fingerprints, html_extract, media, packing, toxicity, warc
from tensorloom.llm.entries import queries
from tests.conftest import DATA

LARGER = DATA.replace("sf0.001", "sf0.01")


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def chain(values, seed=42):
    """The 64-bit hash of several numbers: each hashed with the hash so far as the seed. (kind, number): q for a long, i for an int."""
    for kind, v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<" + kind, v), seed)
    return signed(seed)


def plain_terms(text):
    return {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}


def plain_fingerprint(terms, lexicon):
    """I-Match: the hash of the sorted lexicon terms, and of those in each randomised subset."""
    found = sorted(terms & lexicon)
    first = chain(("q", t) for t in (found or sorted(terms)))
    parts = []
    for seed, (rate, count) in enumerate(fingerprints.SUBSETS):
        cells = {t: chain([("q", t), ("i", seed)]) % rate for t in found}
        for j in range(count):
            own = [t for t in found if cells[t] == j]
            parts.append(chain(("q", t) for t in own) % 65535 + 1 if own else 0)
    return first, parts


def written(fp):
    return f"{fp[0] % (1 << 64):016x}." + "".join(f"{n:04x}" if n else "----" for n in fp[1])


def likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    either = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x or y]
    return sum(x == y for x, y in either) / len(either) if either else 0.0


def test_fingerprints_equal_plain_i_match(spark):
    docs = dict(duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall())
    terms = {i: plain_terms(t) for i, t in docs.items()}
    df = {}
    for own in terms.values():
        for t in own:
            df[t] = df.get(t, 0) + 1
    n = len(docs)
    lexicon = {t for t, k in df.items() if max(2, -(-n // fingerprints.RARE)) <= k <= n / fingerprints.COMMON}
    order = sorted(docs, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    own = {i: plain_fingerprint(t, lexicon) for i, t in terms.items()}
    got = {r.doc_id: r for r in queries()["op3_fingerprints"](spark, DATA).collect()}
    assert got.keys() == docs.keys() and len(lexicon) > 100
    for i, t in docs.items():
        half = len(t) // 2
        edited = plain_fingerprint(plain_terms(t[: len(t) - half] + docs[after[i]][:half]), lexicon)
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (written(own[i]), written(edited))
        assert r.near_edited == pytest.approx(likeness(own[i], edited)) and r.near_next == pytest.approx(likeness(own[i], own[after[i]]))


def test_held_out_labels_are_not_used_and_are_predicted(spark):
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    model, other = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert (model[0] == other[0]).all() and model[1] == other[1]
    spoilt = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y"))
    a = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert a == {r.doc_id: r.score for r in toxicity.score(spoilt, model).collect()}
    known = [(r.doc_id, r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.doc_id in a]
    good, bad = [a[i] for i, y in known if y == 0], [a[i] for i, y in known if y == 1]
    assert np.mean([(x > y) + (x == y) / 2 for x in bad for y in good]) > 0.75


def test_training_is_bounded_by_texts_and_bytes(spark):
    rows = [(i, "good words here " * 5 if i % 2 else "horrid words here " * 5) for i in range(40)] + [(3, "a second text"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, toxic int")
    whole = toxicity.fit(docs, labels)
    assert (toxicity.fit(docs.unionByName(docs), labels.unionByName(labels))[0] == whole[0]).all()  # an id counts once
    none = toxicity.fit(docs, labels, max_bytes=10)
    assert not none[0].any()
    assert (toxicity.fit(docs, labels, max_train=10)[0] != whole[0]).any()


INLINE = re.compile(r"</?(?:a|b)(?:\s[^>]*)?>")


def plain_article(page):
    """The text between the article's tags, for pages whose only other parts are head, menu, advertisement and footer."""
    body = re.sub(r"<!--.*?-->", "", page, flags=re.S)
    body = re.sub(r"<(script|style)\b.*?</\1>", "", body, flags=re.S)
    body = re.search(r"<article>(.*?)</article>", body, re.S).group(1)
    body = re.sub(r"<br>", " ", INLINE.sub("", body))
    blocks = (re.sub(r"\s+", " ", html.unescape(b)).strip() for b in re.split(r"<[^>]*>", body))
    return " ".join(b for b in blocks if b)


def test_html_extraction_equals_the_articles_of_the_given_pages(spark):
    pages = duckdb.sql(f"select page_id, url, html from '{LARGER}/pages.parquet'").fetchall()
    want = sorted((i, u, plain_article(h), len(plain_article(h))) for i, u, h in pages)
    assert sorted(map(tuple, queries()["op8_html_extraction"](spark, LARGER).collect())) == want and len(want) > 100


def test_media_digests_equal_the_texts(spark):
    docs = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in queries()["op7_media"](spark, DATA).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        raw = (t or "").encode()
        filled = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].tail_crc32) == (len(raw), len(filled), zlib.crc32(filled[-64:]))
        assert got[i].payload_sha256 == hashlib.sha256(filled).hexdigest() and got[i].media_bytes > len(filled)


def test_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model).count() == 0 and toxicity.drop_toxic(docs, model).count() == 0
    assert toxicity.fit(spark.read.parquet(f"{DATA}/documents.parquet"), labels.limit(0))[1] < 0
    assert media.media_digests(docs).count() == 0 and packing.pack_documents(docs).count() == 0
    pages = spark.read.parquet(f"{DATA}/pages.parquet").limit(0)
    assert html_extract.extract(pages).count() == 0
    warc.write_archives(pages, str(tmp_path / "w"))
    assert warc.page_digests(warc.read_records(spark, str(tmp_path / "w"))).count() == 0
    turns = spark.read.parquet(f"{DATA}/conversations.parquet").limit(0)
    assert chat.read_formatted(chat.format_conversations(turns)).count() == 0
    assert chat.read_formatted(chat.format_conversations(chat.with_probe(turns))).count() == 1


def test_extra_columns_with_names_the_operators_use(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a", 5, "x", "y"), (1, 1, "assistant", "b", 6, "x", "y")], "conv_id long, turn long, role string, text string, piece int, turns string, runs string")
    assert chat.read_formatted(chat.format_conversations(turns)).first().n_turns == 2
    pages = spark.createDataFrame([(1, "u", "<p>Some words, enough of them.</p>", "a", 1)], "page_id long, url string, html string, text string, n_chars int")
    assert html_extract.extract(pages).first().text == "Some words, enough of them."
    docs = spark.createDataFrame([(1, "some words", 3, "m", 4)], "doc_id long, text string, n_bytes int, media string, score int")
    assert media.media_digests(docs).first().n_bytes == 10
    assert toxicity.score(docs, toxicity.train([], [])).columns == ["doc_id", "held_out", "score", "predicted"]
    assert fingerprints.fingerprint_edits(docs.withColumn("term", F.lit(1)).withColumn("next", F.lit(2))).count() == 1
