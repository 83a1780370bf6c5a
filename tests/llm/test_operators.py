"""The training-data operators against brute force, on the given documents and on hand-made edge cases."""

import functools
import hashlib
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tensorloom.llm import chat, fingerprints, html_extract, media, mixing, packing, simhash, suffix_dedup, toxicity, warc, word_ids
from tensorloom.llm.entries import oracle_sql, queries
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, bucket string"


def frame(spark, rows):
    """Documents with two extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), 7, "x") for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="session")
def edges(spark):
    long = "The quick brown fox jumps over the lazy dog, again and again. " * 40
    rows = [(1, long, "en", "src0"), (1, long, "en", "src0"), (2, None, None, None), (None, "alone here", "en", "src1"), (3, "", "de", "src7"), (4, "a" * 700, "fr", "x"),
            (5, long + "end", "en", "src0"), (6, "é" * 300, "es", "src19"), (7, " \t\n", "en", "src3"), (9, "one two", "en", "src3")]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def docs():
    return dict(duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall())


def plain_fingerprint(text):
    import xxhash

    low = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    words = [w for w in low.translate(bytes(32 if 9 <= c <= 13 else c for c in range(256))).split(b" ") if w]
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    ids = list(fps)
    label = {i: i for i in ids}
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_simhash_equals_brute_force(spark, docs):
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    label = components(fps)
    got = queries()["op1_simhash"](spark, DATA).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", label[i]) for i in docs}


def clustered(rng, n=120):
    """Distinct fingerprints with copies of one to five differing bits, and a crowd that shares five bytes."""
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64).tolist()
    flip = lambda v: v ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))
    return sorted({*base, *(flip(v) for v in base for _ in range(5)), *(base[0] ^ (int(rng.integers(0, 1 << 24)) & 0x00F0F3) for _ in range(300))})


def reached(nodes, pairs):
    """The smallest node that each node reaches."""
    label = {v: v for v in nodes}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for a, b in pairs:
        low, high = sorted((root(a), root(b)))
        label[high] = low
    return {v: root(v) for v in nodes}


@pytest.mark.parametrize("pair_limit,batch_rows", [(512, 200_000), (40, 64)])
def test_simhash_lists_join_what_brute_force_joins(monkeypatch, pair_limit, batch_rows):
    monkeypatch.setattr(simhash, "PAIR_LIMIT", pair_limit)
    monkeypatch.setattr(simhash, "BATCH_ROWS", batch_rows)
    fps = clustered(np.random.default_rng(5))
    slot = lambda n, fp, places: functools.reduce(lambda v, p: v << 8 | fp >> 8 * p & 255, places, n)

    def linked(postings, blocks):
        rows = sorted(postings)
        s, f = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.uint64).view(np.int64)
        return pd.concat(simhash._link_lists(iter([pd.DataFrame({"slot": s[i : i + 50], "fp": f[i : i + 50]}) for i in range(0, len(s), 50)]), blocks))

    found = linked([(slot(n, v, b), v) for v in fps for n, b in enumerate(simhash.BLOCKS)], True)
    pairs = found[found.kind == 0][["a", "b"]]
    crowded = {(int(v) % (1 << 64), int(b)) for v, b in found[found.kind == 1][["a", "b"]].itertuples(index=False)}
    assert bool(crowded) == (pair_limit == 40)
    if crowded:
        longer = [(slot(8 * b + p, v, (*simhash.BLOCKS[b], p)), v) for v, b in crowded for p in range(8) if p not in simhash.BLOCKS[b]]
        pairs = pd.concat([pairs, linked(longer, False)[["a", "b"]]])
    joined = {(int(a) % (1 << 64), int(b) % (1 << 64)) for a, b in pairs.itertuples(index=False)}
    assert reached(fps, joined) == components(dict(zip(fps, fps, strict=True)))


def test_simhash_crowded_lists_go_on_under_one_more_byte(spark):
    fps = clustered(np.random.default_rng(6), 5)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    crowded = spark.createDataFrame([(v, n % 14) for n, v in enumerate(signed)], "fp long, block long")
    got = {(r.slot, r.fp % (1 << 64)) for r in simhash._longer_postings(crowded).collect()}
    slot = lambda n, fp, places: functools.reduce(lambda v, p: v << 8 | fp >> 8 * p & 255, places, n)
    blocks = [(v, n % 14) for n, v in enumerate(fps)]
    assert got == {(slot(8 * b + p, v, (*simhash.BLOCKS[b], p)), v) for v, b in blocks for p in range(8) if p not in simhash.BLOCKS[b]}


def test_the_count_filter_rejects_pairs_that_share_a_block_only():
    block = simhash.BLOCKS[3]
    same = sum(0x5A << 8 * p for p in block)
    others = [p for p in range(8) if p not in block]
    fps = np.array(sorted(same | sum(1 << 8 * p for p in others[:n]) for n in range(5)), dtype=np.uint64)
    slot = np.zeros(len(fps), np.int64) + (3 << 32)
    met = {(int(fps[a]), int(fps[b])) for i, j in simhash.reaching_pairs(slot, fps, False) for a, b in zip(i, j, strict=True)}
    pairs = {(int(a), int(b)) for k, a in enumerate(fps) for b in fps[k + 1 :]}
    assert met == {(a, b) for a, b in pairs if sum(a >> 8 * p & 255 == b >> 8 * p & 255 for p in range(8)) >= 5} and met < pairs
    assert all(any(set(b) <= set(five) for b in simhash.BLOCKS) for five in combinations(range(8), 5)) and len(simhash.BLOCKS) == 14


def test_simhash_edges(spark, edges):
    got = simhash.near_duplicates(edges).collect()
    assert len(got) == 10
    zero = {r.component_id for r in got if r.doc_id in (2, 3, 7)}
    assert zero == {2} and {r.fingerprint for r in got if r.doc_id == 3} == {"0" * 16}
    assert simhash.near_duplicates(edges.limit(0)).count() == 0


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rows = queries()["op2_packing"](spark, DATA).toPandas()
    for i, t in docs.items():
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        own = rows[rows.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        for r in own.itertuples():
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    fill = rows.groupby("sequence_id").length.sum()
    assert fill.max() <= 2048 and fill.sum() / (2048 * len(fill)) > 0.97
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 256), min_size=1, max_size=120))
def test_pack_sizes_hold_all_within_capacity(sizes):
    groups = packing.pack_sizes(sizes, 512)
    assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in g) <= 512 for g in groups)


def test_word_tokenizer_is_the_library():
    from tokenizers import Tokenizer

    texts = ["", "Hello, World... it's 3.5!\x1cx y", "<|endoftext|>a b.", "ÉÀ İstanbul Σας ß., ..", "á é\n\tz,.,", "日本語 テスト", "x" * 5000]
    for name, by_runs in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = packing.tokenizer_path(name)
        tok, own = Tokenizer.from_file(path), word_ids.WordTokenizer(path)
        assert own.by_runs == by_runs
        for _ in range(3):  # what is known gives the same ids, and so it does when half is forgotten
            ids, cuts = own.encode(pa.array(texts))
            for k, t in enumerate(texts):
                assert ids[cuts[k] : cuts[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids, t
            own.known._forget()


def test_known_runs_with_one_hash_are_told_apart(monkeypatch):
    known = word_ids.KnownRuns()
    monkeypatch.setattr(word_ids, "hash", lambda s: len(s), raising=False)
    known.add(["ab", "cd", "xyz"], [b"\1\0\0\0", b"\2\0\0\0", b""])
    assert known.find(["cd", "ab", "xyz", "q"]).tolist() == [-1, 0, 1, -1]


def test_packing_cuts_long_texts_and_slices(spark):
    rows = [(1, "word " * 500_000, "en", "s"), (2, "short one", "en", "s"), (3, "other " * 2000, "en", "s")]
    assert len(rows[0][1]) > packing.SLICE_BYTES
    got = packing.pack_documents(frame(spark, rows)).toPandas()
    for i, n in ((1, 500_001), (2, 3), (3, 2001)):
        own = got[got.doc_id == i].sort_values("start")
        assert (own.start == np.concatenate(([0], np.cumsum(own.length)[:-1]))).all() and own.length.sum() == own.doc_tokens.iloc[0] == n


def test_packing_edges(spark, edges):
    got = packing.pack_documents(edges).collect()
    assert sum(r.doc_tokens == 1 for r in got if r.doc_id in (2, 3, 7)) == 3
    assert packing.pack_documents(edges.limit(0)).count() == 0


def test_fingerprints(spark, docs):
    got = {r.doc_id: r for r in queries()["op3_fingerprints"](spark, DATA).collect()}
    order = sorted(docs, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    for i, t in docs.items():
        m = len(t) // 2
        e = t[: len(t) - m] + docs[after[i]][:m]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
    by_text = {}
    for i, t in docs.items():
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert np.mean([r.near_edited for r in got.values()]) > 5 * np.mean([r.near_next for r in got.values()])


def test_fingerprint_edges(spark, edges):
    got = fingerprints.fingerprint_edits(edges).collect()
    assert len(got) == 10 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (2, 3, 7)}) == 1
    one = fingerprints.fingerprint_edits(frame(spark, [(8, "abcd", "en", "s")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fingerprints.fingerprint_edits(edges.limit(0)).count() == 0


def brute_removed(texts, size=suffix_dedup.LENGTH):
    seen = Counter(t[k : k + size] for t in texts for k in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - size + 1):
            if seen[t[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def test_suffix_dedup_equals_brute_force(spark, docs):
    want = dict(zip(docs, brute_removed([t.encode() for t in docs.values()]), strict=True))
    got = queries()["op4_suffix_dedup"](spark, DATA).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_suffix_dedup_tells_texts_without_an_id_apart(spark):
    rows = [(None, f"{k:05d} " * 60, "en", "s") for k in range(6)] + [(None, "00003 " * 60, "en", "s"), (5, "x" * 300, "en", "s"), (5, "y" * 199 + "z" * 150, "en", "s")]
    docs = frame(spark, rows)
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs)).collect()
    want = sorted(brute_removed([r[1].encode() for r in rows]))
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want and [r.doc_id for r in got].count(None) == 7


def test_suffix_dedup_of_texts_whose_hash_agrees(spark):
    """Texts without an id whose 32-bit hashes are equal keep what is theirs."""
    many = spark.range(300_000).select(F.concat_ws(" ", *(F.hex(F.xxhash64("id", F.lit(k))) for k in range(20))).alias("text"))
    one, other = many.groupBy(F.hash("text")).agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a != b").select("a", "b").first()
    rows = [(None, one, "en", "s"), (None, other, "en", "s"), (3, one, "en", "s")]
    got = {(r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect() if r.doc_id is None}
    assert got == {(len(one), len(one)), (len(other), 0)}


def test_suffix_dedup_of_a_text_over_one_block(spark):
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, n))
    shared, text = word(40), word(60_000)
    assert len(text) > suffix_dedup.BLOCK
    rows = [(1, text + "|" + shared, "en", "s"), (2, "a " + shared + " b", "en", "s"), (3, text[suffix_dedup.BLOCK - 150 : suffix_dedup.BLOCK + 150], "en", "s")]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == {1: (len(shared) + 300, 2), 2: (len(shared), 1), 3: (300, 1)}


def test_suffix_dedup_edges_and_hot_buckets(spark, edges, monkeypatch):
    rows = [*((k, f"{k:04d} " * 50 + "license text " * 12 + f"{k * 7:05d}" * 40, "en", "s") for k in range(30))]
    both = edges.unionByName(frame(spark, rows))
    want = sorted(brute_removed([(r.text or "").encode() for r in both.collect()]))
    tell = lambda df: sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(df).collect())
    assert tell(suffix_dedup.remove_repeats(both)) == want
    monkeypatch.setattr(suffix_dedup, "HOT_CLASSES", 1)
    assert tell(suffix_dedup.remove_repeats(both)) == want
    cut = suffix_dedup.without_repeats(edges)
    assert cut.columns == edges.columns and cut.count() == 10
    assert suffix_dedup.remove_repeats(edges.limit(0)).count() == 0


def test_toxicity_learns_and_scores(spark, edges):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    make = lambda bad: " ".join([*rng.choice(words, 60), *(["horridword"] * 2 if bad else [])])
    y = [k % 4 == 0 for k in range(300)]
    model = toxicity.train([make(b) for b in y], [int(b) for b in y])
    held = [(make(b), b) for b in ([True, False] * 40)]
    s = [toxicity.score_text(t, *model) for t, _ in held]
    assert np.mean([(v >= 0.5) == b for v, (_, b) in zip(s, held, strict=True)]) > 0.9
    assert toxicity.score_text(make(False) + " horridwordd horidword", *model) > np.mean([v for v, (_, b) in zip(s, held, strict=True) if not b])
    got = toxicity.score(edges, model).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert {r.held_out for r in got if r.doc_id == 1} == {zlib.crc32(b"1") % 3 == 1}
    assert toxicity.drop_toxic(edges, model).columns == edges.columns
    assert toxicity.train(["a"], [1])[1] > 0 and toxicity.train([], [])[1] < 0
    assert toxicity.fit(edges, spark.createDataFrame([(1, 1, None), (9, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int"))[0].shape == (toxicity.BUCKETS,)


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "Große Straße & " * 12_000 + "</p>"
    rows = [(1, "http://a", "x" * 200, 1), (2, "http://b\r\n", "x" * 200, 1), (3, None, "short", 1), (4, "u", "short", 1), (5, "u", None, 1), (6, "u", big, 1), (7, "u", big, 1), (8, "u", "WARC/1.1\r\n\r\n" * 30, 1), (8, "u", "WARC/1.1\r\n\r\n" * 30, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, first long")
    warc.write_archives(pages, str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"))
    assert records.where("type = 'continuation'").count() >= 2
    got = warc.page_digests(records).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == sorted((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h, _ in rows)
    assert sorted((r.page_id, r.refers_to) for r in got if r.record_type == "revisit") == [(2, 1), (7, 6), (8, 8)]
    lost = records.where("not (type = 'continuation' and segment = 2)")
    with pytest.raises(Exception, match="segments do not make a record"):
        warc.reassemble(lost).collect()


def test_warc_keeps_every_row(spark, tmp_path):
    """Rows that repeat an id and a payload, rows without an id, and no rows at all."""
    rows = [(1, "u", "y" * 150), (1, "u", "y" * 150), (1, "v", "y" * 150), (2, "u", "y" * 150), (None, "a", "z" * 150), (None, "b", "z" * 150), (3, "u", "tiny"), (3, "u", "tiny"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"))
    assert records.count() == records.select("record_id").distinct().count() == 9
    got = warc.page_digests(records).collect()
    assert Counter((r.page_id, r.payload_bytes) for r in got) == Counter((i, len(h or "")) for i, _, h in rows)
    assert Counter((r.page_id, r.refers_to) for r in got if r.record_type == "revisit") == Counter({(1, 1): 2, (2, 1): 1, (None, None): 1})
    origin = next(r.refers_to for r in records.collect() if r.type == "revisit")
    for broken in (records.where(F.col("record_id") != origin), records.withColumn("payload_digest", F.when(F.col("type") == "revisit", "0").otherwise(F.col("payload_digest")))):
        with pytest.raises(Exception, match="no response with its payload"):
            warc.page_digests(broken).collect()
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": [r[0] for r in rows[3:]], "html": [r[2] for r in rows[3:]]}))
    told = con.execute(oracle_sql()["op6_warc"]).fetchall()
    warc.write_archives(pages.where("url != 'v' and (page_id is null or page_id != 1) or url is null"), str(tmp_path / "sql"))
    got = warc.page_digests(warc.read_records(spark, str(tmp_path / "sql"))).collect()
    assert Counter(tuple(r) for r in got) == Counter(told)
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.page_digests(warc.read_records(spark, str(tmp_path / "none"))).count() == 0


@pytest.mark.parametrize("name,table", [("op6_warc", "pages"), ("op9_mixing", "documents"), ("op10_chat_formatting", "conversations")])
def test_query_equals_sql(spark, name, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    df = queries()[name](spark, DATA)
    want = con.execute(f"select {', '.join(df.columns)} from ({oracle_sql()[name]})").fetchall()
    assert Counter(map(tuple, df.collect())) == Counter(want) and want


def test_chunked_framing():
    data = "aé".encode() * 9000
    assert warc.unchunked(warc.chunked(data, 1000)) == data
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: z\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_ogg_round_trip_and_damage(spark, edges):
    for n in (0, 1, 254, 255, 256, 4000, 70_000, 300_000):
        data = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
        samples, seconds, notes = media.samples_of(media.encode(data, b"hi"))
        assert (samples, notes) == (data, b"hi") and seconds == n / media.RATE
    for n in (0, 4000, 4001, 70_000, 1_500_000):  # over several pages of both streams
        data = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
        packets, notes = media.timed_packets(media.encode(data, b"n" * n))
        ends = [min(n, media.PACKET * (k + 1)) for k in range(-(-n // media.PACKET))]
        assert [(round(a * media.RATE), round(b * media.RATE)) for _, a, b in packets] == (list(zip([0, *ends[:-1]], ends, strict=True)) if n else [])
        assert b"".join(p for p, _, _ in packets) == data and notes == b"n" * n
    file = bytearray(media.encode(b"abc" * 100))
    file[-2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        media.decode(bytes(file))
    crc = 0
    for byte in b"OggS test":
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc >> 31 else crc << 1
    assert media.page_checksum(b"OggS test") == crc
    got = media.media_digests(edges).collect()
    want, _ = media.payload("é" * 300)
    assert len(got) == 10 and {r.payload_sha256 for r in got if r.doc_id == 6} == {hashlib.sha256(want).hexdigest()}


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><div id=cookie-notice>We use cookies, ok?</div><div class="menu"><a href=x>Home</a></div>
<div class="content"><h1>Headline&nbsp;here</h1><p>First &lt;para&gt;, with commas, and length enough to count for points.<p>Second   para &amp; more, text here,
 with <b>bold</b> and <a href=y>links</a>.<form><p>Sign up</p></form><blockquote>Quoted words, rather long, with many commas, in it.</blockquote></div>
<div class="sidebar"><p>Side story, with commas, long enough to be counted, as a paragraph</p></div><section id="comments"><p>Nice article, thanks, really, loved it, so much.</p></section>
<script>var t = "</p>";</script><footer>c</footer></body></html>"""


def test_html_extraction(spark):
    want = "Headline here First <para>, with commas, and length enough to count for points. Second para & more, text here, with bold and links. Quoted words, rather long, with many commas, in it."
    assert html_extract.main_text(PAGE) == want
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, 1), (2, "u", "", 1), (3, "u", "<p", 1), (4, "u", "<div>" * 3000 + "deep", 1)], "page_id long, url string, html string, n_chars int")
    got = html_extract.extract(pages).collect()
    assert [r.text for r in got if r.page_id == 1] == [want, want] and sum(r.n_chars == 0 for r in got) >= 3


def test_mixing_shares_shortage_with_siblings_first(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 10), ("web", "en", "b", 1000), ("books", "en", "c", 1000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.budgets(leaves, 700, 1).collect()}
    assert got == {"a": 10, "b": 490, "c": 200}


def test_mixing_takes_parameters_and_any_number_of_leaves(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = sorted((r.doc_id, r._epoch) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "MOST_LEAVES", 0)
    assert sorted((r.doc_id, r._epoch) for r in mixing.mix(docs).collect()) == want
    few = mixing.mix(docs, budget=500, epochs=1, domain=lambda s: F.lit("one"), domain_weights={"one": 1}, lang_weights={"en": 3, "de": 1})
    rows = few.collect()
    assert {r._domain for r in rows} == {"one"} and 0 < sum(r._tokens for r in rows) <= 500


def test_mixing_edges(spark, edges):
    got = mixing.mix(edges).collect()
    assert {r.doc_id for r in got} <= {None, 1, 2, 3, 4, 5, 6, 7, 9} and mixing.mix(edges.limit(0)).count() == 0
    # rows that repeat an id go together, in every epoch that takes them
    assert all(n == 2 for n in Counter(r._epoch for r in got if r.doc_id == 1).values())


def test_chat(spark):
    rows = [(1, 0, "user", "<|"), (1, 1, "user", "<"), (1, 2, "user", "|im_sep|>"), (1, 3, "a\nb<|n|>", "<||x"), (1, 4, None, None), (None, None, "assistant", ""),
            (2, 1600, "assistant", "y"), (2, 5, "assistant", "x"), (2, 5, "assistant", "x"), (2, None, "system", "z<|im_sep|>")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, runs string")
    got = {r.conv_id: r for r in chat.read_formatted(chat.format_conversations(chat.with_probe(df))).collect()}
    told = lambda turns: hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].turns_sha256 == told([r[2:4] for r in rows[:5]]) and got[1].n_turns == 5
    assert got[2].turns_sha256 == told([("system", "z<|im_sep|>"), ("assistant", "x"), ("assistant", "x"), ("assistant", "y")])
    assert got[2].formatted.count("<|im_start|>") == 2 and got[2].loss_sha256 == hashlib.sha256(b"xxy").hexdigest()
    said = "<|im_end|><|im_start|>assistant ok"
    assert got[-1].turns_sha256 == told([("user", said), ("assistant", said)]) and got[-1].loss_chars == len(said)
    assert got[None].n_turns == 1


def test_queries_run_without_the_pipeline_file():
    assert set(oracle_sql()) <= set(queries()) and F is not None
