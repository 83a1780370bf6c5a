"""The pipeline's near-duplicate stage against brute-force Jaccard groups."""

import duckdb
import numpy as np
import pandas as pd

import corpus_pipeline as P
from tensorloom.llm import near_copies as N
from tests.conftest import DATA


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def lowest(docs):
    """The smallest id of each group linked by Jaccard similarity of 0.8 or more."""
    sets = {i: shingles(t) for i, t in docs.items()}
    label = {i: i for i in docs}
    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if label[a] != label[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if v == high else v for i, v in label.items()}
    return set(label.values())


def test_stage_keeps_one_of_each_jaccard_group(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = lowest(dict(duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()))
    got = [r.doc_id for r in P.stage_simhash(spark, docs, DATA).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_near_copies_of_one_base_and_shared_halves(spark):
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    base, half, rows = word(200), word(100), []
    for i in range(60):
        text = list(base)
        for at in rng.choice(200, i % 6, replace=False):
            text[at] = f"new{i}"
        rows.append((i, " ".join(text), "en"))
        rows.append((100 + i, " ".join(half + word(100)), "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id for r in P.stage_simhash(spark, docs, DATA).collect()}
    assert got == lowest({i: t for i, t, _ in rows})


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f", "x"), (1, "quite another text of its own", "x"), (None, "A b  c d e f", "y"), (None, "alone", "y"), (None, "alone", "y"), (3, None, "z"), (2, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = P.stage_simhash(spark, docs, DATA)
    assert out.columns == docs.columns
    assert sorted(map(repr, out.collect())) == sorted(map(repr, docs.where("(doc_id = 1) or doc_id = 2 or text = 'alone'").distinct().collect()))
    assert P.stage_simhash(spark, docs.limit(0), DATA).count() == 0


def test_one_comparison_a_member_and_the_filter_keeps_near_pairs(spark):
    shared = spark.createDataFrame([(s, n, 500) for s in (1, 2) for n in range(500)], "slot long, node long, n long")
    assert N._first_pairs(shared).count() == 499
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
    sets = {}
    for share in (0, 0, 2, 8, 20, 60, 150):
        text = list(base)
        for at in rng.choice(300, share, replace=False):
            text[at] = f"x{share}"
        sets[share, len(sets)] = N.shingle_hashes(" ".join(text))
    for x in sets.values():
        for y in sets.values():
            same = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            differ = int(np.bitwise_count(N._bits(N._minima(x)).view(np.uint64) ^ N._bits(N._minima(y)).view(np.uint64)).sum())
            assert differ <= N.MOST_BITS if same >= 0.8 else differ > 77
            assert abs(differ - 384 * (1 - same)) < 90


def test_members_that_the_first_misses_are_found_across_groups(spark):
    """Two chains that share a band with one another's texts but are not near to its first member."""
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
    rows = []
    for i in range(12):  # each step moves on by some words, so ends of a chain are far apart
        rows.append((i, " ".join([*base[4 * i :], *(f"new{k}" for k in range(4 * i))]), "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in P.stage_simhash(spark, docs, DATA).collect()} == lowest({i: t for i, t, _ in rows})


def family(rng, n, spread):
    """A set of n hashes and one with the most differing members that a similarity of 0.8 allows, spread to the sides in the given part."""
    common = next(c for c in range(n, 0, -1) if 5 * (c - 1) < 4 * n)
    mine = round((n - common) * spread)
    x = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    return x[: common + mine], np.concatenate((x[:common], x[common + mine :]))


def test_fingerprint_is_a_majority_of_each_bit():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 254, 255, 256, 700):
        hashes = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        mixed = []
        for step in map(int, N.STEPS):
            for h in map(int, hashes):
                x = (h + step) % (1 << 64)
                x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
                x = (x ^ (x >> 27)) * 0x94D049BB133111EB % (1 << 64)
                mixed.append(x ^ (x >> 31))
        want = [sum((2 * sum(x >> bit & 1 for x in mixed[w * n : w * n + n]) > n) << bit for bit in range(64)) for w in range(N.WORDS)]
        assert N.fingerprint(hashes).tolist() == want


def test_pairs_at_the_limit_share_a_posting_and_pass_the_count_filter():
    rng = np.random.default_rng(5)
    for n in (10, 15, 16, 25, 26, 40, 80, 300):
        for spread in (0, 0.5, 0.7, 1) * 10:
            sets = family(rng, n, spread)
            assert 5 * len(np.intersect1d(*sets)) >= 4 * len(np.union1d(*sets))
            nodes = pd.DataFrame({"node": [1, 2], "fp": [N.fingerprint(x).tobytes() for x in sets], "size": [len(x) for x in sets]})
            laid = pd.concat(N._postings(iter([nodes]))).sort_values("posting")
            got = pd.concat(N._link_lists(iter([laid])))
            assert set(zip(got.kind, got.a, got.b, strict=True)) == {(0, 1, 2)} and N._alike(nodes.fp[:1], nodes.fp[1:]).all()
    others = pd.Series([N.fingerprint(rng.integers(0, 1 << 64, 100, dtype=np.uint64)).tobytes() for _ in range(2)])
    assert not N._alike(others[:1], others[1:]).any()


def test_lists_give_their_pairs_or_their_members(monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(N, "LIST_LIMIT", 30)
    rows, want = [], set()
    for slot in (-5, -2, 0, 3, 9, 10, 11):
        base = int(rng.integers(0, 1 << 62))
        size = {-2: 100, 3: 25, 10: 31}.get(slot, 6)
        near = {3: 20, -2: 100}.get(slot, 2)
        ids = [1000 * (slot + 6) + i for i in range(size)]
        for i in ids:
            more = base ^ (1 << (i % 60)) if i - ids[0] < near else int(rng.integers(0, 1 << 62))
            rows.append(((slot << N.FILTER_BITS) | (1 if i - ids[0] < near else int(rng.integers(0, 1 << 40))), more, i))
        if size > 30:
            want |= {(1, i, slot) for i in ids}
        elif near > 10:
            want |= {(1, i, slot) for i in ids[:near]}
        else:
            want.add((0, ids[0], ids[1]))
    laid = pd.DataFrame(sorted(rows), columns=["posting", "more", "node"])
    for batch_rows in (1, 40, 10**6):
        monkeypatch.setattr(N, "BATCH_ROWS", batch_rows)
        got = pd.concat(N._link_lists(iter([laid[i : i + 17] for i in range(0, len(laid), 17)])))
        assert {x for x in zip(got.kind, got.a, got.b, strict=True) if x[0] or x in want} == want and len(got) < len(want) + 20


def test_short_texts_with_one_more_word(spark):
    """Sets of four and five shingles, whose bits differ most at a similarity of 0.8."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(0, 1200, 2):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 9)]
        rows += [(i, " ".join(words), "en"), (i + 1, " ".join(words[:8]), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in P.stage_simhash(spark, docs, DATA).collect()} == set(range(0, 1200, 2))
    assert all(5 * len(shingles(a[1]) & shingles(b[1])) >= 4 * len(shingles(a[1]) | shingles(b[1])) for a, b in zip(rows[::2], rows[1::2], strict=True))


def rows_of_left_joins(plan):
    """Rows that the left outer joins of an executed plan made."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return rows_of_left_joins(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return rows_of_left_joins(plan.plan())
    below = plan.children()
    own = plan.metrics().apply("numOutputRows").value() if kind.endswith("JoinExec") and plan.joinType().toString() == "LeftOuter" else 0
    return own + sum(rows_of_left_joins(below.apply(i)) for i in range(below.size()))


def test_a_member_of_many_lists_meets_its_group_as_one_row(spark, monkeypatch):
    """Twelve texts in a row of near ones, in two groups cut in the middle and the last one alone; all share 30 lists, four of a group 50 more."""
    base = [f"w{x}" for x in range(100)]
    texts = [" ".join([*base[2 * i :], *(f"new{k}" for k in range(2 * i))]) for i in range(12)]
    group = {i: 0 if i < 6 else 6 for i in range(11)}
    rows = spark.createDataFrame(list(enumerate(texts)), "_node long, text string")
    lists = [(s, i) for s in range(-10, 20) for i in range(12)] + [(s, i) for s in range(100, 150) for i in range(4)]
    shared = spark.createDataFrame(lists, "slot long, node long")
    parts = spark.createDataFrame(list(group.items()), "node long, component long")
    made, write = [], N.materialize

    def counted(df, name):
        df.collect()
        made.append(rows_of_left_joins(df._jdf.queryExecution().executedPlan()))
        return write(df, name)

    monkeypatch.setattr(N, "materialize", counted)
    got = [tuple(r) for r in N._across_groups(rows, shared, parts).collect()]
    sets = [shingles(t) for t in texts]
    near = {(i, k) for i in range(12) for k in range(i + 1, 12) if 5 * len(sets[i] & sets[k]) >= 4 * len(sets[i] | sets[k])}
    want = {(i, k) for i, k in near if group.get(i, i) != group.get(k, k)}
    assert len(want) > 2 and want <= set(got) and len(got) == len(set(got))
    assert all(group.get(i, i) != group.get(k, k) for i, k in got)
    assert 12 <= sum(made) <= 2 * 12
