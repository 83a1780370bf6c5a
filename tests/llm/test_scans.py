"""Periodic runs, fill-in-the-middle and license scans against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tensorloom.llm import fill_middle, licenses, runs
from tensorloom.llm.entries import oracle_sql, queries
from tests.conftest import DATA
from tests.llm.test_operators import edges, frame  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=12):
    """Every stretch that keeps a period, by trying all periods; the smallest period of a stretch counts."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least, 2 * q))


def plain_collapsed(words, found):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=40), st.text("abc", max_size=12), st.integers(0, 9)), max_size=4), st.sampled_from([2, 5, 12]))
def test_runs_equal_all_periods(parts, least):
    texts = [" ".join(head + body * times) for head, body, times in parts]
    for text, (found, collapsed, n) in zip(texts, runs.find_in_texts(texts, least), strict=True):
        words = text.split()
        want = plain_runs(words, least)
        assert n == len(words) and found == want and collapsed == plain_collapsed(words, want)


def test_runs_of_blocks_and_long_texts(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    want = runs.find_in_texts(texts, 4)
    monkeypatch.setattr(runs, "BLOCK_WORDS", 90)
    assert runs.find_in_texts(texts, 4) == want
    assert runs.find_in_texts([" ".join(["x"] * 300_000)], 12)[0][0] == [(0, 300_000, 1)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    assert runs.find_in_texts([" ".join(fib[-1])], 2)[0][0] == plain_runs(fib[-1], 2)


def plain_row(i, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    found = plain_runs(words)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines), sha(plain_collapsed(words, found)))


def test_runs_query_equals_plain_version(spark):
    docs = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet' where length(text) < 6000").fetchall()
    want = {i: plain_row(i, t) for i, t in docs}
    got = {r.doc_id: tuple(r) for r in queries()["op11_periodic_runs"](spark, DATA).collect()}
    assert len(got) == 200 and all(got[i] == row for i, row in want.items())
    assert sum(row[1] > 0 for row in want.values()) > 10


def test_runs_edges(spark, edges):  # noqa: F811
    planted = runs.with_planted_period(edges)
    got = runs.run_digests(runs.find_runs(planted)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_row(r.doc_id, r.text) for r in edges.collect())
    assert runs.find_runs(edges.limit(0)).count() == 0
    direct = {r.doc_id: r for r in runs.find_runs(edges).where("doc_id = 1").collect()}
    assert direct[1].n_words == 480 and [tuple(x) for x in direct[1].runs] == [(0, 480, 12)] and direct[1].collapsed.startswith("The quick brown")


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_middle(i, text, unit="word"):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    tokens = TOKEN.findall(text) if unit == "word" else list(text)
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


PIECES = st.lists(st.sampled_from(["a", " ", "\t\n", "é", "日本", "😀", " ", "<", "<P", "<P>", "S>", "\x0b", "z9"]), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES, st.integers(-5, 10**12))
def test_middle_equals_plain_version(text, i):
    for unit in ("word", "char"):
        n, form, lead, mid, out = fill_middle.lay_out(text.encode(), str(i), 42, 50, 80, unit)
        assert (n, form, lead, mid, out.decode()) == plain_middle(i, text, unit)
    n, form, lead, mid, out = fill_middle.lay_out(text.encode(), str(i), 42, 100, 80, "byte")
    out.decode()  # no character is cut
    assert n == len(text.encode())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_index_converts_every_place(text):
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    index = fill_middle.Exceptions.of(raw)
    starts = [len(text[:k].encode("utf-8", "surrogatepass")) for k in range(len(text) + 1)]
    assert [index.to_bytes(k) for k in range(len(text) + 1)] == starts
    assert [index.to_chars(b) for b in starts] == list(range(len(text) + 1))
    assert [index.begins(b) for b in range(len(raw) + 1)] == [max(s for s in starts if s <= b) for b in range(len(raw) + 1)]


def test_middle_edges(spark, edges):  # noqa: F811
    more = edges.unionByName(frame(spark, [(12, "x <S> y", "en", "s"), (13, "é" * 9 + " " + "語" * 200_000, "en", "s")]))
    got = fill_middle.restore(fill_middle.fill_in_middle(more)).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got) == Counter((r.doc_id, *plain_middle(r.doc_id, r.text), r.text or "") for r in more.collect())
    assert fill_middle.fill_in_middle(edges.limit(0)).count() == 0
    broken = fill_middle.fill_in_middle(more, rate=100).where("form = 'spm'").selectExpr("form", "replace(output, '<M>', '') as output")
    with pytest.raises(Exception, match="marks do not fit"):
        fill_middle.restore(broken).collect()
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(edges, unit="line")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(text):
    """Base columns by looking at every place, and whether a whole notice stands anywhere."""
    w = words_of(text)
    places = [(k, label) for phrase, label in licenses.PHRASES for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p]
    whole = {label for notice, label in licenses.NOTICES for p in [notice.split()] for k in range(len(w)) if w[k : k + len(p)] == p}
    at = [k for k, _ in places]
    labels = {x for _, x in places}
    return (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(labels))), labels | whole


@pytest.mark.parametrize("name", ["op12_fill_middle", "op13_licenses"])
def test_scan_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    con.execute("set threads = 4")
    df = queries()[name](spark, DATA)
    got, want = Counter(map(tuple, df.collect())), con.execute(oracle_sql()[name])
    assert [d[0] for d in want.description] == df.columns
    assert got == Counter(want.fetchall())


def test_license_cases(spark, edges):  # noqa: F811
    mit = licenses.NOTICES[9][0]
    text = mit.split()
    cases = {
        1: "Under the GNU General\nPublic-License; GNU General Public License.", 2: "CC BY-NC 4.0 and cc by, MIT License", 3: None, 4: "", 5: "apachelicense mit  licenses",
        6: " ".join(text).upper(), 7: " ".join(text[:8] + ["really"] + text[8:]), 8: " ".join(text[:7] + text[8:]), 9: " ".join(text[:9]), 10: " ".join(x for w in text for x in (w, "filler")),
        11: ("mit license " * 5000) + "gnu general public license", 12: "Ünï MIT éé License mit\tlicense", 13: "Licensed under CC BY-NC 4.0.", 14: "x " * 70_000 + "cc by",
    }
    rows = frame(spark, [(i, t, "en", "s") for i, t in cases.items()])
    got = {r.doc_id: r for r in licenses.license_labels(rows).collect()}
    for i, t in cases.items():
        want, labels = plain_base(t)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want, i
        assert labels <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert (r.score == 0) == (r.labels == "")
    assert [("mit-notice" in got[i].labels) for i in (6, 7, 8, 9, 10)] == [True, True, True, False, False]
    assert got[6].score == 1 and 0.8 <= got[8].score < 1 and got[13].labels == "cc-by,cc-by-nc-4.0"
    both = edges.unionByName(rows.where("doc_id < 3")).unionByName(rows.where("doc_id < 3"))
    told = licenses.license_labels(both).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base) for r in told) == Counter((r.doc_id, *plain_base(r.text)[0][:2]) for r in both.collect())
    assert licenses.license_labels(edges.limit(0)).count() == 0


def test_license_votes_in_pieces(spark, monkeypatch):
    rows = frame(spark, [(1, "a b " + licenses.NOTICES[11][0] + " mit license " * 3, "en", "s")])
    want = licenses.license_labels(rows).collect()
    monkeypatch.setattr(licenses, "PIECE", 3)
    assert licenses.license_labels(rows).collect() == want and want[0].n_base == 3 and "bsd" in want[0].labels
