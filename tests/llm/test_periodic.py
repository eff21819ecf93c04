"""Periodic runs against brute force."""

import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spendlake.llm import periodic, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(words, least=12):
    """Every run: of each period the longest stretches, then the smallest period of each stretch."""
    n, out = len(words), {}
    names = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if words else np.zeros(0, int)
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[0], (names[:-q] == names[q:]).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(same))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a + q >= max(least, 2 * q):
                out.setdefault((a, b + q), q)
    return sorted((a, b - a, q) for (a, b), q in out.items())


def found(texts, least=12):
    words = [WORD.findall(t) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    flat = [w for ws in words for w in ws]
    numbers = np.unique(np.array(flat, dtype=object), return_inverse=True)[1].astype(np.int64) if flat else np.zeros(0, np.int64)
    at, start, length, period = periodic.runs(numbers, first, least)
    return [list(zip(start[at == k].tolist(), length[at == k].tolist(), period[at == k].tolist(), strict=True)) for k in range(len(texts))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=9), st.integers(1, 12)), max_size=6), st.integers(2, 12))
def test_runs_of_repeated_blocks(blocks, least):
    text = " ".join(" ".join(b * k) for b, k in blocks)
    assert found([text], least) == [brute(WORD.findall(text), least)]


def test_runs_of_random_words_and_powers():
    rng = np.random.default_rng(0)
    fib, pair = "a", "ab"
    while len(pair) < 800:
        fib, pair = pair, pair + fib
    thue = "a"
    while len(thue) < 600:
        thue += thue.translate(str.maketrans("ab", "ba"))
    texts = ["", " ".join("a" * 700), " ".join(pair), " ".join(thue)]
    for size in (2, 3):
        for _ in range(150):
            texts.append(" ".join(rng.choice(list("abc")[:size], rng.integers(1, 220))))
    for _ in range(100):
        root = rng.choice(list("abcd"), rng.integers(1, 60)).tolist()
        cut = rng.integers(0, 5)
        texts.append(" ".join(["x"] * cut + root * int(rng.integers(2, 6)) + root[: rng.integers(0, len(root) + 1)] + ["y"] * cut))
    for least in (2, 12):
        assert found(texts, least) == [brute(WORD.findall(t), least) for t in texts]


def rewritten(doc, text):
    words, h = WORD.findall(text or ""), zlib.crc32(str(doc).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc, words):
    runs, gone = brute(words), set()
    for s, n, q in runs:
        gone.update(range(s + q, s + n))
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(kept))


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(expected(r.doc_id, rewritten(r.doc_id, r.text)) for r in docs.collect())
    got = queries.QUERIES["op13_periodic_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == want
    assert any(r[1] for r in want)


def test_edges(spark):
    odd = "a b " * 3000
    rows = [(1, None, "x", 1), (2, "", "x", 2), (None, "a b " * 6, "y", 3), (4, odd, "z", 4), (4, odd, "z", 4), (5, "\t ha ha\nha ha ha ha ha ha ha ha ha ha é", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, `a.b` int")
    out = periodic.find(docs, prefix="_").collect()
    assert len(out) == 6 and out[0].asDict().keys() == {"doc_id", "text", "runs", "a.b", "_n_words", "_runs", "_kept_text"}
    got = {r["a.b"]: (r["_n_words"], [tuple(x) for x in r["_runs"]], r["_kept_text"]) for r in out}
    assert got[1] == got[2] == (0, [], "")
    assert got[3] == (12, [(0, 12, 2)], "a b") and got[4] == (6000, [(0, 6000, 2)], "a b")
    assert got[None] == (13, [(0, 12, 1)], "ha é")
    assert {r["runs"] for r in out} == {"x", "y", "z", None}
    assert periodic.find(docs.drop("runs").limit(0)).count() == 0 and periodic.digest(docs.limit(0)).count() == 0
    assert periodic.planted(docs).count() == 6


def test_word_numbers_of_one_hash(monkeypatch):
    """Words are told apart although all have one hash."""
    monkeypatch.setattr(periodic.text, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    words = ["longer than eight", "anotherwordoften", "anotherwordoften", "x", "longer_than_eigh2", "x"]
    words = [w.replace(" ", "_") for w in words]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    got = periodic.word_numbers(data, ends - [len(w) for w in words], ends).tolist()
    assert [[a == b for b in got] for a in got] == [[a == b for b in words] for a in words]
