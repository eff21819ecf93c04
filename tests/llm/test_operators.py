"""The training-data operators against brute force, and their edge cases."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spendlake.llm import bpe, classifier, components, hnsw, licenses, mixing, near_copies, packing, queries, rules, simhash, substring, token_files, tokens
from tests import compare

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, windows string"
PASSAGE = " ".join(f"word{k}" for k in range(60))
ROWS = [
    (1, None, "en", None, None, 7, "x"),
    (2, "", "en", "a", 0, None, None),
    (3, " \n\t ", None, "a", 3, 1, "y"),
    (4, "Released under the MIT License. " + PASSAGE, "en", "b", 1, 1, "z"),
    (5, "start " + PASSAGE + " end", "en", "b", 1, 1, "z"),
    (5, "start " + PASSAGE + " end", "en", "b", 1, 1, "z"),
    (None, "start " + PASSAGE, "en", "c", 1, 1, "z"),
    (7, "it's <|endoftext|> É ß 日本 😀 'll " + "a" * 5000, "en", "c", 1, 1, "z"),
    (8, " ".join(f"long{k % 977}" for k in range(20000)), "en", "a", 1, 1, "z"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_token_counts(edge):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in tokens.token_counts(edge, queries.BYTE_BPE).collect())
    assert got == sorted((r[0] or -1, len((r[1] or "").encode()), len(ids(queries.BYTE_BPE, r[1]))) for r in ROWS)
    assert tokens.token_counts(edge.limit(0), queries.BYTE_BPE).count() == 0


def test_packing(edge):
    out = packing.pack(edge, queries.BYTE_BPE).toPandas().sort_values(["sequence_id", "offset"])
    assert (out.groupby("sequence_id").length.cumsum() - out.length == out.offset).all()
    assert out.groupby("sequence_id").length.sum().max() <= 1024
    for doc in (1, 7, 8):
        whole = ids(queries.BYTE_BPE, next(r[1] for r in ROWS if r[0] == doc)) + [2]
        pieces = out[out.doc_id == doc].sort_values("piece")
        assert [crc(whole[s : s + n]) for s, n in zip(pieces.start, pieces.length, strict=True)] == pieces.ids_crc32.tolist()
        assert pieces.length.sum() == len(whole)
    assert packing.pack(edge.limit(0), queries.BYTE_BPE).count() == 0


def test_packing_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    lengths = np.concatenate([rng.integers(1, 1025, 5000), np.full(4000, 700), np.full(900, 3)])
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    runs = packing.plan(histogram, 1024)
    used = np.zeros(1025, int)
    for n, items in runs:
        assert sum(items) <= 1024
        np.add.at(used, items, n)
    assert {k: v for k, v in enumerate(used.tolist()) if v} == histogram
    assert len(runs) < 20_000
    thirds = {k: 1000 for k in range(330, 360)}
    assert sum(n for n, _ in packing.plan(thirds, 1024)) <= 11_200  # best fit alone takes a tenth more


def test_token_files(edge):
    out = token_files.round_trip(edge, queries.WORD_BPE).toPandas().sort_values(["start"])
    at = 0
    for r in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        row, whole = out.iloc[0], ids(queries.WORD_BPE, r[1]) + [2]
        out = out.iloc[1:]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(whole), crc(whole))
        at += len(whole)


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    for x in ([], [0], [2**32 - 1, 0], [5] * 1000, rng.integers(0, 50_000, 5000), np.where(rng.random(3000) < 0.02, 2**31 + 7, rng.integers(0, 9, 3000))):
        x = np.array(x, np.uint32)
        assert np.array_equal(token_files.decode_blocks(*token_files.encode_blocks(x)), x)


def test_substring(edge, docs):
    for df in (edge, docs):
        got = {r.doc_id: r for r in substring.dedup(df).withColumn("sha", F.sha2("kept_text", 256)).collect()}
        seen = {}
        for i, t in sorted(((r.doc_id, r.text) for r in df.collect() if r.doc_id is not None), key=lambda r: r[0]):
            words, gone = WORD.findall(t or ""), set()
            for k in range(len(words) - 12):
                if seen.setdefault(tuple(words[k : k + 13]), i) < i:
                    gone.update(range(k, k + 13))
            kept = " ".join(w for k, w in enumerate(words) if k not in gone)
            assert (got[i].n_words, got[i].n_removed, got[i].sha) == (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substring.dedup(edge).count() == len(ROWS)
    assert substring.dedup(edge.limit(0)).count() == 0


def brute_substring(rows):
    """`doc_id` to words left and removed, by a look at every window of every document."""
    seen, out = {}, {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0]):
        words, gone = WORD.findall(t or ""), set()
        for k in range(len(words) - 12):
            if seen.setdefault(tuple(words[k : k + 13]), i) < i:
                gone.update(range(k, k + 13))
        out[i] = (" ".join(w for k, w in enumerate(words) if k not in gone), len(gone))
    return out


@pytest.mark.parametrize("bits", [64, 5])
def test_substring_windows_of_one_hash_take_more_rounds(spark, bits):
    rng = np.random.default_rng(bits)
    passages = [" ".join(f"p{k}w{j}" for j in range(n)) for k, n in enumerate([13, 14, 16, 20, 20, 30])]
    rows = [(i, " ".join([f"u{i}", *(f"{passages[k]} v{i}x{n}" for n, k in enumerate(rng.integers(0, 6, 3)))])) for i in range(-4, 10)]
    rows += [(20, "same " * 40), (21, "same " * 30 + passages[0]), (22, passages[0] + " " + passages[5]), (23, None), (24, ""), (None, passages[5])]
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string"), bits=bits).collect()
    assert {r.doc_id: (r.kept_text, r.n_removed) for r in got if r.doc_id is not None} == brute_substring(rows)
    assert [(r.kept_text, r.n_removed) for r in got if r.doc_id is None] == [(passages[5], 0)]


def test_substring_rows_of_one_id(spark):
    rows = [(1, PASSAGE), (1, "other " + PASSAGE[200:]), (2, "x " + PASSAGE), (2, "y " + PASSAGE[200:]), (2, "z")]
    for bits in (64, 3):
        got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string"), bits=bits).collect()
        assert sorted(r.text for r in got) == sorted(t for _, t in rows)
        removed = {r.text: r.n_removed for r in got}
        assert [removed[t] for i, t in rows if i == 1] == [0, 0] and removed["z"] == 0
        if bits == 64:
            assert [removed[t] for i, t in rows if i == 2] == [60, len(PASSAGE[200:].split()), 0]


def test_substring_words_of_one_polynomial_hash(spark):
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    tail = " " + " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, word + tail), (2, word.translate(str.maketrans("ab", "ba")) + tail), (3, word + tail)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.dedup(docs).collect()} == {1: 0, 2: 0, 3: 13}


def test_runs_without_a_piece_start():
    source = open(queries.BYTE_BPE, "rb").read()
    encoder = bpe.Encoder(source, *bpe.probe(source))
    rng = np.random.default_rng(7)
    texts = ["a" * n for n in (255, 256, 257, 512, 5000)] + ["ab" * 3000, "é" * 3000, "".join(rng.choice(list("abcdefgh"), 4000)), "x" * 700 + " " + "y" * 900]
    counts, got = encoder.encode(pa.array(texts))
    want = encoder.by_library(texts)
    assert counts.tolist() == [len(w) for w in want] and np.array_equal(got, np.concatenate(want))


def test_simhash(spark, edge):
    def fingerprint(t):
        words = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = WORD.findall(words)
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))] if words else []
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))

    out = simhash.groups(edge).toPandas()
    assert sorted(out.fingerprint) == sorted(f"{fingerprint(r[1]):016x}" for r in ROWS)
    named = dict(zip(out.doc_id, out.component_id, strict=True))
    assert named[1] == named[2] == named[3] == 1
    assert simhash.groups(edge.limit(0)).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    out = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(out[k] == 0 for k in range(51)) and all(out[k] == 100 for k in range(100, 160))


def test_hnsw(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16))
    x[300:] = x[:300] + rng.normal(size=(300, 16)) * 0.15
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, x[0].tolist()), (901, None), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0]), (905, [None, 1.0])]
    out = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas().set_index("vec_id")
    u = np.vstack([x, x[:1]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    assert out.n_links.reindex([*range(600), 900]).tolist() == (near.sum(axis=1) - 1).tolist()
    assert out.loc[[901, 902, 903, 904, 905]].n_links.tolist() == [0] * 5 and out.loc[[901, 902, 903, 904, 905]].kept.all()
    assert out.component_id[900] == 0 and not out.kept[900]


@pytest.mark.parametrize("noise", [0.02, 0.06])
def test_hnsw_beams_widen_on_the_graph(noise):
    """A shard of 6,000 rows, groups of 120 and of two: links found through the graph, wider beams where a beam is full of them."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(2010, 32))
    group = np.concatenate([np.repeat(np.arange(10), 120), np.repeat(np.arange(10, 410), 2), np.arange(410, 2010), np.repeat(np.arange(1000, 1200), 12)])
    x = centres[group] + rng.normal(size=(len(group), 32)) * noise * 4
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph = hnsw.Graph.build(x)
    found, beams = hnsw.linked(graph, x, 0.95)
    truth = x @ x.T >= 0.95 - 1e-4
    shares = [truth[k][f].sum() / truth[k].sum() for k, f in enumerate(found)]
    assert np.mean(shares) >= 0.99 and all(truth[k][f].all() for k, f in enumerate(found))
    assert (beams == 0).mean() < 0.25 and (beams > 0).any()
    assert {hnsw.BEAM} < set(beams[beams > 0].tolist()) | {0}


def test_mixing(edge, docs):
    for df in (edge, docs):
        out = mixing.mix(df).toPandas()
        assert len(out) == df.count() and (out.taken <= 2 * out["size"]).all()
        assert abs(out.taken.sum() - 1.5 * out["size"].sum()) <= 0.05 * out["size"].sum() + out["size"].max()
    again = mixing.mix(docs).toPandas()
    assert out.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert mixing.targets([("a", 100), ("b", 10), (None, 50)], (3, 1, 2), 1.5, 2) == {"b": 20.0, None: 88.0, "a": 132.0}
    assert mixing.mix(edge.limit(0)).count() == 0


def test_licenses(spark, edge, docs):
    out = {r.doc_id: r for r in licenses.scan(edge).collect()}
    assert (out[4].n_base, out[4].first_word, out[4].base_labels, out[4].labels, out[4].score) == (1, 3, "mit", "mit", 1.0)
    assert out[1].n_words == 0 and out[1].first_word is None and out[1].labels == ""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in licenses.scan(docs).join(docs, "doc_id").collect():
        words = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        places = [k for p in licenses.PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
    assert licenses.scan(edge.limit(0)).count() == 0


def test_license_notice_in_a_third_of_rows(spark):
    for label, body, _ in licenses.TEMPLATES[::3]:
        for n in (1, 30):
            rows = [(k, body.upper() if k % 3 == 0 else f"plain text {k}") for k in range(n)]
            got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
            held = ",".join(sorted({label} | {x for p, x in licenses.PHRASES.items() if p in body}))
            assert got == {k: (held, 1.0) if k % 3 == 0 else ("", 0.0) for k in range(n)}, (body, n)


def test_rules(spark, edge):
    assert compare.rows(queries.op9_quality_rules(spark, SF).toPandas()) == compare.rows(compare.oracle(SF, rules.SQL))
    assert rules.judge(edge).count() == len(ROWS) and rules.keep(edge).columns == edge.columns
    assert rules.judge(edge.limit(0)).count() == 0


def test_classifier(spark, edge):
    out = queries.op10_quality_classifier(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = out[out.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() >= 0.93 and out.score.between(0, 1).all()
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in classifier.classify(edge, none).collect()} == {0.5}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() and set(out.columns) >= {"doc_id", "piece", "sequence_id", "offset"}
    assert out.select("doc_id").distinct().count() <= docs.count()


def test_near_dedup_decides_on_similarity(spark, edge):
    rng = np.random.default_rng(5)
    texts = [None, "", "Same words here", "same  WORDS here", "one two three four five six seven eight", "one two three four five six seven eight nine"]
    for _ in range(150):
        words = [f"w{k}" for k in rng.integers(0, 5000, rng.integers(40, 200))]
        texts.append(" ".join(words))
        for _ in range(3):
            copy = [w if rng.random() > 0.03 else "edited" for w in words]
            texts.append(" ".join(copy))
    texts += texts[6:30]
    sets = []
    for t in texts:
        words = WORD.findall((t or "").lower())
        sets.append(frozenset(" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset())
    group, like = list(range(len(texts))), lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    for b in range(len(texts)):
        for a in range(b):
            if group[a] != group[b] and like(sets[a], sets[b]):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dict(near_copies.groups(docs).collect()) == dict(enumerate(group))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == sorted(set(group))
    assert near_copies.groups(edge).count() == len(ROWS) and near_copies.groups(edge.limit(0)).count() == 0


def test_nearest_forest():
    rng = np.random.default_rng(6)
    u, v, w = rng.integers(0, 60, 300), rng.integers(0, 60, 300), rng.integers(0, 9, 300)
    u, v, w = u[u != v], v[u != v], w[u != v]
    label, total = list(range(60)), []
    for k in np.argsort(w, kind="stable"):
        p, q = label[u[k]], label[v[k]]
        if p != q:
            label, total = [p if x == q else x for x in label], [*total, w[k]]
    got = near_copies.nearest_forest(u, v, w)
    assert len(got) == len(total) and w[got].sum() == sum(total)
