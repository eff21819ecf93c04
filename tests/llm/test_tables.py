"""Queries on a whole given table against plain readings of their contracts."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from spendlake.llm import classifier, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_token_files_and_counts_equal_the_library(spark, texts):
    library = Tokenizer.from_file(queries.WORD_BPE)
    at, want = 0, {}
    for doc in sorted(texts):
        ids = [*library.encode(texts[doc], add_special_tokens=False).ids, 2]
        want[doc], at = (at, len(ids), crc(ids)), at + len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op2_token_files(spark, SF).collect()}
    assert got == want
    library = Tokenizer.from_file(queries.BYTE_BPE)
    for r in queries.op8_token_counts(spark, SF).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_packing_of_the_table(spark, texts):
    library = Tokenizer.from_file(queries.BYTE_BPE)
    pieces, used = defaultdict(list), defaultdict(int)
    for r in queries.op1_best_fit_packing(spark, SF).collect():
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        used[r.sequence_id] += r.length
    total = 0
    for doc, text in texts.items():
        ids, at = [*library.encode(text, add_special_tokens=False).ids, 2], 0
        total += len(ids)
        for k, (piece, start, length, digest) in enumerate(sorted(pieces[doc])):
            assert (piece, start, digest) == (k, at, crc(ids[at : at + length]))
            assert len(ids) <= 1024 and length == len(ids) or length == 1024 or k == 0 and len(ids) > 1024
            at += length
        assert at == len(ids)
    assert max(used.values()) <= 1024 and len(used) <= 1.03 * total / 1024 + 2


def test_mix_of_the_table(spark, texts):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()
    size = {d: len(WORD.findall(t)) for d, t in texts.items()}
    held, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        held[r.source] += size[r.doc_id]
        largest[r.source] = max(largest[r.source], size[r.doc_id])
    order = sorted(held, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(held.values()), set(order), {}
    while True:  # those that reach twice their size are closed, the rest shares what is left
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * held[s]}
        if not full:
            target |= share
            break
        target |= {s: 2.0 * held[s] for s in full}
        left, open_ = left - sum(2.0 * held[s] for s in full), open_ - full
    source, taken = {r.doc_id: r.source for r in rows}, defaultdict(int)
    got = sorted(map(tuple, queries.op5_source_mixing(spark, SF).select("doc_id", "size", "source_size", "target", "taken").collect()))
    for doc, n, of_source, aim, words in got:
        s = source[doc]
        assert n == size[doc] and of_source == held[s] and aim == pytest.approx(target[s]) and 0 <= words <= 2 * n and (n == 0 or words % n == 0)
        taken[s] += words
    assert all(abs(taken[s] - target[s]) <= max(0.02 * target[s], largest[s] / 2) for s in order)
    assert got == sorted(map(tuple, queries.op5_source_mixing(spark, SF).select("doc_id", "size", "source_size", "target", "taken").collect()))


def test_fingerprint_links_of_the_table(spark):
    rows = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.op6_simhash_near_dedup(spark, SF).collect()}
    ids = sorted(rows)
    group = {d: d for d in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (rows[a][0] ^ rows[b][0]).bit_count() <= 3 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    assert {d: c for d, (_, c) in rows.items()} == group


def test_classifier_is_the_same_in_every_run(spark):
    sf = "/root/testdata/sf0.01"
    one, two = ({r.doc_id: (r.held_out, r.score, r.predicted) for r in queries.op10_quality_classifier(spark, sf).collect()} for _ in range(2))
    assert one == two
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) and p == int(s >= 0.5) and 0 <= s <= 1 for d, (h, s, p) in one.items())
    held = [(labels[d], p) for d, (h, _, p) in one.items() if h and d in labels]
    share = np.mean([x for x, _ in held])
    assert np.mean([x == p for x, p in held]) > max(share, 1 - share)


def test_classifier_settles_texts_of_one_id(spark):
    """Rows in another order and number of partitions, ids with two texts and two labels, and columns of clashing names."""
    rng = np.random.default_rng(4)
    made = [(k // 2, " ".join(f"{'good' if k // 2 % 2 else 'bad'}{w}" for w in rng.integers(0, 30, 20)), 0.5, "x") for k in range(240)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(120)] + [(5, 0, 1), (5, None, 1)], "doc_id long, quality int, x int")
    schema = "doc_id long, text string, score double, x string"
    one, two = (
        sorted((r.doc_id, r.held_out, r.score, r.predicted) for r in classifier.classify(spark.createDataFrame(rows, schema).repartition(n), labels).collect())
        for rows, n in ((made, 3), (made[::-1], 7))
    )
    assert one == two and len(one) == len(made)
    held = [(d % 2, p) for d, h, _, p in one if h]
    assert np.mean([a == b for a, b in held]) > 0.9
    assert classifier.classify(spark.createDataFrame([], schema), labels).count() == 0
