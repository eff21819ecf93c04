"""Ids over the whole long range, negative, null and repeated ones: no row may lose its component."""

import numpy as np
import pytest

import corpus_pipeline
from spendlake.llm import components, hnsw, near_copies, simhash

LARGE = [9000000000000000000, 9000000000000000001, 2**63 - 1, -(2**63), -5, 0, 7, 0x7000000000000000, 0x7000000000000001, 0x6FFFFFFFFFFFFFFF]


def families(seed=3, n=12, copies=3):
    """Texts of `n` families of near copies, far from each other."""
    rng = np.random.default_rng(seed)
    out = []
    for f in range(n):
        words = [f"f{f}w{k}" for k in rng.integers(0, 900, 80)]
        out += [" ".join([*words[:40], f"edit{c}", *words[40:]]) if c else " ".join(words) for c in range(copies)]
    return out


def smallest(groups, ids):
    """Smallest non-null id of each group of row numbers, by row."""
    out = {}
    for rows in groups:
        own = [ids[r] for r in rows if ids[r] is not None]
        out |= {r: min(own) if own else None for r in rows}
    return out


@pytest.mark.parametrize("nulls", [False, True])
def test_components_bear_the_smallest_id(spark, nulls):
    rng = np.random.default_rng(1)
    texts = families()
    ids = [*LARGE, *(int(x) for x in rng.integers(-(2**63), 2**63 - 1, len(texts) - len(LARGE)))]
    rng.shuffle(ids)
    ids = [int(x) for x in ids]
    if nulls:
        ids = [None if k % 5 == 0 or k < 3 else x for k, x in enumerate(ids)]  # the first family has null ids only
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    want = smallest([range(k, k + 3) for k in range(0, len(texts), 3)], ids)
    pairs = sorted(((ids[r], want[r]) for r in want), key=str)
    assert sorted(((r.doc_id, r.component_id) for r in near_copies.groups(docs).collect()), key=str) == pairs
    kept = {x for x in want.values() if x is not None}
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(x for x in got if x is not None) == sorted(kept) and got.count(None) == ids.count(None)

    base = rng.normal(size=(len(texts) // 3, 16))
    vectors = np.repeat(base, 3, axis=0) + rng.normal(size=(len(texts), 16)) * 0.001
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    out = hnsw.near_duplicates(rows).collect()
    assert sorted(((r.vec_id, r.component_id) for r in out), key=str) == pairs
    assert all(r.n_links == 2 and r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in out)


def test_fingerprint_groups_of_large_ids(spark):
    texts = ["same text of a few words"] * 2 + ["other words stand here alone"] * 2 + ["third"]
    ids = [9000000000000000001, 9000000000000000000, None, 2**63 - 1, -(2**63)]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.groups(docs).collect()), key=str)
    assert got == sorted([(9000000000000000001, 9000000000000000000), (9000000000000000000, 9000000000000000000), (None, 2**63 - 1), (2**63 - 1, 2**63 - 1), (-(2**63), -(2**63))], key=str)


def test_numbers_are_of_one_node_each(spark):
    nodes = spark.range(40).selectExpr("case when id % 2 = 0 then id - 20 end as first", "id as mark")
    for kind, want in (("bigint", "below"), ("string", "none")):
        out, ids = components.numbered(nodes, "first", kind)
        assert ids == want and out.select("node").distinct().count() == 40
    assert components.numbered(nodes.filter("first is not null"), "first", "bigint")[1] == "all"
    assert components.numbered(nodes.selectExpr("cast(null as bigint) as first"), "first", "bigint")[1] == "below"


def test_stage_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a few words", "x", 1, 2), (2, "a few words", "x", 3, 4)], "doc_id long, text string, source string, `a.b` int, `node` int")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() >= 1, name
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
