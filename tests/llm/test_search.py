"""Ranked search against SQL and brute force."""

import math
import re
from collections import Counter

import pytest

from spendlake.llm import queries, search
from tests import compare

SF = "/root/testdata/sf0.001"


def terms(text):
    return re.findall(search.TERM, (text or "").translate(str.maketrans(search.UPPER, search.LOWER)))


def brute(docs, items, k=10):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, total = sum(n > 0 for *_, n in counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    wanted, out = {}, []
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    for item, words in wanted.items():
        rows = []
        for doc, c, n in counted:
            score = 0
            for t in words & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // total)))
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def test_query_equals_sql(spark):
    got = queries.QUERIES["op11_ranked_search"](spark, SF)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert compare.rows(got.toPandas()) == compare.rows(compare.oracle(SF, search.SQL))


@pytest.mark.parametrize(("block", "held"), [(1 << 20, 1 << 21), (40, 8)])
def test_edges(spark, monkeypatch, block, held):
    monkeypatch.setattr(search, "HELD", held)
    long_ = "alpha beta " * 4000 + "GAMMA"
    docs = [
        (1, None), (2, ""), (3, " .,!\n"), (4, "Alpha-beta ALPHA_gamma; alpha"), (4, "Alpha-beta ALPHA_gamma; alpha"), (None, "alpha beta"), (9, "alpha beta"), (8, "alpha beta"), (7, long_),
        (10, "alphabet balpha alphaé Éclair été"), (11, "日本 alpha日本 日本"), (12, "éclair Éclair"), *[(20 + k, f"delta word{k}") for k in range(30)],
    ]
    items = [(1, "alpha"), (2, "Alpha beta gamma, alpha"), (3, None), (4, ""), (5, "nowhere to be found"), (None, "日本 Éclair"), (6, "delta"), (7, "beta"), (7, "gamma"), (8, "x")]
    got = search.search(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as term", "2 as item", "3 as `a.b`"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id string, text string")
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in search.search(docs, items).collect()] == [("1", 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 8 * 100)))]
