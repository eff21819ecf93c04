"""Ranked lexical search of all documents for each item, by an Aho-Corasick scan of their texts.

The terms of all items, each between two guards, make one automaton. A text is scanned with every character that
no term can hold turned into a guard, so the automaton gives exactly the whole words that are terms, and their
number in a document is its tf. No index of documents is made; texts are scanned twice. The first scan counts the
documents that hold each term, with a sum for each task. The second scores: the outputs of the automaton map to the
items that hold the term, and a task keeps the best `k` documents of each item. These meet in two windows, the
first within parts of the documents, so that no task sees more than a part of the partial results.

What tasks are given is bounded: items are dealt into blocks of about `BLOCK_BYTES` of terms, and each block has its own
automaton and scans. An item is never cut, so a block holds one item's terms at least.

Rows: null texts have no terms; documents without terms don't count among the documents. Repeated documents are
documents each, and take a rank each. Rows of one `item_id` are one item with the terms of all of them; a null one is an
item too. Ties of score go by ascending `doc_id`, null last. Texts of any length are scanned whole. Other columns are
not looked at, so their names cannot clash. Without documents or items the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of terms of a block of items, about.
BLOCK_BYTES = 1 << 20
#: Sums of a document and an item that a task holds at a time.
HELD = 1 << 21
#: Parts of the documents in which the best are chosen first.
PARTS = 64

GUARD = 0x20
#: Bytes of a text as the automaton reads them: letters in lower case, guards for all that no term holds.
_READ = np.full(256, GUARD, np.uint8)
_READ[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = text.LOWER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]]


def item_terms(items: DataFrame) -> DataFrame:
    """`item_id` and `term`, each distinct term of an item once."""
    terms = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(terms).alias("term")).distinct()


def automaton(terms: Sequence[str]) -> ahocorasick.Automaton:
    """Automaton of guarded terms, byte by byte; its outputs are their numbers."""
    out = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        out.add_word(" " + term.encode().decode("latin-1") + " ", k)
    out.make_automaton()
    return out


def hits(found: ahocorasick.Automaton, column: pa.Array, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each row; row, term and tf of each term that a row holds."""
    data, offsets = text.buffers(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    guarded = np.full(len(data) + n + 1, GUARD, np.uint8)
    guarded[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), size)] = _READ[data]
    inside = guarded != GUARD
    begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    edges = offsets + np.arange(n + 1)  # the guard before each row
    words = np.diff(np.searchsorted(begins, edges))
    outputs = [x for pair in found.iter(guarded.tobytes().decode("latin-1")) for x in pair] if n_terms else []
    pairs = np.array(outputs, np.int64).reshape(-1, 2)
    row = np.searchsorted(edges, pairs[:, 0], side="left") - 1
    key, tf = np.unique(row * max(n_terms, 1) + pairs[:, 1], return_counts=True)
    return words, key // max(n_terms, 1), key % max(n_terms, 1), tf


def frequencies(docs: DataFrame, terms: Sequence[str]) -> tuple[int, int, np.ndarray]:
    """Number of documents with a word, number of all words, and number of documents that hold each term."""
    n_terms = len(terms)

    def job(batches):
        found, total, held = automaton(terms), np.zeros(2, np.int64), np.zeros(n_terms, np.int64)
        for batch in batches:
            for part in text.slices(batch):
                words, _, term, _ = hits(found, part.column("text"), n_terms)
                total += [np.count_nonzero(words), words.sum()]
                held += np.bincount(term, minlength=n_terms)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *some.tolist()], pa.int64()), pa.array([*total.tolist(), *held[some].tolist()], pa.int64())], ["term", "n"])

    sums = docs.select("text").mapInArrow(job, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the block
    got = dict(zip(sums["term"].to_pylist(), sums["n"].to_pylist(), strict=True))
    return got.get(-2, 0), got.get(-1, 0), np.array([got.get(k, 0) for k in range(n_terms)], np.int64)


def _best(rows: pa.Table, k: int) -> pa.Table:
    """Of each item the first `k` rows by score and `doc_id`."""
    order = pc.sort_indices(rows, sort_keys=[("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_end")
    item = rows["item"].to_numpy()[order.to_numpy()]
    return rows.take(order.filter(pa.array(np.arange(len(item)) - np.searchsorted(item, item) < k)))


def scored(docs: DataFrame, terms: Sequence[str], postings: Sequence[tuple[int, int]], n_items: int, k: int) -> DataFrame:
    """`item, doc_id, score`: each task's best documents of each item; `postings` are pairs of a term and an item."""
    n_docs, n_words, held = frequencies(docs, terms)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
    pairs = np.array(sorted(postings), np.int64).reshape(-1, 2)
    cut, of = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1)), pairs[:, 1]
    step = max(1, HELD // max(len(pairs), n_items, 1))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def job(batches):
        found, least, best = automaton(terms), np.ones(n_items, np.int64), None
        for batch in batches:
            for part in text.slices(batch):
                words, row, term, tf = hits(found, part.column("text"), len(terms))
                long_ = np.array([10 + 90 * n * n_docs // n_words for n in words.tolist()] if n_words else [10] * len(words), np.int64)
                value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * long_[row]))
                bounds = np.searchsorted(row, np.arange(0, part.num_rows + step, step))
                for a, b, begin in zip(bounds[:-1], bounds[1:], range(0, part.num_rows, step), strict=True):
                    n = cut[term[a:b] + 1] - cut[term[a:b]]
                    at = np.repeat(cut[term[a:b]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    sums = np.zeros((min(step, part.num_rows - begin), n_items), np.int64)
                    np.add.at(sums, (np.repeat(row[a:b] - begin, n), of[at]), np.repeat(value[a:b], n))
                    if len(sums) > k:
                        least = np.maximum(least, np.partition(sums, len(sums) - k, axis=0)[len(sums) - k])
                    r, item = np.nonzero(sums >= least)
                    new = pa.table({"item": pa.array(item), "doc_id": part.column("doc_id").take(pa.array(r + begin)), "score": pa.array(sums[r, item])})
                    best = _best(new if best is None else pa.concat_tables([best, new]), k)
                    full, n = np.unique(best["item"].to_numpy(), return_counts=True)
                    last = best["score"].to_numpy()[np.cumsum(n) - 1]
                    least[full[n == k]] = np.maximum(least[full[n == k]], last[n == k])
        if best is not None:
            yield from best.combine_chunks().to_batches()

    return docs.select("doc_id", "text").mapInArrow(job, f"item long, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`item_id, rank, doc_id, score`: the `k` documents of highest score above 0 of each item."""
    terms = scratch.stored(item_terms(items))
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 2), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    parts = []
    for b in range(blocks):
        rows = terms.filter(block == b).toArrow()  # about `block_bytes`
        names, ids = pc.unique(rows["term"]).to_pylist(), pc.unique(rows["item_id"])
        number = {t: j for j, t in enumerate(names)}
        at = pc.index_in(rows["item_id"], value_set=ids).to_pylist()
        found = scored(docs, names, [(number[t], i) for t, i in zip(rows["term"].to_pylist(), at, strict=True)], len(ids), k)
        keys = docs.sparkSession.createDataFrame(pa.table({"item": pa.array(range(len(ids)), pa.int64()), "item_id": ids}))
        parts.append(scratch.stored(found.join(keys, "item").select(F.col("item_id").cast(items.schema["item_id"].dataType).alias("item_id"), "doc_id", "score")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    first = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(*order)
    out = out.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


#: The same ranking as SQL for another engine.
SQL = (
    r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_extract_all(translate(text, '{upper}', '{lower}'), '{term}'), lambda x: x <> '') AS ws FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '{term}')) AS term FROM benchmark),
s AS (SELECT count(*) AS nd, sum(len(ws))::BIGINT AS l FROM d WHERE len(ws) > 0),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY r, term),
f AS (SELECT term, count(*) AS df FROM t WHERE term IN (SELECT term FROM i) GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM f, s),
m AS (SELECT r, doc_id, 10 + (90 * len(ws)::BIGINT * nd) // l AS m FROM d, s WHERE len(ws) > 0),
c AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM i JOIN w USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY item_id, r),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM c JOIN m USING (r) WHERE score > 0)
SELECT * FROM o WHERE rank <= 10
"""
).replace("{upper}", UPPER).replace("{lower}", LOWER).replace("{term}", TERM)
