"""Groups of texts whose sets of shingles are alike: SimHash proposes pairs, the sets decide.

Texts with the same set of distinct shingles are one node. Tiles of nodes are compared twice. The first
time a pair of tiles returns a spanning forest of its candidates, nearest first; these links are verified
by the exact Jaccard similarity, and those that pass give parts. The second time it returns every
candidate within a closer radius (`close`) that joins two parts, and these are verified as well. So each of
these is either verified or joins nodes of one part already, while a group of g near copies costs about g
links for each pair of tiles. Beyond the closer radius lie many pairs that are not alike and, of pairs at the
limit of similarity, one in 25; such a pair is missed only where it is not the nearest of its nodes either and
no other pair joins their parts.

Rows: null or wordless text has the empty set, which is like itself only. Null `doc_id`s keep their row;
a group's id is its smallest non-null `doc_id`. Repeated rows and texts of the same set of shingles share a
group; ties of similarity at the limit count as alike. Texts of any length are compared whole. Other columns are
not looked at, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, simhash, text
from .components import components, named, numbered

#: Sets of fewer shingles are estimated too roughly for the closer radius.
FEW = 16
#: Candidates kept in memory by a task before they are cut to their forest.
HELD = 1 << 20


def _once(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once in a row."""
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.bincount(row[new], minlength=len(n))


def sketches(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """`doc_id`, `mark` (a hash of the set of shingles), `same` (a hash of the text), `n` shingles in the set and `fp0` .. `fp{words-1}`."""
    names = [f"fp{k}" for k in range(words)]

    def job(batches):
        for batch in batches:
            for part in text.slices(batch):
                hashes, n = _once(*simhash._shingle_hashes(*text.buffers(part.column("text")), shingle))
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(text.mix(hashes))])
                ends = np.cumsum(n)
                node = text.mix(total[ends] - total[ends - n] + n.astype(np.uint64))
                fps = [simhash._fingerprints(hashes if not k else text.mix(hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))), n) for k in range(words)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(node.view(np.int64)), part.column("same"), pa.array(n.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in fps)], ["doc_id", "mark", "same", "n", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("same")).mapInArrow(job, f"doc_id {kind}, mark long, same long, n long, " + ", ".join(f"{x} long" for x in names))


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """`node` and `items`, the hashes of the distinct shingles of `text`."""

    def job(batches):
        for batch in batches:
            for part in text.slices(batch):
                hashes, n = _once(*simhash._shingle_hashes(*text.buffers(part.column("text")), shingle))
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64)))], ["node", "items"])

    return texts.select("node", "text").mapInArrow(job, "node long, items array<long>")


def _candidates(a: dict, b: dict, radius: int, wide: int, close: int, share: tuple[int, int], same: bool):
    """Row numbers in two tiles and distances of pairs that may be alike, block by block; each pair once."""
    order_a, order_b = (np.argsort(np.bitwise_count(x["fps"][:, 0]), kind="stable") for x in (a, b))
    a, b = ({k: v[o] for k, v in x.items()} for x, o in ((a, order_a), (b, order_b)))
    ones_a, ones_b = (np.bitwise_count(x["fps"][:, 0]).astype(int) for x in (a, b))
    first_a, first_b = a["fps"][:, 0].copy(), b["fps"][:, 0].copy()
    for at in range(0, len(ones_a), 32):
        to = min(at + 32, len(ones_a))
        low, high = np.searchsorted(ones_b, [ones_a[at] - radius, ones_a[to - 1] + radius + 1])
        for begin in range(max(low, at) if same else low, high, 8192):
            x, y = np.nonzero(np.bitwise_count(first_a[at:to, None] ^ first_b[None, begin : min(begin + 8192, high)]) <= radius)
            x, y = x + at, y + begin
            n, m = a["n"][x], b["n"][y]
            ok = (share[1] * np.minimum(n, m) >= share[0] * np.maximum(n, m)) & (a["label"][x] != b["label"][y])
            if same:
                ok &= x < y
            x, y = x[ok], y[ok]
            bits = np.bitwise_count(a["fps"][x] ^ b["fps"][y]).sum(axis=1, dtype=np.int64)
            ok = bits <= np.where(np.minimum(a["n"][x], b["n"][y]) < FEW, wide, close)
            if ok.any():
                yield order_a[x[ok]], order_b[y[ok]], bits[ok]


def nearest_forest(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the links of a spanning forest of least total `w`."""
    if not len(u):
        return np.zeros(0, np.int64)
    names, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = flat[: len(u)], flat[len(u) :]
    rank = np.empty(len(u), np.int64)
    rank[np.argsort(w, kind="stable")] = np.arange(len(u))
    back = np.argsort(rank)
    label, live, taken = np.arange(len(names)), np.arange(len(u)), []
    while len(live):
        p, q = label[x[live]], label[y[live]]
        live, p, q = live[p != q], p[p != q], q[p != q]
        best = np.full(len(names), len(u))
        np.minimum.at(best, p, rank[live])
        np.minimum.at(best, q, rank[live])
        roots = np.flatnonzero(best < len(u))
        links = back[best[roots]]
        taken.append(links)
        p, q = label[x[links]], label[y[links]]
        up = np.arange(len(names))
        up[roots] = np.where(p == roots, q, p)
        mutual = roots[(up[up[roots]] == roots) & (roots < up[roots])]
        up[mutual] = mutual
        while not np.array_equal(up, up[up]):
            up = up[up]
        label = up[label]
    return np.unique(np.concatenate(taken))


def candidates(nodes: DataFrame, radius: int, wide: int, close: int, words: int, share: tuple[int, int], every: bool) -> DataFrame:
    """Candidate links `(a, b)` between nodes of different `label`: all of them, or a nearest spanning forest for each pair of tiles."""
    fps = [f"fp{k}" for k in range(words)]
    both = simhash.pairs_of_tiles(nodes.select("node", "n", "label", *fps), radius, fps)
    if both is None:
        return nodes.sparkSession.createDataFrame([], "a long, b long")

    def unpack(items: pa.ListScalar):
        rows = items.values
        out = {k: rows.field(k).to_numpy() for k in ("node", "n", "label")}
        return out | {"fps": np.stack([rows.field(f).to_numpy().view(np.uint64) for f in fps], axis=1)}

    def job(batches):
        for batch in batches:
            for left, right, x, y in zip(batch.column("items"), batch.column("other_items"), batch.column("tile"), batch.column("other"), strict=True):
                a, b, same = unpack(left), unpack(right), x.as_py() == y.as_py()
                shift = 0 if same else len(a["node"])
                names = a["node"] if same else np.concatenate([a["node"], b["node"]])
                held, size = [], 0
                for u, v, w in _candidates(a, b, radius, wide, close, share, same):
                    held.append(np.stack([u, v + shift, w]))
                    size += len(u)
                    if size > HELD:
                        now = np.concatenate(held, axis=1)
                        if every:
                            yield pa.RecordBatch.from_arrays([pa.array(names[now[0]]), pa.array(names[now[1]])], ["a", "b"])
                            held, size = [], 0
                        else:
                            held, size = [now[:, nearest_forest(*now)]], 0
                if held:
                    now = np.concatenate(held, axis=1)
                    now = now if every else now[:, nearest_forest(*now)]
                    yield pa.RecordBatch.from_arrays([pa.array(names[now[0]]), pa.array(names[now[1]])], ["a", "b"])

    return both.mapInArrow(job, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def groups(docs: DataFrame, shingle: int = 5, share: tuple[int, int] = (4, 5), words: int = 8, radius: int = 22, wide: int = 128, close: int = 92) -> DataFrame:
    """`doc_id` and `component_id`, the smallest `doc_id` linked directly or through others by a similarity of `share` or more.

    Candidates differ in at most `radius` of the first 64 bits and `wide` of all, in the second pass `close`.
    """
    fps = [f"fp{k}" for k in range(words)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = scratch.stored(sketches(docs, shingle, words))
    nodes = rows.groupBy("mark", "n", *fps).agg(F.min("doc_id").alias("first"), F.min("same").alias("same"))
    nodes, ids = numbered(nodes, "first", kind)

    def verified(pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        keys = nodes.join(needed, "node", "left_semi").select("node", "same")
        texts = docs.select("text", F.xxhash64("text").alias("same")).join(keys, "same").groupBy("node").agg(F.first("text").alias("text"))
        sets = scratch.stored(shingle_sets(texts, shingle))
        left, right = (sets.select(F.col("node").alias(k), F.col("items").alias(f"items_{k}")) for k in "ab")
        shared, both = F.size(F.array_intersect("items_a", "items_b")), F.size("items_a") + F.size("items_b")
        return scratch.stored(pairs.join(left, "a").join(right, "b").filter(share[1] * shared >= share[0] * (both - shared)).select("a", "b"))

    forest = scratch.stored(candidates(nodes.withColumn("label", F.col("node")), radius, wide, wide, words, share, False).distinct())
    near = verified(forest)
    parts = scratch.stored(components(near))
    touched = forest.select(F.col("a").alias("node")).unionByName(forest.select(F.col("b").alias("node"))).distinct()
    open_ = nodes.join(touched, "node", "left_semi").join(parts, "node", "left").withColumn("label", F.coalesce("component", "node"))
    rest = scratch.stored(candidates(scratch.stored(open_.drop("component")), radius, wide, close, words, share, True).join(forest, ["a", "b"], "left_anti"))
    found = named(nodes.select("node", "mark", "n", *fps, "first"), near.unionByName(verified(rest)), "first", ids)
    return rows.join(found.select("mark", "n", *fps, "component_id"), ["mark", "n", *fps]).select("doc_id", "component_id")
