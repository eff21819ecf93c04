"""Embedding near-duplicates by hierarchical navigable small-world graphs per shard.

Equal vectors are one node first. Nodes are dealt into shards by hash, and a graph is built for each.
Blocks of nodes then query every shard: greedy descent through the upper layers, a beam search in the
lowest. A query whose beam holds nothing but links gets a beam twice as wide. A part of each block is
audited against brute force on the shard; below `RECALL` of their links all beams of the block are doubled,
again and again, until the audit passes. The last step of widening is the whole shard, taken where the lists of
neighbours of a beam would hold more rows than the shard does. Candidates are verified by cosine in double precision; components are united from
spanning forests.

Within a task all queries move in step in numpy. A shard's graph goes to `PARTS` tasks, and every block to one
of them for each shard, so what is shuffled is the rows times the number of shards and `PARTS`. That number
is `SHARDS` until a shard would exceed `SHARD_BYTES`; as every query asks every shard, work grows as rows times
shards. A task holds one graph and one block of queries at a time.

Rows: vectors that are null, zero, or hold null or non-finite components link with nothing, and so do
vectors of another length. Equal vectors link with each other. A null `vec_id` counts as a link and keeps
its row; its component is that of its vector. Repeated rows keep a row each and link with each other. Ties of
cosine at the threshold link. Labels and other columns are not looked at, so their names cannot clash. Vectors
of any length are compared whole. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .components import forest, named, numbered

SHARDS, SHARD_BYTES, PARTS, BLOCK = 8, 1 << 25, 4, 2048
LINKS, BUILD_BEAM, BEAM, WIDTH = 12, 32, 32, 4
AUDIT, RECALL = 64, 0.99
#: A beam of `b` nodes looks at up to `2 * LINKS * b` neighbours; from one node in so many of the shard on, the next step of widening is the whole shard.
WHOLE = 2 * LINKS


def beam_search(unit: np.ndarray, near: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best `beam` nodes and similarities for each query, best first; -1 where fewer were found."""
    q, n = len(queries), len(unit)
    rows = np.arange(q)
    seen = np.zeros((q, n), dtype=bool)
    seen[rows, entry] = True
    ids = np.full((q, beam), -1, np.int64)
    sims = np.full((q, beam), -np.inf, np.float32)
    ids[:, 0], sims[:, 0] = entry, np.einsum("qd,qd->q", queries, unit[entry])
    done = np.zeros((q, beam), dtype=bool)
    active, take = rows, min(max(WIDTH, beam // 8), beam)
    while len(active):
        waiting = np.where(done[active] | (ids[active] < 0), -np.inf, sims[active])
        pick = np.argpartition(-waiting, take - 1, axis=1)[:, :take] if take < beam else np.tile(np.arange(beam), (len(active), 1))
        value = np.take_along_axis(waiting, pick, axis=1)
        live = np.isfinite(value)
        going = live.any(axis=1)
        active, pick, live = active[going], pick[going], live[going]
        if not len(active):
            break
        hit = np.nonzero(live)
        done[active[hit[0]], pick[hit]] = True
        nodes = np.where(live, ids[active[:, None], pick], 0)
        found = np.where(live[:, :, None], near[nodes], -1).reshape(len(active), -1)
        known = seen[active[:, None], np.maximum(found, 0)] | (found < 0)
        real = np.nonzero(found >= 0)
        seen[active[real[0]], found[real]] = True
        order = np.sort(np.where(known, -1, found), axis=1)
        fresh = order >= 0
        fresh[:, 1:] &= order[:, 1:] != order[:, :-1]
        width = int(fresh.sum(axis=1).max(initial=0))
        if not width:
            continue
        order = np.sort(np.where(fresh, order, -1), axis=1)[:, -width:]
        sim = np.matmul(unit[np.maximum(order, 0)], queries[active][:, :, None])[:, :, 0]
        sim[order < 0] = -np.inf
        all_ids, all_sims = np.concatenate([ids[active], order], axis=1), np.concatenate([sims[active], sim], axis=1)
        all_done = np.concatenate([done[active], np.zeros(order.shape, dtype=bool)], axis=1)
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[active], sims[active], done[active] = (np.take_along_axis(x, best, axis=1) for x in (all_ids, all_sims, all_done))
    return ids, sims


class Graph:
    """Layers of neighbour lists over unit vectors: `LINKS` diverse neighbours of a node, then as many that chose it."""

    def __init__(self, unit: np.ndarray, layers: list[np.ndarray], level: np.ndarray, entry: int):
        self.unit, self.layers, self.level, self.entry = unit, layers, level, entry

    @classmethod
    def build(cls, unit: np.ndarray, seed: int = 5) -> Graph:
        n = len(unit)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int), 4)
        order = np.argsort(-level, kind="stable")
        top = int(level[order[0]])
        graph = cls(unit, [np.full((n, 2 * LINKS), -1, np.int32) for _ in range(top + 1)], level, int(order[0]))
        at, back = 1, [np.zeros(n, np.int64) for _ in range(top + 1)]
        while at < n:
            batch = order[at : at + min(max(16, at), 512)]
            for layer in range(top, -1, -1):
                new = batch[level[batch] >= layer]
                if len(new):
                    graph._insert(layer, new, back[layer], BUILD_BEAM)
            at += len(batch)
        return graph

    def _insert(self, layer: int, new: np.ndarray, back: np.ndarray, beam: int) -> None:
        unit, near = self.unit, self.layers[layer]
        q = unit[new]
        ids, sims = beam_search(unit, near, q, self._descend(q, layer), beam)
        own = q @ q.T
        own[np.tril_indices(len(new))] = -np.inf  # links within the batch go to those before
        k = min(8, len(new))
        inner = np.argpartition(-own, k - 1, axis=1)[:, :k]
        ids = np.concatenate([ids, np.where(np.isfinite(np.take_along_axis(own, inner, axis=1)), new[inner], -1)], axis=1)
        sims = np.concatenate([sims, np.take_along_axis(own, inner, axis=1)], axis=1)
        best = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        ids, sims = np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1)
        ids[ids == new[:, None]] = -1
        v = unit[np.maximum(ids, 0)]
        cross = np.matmul(v, v.transpose(0, 2, 1))
        chosen, count = np.zeros(ids.shape, dtype=bool), np.zeros(len(new), np.int64)
        for k in range(ids.shape[1]):  # nearer to the node than to any neighbour chosen before
            ok = (ids[:, k] >= 0) & (count < LINKS) & ~((cross[:, k, :] > sims[:, k, None]) & chosen).any(axis=1)
            chosen[:, k], count = ok, count + ok
        for k in range(ids.shape[1]):  # the rest by nearness
            ok = (ids[:, k] >= 0) & (count < LINKS) & ~chosen[:, k]
            chosen[:, k], count = chosen[:, k] | ok, count + ok
        row, col = np.nonzero(chosen)
        slot = np.arange(len(row)) - np.searchsorted(row, row)
        near[new[row], slot] = ids[row, col]
        to, source = ids[row, col], new[row]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        place = back[to] + np.arange(len(to)) - np.searchsorted(to, to)
        near[to, LINKS + place % LINKS] = source  # the oldest goes when full
        np.add.at(back, to, 1)

    def _descend(self, queries: np.ndarray, layer: int) -> np.ndarray:
        at = np.full(len(queries), self.entry, np.int64)
        for k in range(len(self.layers) - 1, layer, -1):
            at = beam_search(self.unit, self.layers[k], queries, at, 2)[0][:, 0]
        return at

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        return beam_search(self.unit, self.layers[0], queries, self._descend(queries, 0), beam)


def linked(graph: Graph, queries: np.ndarray, threshold: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Nodes of the graph at similarity of about `threshold` or more to each query, and the beam each was answered with (0: the whole shard)."""
    close, n = threshold - 1e-4, len(graph.unit)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
    audit = np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int)
    truth = [np.flatnonzero(s >= close) for s in queries[audit] @ graph.unit.T]
    beams, todo = np.full(len(queries), BEAM), np.ones(len(queries), dtype=bool)
    while todo.any():
        while todo.any():
            beam = int(beams[todo].min())
            turn = np.flatnonzero(todo & (beams == beam))
            for a in range(0, len(turn), 256):
                part = turn[a : a + 256]
                if beam * WHOLE >= n:
                    for r, s in zip(part, queries[part] @ graph.unit.T, strict=True):
                        out[r] = np.flatnonzero(s >= close)
                    beams[part], todo[part] = 0, False
                    continue
                ids, sims = graph.search(queries[part], beam)
                for k, r in enumerate(part):
                    out[r] = ids[k][sims[k] >= close]
                full = sims[:, -1] >= close
                beams[part[full]] *= 2
                todo[part[~full]] = False
        # each audited query with links counts alike, however many it has
        shares = [len(np.intersect1d(out[r], t, assume_unique=True)) / len(t) for r, t in zip(audit, truth, strict=True) if len(t)]
        if shares and np.mean(shares) < RECALL:
            beams *= 2
            todo = beams > 0
    return out, beams


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """`vec_id, n_links, component_id, kept` of every row."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    value = F.col("embedding").cast("array<double>")
    usable = F.coalesce(F.forall(value, finite) & F.exists(value, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(usable, value).alias("v"))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    nodes = rows.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    nodes, known = numbered(nodes.withColumn("dim", F.size("v")), "first", kind)
    n, dim = nodes.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    shards, block = max(SHARDS, -(-n * dim * 8 // SHARD_BYTES)), max(1, min(BLOCK, SHARD_BYTES // (8 * dim)))
    n_blocks = max(1, -(-n // block))
    parts = min(PARTS, n_blocks)
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(shards)))
    blocks = nodes.withColumn("block", F.pmod(F.xxhash64("node", F.lit(4)), F.lit(n_blocks)))

    def matrix(items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = items.values
        full = x.field("v").flatten().to_numpy().reshape(len(x), -1)
        return x.field("node").to_numpy(), x.field("copies").to_numpy(), full

    def unit(x: np.ndarray) -> np.ndarray:
        scaled = x / np.abs(x).max(axis=1, keepdims=True)
        return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)

    def build(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                graph = Graph.build(unit(matrix(batch.column("items")[k])[2]))
                packed = np.stack(graph.layers).astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("dim").slice(k, 1), batch.column("shard").slice(k, 1), batch.column("items").slice(k, 1), pa.array([packed], pa.binary()), pa.array([graph.entry], pa.int64())],
                    ["dim", "shard", "items", "layers", "entry"],
                )

    def query(batches):
        where, graph = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                here = tuple(batch.column(c)[k].as_py() for c in ("dim", "shard"))
                if batch.column("layers")[k].is_valid:  # the graph comes before its blocks
                    ids, copies, full = matrix(batch.column("items")[k])
                    layers = np.frombuffer(batch.column("layers")[k].as_buffer(), "<i4").reshape(-1, len(ids), 2 * LINKS)
                    where, graph = here, Graph(unit(full), list(layers), np.zeros(0), batch.column("entry")[k].as_py())
                    continue
                if here != where:  # no vector of this length in the shard
                    continue
                q_ids, _, q_full = matrix(batch.column("items")[k])
                found, _ = linked(graph, unit(q_full), threshold)
                x = np.repeat(np.arange(len(q_ids)), [len(f) for f in found])
                y = np.concatenate(found) if len(x) else np.zeros(0, np.int64)
                a, b = q_full[x], full[y]
                a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
                cosine = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
                ok = (cosine >= threshold) & (q_ids[x] != ids[y])
                x, y = x[ok], y[ok]
                count = np.bincount(x, weights=copies[y], minlength=len(q_ids)).astype(np.int64)
                some = np.flatnonzero(count)
                u, v = forest(q_ids[x], ids[y])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([q_ids[some], u])), pa.array([None] * len(some) + v.tolist(), pa.int64()), pa.array(np.concatenate([count[some], np.zeros(len(u), np.int64)]))],
                    ["node", "other", "n"],
                )

    item = F.struct("node", "copies", "v")
    shards_ = dealt.groupBy("dim", "shard").agg(F.collect_list(item).alias("items"))  # SHARD_BYTES or so
    graphs = scratch.stored(shards_.mapInArrow(build, T.StructType([*shards_.schema.fields]).add("layers", "binary").add("entry", "long")))
    packed = blocks.groupBy("dim", "block").agg(F.collect_list(item).alias("items"))  # BLOCK rows or so
    part = F.pmod(F.col("block"), F.lit(parts)).cast("int")
    asked = packed.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), part.alias("part"), "block", "items")
    asked = asked.select("dim", "shard", "part", "block", "items", F.lit(None).cast("binary").alias("layers"), F.lit(None).cast("long").alias("entry"))
    held = graphs.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(-1).cast("long").alias("block"), "items", "layers", "entry")
    ready = held.unionByName(asked).repartition(2 * parts * shards, "dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", "block")
    found = scratch.stored(ready.select("dim", "shard", "items", "layers", "entry").mapInArrow(query, "node long, other long, n long"))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    links = found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    united = named(nodes, links, "first", known).join(counts, "node", "left")
    united = united.select("v", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.lit(True).alias("_has"))
    out = rows.join(united, "v", "left")
    component = F.when(F.col("_has"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
