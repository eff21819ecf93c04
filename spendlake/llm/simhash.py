"""SimHash near-duplicate groups by tiled exact comparison.

Rows: every document gets a result. Null or wordless text has fingerprint zero and links like any other.
Repeated rows, also of one `doc_id`, keep a row each. Null `doc_id`s keep their row; a group's id is its
smallest non-null `doc_id`. Ties do not arise: links depend on fingerprints only. Texts of any length are
hashed whole. An empty table gives an empty result. Other columns are not looked at, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, text
from .components import forest, named, numbered

TILE = 16384
SEED = 42


def _shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each shingle and the number of shingles of each row."""
    data = text.LOWER[data]
    starts, ends, first = text.spans(data, offsets, text.WORD)
    n_words = np.diff(first)
    n = np.where(n_words > 0, np.maximum(n_words - width + 1, 1), 0)
    if not len(starts):
        return np.zeros(0, np.uint64), n
    keep = text.WORD[data]
    gap = ends[ends < len(data)]
    gap = gap[~keep[gap]]
    data[gap] = 0x20
    keep[gap] = True
    place = np.cumsum(keep) - 1
    joined = data[keep].tobytes()
    begin, stop = place[starts].tolist(), (place[ends - 1] + 1).tolist()
    head = np.repeat(first[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    tail = np.minimum(head + width, np.repeat(first[1:], n)) - 1
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[begin[a] : stop[b]], SEED) for a, b in zip(head.tolist(), tail.tolist(), strict=True)], np.uint64), n


def _fingerprints(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bit k is one if it is set in more than half of a row's hashes."""
    out = np.zeros(len(n), np.uint64)
    rows = np.flatnonzero(n)
    if len(rows):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = np.concatenate([[0], np.cumsum(n[rows])[:-1]])
        counts = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
        out[rows] = np.packbits(2 * counts > n[rows][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """`doc_id` and `fp0`: 64 bits of the SimHash, as a signed long."""

    def job(batches):
        for batch in batches:
            for part in text.slices(batch):
                fps = _fingerprints(*_shingle_hashes(*text.buffers(part.column("text")), shingle))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp0"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(job, f"doc_id {kind}, fp0 long")


def _compare(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints of two tiles, as a spanning forest of row numbers; rows of b follow those of a."""
    order_a, order_b = (np.argsort(np.bitwise_count(x[:, 0]), kind="stable") for x in (a, b))
    ones_a, ones_b = np.bitwise_count(a[order_a, 0]).astype(int), np.bitwise_count(b[order_b, 0]).astype(int)
    first_a, first_b = a[order_a, 0], b[order_b, 0]
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(a), 32):
        to = min(at + 32, len(a))
        low, high = np.searchsorted(ones_b, [ones_a[at] - radius, ones_a[to - 1] + radius + 1])
        if same:
            low = max(low, at)
        for begin in range(low, high, 8192):
            x, y = np.nonzero(np.bitwise_count(first_a[at:to, None] ^ first_b[None, begin : min(begin + 8192, high)]) <= radius)
            x, y = order_a[x + at], order_b[y + begin]
            if same:
                x, y = x[x != y], y[x != y]
            if len(x):
                u, v = np.concatenate([u, x]), np.concatenate([v, y if same else y + len(a)])
        if len(u) > 1 << 20:
            u, v = forest(u, v)
    return forest(u, v)


def pairs_of_tiles(nodes: DataFrame, radius: int, fps: list[str]) -> DataFrame | None:
    """`tile, other, items, other_items`: each pair of tiles that can hold nodes within `radius` bits of `fp0`; None without nodes.

    Fingerprints are dealt into tiles of neighbouring population counts and about `TILE` rows at most. Pairs of tiles whose
    counts differ by more than `radius` cannot hold a link and are never made. Items hold all columns of `nodes`.
    """
    counted = nodes.withColumn("ones", F.bit_count("fp0").cast("int"))
    sizes = {r["ones"]: r["n"] for r in counted.groupBy("ones").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    if not sizes:
        return None
    # tiles: neighbouring counts together up to TILE rows, a larger count in parts
    bands: list[list[int]] = []  # lowest count, highest count, rows
    for p in sorted(sizes):
        if bands and bands[-1][2] + sizes[p] <= TILE:
            bands[-1][1:] = [p, bands[-1][2] + sizes[p]]
        else:
            bands.append([p, p, sizes[p]])
    parts = [-(-n // TILE) for _, _, n in bands]
    band_of = F.create_map(*(F.lit(x) for k, (low, high, _) in enumerate(bands) for p in range(low, high + 1) for x in (p, k)))
    n_parts = F.array(*map(F.lit, parts))
    reach = F.array(*(F.lit(max(j for j, (low, _, _) in enumerate(bands) if low - high <= radius)) for _, high, _ in bands))
    dealt = counted.withColumn("band", band_of[F.col("ones")])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(*fps), F.get(n_parts, F.col("band"))).cast("int"))
    tiles = scratch.stored(
        dealt.groupBy("band", "part").agg(F.collect_list(F.struct(*nodes.columns)).alias("items")).select(F.concat_ws("-", "band", "part").alias("tile"), "band", "part", "items")
    )
    pairs = tiles.select("tile", "band", "part").withColumn("other_band", F.explode(F.sequence("band", F.get(reach, F.col("band")))))
    pairs = pairs.withColumn("other_part", F.explode(F.sequence(F.lit(0), F.get(n_parts, F.col("other_band")) - 1)))
    pairs = pairs.filter("other_band > band or other_part >= part").select("tile", F.concat_ws("-", "other_band", "other_part").alias("other"))
    other = tiles.select(F.col("tile").alias("other"), F.col("items").alias("other_items"))
    return pairs.join(tiles.select("tile", "items"), "tile").join(other, "other").select("tile", "other", "items", "other_items")


def links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Links `(a, b)` of `node` ids that span the same components as all pairs within `radius` bits of `fp0`.

    Pairs of tiles are compared exactly, xor and bit count, in numpy. A task returns a spanning forest of
    the links it finds, so a group of g near copies costs about g rows for each pair of tiles, not g squared.
    """
    both = pairs_of_tiles(nodes, radius, ["fp0"])
    if both is None:
        return nodes.sparkSession.createDataFrame([], "a long, b long")

    def unpack(items: pa.ListScalar):
        rows = items.values
        return rows.field("node").to_numpy(), rows.field("fp0").to_numpy().view(np.uint64)[:, None]

    def job(batches):
        for batch in batches:
            a, b = [], []
            for left, right, x, y in zip(batch.column("items"), batch.column("other_items"), batch.column("tile"), batch.column("other"), strict=True):
                (n1, f1), (n2, f2) = unpack(left), unpack(right)
                same = x.as_py() == y.as_py()
                u, v = _compare(f1, f2, radius, same)
                names = n1 if same else np.concatenate([n1, n2])
                a.append(names[u])
                b.append(names[v])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return both.mapInArrow(job, "a long, b long")


def groups(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """`doc_id`, `fingerprint` (hex) and `component_id`, the smallest `doc_id` linked directly or through others."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = scratch.stored(fingerprints(docs, shingle))
    nodes, ids = numbered(rows.groupBy("fp0").agg(F.min("doc_id").alias("first")), "first", kind)
    found = named(nodes, links(nodes.select("node", "fp0"), radius), "first", ids).select("fp0", "component_id")
    return rows.join(found, "fp0").select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")
