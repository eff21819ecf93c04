"""Best-fit packing of token pieces into sequences of fixed capacity by linear grouping.

The plan is made on the histogram of piece lengths, which has at most `capacity` rows whatever the
corpus holds:

1. Linear grouping: lengths above `capacity / 8`, longest first, form groups of equal cardinality; each
   counts as long as the group's longest.
2. Configurations: over these few sizes, the linear programme of the fewest sequences is solved by column
   generation, where each new column is the configuration worth most at the present prices (a knapsack over
   the capacity). Its whole parts say how often each configuration is used.
3. Substitution: actual lengths take the places of their group, the longest that fit first; the last place
   of a sequence, and what space is over, go to the longest piece left that fits. What the whole parts leave
   over is packed in the same way from its longest piece on.
4. Best fit: short pieces, longest first, go where the least space is left over; what remains opens new
   sequences.

Pieces then find their place by length and by their rank among the pieces of that length. Ranks are
counted within (length, salt); a length has a salt for each `SALT_ROWS` of its pieces, so one that a third of
all pieces share is spread over tasks.

Rows: null text counts as empty, so its document is the end id alone. Texts longer than the capacity are cut
into pieces, texts of any length are encoded whole. Repeated rows are packed once for each row; pieces that
tie in all columns may change places with each other. Null `doc_id`s are kept. Other columns are not looked
at, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, text
from .bpe import ENCODE_BYTES, Compiled
from .tokens import with_end

GROUPS = 64
SALT_ROWS = 20_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """`doc_id, piece, start, length, ids_crc32`: each document's ids and its end id, cut only if longer than `capacity`."""
    compiled = Compiled(docs.sparkSession, tokenizer)

    def job(batches):
        for batch in batches:
            for part in text.slices(batch, size=ENCODE_BYTES):
                counts, ids = compiled.encoder().encode(part.column("text"))
                ids, offsets = with_end(counts, ids, end)
                n = np.diff(offsets)
                m = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), m)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
                first = n - (m - 1) * capacity
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[row], capacity)
                raw = memoryview(ids.astype("<u4").tobytes())
                at = (offsets[row] + start) * 4
                bodies = [raw[a : a + 4 * k] for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(row)),
                        pa.array(piece, pa.int32()),
                        pa.array(start),
                        pa.array(length),
                        pa.array([zlib.crc32(b) for b in bodies], pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(job, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _worth_most(sizes: list[int], counts: list[int], prices: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The configuration of greatest total price within the capacity, and that price."""
    best = np.zeros(capacity + 1)
    took = np.zeros((len(sizes), capacity + 1), np.int32)
    for g, (size, price) in enumerate(zip(sizes, prices.tolist(), strict=True)):
        before = best.copy()
        for k in range(1, min(counts[g], capacity // size) + 1 if price > 0 else 1):
            new = before[: capacity + 1 - k * size] + k * price
            better = new > best[k * size :] + 1e-12
            best[k * size :][better], took[g, k * size :][better] = new[better], k
    out, at = np.zeros(len(sizes), np.int64), int(best.argmax())
    for g in reversed(range(len(sizes))):
        out[g] = took[g, at]
        at -= int(out[g]) * sizes[g]
    return out, float(best.max())


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 2000) -> list[tuple[float, np.ndarray]]:
    """Configurations (how many of each size) and how often to use them so that the sum is least: a basis of the linear programme."""
    m, wanted = len(sizes), np.array(counts, float)
    columns = [np.where(np.arange(m) == g, min(capacity // sizes[g], counts[g]), 0) for g in range(m)]
    inverse = np.linalg.inv(np.array(columns, float).T)
    used = inverse @ wanted
    for n in range(rounds):
        column, worth = _worth_most(sizes, counts, inverse.sum(axis=0), capacity)
        if worth <= 1 + 1e-6:
            break
        change = inverse @ column
        ratio = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        columns[out] = column
        if n % 100 == 99:  # rounding errors do not pile up
            inverse = np.linalg.inv(np.array(columns, float).T)
        else:
            inverse[out] /= change[out]
            rest = np.arange(m) != out
            inverse[rest] -= np.outer(change[rest], inverse[out])
        used = inverse @ wanted
    return [(max(0.0, float(x)), c) for x, c in zip(used, columns, strict=True)]


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> list[tuple[int, list[int]]]:
    """Runs `(how many sequences, lengths in each)` that hold every piece of the histogram once."""
    small = capacity // 8
    left = np.zeros(capacity + 1, np.int64)  # large pieces by length
    for length, n in histogram.items():
        left[length] = n if length > small else 0
    per = max(1, -(-int(left.sum()) // groups))
    grouped: dict[int, int] = defaultdict(int)  # rounded size to count
    used = 0
    for length in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[length])
        while todo:
            if used % per == 0:
                top = length
            n = min(todo, per - used % per)
            grouped[top] += n
            used, todo = used + n, todo - n
    sizes = sorted(grouped, reverse=True)
    runs: list[tuple[int, list[int]]] = []

    def longest(most: int, taken: dict[int, int]) -> int:
        return next((x for x in range(most, small, -1) if left[x] > taken.get(x, 0)), 0)

    def substitute(slots: list[int], times: int) -> None:
        while times:
            space, taken = capacity, defaultdict(int)
            for k in range(len(slots)):
                if length := longest(min(space, slots[k]) if k + 1 < len(slots) else space, taken):
                    taken[length] += 1
                    space -= length
            while length := longest(space, taken):
                taken[length] += 1
                space -= length
            if not taken:
                return
            now = min(times, *(int(left[x]) // n for x, n in taken.items()))
            for x, n in taken.items():
                left[x] -= n * now
            runs.append((now, [x for x in sorted(taken, reverse=True) for _ in range(taken[x])]))
            times -= now

    chosen = configurations(sizes, [grouped[s] for s in sizes], capacity) if sizes else []
    for times, pattern in sorted(chosen, key=lambda c: (-c[1]).tolist()):
        substitute([s for s, n in zip(sizes, pattern.tolist(), strict=True) for _ in range(n)], int(times + 1e-9))
    while top := longest(capacity, {}):
        substitute([top], int(left[top]))
    space: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for n, lengths in runs:
        space[capacity - sum(lengths)].append((n, lengths))
    for length in sorted((x for x in histogram if 0 < x <= small), reverse=True):
        todo = histogram[length]
        while todo:
            gap = next((g for g in range(length, capacity + 1) if space.get(g)), None)
            if gap is None:
                each = min(capacity // length, todo)
                times = todo // each
                space[capacity - each * length].append((times, [length] * each))
                todo -= times * each
                continue
            n, lengths = space[gap].pop()
            now = min(n, todo)
            if n > now:
                space[gap].append((n - now, lengths))
            space[gap - length].append((now, [*lengths, length]))
            todo -= now
    return [run for gap in sorted(space) for run in space[gap]]


def place(parts: DataFrame, capacity: int = 1024, groups: int = GROUPS) -> DataFrame:
    """Add `sequence_id` and `offset` to rows that have a `length` of 1 to `capacity`.

    The broadcast slots number a few thousand: they follow from `capacity` and `groups`, not from the rows.
    """
    spark = parts.sparkSession
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # capacity rows at most
    seen: dict[int, int] = defaultdict(int)
    slots, first = [], 0
    for n, lengths in plan(histogram, capacity, groups):
        offset = 0
        for length in lengths:
            slots.append((length, seen[length], seen[length] + n, first, offset))
            seen[length] += n
            offset += length
        first += n
    if not slots:
        return parts.withColumn("sequence_id", F.lit(None).cast("long")).withColumn("offset", F.lit(None).cast("long"))
    slots = spark.createDataFrame(slots, "length long, low long, high long, first long, offset long")
    key = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in parts.columns]
    salts = F.get(F.array(*(F.lit(max(1, histogram.get(k, 0) // SALT_ROWS)) for k in range(capacity + 1))), F.col("length").cast("int"))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64(*key), salts).cast("int"))
    sums = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy(*key)
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(sums, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).alias("p")
    found = ranked.join(F.broadcast(slots).alias("s"), F.expr("p.length = s.length and _rank >= low and _rank < high"))
    return found.select(*(F.col(f"p.{c}") for c in parts.columns), (F.col("first") + F.col("_rank") - F.col("low")).alias("sequence_id"), F.col("s.offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """`doc_id, piece, start, length, ids_crc32, sequence_id, offset` of every piece of every document."""
    return place(scratch.stored(pieces(docs, tokenizer, capacity, end)), capacity)
