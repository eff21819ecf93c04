"""Periodic runs of words by a dictionary of basic factors.

Words of a document are numbered. Level k names every stretch of m = 2^k words by the names of its halves, so two
stretches have one name if and only if their words are equal; stretches that stand once in a document get no
name, and higher levels look at the others only. For every place the successors of its stretch are walked: as long
as they keep one distance they form an arithmetic progression, which is passed in one step. Those at a distance d of
m <= d < 2 m propose the period d. A proposal is extended to both sides through the names of all levels, from the
longest down, and the runs so found are deduplicated; of several periods of one stretch the smallest stays.

No run is missed. A run of period q, m <= q < 2 m, holds the stretch of its start again q words on. If some stretch of
the run's first period has no period up to m / 2, at most three of its successors lie within 2 m, the one at
distance q among them. Otherwise all of these share one period p, the stretch at the run's start has a progression of
step p that ends before distance q (else p would divide the run), and the one at distance q is among the next three.

All documents of a batch go through the levels together, in numpy; a task holds about 1 MB of text, or one document.

Rows: null and empty texts have no words and no runs. Long texts are treated whole, in time n log n for n words. Equal
words tie everywhere, which is the feature. Repeated rows get a result each; a null `doc_id` is kept. Columns named
as the results are replaced, all others kept, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text

#: Words of a run at least; two periods at least besides.
LEAST = 12
#: Successors of a stretch that are looked at, and as many after its progression.
STEPS = 3


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal exactly for equal words."""
    hashes = text.word_hashes(data, starts, ends)
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), dtype=bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    numbers = np.empty(len(order), np.int64)
    numbers[order] = np.cumsum(new) - 1
    # longer words of one hash are told apart by their bytes: each is held against the first of its number
    head = order[np.flatnonzero(new)][numbers]
    size = ends - starts
    odd = np.flatnonzero(size != size[head])
    for width in np.unique(size[size > 8]).tolist():
        rows = np.flatnonzero((size == width) & (head != np.arange(len(size))))
        for a in range(0, len(rows), max(1, (1 << 22) // width)):
            part = rows[a : a + max(1, (1 << 22) // width)]
            at = np.arange(width)
            differs = (data[starts[part][:, None] + at] != data[np.minimum(starts[head[part]][:, None] + at, len(data) - 1)]).any(axis=1)
            odd = np.concatenate([odd, part[differs]])
    seen: dict[bytes, int] = {}
    for k in np.unique(odd).tolist():
        numbers[k] = seen.setdefault(data[starts[k] : ends[k]].tobytes(), len(numbers) + len(seen))
    return numbers


def _named(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of (left, right), and the name of each in that order."""
    key = left * (right.max(initial=0) + 1) + right
    order = np.argsort(key, kind="stable")
    new = np.zeros(len(order), np.int64)
    new[1:] = key[order[1:]] != key[order[:-1]]
    return order, np.cumsum(new)


def factors(words: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4, ... words at each place, -1 for those that stand once in their row."""
    levels: list[np.ndarray] = []
    places, left, right, m = np.arange(len(words)), row, words, 1
    while len(places):
        order, name = _named(left, right)
        often = np.bincount(name) > 1
        level = np.full(len(words), -1, np.int64)
        level[places[order]] = np.where(often[name], name, -1)
        if not often.any():
            break
        levels.append(level)
        here = np.flatnonzero(level >= 0)
        here = here[here + m < len(words)]
        places = here[(level[here + m] >= 0) & (row[here] == row[here + m])]
        left, right, m = level[places], level[places + m], 2 * m  # names hold the row
    return levels


def proposals(level: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and the periods between `m` and 2 `m` that successors of their stretches propose."""
    places = np.flatnonzero(level >= 0)
    order = places[np.argsort(level[places], kind="stable")]
    n, name = len(order), level[order]
    step = np.zeros(n, np.int64)
    step[:-1] = np.where(name[1:] == name[:-1], order[1:] - order[:-1], 0)
    # end of the progression that begins at each: where the step changes
    last = np.flatnonzero(np.append(step[1:] != step[:-1], True)) if n else np.zeros(0, np.int64)
    end = last[np.searchsorted(last, np.arange(n))] + (step > 0)
    out_place, out_period = [], []
    for base in (np.arange(n), end):
        for k in range(1, STEPS + 1):
            to = base + k
            ok = np.flatnonzero(to < n)
            ok = ok[name[to[ok]] == name[ok]]
            d = order[to[ok]] - order[ok]
            good = (d >= m) & (d < 2 * m)
            out_place.append(order[ok[good]])
            out_period.append(d[good])
    return np.concatenate(out_place), np.concatenate(out_period)


def runs(words: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start within the row, length and period of every run, by row, start and period.

    `words` are numbers of the words of all rows, `first` the first of each row.
    """
    n = len(words)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    levels = factors(words, row)
    found: list[np.ndarray] = []
    for k, level in enumerate(levels):
        place, period = proposals(level, 1 << k)
        # of neighbouring places of one period the first speaks for all
        order = np.lexsort((place, period))
        place, period = place[order], period[order]
        new = np.ones(len(place), dtype=bool)
        new[1:] = (period[1:] != period[:-1]) | (place[1:] > place[:-1] + 1)
        place, period = place[new], period[new]
        begin, end = place.copy(), place.copy()
        for j in range(len(levels) - 1, -1, -1):
            names, m = levels[j], 1 << j
            ok = end + period + m <= n
            at = np.where(ok, end, 0)
            ok &= (names[at] >= 0) & (names[at] == names[np.minimum(at + period, n - 1)])
            end += m * ok
            ok = begin >= m
            at = np.where(ok, begin - m, 0)
            ok &= (names[at] >= 0) & (names[at] == names[np.minimum(at + period, n - 1)])
            begin -= m * ok
        length = end - begin + period
        keep = length >= np.maximum(least, 2 * period)
        found.append(np.stack([begin[keep], length[keep], period[keep]]))
    every = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    start, length, period = every[:, np.lexsort((every[2], every[1], every[0]))]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])  # a multiple of the smallest period gives the same stretch
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    at = row[start] if n else np.zeros(0, np.int64)
    return at, start - first[at], length, period


def find(docs: DataFrame, least: int = LEAST, prefix: str = "") -> DataFrame:
    """`docs` with `n_words`, `runs` (start, length and period of each, by start and period) and `kept_text`.

    `kept_text` is the text without the words that a run holds after its first period, joined by a space. The names,
    after `prefix`, replace columns of the same names.
    """
    figures = ["n_words", "runs", "kept_text"]
    names = [c for c in docs.columns if c not in {prefix + f for f in figures}]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = docs.select(F.col("text").alias("t"), F.struct(*map(quoted, names)).alias("r"))

    def job(batches):
        for batch in batches:
            for part in text.slices(batch, "t"):
                data, offsets = text.buffers(part.column("t"))
                starts, ends, first = text.spans(data, offsets, text.WORD)
                at, start, length, period = runs(word_numbers(data, starts, ends), first, least)
                change = np.zeros(len(starts) + 1, np.int64)
                np.add.at(change, first[at] + start + period, 1)
                np.add.at(change, first[at] + start + length, -1)
                keep = np.flatnonzero(np.cumsum(change)[:-1] == 0)
                cut = pa.array(np.searchsorted(at, np.arange(part.num_rows + 1)), pa.int32())
                found = pa.ListArray.from_arrays(cut, pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"]))
                kept = text.joined(data, starts[keep], ends[keep], np.searchsorted(keep, first))
                yield pa.RecordBatch.from_arrays([part.column("r"), pa.array(np.diff(first)), found, pa.array(kept, pa.string())], ["r", *figures])

    item = T.StructType().add("start", "long").add("length", "long").add("period", "long")
    schema = T.StructType([rows.schema["r"]]).add("n_words", "long").add("runs", T.ArrayType(item)).add("kept_text", "string")
    out = rows.select("r", "t").mapInArrow(job, schema)
    return out.select(*(F.col("r").getField(c).alias(c) for c in names), *(F.col(f).alias(prefix + f) for f in figures))


def digest(docs: DataFrame) -> DataFrame:
    """Figures of a document's runs: their number, the longest one, hashes of all of them and of the text that is kept."""
    longest = F.array_max(F.transform("_runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("_runs", lambda r: F.concat(F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))), F.lit("\n"))), "")
    found = find(docs.select("doc_id", "text"), prefix="_").withColumn("_longest", longest)
    length, period = F.col("_longest.length"), -F.col("_longest.period")
    return found.select(
        "doc_id",
        F.size("_runs").cast("long").alias("n_runs"),
        (-F.col("_longest.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(F.lit(1000) * length / period).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("_kept_text", 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """`doc_id` and `text`; of each document whose crc32 of the decimal id is divisible by 10 the words from one place on are made to repeat."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w))), 0)
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(changed, F.col("text"))).otherwise(F.col("text")).alias("text"))
