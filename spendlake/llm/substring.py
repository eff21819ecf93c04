"""Substring deduplication by seed and extend.

Anchors: of each document's hashes of `SEED_WORDS` consecutive words, winnowing keeps the smallest in every
`width - SEED_WORDS + 1`. Two documents that share `width` words in a row share the anchor of that window.
Documents are joined on the anchors that stand in two of them or more.

Extension: around each shared anchor, to the left and to the right, every window of `width` words that the
anchor belongs to is matched to its first holder, the smallest `doc_id` where it starts. Windows next to
each other that match the same document on the same diagonal are one maximal repeat (place and length here,
document and place there), of `width` words at least. The first holder's words of each repeat are then
brought to the document and compared with its own; only words that are equal in `width` places in a row are
removed. The first holder keeps its copy. Windows are judged on the input, not on what is left.

Windows are matched by 64 bits. A window whose words turn out to differ from its first holder's goes into another
round, where the first holder is sought among those that differ, until none is left. So texts that meet by
chance neither remove each other's words nor hide a third one; a round without such windows ends the work.

A document meets the first holder of a window only, not every other holder, so a passage in a third of all
documents costs a row for each document that holds it, and no pairs within a group are made. Anchors and
windows are summed by hash with partial sums and met again by joins that adaptive execution can split.

Rows: null text has no words, an empty one neither. Long texts are treated whole: a text's windows are rows,
not one value. Ties: equal windows of one document count once as its own. A row of null `doc_id` is kept
whole and removes nothing. Rows of one `doc_id` do not remove each other's words. Columns of the input
named as the results are replaced; all others are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch, text

SEED_WORDS = 4


class _Slice:
    """Words of a slice; on demand its windows of `width` words and their anchors, only windows within one row."""

    def __init__(self, column: pa.Array):
        data, offsets = text.buffers(column)
        self.data = data
        self.starts, self.ends, self.first = text.spans(data, offsets, text.WORD)

    def windows(self, width: int, bits: int = 64) -> None:
        words = text.word_hashes(self.data, self.starts, self.ends)
        n = max(0, len(words) - width + 1)
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))[:n]
        self.at = np.flatnonzero(np.arange(n) + width <= self.first[1:][row]) if n else np.zeros(0, np.int64)
        self.row, self.seeds = row[self.at], np.zeros(0, np.uint64)
        if n:
            low = text.window_hashes(words, SEED_WORDS)
            reach, span = 1, width - SEED_WORDS + 1
            while reach < span:  # smallest of `span` seeds in a row
                step = min(reach, span - reach)
                low = np.minimum(low[: len(low) - step], low[step:])
                reach += step
            self.seeds = low[self.at]
        self.hashes = text.window_hashes(words, width)[self.at] >> np.uint64(64 - bits)

    def joined(self, begin: int, end: int) -> str:
        """The words from `begin` to `end` joined by one space."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[begin:end].tolist(), self.ends[begin:end].tolist(), strict=True)).decode()


def _distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _held(lists: pa.Array, row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether each (row, value) stands in that row's list."""
    offsets = np.concatenate([[0], np.cumsum([len(x) if x.is_valid else 0 for x in lists])])
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    out = np.zeros(len(row), dtype=bool)
    if len(flat):
        bounds = np.searchsorted(row, np.arange(len(lists) + 1))
        for r in np.flatnonzero(np.diff(offsets)):
            a, b = bounds[r], bounds[r + 1]
            out[a:b] = np.isin(value[a:b], flat[offsets[r] : offsets[r + 1]])
    return out


def shared_windows(docs: DataFrame, width: int, bits: int, tables: scratch.Tables) -> DataFrame:
    """`doc_id, at, hash` of the windows around anchors that stand in two documents or more."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def anchors(batches):
        for batch in batches:
            for part in text.slices(batch):
                s = _Slice(part.column("text"))
                s.windows(width)
                row, seed = _distinct(s.row, s.seeds)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(seed.view(np.int64))], ["doc_id", "seed"])

    def extend(batches):
        for batch in batches:
            for part in text.slices(batch):
                s = _Slice(part.column("text"))
                s.windows(width, bits)
                held = np.flatnonzero(_held(part.column("seeds"), s.row, s.seeds))
                row = s.row[held]
                place = (s.at[held] - s.first[row]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), pa.array(place), pa.array(s.hashes[held].view(np.int64))], ["doc_id", "at", "hash"]
                )

    found = docs.mapInArrow(anchors, f"doc_id {kind}, seed long")
    shared = found.groupBy("seed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("seed")
    seeded = tables.store(found.join(shared, "seed").groupBy("doc_id").agg(F.collect_list("seed").alias("seeds")))
    windows = tables.store(docs.join(seeded, "doc_id").select("doc_id", "text", "seeds").mapInArrow(extend, f"doc_id {kind}, at int, hash long"))
    tables.drop(seeded)
    return windows


def repeats(windows: DataFrame, width: int, tables: scratch.Tables) -> DataFrame:
    """`doc_id, start, length, source, source_start`: maximal repeats of each document with first holders of its windows.

    A first holder's other windows of that hash are there too, with itself as the source.
    """
    kind = windows.schema["doc_id"].dataType.simpleString()

    def runs(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                found = batch.column("found")[k].values
                at, place = (found.field(f).to_numpy().astype(np.int64) for f in ("at", "place"))
                source = found.field("low").dictionary_encode()
                code = source.indices.to_numpy().astype(np.int64)
                order = np.lexsort((at, at - place, code))
                at, place, code = at[order], place[order], code[order]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (code[1:] != code[:-1]) | (at[1:] - place[1:] != at[:-1] - place[:-1]) | (at[1:] > at[:-1] + 1)
                begin = np.flatnonzero(new)
                last = np.append(begin[1:], len(at)) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(np.full(len(begin), k))), pa.array(at[begin]), pa.array(at[last] - at[begin] + width), source.dictionary.take(pa.array(code[begin])), pa.array(place[begin])],
                    ["doc_id", "start", "length", "source", "source_start"],
                )

    first = windows.groupBy("hash").agg(F.min("doc_id").alias("low"), F.min_by("at", "doc_id").alias("place"), F.max("doc_id").alias("high")).filter("low < high")
    first = tables.store(first.select("hash", "low", "place"))
    later = windows.join(first, "hash").filter("doc_id > low or at <> place").groupBy("doc_id").agg(F.collect_list(F.struct("at", "low", "place")).alias("found"))
    out = tables.store(later.mapInArrow(runs, f"doc_id {kind}, start long, length long, source {kind}, source_start long"))
    tables.drop(first)
    return out


def with_words(docs: DataFrame, found: DataFrame, tables: scratch.Tables) -> DataFrame:
    """`doc_id` and `repeats`, a list of (start, length, whether the source is the document itself, words of the source)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = found.select(F.col("source").alias("doc_id"), F.struct(F.col("source_start").alias("at"), "length").alias("asked")).distinct().groupBy("doc_id").agg(F.collect_list("asked").alias("asked"))

    def cite(batches):
        for batch in batches:
            for part in text.slices(batch):
                s = _Slice(part.column("text"))
                for k in range(part.num_rows):
                    asked = part.column("asked")[k].values
                    at, length = (asked.field(f).to_numpy() for f in ("at", "length"))
                    ok = np.flatnonzero(at + length <= s.first[k + 1] - s.first[k])  # another row of the same id may be shorter
                    for a in range(0, len(ok), 4096):
                        now = ok[a : a + 4096]
                        begin = at[now] + s.first[k]
                        words = [s.joined(b, b + n) for b, n in zip(begin.tolist(), length[now].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(np.full(len(now), k))), pa.array(at[now]), pa.array(length[now]), pa.array(words, pa.string())], ["source", "source_start", "length", "words"])

    cited = tables.store(docs.select("doc_id", "text").join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(cite, f"source {kind}, source_start long, length long, words string"))
    joined = found.join(cited, ["source", "source_start", "length"])
    out = tables.store(joined.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", (F.col("doc_id") == F.col("source")).alias("own"), "words")).alias("repeats")))
    tables.drop(cited)
    return out


def _equal(s: _Slice, row: int, start: int, length: int, words: str, width: int) -> list[tuple[int, int]]:
    """Stretches of `width` words or more of a row, from `start` on, that are the same as `words`."""
    begin, end = int(s.first[row]) + start, min(int(s.first[row]) + start + length, int(s.first[row + 1]))
    if end - begin == length and s.joined(begin, end) == words:
        return [(begin, end)]
    other = words.split(" ")
    same = np.array([s.data[s.starts[k] : s.ends[k]].tobytes().decode() == other[k - begin] for k in range(begin, end)], dtype=bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    return [(begin + a, begin + b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= width]


def compare(docs: DataFrame, repeats: DataFrame, width: int, bits: int) -> DataFrame:
    """`doc_id`, `key` of the text, `gone` (begin, end, begin, end, ... of words equal to another document's) and the windows `at`, `hash` equal to no source."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def starts(stretches: list[tuple[int, int]]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b - width + 1) for a, b in stretches)])

    def job(batches):
        for batch in batches:
            for part in text.slices(batch):
                s = _Slice(part.column("text"))
                gone: list[list[int]] = []
                at: list[np.ndarray] = []
                hashes: list[np.ndarray] = []
                for k, found in enumerate(part.column("repeats")):
                    first, end = int(s.first[k]), int(s.first[k + 1])
                    equal, removed, differ = [], [], []
                    for item in found.values:
                        start, length = item["start"].as_py(), item["length"].as_py()
                        same = _equal(s, k, start, length, item["words"].as_py(), width)
                        equal += same
                        removed += [] if item["own"].as_py() else same
                        if same != [(first + start, first + start + length)]:
                            differ.append((first + start, min(first + start + length, end)))
                    union: list[int] = []
                    for a, b in sorted(removed):
                        if union and a - first <= union[-1]:
                            union[-1] = max(union[-1], b - first)
                        else:
                            union += [a - first, b - first]
                    gone.append(union)
                    left = np.setdiff1d(starts(differ), starts(equal)) if differ else np.zeros(0, np.int64)
                    if len(left) and not hasattr(s, "hashes"):
                        s.windows(width, bits)
                    at.append(left - first)
                    hashes.append(s.hashes[np.searchsorted(s.at, left)].view(np.int64) if len(left) else left)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(gone, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int64())).cast(pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))],
                    ["doc_id", "key", "gone", "at", "hash"],
                )

    rows = docs.select("doc_id", "text", F.sha2("text", 256).alias("key")).join(repeats, "doc_id").select("doc_id", "text", "key", "repeats")
    return rows.mapInArrow(job, f"doc_id {kind}, key string, gone array<long>, at array<int>, hash array<long>")


def covered(docs: DataFrame, width: int = 13, bits: int = 64) -> DataFrame:
    """`doc_id`, `key` (SHA-256 of the text) and `gone`, the stretches of words that stand in a window of an earlier document.

    `bits` of a window's hash match it to its first holder; fewer cost more rounds, the result is the same.
    """
    docs, tables, done = docs.select("doc_id", "text").filter("doc_id is not null"), scratch.Tables(), []
    windows, before = shared_windows(docs, width, bits, tables), None
    while True:
        found = repeats(windows, width, tables)
        if not done:
            tables.drop(windows)
        words = with_words(docs, found, tables)
        checked = tables.store(compare(docs, words, width, bits))
        tables.drop(found, words)
        done.append(checked.select("doc_id", "key", "gone"))
        open_ = checked.agg(F.sum(F.size("at"))).first()[0] or 0
        # every round settles a window of each hash; only rows of one id could bring back a settled one
        if not open_ or (before is not None and open_ >= before):
            break
        windows, before = checked.select("doc_id", F.explode(F.arrays_zip("at", "hash")).alias("w")).select("doc_id", "w.at", "w.hash"), open_
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("gone")).alias("gone"))


def dedup(docs: DataFrame, width: int = 13, prefix: str = "", bits: int = 64) -> DataFrame:
    """`docs` with `n_words`, `n_removed`, `kept_text` (words left, joined by a space) and `spans` of removed words.

    These names, after `prefix`, replace columns of the same names.
    """
    figures = ["n_words", "n_removed", "kept_text", "spans"]
    names = [c for c in docs.columns if c not in {prefix + f for f in figures}]
    rows = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in names if c not in ("doc_id", "text")), F.lit(0).alias("_")).alias("_row"), F.sha2("text", 256).alias("key"))
    joined = rows.join(covered(docs, width, bits), ["doc_id", "key"], "left").select("doc_id", "text", "_row", "gone")

    def job(batches):
        for batch in batches:
            for part in text.slices(batch):
                s = _Slice(part.column("text"))
                n = len(s.starts)
                change = np.zeros(n + 1, np.int64)
                for k, found in enumerate(part.column("gone")):
                    if found.is_valid:
                        ends = found.values.to_numpy() + s.first[k]
                        np.add.at(change, ends[::2], 1)
                        np.add.at(change, ends[1::2], -1)
                gone = np.cumsum(change)[:n] > 0
                removed = np.concatenate([[0], np.cumsum(gone)])[s.first]
                keep = np.flatnonzero(~gone)
                first = np.searchsorted(keep, s.first)
                size = s.ends[keep] - s.starts[keep] + 1
                offs = np.concatenate([[0], np.cumsum(size)])
                body = np.full(offs[-1], 0x20, np.uint8)
                source = np.repeat(s.starts[keep] - offs[:-1], size) + np.arange(offs[-1])
                letter = np.ones(offs[-1], dtype=bool)
                letter[offs[1:] - 1] = False
                body[letter] = s.data[source[letter]]
                raw = body.tobytes()
                at = offs[first]
                texts = [raw[a : max(a, b - 1)].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans: list[list[int]] = [[] for _ in range(part.num_rows)]
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    for r in range(int(np.searchsorted(s.first, a, side="right")) - 1, int(np.searchsorted(s.first, b, side="left"))):
                        x, y = max(a, int(s.first[r])), min(b, int(s.first[r + 1]))
                        if x < y:
                            spans[r] += [x - int(s.first[r]), y - int(s.first[r])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text"), part.column("_row"), pa.array(np.diff(s.first)), pa.array(np.diff(removed)), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.int64()))],
                    ["doc_id", "text", "_row", "n_words", "n_removed", "kept_text", "spans"],
                )

    schema = joined.drop("gone").schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string").add("spans", T.ArrayType(T.LongType()))
    out = joined.mapInArrow(job, schema)
    return out.select(*(c if c in ("doc_id", "text") else F.col(f"_row.`{c}`") for c in names), *(F.col(f).alias(prefix + f) for f in figures))
