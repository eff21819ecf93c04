"""Vectorised views of Arrow text columns: byte buffers, word spans and word hashes.

All helpers work on one Arrow batch inside a task; Spark partitions the rows. Batches are walked in
slices of about 1 MB of text, so memory does not depend on how many long texts a batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a word `[^\x20\x09-\x0D]+`.
WORD = ~_SPACE
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Words longer than this many bytes are hashed one by one with XXH3, shorter ones eight bytes at a time for a whole slice.
LONG_WORD = 64
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of about `size` bytes of `column`, one row at least."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + size, side="right")))
        yield batch.slice(at, end - at)
        at = end


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and the offsets of its rows."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, offs - offs[0]


def spans(data: np.ndarray, offsets: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of allowed bytes within each row, and each row's first run."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ok = allowed[data]
    cut = offsets[offsets < n]
    before = np.zeros(n, dtype=bool)
    before[1:] = ok[:-1]
    before[cut] = False
    starts = np.flatnonzero(ok & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = ok[1:]
    inner = cut[cut > 0]
    after[inner - 1] = False
    ends = np.flatnonzero(ok & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64 on unsigned 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; equal bytes, equal hash, in every batch and task.

    A word of up to eight bytes goes through one-to-one steps of its bytes and length.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (eight[starts] & _KEEP[np.minimum(lengths, 8)]))
    todo, at = np.flatnonzero((lengths > 8) & (lengths <= LONG_WORD)), 8
    while len(todo):
        rest = lengths[todo] - at
        out[todo] = mix((out[todo] + np.uint64(0xD1B54A32D192ED03)) ^ (eight[starts[todo] + at] & _KEEP[np.minimum(rest, 8)]))
        at += 8
        todo = todo[rest > 8]
    for k in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    return mix(h)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> list[str]:
    """Text of each row: its spans joined by one space; `first` is the first span of each row."""
    size = ends - starts + 1
    offsets = np.concatenate([[0], np.cumsum(size)])
    body = np.full(offsets[-1], 0x20, np.uint8)
    letter = np.ones(offsets[-1], dtype=bool)
    letter[offsets[1:] - 1] = False
    source = np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])
    body[letter] = data[source[letter]]
    raw, at = body.tobytes(), offsets[first].tolist()
    return [raw[a : max(a, b - 1)].decode() for a, b in zip(at[:-1], at[1:], strict=True)]
