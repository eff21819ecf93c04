"""Token ids written as patched frame-of-reference blocks and read back.

A segment is the unit of a file: whole documents, about `SEGMENT` ids, in ascending `doc_id` order. Its
ids are cut into blocks of `BLOCK`. A block stores its minimum, then each id less the minimum at a width
that holds `SHARE` of them; the high bits of the others are exceptions, a list of positions and values.
An index gives the byte where each block starts, so any id can be read without decoding what comes
before. Segments are rows of a Parquet table in the shared folder, one file or more per range of
`doc_id`s, with the documents' ids and token numbers beside the blocks.

Rows: null text counts as empty (the end id alone). A null `doc_id` sorts first. Rows of one `doc_id`
are written one after the other and keep a result each. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, text
from .bpe import ENCODE_BYTES, Compiled
from .tokens import with_end

BLOCK = 512
SEGMENT = 1 << 16
SHARE = 0.95


def encode_blocks(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Index (uint32 block starts and the end) and payload of a segment's ids."""
    out, starts, at = [], [0], 0
    for k in range(0, len(ids), BLOCK):
        block = ids[k : k + BLOCK].astype(np.uint32)
        low = int(block.min())
        rest = block - np.uint32(low)
        width = int(np.sort(rest)[int(np.ceil(SHARE * len(rest))) - 1]).bit_length()
        odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
        head = np.array([low, width, len(odd), len(block)], "<u4").tobytes()
        bits = (rest[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
        packed = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        patch = odd.astype("<u2").tobytes() + (rest[odd] >> np.uint32(min(width, 31))).astype("<u4").tobytes()
        out += [head, packed, patch]
        at += len(head) + len(packed) + len(patch)
        starts.append(at)
    return np.array(starts, "<u4").tobytes(), b"".join(out)


def decode_block(payload, start: int) -> np.ndarray:
    """Ids of the block that starts at a byte of the payload."""
    low, width, n_odd, n = (int(x) for x in np.frombuffer(payload, "<u4", 4, start))
    at = start + 16
    size = -(-n * width // 8)
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    rest = bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32)) if width else np.zeros(n, np.uint32)
    odd = np.frombuffer(payload, "<u2", n_odd, at + size)
    high = np.frombuffer(payload, "<u4", n_odd, at + size + 2 * n_odd)
    rest[odd] |= high << np.uint32(min(width, 31))
    return rest + np.uint32(low)


def decode_blocks(index, payload) -> np.ndarray:
    """All ids of a segment."""
    starts = np.frombuffer(index, "<u4")[:-1]
    return np.concatenate([decode_block(payload, int(s)) for s in starts]) if len(starts) else np.zeros(0, np.uint32)


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 2) -> None:
    """Encode every text and write its ids to segments under `path`."""
    compiled = Compiled(docs.sparkSession, tokenizer)

    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow_kind = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def job(batches):
        from pyspark import TaskContext

        shard, segment, start = TaskContext.get().partitionId(), 0, 0
        names, lengths, held = [], [], []

        def flush():
            nonlocal segment, start, names, lengths, held
            ids = np.concatenate(held)
            index, payload = encode_blocks(ids)
            row = [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64())]
            row += [pa.array([names], pa.list_(arrow_kind)), pa.array([lengths], pa.list_(pa.int64())), pa.array([index], pa.binary()), pa.array([payload], pa.binary())]
            segment, start, names, lengths, held = segment + 1, start + len(ids), [], [], []
            return pa.RecordBatch.from_arrays(row, ["shard", "segment", "start", "n", "doc_ids", "lengths", "index", "payload"])

        for batch in batches:
            for part in text.slices(batch, size=ENCODE_BYTES):
                counts, ids = compiled.encoder().encode(part.column("text"))
                ids, offsets = with_end(counts, ids, end)
                named, sizes, a = part.column("doc_id").to_pylist(), np.diff(offsets).tolist(), 0
                total = sum(lengths)
                for k, (name, n) in enumerate(zip(named, sizes, strict=True)):
                    names.append(name)
                    lengths.append(n)
                    total += n
                    if total >= SEGMENT:
                        held.append(ids[offsets[a] : offsets[k + 1]])
                        a, total = k + 1, 0
                        yield flush()
                held.append(ids[offsets[a] :])
        if names:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    schema = f"shard int, segment int, start long, n long, doc_ids array<{kind}>, lengths array<bigint>, index binary, payload binary"
    ordered.mapInArrow(job, schema).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """`doc_id, start, n_tokens, ids_crc32` of every document, decoded from the segments under `path`.

    `start` counts the ids of all documents before. One row per shard, its number of ids, is summed over
    shards; within a shard each segment knows its own start.
    """
    segments = spark.read.parquet(path)
    shards = segments.groupBy("shard").agg(F.sum("n").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def job(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                names = batch.column("doc_ids")[k].values
                lengths = batch.column("lengths")[k].values.to_numpy()
                ids = decode_blocks(batch.column("index")[k].as_buffer(), batch.column("payload")[k].as_buffer())
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(offsets[:-1] + batch.column("start")[k].as_py() + batch.column("base")[k].as_py()), pa.array(lengths), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    joined = segments.join(F.broadcast(bases), "shard")  # a row for each range of ids
    return joined.select("start", "base", "doc_ids", "lengths", "index", "payload").mapInArrow(job, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Write the ids of all documents to a new shared folder, and read their digests back from the files."""
    path = scratch.folder(docs.sparkSession)
    write(docs, path, tokenizer, end)
    return read(docs.sparkSession, path)
