"""Token counts by a compiled finite-state transducer (see `bpe`).

Rows: one result per row, repeated rows included; null text counts as empty (0 bytes, 0 tokens); a null
`doc_id` stays null. Special strings inside a text count as the library counts them by default. Very long
texts run through the tables in the same chunks as short ones. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text
from .bpe import ENCODE_BYTES, Compiled


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """`doc_id, n_bytes, n_tokens, over_limit` of each text under the tokenizer file `tokenizer`."""
    compiled = Compiled(docs.sparkSession, tokenizer)

    def job(batches):
        for batch in batches:
            for part in text.slices(batch, size=ENCODE_BYTES):
                _, offsets = text.buffers(part.column("text"))
                counts, _ = compiled.encoder().encode(part.column("text"), want_ids=False)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(counts), pa.array(counts > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(job, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def with_end(counts: np.ndarray, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a batch with the end id after each row's, and each row's offset among them."""
    offsets = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(offsets[-1], end, np.uint32)
    keep = np.ones(offsets[-1], dtype=bool)
    keep[offsets[1:] - 1] = False
    out[keep] = ids
    return out, offsets
