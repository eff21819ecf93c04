"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, a temperature.

1. Every word (a run of letters and digits, or a run of symbols) has an index vector: a few +1 and -1 at
   places drawn from its hash. Over all documents, each of `BUCKETS` hashed words sums the index vectors
   of its neighbours, `REACH` to either side. These sums, centred and scaled, are the word vectors.
2. A document is the mean of its words' vectors and of their own index vectors.
3. At most `FIT_ROWS` labelled rows (those of smallest hash) train a network of one hidden layer in numpy;
   a quarter of them, set apart, picks the temperature that divides the logits.
4. All documents are scored on the executors.

Rows: null and empty texts pool to the zero vector and get a score too. Texts of any length are pooled whole.
Repeated rows get a result each; of rows of one `doc_id` the smallest vector is fitted, and of its labels the
greatest, so ties are settled alike in every run. Null `doc_id`s are kept, with `held_out` false. Other columns
are not looked at, so their names cannot clash. Labels of null `quality` are not used. Without labels of
both kinds the score is the share of good labels (0.5 without any). An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, text

BUCKETS, DIM, REACH, NONZERO = 4096, 32, 2, 4
FIT_ROWS = 20_000
HIDDEN, EPOCHS = 32, 40

_ALNUM = np.ones(256, dtype=bool)
_ALNUM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_SYMBOL = ~_ALNUM & text.WORD


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes in order and the row of each."""
    data, offsets = text.buffers(column)
    found = [text.spans(data, offsets, table)[:2] for table in (_ALNUM, _SYMBOL)]
    starts, ends = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    return text.word_hashes(data, starts, ends), np.searchsorted(offsets, starts, side="right") - 1


def _index(h: np.ndarray):
    """Places and signs of the non-zeros of index vectors."""
    h = text.mix(h ^ np.uint64(0xA5A5A5A5))
    for k in range(NONZERO):
        part = (h >> np.uint64(16 * k)).astype(np.int64)
        yield part % DIM, 1 - 2 * ((part >> 8) & 1)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """`BUCKETS` x `DIM` sums over the whole corpus; their size does not depend on it."""

    def job(batches):
        total = np.zeros(BUCKETS * DIM)
        for batch in batches:
            for part in text.slices(batch):
                h, row = _tokens(part.column("text"))
                bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
                for place, sign in _index(h):
                    for k in range(1, REACH + 1):
                        same = row[k:] == row[:-k]
                        total += np.bincount(bucket[k:] * DIM + place[:-k], sign[:-k] * same, BUCKETS * DIM)
                        total += np.bincount(bucket[:-k] * DIM + place[k:], sign[k:] * same, BUCKETS * DIM)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS), pa.int32()), *map(pa.array, total.reshape(BUCKETS, DIM).T)], ["bucket", *names])

    names = [f"x{k}" for k in range(DIM)]
    sums = docs.select("text").mapInArrow(job, "bucket int, " + ", ".join(f"{x} double" for x in names)).groupBy("bucket").agg(*(F.sum(x).alias(x) for x in names))
    out = np.zeros((BUCKETS, DIM))
    for r in sums.collect():  # BUCKETS rows at most
        out[r[0]] = r[1:]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    out = np.divide(out, size, out=np.zeros_like(out), where=size > 0)
    return out - out[size[:, 0] > 0].mean(axis=0) * (size > 0) if size.any() else out


def features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """`doc_id` and `x`, the pooled vector of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors.astype(np.float32))

    def job(batches):
        table = shared.value
        for batch in batches:
            for part in text.slices(batch):
                h, row = _tokens(part.column("text"))
                n = part.num_rows
                used = np.bincount(row, minlength=n)
                bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
                own = np.zeros(n * DIM)
                for place, sign in _index(h):
                    own += np.bincount(row * DIM + place, sign, n * DIM)
                pooled = np.zeros((n, DIM))
                some = np.flatnonzero(used)
                if len(some):
                    pooled[some] = np.add.reduceat(table[bucket], (np.cumsum(used) - used)[some], axis=0)
                x = np.concatenate([pooled, own.reshape(n, DIM)], axis=1) / np.maximum(used, 1)[:, None]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float32()), 2 * DIM).cast(pa.list_(pa.float32()))], ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(job, f"doc_id {kind}, x array<float>")


class Network:
    """Two layers in numpy: tanh, then a logit; Adam on weighted log loss; a temperature on rows set apart."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3):
        self.rate = float(y.mean()) if len(y) else 0.5
        self.constant = not len(y) or not 0 < self.rate < 1
        self.temperature = 1.0
        if self.constant:
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        order = rng.permutation(len(x))
        apart, fit = order[: len(x) // 4], order[len(x) // 4 :]
        x = (x - self.mean) / self.scale
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
                hidden = np.tanh(x[at] @ p[0] + p[1])
                error = (1 / (1 + np.exp(-(hidden @ p[2] + p[3]))) - y[at]) / len(at)
                inner = error[:, None] * p[2] * (1 - hidden**2)
                grads = [x[at].T @ inner + 1e-4 * p[0], inner.sum(axis=0), hidden.T @ error + 1e-4 * p[2], error.sum(keepdims=True)]
                t += 1
                for k, g in enumerate(grads):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    p[k] -= 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p = p
        if len(apart):
            logit, good = self._logit(x[apart]), y[apart]
            losses = {s: float(np.logaddexp(0, np.where(good > 0, -logit, logit) / s).mean()) for s in np.geomspace(0.25, 8, 41)}
            self.temperature = float(min(losses, key=losses.get))

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant:
            return np.full(len(x), self.rate)
        logit = self._logit((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id, held_out, score, predicted` of every document, learned from labels of rows not held out."""
    table = scratch.stored(features(docs, word_vectors(docs)))
    good = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    labelled = table.join(good.filter(~held_out()), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("y").alias("y"))
    fit = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).select("x", "y").toPandas()
    net = Network(np.stack(fit["x"]).astype(float) if len(fit) else np.zeros((0, 2 * DIM)), fit["y"].to_numpy(float))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def job(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            score = shared.value.score(x.astype(float)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = table.mapInArrow(job, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
