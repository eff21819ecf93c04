"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words. A document's expected number of copies is its source's rate, target
over size, raised for long documents and lowered for short ones (`TILT`), so that the expected words of a
source are its target exactly. Whole copies of that are certain; the fraction left is the document's inclusion
probability p, which so differs from document to document. Each document draws a fixed uniform number u from
a hash of its id and text, and the documents of a source are ranked by the random odds u / (1 - u) over the
inclusion odds p / (1 - p). The first in that order get one copy more, up to the words the source still lacks;
where the next would take it past them, documents that still fit are taken in the same order.

Ranks are not sorted in one task: they are cut into `BUCKETS` ranges, sizes are summed by source and range,
and only the range in which a source's words run out is sorted, with the ranges after it that hold the next
`SPARE` documents. That is about one in `BUCKETS` of a source's rows, whatever its size.

Rows: null text has size 0. Null `source` is a source of its own, after all others. Repeated rows are
documents of their own; they tie and are told apart by nothing, so either may be taken. A source without words
gets target 0 and takes nothing. Texts of any length are counted whole. Other columns are not looked at, so
their names cannot clash. An empty table gives an empty result. One row for each source is held on the driver:
up to some hundred thousand sources.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 1 << 14
SPARE = 256
#: How far expected copies lean towards long documents, and the size in words that counts as half long.
TILT, HALF = 0.5, 500.0


def targets(sources: Sequence[tuple[str | None, int]], weights: Sequence[int], share: float, most: float) -> dict[str | None, float]:
    """Target words of each source: `share` of all words by weight, none above `most` times its own words."""
    ordered = sorted(sources, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {name: weights[k % len(weights)] for k, (name, _) in enumerate(ordered)}
    size = dict(ordered)
    left, open_, out = share * sum(size.values()), list(size), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * size[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = most * size[s]
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def _tilt(rate: float, mean: float, most: int) -> float:
    """The largest lean up to `TILT` that leaves expected copies between 0 and `most`."""
    if rate <= 0 or not 0 < mean < 1:
        return 0.0
    return max(0.0, min(TILT, 1 / mean, (most / rate - 1) / (1 - mean)))


def expected(docs: DataFrame, weights: Sequence[int], share: float, most: int, seed: int) -> DataFrame:
    """Documents with `size`, their source's figures, `whole` copies, inclusion probability `p` and `rank` in (0, 1)."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    rows = scratch.stored(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), u.alias("u")))
    long_ = F.col("size") / (F.col("size") + HALF)
    per = rows.groupBy("source").agg(F.sum("size").alias("n"), F.sum(F.round(F.col("size") * long_, 6).cast("decimal(38,6)")).cast("double").alias("long")).collect()  # one row for each source
    aims = targets([(r["source"], r["n"]) for r in per], weights, share, most)
    rates = [(aims[r["source"]] / r["n"], r["long"] / r["n"]) if r["n"] else (0.0, 0.0) for r in per]
    plan = {
        "key": pa.array(["n" if r["source"] is None else "s" + r["source"] for r in per], pa.string()),
        "source_size": pa.array([r["n"] for r in per], pa.int64()),
        "target": pa.array([float(aims[r["source"]]) for r in per], pa.float64()),
        "rate": pa.array([x for x, _ in rates], pa.float64()),
        "mean": pa.array([x for _, x in rates], pa.float64()),
        "tilt": pa.array([_tilt(*x, most) for x in rates], pa.float64()),
    }
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    rows = rows.withColumn("key", key).join(docs.sparkSession.createDataFrame(pa.table(plan)), "key")  # local rows of known size, so Spark decides on a broadcast
    copies = F.least(F.col("rate") * (1 + F.col("tilt") * (long_ - F.col("mean"))), F.lit(float(most)))
    whole = F.least(F.floor(copies + 1e-9), F.lit(most)).cast("int")
    rows = rows.withColumn("whole", whole).withColumn("p", F.when(F.col("size") > 0, F.greatest(copies - whole, F.lit(0.0))).otherwise(0.0))
    odds = F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.col("p")
    return rows.withColumn("rank", F.when(F.col("p") > 0, odds / (1 + odds)))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7) -> DataFrame:
    """`doc_id, source, size, source_size, target, copies, taken` of every document."""
    rows = expected(docs, weights, share, most, seed).select("key", "doc_id", "source", "size", "source_size", "target", "whole", "p", "rank")
    rows = rows.withColumn("bucket", F.floor(F.col("rank") * BUCKETS).cast("int"))
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("n"), F.count("*").alias("docs"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.max("target").alias("target"))
    upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # BUCKETS rows of a source at most
    all_ = Window.partitionBy("key")
    sums = sums.withColumn("lacking", F.col("target") - F.sum("certain").over(all_)).filter("bucket is not null and lacking > 0")
    sums = sums.withColumns({"end": F.sum("n").over(upto), "held": F.sum("docs").over(upto)})
    ends = sums.groupBy("key").agg(
        F.min(F.when(F.col("end") >= F.col("lacking"), F.col("bucket"))).alias("cut"),
        F.max(F.when(F.col("end") < F.col("lacking"), F.col("end"))).alias("before"),
        F.min(F.when(F.col("end") >= F.col("lacking"), F.col("held"))).alias("held"),
        F.max("lacking").alias("lacking"),
    )
    after = sums.join(ends.select("key", F.col("held").alias("reached"), "cut"), "key").filter("cut is null or bucket >= cut").groupBy("key").agg(F.min(F.when(F.col("held") >= F.col("reached") + SPARE, F.col("bucket"))).alias("upto"))
    edges = ends.join(after, "key", "left").select("key", F.coalesce("cut", F.lit(BUCKETS)).alias("cut"), F.coalesce("upto", F.lit(BUCKETS)).alias("upto"), (F.col("lacking") - F.coalesce("before", F.lit(0))).alias("gap"))
    edges = docs.sparkSession.createDataFrame(edges.toArrow())  # one row for each source
    rows = rows.join(edges, "key", "left")
    edge = rows.filter("bucket >= cut and bucket <= upto and whole < " + str(most))
    others = rows.filter(f"bucket is null or cut is null or bucket < cut or bucket > upto or whole >= {most}")
    names = ["doc_id", "source", "size", "source_size", "target", "whole", "extra"]
    chosen = edge.groupBy("key").applyInPandas(_fill, edge.select("doc_id", "source", "size", "source_size", "target", "whole", F.lit(0).alias("extra")).schema)
    extra = F.when(F.col("bucket").isNotNull() & (F.col("bucket") < F.col("cut")) & (F.col("whole") < most), 1).otherwise(0)
    copies = F.col("whole") + F.col("extra")
    both = others.withColumn("extra", extra).select(names).unionByName(chosen)
    return both.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a source's documents at the edge, in order of rank, those that still fit; then the next if that comes nearer."""
    rows = rows.sort_values(["rank", "doc_id", "size"], kind="stable")
    gap, extra = float(rows["gap"].iloc[0]), []
    for size in rows["size"].tolist():
        extra.append(int(size <= gap))
        gap -= size * extra[-1]
    left = [(abs(gap - s), k) for k, (s, e) in enumerate(zip(rows["size"].tolist(), extra, strict=True)) if not e]
    if left and min(left)[0] < gap:
        extra[min(left)[1]] = 1
    return rows.assign(extra=extra)[["doc_id", "source", "size", "source_size", "target", "whole", "extra"]]
