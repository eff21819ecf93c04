"""The corpus pipeline: quality rules, near-dedup, substring dedup, source mixing, packing.

Each stage takes the documents that the stage before left, with the columns of `documents`; the last
returns the placed pieces. Text is null or empty where a stage before left nothing of it; such rows pass
on as empty documents. Rows of one `doc_id` count as one document in the near-dedup and mixing stages;
rows of null `doc_id` pass the near-dedup stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.llm import mixing, near_copies, packing, queries, rules, scratch, substring

#: Near copies: five-word shingles, Jaccard similarity of 4/5 or more. A pair at 4/5 differs in 78 of 512 bits on average (96 for sets of 4 and 5), unrelated texts in 256.
NEAR = {"shingle": 5, "share": (4, 5), "words": 8, "radius": 22, "wide": 128}


def _own(docs: DataFrame) -> list[Column]:
    """The columns of `docs` in order, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies."""
    groups = near_copies.groups(docs, **NEAR)
    kept = groups.filter("doc_id = component_id").select("doc_id").distinct()
    return docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null")).select(_own(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 words or more that an earlier document holds."""
    out = substring.dedup(docs, prefix="_new_")
    text = F.when(F.col("_new_n_removed") > 0, F.col("_new_kept_text")).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(_own(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mixing.mix(docs).filter("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("_copies")).withColumnRenamed("doc_id", "_doc_id")
    joined = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("_doc_id")))
    return joined.select(*_own(docs), F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(_own(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return packing.pack(docs, queries.BYTE_BPE)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("source_mixing", mix_sources), ("best_fit_packing", pack)]

#: SQL cannot express the fingerprints, the random order or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.stored(docs)
    return docs
