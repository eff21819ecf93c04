"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, hnsw, licenses, mixing, packing, periodic, pii, rules, search, simhash, substring, token_files, tokens

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_token_files(spark, sf_dir):
    return token_files.round_trip(_table(spark, sf_dir, "documents"), WORD_BPE)


def op3_embedding_near_dedup(spark, sf_dir):
    return hnsw.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_substring_dedup(spark, sf_dir):
    out = substring.dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_source_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash_near_dedup(spark, sf_dir):
    return simhash.groups(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return tokens.token_counts(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op9_quality_rules(spark, sf_dir):
    return rules.judge(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark, sf_dir):
    return classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_ranked_search(spark, sf_dir):
    return search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_personal_data(spark, sf_dir):
    return pii.digest(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark, sf_dir):
    return periodic.digest(periodic.planted(_table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_token_files,
        op3_embedding_near_dedup,
        op4_substring_dedup,
        op5_source_mixing,
        op6_simhash_near_dedup,
        op7_license_scan,
        op8_token_counts,
        op9_quality_rules,
        op10_quality_classifier,
        op11_ranked_search,
        op12_personal_data,
        op13_periodic_runs,
    )
}

SQL = {"op9_quality_rules": rules.SQL, "op11_ranked_search": search.SQL}
