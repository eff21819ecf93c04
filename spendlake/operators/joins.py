"""Joins with a declared cardinality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.tables import stored


def duplicated(df: DataFrame, on: list[str]) -> DataFrame:
    """Keys that stand more than once."""
    return df.groupBy(*on).agg(F.count("*").alias("n")).filter("n > 1")


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", cardinality: str = "many_to_one") -> DataFrame:
    """Join after checking that the sides declared `one` have no repeated key; raises ValueError otherwise."""
    for side, df, kind in (("left", left, cardinality.split("_to_")[0]), ("right", right, cardinality.split("_to_")[1])):
        if kind == "one" and duplicated(df, on).limit(1).count():
            raise ValueError(f"keys {on} repeat on the {side} side")
    return left.join(right, on, how)


def same_keys(left: DataFrame, right: DataFrame, on: list[str]) -> bool:
    """Whether both tables hold the same set of keys."""
    a, b = left.select(*on).distinct(), right.select(*on).distinct()
    return not a.join(b, on, "left_anti").limit(1).count() and not b.join(a, on, "left_anti").limit(1).count()


def key_guards(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """`missing, shared, unused`: distinct keys of the left side that the right lacks, that both have, and that only the right has."""
    a = left.select(*on).distinct().withColumn("_a", F.lit(True))
    b = right.select(*on).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, on, "full")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a") & F.col("_b")).alias("shared"), F.count_if(F.col("_a").isNull()).alias("unused"))


def with_headers(rows: DataFrame, headers: DataFrame, key: str, suffix: str = "_header") -> tuple[DataFrame, DataFrame]:
    """Rows with the columns of their header, `suffix` on names that clash, stored; and `rows_before, rows_after, unmatched`, from the pass that wrote them."""
    own = headers.select(F.col(key).alias("_k"), F.lit(True).alias("_found"), *(F.col(c).alias(c + suffix if c in rows.columns else c) for c in headers.columns if c != key))
    seen = Observation()
    joined = rows.join(own, rows[key] == own["_k"], "left").drop("_k")
    joined = stored(joined.observe(seen, F.count(F.lit(1)).alias("after"), F.count_if(F.col("_found").isNull()).alias("unmatched")))
    figures = (rows.count(), seen.get["after"], seen.get["unmatched"])
    return joined.drop("_found"), rows.sparkSession.createDataFrame([figures], "rows_before long, rows_after long, unmatched long")
