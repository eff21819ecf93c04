"""Tables written between jobs, and order statistics and running sums that no single task has to hold."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import ratio

#: Rows that one task may sort for an exact quantile, and ranges counted in a pass.
FEW, RANGES = 200_000, 4096


def stored(df: DataFrame) -> DataFrame:
    """Write a DataFrame below `spark.checkpoint.dir`, which the driver and all executors share, and read it back."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spendlake-")
    path = f"{base.rstrip('/')}/spendlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running(df: DataFrame, values: Mapping[str, Column], order: Sequence[Column], by: Sequence[str] = (), totals: Mapping[str, str] | None = None) -> DataFrame:
    """Add for each name the sum of its value over all rows before, in order, within `by`; for each key of `totals` the sum of the value it names over all rows of `by`.

    Rows are range-partitioned by `by` and `order`, and written once with the number of their partition, so
    that both readings see the same partitions. Each partition's totals, a row for each key of `by` in it,
    are summed over partitions; a running sum within the partition is added. No task holds more than a range.
    """
    keys = [F.col(c) for c in by]
    rows = df.withColumns({f"_v_{n}": c for n, c in values.items()})
    dealt = stored(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part", *by).agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values))
    upto = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    base = sums.select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_k_{c}") for c in by), *(F.coalesce(F.sum(f"_s_{n}").over(upto), F.lit(0)).alias(f"_b_{n}") for n in values), *(F.sum(f"_s_{v}").over(Window.partitionBy(*by)).alias(n) for n, v in (totals or {}).items()))
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in values})
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    out = out.join(base, same)
    return out.select(*df.columns, *((F.col(f"_b_{n}") + F.col(f"_i_{n}")).alias(n) for n in values), *(totals or {}))


def beside(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of `left` with the other columns of the row of `right` that has the same `by`, where null equals null; without `by`, of its only row."""
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return left.join(right.withColumnsRenamed({c: f"_k_{c}" for c in by}), same, "left").drop(*(f"_k_{c}" for c in by))


def sampled(df: DataFrame, k: int, id_column: str, by: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """The `k` rows of each group, or of all, of smallest md5 of (seed, id): a bounded sample, the same in every run.

    The smallest of each of 256 parts of a group are found first, from partial limits of every task, and the sample among
    those, so no task sorts a group and nothing is sorted as a whole. Equal ids go by all other columns.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(id_column).cast("string")).cast("binary")))
    order = ["_h", id_column, *(c for c in df.columns if c != id_column)]
    first = Window.partitionBy(*by, F.substring("_h", -2, 2)).orderBy(*order)
    last = Window.partitionBy(*by, F.lit(0)).orderBy(*order)  # `k` rows of 256 parts at most
    some = hashed.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k)
    return some.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= k).select(df.columns)


def _ranked(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """`g, rank, v`: the value `x` of each wanted rank, from 0, within its group.

    Each pass counts the values in play in `RANGES` equal ranges for all wanted ranks at once, with partial sums, and
    goes on in the range that holds the rank, until its values are equal or few enough for one task to sort.
    """
    finite = F.when(F.abs("x") < float("inf"), F.col("x"))  # infinite values lie below or above all ranges
    figures = (F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.coalesce(F.min(finite), F.lit(0.0)).alias("first"), F.coalesce(F.max(finite), F.lit(0.0)).alias("last"))
    now, out = stored(ranks.join(rows.groupBy("g").agg(*figures), "g").withColumn("below", F.lit(0).cast("long"))), []
    while True:
        out.append(now.filter("low = high").select("g", "rank", F.col("low").alias("v")))
        own = rows.join(now.filter("low < high").select("g", "rank", "n", "low", "high", "first", "last", "below"), "g").filter("x between low and high")
        few = own.filter(F.col("n") <= FEW).groupBy("g", "rank").agg(F.sort_array(F.collect_list("x")).alias("held"), F.max("below").alias("below"))
        out.append(few.select("g", "rank", F.get("held", (F.col("rank") - F.col("below")).cast("int")).alias("v")))
        if not now.filter((F.col("n") > FEW) & F.expr("low < high")).limit(1).count():
            break
        part = ratio(F.col("x") / 2 - F.col("first") / 2, F.col("last") / 2 - F.col("first") / 2)  # halves, as the difference may be too large
        at = F.when(F.col("x") < F.col("first"), -1).when(F.col("x") > F.col("last"), RANGES).otherwise(F.coalesce(F.least(F.floor(part * RANGES), F.lit(RANGES - 1)), F.lit(0)))
        counts = own.filter(F.col("n") > FEW).withColumn("at", at.cast("int")).groupBy("g", "rank", "below", "at").agg(*figures)
        upto = Window.partitionBy("g", "rank").orderBy("at")  # `RANGES` rows or so
        counts = counts.withColumn("end", F.col("below") + F.sum("n").over(upto)).filter("end - n <= rank and rank < end")
        now = stored(counts.withColumn("below", F.col("end") - F.col("n")).drop("end", "at"))
    return reduce(DataFrame.unionByName, out)


def _mixed(a: Column, b: Column, pos: Column) -> Column:
    """The value at `pos` between those of the ranks below and above it."""
    return F.when(a == b, a).otherwise((F.ceil(pos) - pos) * a + (pos - F.floor(pos)) * b)


def _sorted(rows: DataFrame, levels: Mapping[str, float]) -> DataFrame:
    """`g` and a column for each name of `levels`, of groups of `FEW` values at most: values cross once, by group, and are sorted there."""
    order = Window.partitionBy("g").orderBy("x")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = rows.select("g", "x", (F.row_number().over(order) - 1).alias("r"), F.count("*").over(whole).alias("n"))
    pos = lambda q, n: F.lit(float(q)) * (n - 1)
    spots = [(F.floor(pos(q, F.col("n"))), F.ceil(pos(q, F.col("n")))) for q in levels.values()]
    near = placed.filter(reduce(lambda a, b: a | b, (F.col("r").isin(*two) for two in spots)))
    at = lambda spot, name: F.max(F.when(F.col("r") == spot, F.col("x"))).alias(name)
    ends = near.groupBy("g").agg(F.max("n").alias("n"), *(at(two[k], f"{side}{j}") for j, two in enumerate(spots) for k, side in enumerate("ab")))
    return ends.select("g", *(_mixed(F.col(f"a{j}"), F.col(f"b{j}"), pos(q, F.col("n"))).alias(name) for j, (name, q) in enumerate(levels.items())))


def quantiles(df: DataFrame, value: str | Column, levels: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """`by` and a column for each name of `levels`: exact quantiles of each group, by linear interpolation, null and NaN left out.

    Groups of up to `FEW` values are sorted once they met. For larger ones the values of the ranks are found in
    passes over all of them, so that no task holds a group's values, be it one group of all rows.
    """
    group = F.struct(*(F.col(c).alias(f"k{j}") for j, c in enumerate(by))) if by else F.struct(F.lit(0).alias("k0"))
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = stored(df.select(group.alias("g"), x.alias("x")).filter("x is not null and not isnan(x)"))
    counts = rows.groupBy("g").agg(F.count("*").alias("size"))
    large = stored(counts.filter(F.col("size") > FEW))
    plain = lambda part: _sorted(part, levels)
    if large.limit(1).count():
        pos = F.col("level") * (F.col("size") - 1)
        wanted = large.withColumn("w", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("level")) for n, q in levels.items())))).select("g", "size", "w.*")
        wanted = wanted.select("g", "name", pos.alias("pos"), F.floor(pos).alias("down"), F.ceil(pos).alias("up"))
        ranks = wanted.select("g", F.explode(F.array("down", "up")).alias("rank")).distinct()
        many = rows.join(large, "g", "left_semi")
        values = stored(_ranked(many, ranks))
        both = wanted.join(values.select("g", F.col("rank").alias("down"), F.col("v").alias("a")), ["g", "down"]).join(values.select("g", F.col("rank").alias("up"), F.col("v").alias("b")), ["g", "up"])
        mixed = _mixed(F.col("a"), F.col("b"), F.col("pos"))
        found = both.groupBy("g").agg(*(F.max(F.when(F.col("name") == n, mixed)).alias(n) for n in levels))
        out = plain(rows.join(large, "g", "left_anti")).unionByName(found)
    else:
        out = plain(rows)
    return out.select(*(F.col(f"g.k{j}").alias(c) for j, c in enumerate(by)), *levels)


def quantile(df: DataFrame, value: str, level: float, name: str) -> DataFrame:
    """One row with the exact quantile of a column, null where it holds no value."""
    return beside(df.sparkSession.range(1).select(), quantiles(df, value, {name: level}), ())
