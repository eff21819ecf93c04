"""Statistics shared by operators. Ratios over zero are null; nothing here makes a NaN."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def flag(c: str | Column) -> Column:
    """A flag whose null counts as false."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def concentration(hhi: Column) -> Column:
    """Class of a Herfindahl-Hirschman index on the scale to 10,000."""
    return F.when(hhi.isNull(), "indefinido").when(hhi < 1500, "nao concentrado").when(hhi < 2500, "moderadamente concentrado").otherwise("altamente concentrado")


def _z(off: Column, mad: Column, std: Column, value: Column) -> Column:
    return F.when(mad > 0, 0.6745 * off / mad).when(std > 0, off / std).when(mad.isNotNull() & value.isNotNull(), F.lit(0.0))


def _in_passes(df: DataFrame, group: str, value: str, least: int, name: str) -> DataFrame:
    """`modified_zscore` of groups that no task may hold."""
    from .tables import quantiles

    known = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).alias("_x"))
    center = known.groupBy("_g").agg(F.count("*").alias("_n"), F.stddev_samp("_x").alias("_std")).join(quantiles(known, "_x", {"_med": 0.5}, ["_g"]), "_g", "left")
    off_center = known.join(center.filter(F.col("_n") >= least), "_g")
    spread = quantiles(off_center, F.abs(F.col("_x") - F.col("_med")), {"_mad": 0.5}, ["_g"])
    z = _z(F.col(value) - F.col("_med"), F.col("_mad"), F.col("_std"), F.col(value))
    return df.join(center.join(spread, "_g"), df[group] == F.col("_g"), "left").withColumn(name, z).drop("_g", "_n", "_med", "_std", "_mad")


def _in_windows(df: DataFrame, group: str, names: Mapping[str, str], least: int, size: str) -> DataFrame:
    """`modified_zscores` of groups that a task may hold: rows cross once, by group, for all values."""
    own, nothing = Window.partitionBy(group), F.lit(None).cast("double")
    x = {n: F.nanvl(F.col(v).cast("double"), nothing) for n, v in names.items()}
    out = df.withColumn(size, F.count("*").over(own))
    for n, v in names.items():
        out = out.withColumns({f"_n_{n}": F.count(v).over(own), f"_std_{n}": F.stddev_samp(v).over(own), f"_med_{n}": F.percentile(x[n], 0.5).over(own)})
    for n in names:
        out = out.withColumn(f"_mad_{n}", F.percentile(F.nanvl(F.abs(x[n] - F.col(f"_med_{n}")), nothing), 0.5).over(own))
    z = {n: F.when((F.col(f"_n_{n}") >= least) & F.col(f"_mad_{n}").isNotNull(), _z(F.col(v) - F.col(f"_med_{n}"), F.col(f"_mad_{n}"), F.col(f"_std_{n}"), F.col(v))) for n, v in names.items()}
    return out.select(*df.columns, size, *(c.alias(n) for n, c in z.items()))


def modified_zscores(df: DataFrame, group: str, names: Mapping[str, str], least: int = 5, size: str = "group_rows") -> DataFrame:
    """Add the number of rows of the group as `size` and, for each name, 0.6745 (x - median) / MAD of its value within the group.

    Where the MAD is zero the sample deviation takes its place without the factor, and 0 if that is zero
    or null too. Null in groups of fewer than `least` values, for null values and for null keys. Groups of
    more than `FEW` rows go apart, and their medians are found in passes, so no task holds such a group.
    """
    from . import tables

    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_size"))
    apart = tables.stored(sizes.filter((F.col("_size") > tables.FEW) | F.col("_g").isNull()))  # a key for each `FEW` rows, and null
    large, keyless = apart.filter("_g is not null"), apart.filter("_g is null").limit(1).count()
    rows = df.filter(F.col(group).isNotNull()) if keyless else df
    if not large.limit(1).count():
        out = _in_windows(rows, group, names, least, size)
    else:
        same = F.col(group) == F.col("_g")
        out = _in_windows(rows.join(F.broadcast(large), same, "left_anti"), group, names, least, size)
        many = rows.join(F.broadcast(large), same).drop("_g").withColumnRenamed("_size", size)
        for n, v in names.items():
            many = _in_passes(many, group, v, least, n)
        out = out.unionByName(many)
    if keyless:
        nothing = {size: F.lit(None).cast("long")} | {n: F.lit(None).cast("double") for n in names}
        out = out.unionByName(df.filter(F.col(group).isNull()).withColumns(nothing))
    return out


def modified_zscore(df: DataFrame, group: str, value: str, least: int = 5, name: str = "z") -> DataFrame:
    """`modified_zscores` of one value."""
    return modified_zscores(df, group, {name: value}, least, "_rows").drop("_rows")
