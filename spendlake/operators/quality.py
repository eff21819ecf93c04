"""Profiles of raw tables: counts, nulls, duplicates, dates, ranges, units, schema drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..functions.tables import beside, quantiles


def null_profile(df: DataFrame) -> DataFrame:
    """`column, nulls, pct, kind` of every column in one pass over the table."""
    one = df.agg(F.count("*").alias("_rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    kinds = F.create_map(*(F.lit(x) for pair in df.dtypes for x in pair))
    return one.unpivot("_rows", df.columns, "column", "nulls").select("column", "nulls", F.round(F.try_divide(100.0 * F.col("nulls"), F.col("_rows")), 2).alias("pct"), kinds[F.col("column")].alias("kind"))


def key_duplicates(df: DataFrame, *key: str) -> DataFrame:
    """`rows, duplicates, pct`: rows beyond the first of each key; nulls are equal."""
    groups = df.groupBy(*key).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")).withColumn("pct", F.round(F.try_divide(100.0 * F.col("duplicates"), F.col("rows")), 4))


def exact_duplicates(df: DataFrame) -> DataFrame:
    return key_duplicates(df, *df.columns)


def invalid_dates(df: DataFrame, column: str) -> DataFrame:
    """`invalid, first, last`: texts that are no date, apart from nulls, and the range of the others."""
    at = F.col(column).cast("string").try_cast("timestamp")
    return df.agg(F.count_if(at.isNull() & F.col(column).isNotNull()).alias("invalid"), F.min(at).alias("first"), F.max(at).alias("last"))


def value_range(df: DataFrame, column: str, least: float = 0.0) -> DataFrame:
    """`below, zero, missing` counts of a numeric or text column, and the percentages of rows that the first two are."""
    x = F.col(column).try_cast("double")
    pct = lambda c: F.round(100 * ratio(F.count_if(c), F.count("*")), 2)
    return df.agg(F.count_if(x < least).alias("below"), F.count_if(x == 0).alias("zero"), F.count_if(x.isNull()).alias("missing"), pct(x < least).alias("below_pct"), pct(x == 0).alias("zero_pct"))


def code_gaps(df: DataFrame, code: str) -> DataFrame:
    """`n, missing, zero, missing_pct, zero_pct` of a catalogue code."""
    x = F.col(code).try_cast("double")
    pct = lambda c: F.round(100 * ratio(F.count_if(c), F.count("*")), 2)
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(code).isNull()).alias("missing"), F.count_if(x == 0).alias("zero"), pct(F.col(code).isNull()).alias("missing_pct"), pct(x == 0).alias("zero_pct"))


def unit_heterogeneity(df: DataFrame, item: str, unit: str) -> DataFrame:
    """`items, mixed`: items, and those with more than one unit."""
    per = df.filter(F.col(item).isNotNull()).groupBy(item).agg(F.min(unit).alias("a"), F.max(unit).alias("b"))
    return per.agg(F.count("*").alias("items"), F.count_if(F.col("a") != F.col("b")).alias("mixed"))


def multi_unit_items(df: DataFrame, item: str, unit: str, code: str, top: int = 30) -> DataFrame:
    """The items of most units: rows, units, the units in order, and catalogue codes."""
    per = df.filter(F.col(item).isNotNull()).groupBy(item).agg(
        F.count("*").alias("n_rows"), F.count_distinct(unit).alias("n_units"), F.concat_ws("|", F.sort_array(F.collect_set(unit))).alias("units"), F.count_distinct(code).alias("n_codes")
    )
    return per.filter("n_units > 1").orderBy(F.desc("n_units"), F.desc("n_rows"), item).limit(top)


def shape(df: DataFrame) -> DataFrame:
    """`n_rows, n_columns, names`."""
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(",".join(df.columns)).alias("names"))


def schema_drift(df: DataFrame, expected: DataFrame | list[str]) -> DataFrame:
    """`column, status, filled, distinct_values`: columns that are new, missing or there, with what the rows hold of them."""
    names = expected.columns if isinstance(expected, DataFrame) else list(expected)
    one = df.agg(*(F.struct(F.count(c).alias("filled"), F.approx_count_distinct(c).alias("distinct_values")).alias(c) for c in df.columns))
    there = one.unpivot([], df.columns, "column", "x").select("column", F.when(F.col("column").isin(*names), "expected").otherwise("new").alias("status"), "x.filled", "x.distinct_values")
    lost = [(c,) for c in names if c not in df.columns]
    if not lost:
        return there
    none = F.lit(None).cast("long")
    return there.unionByName(df.sparkSession.createDataFrame(lost, "column string").select("column", F.lit("missing").alias("status"), none.alias("filled"), none.alias("distinct_values")))


def rule_checks(df: DataFrame, price: str, quantity: str, total: str, key: list[str]) -> DataFrame:
    """`rule, n`: rows of prices and quantities that are not positive, of negative totals, and of repeated keys."""
    one = df.agg(F.count_if(F.col(price) <= 0).alias("price"), F.count_if(F.col(quantity) <= 0).alias("quantity"), F.count_if(F.col(total) < 0).alias("total"))
    repeated = df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").agg(F.lit("key").alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return one.unpivot([], ["price", "quantity", "total"], "rule", "n").unionByName(repeated)


def bronze_report(df: DataFrame, expected: list[str], key: list[str], price: str, dates: list[str], item: str, unit: str, supplier: str) -> DataFrame:
    """`check, column, metric, value`: all checks of a raw table in long form, from two passes over the rows.

    Counts are added up by item, along with its units, so all of them cross as a row for each item and task. Rows are
    counted once as wholes, and the kinds of each key among these.
    """
    x = F.col(price).cast("string").try_cast("double")
    bad = {c: F.col(c).cast("string").try_cast("timestamp").isNull() & F.col(c).isNotNull() for c in dates}
    counts = {
        "shape||rows": F.count("*"),
        f"range|{price}|below": F.count_if(x < 0),
        f"range|{price}|zero": F.count_if(x == 0),
        f"reference|{supplier}|missing": F.count_if(F.col(supplier).isNull()),
        **{f"nulls|{c}|n": F.count_if(F.col(c).isNull()) for c in df.columns},
        **{f"dates|{c}|invalid": F.count_if(v) for c, v in bad.items()},
    }
    per = df.groupBy(F.col(item).alias("_i")).agg(*(c.alias(n) for n, c in counts.items()), F.min(unit).alias("_a"), F.max(unit).alias("_b"))
    there = F.col("_i").isNotNull()
    plain = per.agg(*(F.coalesce(F.sum(f"`{n}`"), F.lit(0)).alias(n) for n in counts), F.count_if(there).alias(f"units|{item}|items"), F.count_if(there & F.expr("_a <> _b")).alias(f"units|{item}|mixed"))
    kinds = df.groupBy(*df.columns).agg(F.count("*").alias("_n")).groupBy(*key).agg(F.sum("_n").alias("_rows"), F.count("*").alias("_kinds"))
    beyond = lambda n: F.coalesce(F.sum(F.col("_rows") - n), F.lit(0))
    repeated = kinds.agg(beyond(F.col("_kinds")).alias("duplicates||exact"), beyond(1).alias(f"duplicates|{','.join(key)}|key"))
    long = [one.select(*(F.col(f"`{c}`").cast("long") for c in one.columns)).unpivot([], one.columns, "name", "value") for one in (plain, repeated)]
    out = long[0].unionByName(long[1])
    drift = [("drift", c, "new", 1) for c in sorted(set(df.columns) - set(expected))] + [("drift", c, "missing", 1) for c in sorted(set(expected) - set(df.columns))]
    part = F.split("name", r"\|")
    out = out.select(part[0].alias("check"), part[1].alias("column"), part[2].alias("metric"), "value")
    return out.unionByName(df.sparkSession.createDataFrame(drift, "check string, column string, metric string, value long")) if drift else out


def unit_distribution(df: DataFrame, item: str, unit: str, top: int = 20) -> DataFrame:
    return df.groupBy(item, unit).agg(F.count("*").alias("n")).orderBy(F.desc("n"), item, unit).limit(top)


def code_cardinality(df: DataFrame, code: str, description: str, unit: str) -> DataFrame:
    """For each catalogue code: rows, descriptions, units."""
    return df.filter(F.col(code).isNotNull()).groupBy(code).agg(F.count("*").alias("n_rows"), F.count_distinct(description).alias("n_descriptions"), F.count_distinct(unit).alias("n_units"))


def code_summary(df: DataFrame, code: str, description: str, unit: str) -> DataFrame:
    """One row over catalogue codes: how many, their rows, and the percentage with several descriptions and with several units."""
    per = code_cardinality(df, code, description, unit)
    pct = lambda c: F.round(100 * ratio(F.count_if(F.col(c) > 1), F.count("*")), 2)
    return per.agg(F.count("*").alias("n_codes"), F.sum("n_rows").alias("n_rows"), pct("n_descriptions").alias("several_descriptions_pct"), pct("n_units").alias("several_units_pct"), F.max("n_units").alias("most_units"))


def described(df: DataFrame, value: str, *by: str, extra: tuple | list = ()) -> DataFrame:
    """`n, mean, std, least, p25, p50, p99, most` of a column, of all rows or by group."""
    rows = df.groupBy(*by) if by else df
    figures = rows.agg(*extra, F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_samp(value), 4).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))
    shares = {"p25": 0.25, "p50": 0.5, "p99": 0.99}
    out = beside(figures, quantiles(df, value, shares, by), by).withColumns({c: F.round(c, 4) for c in shares})
    return out.select(*(c for c in figures.columns if c != "most"), *shares, "most")
