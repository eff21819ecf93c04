"""Spend by category and supplier, concentration, ABC curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import concentration, flag, ratio
from ..functions.tables import quantile, running


UNCLASSIFIED = "Não categorizado"


def flag_extreme(df: DataFrame, value: str, multiple: float = 1000.0, outlier: str | None = None) -> DataFrame:
    """Add `is_extreme`: above `multiple` times the median of the rows not flagged as outliers."""
    clean = df.filter(~flag(outlier)) if outlier else df
    cut = quantile(clean, value, 0.5, "_cut")
    return df.crossJoin(F.broadcast(cut)).withColumn("is_extreme", F.coalesce(F.col(value) > multiple * F.col("_cut"), F.lit(False))).drop("_cut")  # one row


def without_flagged(df: DataFrame, value: str = "total_price", outlier: str = "is_value_outlier", multiple: float = 1000.0) -> DataFrame:
    """Rows that are neither flagged as outliers nor extreme by the median of the rows not flagged."""
    known = outlier if outlier in df.columns else None
    out = flag_extreme(df, value, multiple, known).filter("not is_extreme").drop("is_extreme")
    return out.filter(~flag(outlier)) if known else out


def by_category(df: DataFrame, category: str = "category", value: str = "total_price") -> DataFrame:
    """`category, spend, n_rows, n_suppliers, n_items, pct`; null is a category of its own."""
    per = df.groupBy(F.coalesce(category, F.lit(UNCLASSIFIED)).alias("category")).agg(
        F.sum(value).alias("spend"), F.count("*").alias("n_rows"), F.count_distinct("supplier_key").alias("n_suppliers"), F.count_distinct("item_key").alias("n_items")
    )
    return per.withColumn("pct", F.round(100 * ratio(F.col("spend"), F.sum("spend").over(Window.partitionBy())), 4))


def shares(df: DataFrame, category: str = "category", supplier: str = "supplier_key", value: str = "total_price") -> DataFrame:
    """Spend of each supplier in each category and its share of the category, in percent; null is a category of its own."""
    named = df.filter(F.col(supplier).isNotNull()).withColumn(category, F.coalesce(category, F.lit(UNCLASSIFIED)))
    per = named.groupBy(category, supplier).agg(F.sum(value).alias("spend"))
    total = per.groupBy(F.col(category).alias("_c")).agg(F.sum("spend").alias("_t"))
    return per.join(total, F.col(category) == F.col("_c")).withColumn("share", 100 * ratio(F.col("spend"), F.col("_t"))).drop("_c", "_t")


def hhi(df: DataFrame, category: str = "category", supplier: str = "supplier_key", value: str = "total_price") -> DataFrame:
    """`category, n_suppliers, hhi, top1, top3, level` of each category."""
    h = F.col("share") * F.col("share")
    summed = shares(df, category, supplier, value).withColumn("_part", F.pmod(F.xxhash64(supplier), F.lit(64)))
    top = lambda c: F.slice(F.sort_array(c, asc=False), 1, 3)
    parts = summed.groupBy(category, "_part").agg(F.count("*").alias("n"), F.sum(h).alias("h"), top(F.collect_list("share")).alias("t"))
    per = parts.groupBy(category).agg(F.sum("n").alias("n_suppliers"), F.round(F.sum("h"), 4).alias("hhi"), top(F.flatten(F.collect_list("t"))).alias("_t"))  # 3 of each of 64 parts
    three = F.aggregate("_t", F.lit(0.0), lambda a, x: a + x)
    return per.select(category, "n_suppliers", "hhi", F.round(F.get("_t", 0), 4).alias("top1"), F.round(three, 4).alias("top3"), concentration(F.col("hhi")).alias("level"))


def abc_curve(df: DataFrame, category: str = "category", supplier: str = "supplier_key", value: str = "total_price", total: str = "__GLOBAL__") -> DataFrame:
    """`category, supplier, spend, rank, cumulative, abc` for each category and for all together.

    Ranks and cumulative shares are running sums over suppliers, after aggregation, dealt over tasks by ranges.
    """
    rows = df.filter(F.col(supplier).isNotNull()).select(F.explode(F.array(F.coalesce(category, F.lit(UNCLASSIFIED)), F.lit(total))).alias(category), supplier, value)
    per = rows.groupBy(category, supplier).agg(F.sum(value).alias("spend"))
    run = running(per, {"_before": F.col("spend"), "_rank": F.lit(1)}, [F.desc("spend"), F.col(supplier)], [category], totals={"_t": "_before"})
    cumulative = F.round(100 * ratio(F.col("_before") + F.col("spend"), F.col("_t")), 6)
    out = run.select(category, supplier, "spend", (F.col("_rank") + 1).cast("int").alias("rank"), cumulative.alias("cumulative"))
    return out.withColumn("abc", F.when(F.col("cumulative") <= 80, "A").when(F.col("cumulative") <= 95, "B").otherwise("C"))


def abc_extract(df: DataFrame, category: str = "category", supplier: str = "supplier_key", name: str = "supplier_name") -> DataFrame:
    """`abc_curve` with each supplier's `name`, the first in order, or its key where it has none."""
    names = df.filter(F.col(supplier).isNotNull()).groupBy(supplier).agg(F.min(name).alias("name"))
    return abc_curve(df, category, supplier).join(names, supplier, "left").withColumn("name", F.coalesce("name", F.col(supplier).cast("string")))


def spend_extract(df: DataFrame) -> DataFrame:
    """Spend and concentration of the categories that have a name, with shares among these."""
    known = df.filter("category is not null")
    return by_category(known).join(hhi(known).drop("n_suppliers"), "category", "left")


def category_profile(df: DataFrame, category: str, top: int = 30) -> tuple[DataFrame, DataFrame]:
    """One row on a category (its rank by spend, figures, concentration, suppliers of class A, largest supplier's share) and its first `top` suppliers."""
    curve = abc_extract(df.filter(F.col("category") == category)).filter(F.col("category") == category)
    per = by_category(df)
    own = per.filter(F.col("category") == category)
    rank = per.alias("p").join(own.select(F.col("spend").alias("_own")), F.col("spend") > F.col("_own")).agg((F.count("*") + 1).cast("int").alias("rank"))
    classes = curve.agg(F.count_if(F.col("abc") == "A").alias("n_class_a"))
    of_one = hhi(df.filter(F.col("category") == category)).select("hhi", "top1", "top3", "level")
    return own.crossJoin(rank).crossJoin(of_one).crossJoin(classes), curve.orderBy("rank").limit(top)  # one row each


def concentration_of_top(df: DataFrame, id_column: str, top: int = 20, value: str = "total_price", supplier: str = "supplier_key") -> DataFrame:
    """One row: spend of the `top` largest rows, its share of all, the supplier with most of it and that supplier's share of it."""
    first = df.orderBy(F.desc(value), id_column).limit(top).select(supplier, F.col(value).alias("_v"))
    per = first.groupBy(supplier).agg(F.sum("_v").alias("_s"))  # `top` rows at most
    lead = per.agg(F.sum("_s").alias("top_spend"), F.max_by(supplier, F.struct("_s", supplier)).alias("supplier"), F.max("_s").alias("_m"))
    out = lead.crossJoin(df.agg(F.sum(value).alias("spend")))  # one row each
    pct = lambda a, b: F.round(100 * ratio(F.col(a), F.col(b)), 4)
    return out.select(F.col("spend").cast("double").alias("spend"), F.col("top_spend").cast("double").alias("top_spend"), pct("top_spend", "spend").alias("top_share"), "supplier", pct("_m", "top_spend").alias("supplier_share"))
