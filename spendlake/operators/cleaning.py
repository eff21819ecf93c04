"""Cleaning of item rows: duplicates, superseded revisions, conflicts, categories, unit comparability.

Ties are broken by the columns named in each function, never by file order. Null keys are left alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.stats import flag, ratio
from ..functions.tables import stored


def remove_exact_duplicates(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """One row for each combination of the other columns (nulls are equal): the smallest in the ignored ones."""
    same = [c for c in df.columns if c not in ignore]
    if not ignore:
        return df.dropDuplicates()
    first, named = _smallest(df, ignore)
    return df.groupBy(*same).agg(*first).select(*(named.get(c, F.col(c)) for c in df.columns))


def _smallest(df: DataFrame, names: Sequence[str]) -> tuple[list[Column], dict[str, Column]]:
    """Aggregates of the smallest combination of these columns, null before all values, and the columns made of them.

    One column has plain aggregates, which need no sort where numbers are hashed.
    """
    own = [c for c in df.columns if c in names]
    if len(own) == 1:
        return [F.min(own[0]).alias("_b"), F.max(F.col(own[0]).isNull()).alias("_gap")], {own[0]: F.when(~F.col("_gap"), F.col("_b")).alias(own[0])}
    return [F.min(F.struct(*own)).alias("_b")] if own else [], {c: F.col(f"_b.{c}").alias(c) for c in own}


def resolve_revisions(df: DataFrame, key: Sequence[str], date: str, several: str | None = None) -> DataFrame:
    """Of keys with several dates, the latest row; all rows of other keys and of null keys.

    `several` names a flag that is true on rows whose key had more dates before; it comes out true on the rows of all such keys.
    """
    known = F.lit(True)
    for k in key:
        known = known & F.col(k).isNotNull()
    before = F.max(flag(several)) if several else F.lit(False)
    dates = df.filter(known).groupBy(*key).agg(F.min(date).alias("_a"), F.max(date).alias("_b"), before.alias("_s")).filter("_a < _b or _s").select(*key, F.lit(True).alias("_many"))
    joined = df.join(dates, list(key), "left")  # null keys meet nothing and stay
    tie = [F.col(c).asc_nulls_last() for c in df.columns if c not in (*key, date, several)]
    w = Window.partitionBy(*key).orderBy(F.col(date).desc_nulls_last(), *tie)  # the rows of one key that has several dates
    last = joined.filter("_many").withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    last = last.withColumn(several, F.lit(True)) if several else last
    return last.select(df.columns).unionByName(joined.filter("_many is null").select(df.columns))


def flag_conflicts(df: DataFrame, key: str, date: str, value: str, name: str = "conflict") -> DataFrame:
    """True for keys with exactly one date and more than one value."""
    per = conflicts(df, key, date, value, "_c").withColumnRenamed(key, "_k")
    return df.join(per, df[key] == per["_k"], "left").withColumn(name, flag("_c")).drop("_k", "_c")


def conflicts(df: DataFrame, key: str, date: str, value: str, name: str = "conflict") -> DataFrame:
    """`key, name`: whether the key has exactly one date and more than one value."""
    per = df.filter(F.col(key).isNotNull()).groupBy(key).agg(((F.min(date) == F.max(date)) & (F.min(value) < F.max(value))).alias(name))
    return per.withColumn(name, flag(name))


def classify(df: DataFrame, column: str, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add `category` and `is_relevant`: the first category with a word in the text."""
    plain = df.withColumn("_plain", text.strip_accents(F.col(column)))  # once for all categories
    return plain.withColumn("category", text.first_category(F.col(column), categories, F.col("_plain"))).withColumn("is_relevant", F.col("category").isNotNull()).drop("_plain")


def spend_total(df: DataFrame, value: str, conflict: str) -> DataFrame:
    """`gross, net, excluded, n_excluded, pct`: totals with and without conflicting rows, and the share left out in percent."""
    out = df.agg(F.sum(value).alias("gross"), F.sum(F.when(~flag(conflict), F.col(value))).alias("net"), F.count_if(flag(conflict)).alias("n_excluded"))
    out = out.withColumn("excluded", F.col("gross") - F.coalesce("net", F.lit(0)))
    return out.withColumn("pct", F.round(100 * ratio(F.col("excluded"), F.col("gross")), 4))


def unit_comparability(df: DataFrame, item: str, unit: str) -> DataFrame:
    """`item, unit_flag`: unit_comparable (one unit at most), unit_requires_conversion (all of one dimension) or unit_unknown."""
    dim, _ = text.parse_unit(F.col(unit))
    rows = df.filter(F.col(item).isNotNull()).select(item, text.normalize_unit(F.col(unit)).alias("u"), dim.alias("d"))
    per = rows.groupBy(item).agg(F.min("u").alias("a"), F.max("u").alias("b"), F.min("d").alias("da"), F.max("d").alias("db"), F.max(F.col("d").isNull()).alias("gap"))
    same = F.coalesce(F.col("a") == F.col("b"), F.lit(True))
    return per.select(item, F.when(same, "unit_comparable").when((F.col("da") == F.col("db")) & ~F.col("gap"), "unit_requires_conversion").otherwise("unit_unknown").alias("unit_flag"))


def flag_shares(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """`label, n, pct` of fixed labels, zeros included."""
    counts = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(column) == x).alias(x) for x in labels))
    return counts.unpivot("_n", list(labels), "label", "n").select("label", "n", F.round(F.try_divide(100.0 * F.col("n"), F.col("_n")), 4).alias("pct"))


def partners_per_item(df: DataFrame, item: str, partner: str) -> DataFrame:
    """`n_partners, n_items`: how many items have so many partners."""
    per = df.filter(F.col(item).isNotNull()).groupBy(item).agg(F.count_distinct(partner).alias("n_partners"))
    return per.groupBy("n_partners").agg(F.count("*").alias("n_items"))


def key_violations(df: DataFrame, key: Sequence[str], date: str, value: str) -> DataFrame:
    """`kind, n_groups, n_rows` of keys that stand more than once: same or different date, same or different value."""
    per = df.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct(date).alias("d"), F.count_distinct(value).alias("v")).filter("n > 1")
    kind = F.concat(F.when(F.col("d") > 1, "different").otherwise("same"), F.lit("_date_"), F.when(F.col("v") > 1, "different").otherwise("same"), F.lit("_value"))
    return per.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"))


def violation_sample(df: DataFrame, key: Sequence[str], top: int = 20) -> DataFrame:
    """The first keys, in order, that stand more than once, with their number of rows."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").orderBy(*key).limit(top)


#: Columns of the raw item table that tell a row but not its contents, and those to be typed.
VOLATILE = (
    "COD_RESULTADO_ITEM", "srk_pncp_item_compra", "data_atualizacao_pncp", "data_inclusao_pncp", "valor_unitario_estimado", "valor_total", "nome_fornecedor", "quantidade",
)
MONEY = ("valor_unitario_estimado", "valor_total", "valor_total_resultado", "valor_unitario_resultado")
QUANTITIES = ("quantidade", "quantidade_resultado")
DATES = ("data_inclusao_pncp", "data_atualizacao_pncp", "data_resultado")
KEY = ("id_compra_item", "cod_fornecedor")


def apply_typing(df: DataFrame, numbers: Sequence[str] = (*MONEY, *QUANTITIES), dates: Sequence[str] = DATES) -> DataFrame:
    """Numbers and dates typed where the columns are there; what cannot be read becomes null."""
    typed = {c: F.col(c).cast("string").try_cast("double") for c in numbers if c in df.columns}
    return df.withColumns(typed | {c: F.col(c).cast("string").try_cast("timestamp") for c in dates if c in df.columns})


def category_summary(df: DataFrame) -> DataFrame:
    """`category, n, pct`: rows by category, null for those of none, and their share of all in percent."""
    per = df.groupBy("category").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # a row for each category; the rows are read once
    return per.select("category", "n", F.round(100 * ratio(F.col("n"), total), 4).alias("pct"))


def key_summary(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """`n_rows, n_violating, pct, is_unique`: rows whose key stands more than once."""
    per = df.groupBy(*key).agg(F.count("*").alias("n"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_violating"))
    return out.withColumn("pct", F.round(F.coalesce(100 * ratio(F.col("n_violating"), F.col("n_rows")), F.lit(0.0)), 4)).withColumn("is_unique", F.col("n_violating") == 0)


def violating_purchases(df: DataFrame, key: Sequence[str], purchase: str, top: int = 5) -> DataFrame:
    """`purchase, n_rows`: the purchases with the most rows of repeated keys."""
    per = df.groupBy(*key, purchase).agg(F.count("*").alias("_n"))
    many = per.groupBy(*key).agg(F.sum("_n").alias("_all")).filter("_all > 1")
    return per.join(many, list(key)).groupBy(purchase).agg(F.sum("_n").alias("n_rows")).orderBy(F.desc("n_rows"), purchase).limit(top)


def silver(bronze: DataFrame) -> DataFrame:
    """The raw item table typed, without exact duplicates and superseded revisions, with its category and conflict flag; not stored."""
    return _cleaned(bronze)


def silver_with_report(bronze: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`metric, value` of the way from raw to cleaned rows, and the cleaned rows, stored.

    The figures are observed while the rows are written, in the tasks that write them, so a lost executor's tasks count once.
    """
    seen, last = Observation(), Observation()
    spend = F.col("valor_total_resultado").cast("double")
    rows = stored(
        _cleaned(bronze, seen).observe(
            last,
            F.count(F.lit(1)).alias("rows_clean"),
            F.count_if("resultado_conflitante").alias("rows_conflicting"),
            F.count_if("is_relevant").alias("rows_relevant"),
            F.coalesce(F.sum(spend), F.lit(0.0)).alias("spend_gross"),
            F.coalesce(F.sum(F.when(~F.col("resultado_conflitante"), spend)), F.lit(0.0)).alias("spend_net"),
        )
    )
    found = seen.get | last.get
    figures = {k: found[k] for k in ("rows_raw", "rows_without_duplicates", "rows_clean", "rows_conflicting", "rows_relevant", "spend_gross", "spend_net")}
    return bronze.sparkSession.createDataFrame([(k, float(v)) for k, v in figures.items()], "metric string, value double"), rows


def _cleaned(bronze: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Cleaned rows; `seen` observes `rows_raw` and `rows_without_duplicates`.

    Rows cross once, by their key, and copies, dates, conflicts and the latest row of a key are settled where they
    meet; rows without a whole key are dealt by their contents.
    """
    typed = apply_typing(bronze)
    volatile = [c for c in VOLATILE if c in typed.columns]
    same = [c for c in typed.columns if c not in volatile]
    date, value = "data_resultado", "valor_total_resultado"
    known = F.col(KEY[0]).isNotNull() & F.col(KEY[1]).isNotNull()
    dealt = typed.withColumn("_salt", F.when(known, F.lit(0).cast("long")).otherwise(F.xxhash64(*same))).repartition(*KEY, "_salt")
    first, named = _smallest(typed, volatile)
    once = dealt.groupBy(*same, "_salt").agg(*first, F.count("*").alias("_n")).select(*(named.get(c, F.col(c)) for c in typed.columns), "_salt", "_n")
    if seen:
        once = once.observe(seen, F.count(F.lit(1)).alias("rows_without_duplicates"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_raw"))
    tie = [F.col(c).asc_nulls_last() for c in typed.columns if c not in (*KEY, date)]
    newest = Window.partitionBy(*KEY, "_salt").orderBy(F.col(date).desc_nulls_last(), *tie)  # the rows of one key, without copies
    whole = newest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {"_a": F.min(date).over(whole), "_b": F.max(date).over(whole), "_r": F.row_number().over(newest)}
    ends |= {"_c": F.min(value).over(whole), "_d": F.max(value).over(whole)} if value in typed.columns else {"_c": F.lit(0), "_d": F.lit(0)}
    latest = once.withColumns(ends).filter(~flag(known & F.expr("_a < _b")) | F.expr("_r = 1"))
    conflict = flag(known & F.expr("_a = _b and _c < _d")).alias("resultado_conflitante")
    return classify(latest, "descricao_resumida", text.RELEVANT).select(*typed.columns, "category", "is_relevant", conflict)


def flag_conflicts_of(df: DataFrame, key: Sequence[str], date: str, value: str, name: str) -> DataFrame:
    """True for keys of several columns with exactly one date and more than one value; false where columns are missing."""
    if any(c not in df.columns for c in (*key, date, value)):
        return df.withColumn(name, F.lit(False))
    per = df.groupBy(*key).agg(((F.min(date) == F.max(date)) & (F.min(value) < F.max(value))).alias(name))
    return df.join(per, list(key), "left").withColumn(name, flag(name))


def date_key(day):
    """Column: a date as a whole number yyyyMMdd."""
    return F.date_format(day, "yyyyMMdd").cast("int")


def day_of_key(key):
    """Column: the date of a whole number yyyyMMdd; null where it is none."""
    return F.try_to_date(F.lpad(key.cast("string"), 8, "0"), "yyyyMMdd")
