"""The star schema: dimensions, the fact table and its outlier flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import flag, modified_zscores
from ..functions.text import item_key
from ..sources.files import read_years, require_columns
from .cleaning import unit_comparability


#: Names of months.
MONTHS = ("Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho", "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro")

#: Columns of the buyer dimension.
BUYER = ("id_compra", "orgao_entidade_cnpj", "orgao_entidade_razao_social", "unidade_orgao_uf_sigla", "unidade_orgao_municipio_nome", "codigo_modalidade", "modalidade_nome")


def dim_buyer(headers: DataFrame, names: Sequence[str] = BUYER) -> DataFrame:
    """The header columns of the buyer dimension; raises if one is missing."""
    return require_columns(headers, names).select(*names)


def buyer_grain(dim: DataFrame, key: str = "id_compra") -> DataFrame:
    """`n_rows, n_keys, is_valid`: whether each key stands once."""
    return dim.agg(F.count("*").alias("n_rows"), (F.count_distinct(key) + F.max(F.when(F.col(key).isNull(), 1).otherwise(0))).alias("n_keys")).withColumn("is_valid", F.col("n_rows") == F.col("n_keys"))


def dim_buyer_of_years(spark, root: str, years: Sequence[int], date: str = "data_publicacao_pncp", names: Sequence[str] = BUYER) -> DataFrame:
    """The buyer dimension of several years of headers: the latest of each key."""
    headers = read_years(spark, root, years)
    dated = headers.withColumn(date, F.col(date).cast("string").try_cast("timestamp"))
    return dim_buyer(latest_per_key(dated, names[0], date), names)


def latest_per_key(df: DataFrame, key: str, date: str) -> DataFrame:
    """The latest row of each key; ties by the other columns in order."""
    tie = [F.col(c).asc_nulls_last() for c in df.columns if c not in (key, date)]
    w = Window.partitionBy(key).orderBy(F.col(date).desc_nulls_last(), *tie)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def most_frequent(df: DataFrame, group: str, value: str, name: str | None = None) -> DataFrame:
    """The most frequent value of each group, nulls aside; of equal counts the smallest value."""
    counts = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(group).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("_b")).select(group, F.col("_b.v").alias(name or value))


def dim_item(rows: DataFrame, item: str = "item_key", code: str = "catalogue_code", category: str = "category", modes: Mapping[str, str] | None = None, unit: str | None = None) -> DataFrame:
    """`item_key, n_rows, category, n_codes, code`: all item keys with their most frequent attributes.

    `modes` names further columns to take the most frequent value of; with `unit`, `unit_flag` says whether units compare.
    """
    out = rows.filter(F.col(item).isNotNull()).groupBy(item).agg(F.count("*").alias("n_rows"), F.count_distinct(code).alias("n_codes"))
    for value, name in {category: category, code: "code", **(modes or {})}.items():
        out = out.join(most_frequent(rows, item, value, name), item, "left")
    return out.join(unit_comparability(rows, item, unit), item, "left") if unit else out


def dim_supplier(rows: DataFrame, supplier: str = "supplier_key", name: str = "supplier_name", item: str = "item_key") -> DataFrame:
    base = rows.filter(F.col(supplier).isNotNull()).groupBy(supplier).agg(F.count("*").alias("n_rows"), F.count_distinct(item).alias("n_items"))
    return base.join(most_frequent(rows, supplier, name), supplier, "left")


def dim_date(spark, start: str, end: str) -> DataFrame:
    """One row a day: key, date, year, quarter, month, day, weekday (Monday is 0) and the month's name."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day_date"))
    d = F.col("day_date")
    return days.select(F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), d, F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.day(d).alias("day"), F.weekday(d).alias("weekday"), F.get(F.array(*map(F.lit, MONTHS)), F.month(d) - 1).alias("month_name"))


def fact_purchase(rows: DataFrame, headers: DataFrame, items: DataFrame) -> DataFrame:
    """Priced rows with header and item attributes; rows without a header stay."""
    priced = rows.filter(F.col("unit_price").isNotNull())
    out = priced.join(headers, "purchase_id", "left").join(items.select("item_key", F.col("category").alias("item_category")), "item_key", "left")
    return out.withColumn("date_key", F.date_format("result_date", "yyyyMMdd").cast("int"))


def join_audit(rows: DataFrame, headers: DataFrame, key: str) -> DataFrame:
    """`rows_before, rows_after, unmatched` of a left join to the header table."""
    per = headers.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    joined = rows.join(per, rows[key] == per["_k"], "left")
    return joined.agg(F.count("*").alias("rows_before"), F.sum(F.coalesce("_n", F.lit(1))).alias("rows_after"), F.count_if(F.col("_n").isNull()).alias("unmatched"))


def grain_violations(fact: DataFrame, key: Sequence[str], conflict: str) -> DataFrame:
    """`violating_rows, unflagged_groups`: rows of repeated keys, and repeated keys without any flagged row."""
    per = fact.groupBy(*key).agg(F.count("*").alias("n"), F.max(flag(conflict)).alias("c")).filter("n > 1")
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violating_rows"), F.count_if(~F.col("c")).alias("unflagged_groups"))


def flag_value_outliers(df: DataFrame, item: str, values: Sequence[str] = ("unit_price", "quantity"), z: float = 3.5, least: int = 5, total: str | None = "total_price") -> DataFrame:
    """Add `group_rows`, `z_<value>`, `is_outlier` and `reason`, from modified z-scores of the logarithms of positive values.

    The total is looked at too where it is there, since price and quantity may both be high but not too high.
    """
    every = (*values, total) if total and total in df.columns and total not in values else tuple(values)
    logs = df.withColumns({f"_log_{v}": F.when(F.col(v) > 0, F.ln(v)) for v in every})
    out = modified_zscores(logs, item, {f"z_{v}": f"_log_{v}" for v in every}, least).drop(*(f"_log_{v}" for v in every))
    fired = [F.when(F.abs(F.col(f"z_{v}")) > z, F.lit(v)) for v in every]
    return out.withColumn("reason", F.nullif(F.concat_ws(",", *fired), F.lit(""))).withColumn("is_outlier", F.col("reason").isNotNull())


def fact_of_silver(silver: DataFrame, buyers: DataFrame, items: DataFrame) -> DataFrame:
    """Fact rows of cleaned item rows: those with a result, with buyer and item attributes and outlier flags; buyers may be missing."""
    return flag_value_outliers(fact_rows(silver, buyers, items), "item_key")


def fact_rows(silver: DataFrame, buyers: DataFrame, items: DataFrame) -> DataFrame:
    """`fact_of_silver` without the outlier flags, whose medians take jobs of their own, for figures that need none of them."""
    rows = silver.filter("valor_unitario_resultado is not null").withColumn("item_key", item_key(F.col("descricao_resumida")))
    joined = rows.join(buyers.drop("orgao_entidade_cnpj"), "id_compra", "left").join(items.select("item_key", "unit_flag"), "item_key", "left")
    return joined.select(
        F.col("id_compra_item").alias("purchase_item_id"),
        F.col("id_compra").alias("purchase_id"),
        F.date_format("data_resultado", "yyyyMMdd").cast("int").alias("date_key"),
        F.col("orgao_entidade_cnpj").alias("buyer_key"),
        F.col("cod_fornecedor").alias("supplier_key"),
        "item_key",
        "unit_flag",
        F.col("category"),
        "unidade_orgao_uf_sigla",
        "modalidade_nome",
        F.col("quantidade_resultado").alias("quantity"),
        F.col("valor_unitario_resultado").alias("unit_price"),
        F.lit(None).cast("double").alias("real_unit_price"),
        F.col("valor_total_resultado").alias("total_price"),
        "resultado_conflitante",
    )
