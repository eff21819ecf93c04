"""The driver's tables as purchase records, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables beside the lines that a column comes from, each with its condition; the later ones need those before them.
_JOINS = {
    "part": "l_partkey = p_partkey",
    "supplier": "l_suppkey = s_suppkey",
    "orders": "l_orderkey = o_orderkey",
    "customer": "o_custkey = c_custkey",
    "nation": "c_nationkey = n_nationkey",
}
_FROM = {"supplier_name": ["supplier"], "description": ["part"], "unit_item": ["part"], "unit": ["part"], "category": ["part"], "segment": ["part", "supplier"], "uf": ["orders", "customer", "nation"], "modality": ["orders"], "buyer_key": ["orders"]}


def items(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Item rows: a row for each line, with its header's and item's attributes; all columns or the named ones.

    Keys of these tables are whole, so a table that no named column comes from is not joined. The keys of the lines
    may be named too, for `attached`.
    """
    needed = set(_JOINS) if not names else {t for n in names for t in _FROM.get(n, ())}
    rows = table(spark, sf_dir, "lineitem")
    for name, on in _JOINS.items():
        if name in needed:
            rows = rows.join(table(spark, sf_dir, name), F.expr(on))
    every = _columns()
    return rows.select(*(every[n].alias(n) if n in every else F.col(n) for n in names or every))


#: Keys of the lines by which `attached` finds the other tables.
KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def attached(spark: SparkSession, sf_dir: str, rows: DataFrame, *names: str) -> DataFrame:
    """Item rows with `KEYS` and these columns too, of other tables or made of the keys, for few rows whose attributes were left out before."""
    needed = {t for n in names for t in _FROM.get(n, ())}
    out = rows
    for name, on in _JOINS.items():
        if name in needed:
            out = out.join(table(spark, sf_dir, name), F.expr(on))
    every = _columns()
    return out.select(*rows.columns, *(every[n].alias(n) for n in names))


def parts_of_items(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """These columns of every part that an item row has, once for each part."""
    seen = table(spark, sf_dir, "lineitem").select("l_partkey").distinct()  # a key crosses once for each task, and lines are not sorted
    used = table(spark, sf_dir, "part").join(seen, F.expr(_JOINS["part"]), "left_semi")
    every = _columns()
    return used.select(*(every[n].alias(n) for n in names))


NAMES = ("purchase_item_id", "supplier_key", "supplier_name", "purchase_id", "result_date", "quantity", "total_price", "unit_price", "item_key", "description", "unit_item", "unit", "catalogue_code", "category", "segment", "uf", "modality", "buyer_key")


def _columns() -> dict[str, Column]:
    columns = [
        F.concat_ws("-", "l_orderkey", "l_linenumber"),
        F.lpad(F.col("l_suppkey").cast("string"), 14, "0"),
        F.col("s_name"),
        F.col("l_orderkey").cast("string"),
        F.to_date("l_shipdate"),
        F.col("l_quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)"),
        F.when((F.col("l_returnflag") != "N") | (F.col("l_linenumber") != 7), F.col("l_extendedprice") / F.col("l_quantity")),
        F.col("l_partkey").cast("string"),
        F.col("p_name"),
        F.concat_ws(" ", "p_name", "p_brand"),
        F.when(F.col("p_size") <= 10, "UNIDADE").when(F.col("p_size") <= 30, F.concat(F.lit("EMBALAGEM "), "p_size", F.lit(",00 G"))).otherwise("QUILOGRAMA"),
        F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey")),
        F.nullif("p_type", F.lit("PROMO")),
        F.concat_ws("/", "p_brand", "s_nationkey"),
        F.col("n_name"),
        F.col("o_orderpriority"),
        F.col("o_custkey"),
    ]
    return dict(zip(NAMES, columns, strict=True))


ITEMS = """items AS (
  SELECT l_orderkey || '-' || l_linenumber AS purchase_item_id, lpad(l_suppkey::VARCHAR, 14, '0') AS supplier_key, s_name AS supplier_name,
         o_orderkey::VARCHAR AS purchase_id, l_shipdate::DATE AS result_date, l_quantity AS quantity, l_extendedprice::DECIMAL(18,2) AS total_price,
         CASE WHEN l_returnflag <> 'N' OR l_linenumber <> 7 THEN l_extendedprice / l_quantity END AS unit_price, l_partkey::VARCHAR AS item_key,
         p_name AS description, p_name || ' ' || p_brand AS unit_item,
         CASE WHEN p_size <= 10 THEN 'UNIDADE' WHEN p_size <= 30 THEN 'EMBALAGEM ' || p_size || ',00 G' ELSE 'QUILOGRAMA' END AS unit,
         CASE WHEN l_partkey % 3 <> 0 THEN l_partkey END AS catalogue_code, nullif(p_type, 'PROMO') AS category,
         p_brand || '/' || s_nationkey AS segment, n_name AS uf, o_orderpriority AS modality, c_custkey AS buyer_key
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
