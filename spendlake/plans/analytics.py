"""Registered queries: library operators over the purchase adapter, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.stats import modified_zscore
from ..functions.tables import quantile, stored
from ..operators import cleaning, comparison, joins, models, pricing, quality, resampling, spend, star
from .adapter import ITEMS, items, table

QUERIES, SQL = {}, {}

#: Words that sort the driver's item names into ordered categories.
CATEGORIES = {"fixacao": ("bolt", "screw", "nail"), "pecas": ("gear", "ring", "valve"), "aparelhos": ("widget", "gadget")}


def query(name: str, sql: str | None = None, over_items: bool = True, recursive: bool = False):
    def add(f):
        QUERIES[name] = f
        if sql:
            body = sql.strip()
            SQL[name] = (f"WITH {'RECURSIVE ' if recursive else ''}{ITEMS}" + (f", {body[5:]}" if body.upper().startswith("WITH ") else f"\n{body}")) if over_items else body
        return f

    return add


def money(df, *names):
    """Exact decimal sums as doubles, as the SQL returns them."""
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def day(name):
    return F.col(name).cast("string").alias(name)


# ---- spend ----

@query("hhi_by_category", """
WITH s AS (SELECT coalesce(category, 'Não categorizado') AS category, supplier_key, sum(total_price) AS spend FROM items GROUP BY 1, 2),
h AS (SELECT *, 100 * spend::DOUBLE / (sum(spend) OVER (PARTITION BY category))::DOUBLE AS share, row_number() OVER (PARTITION BY category ORDER BY spend DESC, supplier_key) AS r FROM s)
SELECT category, count(*) AS n_suppliers, round(sum(share * share), 4) AS hhi, round(max(share), 4) AS top1, round(sum(share) FILTER (r <= 3), 4) AS top3,
       CASE WHEN round(sum(share * share), 4) < 1500 THEN 'nao concentrado' WHEN round(sum(share * share), 4) < 2500 THEN 'moderadamente concentrado' ELSE 'altamente concentrado' END AS level
FROM h GROUP BY 1""")
def _(spark, d):
    return spend.hhi(items(spark, d, "category", "supplier_key", "total_price"))


@query("hhi_by_segment", """
WITH s AS (SELECT segment, supplier_key, sum(total_price) AS spend FROM items GROUP BY 1, 2),
h AS (SELECT *, 100 * spend::DOUBLE / (sum(spend) OVER (PARTITION BY segment))::DOUBLE AS share, row_number() OVER (PARTITION BY segment ORDER BY spend DESC, supplier_key) AS r FROM s)
SELECT segment, count(*) AS n_suppliers, round(sum(share * share), 4) AS hhi, round(max(share), 4) AS top1, round(sum(share) FILTER (r <= 3), 4) AS top3,
       CASE WHEN round(sum(share * share), 4) < 1500 THEN 'nao concentrado' WHEN round(sum(share * share), 4) < 2500 THEN 'moderadamente concentrado' ELSE 'altamente concentrado' END AS level
FROM h GROUP BY 1""")
def _(spark, d):
    return spend.hhi(items(spark, d, "segment", "supplier_key", "total_price"), "segment")


@query("spend_by_category", """
SELECT coalesce(category, 'Não categorizado') AS category, sum(total_price)::DOUBLE AS spend, count(*) AS n_rows, count(DISTINCT supplier_key) AS n_suppliers, count(DISTINCT item_key) AS n_items,
       round(100 * sum(total_price)::DOUBLE / (sum(sum(total_price)) OVER ())::DOUBLE, 4) AS pct FROM items GROUP BY 1""")
def _(spark, d):
    return money(spend.by_category(items(spark, d, "category", "supplier_key", "item_key", "total_price")), "spend")


@query("abc_curve", """
WITH r AS (SELECT coalesce(category, 'Não categorizado') AS category, supplier_key, total_price FROM items UNION ALL SELECT '__GLOBAL__', supplier_key, total_price FROM items),
s AS (SELECT category, supplier_key, sum(total_price) AS spend FROM r GROUP BY 1, 2),
c AS (SELECT category, supplier_key, spend::DOUBLE AS spend, row_number() OVER w AS rank,
             round(100 * (sum(spend) OVER (w ROWS UNBOUNDED PRECEDING))::DOUBLE / (sum(spend) OVER (PARTITION BY category))::DOUBLE, 6) AS cumulative
      FROM s WINDOW w AS (PARTITION BY category ORDER BY spend DESC, supplier_key))
SELECT *, CASE WHEN cumulative <= 80 THEN 'A' WHEN cumulative <= 95 THEN 'B' ELSE 'C' END AS abc FROM c""")
def _(spark, d):
    return money(spend.abc_curve(items(spark, d, "category", "supplier_key", "total_price")), "spend")


@query("extreme_by_global_median", """
SELECT purchase_item_id, supplier_key, total_price::DOUBLE AS total_price FROM items WHERE total_price::DOUBLE > 1.5 * (SELECT median(total_price::DOUBLE) FROM items)""")
def _(spark, d):
    rows = items(spark, d).withColumn("total_price", F.col("total_price").cast("double"))
    return spend.flag_extreme(rows, "total_price", 1.5).filter("is_extreme").select("purchase_item_id", "supplier_key", "total_price")


@query("spend_by_year", "SELECT year(result_date)::INT AS year, count(*) AS n, sum(total_price)::DOUBLE AS spend FROM items GROUP BY 1")
def _(spark, d):
    return items(spark, d, "result_date", "total_price").groupBy(F.year("result_date").alias("year")).agg(F.count("*").alias("n"), F.sum("total_price").cast("double").alias("spend"))


# ---- quality ----

@query("null_profile", """
WITH n AS (SELECT count(*) AS t, count(*) FILTER (unit_price IS NULL) AS unit_price, count(*) FILTER (catalogue_code IS NULL) AS catalogue_code, count(*) FILTER (category IS NULL) AS category FROM items)
SELECT 'unit_price' AS "column", unit_price AS nulls, round(100.0 * unit_price / t, 2)::DOUBLE AS pct, 'double' AS kind FROM n UNION ALL
SELECT 'catalogue_code', catalogue_code, round(100.0 * catalogue_code / t, 2)::DOUBLE, 'bigint' FROM n UNION ALL SELECT 'category', category, round(100.0 * category / t, 2)::DOUBLE, 'string' FROM n""")
def _(spark, d):
    out = quality.null_profile(items(spark, d, "unit_price", "catalogue_code", "category"))
    return out.withColumn("pct", F.col("pct").cast("double"))  # kinds: double, bigint, string


@query("key_duplicates", """
WITH g AS (SELECT count(*) AS n FROM items GROUP BY purchase_item_id, supplier_key)
SELECT sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicates, round(100.0 * sum(n - 1) / sum(n), 4)::DOUBLE AS pct FROM g""")
def _(spark, d):
    out = quality.key_duplicates(items(spark, d, "purchase_item_id", "supplier_key"), "purchase_item_id", "supplier_key")
    return out.withColumn("pct", F.col("pct").cast("double"))


@query("value_range", "SELECT count(*) FILTER (unit_price < 1000) AS below, count(*) FILTER (unit_price = 0) AS zero, count(*) FILTER (unit_price IS NULL) AS missing, round(100 * count(*) FILTER (unit_price < 1000) / count(*)::DOUBLE, 2) AS below_pct, round(100 * count(*) FILTER (unit_price = 0) / count(*)::DOUBLE, 2) AS zero_pct FROM items")
def _(spark, d):
    return quality.value_range(items(spark, d, "unit_price"), "unit_price", 1000.0)


@query("unit_heterogeneity", """
WITH p AS (SELECT unit_item, count(DISTINCT unit) AS u FROM items GROUP BY 1) SELECT count(*) AS items, count(*) FILTER (u > 1) AS mixed FROM p""")
def _(spark, d):
    return quality.unit_heterogeneity(items(spark, d), "unit_item", "unit")


@query("multi_unit_items", """
SELECT unit_item, count(*) AS n_rows, count(DISTINCT unit) AS n_units, string_agg(DISTINCT unit, '|' ORDER BY unit) AS units, count(DISTINCT catalogue_code) AS n_codes
FROM items GROUP BY 1 HAVING count(DISTINCT unit) > 1 ORDER BY n_units DESC, n_rows DESC, unit_item LIMIT 30""")
def _(spark, d):
    return quality.multi_unit_items(items(spark, d), "unit_item", "unit", "catalogue_code")


@query("unit_distribution", "SELECT unit_item, unit, count(*) AS n FROM items GROUP BY 1, 2 ORDER BY n DESC, unit_item, unit LIMIT 20")
def _(spark, d):
    return quality.unit_distribution(items(spark, d), "unit_item", "unit")


@query("code_cardinality", "SELECT catalogue_code, count(*) AS n_rows, count(DISTINCT description) AS n_descriptions, count(DISTINCT unit) AS n_units FROM items WHERE catalogue_code IS NOT NULL GROUP BY 1")
def _(spark, d):
    return quality.code_cardinality(items(spark, d), "catalogue_code", "description", "unit")


_DRIFT = ("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority")


@query("schema_drift", " UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", '{'expected' if c in ('o_orderkey', 'o_custkey', 'o_orderdate', 'o_totalprice') else 'new'}' AS status, count({c}) AS filled FROM orders" for c in _DRIFT]
    + ["SELECT 'o_clerk', 'missing', NULL"]), over_items=False)
def _(spark, d):
    return quality.schema_drift(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_clerk"]).drop("distinct_values")


# ---- cleaning ----

@query("remove_exact_duplicates", "SELECT description, unit, category, min(purchase_item_id) AS purchase_item_id FROM items GROUP BY 1, 2, 3")
def _(spark, d):
    return cleaning.remove_exact_duplicates(items(spark, d).select("description", "unit", "category", "purchase_item_id"), ["purchase_item_id"])


@query("resolve_revisions", """
WITH g AS (SELECT purchase_item_id, supplier_key, result_date, total_price, min(result_date) OVER w < max(result_date) OVER w AS many,
                  row_number() OVER (w ORDER BY result_date DESC, total_price) AS r FROM items WINDOW w AS (PARTITION BY purchase_item_id, supplier_key))
SELECT purchase_item_id, supplier_key, result_date::VARCHAR AS result_date, total_price::DOUBLE AS total_price FROM g WHERE NOT many OR r = 1""")
def _(spark, d):
    rows = items(spark, d, "purchase_item_id", "supplier_key", "result_date", "total_price")
    out = cleaning.resolve_revisions(rows, ["purchase_item_id", "supplier_key"], "result_date")
    return money(out, "total_price").withColumn("result_date", day("result_date"))


@query("conflicting_results", """
WITH c AS (SELECT purchase_item_id, min(date_trunc('quarter', result_date)) = max(date_trunc('quarter', result_date)) AND min(total_price) < max(total_price) AS c FROM items GROUP BY 1)
SELECT c AS conflict, count(*) AS n, sum(total_price)::DOUBLE AS spend FROM items JOIN c USING (purchase_item_id) GROUP BY 1""")
def _(spark, d):
    rows = items(spark, d, "purchase_item_id", "result_date", "total_price").withColumn("period", F.trunc("result_date", "quarter"))
    return cleaning.flag_conflicts(rows, "purchase_item_id", "period", "total_price").groupBy("conflict").agg(F.count("*").alias("n"), F.sum("total_price").cast("double").alias("spend"))


@query("spend_total", """
WITH c AS (SELECT purchase_item_id, min(date_trunc('quarter', result_date)) = max(date_trunc('quarter', result_date)) AND min(total_price) < max(total_price) AS c FROM items GROUP BY 1)
SELECT sum(total_price)::DOUBLE AS gross, (sum(total_price) FILTER (NOT c))::DOUBLE AS net, count(*) FILTER (c) AS n_excluded, (sum(total_price) FILTER (c))::DOUBLE AS excluded, round(100 * (sum(total_price) FILTER (c))::DOUBLE / sum(total_price)::DOUBLE, 4) AS pct FROM items JOIN c USING (purchase_item_id)""")
def _(spark, d):
    rows = items(spark, d, "purchase_item_id", "result_date", "total_price").withColumn("period", F.trunc("result_date", "quarter"))
    flagged = cleaning.flag_conflicts(rows, "purchase_item_id", "period", "total_price")
    return money(cleaning.spend_total(flagged, "total_price", "conflict"), "gross", "net", "excluded")


_CASE = "CASE " + " ".join(f"WHEN regexp_matches(description, '(?i)\\b({'|'.join(w)})\\b') THEN '{n}'" for n, w in CATEGORIES.items()) + " END"


@query("classify_categories", f"SELECT {_CASE} AS category, count(*) AS n FROM items GROUP BY 1")
def _(spark, d):
    return cleaning.classify(items(spark, d).drop("category"), "description", CATEGORIES).groupBy("category").agg(F.count("*").alias("n"))


@query("unit_comparability", """
WITH u AS (SELECT unit_item, unit, CASE WHEN unit = 'UNIDADE' THEN 'CONTAGEM' ELSE 'PESO' END AS dim FROM items),
p AS (SELECT unit_item, count(DISTINCT unit) AS n, count(DISTINCT dim) AS k FROM u GROUP BY 1)
SELECT unit_item, CASE WHEN n <= 1 THEN 'unit_comparable' WHEN k = 1 THEN 'unit_requires_conversion' ELSE 'unit_unknown' END AS unit_flag FROM p""")
def _(spark, d):
    return cleaning.unit_comparability(items(spark, d), "unit_item", "unit")


@query("unit_flag_shares", """
WITH p AS (SELECT unit_item, count(DISTINCT unit) AS n, count(DISTINCT CASE WHEN unit = 'UNIDADE' THEN 'C' ELSE 'P' END) AS k FROM items GROUP BY 1),
f AS (SELECT CASE WHEN n <= 1 THEN 'unit_comparable' WHEN k = 1 THEN 'unit_requires_conversion' ELSE 'unit_unknown' END AS label FROM p)
SELECT l.label, count(f.label) AS n, round(100.0 * count(f.label) / (SELECT count(*) FROM f), 4)::DOUBLE AS pct
FROM (VALUES ('unit_comparable'), ('unit_requires_conversion'), ('unit_unknown')) l(label) LEFT JOIN f USING (label) GROUP BY 1""")
def _(spark, d):
    out = cleaning.flag_shares(cleaning.unit_comparability(items(spark, d), "unit_item", "unit"), "unit_flag", ["unit_comparable", "unit_requires_conversion", "unit_unknown"])
    return out.withColumn("pct", F.col("pct").cast("double"))


@query("suppliers_per_item", "WITH p AS (SELECT item_key, count(DISTINCT supplier_key) AS n_partners FROM items GROUP BY 1) SELECT n_partners, count(*) AS n_items FROM p GROUP BY 1")
def _(spark, d):
    return cleaning.partners_per_item(items(spark, d, "item_key", "supplier_key"), "item_key", "supplier_key")


@query("key_violations", """
WITH g AS (SELECT count(*) AS n, count(DISTINCT result_date) AS d, count(DISTINCT total_price) AS v FROM items GROUP BY purchase_item_id, supplier_key HAVING count(*) > 1)
SELECT (CASE WHEN d > 1 THEN 'different' ELSE 'same' END) || '_date_' || (CASE WHEN v > 1 THEN 'different' ELSE 'same' END) || '_value' AS kind, count(*) AS n_groups, sum(n)::BIGINT AS n_rows FROM g GROUP BY 1""")
def _(spark, d):
    return cleaning.key_violations(items(spark, d), ["purchase_item_id", "supplier_key"], "result_date", "total_price")


@query("violation_sample", "SELECT purchase_item_id, supplier_key, count(*) AS n FROM items GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 20")
def _(spark, d):
    return cleaning.violation_sample(items(spark, d), ["purchase_item_id", "supplier_key"])


# ---- star ----

@query("latest_header", """
SELECT buyer_key, purchase_id FROM (SELECT buyer_key, purchase_id, row_number() OVER (PARTITION BY buyer_key ORDER BY result_date DESC, purchase_id) AS r FROM items) WHERE r = 1""")
def _(spark, d):
    return star.latest_per_key(items(spark, d, "buyer_key", "result_date", "purchase_id"), "buyer_key", "result_date").select("buyer_key", "purchase_id")


@query("dim_item", """
WITH c AS (SELECT item_key, uf, count(*) AS n FROM items GROUP BY 1, 2), m AS (SELECT item_key, uf FROM (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY n DESC, uf) AS r FROM c) WHERE r = 1)
SELECT item_key, count(*) AS n_rows, count(DISTINCT catalogue_code) AS n_codes, any_value(m.uf) AS uf, min(catalogue_code) AS code FROM items JOIN m USING (item_key) GROUP BY 1""")
def _(spark, d):
    return star.dim_item(items(spark, d), category="uf")


@query("dim_supplier", "SELECT supplier_key, count(*) AS n_rows, count(DISTINCT item_key) AS n_items, min(supplier_name) AS supplier_name FROM items GROUP BY 1")
def _(spark, d):
    return star.dim_supplier(items(spark, d))


@query("dim_date", """
SELECT strftime(x, '%Y%m%d')::INT AS date_key, x::DATE::VARCHAR AS day_date, year(x)::INT AS year, quarter(x)::INT AS quarter, month(x)::INT AS month, day(x)::INT AS day, (isodow(x) - 1)::INT AS weekday,
       list_extract(['Janeiro', 'Fevereiro', 'Março', 'Abril', 'Maio', 'Junho', 'Julho', 'Agosto', 'Setembro', 'Outubro', 'Novembro', 'Dezembro'], month(x)::INT) AS month_name
FROM (SELECT unnest(generate_series((SELECT min(l_shipdate)::DATE FROM lineitem)::TIMESTAMP, (SELECT max(l_shipdate)::DATE FROM lineitem)::TIMESTAMP, INTERVAL 1 DAY)) AS x)""", over_items=False)
def _(spark, d):
    ends = table(spark, d, "lineitem").agg(F.min(F.to_date("l_shipdate")), F.max(F.to_date("l_shipdate"))).first()
    return star.dim_date(spark, str(ends[0]), str(ends[1])).withColumn("day_date", day("day_date"))


@query("fact_purchase", """
SELECT purchase_item_id, supplier_key, o_orderstatus AS status, category AS item_category, strftime(result_date, '%Y%m%d')::INT AS date_key, round(unit_price, 6) AS unit_price
FROM items LEFT JOIN orders ON purchase_id = o_orderkey::VARCHAR WHERE unit_price IS NOT NULL""")
def _(spark, d):
    rows = items(spark, d)
    headers = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("purchase_id"), F.col("o_orderstatus").alias("status"))
    fact = star.fact_purchase(rows, headers, star.dim_item(rows))
    return fact.select("purchase_item_id", "supplier_key", "status", "item_category", "date_key", F.round("unit_price", 6).alias("unit_price"))


@query("join_audit", "SELECT count(*) AS rows_before, count(*) AS rows_after, count(*) FILTER (o_orderkey IS NULL) AS unmatched FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey", over_items=False)
def _(spark, d):
    headers = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return joins.with_headers(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), headers, "l_orderkey")[1]


@query("grain_violations", """
WITH g AS (SELECT count(*) AS n, max((total_price > 50000)::INT) AS c FROM items GROUP BY purchase_item_id, supplier_key HAVING count(*) > 1)
SELECT coalesce(sum(n), 0)::BIGINT AS violating_rows, count(*) FILTER (c = 0) AS unflagged_groups FROM g""")
def _(spark, d):
    return star.grain_violations(items(spark, d).withColumn("big", F.col("total_price") > 50000), ["purchase_item_id", "supplier_key"], "big")


_Z = """
WITH v AS (SELECT purchase_item_id, supplier_key, result_date, item_key, ln(unit_price) AS x FROM items),
m AS (SELECT item_key, count(x) AS n, median(x) AS med, stddev_samp(x) AS sd FROM v WHERE x IS NOT NULL GROUP BY 1),
a AS (SELECT item_key, median(abs(x - med)) AS mad FROM v JOIN m USING (item_key) WHERE x IS NOT NULL AND n >= 5 GROUP BY 1),
z AS (SELECT v.*, CASE WHEN mad > 0 THEN 0.6745 * (x - med) / mad WHEN sd > 0 THEN (x - med) / sd WHEN mad IS NOT NULL AND x IS NOT NULL THEN 0 END AS z FROM v LEFT JOIN m USING (item_key) LEFT JOIN a USING (item_key))
"""


@query("modified_zscore", _Z + "SELECT purchase_item_id, supplier_key, result_date::VARCHAR AS result_date, round(z, 6) AS z FROM z")
def _(spark, d):
    rows = items(spark, d, "purchase_item_id", "supplier_key", "result_date", "item_key", "unit_price").withColumn("x", F.ln("unit_price"))
    return modified_zscore(rows, "item_key", "x").select("purchase_item_id", "supplier_key", day("result_date"), F.round("z", 6).alias("z"))


@query("value_outliers", _Z + "SELECT purchase_item_id, supplier_key, result_date::VARCHAR AS result_date, 'unit_price' AS reason FROM z WHERE abs(z) > 2.5")
def _(spark, d):
    return star.flag_value_outliers(items(spark, d, "purchase_item_id", "supplier_key", "result_date", "item_key", "unit_price"), "item_key", ["unit_price"], 2.5, total=None).filter("is_outlier").select("purchase_item_id", "supplier_key", day("result_date"), "reason")


# ---- baseline, errors, anomalies, savings, drift ----

_BASE = """
WITH c AS (SELECT *, year(result_date) AS year FROM items WHERE category IS NOT NULL AND unit_price > 0 AND quantity > 0),
b AS (SELECT item_key, median(unit_price) AS expected, count(*) AS n FROM c WHERE year = 1999 GROUP BY 1),
g AS (SELECT category, median(unit_price) AS fallback FROM c WHERE year = 1999 GROUP BY 1),
r AS (SELECT c.*, b5.expected AS item_expected, coalesce(b5.expected, g.fallback) AS expected, b.item_key IS NOT NULL AS is_known
      FROM c LEFT JOIN (SELECT * FROM b WHERE n >= 5) b5 USING (item_key) LEFT JOIN b ON c.item_key = b.item_key LEFT JOIN g ON c.category = g.category WHERE year IN (2000, 2001)),
e2 AS (SELECT r.*, purchase_item_id || '/' || supplier_key || '/' || result_date AS id, ln(unit_price) - ln(expected) AS log_error, abs(ln(unit_price) - ln(expected)) AS abs_log_error, abs(unit_price - expected) AS abs_error, 100 * abs(unit_price - expected) / unit_price AS ape FROM r WHERE expected > 0),
e AS (SELECT * FROM e2 WHERE year = 2000),
t AS (SELECT quantile_cont(abs_log_error, 0.95) AS threshold FROM e WHERE is_known),
d AS (SELECT e2.*, CASE WHEN NOT is_known THEN 'nao_avaliavel' WHEN abs_log_error <= threshold THEN 'normal' WHEN log_error > 0 THEN 'acima' ELSE 'abaixo' END AS direction FROM e2, t)
"""


#: What medians, errors and savings need of an item row; only the part of a line is joined for it.
PRICED = ("purchase_item_id", "supplier_key", "result_date", "quantity", "total_price", "unit_price", "item_key", "category")


def _split(spark, d, *names):
    """Rows of the baseline with their split, stored, as every caller reads them more than once; all columns or the named ones.

    Where no `item_key` is named, items are known by the number of their part. The median takes the prices alone, so the
    rest is written for three years only.
    """
    rows = items(spark, d, *names)
    if "item_key" not in rows.columns:
        rows = rows.withColumnRenamed("l_partkey", "item_key")
    return stored(pricing.split(pricing.baseline_rows(rows), 1999, 2000, 2001))


def _with_id(rows):
    return rows.withColumn("id", F.concat_ws("/", "purchase_item_id", "supplier_key", F.col("result_date").cast("string")))


def _errors(spark, d, *splits, rows=None):
    """Errors of the medians of 1999 on later rows, those of unknown items too, with an id for each row."""
    rows = rows or _split(spark, d, *PRICED)
    train = rows.filter("split = 'train'")
    scored = pricing.scored_by_medians(rows.filter(F.col("split").isin(*(splits or ("validation",)))), train)
    return stored(pricing.prediction_errors(scored, train).withColumn("id", F.concat_ws("/", "purchase_item_id", "supplier_key", F.col("result_date").cast("string"))))


def _flagged(spark, d, rows=None):
    """Errors of 2000 and 2001 under the threshold of 2000."""
    e = _errors(spark, d, "validation", "test", rows=rows)
    return pricing.flag_anomalies(e, pricing.anomaly_threshold(e.filter("split = 'validation'")))


@query("median_baseline", _BASE + "SELECT item_key, round(expected, 6) AS expected, n, n >= 5 AS reliable FROM b")
def _(spark, d):
    return pricing.median_baseline(_split(spark, d, *PRICED).filter("split = 'train'")).withColumn("expected", F.round("expected", 6))


@query("median_baseline_eval", _BASE + """
SELECT count(*) AS n, count(item_expected) AS covered, round(100.0 * count(item_expected) / count(*), 4)::DOUBLE AS coverage, round(avg(abs(unit_price - item_expected)), 4) AS mae,
       round(sqrt(avg((unit_price - item_expected) * (unit_price - item_expected))), 4) AS rmse, round(avg(100 * abs(unit_price - item_expected) / unit_price), 4) AS mean_ape,
       round(median(100 * abs(unit_price - item_expected) / unit_price), 4) AS median_ape FROM r WHERE year = 2000""")
def _(spark, d):
    rows = _split(spark, d, *PRICED)
    return pricing.evaluate_baseline(rows.filter("split = 'validation'"), pricing.median_baseline(rows.filter("split = 'train'")))


_METRICS = """count(*) AS n, round(avg(abs_log_error), 6) AS mae_log, round(sqrt(avg(log_error * log_error)), 6) AS rmse_log, round(median(ape), 4) AS med_ape,
       round(100 * sum(abs_error) / sum(unit_price), 4) AS wape, round(avg(abs_error), 4) AS mae, round(avg(is_known::INT), 6) AS known_rate,
       round(sqrt(avg(abs_error * abs_error)), 4) AS rmse, round(1 - avg(is_known::INT), 6) AS unseen_rate FROM e"""


@query("prediction_metrics", _BASE + f"SELECT {_METRICS}")
def _(spark, d):
    return pricing.metrics(_errors(spark, d))


@query("metrics_by_category", _BASE + f"SELECT category, {_METRICS} GROUP BY 1")
def _(spark, d):
    return pricing.metrics(_errors(spark, d), "category")


@query("metrics_by_month", _BASE + f"SELECT strftime(result_date, '%Y-%m') AS month, {_METRICS} GROUP BY 1")
def _(spark, d):
    return pricing.metrics(_errors(spark, d).withColumn("month", F.date_format("result_date", "yyyy-MM")), "month")


_RESAMPLED = resampling.resampled_sql("p") + """,
i AS (SELECT quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m)
SELECT round((SELECT avg(delta) FROM p), 6) AS delta, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN low > 0 THEN 'reference_better' WHEN high < 0 THEN 'challenger_better' ELSE 'inconclusive' END AS verdict FROM i"""


@query("clustered_bootstrap", _BASE + """,
p AS (SELECT item_key, abs_log_error - abs(ln(unit_price) - ln((SELECT median(unit_price) FROM c WHERE year = 1999))) AS delta FROM e),""" + _RESAMPLED, recursive=True)
def _(spark, d):
    rows = _split(spark, d, *PRICED)
    middle = quantile(rows.filter("split = 'train'"), "unit_price", 0.5, "mid")
    pairs = _errors(spark, d, rows=rows).crossJoin(F.broadcast(middle)).withColumn("delta", F.col("abs_log_error") - F.abs(F.ln("unit_price") - F.ln("mid")))  # one row
    return resampling.clustered_bootstrap(pairs, "item_key", "delta")


@query("anomaly_calibration", _BASE + """
SELECT year::INT AS year, direction, count(*) AS n, round(avg(abs_log_error), 6) AS mean_error FROM d GROUP BY 1, 2""")
def _(spark, d):
    return _flagged(spark, d).groupBy("year", "direction").agg(F.count("*").alias("n"), F.round(F.avg("abs_log_error"), 6).alias("mean_error"))


_SAVE = _BASE + """, q AS (SELECT id, category, supplier_key, (unit_price - expected) * quantity AS saving FROM d WHERE direction = 'acima'),
o AS (SELECT *, round(saving, 4)::DECIMAL(24,4) AS s FROM q), w AS (SELECT *, coalesce(sum(s) OVER (ORDER BY s DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(s) OVER () AS total FROM o)
"""


def _savings(spark, d):
    return pricing.savings(_flagged(spark, d), 10_000.0)


@query("savings_opportunities", _SAVE + "SELECT id, category, round(saving, 4) AS saving, saving >= 10000 AS high_ticket FROM q")
def _(spark, d):
    return _savings(spark, d).select("id", "category", F.round("saving", 4).alias("saving"), "high_ticket")


@query("savings_priority", _SAVE + """SELECT id, round((before + s)::DOUBLE / total::DOUBLE, 6) AS cumulative_share,
  CASE WHEN before::DOUBLE / total::DOUBLE < 0.7 THEN 'Alta' WHEN before::DOUBLE / total::DOUBLE < 0.9 THEN 'Media' ELSE 'Baixa' END AS priority FROM w""")
def _(spark, d):
    return pricing.savings_priority(_savings(spark, d), "id").select("id", F.round("cumulative_share", 6).alias("cumulative_share"), "priority")


@query("savings_by_category", _SAVE + "SELECT category, count(*) AS n, sum(s)::DOUBLE AS saving FROM o GROUP BY 1")
def _(spark, d):
    return _savings(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.sum(F.round("saving", 4).cast("decimal(24,4)")).cast("double").alias("saving"))


#: Priorities of all transactions by what they cost, so that the running sum goes over the whole table.
@query("transaction_priority", """
WITH o AS (SELECT purchase_item_id || '/' || supplier_key || '/' || result_date AS id, total_price AS s FROM items),
w AS (SELECT id, coalesce(sum(s) OVER (ORDER BY s DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / (sum(s) OVER ())::DOUBLE AS share,
  (sum(s) OVER (ORDER BY s DESC, id ROWS UNBOUNDED PRECEDING))::DOUBLE / (sum(s) OVER ())::DOUBLE AS cumulative FROM o)
SELECT CASE WHEN share < 0.7 THEN 'Alta' WHEN share < 0.9 THEN 'Media' ELSE 'Baixa' END AS priority, count(*) AS n, round(max(cumulative), 6) AS greatest_share FROM w GROUP BY 1""")
def _(spark, d):
    rows = items(spark, d, "purchase_item_id", "supplier_key", "result_date", "total_price").select(F.concat_ws("/", "purchase_item_id", "supplier_key", F.col("result_date").cast("string")).alias("id"), F.col("total_price").alias("saving"))
    return pricing.savings_priority(rows, "id").groupBy("priority").agg(F.count("*").alias("n"), F.round(F.max("cumulative_share"), 6).alias("greatest_share"))


_MIX = """
WITH n AS (SELECT category, count(*) FILTER (year(result_date) = 1999) AS a, count(*) FILTER (year(result_date) = 2000) AS b FROM items GROUP BY 1 HAVING a + b > 0),
m AS (SELECT category, round(100 * a::DOUBLE / (sum(a) OVER ())::DOUBLE, 6) AS share_a, round(100 * b::DOUBLE / (sum(b) OVER ())::DOUBLE, 6) AS share_b FROM n)
SELECT category, share_a, share_b, round(share_b - share_a, 6) AS delta_pp FROM m"""


@query("category_mix", _MIX)
def _(spark, d):
    return pricing.category_mix(items(spark, d, "category", "result_date").withColumn("year", F.year("result_date")), "category", "year", 1999, 2000)


@query("category_mix_tvd", _MIX.replace("SELECT category, share_a, share_b, round(share_b - share_a, 6) AS delta_pp FROM m", "SELECT round(sum(abs(round(share_b - share_a, 6))) / 2, 4) AS tvd, arg_max(coalesce(category, 'Não categorizado'), abs(round(share_b - share_a, 6))) AS largest FROM m"))
def _(spark, d):
    return pricing.variation_distance(pricing.category_mix(items(spark, d, "category", "result_date").withColumn("year", F.year("result_date")), "category", "year", 1999, 2000))


@query("distribution_by_year", """
SELECT year(result_date)::INT AS year, count(*) AS n, round(median(unit_price), 4) AS price_median, round(quantile_cont(unit_price, 0.25), 4) AS p25, round(quantile_cont(unit_price, 0.75), 4) AS p75, round(quantile_cont(unit_price, 0.9), 4) AS p90, round(median(quantity), 4) AS quantity_median,
  round(avg(ln(unit_price)) FILTER (unit_price > 0), 6) AS log_price_mean, round(avg(ln(quantity)) FILTER (quantity > 0), 6) AS log_quantity_mean FROM items GROUP BY 1""")
def _(spark, d):
    return comparison.distribution(items(spark, d, "result_date", "unit_price", "quantity").withColumn("year", F.year("result_date")), "year")


# ---- exploration and text ----

@query("volume_coverage", """
WITH p AS (SELECT item_key, count(*) AS n, sum(total_price) AS s FROM items GROUP BY 1), t AS (SELECT unnest([1, 2, 3, 5, 10, 20, 30]) AS least)
SELECT least::INT AS least, count(*) FILTER (n >= least) AS n_items, coalesce(sum(s) FILTER (n >= least), 0)::DOUBLE AS spend FROM p, t GROUP BY 1""")
def _(spark, d):
    per = items(spark, d, "item_key", "total_price").groupBy("item_key").agg(F.count("*").alias("n"), F.sum("total_price").alias("s"))
    rows = per.withColumn("least", F.explode(F.array(*map(F.lit, (1, 2, 3, 5, 10, 20, 30)))))
    big = F.col("n") >= F.col("least")
    return rows.groupBy("least").agg(F.count_if(big).alias("n_items"), F.coalesce(F.sum(F.when(big, F.col("s"))), F.lit(0)).cast("double").alias("spend"))


@query("word_spend", """
WITH w AS (SELECT DISTINCT purchase_item_id, supplier_key, result_date, total_price, unnest(regexp_extract_all(lower(description), '([a-z]+)', 1)) AS word FROM items WHERE category IS NULL)
SELECT word, count(*) AS n, sum(total_price)::DOUBLE AS spend FROM w WHERE length(word) >= 4 GROUP BY 1""")
def _(spark, d):
    rows = items(spark, d).filter("category is null").select("purchase_item_id", "supplier_key", "result_date", "total_price", F.explode(F.array_distinct(text.long_words(F.col("description")))).alias("word"))
    return rows.distinct().groupBy("word").agg(F.count("*").alias("n"), F.sum("total_price").cast("double").alias("spend"))


@query("accent_free_words", """
SELECT lang, count(*) AS n_docs, count(*) FILTER (strip_accents(coalesce(text, '')) <> coalesce(text, '')) AS n_accented FROM documents GROUP BY 1""", over_items=False)
def _(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_if(text.strip_accents(F.col("text")) != F.col("text")).alias("n_accented"))


@query("top_transactions", "SELECT purchase_item_id, supplier_key, result_date::VARCHAR AS result_date, total_price::DOUBLE AS total_price FROM items ORDER BY total_price DESC, purchase_item_id, supplier_key, result_date LIMIT 20")
def _(spark, d):
    return money(items(spark, d).orderBy(F.desc("total_price"), "purchase_item_id", "supplier_key", "result_date").limit(20).select("purchase_item_id", "supplier_key", day("result_date"), "total_price"), "total_price")


@query("spend_by_region_rollup", "SELECT uf, modality, sum(total_price)::DOUBLE AS spend, count(*) AS n FROM items GROUP BY ROLLUP (uf, modality)")
def _(spark, d):
    return items(spark, d).rollup("uf", "modality").agg(F.sum("total_price").cast("double").alias("spend"), F.count("*").alias("n"))


@query("label_coverage", """
SELECT l.doc_id IS NOT NULL AS labelled, d.doc_id IS NOT NULL AS document, count(*) AS n FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2""", over_items=False)
def _(spark, d):
    a = table(spark, d, "documents").select("doc_id", F.lit(True).alias("document"))
    b = table(spark, d, "labels").select("doc_id", F.lit(True).alias("labelled"))
    has = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return a.join(b, "doc_id", "full").select(has("labelled"), has("document")).groupBy("labelled", "document").agg(F.count("*").alias("n"))


@query("events_by_day", "SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2", over_items=False)
def _(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


# ---- models (rows only) ----

def _model_rows(spark, d):
    rows = models.engineer(_split(spark, d))
    train = rows.filter("split = 'train'")
    prior = models.target_mean(train)
    default = train.agg(F.avg("log_price")).first()[0] or 0.0
    return models.with_prior(train, prior, default), models.with_prior(rows.filter("split = 'validation'"), prior, default), train


@query("price_model_ridge")
def _(spark, d):
    train, validation, known = _model_rows(spark, d)
    return pricing.metrics(pricing.prediction_errors(models.score(models.ridge(train), validation), known))


@query("price_model_trees")
def _(spark, d):
    train, validation, known = _model_rows(spark, d)
    return pricing.metrics(pricing.prediction_errors(models.score(models.trees(train), validation), known))


def _observations(spark, d):
    """Engineered rows, one for each id."""
    rows = _with_id(_split(spark, d, "purchase_item_id", "supplier_key", "result_date", "quantity", "unit_price", "item_key", "category", "uf"))
    once = rows.groupBy("id").agg(F.min(F.struct("unit_price", "quantity", "item_key", "category", "uf", "split")).alias("o"))
    return models.engineer(once.select("id", "o.*"))


@query("price_model_tuning")
def _(spark, d):
    train, validation, _known = _model_rows(spark, d)
    return models.tuned(train, validation, rounds=5)


@query("price_model_out_of_time")
def _(spark, d):
    rows = stored(_observations(spark, d))  # read by the guards, the fit and the scores
    return models.out_of_time(rows.filter("split <> 'test'"), rows.filter("split = 'test'"), "id", models.ridge)
