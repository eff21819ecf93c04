"""Registered queries on reports, extracts and views that put several operators together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.tables import sampled, stored
from ..operators import comparison, models, pricing, quality, savings, spend, star
from . import analytics, opportunities
from .adapter import items, table
from .analytics import _BASE, _METRICS, money, query

# ---- from facts to a report ----


@query("price_baseline_report", _BASE + """, g3 AS (SELECT 1999 AS year, 'train' AS split UNION ALL SELECT 2000, 'validation' UNION ALL SELECT 2001, 'test'),
i AS (SELECT count(*) AS n_items, count(*) FILTER (n >= 5) AS n_reliable FROM b), v AS (SELECT c.year, unit_price, expected AS x FROM c LEFT JOIN b ON c.item_key = b.item_key AND b.n >= 5),
k AS (SELECT year, count(*) AS n, count(x) AS covered, round(100.0 * count(x) / count(*), 4)::DOUBLE AS coverage, round(avg(abs(unit_price - x)), 4) AS mae, round(sqrt(avg((unit_price - x) * (unit_price - x))), 4) AS rmse,
  round(avg(100 * abs(unit_price - x) / unit_price), 4) AS mean_ape, round(median(100 * abs(unit_price - x) / unit_price), 4) AS median_ape FROM v GROUP BY 1)
SELECT n, CASE WHEN split <> 'train' THEN covered END AS covered, CASE WHEN split <> 'train' THEN coverage END AS coverage, CASE WHEN split <> 'train' THEN mae END AS mae, CASE WHEN split <> 'train' THEN rmse END AS rmse,
  CASE WHEN split <> 'train' THEN mean_ape END AS mean_ape, CASE WHEN split <> 'train' THEN median_ape END AS median_ape, split, n_items, n_reliable FROM k JOIN g3 USING (year), i""")
def _(spark, d):
    return pricing.baseline_report(items(spark, d), 1999, 2000, 2001)


@query("baseline_metrics_coverage", _BASE + f""", r5 AS (SELECT count(*) AS n_rows, count(item_expected) AS covered FROM r WHERE year = 2000), m AS (SELECT {_METRICS.replace("FROM e", "FROM (SELECT * FROM e WHERE item_expected IS NOT NULL)")})
SELECT m.*, n_rows, covered, round(100 * covered / n_rows::DOUBLE, 4) AS coverage FROM m, r5""")
def _(spark, d):
    rows = analytics._split(spark, d, *analytics.PRICED)
    train, later = rows.filter("split = 'train'"), rows.filter("split = 'validation'")
    return pricing.baseline_metrics(later, train)


@query("price_model_report")
def _(spark, d):
    return models.report(analytics._with_id(items(spark, d)), (1999, 2000, 2001))[0]


@query("price_model_effects")
def _(spark, d):
    return models.report(analytics._with_id(items(spark, d)), (1999, 2000, 2001), lambda rows: models.trees(rows, rounds=5))[1]


@query("model_levels", _BASE + """, z AS (SELECT year, coalesce(category, '__MISSING__') AS category, coalesce(CASE WHEN year = 1999 AND uf IN (SELECT min(uf) FROM items) THEN NULL ELSE uf END, '__MISSING__') AS uf FROM c WHERE year IN (1999, 2000, 2001)),
k AS (SELECT year, CASE WHEN category IN (SELECT category FROM z WHERE year = 1999) THEN category ELSE '__MISSING__' END AS category, CASE WHEN uf IN (SELECT uf FROM z WHERE year = 1999) THEN uf ELSE '__MISSING__' END AS uf FROM z)
SELECT year::INT AS year, category, uf, count(*) AS n FROM k GROUP BY 1, 2, 3""")
def _(spark, d):
    rows = analytics._split(spark, d)
    first = items(spark, d).agg(F.min("uf").alias("_f"))
    rows = rows.crossJoin(F.broadcast(first)).withColumn("uf", F.when((F.col("split") != "train") | (F.col("uf") != F.col("_f")), F.col("uf"))).drop("_f")  # one row; a state that training never meets
    rows = models.engineer(rows)
    return models.with_levels(rows, models.vocabulary(rows.filter("split = 'train'"))).groupBy("year", "category", "uf").agg(F.count("*").alias("n"))


@query("tuned_against_first")
def _(spark, d):
    """The first configuration of boosted trees against a tuned one on the same validation rows, by clustered bootstrap."""
    rows = stored(analytics._observations(spark, d))
    train = rows.filter("split = 'train'").select("item_key", "log_quantity", "log_price", *models.CATEGORIES)
    later = rows.filter("split = 'validation'")
    errors = lambda **how: stored(models.fitted_errors(train, later, lambda part: models.trees(part, **how)).select("id", "item_key", "abs_log_error"))
    return comparison.compare_models(errors(rounds=5), {"tuned": errors(rounds=8, depth=6)}, "id", "item_key", fixed=False)


# ---- extracts ----


@query("spend_extract", """WITH i AS (SELECT * FROM items WHERE category IS NOT NULL), c AS (SELECT category, sum(total_price) AS spend, count(*) AS n_rows, count(DISTINCT supplier_key) AS n_suppliers, count(DISTINCT item_key) AS n_items FROM i GROUP BY 1),
s AS (SELECT category, supplier_key, sum(total_price) AS x FROM i GROUP BY 1, 2), h AS (SELECT *, 100 * x::DOUBLE / (sum(x) OVER (PARTITION BY category))::DOUBLE AS share, row_number() OVER (PARTITION BY category ORDER BY x DESC) AS r FROM s),
k AS (SELECT category, round(sum(share * share), 4) AS hhi, round(max(share), 4) AS top1, round(sum(share) FILTER (r <= 3), 4) AS top3 FROM h GROUP BY 1)
SELECT category, spend::DOUBLE AS spend, n_rows, n_suppliers, n_items, round(100 * spend::DOUBLE / (sum(spend) OVER ())::DOUBLE, 4) AS pct, hhi, top1, top3,
  CASE WHEN hhi < 1500 THEN 'nao concentrado' WHEN hhi < 2500 THEN 'moderadamente concentrado' ELSE 'altamente concentrado' END AS level FROM c JOIN k USING (category)""")
def _(spark, d):
    return money(spend.spend_extract(items(spark, d)), "spend")


@query("abc_extract", """WITH x AS (SELECT coalesce(category, 'Não categorizado') AS category, supplier_key, total_price FROM items UNION ALL SELECT '__GLOBAL__', supplier_key, total_price FROM items),
s AS (SELECT category, supplier_key, sum(total_price) AS spend FROM x GROUP BY 1, 2), n AS (SELECT supplier_key, min(supplier_name) AS name FROM items GROUP BY 1),
c AS (SELECT *, row_number() OVER w AS rank, round(100 * (sum(spend) OVER (w ROWS UNBOUNDED PRECEDING))::DOUBLE / (sum(spend) OVER (PARTITION BY category))::DOUBLE, 6) AS cumulative FROM s WINDOW w AS (PARTITION BY category ORDER BY spend DESC, supplier_key))
SELECT category, supplier_key, name, spend::DOUBLE AS spend, rank, cumulative, CASE WHEN cumulative <= 80 THEN 'A' WHEN cumulative <= 95 THEN 'B' ELSE 'C' END AS abc FROM c JOIN n USING (supplier_key)""")
def _(spark, d):
    return money(spend.abc_extract(items(spark, d)), "spend")


_ROUNDED = ("unit_price", "expected", "deviation_pct", "saving", "history_median", "price_vs_history")


@query("savings_extract", opportunities._OPP + "SELECT " + ", ".join(
    {"deviation_pct": "round(100 * (unit_price - expected) / expected, 6) AS deviation_pct", "price_vs_history": "round(unit_price / history_median, 6) AS price_vs_history"}.get(c, f"round({c}, 6) AS {c}" if c in _ROUNDED else c)
    for c in savings.EXTRACT) + " FROM q")
def _(spark, d):
    rows = pricing.residuals(opportunities._audited(spark, d, "description", "supplier_name", priority=True))
    return savings.extract(rows).withColumns({c: F.round(c, 6) for c in _ROUNDED})


# ---- samples ----


@query("sampled_orders", "SELECT * FROM orders ORDER BY md5('42-' || o_orderkey), o_orderkey LIMIT 500", over_items=False)
def _(spark, d):
    return sampled(table(spark, d, "orders"), 500, "o_orderkey")


@query("observed_expected_sample", _BASE + """, s AS (SELECT *, row_number() OVER (PARTITION BY is_known ORDER BY md5('42-' || id), id) AS r FROM (SELECT DISTINCT id, is_known, round(unit_price, 6) AS unit_price, round(expected, 6) AS expected FROM e2 WHERE year = 2001))
SELECT id, is_known, unit_price, expected FROM s WHERE r <= 5000""")
def _(spark, d):
    rows = analytics._errors(spark, d, "test").select("id", "is_known", F.round("unit_price", 6).alias("unit_price"), F.round("expected", 6).alias("expected")).distinct()
    return sampled(rows, 5000, "id", ["is_known"])


# ---- views ----


@query("concentration_leader", """WITH s AS (SELECT segment, supplier_key, sum(total_price)::DOUBLE AS x FROM items GROUP BY 1, 2), h AS (SELECT segment, round(sum(pow(100 * x / t, 2)), 4) AS hhi FROM (SELECT *, sum(x) OVER (PARTITION BY segment) AS t FROM s) GROUP BY 1)
SELECT segment, hhi FROM h ORDER BY hhi DESC, segment DESC LIMIT 1""")
def _(spark, d):
    return spend.hhi(items(spark, d), "segment").orderBy(F.desc("hhi"), F.desc("segment")).limit(1).select("segment", "hhi")


@query("category_card", """WITH c AS (SELECT coalesce(category, 'Não categorizado') AS category, sum(total_price) AS spend, count(*) AS n_rows, count(DISTINCT supplier_key) AS n_suppliers, count(DISTINCT item_key) AS n_items FROM items GROUP BY 1),
p AS (SELECT *, round(100 * spend::DOUBLE / (sum(spend) OVER ())::DOUBLE, 4) AS pct, rank() OVER (ORDER BY spend DESC)::INT AS rank FROM c),
s AS (SELECT supplier_key, sum(total_price) AS x FROM items WHERE category = 'LARGE' GROUP BY 1), h AS (SELECT *, 100 * x::DOUBLE / (sum(x) OVER ())::DOUBLE AS share, row_number() OVER w AS r, round(100 * (sum(x) OVER (w ROWS UNBOUNDED PRECEDING))::DOUBLE / (sum(x) OVER ())::DOUBLE, 6) AS cum FROM s WINDOW w AS (ORDER BY x DESC, supplier_key)),
k AS (SELECT round(sum(share * share), 4) AS hhi, round(max(share), 4) AS top1, round(sum(share) FILTER (r <= 3), 4) AS top3, count(*) FILTER (cum <= 80) AS n_class_a FROM h)
SELECT category, spend::DOUBLE AS spend, n_rows, n_suppliers, n_items, pct, rank, hhi, top1, top3, CASE WHEN hhi < 1500 THEN 'nao concentrado' WHEN hhi < 2500 THEN 'moderadamente concentrado' ELSE 'altamente concentrado' END AS level, n_class_a FROM p, k WHERE category = 'LARGE'""")
def _(spark, d):
    return money(spend.category_profile(items(spark, d), "LARGE")[0], "spend")


_CHOSEN = {"tiers": ["Alta", "Baixa"], "categories": ["LARGE", "SMALL", "MEDIUM"], "priorities": ["Alta", "Media"]}
_WHERE = "confidence IN ('Alta', 'Baixa') AND category IN ('LARGE', 'SMALL', 'MEDIUM') AND priority IN ('Alta', 'Media')"


@query("chosen_opportunities", opportunities._OPP + f"SELECT id, category, confidence, priority, round(saving, 4) AS saving FROM q WHERE {_WHERE}")
def _(spark, d):
    rows, _figures = savings.listed(opportunities._audited(spark, d, priority=True), **_CHOSEN)
    return rows.select("id", "category", "confidence", "priority", F.round("saving", 4).alias("saving"))


@query("chosen_figures", opportunities._OPP + f"""SELECT 'chosen' AS choice, count(*) AS n, coalesce(sum(s), 0)::DOUBLE AS saving, round(avg(s::DOUBLE), 4) AS mean FROM q WHERE {_WHERE}
UNION ALL SELECT 'no tier', 0, 0, NULL""")
def _(spark, d):
    rows = opportunities._audited(spark, d, priority=True)
    chosen, none = savings.listed(rows, **_CHOSEN)[1], savings.listed(rows, **_CHOSEN | {"tiers": []})[1]
    return chosen.withColumn("choice", F.lit("chosen")).unionByName(none.withColumn("choice", F.lit("no tier")))


@query("price_indicators", _BASE + """SELECT CASE WHEN is_known THEN 'Known' ELSE 'Unseen' END AS segment, count(*) AS n, round(avg(abs_log_error), 6) AS mae_log, count(*) FILTER (direction = 'acima') AS n_above, count(*) FILTER (direction = 'abaixo') AS n_below,
  round(100 * count(*) FILTER (direction IN ('acima', 'abaixo')) / nullif(count(*) FILTER (is_known), 0)::DOUBLE, 4) AS anomaly_rate FROM d WHERE year = 2001 GROUP BY 1""")
def _(spark, d):
    return comparison.price_indicators(analytics._flagged(spark, d).filter("year = 2001").withColumn("segment", text.relabel(F.col("is_known").cast("string"), {"true": "Known", "false": "Unseen"})), "segment")


@query("anomaly_ranking_both", _BASE + """, rk AS (SELECT id, direction, round(abs_log_error, 6) AS error, row_number() OVER (PARTITION BY direction ORDER BY round(abs_log_error, 9) DESC, id) AS rank FROM d WHERE year = 2001 AND direction IN ('acima', 'abaixo'))
SELECT id, direction, error, rank::INT AS rank FROM rk WHERE rank <= 50""")
def _(spark, d):
    return comparison.largest_anomalies(analytics._flagged(spark, d).filter("year = 2001"), "id").select("id", "direction", F.round("abs_log_error", 6).alias("error"), "rank")


@query("monitoring_indicators", _BASE + """, p AS (SELECT avg(abs_log_error) FILTER (year = 2000) AS a, avg(abs_log_error) FILTER (year = 2001) AS z, 100 * avg((NOT is_known)::INT) FILTER (year = 2000) AS ra, 100 * avg((NOT is_known)::INT) FILTER (year = 2001) AS rz,
  avg(abs_log_error) FILTER (year = 2000 AND is_known) AS ka, avg(abs_log_error) FILTER (year = 2001 AND is_known) AS kz, avg(abs_log_error) FILTER (year = 2000 AND NOT is_known) AS ua, avg(abs_log_error) FILTER (year = 2001 AND NOT is_known) AS uz FROM e2),
o AS (SELECT round(100 * count(*) FILTER (year = 2000 AND direction IN ('acima', 'abaixo')) / nullif(count(*) FILTER (year = 2000 AND is_known), 0)::DOUBLE, 4) AS oa, round(100 * count(*) FILTER (year = 2001 AND direction IN ('acima', 'abaixo')) / nullif(count(*) FILTER (year = 2001 AND is_known), 0)::DOUBLE, 4) AS oz FROM d),
n AS (SELECT category, count(*) FILTER (year = 2000) AS x, count(*) FILTER (year = 2001) AS y FROM e2 GROUP BY 1), m AS (SELECT round(100 * y / (sum(y) OVER ())::DOUBLE, 6) - round(100 * x / (sum(x) OVER ())::DOUBLE, 6) AS delta FROM n)
SELECT round(a, 6) AS mae_log_first, round(z, 6) AS mae_log_second, round(100 * (z - a) / a, 4) AS mae_log_delta_pct, round(ka, 6) AS known_first, round(kz, 6) AS known_second, round(ua, 6) AS unseen_first, round(uz, 6) AS unseen_second,
  round(ra, 4) AS unseen_rate_first, round(rz, 4) AS unseen_rate_second, round(rz - ra, 4) AS unseen_rate_delta_pp, oa AS anomaly_rate_first, oz AS anomaly_rate_second, (SELECT round(sum(abs(round(delta, 6))) / 2, 4) FROM m) AS mix_shift FROM p, o""")
def _(spark, d):
    flagged = stored(analytics._flagged(spark, d))
    return comparison.monitoring(flagged, flagged, pricing.category_mix(flagged, "category", "year", 2000, 2001), "year", 2000, 2001)


# ---- looks at the data ----


@query("top_concentration", """WITH t AS (SELECT supplier_key, total_price FROM items ORDER BY total_price DESC, purchase_item_id LIMIT 20), p AS (SELECT supplier_key, sum(total_price) AS s FROM t GROUP BY 1)
SELECT (SELECT sum(total_price) FROM items)::DOUBLE AS spend, (SELECT sum(s) FROM p)::DOUBLE AS top_spend, round(100 * (SELECT sum(s) FROM p)::DOUBLE / (SELECT sum(total_price) FROM items)::DOUBLE, 4) AS top_share, supplier_key AS supplier,
  round(100 * s::DOUBLE / (SELECT sum(s) FROM p)::DOUBLE, 4) AS supplier_share FROM p ORDER BY s DESC, supplier_key DESC LIMIT 1""")
def _(spark, d):
    return spend.concentration_of_top(items(spark, d), "purchase_item_id")


_Z = """, m{k} AS (SELECT item_key, count(x) AS n, median(x) AS med, stddev_samp(x) AS sd FROM v{k} WHERE x IS NOT NULL GROUP BY 1), a{k} AS (SELECT item_key, median(abs(x - med)) AS mad FROM v{k} JOIN m{k} USING (item_key) WHERE x IS NOT NULL AND n >= 5 GROUP BY 1),
z{k} AS (SELECT v{k}.rid, coalesce(abs(CASE WHEN mad > 0 THEN 0.6745 * (x - med) / mad WHEN sd > 0 THEN (x - med) / sd END) > 2.5, false) AS o FROM v{k} LEFT JOIN m{k} USING (item_key) LEFT JOIN a{k} USING (item_key))"""


@query("outlier_reasons", "WITH w AS (SELECT *, row_number() OVER () AS rid FROM items)" + "".join(
    f", v{k} AS (SELECT rid, item_key, CASE WHEN {c} > 0 THEN ln({c}::DOUBLE) END AS x FROM w)" + _Z.replace("{k}", str(k)) for k, c in enumerate(("unit_price", "quantity", "total_price"))
) + """, f AS (SELECT nullif(concat_ws(',', CASE WHEN z0.o THEN 'unit_price' END, CASE WHEN z1.o THEN 'quantity' END, CASE WHEN z2.o THEN 'total_price' END), '') AS reason, total_price FROM w JOIN z0 USING (rid) JOIN z1 USING (rid) JOIN z2 USING (rid))
SELECT reason, count(*) AS n, sum(total_price)::DOUBLE AS spend FROM f GROUP BY 1""")
def _(spark, d):
    rows = star.flag_value_outliers(items(spark, d, "item_key", "unit_price", "quantity", "total_price"), "item_key", ["unit_price", "quantity"], 2.5)
    return money(rows.groupBy("reason").agg(F.count("*").alias("n"), F.sum("total_price").alias("spend")), "spend")


@query("code_gaps", "SELECT count(*) AS n, count(*) FILTER (catalogue_code IS NULL) AS missing, count(*) FILTER (catalogue_code = 0) AS zero, round(100 * count(*) FILTER (catalogue_code IS NULL) / count(*)::DOUBLE, 2) AS missing_pct, round(100 * count(*) FILTER (catalogue_code = 0) / count(*)::DOUBLE, 2) AS zero_pct FROM (SELECT CASE WHEN catalogue_code % 10 = 1 THEN 0 ELSE catalogue_code END AS catalogue_code FROM items)")
def _(spark, d):
    return quality.code_gaps(items(spark, d).withColumn("catalogue_code", F.when(F.col("catalogue_code") % 10 == 1, 0).otherwise(F.col("catalogue_code"))), "catalogue_code")


@query("code_summary", """WITH c AS (SELECT catalogue_code, count(*) AS n, count(DISTINCT description) AS k, count(DISTINCT unit) AS u FROM (SELECT *, catalogue_code % 50 AS code FROM items) WHERE catalogue_code IS NOT NULL GROUP BY 1),
g AS (SELECT catalogue_code % 50 AS code, count(*) AS n, count(DISTINCT description) AS k, count(DISTINCT unit) AS u FROM items WHERE catalogue_code IS NOT NULL GROUP BY 1)
SELECT count(*) AS n_codes, sum(n)::BIGINT AS n_rows, round(100 * count(*) FILTER (k > 1) / count(*)::DOUBLE, 2) AS several_descriptions_pct, round(100 * count(*) FILTER (u > 1) / count(*)::DOUBLE, 2) AS several_units_pct, max(u) AS most_units FROM g""")
def _(spark, d):
    return quality.code_summary(items(spark, d).withColumn("code", F.col("catalogue_code") % 50), "code", "description", "unit")
