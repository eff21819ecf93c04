"""Price baselines, prediction errors, comparison of models, anomalies and savings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import flag, ratio
from ..functions.tables import beside, quantile, quantiles, running, stored


def baseline_rows(fact: DataFrame, multiple: float = 1000.0) -> DataFrame:
    """Rows that a baseline may learn from: categorised, priced, with a quantity, neither outlier nor extreme; with their year."""
    from .spend import flag_extreme

    rows = fact.filter("category is not null and item_key is not null and unit_price > 0 and quantity > 0")
    if "is_outlier" in rows.columns:
        rows = rows.filter(~flag("is_outlier"))
    return flag_extreme(rows, "unit_price", multiple).filter("not is_extreme").drop("is_extreme").withColumn("year", F.year("result_date"))


def split(df: DataFrame, train: int, validation: int, test: int) -> DataFrame:
    """Add `split` by year; other years are dropped."""
    label = F.when(F.col("year") == train, "train").when(F.col("year") == validation, "validation").when(F.col("year") == test, "test")
    return df.withColumn("split", label).filter("split is not null")


def median_baseline(train: DataFrame, least: int = 5) -> DataFrame:
    """`item_key, expected, n, reliable`: the exact median price of each item."""
    counts = train.groupBy("item_key").agg(F.count("*").alias("n"))
    out = beside(counts, quantiles(train, "unit_price", {"expected": 0.5}, ["item_key"]), ["item_key"])
    return out.select("item_key", "expected", "n", (F.col("n") >= least).alias("reliable"))


def evaluate_baseline(rows: DataFrame, baseline: DataFrame, reliable: bool = True) -> DataFrame:
    """Coverage and errors of the baseline on other rows; all measures null where nothing is covered."""
    known = baseline.filter("reliable") if reliable else baseline
    joined = rows.select("item_key", "unit_price").join(known.select("item_key", "expected"), "item_key", "left")
    err = F.abs(F.col("unit_price") - F.col("expected"))
    ape = 100 * ratio(err, F.col("unit_price"))
    figures = joined.agg(
        F.count("*").alias("n"), F.count("expected").alias("covered"), F.round(100 * ratio(F.count("expected"), F.count("*")), 4).alias("coverage"),
        F.round(F.avg(err), 4).alias("mae"), F.round(F.sqrt(F.avg(err * err)), 4).alias("rmse"), F.round(F.avg(ape), 4).alias("mean_ape"),
    )
    return figures.crossJoin(quantile(joined.withColumn("_ape", ape), "_ape", 0.5, "median_ape")).withColumn("median_ape", F.round("median_ape", 4))  # one row each


def baseline_report(fact: DataFrame, train: int, validation: int, test: int, least: int = 5) -> DataFrame:
    """From facts to the figures of the median baseline: a row for each split with its rows, the items learnt and reliable, coverage and errors.

    The training split has no errors, as it is what the medians come from.
    """
    rows = stored(split(baseline_rows(fact), train, validation, test).select("split", "item_key", "unit_price"))
    medians = stored(median_baseline(rows.filter("split = 'train'"), least))
    items = medians.agg(F.count("*").alias("n_items"), F.count_if("reliable").alias("n_reliable"))
    out = None
    for name in ("validation", "test"):
        part = evaluate_baseline(rows.filter(F.col("split") == name), medians).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    first = rows.filter("split = 'train'").agg(F.count("*").alias("n")).withColumn("split", F.lit("train"))
    return out.unionByName(first, allowMissingColumns=True).crossJoin(items)  # one row


def category_medians(train: DataFrame) -> DataFrame:
    """`category, _category`: the exact median price of each category."""
    return quantiles(train, "unit_price", {"_category": 0.5}, ["category"])


def scored_by_medians(rows: DataFrame, train: DataFrame, least: int = 5, medians: DataFrame | None = None, by_category: DataFrame | None = None) -> DataFrame:
    """Rows with `expected`: the median of the item where that is reliable, else that of the category.

    `median_baseline` and `category_medians` of the training rows may be given, where they are read more than once.
    """
    by_item = (medians or median_baseline(train, least)).filter("reliable").select("item_key", F.col("expected").alias("_item"))
    by_category = by_category or category_medians(train)
    # a row for each category, of which there are few; rows would meet in as many tasks
    return rows.join(by_item, "item_key", "left").join(F.broadcast(by_category), "category", "left").withColumn("expected", F.coalesce("_item", "_category")).drop("_item", "_category")


def prediction_errors(scored: DataFrame, train_items: DataFrame, price: str = "unit_price", expected: str = "expected") -> DataFrame:
    """Add log error, absolute error, APE and whether the item was known in training."""
    known = train_items.select("item_key").distinct().withColumn("_k", F.lit(True))
    out = scored.filter(F.col(expected) > 0).join(known, "item_key", "left").withColumn("is_known", flag("_k")).drop("_k")
    log_error = F.ln(price) - F.ln(expected)
    return out.withColumn("log_error", log_error).withColumn("abs_log_error", F.abs("log_error")).withColumn("abs_error", F.abs(F.col(price) - F.col(expected))).withColumn("ape", 100 * ratio(F.col("abs_error"), F.col(price)))


def residuals(scored: DataFrame, price: str = "unit_price", expected: str = "expected") -> DataFrame:
    """Add `log_residual` and `deviation_pct` from the expected price; null over zero."""
    positive = (F.col(price) > 0) & (F.col(expected) > 0)
    return scored.withColumn("log_residual", F.when(positive, F.ln(price) - F.ln(expected))).withColumn("deviation_pct", 100 * ratio(F.col(price) - F.col(expected), F.col(expected)))


def metrics(errors: DataFrame, *by: str, price: str = "unit_price") -> DataFrame:
    """Error measures of all rows, or of each group."""
    rows = errors.groupBy(*by) if by else errors
    known = F.avg(F.col("is_known").cast("double"))
    figures = rows.agg(
        F.count("*").alias("n"), F.round(F.avg("abs_log_error"), 6).alias("mae_log"), F.round(F.sqrt(F.avg(F.col("log_error") * F.col("log_error"))), 6).alias("rmse_log"),
        F.round(100 * ratio(F.sum("abs_error"), F.sum(price)), 4).alias("wape"), F.round(F.avg("abs_error"), 4).alias("mae"), F.round(known, 6).alias("known_rate"),
        F.round(F.sqrt(F.avg(F.col("abs_error") * F.col("abs_error"))), 4).alias("rmse"), F.round(1 - known, 6).alias("unseen_rate"),
    )
    out = beside(figures, quantiles(errors, "ape", {"med_ape": 0.5}, by), by).withColumn("med_ape", F.round("med_ape", 4))
    return out.select(*by, "n", "mae_log", "rmse_log", "med_ape", "wape", "mae", "known_rate", "rmse", "unseen_rate")


def evaluated(errors: DataFrame, *by: str, price: str = "unit_price") -> DataFrame:
    """`metrics`, or ValueError where there is nothing to measure: no rows, or an error or price that is null, not finite, or a price of zero or less."""
    usable = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf"))
    whole = F.col(price) > 0
    for c in ("log_error", "abs_log_error", "abs_error", "ape", price):
        whole = whole & usable(c)
    n, bad = errors.agg(F.count("*"), F.count_if(~F.coalesce(whole, F.lit(False)))).first()
    if not n or bad:
        raise ValueError(f"{bad} of {n} rows cannot be measured")
    return metrics(errors, *by, price=price)


def anomaly_threshold(errors: DataFrame, level: float = 0.95, known_only: bool = True) -> DataFrame:
    """One row, `threshold`: a quantile of absolute log errors."""
    if not 0 < level < 1:
        raise ValueError("level has to lie between 0 and 1")
    return quantile(errors.filter("is_known") if known_only else errors, "abs_log_error", level, "threshold")


def baseline_metrics(rows: DataFrame, train: DataFrame, least: int = 5) -> DataFrame:
    """`metrics` of the reliable medians on the rows that they cover, with `n_rows`, `covered` and `coverage` of all rows."""
    known = median_baseline(train, least).filter("reliable").select("item_key", "expected")
    scored = rows.join(known, "item_key", "left")
    counts = scored.agg(F.count("*").alias("n_rows"), F.count("expected").alias("covered"))
    out = metrics(prediction_errors(scored.filter("expected is not null"), train)).crossJoin(counts)  # one row each
    return out.withColumn("coverage", F.round(100 * ratio(F.col("covered"), F.col("n_rows")), 4))


def flag_anomalies(errors: DataFrame, threshold: DataFrame, known_only: bool = True) -> DataFrame:
    """Add `direction` under a frozen threshold: above, below, normal or nao_avaliavel."""
    joined = errors.crossJoin(F.broadcast(threshold))  # one row
    usable = F.col("is_known") if known_only else F.lit(True)
    return joined.withColumn("direction", F.when(~usable | F.col("abs_log_error").isNull(), "nao_avaliavel").when(F.col("abs_log_error") <= F.col("threshold"), "normal").when(F.col("log_error") > 0, "acima").otherwise("abaixo")).drop("threshold")


def savings(flagged: DataFrame, high_ticket: float = 100_000.0) -> DataFrame:
    """Rows above their expected price with `saving` and `high_ticket`."""
    saving = F.greatest(F.col("unit_price") - F.col("expected"), F.lit(0.0)) * F.col("quantity")
    return flagged.filter("direction = 'acima'").withColumn("saving", saving).withColumn("high_ticket", F.col("saving") >= high_ticket)


def savings_priority(rows: DataFrame, id_column: str, first: float = 0.70, second: float = 0.90) -> DataFrame:
    """Add `cumulative_share` and `priority`, from the share of savings before the row, largest first; all low where the total is zero."""
    if not 0 < first < second <= 1:
        raise ValueError("limits have to rise between 0 and 1")
    exact = rows.withColumn("_s", F.round("saving", 4).cast("decimal(24,4)"))
    run = running(exact, {"_before": F.col("_s")}, [F.desc("_s"), F.col(id_column)], totals={"_total": "_before"})
    share = ratio(F.col("_before"), F.col("_total"))
    level = F.when(F.coalesce(F.col("_total"), F.lit(0)) <= 0, "Baixa").when(share < first, "Alta").when(share < second, "Media").otherwise("Baixa")
    return run.withColumn("cumulative_share", ratio(F.col("_before") + F.col("_s"), F.col("_total"))).withColumn("priority", level).drop("_s", "_before", "_total")


CAUTIONS = ("few_history", "unit_not_comparable", "total_mismatch", "conflicting")


def savings_confidence(df: DataFrame, cautions: Sequence[str] = CAUTIONS) -> DataFrame:
    """Add `confidence`: Baixa with any caution; else Revisao Alto Valor for high tickets and Alta for others."""
    issue = F.lit(False)
    for c in cautions:
        issue = issue | flag(c)
    return df.withColumn("confidence", F.when(issue, "Baixa").when(flag("high_ticket"), "Revisao Alto Valor").otherwise("Alta"))


def category_mix(rows: DataFrame, category: str, period: str, first, second) -> DataFrame:
    """`category, share_a, share_b, delta_pp`: shares of rows in two periods, in percent; absent is 0."""
    counts = rows.groupBy(category).agg(F.count_if(F.col(period) == first).alias("a"), F.count_if(F.col(period) == second).alias("b")).filter("a + b > 0")
    everything = Window.partitionBy()
    a, b = (100 * ratio(F.col(x), F.sum(x).over(everything)) for x in "ab")
    return counts.select(category, F.round(F.coalesce(a, F.lit(0.0)), 6).alias("share_a"), F.round(F.coalesce(b, F.lit(0.0)), 6).alias("share_b")).withColumn("delta_pp", F.round(F.col("share_b") - F.col("share_a"), 6))


def variation_distance(mix: DataFrame) -> DataFrame:
    """One row: half the sum of absolute share deltas, and the category of the largest shift."""
    return mix.agg(F.round(F.sum(F.abs("delta_pp")) / 2, 4).alias("tvd"), F.max_by(F.coalesce("category", F.lit("Não categorizado")), F.abs("delta_pp")).alias("largest"))


def histogram(rows: DataFrame, value: str, bins: int, *by: str) -> DataFrame:
    """`bin, n` of equal ranges from the least to the greatest value, the last with its upper end; by group if wanted."""
    ends = rows.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    at = F.least(F.floor(ratio(F.col(value) - F.col("_a"), F.col("_b") - F.col("_a")) * bins), F.lit(bins - 1))
    return rows.crossJoin(F.broadcast(ends)).filter(F.col(value).isNotNull()).groupBy(*by, F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))  # one row
