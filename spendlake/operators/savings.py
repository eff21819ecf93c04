"""Opportunities of saving: their history, audit, confidence and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import flag, ratio
from ..functions.tables import beside, quantiles
from .pricing import CAUTIONS, savings_confidence

#: Columns of the extract of opportunities.
EXTRACT = (
    "id", "purchase_item_id", "item_key", "description", "category", "supplier_key", "supplier_name", "unit_price", "expected", "quantity", "total_price", "deviation_pct", "saving", "priority", "confidence",
    "n_history", "history_median", "price_vs_history", "unit_flag", "high_ticket", "few_history", "unit_not_comparable", "total_mismatch", "conflicting", "n_cautions",
)
#: Tiers and priorities in the order in which they are listed.
TIERS = {"Alta": 1, "Revisao Alto Valor": 2, "Baixa": 3}
PRIORITIES = {"Alta": 1, "Media": 2, "Baixa": 3}


def in_order(df: DataFrame, column: str, order: dict[str, int]) -> DataFrame:
    """Rows sorted by a mapping of labels to places; labels without a place come last."""
    place = F.coalesce(F.create_map(*(F.lit(x) for pair in order.items() for x in pair))[F.col(column)], F.lit(len(order) + 1))
    return df.orderBy(place, column)


def history(rows: DataFrame, item: str = "item_key", price: str = "unit_price") -> DataFrame:
    """`item_key, n_history, history_median, history_p25, history_p75` of earlier prices."""
    counts = rows.groupBy(item).agg(F.count("*").alias("n_history"))
    return beside(counts, quantiles(rows, price, {"history_median": 0.5, "history_p25": 0.25, "history_p75": 0.75}, [item]), [item])


def audited(opportunities: DataFrame, past: DataFrame, units: DataFrame, unit_key: str, least: int = 5, most_off: float = 1.0) -> DataFrame:
    """Opportunities with their history, cautions, how many of them there are, and their confidence.

    `units` has `unit_flag` by `unit_key`; opportunities have `conflicting`. An item without history is not held
    to have too little of it, as there is no number to compare.
    """
    rows = opportunities.join(past, "item_key", "left").join(units, unit_key, "left")
    total = F.abs(F.col("total_price"))
    rows = rows.withColumns(
        {
            "total_off_pct": 100 * ratio(F.abs(F.col("unit_price") * F.col("quantity") - F.col("total_price")), total),
            "saving_share_pct": 100 * ratio(F.col("saving"), total),
            "price_vs_history": ratio(F.col("unit_price"), F.col("history_median")),
        }
    )
    rows = rows.withColumns(
        {
            "few_history": F.coalesce(F.col("n_history") < least, F.lit(False)),
            "unit_not_comparable": F.coalesce(F.col("unit_flag") != "unit_comparable", F.lit(True)),
            "total_mismatch": F.coalesce(F.col("total_off_pct") > most_off, F.lit(False)),
            "conflicting": flag("conflicting"),
        }
    )
    count = sum((flag(c).cast("int") for c in ("high_ticket", *CAUTIONS)), F.lit(0))
    return savings_confidence(rows.withColumn("n_cautions", count))


def exact(column: str = "saving"):
    """Savings as decimals, so that sums do not depend on their order."""
    return F.round(column, 4).cast("decimal(24,4)")


def summary(df: DataFrame) -> DataFrame:
    """`n, saving, n_high_ticket, saving_without_high_ticket`."""
    return df.agg(
        F.count("*").alias("n"), F.sum(exact()).cast("double").alias("saving"), F.count_if(flag("high_ticket")).alias("n_high_ticket"),
        F.coalesce(F.sum(F.when(~flag("high_ticket"), exact())).cast("double"), F.lit(0.0)).alias("saving_without_high_ticket"),
    )


def audit_summary(df: DataFrame) -> DataFrame:
    """`measure, value`: opportunities with each caution, without any, and their savings."""
    clean = F.col("n_cautions") == 0
    one = df.agg(
        F.count("*").cast("double").alias("n"), F.coalesce(F.sum(exact()).cast("double"), F.lit(0.0)).alias("saving"),
        *(F.count_if(flag(c)).cast("double").alias(c) for c in ("high_ticket", *CAUTIONS)),
        F.count_if(clean).cast("double").alias("clean"), F.coalesce(F.sum(F.when(clean, exact())).cast("double"), F.lit(0.0)).alias("saving_clean"),
        F.coalesce(F.sum(F.when(~flag("high_ticket"), exact())).cast("double"), F.lit(0.0)).alias("saving_without_high_ticket"),
    )
    return one.unpivot([], one.columns, "measure", "value")


def by_group(df: DataFrame, *keys: str) -> DataFrame:
    """The keys with `n, saving, share`: share of all savings in percent; null is a group of its own."""
    total = df.agg(F.sum(exact()).alias("_t"))
    per = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(exact()).alias("_s")).crossJoin(F.broadcast(total))  # one row
    return per.select(*keys, "n", F.col("_s").cast("double").alias("saving"), F.round(100 * ratio(F.col("_s"), F.col("_t")), 4).alias("share"))


def caution_reasons(df: DataFrame) -> DataFrame:
    """`reason, n` of opportunities of low confidence; one may have several reasons."""
    one = df.filter("confidence = 'Baixa'").agg(*(F.count_if(flag(c)).alias(c) for c in CAUTIONS))
    return one.unpivot([], list(CAUTIONS), "reason", "n")


def extract(df: DataFrame) -> DataFrame:
    """The columns `EXTRACT` of audited opportunities with a priority, by tier and then by saving, largest first; ValueError if one is absent."""
    if missing := [c for c in EXTRACT if c not in df.columns]:
        raise ValueError("missing columns: " + ", ".join(missing))
    place = F.coalesce(F.create_map(*(F.lit(x) for pair in TIERS.items() for x in pair))[F.col("confidence")], F.lit(len(TIERS) + 1))
    return df.orderBy(place, F.desc("saving"), "id").select(*EXTRACT)


def listed(df: DataFrame, tiers=None, categories=None, priorities=None) -> tuple[DataFrame, DataFrame]:
    """Opportunities of the chosen tiers, categories and priorities, largest saving first, and one row of `n, saving, mean` of them.

    None chooses all; an empty choice gives an empty list and sums of 0, and no mean.
    """
    for column, chosen in (("confidence", tiers), ("category", categories), ("priority", priorities)):
        if chosen is not None:
            df = df.filter(F.col(column).isin(*chosen) if chosen else F.lit(False))
    figures = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(exact()), F.lit(0)).cast("double").alias("saving"), F.round(ratio(F.sum(exact()), F.count(exact())), 4).alias("mean"))
    return df.orderBy(F.desc("saving"), "id"), figures
