"""Customer analytics: tiers, inactivity, concentration, segment summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent, percent_or_zero
from ..operators.ranking import column_quantiles, head_sums, numbered

QUINTILES = [0.2, 0.4, 0.6, 0.8]
INACTIVE_DAYS = 180


def rfm_tiers(per_customer: DataFrame) -> DataFrame:
    """Recency, frequency and monetary scores from 1 to 5 and the tier they add up to.

    ``per_customer`` has customer_id, last_day, frequency, monetary. The quintile borders are exact
    and enter as one scalar row; a score is the number of borders below the value plus one, so equal
    customers always share a tier and no customer is ranked in a global sort.
    """
    newest = per_customer.agg(F.max("last_day").alias("d")).scalar()
    measured = per_customer.select(
        "customer_id",
        F.datediff(newest, F.col("last_day")).alias("recency_days"),
        F.col("frequency"),
        F.col("monetary").cast("double").alias("monetary"),
    )
    found = column_quantiles(measured, ["recency_days", "frequency", "monetary"], QUINTILES)
    borders = found.agg(F.map_from_entries(F.collect_list(F.struct("column", "q"))).alias("m")).scalar()
    measured = measured.withColumn("_borders", borders)

    def score(column: str, reverse: bool = False) -> Column:
        border = F.col("_borders")[column]
        below = sum((F.when(F.col(column) > border[i], 1).otherwise(0) for i in range(4)), F.lit(0))
        return (5 - below) if reverse else (1 + below)

    scored = measured.withColumns({"r": score("recency_days", True), "f": score("frequency"), "m": score("monetary")})
    total = F.col("r") + F.col("f") + F.col("m")
    tier = F.when(total >= 12, "Champions").when(total >= 9, "Loyal").when(total >= 6, "Regular").otherwise("At Risk")
    return scored.withColumn("tier", tier).drop("_borders")


def inactivity(last_seen: DataFrame) -> DataFrame:
    """Customers whose last order is more than 180 days before the end of the data."""
    newest = last_seen.agg(F.max("last_day").alias("d")).scalar()
    days = F.datediff(newest, F.col("last_day"))
    return last_seen.select("customer_id", days.alias("days_since_last"), (days > INACTIVE_DAYS).alias("is_inactive"))


def segment_summary(grouped: DataFrame, group: str) -> DataFrame:
    """Share, margin and rank of each segment. ``grouped`` has one row per segment (category, region or account)
    with revenue, profit, quantity and transactions."""
    ranked = numbered(grouped, [F.col("revenue").desc(), F.col(group).asc()])
    total = ranked.agg(F.sum("revenue")).scalar()
    return ranked.select(
        group,
        "rank",
        F.col("revenue").cast("double").alias("revenue"),
        F.round(percent(F.col("revenue"), total), 6).alias("share_pct"),
        F.col("profit").cast("double").alias("profit"),
        F.round(percent(F.col("profit"), F.col("revenue")), 6).alias("margin_pct"),
        F.col("transactions"),
        F.col("quantity"),
    )


def pareto(per_account: DataFrame, value: str) -> DataFrame:
    """Share of the top 20 percent of accounts (count rounded down and half-even) and of the top 5 and 10."""
    fifth = F.col("n") * 0.2
    heads = {
        "floor20": F.greatest(F.lit(1), F.floor(fifth)),
        "round20": F.greatest(F.lit(1), F.bround(fifth, 0)),
        "top5": F.lit(5),
        "top10": F.lit(10),
    }
    sums = head_sums(per_account, value, heads)
    shares = [F.round(percent_or_zero(F.col(f"{h}_sum"), F.col("total")), 6).alias(f"{h}_share_pct") for h in heads]
    return sums.select(
        F.col("n").alias("accounts"), F.col("floor20_k").alias("floor20_accounts"), F.col("round20_k").alias("round20_accounts"), *shares
    )
