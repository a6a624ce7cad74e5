"""Resampling on a gap-free calendar, growth measures, forecast and anomalies.

All windows here run over periods, whose number the calendar bounds, never over the input rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import GRANULARITIES, period_label, period_start
from .ranking import exact_quantiles

MIN_PERIODS = 4
Z_95 = 1.96


def _spine(buckets: DataFrame, keys: list[str], granularity: str) -> DataFrame:
    step = F.expr(GRANULARITIES[granularity][0])
    bounds = buckets.groupBy(*keys).agg(F.min("period").alias("_from"), F.max("period").alias("_to"))
    return bounds.select(*keys, F.explode(F.sequence("_from", "_to", step)).alias("period")).filter(F.col("period").isNotNull())


def resample(
    df: DataFrame, moment: str, value: str, granularity: str, agg: str = "sum", keys: list[str] | None = None
) -> DataFrame:
    """One row per period between the first and the last: ``keys..., period, value``.

    Missing periods count as 0 for sum and count and stay NULL for avg, min, max and median.
    """
    keys = keys or []
    rows = df.filter(F.col(moment).isNotNull() & F.col(value).isNotNull()).select(
        *keys, period_start(moment, granularity).alias("period"), F.col(value).alias("_v")
    )
    measures = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max}
    if agg == "median":
        found = exact_quantiles(rows, [*keys, "period"], "_v", [0.5])
        buckets = found.select(*keys, "period", F.element_at("q", 1).alias("value"))
    else:
        buckets = rows.groupBy(*keys, "period").agg(measures[agg]("_v").alias("value"))
    out = _spine(buckets, keys, granularity).join(buckets, [*keys, "period"], "left")
    if agg in ("sum", "count"):
        out = out.withColumn("value", F.coalesce("value", F.lit(0)))
    return out


def resample_measures(df: DataFrame, moment: str, value: str, granularity: str) -> DataFrame:
    """Sum, average, count, minimum, maximum and median of every period: one fold for the first
    five, one quantile pass for the median."""
    rows = df.filter(F.col(moment).isNotNull() & F.col(value).isNotNull()).select(
        period_start(moment, granularity).alias("period"), F.col(value).alias("_v")
    )
    folded = rows.groupBy("period").agg(
        F.sum("_v").alias("sum"), F.avg("_v").alias("avg"), F.count("_v").alias("count"), F.min("_v").alias("min"), F.max("_v").alias("max")
    )
    medians = exact_quantiles(rows, ["period"], "_v", [0.5]).select("period", F.element_at("q", 1).alias("median"))
    out = _spine(folded, [], granularity).join(folded, "period", "left").join(medians, "period", "left")
    return out.withColumns({"sum": F.coalesce("sum", F.lit(0)), "count": F.coalesce("count", F.lit(0))})


def label(ts: DataFrame, granularity: str) -> DataFrame:
    return ts.withColumn("period_label", period_label("period", granularity))


def _ordered(keys: list[str]):
    return W.partitionBy(*(keys or [F.lit(0)])).orderBy("period")


def growth(current: Column, before: Column) -> Column:
    """Percentage growth; NULL when the value before is zero or missing."""
    return F.try_divide((current - before).cast("double"), before.cast("double")) * 100.0


def with_growth(ts: DataFrame, granularity: str, keys: list[str] | None = None) -> DataFrame:
    """Add period-over-period growth, 3-period mean, running total and year-over-year growth."""
    order = _ordered(keys or [])
    whole = W.partitionBy(*(keys or [F.lit(0)]))
    lag = GRANULARITIES[granularity][1]
    value = F.col("value")
    return ts.withColumns(
        {
            "pop_growth_pct": growth(value, F.lag("value").over(order)),
            "rolling_3_avg": F.avg("value").over(order.rowsBetween(-2, 0)),
            "cumulative_total": F.sum("value").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)),
            "yoy_growth_pct": F.when(F.count(F.lit(1)).over(whole) > lag, growth(value, F.lag("value", lag).over(order))),
        }
    )


def peak_period(ts: DataFrame) -> DataFrame:
    """Highest period (earliest on ties) and growth of the latest one."""
    graded = ts.withColumn("_g", growth(F.col("value"), F.lag("value").over(_ordered([]))))
    return graded.agg(
        F.min_by(F.struct("period", "value"), F.struct(-F.col("value"), F.col("period"))).alias("p"),
        F.max_by("_g", "period").alias("latest_growth_pct"),
        F.max("period").alias("latest_period"),
    ).select(F.col("p.period").alias("peak"), F.col("p.value").alias("peak_value"), "latest_period", "latest_growth_pct")


def forecast(ts: DataFrame, horizon: int, keys: list[str] | None = None) -> DataFrame:
    """Least-squares line over the monthly values, continued for ``horizon`` months.

    Needs at least four periods per key; values and lower bounds do not go below zero; the band is
    1.96 times the population deviation of the residuals.
    """
    keys = keys or []
    order, whole = _ordered(keys), W.partitionBy(*(keys or [F.lit(0)]))
    value = F.col("value").cast("double")
    lines = ts.withColumns({"t": (F.row_number().over(order) - 1).cast("double"), "v": value, "n": F.count(F.lit(1)).over(whole)})
    lines = lines.filter(F.col("n") >= MIN_PERIODS)
    lines = lines.withColumns({"slope": F.regr_slope("v", "t").over(whole), "intercept": F.regr_intercept("v", "t").over(whole)})
    residual = F.col("v") - (F.col("slope") * F.col("t") + F.col("intercept"))
    fit = lines.groupBy(*keys, "n", "slope", "intercept").agg(
        F.stddev_pop(residual).alias("sigma"), F.max("period").alias("last")
    )
    steps = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    point = F.greatest(F.lit(0.0), F.col("slope") * (F.col("n") - 1 + F.col("step")) + F.col("intercept"))
    return steps.select(
        *keys,
        F.add_months("last", F.col("step")).alias("period"),
        point.alias("forecast"),
        F.greatest(F.lit(0.0), point - Z_95 * F.col("sigma")).alias("lower"),
        (point + Z_95 * F.col("sigma")).alias("upper"),
        F.when(F.col("slope") > 0, "Upward").otherwise("Downward").alias("trend"),
    )


# Z-score limits of spikes and drops, and of their high severity.
SPIKE_Z, SPIKE_HIGH_Z = 2.0, 2.8
DROP_Z, DROP_HIGH_Z = -1.8, -2.5
SKEW_SHARE = 60.0
SKEW_GROUPS = 3


def zscore_anomalies(ts: DataFrame) -> DataFrame:
    """Months far from the mean of all months, by sample deviation; needs four months."""
    whole = W.partitionBy(F.lit(0))
    v = F.col("value").cast("double")
    graded = ts.withColumns(
        {"mean": F.avg(v).over(whole), "sigma": F.stddev_samp(v).over(whole), "n": F.count(F.lit(1)).over(whole)}
    ).filter((F.col("n") >= MIN_PERIODS) & (F.col("sigma") > 0) & (F.col("mean") > 0))
    z = (v - F.col("mean")) / F.col("sigma")
    graded = graded.withColumn("z", z).filter((F.col("z") > SPIKE_Z) | (F.col("z") < DROP_Z))
    high = (F.col("z") > SPIKE_HIGH_Z) | (F.col("z") < DROP_HIGH_Z)
    return graded.select(
        "period",
        F.when(F.col("z") > 0, "spike").otherwise("drop").alias("type"),
        F.when(high, "HIGH").otherwise("MEDIUM").alias("severity"),
        v.alias("observed"),
        F.col("mean").alias("expected"),
        ((v - F.col("mean")) / F.col("mean") * 100.0).alias("deviation_pct"),
        "z",
    )


def concentration_anomaly(df: DataFrame, group: str, value: Column) -> DataFrame:
    """A row when one of at least three groups holds more than 60 percent of the total."""
    totals = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.sum(value).alias("g"))
    best = totals.agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("g").cast("double").alias("total"),
        F.min_by(F.struct(F.col(group).cast("string").alias("name"), "g"), F.struct(-F.col("g"), F.col(group))).alias("b"),
    )
    share = F.try_divide(F.col("b.g").cast("double") * 100.0, F.col("total"))
    return best.select(
        F.lit("skew").alias("type"),
        F.lit("MEDIUM").alias("severity"),
        F.col("b.name").alias("subject"),
        F.col("b.g").cast("double").alias("observed"),
        (F.col("total") / F.col("groups")).alias("expected"),
        share.alias("share_pct"),
        "groups",
        "total",
    ).filter((F.col("groups") >= SKEW_GROUPS) & (F.col("total") > 0) & (F.col("share_pct") > SKEW_SHARE)).drop("groups", "total")
