"""Role-driven KPIs and fact rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent_or_zero


def leader(df: DataFrame, group: str, value: Column) -> DataFrame:
    """Group with the largest sum; ties go to the first name. NULL groups do not take part."""
    totals = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.sum(value).alias("value"))
    best = totals.agg(F.min_by(F.struct(F.col(group).cast("string").alias("leader"), "value"), F.struct(-F.col("value"), F.col(group))).alias("b"))
    return best.select(F.lit(group).alias("dimension"), "b.leader", "b.value")


def rank_groups(df: DataFrame, group: str, value: Column) -> DataFrame:
    """Groups by descending sum, ties by name; there may be as many groups as accounts."""
    from .ranking import numbered

    totals = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.sum(value).alias("revenue"))
    return numbered(totals, [F.col("revenue").desc(), F.col(group).asc()])


def month_share(df: DataFrame, month: str, value: Column) -> DataFrame:
    """Revenue, transactions and share of the total per month."""
    from pyspark.sql import Window as W

    grouped = df.groupBy(F.col(month).alias("period")).agg(F.sum(value).alias("r"), F.count(value).alias("transactions"))
    whole = F.sum("r").over(W.partitionBy(F.lit(0)))
    return grouped.select(
        "period",
        F.col("r").cast("double").alias("revenue"),
        "transactions",
        F.round(percent_or_zero(F.col("r"), whole), 6).alias("share_pct"),
    )


# Alert limits in percent and in score points.
ACCOUNT_LIMIT = 35.0
CATEGORY_LIMIT = 60.0
SCORE_LIMIT = 80.0


def business_alerts(df: DataFrame, key: list[str], revenue: str, profit: str, account: str, category: str, score: Column | None = None) -> DataFrame:
    """Alert rows for missing, duplicate and negative rows, for concentration and for a low quality score.

    Row-level counts ride along with the per-key fold that finds duplicates, account and category
    totals with their own folds; the three one-row results meet as scalars.
    """
    from ..plans.baskets import alert_rows

    def flag(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0))

    per_key = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        flag(F.col(revenue).isNull() | F.col(profit).isNull()).alias("missing"),
        flag(F.col(profit) < 0).alias("losses"),
        flag(F.col(revenue) < 0).alias("refunds"),
        F.sum(revenue).alias("total"),
    )
    rows = per_key.agg(
        F.sum(F.col("n") - 1).alias("duplicates"), F.sum("missing").alias("missing"), F.sum("losses").alias("losses"), F.sum("refunds").alias("refunds"), F.sum("total").alias("total")
    )

    def largest(group: str) -> Column:
        return df.groupBy(group).agg(F.sum(revenue).alias("g")).agg(F.max("g").alias("m")).scalar()

    rows = rows.withColumns(
        {
            "account_pct": F.round(percent_or_zero(largest(account), F.col("total")), 6),
            "category_pct": F.round(percent_or_zero(largest(category), F.col("total")), 6),
            "score": score if score is not None else F.lit(None).cast("double"),
        }
    )
    return alert_rows(
        rows,
        [
            ("WARNING", "missing_values", F.col("missing"), F.col("missing") > 0),
            ("WARNING", "duplicate_rows", F.col("duplicates"), F.col("duplicates") > 0),
            ("WARNING", "negative_profit", F.col("losses"), F.col("losses") > 0),
            ("WARNING", "negative_revenue", F.col("refunds"), F.col("refunds") > 0),
            ("WARNING", "low_quality_score", F.col("score"), F.col("score") < SCORE_LIMIT),
            ("WARNING", "account_concentration", F.col("account_pct"), F.col("account_pct") > ACCOUNT_LIMIT),
            ("WARNING", "category_concentration", F.col("category_pct"), F.col("category_pct") > CATEGORY_LIMIT),
        ],
    )


def _scalar(df: DataFrame) -> Column:
    """All columns of a one-row frame as one struct."""
    return df.agg(F.first(F.struct(*df.columns)).alias("s")).scalar()


def kpi_row(df: DataFrame, roles: dict[str, str | None], tie: str) -> DataFrame:
    """Headline figures of a table by the role of its columns, in one row.

    Five measures need a distinct count; each column is counted on its own instead of expanding
    every row five times. Growth compares the earlier half of the rows with the later one.
    """
    from .profile import column_counts
    from .ranking import half_split

    revenue, profit, cost, quantity = (roles.get(r) for r in ("revenue", "profit", "cost", "quantity"))
    null = F.lit(None).cast("double")
    rev = F.col(revenue)
    base = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(rev).alias("_rev"),
        F.avg(rev).cast("double").alias("average_revenue"),
        (F.sum(profit) if profit else null).alias("_profit"),
        (F.avg(cost).cast("double") if cost else F.lit(0.0)).alias("average_cost"),
        (F.sum(quantity).cast("double") if quantity else F.count(F.lit(1)).cast("double")).alias("total_quantity"),
    )
    entities = {r: roles.get(r) for r in ("order_id", "customer", "product", "category", "region") if roles.get(r)}
    counts = column_counts(df, list(entities.values()))
    base = base.withColumn("_distinct", counts.agg(F.map_from_entries(F.collect_list(F.struct("column", "unique_count"))).alias("m")).scalar())

    def unique(role: str) -> Column:
        return F.col("_distinct")[entities[role]] if role in entities else F.lit(None).cast("bigint")

    out = base.withColumns({f"_{r}": unique(r) for r in ("order_id", "customer", "product", "category", "region")})
    orders = F.coalesce(F.col("_order_id"), F.col("row_count"))
    if roles.get("date"):
        out = out.withColumn("_half", _scalar(half_split(df, roles["date"], tie, revenue)))
        first, second = F.col("_half.first_sum"), F.col("_half.second_sum")
        enough = (F.col("_half.rows") >= 4) & (F.col("_half.first_rows") >= 2)
        growth = F.when(enough & (first > 0), percent_or_zero(second - first, first))
        previous = F.when(enough, first.cast("double"))
    else:
        growth, previous = null, null
    tops = {}
    for role in ("category", "region"):
        if roles.get(role):
            out = out.withColumn(f"_top_{role}", _scalar(leader(df, roles[role], rev)))
            tops[f"top_{role}_name"] = F.col(f"_top_{role}.leader")
            tops[f"top_{role}_val"] = F.col(f"_top_{role}.value").cast("double")
        else:
            tops[f"top_{role}_name"] = F.lit(None).cast("string")
            tops[f"top_{role}_val"] = F.lit(0.0)
    return out.select(
        "row_count",
        F.col("_rev").cast("double").alias("total_revenue"),
        orders.alias("total_transactions"),
        "total_quantity",
        "average_revenue",
        (F.col("_rev").cast("double") / F.greatest(F.lit(1), orders)).alias("average_transaction_value"),
        F.col("_profit").cast("double").alias("total_profit"),
        F.when(F.col("_rev") > 0, F.col("_profit").cast("double") / F.col("_rev").cast("double") * 100.0).alias("profit_margin"),
        "average_cost",
        F.col("_customer").alias("unique_customers"),
        F.col("_product").alias("unique_products"),
        F.col("_category").alias("unique_categories"),
        F.col("_region").alias("unique_regions"),
        growth.alias("growth_pct"),
        previous.alias("prev_period_revenue"),
        *[c.alias(a) for a, c in tops.items()],
    )


def kpi_cards(kpis: DataFrame, domain: str, roles: dict[str, str | None]) -> DataFrame:
    """The measures shown for a domain, each with its source column, formula and confidence."""
    def card(kpi: str, value: str, source: str | None, formula: str, confidence: int) -> Column:
        return F.struct(
            F.lit(kpi).alias("kpi_id"),
            F.col(value).cast("double").alias("value"),
            F.lit(source or "records").alias("source_column"),
            F.lit(formula).alias("formula"),
            F.lit(confidence).alias("confidence"),
            F.col("row_count").alias("rows_included"),
        )

    rev, profit, cat, cust, prod, qty = (roles.get(r) for r in ("revenue", "profit", "category", "customer", "product", "quantity"))
    rows = card("records", "row_count", None, "count(*)", 99)
    total = card("total_value", "total_revenue", rev, f"sum({rev})", 95) if rev else None
    kinds = card("categories", "unique_categories", cat, f"count(distinct {cat})", 90) if cat else None
    gain = card("profit", "total_profit", profit, f"sum({profit})", 94) if profit else None
    paid = bool(rev) and any(w in rev.lower() for w in ("salary", "compensation", "pay"))
    mean = card("average_value", "average_revenue", rev, f"avg({rev})", 92) if rev else None
    units = card("units", "total_quantity", qty, f"sum({qty})" if qty else "count(*)", 95)
    goods = card("products", "unique_products", prod, f"count(distinct {prod})", 90) if prod else None
    people = card("customers", "unique_customers", cust, f"count(distinct {cust})", 90) if cust else None
    if domain.startswith("HR"):
        cards = [rows, *([mean, total] if paid else []), kinds]
    elif domain.startswith("Marketing"):
        cards = [total, rows, kinds]
    elif domain.startswith("Inventory"):
        cards = [units, total, goods if goods is not None else kinds]
    elif domain.startswith("Financial"):
        cards = [total, gain, rows, kinds]
    elif domain.startswith("Healthcare"):
        cards = [rows, total, kinds]
    else:
        cards = [total, mean, gain, people if people is not None else kinds]
    return kpis.select(F.explode(F.array(*[c for c in cards if c is not None])).alias("c")).select("c.*")


def driver_decomposition(df: DataFrame, revenue: str, tie: str, date: str | None, category: str | None, region: str | None) -> DataFrame:
    """What moved a metric: the shift between halves and the leading category and region."""
    from .ranking import half_split

    total = df.agg(F.sum(revenue).alias("t")).scalar()
    parts = []
    if date:
        half = half_split(df, date, tie, revenue).filter(F.col("first_rows") >= 3)
        diff = F.col("second_sum") - F.col("first_sum")
        parts.append(
            half.select(
                F.lit("period_shift").alias("driver"),
                F.lit(revenue).alias("subject"),
                diff.cast("double").alias("value"),
                percent_or_zero(diff, F.col("first_sum")).alias("pct"),
                F.when(diff >= 0, "positive").otherwise("negative").alias("type"),
            )
        )
    for driver, group in (("segment", category), ("region", region if region != category else None)):
        if group:
            parts.append(
                leader(df, group, F.col(revenue)).select(
                    F.lit(driver).alias("driver"),
                    F.col("leader").alias("subject"),
                    F.col("value").cast("double").alias("value"),
                    percent_or_zero(F.col("value"), total).alias("pct"),
                    F.lit("info").alias("type"),
                )
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Attainment limits in percent.
ON_TRACK, AT_RISK = 80.0, 50.0


def target_status(df: DataFrame, actual: str, target: str) -> DataFrame:
    """Attainment, gap and status of every (actual, target) row; no status without a positive target."""
    a, t = F.col(actual).cast("double"), F.col(target).cast("double")
    has = t > 0
    attained = F.when(has, a / t * 100.0)
    needed = F.when(a > 0, F.try_divide(t - a, a) * 100.0).otherwise(100.0)
    status = (
        F.when(~has, "NO TARGET")
        .when(a >= t, "EXCEEDED")
        .when(attained >= ON_TRACK, "ON TRACK")
        .when(attained >= AT_RISK, "AT RISK")
        .otherwise("BEHIND")
    )
    return df.withColumns(
        {
            "attainment_pct": F.when(has, F.round(attained, 2)).otherwise(0.0),
            "remaining": F.when(has, F.round(F.greatest(F.lit(0.0), t - a), 2)),
            "gap": F.when(has, F.round(t - a, 2)),
            "required_growth_pct": F.when(has, F.round(F.greatest(F.lit(0.0), needed), 1)),
            "status": status,
        }
    )


def insight_facts(df: DataFrame, kpis: DataFrame, roles: dict[str, str | None]) -> DataFrame:
    """Fact rows (type, subject, value, share): summary, margin, leaders, Pareto, hygiene."""
    from ..plans.customers import pareto
    from .profile import duplicates, light_profile

    def fact(kind: str, subject: Column, value: Column, share: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), subject.cast("string").alias("subject"), value.cast("double").alias("value"), share.cast("double").alias("share_pct"))

    revenue, customer = roles["revenue"], roles.get("customer")
    total = F.col("total_revenue")
    missing, copies = light_profile(df).select("missing_cells").scalar(), duplicates(df).select("duplicate_rows").scalar()
    frame = kpis.withColumns({"_missing": missing, "_copies": copies})
    facts = [fact("summary", F.lit(revenue), total, F.col("growth_pct"))]
    if roles.get("profit"):
        facts.append(fact("profitability", F.lit(roles["profit"]), F.col("total_profit"), F.col("profit_margin")))
    for role in ("category", "region"):
        if roles.get(role):
            facts.append(fact(role, F.col(f"top_{role}_name"), F.col(f"top_{role}_val"), percent_or_zero(F.col(f"top_{role}_val"), total)))
    if customer:
        accounts = df.filter(F.col(customer).isNotNull()).groupBy(customer).agg(F.sum(revenue).alias("_r"))
        p = _scalar(pareto(accounts, "_r"))
        frame = frame.withColumn("_p", p)
        facts.append(fact("customer", F.lit("top_20_pct"), F.col("_p.floor20_accounts"), F.col("_p.floor20_share_pct")))
    clean = (F.col("_missing") == 0) & (F.col("_copies") == 0)
    facts.append(fact("quality", F.when(clean, "clean").otherwise("attention"), F.col("_missing") + F.col("_copies"), F.lit(None)))
    return frame.select(F.explode(F.array(*facts)).alias("f")).select("f.*")


def top_findings(kpis: DataFrame, anomalies: DataFrame, quality: DataFrame) -> DataFrame:
    """Volume, concentration, first anomaly and quality as numbered rows."""
    def row(number: int, badge: str, subject: Column, value: Column, pct: Column) -> list[Column]:
        return [F.lit(number).alias("rank"), F.lit(badge).alias("badge"), subject.cast("string").alias("subject"), value.cast("double").alias("value"), pct.cast("double").alias("pct")]

    volume = kpis.select(*row(1, "PERFORMANCE", F.lit("revenue"), F.col("total_revenue"), F.col("growth_pct")))
    share = percent_or_zero(F.col("top_category_val"), F.col("total_revenue"))
    leading = kpis.filter(F.col("top_category_name").isNotNull()).select(*row(2, "LEADER", F.col("top_category_name"), F.col("top_category_val"), share))
    first = anomalies.orderBy("period").limit(1).select(*row(3, "ANOMALY", F.date_format("period", "yyyy-MM"), F.col("observed"), F.col("deviation_pct")))
    score = quality.select(*row(4, "DATA QUALITY", F.col("rating"), F.col("quality_score"), F.lit(None)))
    return volume.unionByName(leading).unionByName(first).unionByName(score)
