"""Money, ratios and number text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"


def money(c: Column | str) -> Column:
    """Exact two-digit amount; text or doubles that are not numbers become NULL."""
    col = F.col(c) if isinstance(c, str) else c
    return col.try_cast(MONEY)


def ratio(num: Column, den: Column, digits: int | None = None) -> Column:
    """``num / den`` as double, NULL when the denominator is zero or NULL."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return F.round(out, digits) if digits is not None else out


def percent(num: Column, den: Column, digits: int | None = None) -> Column:
    """``100 * num / den``, NULL when the denominator is zero."""
    out = F.try_divide(num.cast("double") * F.lit(100.0), den.cast("double"))
    return F.round(out, digits) if digits is not None else out


def percent_or_zero(num: Column, den: Column, digits: int | None = None) -> Column:
    """Like :func:`percent`, but 0 when the denominator is not positive."""
    out = F.when(den > 0, num.cast("double") * F.lit(100.0) / den.cast("double")).otherwise(F.lit(0.0))
    return F.round(out, digits) if digits is not None else out


def mean_money(total: Column, count: Column) -> Column:
    """``total / count`` rounded half up to cents on decimals, NULL for a zero count."""
    return F.round(F.try_divide(total, count), 2).cast("double")


def pct_delta(a: Column, b: Column) -> Column:
    """Percentage change from ``a`` to ``b`` with guards: 0 to 0 is 0, 0 to ± is ±100, NULL is 0."""
    a, b = a.cast("double"), b.cast("double")
    return (
        F.when(a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b), F.lit(0.0))
        .when((a == 0) & (b == 0), F.lit(0.0))
        .when((a == 0) & (b > 0), F.lit(100.0))
        .when(a == 0, F.lit(-100.0))
        .otherwise(F.try_divide(b - a, F.abs(a)) * 100.0)
    )


# The marks stripped from amounts written as text.
AMOUNT_MARKS = r"[$,€£¥%\s]"


def clean_numeric_text(c: Column) -> Column:
    """Number from text such as ``$1,250.00`` or ``12 %``; anything else counts as 0."""
    value = F.regexp_replace(c.cast("string"), AMOUNT_MARKS, "").try_cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(value)


# Lower bound, factor, digits and unit of a compact label.
COMPACT_UNITS = [
    (1_000_000_000, "0.000000001", 2, "B"),
    (1_000_000, "0.000001", 2, "M"),
    (1_000, "0.001", 1, "K"),
]


def compact_metric(value: Column, currency: bool = True) -> Column:
    """Short label of an amount: ``$1.45M``, ``$350.0K``, ``$42.50``."""
    prefix = "$" if currency else ""
    amount = value.cast("decimal(18,2)")

    def label(factor: str, digits: int, unit: str) -> Column:
        scaled = amount * F.lit(factor).cast("decimal(10,9)")
        return F.concat(F.lit(prefix), scaled.cast(f"decimal(18,{digits})").cast("string"), F.lit(unit))

    small = F.concat(F.lit(prefix), amount.cast("decimal(18,2)" if currency else "decimal(18,0)").cast("string"))
    branches = [(F.abs(amount) >= low, label(factor, digits, unit)) for low, factor, digits, unit in COMPACT_UNITS]
    first = F.when(*branches[0])
    return reduce(lambda acc, br: acc.when(*br), branches[1:], first).otherwise(small)
