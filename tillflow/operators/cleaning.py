"""Cleaning steps and recipes.

Each step is a function from frame to frame without any action; statistics a step needs (a mean, a
median, fences) enter the plan as scalar subqueries. ``run_recipe`` also counts what every step did.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text
from ..session import materialize
from .dedup import keep_one
from .fill import fill_directional
from .profile import IQR_FACTOR, column_counts, numeric_columns, outlier_bounds, outliers
from .ranking import column_quantiles
from .rules import rate
from .select import text_columns

# Texts that stand for a missing value.
PLACEHOLDERS = [
    "N/A", "NA", "null", "NULL", "None", "NONE", "-", "--", "?", "???",
    "#N/A", "#VALUE!", "nan", "NAN", "nil", "NIL", "empty", "EMPTY",
]
# Texts that stand for true and false.
TRUE_TEXT = ["1", "t", "true", "y", "yes"]
FALSE_TEXT = ["0", "f", "false", "n", "no"]
UNKNOWN = "Unknown"
MIN_VALUES = 5
IMPUTE_LIMIT_PCT = 40.0


def drop_missing(df: DataFrame, columns: list[str] | None = None, how: str = "any", thresh: int | None = None) -> DataFrame:
    subset = [c for c in columns if c in df.columns] if columns else None
    return df.dropna(how=how, thresh=thresh, subset=subset)


def _number(c: str) -> Column:
    return F.col(c).try_cast("double")


def most_frequent(df: DataFrame, column: str) -> Column:
    """Most frequent value, ties to the smallest: counted with map-side combine, then one minimum."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias("m")).scalar()


def fill_value(df: DataFrame, column: str, strategy: str, constant=None) -> Column:
    if strategy == "mean":
        return df.agg(F.avg(_number(column)).alias("m")).scalar()
    if strategy == "median":
        return column_quantiles(df, [column], [0.5]).select(F.element_at("q", 1).alias("m")).scalar()
    if strategy == "mode":
        kind = df.schema[column].dataType.simpleString()
        fallback = F.lit(UNKNOWN) if kind == "string" else F.lit(None).cast(kind)
        return F.coalesce(most_frequent(df, column), fallback)
    if strategy == "zero":
        return F.lit(0)
    return F.lit(constant if constant is not None else UNKNOWN)


def impute_missing(
    df: DataFrame,
    column: str,
    strategy: str = "median",
    constant=None,
    order: list[str] | None = None,
    keys: list[str] | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    if strategy in ("ffill", "bfill"):
        if not order or bucket is None:
            raise ValueError("directional fill needs an explicit order and a bucket of it")
        return fill_directional(df, keys or [], order, column, bucket, strategy == "bfill")
    value = fill_value(df, column, strategy, constant).cast(df.schema[column].dataType)
    return df.withColumn(column, F.coalesce(F.col(column), value))


def remove_duplicates(df: DataFrame, order: list[str], subset: list[str] | None = None, keep: str = "first") -> DataFrame:
    keys = [c for c in subset if c in df.columns] if subset else df.columns
    if set(keys) == set(df.columns):
        return df.distinct()
    rest = [c for c in df.columns if c not in order]
    direction = [F.col(c).desc() if keep == "last" else F.col(c).asc() for c in order]
    return keep_one(df, keys, [*direction, *[F.col(c) for c in rest]])


def bounds(df: DataFrame, column: str, method: str, factor: float) -> Column:
    """Struct of lower and upper bound; NULL bounds when there are too few values or no spread."""
    if method == "zscore":
        v = _number(column)
        mean, sd, n = F.avg(v), F.stddev_samp(v), F.count(v)
        usable = (n >= MIN_VALUES) & (sd > 0)
        frame = df.agg(F.struct(F.when(usable, mean - factor * sd).alias("lower"), F.when(usable, mean + factor * sd).alias("upper")).alias("b"))
    else:
        usable = F.col("n") >= MIN_VALUES
        frame = outlier_bounds(df, [column], factor).select(
            F.struct(F.when(usable, F.col("lower")).alias("lower"), F.when(usable, F.col("upper")).alias("upper")).alias("b")
        )
    return frame.scalar()


def handle_outliers(df: DataFrame, column: str, method: str = "iqr", action: str = "clip", factor: float = IQR_FACTOR) -> DataFrame:
    """Clip to the bounds or drop what lies outside; NULL is kept either way."""
    marked = df.withColumn("_bounds", bounds(df, column, method, factor))
    v, lower, upper = _number(column), F.col("_bounds.lower"), F.col("_bounds.upper")
    if action == "drop":
        outside = F.coalesce((v < lower) | (v > upper), F.lit(False))
        return marked.filter(~outside).drop("_bounds")
    # greatest/least skip NULL: a missing value must stay missing, missing bounds change nothing.
    return marked.withColumn(column, F.when(v.isNotNull(), F.least(F.greatest(v, lower), upper))).drop("_bounds")


def strip_whitespace(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    wanted = [c for c in (columns or text_columns(df)) if c in df.columns]
    return df.withColumns({c: text.strip(c) for c in wanted})


def change_case(df: DataFrame, column: str, case_type: str = "title") -> DataFrame:
    return df.withColumn(column, text.change_case(column, case_type))


def replace_placeholders(df: DataFrame, columns: list[str] | None = None, placeholders: list[str] | None = None) -> DataFrame:
    wanted = [c for c in (columns or df.columns) if c in df.columns]
    words = placeholders or PLACEHOLDERS
    return df.withColumns({c: F.when(~text.strip(F.col(c).cast("string")).isin(words), F.col(c)) for c in wanted})


def coerce(df: DataFrame, column: str, target: str, date_format: str | None = None) -> DataFrame:
    c = F.col(column)
    lowered = F.lower(c.cast("string"))
    targets: dict[str, Callable[[], Column]] = {
        "numeric": lambda: c.try_cast("double"),
        "integer": lambda: F.bround(c.try_cast("double"), 0).try_cast("bigint"),
        "date": lambda: F.try_to_timestamp(c, F.lit(date_format)) if date_format else F.try_to_timestamp(c),
        "text": lambda: F.when(~c.cast("string").isin("nan", "None"), c.cast("string")),
        "boolean": lambda: F.when(lowered.isin(TRUE_TEXT), True).when(lowered.isin(FALSE_TEXT), False),
    }
    return df.withColumn(column, targets[target]())


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def recommend(df: DataFrame, numeric: list[str] | None = None) -> DataFrame:
    """Rows (action, column, evidence) for everything worth cleaning."""
    numeric = numeric if numeric is not None else numeric_columns(df)
    words = text_columns(df)

    def sums(name: str, hit: Callable[[str], Column]) -> list[Column]:
        return [F.struct(F.lit(name).alias("action"), F.lit(c).alias("column"), F.sum(F.when(hit(c), 1).otherwise(0)).cast("double").alias("evidence")) for c in words]

    texts = df.agg(
        F.array(
            *sums("strip_whitespace", lambda c: text.strip(c) != F.col(c)),
            *sums("replace_placeholders", lambda c: text.strip(c).isin(PLACEHOLDERS)),
        ).alias("a")
    ).select(F.explode("a").alias("e")).select("e.*")
    from .profile import duplicates

    copies = duplicates(df).select(F.lit("remove_duplicates").alias("action"), F.lit("*").alias("column"), F.col("duplicate_rows").cast("double").alias("evidence"))
    counts = column_counts(df)
    constant = F.col("unique_count") + F.when(F.col("null_count") > 0, 1).otherwise(0) <= 1
    constants = counts.filter(constant).select(F.lit("drop_columns").alias("action"), "column", F.lit(1.0).alias("evidence"))
    null_pct = rate(F.col("null_count"), F.col("row_count"), 2)
    action = F.when(F.col("column").isin(numeric), "impute_median").otherwise("impute_mode")
    gaps = counts.filter((F.col("null_count") > 0) & (null_pct <= IMPUTE_LIMIT_PCT)).select(
        action.alias("action"), "column", F.col("null_count").cast("double").alias("evidence")
    )
    parts = [texts, copies, constants, gaps]
    if numeric:
        parts.append(outliers(df, numeric).select(F.lit("clip_outliers").alias("action"), "column", F.col("outlier_count").cast("double").alias("evidence")))
    return reduce(DataFrame.unionByName, parts).filter(F.col("evidence") > 0)


STEPS: dict[str, Callable[..., DataFrame]] = {
    "drop_missing": drop_missing,
    "impute_missing": impute_missing,
    "remove_duplicates": remove_duplicates,
    "handle_outliers": handle_outliers,
    "strip_whitespace": strip_whitespace,
    "change_case": change_case,
    "replace_placeholders": replace_placeholders,
    "coerce": coerce,
    "drop_columns": drop_columns,
}


def apply_recipe(df: DataFrame, recipe: list[dict]) -> tuple[DataFrame, list[dict]]:
    """Fold the steps over the frame. A step that cannot be planned is recorded and skipped.

    Undo is the same recipe without its last step on the original frame, reset is the empty recipe.
    """
    history = []
    for number, step in enumerate(recipe, start=1):
        action, params = step.get("action"), step.get("params", {})
        entry = {"step": number, "action": action, "error": None}
        if action not in STEPS:
            entry["error"] = "unknown operation"
            history.append(entry)
            continue
        try:
            df = STEPS[action](df, **params)
        except Exception as exc:  # noqa: BLE001 - the message goes into the history
            entry["error"] = str(exc).splitlines()[0]
        history.append(entry)
    return df, history


def undo(original: DataFrame, recipe: list[dict]) -> tuple[DataFrame, list[dict]]:
    return apply_recipe(original, recipe[:-1])


#: Steps that read the whole frame for a statistic, or shuffle it.
WHOLE_FRAME = ["impute_missing", "handle_outliers", "remove_duplicates"]
STATISTICS = "step int, action string, rows_before bigint, rows_after bigint, rows_removed bigint, cells_changed bigint, columns_changed string, error string"


def _changed(old: str, new: str, before: str, after: str) -> Column:
    """Cells that a step changed; where the type changes, those that it emptied."""
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double")
    if before == after or (before in numbers and after in numbers):
        return ~F.col(old).eqNullSafe(F.col(new))
    return F.col(old).isNotNull() & F.col(new).isNull()


def _observed(df: DataFrame, step: dict) -> tuple[DataFrame, Observation, list[str]]:
    """The frame after a step, its counts, and the columns whose cells are compared."""
    action, params = step["action"], dict(step.get("params", {}))
    wanted = [params["column"]] if "column" in params else []
    if action in ("strip_whitespace", "replace_placeholders"):
        default = text_columns(df) if action == "strip_whitespace" else df.columns
        wanted = params["columns"] = [c for c in (params.get("columns") or default) if c in df.columns]
    kinds = dict(df.dtypes)
    olds = {c: f"_was_{i}" for i, c in enumerate(wanted)}
    after = STEPS[action](df.withColumns({o: F.col(c) for c, o in olds.items()}), **params)
    now = dict(after.dtypes)
    seen = Observation()
    counts = [F.count_if(_changed(o, c, kinds[c], now[c])).alias(f"c{i}") for i, (c, o) in enumerate(olds.items())]
    return after.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).drop(*olds.values()), seen, wanted


def run_recipe(df: DataFrame, recipe: list[dict]) -> tuple[DataFrame, list[dict]]:
    """The stored result of a recipe and what every step did: rows before, after and removed, cells changed, columns.

    Counts are observed while the rows pass, so nothing is read again for them. Before a step that needs the whole frame
    the rows are stored once: its statistic and the step read what is stored, and counts are always taken by the tasks
    that write, of which Spark counts each once even when tasks are repeated. Steps that cannot be planned are recorded
    and skipped. NULL is a missing value, never a placeholder that was replaced.
    """
    start = Observation()
    df = df.observe(start, F.count(F.lit(1)).alias("rows"))
    history: list[dict] = []
    seen: list[tuple[dict, Observation, list[str]]] = []
    for number, step in enumerate(recipe, start=1):
        action = step.get("action")
        entry = dict.fromkeys(("rows_before", "rows_after", "rows_removed", "cells_changed", "columns_changed", "error"))
        entry = {"step": number, "action": action, **entry}
        history.append(entry)
        if action not in STEPS:
            entry["error"] = "unknown operation"
            continue
        if action in WHOLE_FRAME:
            df = materialize(df, "recipe")
        try:
            df, counts, columns = _observed(df, step)
        except Exception as exc:  # noqa: BLE001 - the message goes into the history
            entry["error"] = str(exc).splitlines()[0]
            continue
        seen.append((entry, counts, columns))
    df = materialize(df, "recipe")
    rows = start.get["rows"]
    for entry, counts, columns in seen:
        found = counts.get
        cells = {c: found[f"c{i}"] for i, c in enumerate(columns)}
        names = ",".join(c for c, n in cells.items() if n)
        entry.update(rows_before=rows, rows_after=found["rows"], rows_removed=rows - found["rows"], cells_changed=sum(cells.values()), columns_changed=names)
        rows = found["rows"]
    return df, history


def statistics(df: DataFrame, recipe: list[dict]) -> DataFrame:
    """One row per step of ``run_recipe``."""
    names = [part.split()[0] for part in STATISTICS.split(", ")]
    history = run_recipe(df, recipe)[1]
    return df.sparkSession.createDataFrame([tuple(e[n] for n in names) for e in history], STATISTICS)
