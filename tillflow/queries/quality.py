"""Profiling and cleaning of a dirty table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import raw
from ..operators import cleaning, profile
from .registry import query, table
from .sqlbits import big, dbl

DIRTY = """dirty AS (SELECT event_id AS record_id,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN '  N/A ' WHEN event_id % 19 = 0 THEN '-'
    WHEN event_id % 5 = 0 THEN '  ' || event_type || chr(9) ELSE event_type END AS label,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 97 = 0 THEN value + 10000 ELSE value END AS amount, user_id::double AS units,
  CASE WHEN event_id % 29 = 0 THEN 'bad date' WHEN event_id % 31 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS seen_on, 'log' AS origin
  FROM (SELECT *, unnest(CASE WHEN event_id % 50 = 0 THEN [0, 1] ELSE [0] END) AS cp FROM events))"""

COLUMNS = ["record_id", "label", "amount", "units", "seen_on", "origin"]
NUMERIC = ["amount", "units"]
DATES = ["seen_on"]


def dirty(spark, sf):
    return raw.dirty_records(spark, sf)


def rate_sql(part: str, whole: str, digits: int = 2) -> str:
    """100 * part / whole rounded half up with integers."""
    scale = 10**digits
    return f"cast((2 * cast({part} as hugeint) * 100 * {scale} + {whole}) // (2 * cast({whole} as hugeint)) as double) / {scale}"


MISSING = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in COLUMNS)
COUNTS = "counts AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count FROM dirty" for c in COLUMNS
) + ")"
FENCES = "fences AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, round(quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 9) AS lo,
    round(quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 9) AS hi FROM dirty"""
    for c in NUMERIC
) + "), outl AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", n, lo, hi, (SELECT count(*) FROM dirty WHERE {c} < lo OR {c} > hi) AS outlier_count FROM fences WHERE \"column\" = '{c}'" for c in NUMERIC
) + ")"
DUPS = f"dups AS (SELECT sum(n) AS row_count, sum(n - 1) AS duplicate_rows FROM (SELECT count(*) AS n FROM dirty GROUP BY {', '.join(COLUMNS)}))"
BAD = "seen_on IS NOT NULL AND try_cast(seen_on as timestamp) IS NULL"


@query(
    "profile_light",
    f"""WITH {DIRTY}, s AS (SELECT count(*) AS n, sum({MISSING}) AS m FROM dirty) SELECT n AS row_count, 6 AS col_count, {big('m')} AS missing_cells,
    {rate_sql('m', '(n * 6)')} AS missing_pct, {rate_sql('(n * 6 - m)', '(n * 6)')} AS completeness_score FROM s""",
)
def profile_light(spark, sf):
    return profile.light_profile(dirty(spark, sf))


@query(
    "profile_columns",
    f"""WITH {DIRTY}, {COUNTS}, {FENCES}, c AS (SELECT counts.*, CASE WHEN "column" = 'seen_on' THEN (SELECT count(*) FROM dirty WHERE {BAD}) ELSE 0 END AS bad,
      coalesce((SELECT outlier_count FROM outl WHERE outl."column" = counts."column"), 0) AS far, {rate_sql('null_count', 'row_count')} AS null_pct FROM counts)
    SELECT "column", null_count, null_pct, unique_count, {rate_sql('unique_count', 'row_count')} AS unique_pct, {rate_sql('(row_count - null_count)', 'row_count')} AS completeness_score,
    far AS outlier_count, bad AS invalid_date_count, "column" = 'origin' AS is_constant,
    CASE WHEN "column" = 'origin' THEN 'drop_constant' WHEN null_pct > 0 AND "column" IN ('amount', 'units') THEN 'impute_numeric' WHEN null_pct > 0 THEN 'impute_mode'
      WHEN bad > 0 THEN 'standardize_dates' WHEN far > 0 THEN 'clip_outliers' ELSE 'none' END AS advice,
    CASE WHEN null_count = 0 THEN 'GOOD' WHEN null_pct < 10 THEN 'WARNING' ELSE 'CRITICAL' END AS status FROM c""",
)
def profile_columns(spark, sf):
    return profile.column_profile(dirty(spark, sf), NUMERIC, DATES)


@query("profile_duplicates", f"WITH {DIRTY}, {DUPS} SELECT {big('row_count')} AS row_count, {big('duplicate_rows')} AS duplicate_rows, {rate_sql('duplicate_rows', 'row_count', 4)} AS duplicate_pct FROM dups")
def profile_duplicates(spark, sf):
    return profile.duplicates(dirty(spark, sf))


@query(
    "profile_outliers",
    f"""WITH {DIRTY}, {FENCES} SELECT "column", n AS value_count, outlier_count, {rate_sql('outlier_count', 'n')} AS outlier_pct, round(lo, 4) AS lower_bound, round(hi, 4) AS upper_bound
    FROM outl WHERE outlier_count > 0""",
)
def profile_outliers(spark, sf):
    return profile.outliers(dirty(spark, sf), NUMERIC)


@query(
    "profile_invalid_dates",
    f"""WITH {DIRTY}, s AS (SELECT count(seen_on) AS filled, sum(CASE WHEN {BAD} THEN 1 ELSE 0 END) AS bad FROM dirty)
    SELECT 'seen_on' AS "column", filled, {big('bad')} AS invalid_count, {rate_sql('bad', 'filled')} AS invalid_pct FROM s""",
)
def profile_invalid_dates(spark, sf):
    return profile.invalid_dates(dirty(spark, sf), DATES)


SCORE = f"""{COUNTS}, {FENCES}, {DUPS}, s AS (SELECT row_count::bigint AS row_count, duplicate_rows::bigint AS duplicate_rows, (SELECT sum(null_count) FROM counts)::bigint AS missing_values,
  (SELECT sum(row_count) FROM counts)::bigint AS cells, (SELECT sum(outlier_count) FROM outl)::bigint AS outlier_count, (SELECT count(amount) + count(units) FROM dirty) AS vals,
  (SELECT count(*) FROM dirty WHERE {BAD}) AS invalid_dates, (SELECT count(*) FROM counts WHERE unique_count + (CASE WHEN null_count > 0 THEN 1 ELSE 0 END) <= 1) AS constant_columns FROM dups),
p AS (SELECT *, greatest(0, 100 - missing_values::double / cells * 100) AS c, greatest(0, 100 - duplicate_rows::double / row_count * 100) AS u,
  greatest(0, 100 - (missing_values::double / cells * 100 * 0.4 + invalid_dates::double / row_count * 100 * 2)) AS v,
  greatest(0, 100 - (outlier_count::double / greatest(1, vals) * 100 * 1.5 + constant_columns * 2)) AS k FROM s),
scored AS (SELECT *, round(least(100, 0.35::double * c + 0.30::double * u + 0.20::double * v + 0.15::double * k), 2) AS quality_score FROM p)"""


@query(
    "quality_score",
    f"""WITH {DIRTY}, {SCORE} SELECT row_count, quality_score, round(c, 2) AS completeness_score, round(u, 2) AS uniqueness_score, round(v, 2) AS validity_score, round(k, 2) AS consistency_score,
    CASE WHEN quality_score >= 95 THEN 'EXCELLENT' WHEN quality_score >= 85 THEN 'GOOD' WHEN quality_score >= 70 THEN 'FAIR' ELSE 'POOR' END AS rating,
    CASE WHEN quality_score >= 95 THEN 'EXCELLENT' WHEN quality_score >= 80 THEN 'GOOD' WHEN quality_score >= 60 THEN 'WARNING' ELSE 'CRITICAL' END AS report_rating,
    missing_values, duplicate_rows, invalid_dates, outlier_count, constant_columns, missing_values + duplicate_rows + invalid_dates + outlier_count + constant_columns AS total_issues FROM scored""",
)
def quality_score(spark, sf):
    return profile.quality_score(dirty(spark, sf), NUMERIC, DATES)


@query(
    "quality_score_simple",
    f"""WITH {DIRTY}, {DUPS}, m AS (SELECT sum({MISSING}) AS m FROM dirty) SELECT {big('row_count')} AS row_count, {big('m')} AS missing_cells, {big('duplicate_rows')} AS duplicate_rows,
    round(100 - (m::double / (row_count * 6) * 100 * 0.4 + duplicate_rows::double / row_count * 100 * 0.6), 4) AS quality_score FROM dups, m""",
)
def quality_score_simple(spark, sf):
    return profile.simple_score(dirty(spark, sf))


REASON = "concat_ws(' | ', CASE WHEN {m} > 0 THEN 'Missing values in: ' || array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ', ') END, CASE WHEN n > 1 THEN 'Duplicate row' END)".format(
    m=f"({MISSING})", names=", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in COLUMNS)
)


@query(
    "problem_rows",
    f"""WITH {DIRTY}, d AS (SELECT *, count(*) OVER (PARTITION BY {', '.join(COLUMNS)}) AS n, row_number() OVER (PARTITION BY {', '.join(COLUMNS)}) AS copy FROM dirty)
    SELECT {', '.join(COLUMNS)}, {REASON} AS reason, cast(copy as integer) AS copy FROM d WHERE n > 1 OR ({MISSING}) > 0 ORDER BY record_id, copy LIMIT 20""",
)
def problem_rows(spark, sf):
    return profile.problem_rows(dirty(spark, sf), "record_id", 20)


@query(
    "issue_rows",
    f"""WITH {DIRTY}, {FENCES}, f AS (SELECT {', '.join(COLUMNS)}, count(*) AS occurrences FROM dirty GROUP BY ALL)
    SELECT 'missing' AS issue, record_id, occurrences FROM f WHERE ({MISSING}) > 0 UNION ALL SELECT 'duplicates', record_id, occurrences FROM f WHERE occurrences > 1
    UNION ALL SELECT 'outliers', record_id, occurrences FROM f WHERE amount < (SELECT lo FROM fences WHERE "column" = 'amount') OR amount > (SELECT hi FROM fences WHERE "column" = 'amount')
    UNION ALL SELECT 'invalid_dates', record_id, occurrences FROM f WHERE {BAD} UNION ALL SELECT 'any', record_id, occurrences FROM f WHERE ({MISSING}) > 0 OR occurrences > 1""",
)
def issue_rows(spark, sf):
    frame = dirty(spark, sf)
    kinds = [("missing", None), ("duplicates", None), ("outliers", "amount"), ("invalid_dates", "seen_on"), ("any", None)]
    parts = [profile.issue_rows(frame, k, c).select(F.lit(k).alias("issue"), "record_id", "occurrences") for k, c in kinds]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# The cleaned copy: copies removed, amount filled with 0.
@query(
    "quality_delta",
    f"""WITH {DIRTY}, {SCORE}, a AS (SELECT * FROM scored),
    b AS (WITH dirty0 AS (SELECT DISTINCT record_id, label, coalesce(amount, 0) AS amount, units, seen_on, origin FROM dirty), {SCORE.replace('FROM dirty', 'FROM dirty0')} SELECT * FROM scored)
    SELECT a.quality_score AS score_before, b.quality_score AS score_after, round(b.quality_score - a.quality_score, 2) AS score_delta,
    b.missing_values - a.missing_values AS missing_delta, b.duplicate_rows - a.duplicate_rows AS duplicate_delta FROM a, b""",
)
def quality_delta(spark, sf):
    from ..operators.compare import quality_delta as delta

    before = dirty(spark, sf)
    after, _ = cleaning.apply_recipe(
        before,
        [
            {"action": "impute_missing", "params": {"column": "amount", "strategy": "zero"}},
            {"action": "remove_duplicates", "params": {"order": ["record_id"]}},
        ],
    )
    return delta(before, after, NUMERIC, DATES)


@query(
    "source_profile",
    f"""WITH d AS (SELECT text, lang, source, n_chars FROM documents), s AS (SELECT count(*) AS n FROM d), u AS (SELECT count(*) AS u FROM (SELECT DISTINCT * FROM d)),
    c AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, sum(CASE WHEN {c} IS NULL OR lower(trim(cast({c} as varchar), ' ')) IN ('', 'null', 'none', 'nan') THEN 1 ELSE 0 END)::bigint AS k FROM d" for c in ("text", "lang", "source", "n_chars"))})
    SELECT col AS "column", n AS row_count, k AS null_count, {rate_sql('k', 'n')} AS null_pct, n - u AS duplicate_rows FROM c, s, u""",
)
def source_profile(spark, sf):
    return profile.source_profile(table(spark, sf, "documents").drop("doc_id"))


# --- cleaning ----------------------------------------------------------------------------------


@query("clean_drop_missing", f"WITH {DIRTY} SELECT * FROM dirty WHERE label IS NOT NULL AND amount IS NOT NULL")
def clean_drop_missing(spark, sf):
    return cleaning.drop_missing(dirty(spark, sf), ["label", "amount"])


def imputed(spark, sf, column, strategy):
    return cleaning.impute_missing(dirty(spark, sf), column, strategy)


@query("clean_impute_mean", f"WITH {DIRTY} SELECT record_id, round(coalesce(amount, (SELECT avg(amount) FROM dirty)), 6) AS amount FROM dirty")
def clean_impute_mean(spark, sf):
    return imputed(spark, sf, "amount", "mean").select("record_id", F.round("amount", 6).alias("amount"))


@query("clean_impute_median", f"WITH {DIRTY} SELECT record_id, round(coalesce(amount, (SELECT median(amount) FROM dirty)), 6) AS amount FROM dirty")
def clean_impute_median(spark, sf):
    return imputed(spark, sf, "amount", "median").select("record_id", F.round("amount", 6).alias("amount"))


@query(
    "clean_impute_mode",
    f"WITH {DIRTY}, m AS (SELECT label FROM dirty WHERE label IS NOT NULL GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) SELECT record_id, coalesce(label, (SELECT label FROM m)) AS label FROM dirty",
)
def clean_impute_mode(spark, sf):
    return imputed(spark, sf, "label", "mode").select("record_id", "label")


@query(
    "clean_dedup",
    f"""WITH {DIRTY} SELECT record_id, label, amount, seen_on FROM (SELECT *, row_number() OVER (PARTITION BY seen_on, label ORDER BY record_id DESC) AS rn FROM dirty) WHERE rn = 1""",
)
def clean_dedup(spark, sf):
    out = cleaning.remove_duplicates(dirty(spark, sf), ["record_id"], ["seen_on", "label"], "last")
    return out.select("record_id", "label", "amount", "seen_on")


@query("clean_outliers_clip", f"""WITH {DIRTY}, {FENCES} SELECT record_id, round(CASE WHEN amount IS NOT NULL THEN least(greatest(amount, lo), hi) END, 6) AS amount FROM dirty, fences WHERE "column" = 'amount'""")
def clean_outliers_clip(spark, sf):
    out = cleaning.handle_outliers(dirty(spark, sf), "amount")
    return out.select("record_id", F.round("amount", 6).alias("amount"))


@query(
    "clean_outliers_drop",
    f"WITH {DIRTY}, s AS (SELECT avg(amount) AS m, stddev_samp(amount) AS sd FROM dirty) SELECT record_id, amount FROM dirty, s WHERE amount IS NULL OR amount BETWEEN m - 3 * sd AND m + 3 * sd",
)
def clean_outliers_drop(spark, sf):
    return cleaning.handle_outliers(dirty(spark, sf), "amount", "zscore", "drop", 3.0).select("record_id", "amount")


@query("clean_strip", f"WITH {DIRTY} SELECT record_id, trim(label, ' ' || chr(9)) AS label, seen_on, origin FROM dirty")
def clean_strip(spark, sf):
    return cleaning.strip_whitespace(dirty(spark, sf)).select("record_id", "label", "seen_on", "origin")


@query(
    "clean_case",
    """SELECT p_partkey, upper(p_name) AS upper_name, lower(p_brand) AS lower_brand, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS title_type,
    upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) AS capital_name FROM part""",
)
def clean_case(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("upper_name"), F.col("p_brand").alias("lower_brand"), F.col("p_type").alias("title_type"), F.col("p_name").alias("capital_name")
    )
    for column, case in [("upper_name", "upper"), ("lower_brand", "lower"), ("title_type", "title"), ("capital_name", "capitalize")]:
        part = cleaning.change_case(part, column, case)
    return part


@query("clean_sentinels", f"WITH {DIRTY} SELECT record_id, CASE WHEN trim(label) NOT IN ('N/A', '-') THEN label END AS label, seen_on FROM dirty")
def clean_sentinels(spark, sf):
    return cleaning.replace_placeholders(dirty(spark, sf), ["label", "seen_on"]).select("record_id", "label", "seen_on")


@query(
    "clean_coerce",
    f"""WITH {DIRTY} SELECT record_id, cast(round_even(amount, 0) as bigint) AS whole, strftime(try_cast(seen_on as timestamp), '%Y-%m-%d') AS day,
    CASE WHEN units % 2 = 0 THEN true ELSE false END AS flag, units AS number FROM dirty""",
)
def clean_coerce(spark, sf):
    words = F.when(F.col("units") % 4 == 0, "Yes").when(F.col("units") % 4 == 2, "T").when(F.col("units") % 4 == 1, "no").otherwise("0")
    frame = dirty(spark, sf).select(
        "record_id", F.col("amount").alias("whole"), F.col("seen_on").alias("day"), words.alias("flag"), F.col("units").cast("string").alias("number")
    )
    for column, target in [("whole", "integer"), ("day", "date"), ("flag", "boolean"), ("number", "numeric")]:
        frame = cleaning.coerce(frame, column, target)
    return frame.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "clean_recommend",
    f"""WITH {DIRTY}, {COUNTS}, {FENCES}, {DUPS}
    SELECT 'strip_whitespace' AS action, 'label' AS "column", count(*)::double AS evidence FROM dirty WHERE trim(label, ' ' || chr(9)) <> label
    UNION ALL SELECT 'replace_placeholders', 'label', count(*)::double FROM dirty WHERE trim(label, ' ' || chr(9)) IN ('N/A', '-')
    UNION ALL SELECT 'remove_duplicates', '*', duplicate_rows::double FROM dups UNION ALL SELECT 'drop_columns', 'origin', 1.0::double
    UNION ALL SELECT CASE WHEN "column" = 'amount' THEN 'impute_median' ELSE 'impute_mode' END, "column", null_count::double FROM counts WHERE null_count > 0
    UNION ALL SELECT 'clip_outliers', "column", outlier_count::double FROM outl WHERE outlier_count > 0""",
)
def clean_recommend(spark, sf):
    return cleaning.recommend(dirty(spark, sf), NUMERIC)


@query(
    "clean_recipe",
    f"""WITH {DIRTY}, a AS (SELECT record_id, CASE WHEN trim(label, ' ' || chr(9)) NOT IN ('N/A', '-') THEN upper(trim(label, ' ' || chr(9))) END AS label, coalesce(amount, 0) AS amount, units, seen_on FROM dirty)
    SELECT DISTINCT * FROM a WHERE label IS NOT NULL""",
)
def clean_recipe(spark, sf):
    recipe = [
        {"action": "strip_whitespace"},
        {"action": "replace_placeholders", "params": {"columns": ["label"]}},
        {"action": "no_such_step"},
        {"action": "change_case", "params": {"column": "label", "case_type": "upper"}},
        {"action": "impute_missing", "params": {"column": "amount", "strategy": "zero"}},
        {"action": "drop_missing", "params": {"columns": ["label"]}},
        {"action": "drop_columns", "params": {"columns": ["origin"]}},
        {"action": "remove_duplicates", "params": {"order": ["record_id"]}},
    ]
    out, _history = cleaning.apply_recipe(dirty(spark, sf), recipe)
    return out


@query(
    "clean_statistics",
    f"""WITH {DIRTY}, a AS (SELECT *, trim(label, ' ' || chr(9)) AS stripped FROM dirty), b AS (SELECT *, CASE WHEN stripped NOT IN ('N/A', '-') THEN stripped END AS known FROM a),
    m AS (SELECT median(amount) AS mid FROM dirty), c AS (SELECT *, coalesce(amount, mid) AS filled, try_cast(seen_on as timestamp) AS day FROM b, m),
    q AS (SELECT quantile_cont(filled, 0.25) AS q1, quantile_cont(filled, 0.75) AS q3 FROM c), d AS (SELECT *, round(q1 - 1.5 * (q3 - q1), 9) AS lo, round(q3 + 1.5 * (q3 - q1), 9) AS hi FROM c, q),
    e AS (SELECT count(*) AS n, count(CASE WHEN label <> stripped THEN 1 END) AS c1, count(CASE WHEN stripped IS NOT NULL AND known IS NULL THEN 1 END) AS c2, count(CASE WHEN upper(known) <> known THEN 1 END) AS c4,
      count(*) - count(amount) AS c5, count(CASE WHEN filled < lo OR filled > hi THEN 1 END) AS c6, count(CASE WHEN seen_on IS NOT NULL AND day IS NULL THEN 1 END) AS c7, count(known) AS n8 FROM d),
    f AS (SELECT count(*) AS n9 FROM (SELECT DISTINCT record_id, upper(known), least(greatest(filled, lo), hi), units, day, origin FROM d WHERE known IS NOT NULL)),
    s AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS step, unnest(['strip_whitespace', 'replace_placeholders', 'no_such_step', 'change_case', 'impute_missing', 'handle_outliers', 'coerce', 'drop_missing', 'remove_duplicates']) AS action,
      unnest([n, n, NULL, n, n, n, n, n, n8]) AS rows_before, unnest([n, n, NULL, n, n, n, n, n8, n9]) AS rows_after, unnest([c1, c2, NULL, c4, c5, c6, c7, 0, 0]) AS cells_changed,
      unnest(['label', 'label', NULL, 'label', 'amount', 'amount', 'seen_on', '', '']) AS name, unnest([NULL, NULL, 'unknown operation', NULL, NULL, NULL, NULL, NULL, NULL]) AS error FROM e, f)
    SELECT cast(step as integer) AS step, action, rows_before, rows_after, rows_before - rows_after AS rows_removed, cells_changed, CASE WHEN cells_changed = 0 THEN '' ELSE name END AS columns_changed, error FROM s""",
)
def clean_statistics(spark, sf):
    """What every step of a recipe did to the rows and cells."""
    recipe = [
        {"action": "strip_whitespace"},
        {"action": "replace_placeholders", "params": {"columns": ["label"]}},
        {"action": "no_such_step"},
        {"action": "change_case", "params": {"column": "label", "case_type": "upper"}},
        {"action": "impute_missing", "params": {"column": "amount", "strategy": "median"}},
        {"action": "handle_outliers", "params": {"column": "amount"}},
        {"action": "coerce", "params": {"column": "seen_on", "target": "date"}},
        {"action": "drop_missing", "params": {"columns": ["label"]}},
        {"action": "remove_duplicates", "params": {"order": ["record_id"]}},
    ]
    return cleaning.statistics(dirty(spark, sf), recipe)
