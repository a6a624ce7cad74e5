"""Hand cases and brute-force comparisons for profiling, cleaning, series, ranking and comparison."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from frames import rows
from pyspark.sql import functions as F

from tillflow.functions.numbers import compact_metric, pct_delta
from tillflow.functions.text import mask_secrets, spreadsheet_safe
from tillflow.operators import cleaning, compare, drill, kpis, profile, schema_infer, select
from tillflow.operators import timeseries as ts
from tillflow.operators.fill import fill_directional
from tillflow.operators.ranking import exact_quantiles, half_split, head_sums, numbered

DIRTY = [
    (1, " Alice ", "HR", 50000.0, "2020-01-01", "X"),
    (2, "Bob", "IT", 52000.0, "2020-02-01", "X"),
    (3, "Carol", "IT", None, "2020-03-01", "X"),
    (4, "Dan", "N/A", 51000.0, "2020-04-01", "X"),
    (5, "Eve", "HR", 53000.0, "not a date", "X"),
    (6, "Frank", "-", 49500.0, "2020-06-01", "X"),
    (7, "Grace", "IT", 1000000.0, "2020-07-01", "X"),
    (8, "Heidi", "HR", None, "2020-08-01", "X"),
    (9, "Ivan", "IT", 50500.0, "2020-09-01", "X"),
    (9, "Ivan", "IT", 50500.0, "2020-09-01", "X"),
    (10, "Judy", "HR", 51500.0, "2020-10-01", "X"),
]


@pytest.fixture(scope="module")
def dirty(spark):
    return spark.createDataFrame(DIRTY, "id int, name string, department string, salary double, join_date string, constant_col string").repartition(3)


def test_profile_of_a_dirty_table(dirty):
    light = profile.light_profile(dirty).first()
    assert (light.row_count, light.col_count, light.missing_cells) == (11, 6, 2)
    assert profile.duplicates(dirty).first().duplicate_rows == 1
    assert rows(profile.outliers(dirty, ["salary"]), "column", "outlier_count") == [("salary", 1)]
    assert profile.invalid_dates(dirty, ["join_date"]).first().invalid_count == 1
    columns = {r.column: r for r in profile.column_profile(dirty, ["salary"], ["join_date"]).collect()}
    assert columns["constant_col"].is_constant and columns["constant_col"].advice == "drop_constant"
    assert columns["salary"].null_count == 2 and columns["salary"].advice == "impute_numeric"
    score = profile.quality_score(dirty, ["salary"], ["join_date"]).first()
    assert score.total_issues == 2 + 1 + 1 + 1 + 1


def test_quality_score_matches_the_formula(dirty):
    s = profile.quality_score(dirty, ["salary"], ["join_date"]).first()
    missing, dup, bad, out = 2 / 66 * 100, 1 / 11 * 100, 1 / 11 * 100, 1 / 9 * 100
    validity = 100 - (missing * 0.4 + bad * 2)
    consistency = max(0.0, 100 - (out * 1.5 + 2.0))
    want = 0.35 * (100 - missing) + 0.3 * (100 - dup) + 0.2 * validity + 0.15 * consistency
    assert s.quality_score == pytest.approx(want, abs=0.006)


def test_problem_rows_name_gaps_and_copies(dirty):
    out = [(r.id, r.reason) for r in profile.problem_rows(dirty, "id", 20).orderBy("id", "copy").collect()]
    assert out == [(3, "Missing values in: salary"), (8, "Missing values in: salary"), (9, "Duplicate row"), (9, "Duplicate row")]


def test_cleaning_steps(dirty):
    assert cleaning.drop_missing(dirty, ["salary"]).count() == 9
    assert cleaning.remove_duplicates(dirty, ["id"]).count() == 10
    assert cleaning.replace_placeholders(dirty, ["department"]).filter("department is null").count() == 2
    clipped = cleaning.handle_outliers(dirty, "salary")
    assert clipped.count() == 11 and clipped.agg(F.max("salary")).first()[0] < 1000000
    assert clipped.filter("salary is null").count() == 2
    assert cleaning.handle_outliers(dirty, "salary", action="drop").count() == 10
    median = cleaning.impute_missing(dirty, "salary", "median").filter("id = 3").first().salary
    assert median == float(np.median([r[3] for r in DIRTY if r[3] is not None]))
    assert cleaning.impute_missing(dirty, "department", "mode").filter("department is null").count() == 0
    assert cleaning.strip_whitespace(dirty).filter("name = 'Alice'").count() == 1


def test_outliers_need_enough_values(spark):
    few = spark.createDataFrame([(1.0,), (2.0,), (1000.0,)], "v double")
    assert rows(cleaning.handle_outliers(few, "v")) == [(1.0,), (2.0,), (1000.0,)]
    same = spark.createDataFrame([(5.0,)] * 6, "v double")
    assert cleaning.handle_outliers(same, "v", "zscore", "drop").count() == 6


def test_recipe_records_errors_and_undo_replays(dirty):
    recipe = [
        {"action": "remove_duplicates", "params": {"order": ["id"]}},
        {"action": "does_not_exist"},
        {"action": "drop_missing", "params": {"columns": ["salary"]}},
    ]
    out, log = cleaning.apply_recipe(dirty, recipe)
    assert out.count() == 8 and [h["error"] is None for h in log] == [True, False, True]
    assert cleaning.undo(dirty, recipe)[0].count() == 10
    assert cleaning.apply_recipe(dirty, [])[0].count() == 11


def test_coerce(spark):
    df = spark.createDataFrame([("2.5", "Yes", "2020-01-01"), ("x", "f", "bad"), ("3.5", "maybe", None)], "n string, b string, d string")
    assert rows(cleaning.coerce(df, "n", "integer").dropna(subset=["n"]), "n") == [(2,), (4,)]
    assert [r.b for r in cleaning.coerce(df, "b", "boolean").collect()].count(None) == 1
    assert cleaning.coerce(df, "d", "date").filter("d is not null").count() == 1


def test_recommendations_cover_every_issue(dirty):
    got = {(r.action, r.column) for r in cleaning.recommend(dirty, ["salary"]).collect()}
    assert {("strip_whitespace", "name"), ("replace_placeholders", "department"), ("remove_duplicates", "*"), ("drop_columns", "constant_col"), ("impute_median", "salary"), ("clip_outliers", "salary")} <= got


# --- ranking against brute force -----------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_quantiles_match_numpy(spark, seed):
    rng = random.Random(seed)
    data = [(g, rng.choice([0.0, -5.0, rng.gauss(0, 1000), rng.expovariate(0.001), 7.25])) for g in "ab" for _ in range(500)]
    data += [("a", 7.25)] * 400 + [("b", None), ("a", float("nan"))]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for r in exact_quantiles(df, ["g"], "v", probs).collect():
        values = [v for g, v in data if g == r.g and v is not None and v == v]
        assert r.n == len(values)
        assert list(r.q) == pytest.approx(list(np.percentile(values, [p * 100 for p in probs])))


def test_head_sums_match_a_sort(spark):
    rng = random.Random(3)
    values = [rng.choice([100, 100, 100, rng.randint(1, 10**6), 0]) for _ in range(777)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(4)
    out = head_sums(df, "v", {"five": F.lit(5), "fifth": F.floor(F.col("n") * 0.2), "all": F.lit(10**6)}).first()
    ordered = sorted(values, reverse=True)
    assert (out.five_sum, out.fifth_sum, out.all_sum) == (sum(ordered[:5]), sum(ordered[: int(777 * 0.2)]), sum(values))


@pytest.mark.parametrize("n", [6, 101])
def test_half_split_matches_a_sort(spark, n):
    rng = random.Random(n)
    day0 = dt.date(2020, 1, 1)
    data = [(day0 + dt.timedelta(days=rng.choice([0, 1, 1, 1, 2])), i, rng.randint(1, 100)) for i in range(n)]
    df = spark.createDataFrame(data, "d date, k bigint, v bigint").repartition(4)
    out = half_split(df, "d", "k", "v").first()
    ordered = [v for _, _, v in sorted(data)]
    assert (out.rows, out.first_sum, out.second_sum) == (n, sum(ordered[: n // 2]), sum(ordered[n // 2 :]))


def test_half_split_by_text_ids_and_missing_ties(spark):
    rng = random.Random(8)
    for days in (1, 3):
        data = [(dt.date(2020, 1, 1 + rng.randrange(days)), rng.choice([None, f"{rng.getrandbits(60):015x}"]), rng.randint(-50, 100)) for _ in range(301)]
        out = half_split(spark.createDataFrame(data, "d date, k string, v bigint").repartition(6), "d", "k", "v").first()
        ordered = [v for _, _, _, v in sorted((d, k is not None, k or "", v) for d, k, v in data)]
        assert (out.rows, out.first_sum, out.second_sum) == (301, sum(ordered[:150]), sum(ordered[150:]))
    assert half_split(spark.createDataFrame([], "d date, k string, v bigint"), "d", "k", "v").count() == 0


def test_values_far_from_zero_are_cut(spark):
    df = spark.range(1_700_000_000, 1_700_020_000, 1, 4).selectExpr("'a' AS g", "CAST(id AS double) AS v", "id")
    assert list(exact_quantiles(df, ["g"], "v", [0.0, 0.37, 0.5, 1.0]).first().q) == pytest.approx([1.7e9, 1.7e9 + 0.37 * 19_999, 1.7e9 + 9999.5, 1.7e9 + 19_999], abs=1e-6)
    assert head_sums(df, "id", {"few": F.lit(7)}).first().few_sum == sum(range(1_700_020_000 - 7, 1_700_020_000))


def test_numbered_is_a_total_order(spark):
    rng = random.Random(9)
    data = [(rng.randint(0, 20), f"n{i:04d}") for i in range(400)]
    out = numbered(spark.createDataFrame(data, "v int, name string").repartition(7), [F.col("v").desc(), F.col("name").asc()])
    assert [r.name for r in out.orderBy("rank").collect()] == [n for _, n in sorted(data, key=lambda x: (-x[0], x[1]))]
    assert sorted(r.rank for r in out.collect()) == list(range(1, 401))


def test_alerts_for_returns_and_a_low_score(spark):
    data = [(1, 100.0, 5.0, "a", "x"), (2, -30.0, 1.0, "b", "y"), (3, 90.0, 4.0, "c", "z")]
    df = spark.createDataFrame(data, "id int, revenue double, profit double, account string, category string")
    args = (df, ["id"], "revenue", "profit", "account", "category")
    low = {r.alert: r.value for r in kpis.business_alerts(*args, score=F.lit(62.5)).collect()}
    fine = {r.alert for r in kpis.business_alerts(*args, score=F.lit(80.0)).collect()}
    assert (low["negative_revenue"], low["low_quality_score"]) == (1.0, 62.5)
    assert "negative_revenue" in fine and "low_quality_score" not in fine and "low_quality_score" not in {r.alert for r in kpis.business_alerts(*args).collect()}


def test_half_split_growth(spark):
    data = [(dt.date(2023, 1, i + 1), i, 100 if i < 3 else 200) for i in range(6)]
    out = compare.period_compare(spark.createDataFrame(data, "d date, k int, v int"), "d", "k", "v").first()
    assert (out.previous, out.current, out.difference_pct) == (300.0, 600.0, 100.0)


def test_fill_matches_a_sequential_fill(spark):
    rng = random.Random(5)
    data = [(k, t, rng.choice([None, float(t)])) for k in "ab" for t in range(60)]
    df = spark.createDataFrame(data, "k string, t int, v double").repartition(3)
    forward = rows(fill_directional(df, ["k"], ["t"], "v", F.floor(F.col("t") / 7)), "k", "t", "v")
    want = []
    for key in "ab":
        last = None
        for k, t, v in data:
            if k == key:
                last = v if v is not None else last
                want.append((k, t, last))
    assert forward == sorted(want)


# --- series ------------------------------------------------------------------------------------------


def month_rows(values, start=dt.date(2022, 1, 1)):
    out, y, m = [], start.year, start.month
    for v in values:
        out.append((dt.date(y, m, 10), float(v)))
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return out


def test_resample_fills_gaps(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 5), 10.0), (dt.date(2023, 3, 5), 30.0)], "d date, v double")
    assert [r.value for r in ts.resample(df, "d", "v", "monthly").orderBy("period").collect()] == [10.0, 0.0, 30.0]
    assert [r.value for r in ts.resample(df, "d", "v", "monthly", "avg").orderBy("period").collect()] == [10.0, None, 30.0]
    growth = ts.with_growth(ts.resample(df, "d", "v", "monthly"), "monthly").orderBy("period").collect()
    assert [r.pop_growth_pct for r in growth] == [None, -100.0, None]


def test_weeks_end_on_monday(spark):
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 8), dt.date(2024, 1, 9)]
    df = spark.createDataFrame([(d, 1.0) for d in days], "d date, v double")
    out = [(str(r.period), r.value) for r in ts.resample(df, "d", "v", "weekly").orderBy("period").collect()]
    assert out == [("2024-01-01", 1.0), ("2024-01-08", 2.0), ("2024-01-15", 1.0)]


def test_two_years_of_months(spark):
    df = spark.createDataFrame(month_rows(range(100, 124)), "d date, v double")
    out = ts.with_growth(ts.resample(df, "d", "v", "monthly"), "monthly").orderBy("period").collect()
    assert len(out) == 24 and out[12].yoy_growth_pct == pytest.approx(12.0) and out[2].rolling_3_avg == 101.0


def test_forecast_rises_and_needs_four_months(spark):
    df = spark.createDataFrame(month_rows(range(1000, 2200, 100)), "d date, v double")
    out = ts.forecast(ts.resample(df, "d", "v", "monthly"), 3).orderBy("period").collect()
    assert len(out) == 3 and out[0].trend == "Upward" and out[0].forecast == pytest.approx(2200.0)
    short = spark.createDataFrame(month_rows([1, 2]), "d date, v double")
    assert ts.forecast(ts.resample(short, "d", "v", "monthly"), 3).count() == 0


def test_spike(spark):
    df = spark.createDataFrame(month_rows([1000] * 11 + [10000]), "d date, v double")
    out = ts.zscore_anomalies(ts.resample(df, "d", "v", "monthly")).collect()
    assert [(r.type, r.observed) for r in out] == [("spike", 10000.0)]


# --- selections, KPIs, comparison -------------------------------------------------------------------------


def test_top_and_other(spark):
    df = spark.createDataFrame([(f"g{i}", float(i)) for i in range(1, 11)] + [(None, 0.5), (" ", 0.25)], "g string, v double")
    out = {r.g: r.total for r in select.top_and_other(df, "g", F.col("v"), 4).collect()}
    assert out == {"g10": 10.0, "g9": 9.0, "g8": 8.0, "g7": 7.0, "Other": 21.75}


def test_pct_delta_guards(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 50.0), (0.0, -50.0), (100.0, 150.0), (200.0, 100.0)], "a double, b double")
    assert [r[0] for r in df.select(pct_delta(F.col("a"), F.col("b"))).collect()] == [0.0, 100.0, -100.0, 50.0, -50.0]


def test_labels_and_guards(spark):
    df = spark.createDataFrame([(1450000.0,), (350000.0,), (42.5,)], "v double")
    assert [r[0] for r in df.select(compact_metric(F.col("v"))).collect()] == ["$1.45M", "$350.0K", "$42.50"]
    cells = spark.createDataFrame([("=1+1",), ("-5.2",), ("-x",), (" @a",), ("ok",), ("+",)], "c string")
    assert [r[0] for r in cells.select(spreadsheet_safe("c")).collect()] == ["'=1+1", "-5.2", "'-x", "' @a", "ok", "'+"]
    text = spark.createDataFrame([("postgresql://u:secret@h/db password=abc Bearer abcdefghijklmnopq",)], "c string")
    masked = text.select(mask_secrets("c")).first()[0]
    assert "secret" not in masked and "abc" not in masked


def test_target_status(spark):
    df = spark.createDataFrame([(850000.0, 1e6), (1.2e6, 1e6), (6e5, 1e6), (1e5, 1e6), (1.0, 0.0)], "a double, t double")
    out = [(r.attainment_pct, r.status) for r in kpis.target_status(df, "a", "t").collect()]
    assert out == [(85.0, "ON TRACK"), (120.0, "EXCEEDED"), (60.0, "AT RISK"), (10.0, "BEHIND"), (0.0, "NO TARGET")]


def test_semantic_types_and_domain(spark):
    df = spark.createDataFrame(
        [(f"o{i}", dt.date(2024, 1, i + 1), "Paris", 10.5 * i, 0.1, i % 2 == 0, "Toys") for i in range(20)],
        "order_id string, order_date date, customer_city string, revenue double, discount_rate double, is_priority boolean, product_category string",
    )
    types = {r.column: r.fine_type for r in schema_infer.catalog(df).collect()}
    assert types == {"order_id": "id", "order_date": "date", "customer_city": "geographic", "revenue": "currency", "discount_rate": "percentage", "is_priority": "boolean", "product_category": "categorical"}
    assert schema_infer.classify_domain(df.columns)[0] == "Retail & E-Commerce"
    roles = schema_infer.roles(df, types)
    assert (roles["revenue"], roles["date"], roles["order_id"]) == ("revenue", "order_date", "order_id")


def test_schema_match():
    found = schema_infer.match_schemas(["revenue", "customer_id", "order_date", "x"], ["sales", "client", "transaction_date", "y"])
    assert len(found["pairs"]) == 3 and found["match_rate_pct"] == 75.0
    assert (found["only_in_a"], found["only_in_b"]) == (["x"], ["y"])


def test_dataset_compare(spark):
    a = spark.createDataFrame([(100.0,), (200.0,), (300.0,)], "amount double")
    b = spark.createDataFrame([(200.0,), (300.0,), (400.0,)], "amount double")
    r = compare.dataset_compare(a, b, {"amount": "amount"}).first()
    assert (r.sum_a, r.sum_b, r.sum_pct, r.mean_a, r.mean_b, r.median_b) == (600.0, 900.0, 50.0, 200.0, 300.0, 300.0)


def test_record_diff(spark):
    a = spark.createDataFrame([("1", "open"), ("2", "open"), ("3", "open")], "order_id string, status string")
    b = spark.createDataFrame([("1", "open"), ("2", "closed"), ("4", "open")], "order_id string, status string")
    diff = compare.record_diff(a, b, "order_id", "order_id", [("status", "status")], ["status"], ["status"])
    c = compare.record_diff_counts(diff).first()
    assert (c.common_count, c.new_count, c.removed_count, c.changed_count) == (2, 1, 1, 1)


def test_category_shift_and_members(spark):
    a = spark.createDataFrame([("IT", 10.0), ("HR", 5.0), ("Ops", 1.0)], "dept string, val double")
    b = spark.createDataFrame([("IT", 20.0), ("Marketing", 7.0), ("Ops", 1.0)], "dept string, val double")
    out = {r.category: r.status for r in compare.category_shift(a, b, "dept", "dept", F.col("val"), F.col("val")).collect()}
    assert out == {"IT": "Common", "HR": "Only in A", "Marketing": "New in B", "Ops": "Common"}
    sales = spark.createDataFrame([("Electronics", 200.0), ("Electronics", 300.0), ("Apparel", 250.0)], "c string, v double")
    r = compare.dimension_compare(sales, "c", "Electronics", "Apparel", "v").first()
    assert (r.value_a, r.value_b, r.leader, r.difference_pct) == (500.0, 250.0, "Electronics", 100.0)


def test_hierarchies():
    out = drill.hierarchies(["order_date", "region", "state", "category", "product"], "order_date")
    assert out["Time Hierarchy"] == ["Year", "Quarter", "Month", "Day"] and out["Geographic Hierarchy"] == ["region", "state"]
