"""What a cleaning recipe reports about its steps."""

from frames import rows

from tillflow.operators import cleaning

RECIPE = [
    {"action": "strip_whitespace"},
    {"action": "replace_placeholders"},
    {"action": "coerce", "params": {"column": "n", "target": "integer"}},
    {"action": "impute_missing", "params": {"column": "n", "strategy": "median"}},
    {"action": "impute_missing", "params": {"column": "gone", "strategy": "zero"}},
    {"action": "drop_missing", "params": {"columns": ["name"]}},
    {"action": "remove_duplicates", "params": {"order": ["id"]}},
    {"action": "drop_columns", "params": {"columns": ["city"]}},
]


def test_every_step_is_counted(spark):
    data = [(1, " Ann ", "4", "Rio"), (1, "Ann", "4", "Rio "), (2, "-", "x", None), (3, None, None, "?"), (4, "Bo", "8", "\t"), (5, "Cy", "6", "Rio")]
    frame = spark.createDataFrame(data, "id int, name string, n string, city string").repartition(3)
    out, history = cleaning.run_recipe(frame, RECIPE)
    assert rows(out) == [(1, "Ann", 4), (4, "Bo", 8), (5, "Cy", 6)]
    got = [(e["rows_before"], e["rows_after"], e["rows_removed"], e["cells_changed"], e["columns_changed"]) for e in history]
    assert got == [
        (6, 6, 0, 3, "name,city"),
        (6, 6, 0, 2, "name,city"),
        (6, 6, 0, 1, "n"),
        (6, 6, 0, 2, "n"),
        (None, None, None, None, None),
        (6, 4, 2, 0, ""),
        (4, 3, 1, 0, ""),
        (3, 3, 0, 0, ""),
    ]
    assert [bool(e["error"]) for e in history] == [False] * 4 + [True] + [False] * 3


def test_an_empty_table_and_an_empty_recipe(spark):
    frame = spark.createDataFrame([], "id int, name string, n string, city string")
    out, history = cleaning.run_recipe(frame, RECIPE)
    assert out.count() == 0 and {e["rows_after"] for e in history if not e["error"]} == {0}
    full = spark.createDataFrame([(1, "a")], "id int, name string")
    out, history = cleaning.run_recipe(full, [])
    assert rows(out) == [(1, "a")] and history == []
