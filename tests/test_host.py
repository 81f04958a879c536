"""Settings, variant records, protected fields, emptied tables and SQL functions on odd rows."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import sql as S
from quillon.functions import text as T
from quillon.operators import practice, quality, settings, versions


def merged(spark, stored, patch):
    row = spark.createDataFrame([(stored, patch)], "stored string, patch string")
    return settings.merged(row).first()["settings"].asDict()


def test_settings_defaults_and_limits(spark):
    plain = merged(spark, None, None)
    assert plain == merged(spark, "", "not json") == merged(spark, "{}", '{"dailyTarget": null, "other": 1}')
    assert (plain["theme"], plain["uiScale"], plain["dailyTarget"], plain["autoBackup"], plain["examGoalDate"]) == ("light", 100, 30, True, "")
    got = merged(spark, '{"dailyTarget": 7, "theme": "dark", "autoBackup": false}', '{"uiScale": 1000, "defaultExamMinutes": 1, "backupRetention": 4.5}')
    assert (got["theme"], got["dailyTarget"], got["uiScale"], got["defaultExamMinutes"], got["backupRetention"], got["autoBackup"]) == ("dark", 7, 150, 10, 5, False)
    assert merged(spark, '{"dailyTarget": 7}', '{"dailyTarget": 8, "uiScale": "big"}')["dailyTarget"] == 8
    goal = merged(spark, None, '{"examGoalName": "  %s ", "examGoalDate": " 2024-02-29 "}' % ("x" * 50))
    assert (goal["examGoalName"], goal["examGoalDate"]) == ("x" * 40, "2024-02-29")
    assert merged(spark, '{"examGoalDate": "2023-02-29"}', None)["examGoalDate"] == ""


def test_settings_of_no_rows_keep_columns(spark):
    rows = spark.createDataFrame([], "id long, stored string, patch string")
    assert settings.merged(rows).columns == ["id", "stored", "patch", "settings"] and settings.merged(rows).count() == 0


def test_variant_records(spark):
    cases = [(["b ", "A"], ["a", "B", "b"], True), ([], [], True), (None, [], True), (["A"], None, False), ([""], [], False), (["A"], ["AB"], False)]
    rows = [(i, 1, "s", ["x"], a, "e", u, "t") for i, (a, u, _) in enumerate(cases)]
    schema = "id long, question_id long, stem string, options array<string>, answer array<string>, explanation string, user_answer array<string>, created_at string"
    got = practice.variant_records(spark.createDataFrame(rows, schema)).orderBy("id").collect()
    assert [r["correct"] for r in got] == [c[2] for c in cases]
    assert got[0]["variant_json"] == '{"stem":"s","options":["x"],"answer":["b ","A"],"explanation":"e"}' and got[0]["user_answer_json"] == '["a","B","b"]'


def test_protected_changes(spark):
    schema = "id long, a string, b string, c string"
    before = spark.createDataFrame([(1, "x", None, "p"), (2, "x", "y", "p"), (3, "x", "y", "p"), (None, "x", "y", "p"), (5, "x", "y", "p")], schema)
    after = spark.createDataFrame([(1, "x", None, "q"), (2, None, "y", "p"), (3, "z", None, "p"), (None, "z", "y", "p"), (6, "z", "y", "p")], schema)
    got = versions.protected_changes(before, after, "id", ["a", "b"]).collect()
    assert {r["id"]: r["changed"] for r in got} == {2: ["a"], 3: ["a", "b"]}


def test_emptied(spark):
    tables = {"attempts": spark.range(3), "questions": spark.range(4)}
    got = versions.emptied(tables, ["attempts"])
    assert (got["attempts"].count(), got["questions"].count(), got["attempts"].columns) == (0, 4, ["id"])
    with pytest.raises(ValueError):
        versions.emptied(tables, ["attempt"])


def test_page_type_of_nulls_is_plain(spark):
    null = F.lit(None)
    kind = quality.page_type(null.cast("boolean"), null.cast("int"), null.cast("int"), null.cast("int"), null.cast("boolean"), null.cast("int"), null.cast("int"))
    assert spark.range(1).select(kind.alias("k")).first()["k"].asDict() == {"type": quality.PLAIN, "confidence": 0.6}
    unread = quality.unread_page_type(F.lit(0), F.lit(0), F.lit(True), F.lit("x"))
    assert spark.range(1).select(unread.alias("k")).first()["k"] == quality.BLANK


def test_evaluation_forms(spark):
    rows = spark.createDataFrame([("甲，乙 “a”　b。", "1，234 。5％"), (None, None), ("", "")], "t string, n string")
    got = rows.select(T.evaluation_text(F.col("t")).alias("t"), T.evaluation_number(F.col("n")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("甲乙ab", "1234.5%"), (None, None), ("", "")]


def test_sql_functions_are_inlined(spark):
    names = S.register(spark)
    assert names == S.register(spark)  # again: replaced
    df = spark.sql("SELECT quillon_error_rate('', '') AS a, quillon_error_rate('ab', 'ac') AS b, quillon_percent(1, 0) AS c, quillon_difficulty(NULL) AS d")
    assert tuple(df.first()) == (0.0, 0.5, 0.0, 2)
    assert "PythonUDF" not in df._jdf.queryExecution().toString()
