"""A library's requests, from indexing to backups, over one store."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillon.plans import model
from quillon.workbench import Workbench

SF = "/root/testdata/sf0.001"
AT = datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def bench(spark, tmp_path):
    w = Workbench(spark, str(tmp_path / "w"))
    questions = spark.createDataFrame([(i, f"stem number {i}", "abc"[i % 3], "s", ["A"], ["t"], 2000 + i, "p", f"h{i}") for i in range(9)], "id long, stem string, category string, subject string, answer array<string>, tags array<string>, year int, paper string, content_hash string")
    assert w.index(questions) == {"added": 9, "updated": 0, "removed": 0}
    return w


def test_content_and_snapshots(spark, bench):
    new = bench.read("questions").filter("id <> 3").withColumn("content_hash", F.when(F.col("id") == 4, "x").otherwise(F.col("content_hash")))
    assert bench.index(new) == {"added": 0, "updated": 1, "removed": 1}
    assert [(n, q) for n, _, _, q in bench.snapshots()] == [(2, 8), (1, 9)]
    bench.set_favorites(spark.createDataFrame([(1, True, AT)], "question_id long, favorite boolean, created_at timestamp_ntz"))
    bench.rollback_content(1)
    assert bench.read("questions").count() == 9 and bench.read("favorites").count() == 1
    assert bench.index(new, keep=1)["removed"] == 1 and len(bench.snapshots()) == 1


def test_practice(spark, bench):
    attempt = "id long, question_id long, answer array<string>, created_at timestamp_ntz, wrong_cause string"
    batch = spark.createDataFrame([(1, 0, ["a "], AT, None), (2, 1, ["B"], AT, "slip"), (3, 77, ["A"], AT, None)], attempt)
    assert bench.submit(batch, 0) and bench.submit(batch, 0) is None
    bench.set_causes(spark.createDataFrame([(1, " gap "), (0, "no")], "question_id long, cause string"))
    lib = bench.library("2024-01-05 00:00:00")
    assert (lib.totals().first()["attempts"], lib.totals().first()["correct"]) == (2, 1)
    assert [(r["question_id"], r["last_cause"]) for r in bench.store.read("review_state").filter("wrong_count > 0").collect()] == [(1, "gap")]
    fav = "question_id long, favorite boolean, created_at timestamp_ntz"
    bench.set_favorites(spark.createDataFrame([(1, True, AT), (2, True, AT), (2, False, AT + timedelta(1))], fav))
    bench.set_favorites(spark.createDataFrame([(3, True, AT)], fav))
    assert [r[0] for r in rows(bench.read("favorites"))] == [1, 3]
    note = "question_id long, content string, updated_at timestamp_ntz"
    bench.save_notes(spark.createDataFrame([(1, "one", AT), (2, "x" * 200_001, AT)], note))
    bench.save_notes(spark.createDataFrame([(1, " ", AT)], note))
    assert [(r["question_id"], len(r["content"])) for r in bench.read("notes").collect()] == [(2, 200_000)]
    assert bench.library("2024-01-05 00:00:00").favorite_book().count() == 2
    with pytest.raises(ValueError):
        bench.reset("yes")
    bench.reset("RESET")
    assert bench.read("notes").count() == 0 and bench.store.read("attempts").count() == 0 and bench.read("questions").count() == 9


def test_sessions_exams_and_plans(spark, bench):
    session = "id long, kind string, ids array<long>, started_at timestamp_ntz"
    bench.start_sessions(spark.createDataFrame([(1, "practice", [1, 2], AT), (2, "review", [3], AT)], session))
    bench.start_sessions(spark.createDataFrame([(3, "practice", [4, 5], AT + timedelta(1))], session))
    bench.update_sessions(spark.createDataFrame([(3, 9, [5, 6], None), (1, 1, None, "completed"), (2, None, None, "completed")], "id long, index int, uncertain array<long>, status string"))
    assert {r["id"]: (r["index"], r["uncertain"], r["status"]) for r in bench.read("sessions").collect()} == {1: (0, [], "abandoned"), 2: (0, [], "completed"), 3: (1, [5], "active")}
    bench.create_exam(1, spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "id long, place int"))
    answer = "exam_id long, question_id long, answer array<string>, seconds int"
    bench.save_answers(spark.createDataFrame([(1, 0, ["B"], 5), (1, 1, ["A"], 7), (9, 1, ["A"], 1)], answer))
    bench.save_answers(spark.createDataFrame([(1, 0, ["A"], 9)], answer))
    assert bench.finish_exam(1, "2024-01-02 00:00:00", 0) and bench.finish_exam(1, "2024-01-02 00:00:00", 0) is None
    bench.save_answers(spark.createDataFrame([(1, 2, ["A"], 1)], answer))  # too late
    lib = bench.library("2024-01-05 00:00:00")
    assert [tuple(r) for r in lib.exam_scores().collect()] == [(1, 3, 2, 66.7)]
    assert sum(r["seconds"] for r in lib.exam_breakdown(1).collect()) == 16
    assert [(r["question_id"], r["wrong_count"]) for r in lib.reviews().collect()] == [(2, 1)]
    plan = lib.plan(2, 30)
    bench.apply_plan(1, plan)
    bench.apply_plan(2, plan)
    assert {r["status"] for r in bench.read("plans").filter("plan_id = 1").collect()} == {"cancelled"}
    items = bench.plan_items().collect()
    assert len(items) == 6 and not any(r["done"] for r in items)
    done = "plan_id long, item_id long, completed int"
    bench.complete_items(spark.createDataFrame([(2, items[0]["item_id"], 10_000)], done))
    first = bench.plan_items().filter(F.col("item_id") == items[0]["item_id"]).first()
    assert first["done"] and first["completed"] == first["target"]
    bench.complete_items(spark.createDataFrame([(2, r["item_id"], r["target"]) for r in items], done))
    assert {r["status"] for r in bench.read("plans").filter("plan_id = 2").collect()} == {"completed"}


def test_settings_and_backups(spark, bench, tmp_path):
    assert bench.settings().first()["dailyTarget"] == 30
    bench.save_settings('{"dailyTarget": 9000, "examGoalName": " x "}')
    bench.save_settings('{"uiScale": 90}')
    s = bench.settings().first()
    assert (s["dailyTarget"], s["uiScale"], s["examGoalName"]) == (500, 90, "x")
    name = bench.back_up(str(tmp_path / "b"))
    bench.save_settings('{"uiScale": 120}')
    bench.restore(str(tmp_path / "b"), name)
    assert bench.settings().first()["uiScale"] == 90
    bench.back_up(str(tmp_path / "b"), keep=1)
    assert len(bench.backups(str(tmp_path / "b"))) == 1


def test_analytical_requests(spark):
    from quillon.api import Library

    q, a = model.questions(spark, SF), model.attempts(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    exams = spark.createDataFrame([(1, 0, "c", ["A"], ["A"], 3)], "exam_id long, place int, category string, answer array<string>, key array<string>, seconds int")
    essays = spark.createDataFrame([(1, '{"score": 7}', AT), (2, '{"score": 9}', AT + timedelta(1))], "prompt_id long, evaluation string, created_at timestamp_ntz")
    talks = spark.createDataFrame([(1, AT, "m"), (2, AT + timedelta(1), "n")], "conv_id long, updated_at timestamp_ntz, messages string")
    lib = Library(q, a, model.favorites(spark, SF), model.notes(spark, SF), model.memberships(spark, SF), model.AS_OF, documents=docs, exams=exams, essays=essays, conversations=talks)
    assert lib.find("ring").count() > 0 and lib.find_documents("license", lang="en").count() <= docs.count()
    assert [r["id"] for r in lib.get([5, 3]).collect()] == [5, 3] and lib.user_metadata([3, 5]).count() == 2
    assert lib.categories("a").count() > 1 and lib.by_category(7).count() > 1 and lib.by_day(30).count() > 20 and lib.weakest().count() == 1
    assert lib.recent(4).count() == 4 and lib.advice().count() >= 1 and lib.plan(3).count() == 9
    assert rows(lib.session(8)) == rows(a.filter("session_id = 8"))
    assert [tuple(r) for r in lib.exam_history().collect()] == [(1, 1, 1, 100.0)]
    assert lib.essay_summary().first()["essays"] == 2 and [r["prompt_id"] for r in lib.essay_history(limit=1).collect()] == [2]
    assert [r["conv_id"] for r in lib.recent_conversations().collect()] == [2, 1]
    assert len({r["id"] for r in lib.select(5, "adaptive").collect()}) == 5
    with pytest.raises(ValueError):
        lib.select(5, "odd")
    with pytest.raises(ValueError, match="documents"):
        Library(q, a, a, a, a, model.AS_OF).find("x")
