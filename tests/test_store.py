"""Versions, rollback, commits of several tables, late attempts, backups."""

import random
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillon.operators import practice, versions
from quillon.sources import store as st
from quillon.sources import submission
from quillon.sources.store import Store


def rows(df):
    return sorted(map(str, df.collect()))


def table(spark, *values):
    return spark.createDataFrame(list(values), "id long, stem string, tags array<string>")


def test_versions_rollback_and_sharing(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.version() is None and s.versions() == []
    first = spark.range(200).select("id", F.col("id").cast("string").alias("stem"), F.array(F.lit("a"), F.lit(None).cast("string")).alias("tags"))
    second = first.filter("id <> 7").withColumn("stem", F.when(F.col("id") == 9, F.lit("nine")).otherwise(F.col("stem"))).unionByName(table(spark, (500, None, None)))
    assert s.commit({"questions": first, "documents": first.limit(0)}, keys={"questions": "id"}, n_parts=16) == 1
    assert s.commit({"questions": second}, n_parts=16) == 2
    assert rows(s.read("questions")) == rows(second) and rows(s.read("questions", 1)) == rows(first) and s.read("documents").count() == 0
    assert {tuple(r) for r in s.changes("questions", 1, 2, "id").collect()} == {(7, "removed"), (9, "updated"), (500, "added")}
    a, b = ({p.path for p in s.version(n).tables["questions"].parts} for n in (1, 2))
    assert len(a & b) >= 13 and len(a) == 16  # three rows changed at most three parts
    assert s.rollback(1) == 3 and rows(s.read("questions")) == rows(first)
    assert s.version().reason == "rollback" and s.version().of == 1 and {p.path for p in s.version().tables["questions"].parts} == a
    assert s.rollback(2) == 4 and rows(s.read("questions")) == rows(second)  # a rollback can be taken back
    with pytest.raises(LookupError):
        s.rollback(99)
    with pytest.raises(KeyError):
        s.read("nothing")
    assert s.prune(2, grace_seconds=0) == [1, 2] and s.numbers() == [3, 4]
    assert rows(s.read("questions", 3)) == rows(first) and rows(s.read("questions")) == rows(second)
    with pytest.raises(LookupError):
        s.rollback(1)
    s.prune(0, grace_seconds=0)
    assert s.numbers() == [4] and rows(s.read("questions")) == rows(second) and s.damaged() == []
    held = {p.path.split("/")[1] for p in s.version().tables["questions"].parts}
    assert {f.name for f in (tmp_path / "s/parts/questions").iterdir()} - {".", ".."} == held


def test_what_breaks_off_leaves_the_old_version(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "s"))
    s.commit({"q": table(spark, (1, "a", None)), "r": table(spark, (1, "x", None))})
    broken = spark.range(4).select("id", F.when(F.col("id") == 3, F.raise_error(F.lit("killed"))).otherwise("b").alias("stem"), F.lit(None).cast("array<string>").alias("tags"))
    with pytest.raises(Exception, match="killed"):
        s.commit({"q": table(spark, (2, "b", None)), "r": broken})
    assert s.numbers() == [1] and rows(s.read("q")) == rows(table(spark, (1, "a", None)))
    monkeypatch.setattr(st, "write_text", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        s.commit({"q": table(spark, (2, "b", None))})
    monkeypatch.undo()
    assert s.numbers() == [1] and s.commit({"q": table(spark, (2, "b", None))}) == 2
    # Of two writers that start from one version, one wins.
    base = s.version()
    s.commit({"q": table(spark, (3, "c", None))})
    with pytest.raises(st.Conflict):
        s._publish(base, base.tables, "commit", {})
    assert rows(s.read("q")) == rows(table(spark, (3, "c", None)))


def test_contents_are_told_apart(spark, tmp_path):
    def sum_of(df):
        return tuple(st.checksums(df).first())

    different = [[(1, "a", None)], [(1, None, ["a"])], [(1, None, [None, "a"])], [(1, None, ["a", None])], [(1, None, ["a"]), (1, None, ["a"])], [(1, "", ["a"])], []]
    assert len({sum_of(table(spark, *d)) for d in different}) == len(different)
    assert sum_of(table(spark, (1, "a", None), (2, "b", None))) == sum_of(table(spark, (2, "b", None), (1, "a", None)))
    s = Store(spark, str(tmp_path / "s"))
    s.commit(append={"q": table(spark, (1, "a", None))})
    s.commit(append={"q": table(spark, (1, "a", None))})
    s.commit(append={"q": table(spark)})
    assert s.read("q").count() == 2 and len(s.version().tables["q"].parts) == 2
    with pytest.raises(ValueError):
        s.commit(append={"q": spark.range(2)})
    s.compact("q", 4)
    assert s.read("q").count() == 2 and len(s.version().tables["q"].parts) == 1
    old, new = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id long, content_hash string"), spark.createDataFrame([(1, None), (2, "y"), (4, None)], "id long, content_hash string")
    assert {tuple(r) for r in versions.diff(old, new).collect()} == {(1, "same"), (2, "updated"), (3, "removed"), (4, "added")}


def _attempts(n, seed):
    r = random.Random(seed)
    base = datetime(2024, 1, 1)
    # One question has a third of all attempts; some attempts share an instant.
    return [(i, 0 if r.random() < 0.3 else r.randrange(25), base + timedelta(minutes=r.randrange(3000)), r.random() < 0.6, r.choice([None, " ", "slip", "gap"]), r.choice([None, "normal", "easy", "hard", "forgot"])) for i in range(n)]


_SCHEMA = "id long, question_id long, created_at timestamp_ntz, correct boolean, wrong_cause string, feedback string"


@pytest.mark.parametrize("late", [False, True])
def test_any_order_of_batches_gives_the_batch_result(spark, tmp_path, late):
    data = _attempts(400, 3 + late)
    data.sort(key=lambda x: (x[2], x[0]))
    batches = [data[i : i + 100] for i in range(0, 400, 100)]
    if late:
        random.Random(1).shuffle(batches)
    s = Store(spark, str(tmp_path / "s"))
    for number, batch in enumerate(batches):
        assert submission.submit(s, spark.createDataFrame(batch, _SCHEMA), number) == number + 1
        assert submission.submit(s, spark.createDataFrame(batch, _SCHEMA), number) is None  # it comes again
    want = practice.review_state(spark.createDataFrame(data, _SCHEMA))
    assert rows(submission.states(s).select(want.columns)) == rows(want)
    assert s.read("attempts").count() == 400


def test_both_tables_or_neither(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "s"))
    one, two = (spark.createDataFrame(_attempts(30, k), _SCHEMA) for k in (1, 2))
    submission.submit(s, one, 0)
    before = rows(s.read("review_state"))
    appended = Store._appended
    monkeypatch.setattr(Store, "_appended", lambda *a: (_ for _ in ()).throw(OSError("killed between the tables")))
    with pytest.raises(OSError):
        submission.submit(s, two, 1)
    assert rows(s.read("review_state")) == before and s.read("attempts").count() == 30 and s.mark("attempts") == 0
    monkeypatch.setattr(Store, "_appended", appended)
    assert submission.submit(s, two, 1) == 2 and s.read("attempts").count() == 60 and rows(s.read("review_state")) != before


def test_grading_and_questions_that_are_gone(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    questions = spark.createDataFrame([(1, ["A", "c"]), (2, ["B"])], "id long, answer array<string>")
    at = datetime(2024, 1, 1)
    given = [(1, 1, [" C", "a", "A"], at, -5), (2, 2, ["A"], at, 7), (3, 9, ["A"], at, 1), (4, None, ["A"], at, 1), (5, 2, None, at + timedelta(1), 1)]
    batch = spark.createDataFrame(given, "id long, question_id long, answer array<string>, created_at timestamp_ntz, duration_seconds int")
    submission.submit(s, batch, 0, questions)
    kept = {r["id"]: r for r in s.read("attempts").collect()}
    assert [(kept[i]["correct"], kept[i]["counted"]) for i in (1, 2, 5)] == [(True, True), (False, True), (False, True)]
    assert not kept[3]["counted"] and not kept[4]["counted"] and kept[1]["duration_seconds"] == 0
    assert [(r["question_id"], r["wrong_count"]) for r in submission.states(s).collect()] == [(2, 2)]
    assert s.read("review_state").count() == 2


def test_submitting_a_stream(spark, tmp_path):
    src, data = tmp_path / "src", _attempts(120, 9)
    for i in range(0, 120, 40):
        spark.createDataFrame(data[i : i + 40], _SCHEMA).coalesce(1).write.parquet(f"{src}/b{i:03d}")
    s = Store(spark, str(tmp_path / "s"))
    for _ in range(2):  # the second run starts anew without the first one's checkpoint: every batch comes again
        stream = spark.readStream.schema(_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
        stream.writeStream.foreachBatch(submission.submitter(s)).option("checkpointLocation", str(tmp_path / f"c{_}")).trigger(availableNow=True).start().awaitTermination()
    want = practice.review_state(spark.createDataFrame(data, _SCHEMA))
    assert rows(submission.states(s).select(want.columns)) == rows(want) and s.read("attempts").count() == 120 and len(s.numbers()) == 3


def test_backups(spark, tmp_path):
    s, folder = Store(spark, str(tmp_path / "s")), str(tmp_path / "b")
    with pytest.raises(ValueError):
        st.back_up(s, folder)
    one = table(spark, *[(i, str(i), ["t"]) for i in range(50)])
    s.commit({"q": one, "settings": table(spark, (1, "x", None))}, keys={"q": "id"}, n_parts=4)
    name = st.back_up(s, folder)
    (tmp_path / "b/_pending-x").mkdir()  # one that broke off
    assert [(b.name, b.reason, b.rows) for b in st.backups(spark, folder)] == [(name, "manual", 51)] and st.backups(spark, folder)[0].bytes > 0
    s.commit({"q": one.limit(3), "more": one}, n_parts=4)
    st.validate(spark, folder, name, ["q", "settings"])
    with pytest.raises(ValueError, match="no "):
        st.validate(spark, folder, name, ["other"])
    with pytest.raises(ValueError, match="no backup"):
        st.restore(s, folder, "../s")
    st.restore(s, folder, name)
    assert rows(s.read("q")) == rows(one) and "more" not in s.version().tables
    kinds = [b.reason for b in st.backups(spark, folder)]
    assert kinds == ["pre-restore", "manual"]
    st.restore(s, folder, st.backups(spark, folder)[0].name)  # back to before the restore
    assert s.read("q").count() == 3 and s.read("more").count() == 50
    # A damaged backup is not restored, and the store stays as it is.
    part = next(p for p in (tmp_path / "b" / name / "parts/q").iterdir())
    other = next(p for p in (tmp_path / "b" / name / "parts/q").iterdir() if p != part)
    shutil.rmtree(part)
    shutil.copytree(other, part)
    version = s.version().number
    with pytest.raises(ValueError, match="damaged"):
        st.restore(s, folder, name)
    assert s.version().number == version
    assert len(st.prune_backups(spark, folder, 2)) == 1 and len(st.backups(spark, folder)) == 2
    assert len(st.prune_backups(spark, folder, 0)) == 1 and len(st.backups(spark, folder)) == 1
