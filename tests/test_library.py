import sqlite3

import pytest
from pyspark.sql import functions as F

from quillon.operators import graph, layout, practice, versions
from quillon.sources import readers, sinks
from quillon.streaming import review

MD = '---\nid: q1\nsubject: "math"\nanswer: AC\ntags: [a, b]\ndifficulty: 9\nyear: 2021\n---\n# Title\n\nWhat is it?\n\nA. one\nＢ、two\nC: three\n\n## 解析\nBecause.\n'


def test_markdown_round_trip(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/q.md").write_text(MD)
    (tmp_path / "note.md").write_text("# Note\n\nplain text")
    (tmp_path / "x.bin").write_text("no")
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in readers.parse_markdown(readers.files(spark, str(tmp_path))).collect()}
    q = rows["q.md"]
    assert set(rows) == {"q.md", "note.md"} and not rows["note.md"]["is_question"] and rows["note.md"]["title"] == "Note"
    assert q["is_question"] and q["id"] == "q1" and q["answer"] == ["A", "C"] and [o["key"] for o in q["options"]] == ["A", "B", "C"]
    assert q["difficulty"] == 5 and q["year"] == 2021 and q["explanation"] == "Because." and q["tags"] == ["a", "b"]
    text = readers.parse_markdown(readers.files(spark, str(tmp_path))).filter("is_question").select(sinks.question_markdown().alias("t")).first()["t"]
    again = readers.parsed_file("p", text)
    assert again["answer"] == ["A", "C"] and again["id"] == "q1" and [o["text"] for o in again["options"]] == ["one", "two", "three"]
    listing = readers.eligible(readers.files(spark, str(tmp_path), "*").drop("content")).select("path", "eligible", "reason").collect()
    assert {r["path"].rsplit(".", 1)[-1]: r["eligible"] for r in listing} == {"md": True, "bin": False}


def test_other_readers(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.json").write_text('{"title": "P", "year": 2020, "questions": [{"id": "1", "stem": "s"}, {"id": "2", "stem": "t"}]}')
    (tmp_path / "p/b.json").write_text("{broken")
    assert [(r["paper"], r["place"], r["id"]) for r in readers.json_papers(spark, str(tmp_path / "p")).orderBy("place").collect()] == [("P", 1, "1"), ("P", 2, "2")]
    with sqlite3.connect(tmp_path / "d.sqlite") as db:
        db.execute("create table q (id int, stem text)")
        db.executemany("insert into q values (?, ?)", [(i, f"s{i}") for i in range(5)])
    assert readers.sqlite_table(spark, str(tmp_path / "d.sqlite"), "q").count() == 5
    tree = spark.createDataFrame([('[{"name": "m", "groups": [{"name": "g", "topics": [{"code": "1", "name": "t"}]}]}]',)], "json string")
    assert [tuple(r) for r in readers.taxonomy(tree).collect()] == [("1", "m-g-t")]
    lines = spark.createDataFrame([('{"state":"running","page":9,"total":5,"confidence":3}',), ("oops",), ('{"state":"odd"}',)], "line string")
    assert [tuple(r) for r in readers.worker_events(lines).collect()] == [("running", 5, 5, 1.0)]


def brute(rows):
    s = (0, 0, False, None, None, None, None, None)
    for us, correct, cause, fb in rows:
        s = review.step(s, us, correct, cause, fb)
    return s


def test_batch_fold_equals_stepwise_fold(spark, rng=None):
    import random
    from datetime import datetime, timedelta

    r = random.Random(4)
    base, data, per = datetime(2024, 1, 1), [], {}
    for i in range(1500):
        q, us = r.randrange(120), r.randrange(10**12)
        row = (r.random() < 0.6, r.choice([None, "", " ", "slip", "gap"]), r.choice(["normal", "easy", "hard", "forgot"]))
        data.append((i, q, base + timedelta(microseconds=us), *row))
        per.setdefault(q, []).append((base + timedelta(microseconds=us), i, row))
    df = spark.createDataFrame(data, "id long, question_id long, created_at timestamp_ntz, correct boolean, wrong_cause string, feedback string")
    got = {x["question_id"]: x for x in practice.review_state(df).collect()}
    epoch = datetime(1970, 1, 1)
    us = lambda t: None if t is None else round((t - epoch).total_seconds() * 1e6)
    for q, rows in per.items():
        s = brute([(us(t), *row) for t, _, row in sorted(rows, key=lambda x: x[:2])])
        if not s[0]:
            assert q not in got
            continue
        g = got[q]
        assert (g["wrong_count"], g["correct_streak"], g["mastered"], g["last_cause"], us(g["first_wrong_at"]), us(g["last_attempt_at"]), us(g["due_at"]), us(g["completed_at"])) == s


def test_streams(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    rows = [(1, 5, False, "slip", "2024-01-01 00:00:00"), (2, 5, True, None, "2024-01-02 00:00:00"), (3, 6, True, None, "2024-01-02 00:00:00"), (4, 5, True, None, "2024-01-03 00:00:00")]
    schema = "id long, question_id long, correct boolean, wrong_cause string, created_at timestamp_ntz"
    df = spark.createDataFrame(rows, "id long, question_id long, correct boolean, wrong_cause string, t string").withColumn("created_at", F.col("t").cast("timestamp_ntz")).drop("t")
    df.filter("id < 3").coalesce(1).write.parquet(f"{src}/a")
    df.filter("id >= 3").coalesce(1).write.parquet(f"{src}/b")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    review.review_stream(stream).writeStream.outputMode("update").foreachBatch(review.keep_latest(str(out), "question_id", "last_attempt_at")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(out)).orderBy(F.desc("last_attempt_at")).first()
    want = practice.review_state(df).first()
    assert {k: got[k] for k in want.asDict()} == want.asDict() and want["mastered"]
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib/q.md").write_text(MD)
    seen = []
    review.watch(spark, str(tmp_path / "lib"), lambda b, n: seen.extend(r["id"] for r in readers.parse_markdown(b).collect()), str(tmp_path / "c2"), every=None).awaitTermination()
    assert seen == ["q1"]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (4, 4), (None, 1), *[(100, 100 + i) for i in range(1, 50)], *[(200 + i, 201 + i) for i in range(40)]], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, **{100 + i: 100 for i in range(50)}, **{200 + i: 200 for i in range(41)}}
    assert graph.connected_components(edges.limit(0)).count() == 0


def test_versions_and_packing(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "id long, content_hash string, v string")
    new = spark.createDataFrame([(1, "a", "X"), (2, "B", "Y"), (4, "d", "W")], "id long, content_hash string, v string")
    assert {tuple(r) for r in versions.diff(old, new).collect()} == {(1, "same"), (2, "updated"), (3, "removed"), (4, "added")}
    assert {tuple(r) for r in versions.replaced(old, new).collect()} == {(1, "a", "x"), (2, "B", "Y"), (4, "d", "W")}
    units = spark.createDataFrame([(0, [1, 2, 3, 4, 5, 6, 7, 8, 9], 9), *[(i, [10 * i, 10 * i + 1], 2) for i in range(1, 12)], (20, [999], 1), (21, [1000], 1)], "position int, ids array<long>, size int")
    assert [r["id"] for r in practice.packed_units(units, 10).orderBy("place").collect()] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 999]
    assert [r["id"] for r in practice.packed_units(units, 4).orderBy("place").collect()] == [1, 2, 3, 4]
    sinks.package({"old": old, "new": new}, str(tmp_path / "p"))
    assert readers and set(sinks.read_package(spark, str(tmp_path / "p"))) == {"old", "new"}
    old.limit(1).write.mode("overwrite").parquet(str(tmp_path / "p/old"))
    with pytest.raises(ValueError):
        sinks.read_package(spark, str(tmp_path / "p"))


def test_layout(spark):
    rows = [(1, 1, 0, "text", [0.0, 0.0, 0.4, 0.1], "", "1. left"), (1, 1, 1, "text", [0.6, 0.0, 1.0, 0.1], "", "right"), (1, 1, 2, "text", [0.0, 0.2, 0.4, 0.3], "", "left two"), (1, 1, 3, "image", [0.6, 0.2, 0.9, 0.5], "i.png", ""), (1, 1, 4, "image", [0.61, 0.2, 0.9, 0.5], "j.png", "")]
    regions = spark.createDataFrame(rows, "doc long, page int, region_no int, type string, bbox array<double>, img_path string, text string")
    assert [r["region_no"] for r in layout.reading_order(regions).orderBy("place").collect()] == [0, 2, 1, 3, 4]
    assert [r["region_no"] for r in layout.merged_figures(regions).collect()] == [3]
    assert layout.page_questions(regions).select("num", "images", "confidence").first() == (1, ["i.png", "j.png"], "medium")
    labels = spark.createDataFrame([(1, 1, 0, "text", [0.0, 0.0, 10.0, 10.0], "", "A"), (1, 1, 1, "text", [100.0, 0.0, 110.0, 10.0], "", "B"), (1, 1, 2, "image", [0.0, 20.0, 50.0, 60.0], "a", ""), (1, 1, 3, "image", [90.0, 20.0, 150.0, 60.0], "b", "")], regions.schema)
    assert {(r["key"], r["img_path"]) for r in layout.bound_options(labels).collect()} == {("A", "a"), ("B", "b")}
    cells = spark.createDataFrame([(1, 1, 0.0, 1.0, "a"), (1, 1, 9.0, 2.0, "b"), (1, 1, 0.0, 22.0, "c")], "doc long, page int, x double, y double, text string")
    assert [r["cells"] for r in layout.table_of_cells(cells).orderBy("row").collect()] == [["a", "b"], ["c", ""]]
    pages = layout.from_manifest(spark.createDataFrame([(1, '{"pages":[{"pageNumber":1,"lines":["x","y"]},{"pageNumber":0,"lines":["q"]},{"pageNumber":2,"lines":["z"]}]}'), (2, "bad")], "doc long, manifest string"))
    lines = spark.createDataFrame([(1, 0, "x"), (1, 1, " "), (1, 2, "y"), (1, 3, "z")], "doc long, line_no int, line string")
    assert [r["page"] for r in layout.line_pages(lines, pages).orderBy("line_no").collect()] == [1, None, 1, 2]
    nums = spark.createDataFrame([(1, i, n) for i, n in enumerate([1, 2, 3, 1, 2, 2])], "doc long, place int, num int")
    assert [r["segment"] for r in layout.segments(nums).orderBy("place").collect()] == [0, 0, 0, 1, 1, 2]


def test_a_folder_s_changes(spark, tmp_path):
    lib, state, seen = tmp_path / "lib", str(tmp_path / "state"), []
    lib.mkdir()
    (lib / "a.md").write_text("one")
    (lib / "b.md").write_text("two")
    look = lambda: review.poll(spark, str(lib), lambda c, n: seen.append((n, sorted((r["path"].rsplit("/")[-1], r["status"]) for r in c.collect()))), state)
    assert look() and not look()
    (lib / "a.md").write_text("one more")
    (lib / "b.md").unlink()
    (lib / "c.md").write_text("three")

    def broken(changes, number):
        raise OSError

    with pytest.raises(OSError):
        review.poll(spark, str(lib), broken, state)
    assert look() and not look()
    assert seen == [(0, [("a.md", "added"), ("b.md", "added")]), (1, [("a.md", "changed"), ("b.md", "deleted"), ("c.md", "added")])]


def test_latest_row_of_each_key(spark, tmp_path):
    put = review.keep_latest(str(tmp_path / "t"), "k", "at")
    rows = lambda *r: spark.createDataFrame(r, "k int, at int, v string")
    put(rows((1, 1, "a"), (1, 3, "b"), (2, 5, "c")), 0)
    put(rows((1, 2, "d"), (2, 5, "e")), 1)
    put(rows((1, 2, "d"), (2, 5, "e")), 1)
    assert sorted(map(tuple, review.latest(spark, str(tmp_path / "t"), "k", "at").collect())) == [(1, 3, "b"), (2, 5, "e")]


def test_sqlite_table_without_rows(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "e.sqlite") as db:
        db.execute("CREATE TABLE q (id INTEGER, stem TEXT)")
    got = readers.sqlite_table(spark, str(tmp_path / "e.sqlite"), "q")
    assert got.columns == ["id", "stem"] and got.count() == 0
