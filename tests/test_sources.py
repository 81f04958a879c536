"""SQLite on executors; folders' limits and links."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from quillon.sources import readers, sqlite


def test_a_million_rows_in_several_tasks(spark, tmp_path):
    path = str(tmp_path / "d.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("create table q (id integer primary key, stem text, weight real, body blob, odd int)")
        db.executemany("insert into q values (?, ?, ?, ?, ?)", ((i * 2, f"s{i}", i / 2, b"x", "seven" if i % 100_000 == 0 else i) for i in range(1_000_000)))
        db.execute("create view v as select id, stem from q where id < 10")
        db.execute('create table "w ""x" (k text primary key, n numeric) without rowid')
        db.execute('insert into "w ""x" values (\'a\', 1.5), (\'b\', null)')
    t = sqlite.sqlite_table(spark, path, "q")
    assert t.rdd.getNumPartitions() == 20  # of 100,000 row numbers each
    got = t.withColumn("task", F.spark_partition_id()).agg(F.count("*"), F.sum("id"), F.sum("weight"), F.count("odd"), F.sum(F.length("body")), F.countDistinct("task")).first()
    assert tuple(got) == (1_000_000, 999_999_000_000, 249_999_750_000.0, 999_990, 1_000_000, 20)
    assert dict(t.dtypes) == {"id": "bigint", "stem": "string", "weight": "double", "body": "binary", "odd": "bigint"}
    some = sqlite.sqlite_table(spark, path, "q", columns=["stem"], where="id between 10 and 14", rows=1_000_000)
    assert some.columns == ["stem"] and sorted(r["stem"] for r in some.collect()) == ["s5", "s6", "s7"]
    assert sqlite.sqlite_table(spark, path, "v").count() == 5
    assert sorted(map(tuple, sqlite.sqlite_table(spark, path, 'w "x').collect())) == [("a", 1.5), ("b", None)]
    for bad in ({"table": "none"}, {"table": "q", "columns": ["nothing"]}):
        with pytest.raises(Exception, match="no "):
            sqlite.sqlite_table(spark, path, **bad).count()


def test_folders(spark, tmp_path):
    lib, other = tmp_path / "lib", tmp_path / "other"
    (lib / "a/b").mkdir(parents=True)
    (lib / "node_modules").mkdir()
    other.mkdir()
    for f in (lib / "x.md", lib / "a/y.md", lib / "a/b/z.md", lib / "node_modules/g.md", other / "o.md"):
        f.write_text("text of " + f.name)
    (lib / "big.md").write_text("b" * 1000)
    (lib / "linked").symlink_to(other)
    (lib / "l.md").symlink_to(other / "o.md")
    rows = {r["path"].rsplit("/", 1)[-1]: (r["left_out"], r["content"] is not None) for r in readers.listed(spark, str(lib), most_bytes=500, most_depth=2).collect()}
    assert {k: rows[k] for k in ("x.md", "y.md", "z.md", "g.md", "big.md")} == {"x.md": (None, True), "y.md": (None, True), "z.md": ("depth", False), "g.md": ("ignored", False), "big.md": ("size", False)}
    assert all(rows[k] == ("link", False) for k in ("l.md", "o.md") if k in rows)
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in readers.files(spark, str(lib), most_bytes=None, most_depth=None).collect()) == ["big.md", "x.md", "y.md", "z.md"]
