"""Every registered query with SQL agrees with DuckDB on small tables, whatever the order of rows."""

import math

import duckdb
import pytest

import __spark_entry__
from quillon.api import Library
from quillon.plans import all_queries, model

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(all_queries.QUERIES))
def test_query(spark, db, name):
    df = all_queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name in all_queries.SQL:
        out = db.execute(all_queries.SQL[name])
        names = [d[0] for d in out.description]
        assert sorted(names) == columns
        assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in out.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_facade(spark):
    lib = Library(model.questions(spark, SF), model.attempts(spark, SF), model.favorites(spark, SF), model.notes(spark, SF), model.memberships(spark, SF), model.AS_OF)
    for df in (lib.search("ring", subject="a"), lib.due(), lib.wrong_book(), lib.favorite_book(), lib.note_book(), lib.facets(), lib.papers(2), lib.paper(1), lib.similar(3), lib.today(), lib.streak(), lib.activity(), lib.totals(7), lib.causes(), lib.weaknesses(), lib.strengths()):
        df.collect()
    assert lib.select(5).count() == 5 and lib.select(5, "random", "s").count() == 5
    assert [r["id"] for r in lib.select(0, ids=[3, 1]).collect()] == [3, 1]
