"""Queries over versioned stores: rollback, changes, commits of attempts, backups."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.plans.model import attempts, questions, table
from quillon.plans.registry import query
from quillon.sources import store as st
from quillon.sources import submission
from quillon.sources.store import Store
from quillon.storage import fresh_path

_ORDERED = "(SELECT l_partkey AS k, max(l_linenumber) AS m FROM lineitem GROUP BY 1) l"


def _versions(spark, sf) -> Store:
    """A library's questions, then those that were ever ordered, their difficulty the longest order's place."""
    s = Store(spark, fresh_path(spark, "vault"))
    first = questions(spark, sf).select("id", "stem", "tags", "difficulty")
    ordered = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_linenumber").cast("int").alias("difficulty"))
    s.commit({"questions": first}, keys={"questions": "id"}, n_parts=16)
    s.commit({"questions": first.drop("difficulty").join(ordered, "id")}, n_parts=16, reason="indexed again")
    return s


@query("vault_rollback", f"SELECT 2 AS version, q.id, q.stem, CAST(l.m AS INT) AS difficulty FROM questions q JOIN {_ORDERED} ON l.k = q.id UNION ALL SELECT 3, id, stem, difficulty FROM questions")
def vault_rollback(spark, sf):
    """The version before a rollback and the one that it made."""
    s = _versions(spark, sf)
    last = s.rollback(1)
    rows = [s.read("questions", n).select(F.lit(n).alias("version"), "id", "stem", "difficulty") for n in (last - 1, last)]
    return rows[0].unionByName(rows[1])


@query("vault_changes", f"SELECT q.id, CASE WHEN l.k IS NULL THEN 'removed' ELSE 'updated' END AS change FROM questions q LEFT JOIN {_ORDERED} ON l.k = q.id WHERE l.m IS DISTINCT FROM q.difficulty")
def vault_changes(spark, sf):
    """H01 over H03: what two versions differ in, from the parts that they don't share."""
    return _versions(spark, sf).changes("questions", 1, 2, "id")


@query("submitted_state", "SELECT * FROM review_state")
def submitted_state(spark, sf):
    """Every attempt, committed by weeks that come out of order, one of them twice."""
    s, rows = Store(spark, fresh_path(spark, "attempts")), attempts(spark, sf)
    week = F.floor((F.dayofmonth("created_at") - 1) / 8)
    for number, w in enumerate((2, 0, 3, 1)):
        submission.submit(s, rows.filter(week == w), number, n_parts=4)
    submission.submit(s, rows.filter(week == 3), 2)
    return submission.states(s).select("question_id", "wrong_count", "correct_streak", "mastered", "last_cause", "first_wrong_at", "last_attempt_at", "due_at", "completed_at")


@query("submitted_attempts", "SELECT question_id, count(*) AS attempts, count(*) FILTER (WHERE correct) AS correct, CAST(sum(greatest(0, duration_seconds)) AS BIGINT) AS seconds FROM attempts GROUP BY 1")
def submitted_attempts(spark, sf):
    """The other table of the same commits."""
    s, rows = Store(spark, fresh_path(spark, "attempts")), attempts(spark, sf)
    for number, wrong in enumerate((True, False, True)):
        submission.submit(s, rows.filter(F.col("wrong_cause").isNotNull() == wrong), min(number, 1), n_parts=4)
    return s.read("attempts").groupBy("question_id").agg(F.count("*").alias("attempts"), F.count_if("correct").alias("correct"), F.sum("duration_seconds").alias("seconds"))


@query("backup_restore", "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders")
def backup_restore(spark, sf):
    """Orders as a validated backup brings them back after a commit that lost most of them."""
    s, folder = Store(spark, fresh_path(spark, "orders")), fresh_path(spark, "backups")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    s.commit({"orders": rows}, keys={"orders": "o_orderkey"}, n_parts=8)
    name = st.back_up(s, folder)
    s.commit({"orders": rows.filter("o_orderstatus = 'P'")}, n_parts=8)
    st.restore(s, folder, name, needed=["orders"])
    return s.read("orders")
