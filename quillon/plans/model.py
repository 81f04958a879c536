"""The logical tables of a practice library, defined over the driver's tables, in Spark and in SQL.

Times are taken as UTC instants. Everything that depends on the present takes ``AS_OF``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
TIME_ZONE = "Asia/Shanghai"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each practice attempt."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.get_json_object("props", "$.k").cast("long").alias("question_id"),
        "user_id",
        F.col("event_type").isin("click", "purchase", "signup").alias("correct"),
        F.when(F.col("event_type") == "error", F.lit("error")).alias("wrong_cause"),
        F.round("value").cast("int").alias("duration_seconds"),
        F.col("event_type").alias("mode"),
        F.col("user_id").alias("session_id"),
        F.col("ts").alias("created_at"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question dimension."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_type").alias("category"),
        F.when(F.col("p_size") <= 25, "a").otherwise("b").alias("subject"),
        (1 + F.col("p_size") % 5).cast("int").alias("difficulty"),
        F.split("p_name", " ").alias("tags"),
        F.col("p_name").alias("stem"),
        F.col("p_brand").alias("paper"),
        (2000 + F.col("p_partkey") % 25).cast("int").alias("year"),
        (F.col("p_partkey") % 10 == 0).alias("in_group"),
        (F.col("p_partkey") / 7).cast("long").alias("family"),
    )


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which questions a paper has, and in what place."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("question_id"))


def favorites(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir).filter("mode = 'purchase'")
    return a.groupBy("question_id").agg(F.max("created_at").alias("created_at"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir).filter("mode = 'error'").groupBy("question_id").agg(F.count("*").alias("n"), F.max("created_at").alias("updated_at"))
    return a.select("question_id", F.when(F.col("question_id") % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit("seen "), F.col("n").cast("string"))).alias("content"), "updated_at")


def exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of exam sessions: an order is a session, a line is an item; a line with flag N wasn't answered."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("exam_id"),
        F.col("l_linenumber").alias("place"),
        F.col("l_partkey").alias("question_id"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("answer"),
        F.when(F.col("l_partkey") % 2 == 0, "A").otherwise("R").alias("key"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity").cast("int")).otherwise(0).alias("seconds"),
    )


#: The same tables for the oracle.
TABLES: dict[str, str] = {
    "attempts": """SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS question_id, user_id,
        event_type IN ('click', 'purchase', 'signup') AS correct, CASE WHEN event_type = 'error' THEN 'error' END AS wrong_cause,
        CAST(round(value) AS INT) AS duration_seconds, event_type AS mode, user_id AS session_id, ts AS created_at FROM events""",
    "questions": """SELECT p_partkey AS id, p_type AS category, CASE WHEN p_size <= 25 THEN 'a' ELSE 'b' END AS subject,
        CAST(1 + p_size % 5 AS INT) AS difficulty, string_split(p_name, ' ') AS tags, p_name AS stem, p_brand AS paper,
        CAST(2000 + p_partkey % 25 AS INT) AS year, p_partkey % 10 = 0 AS in_group, p_partkey // 7 AS family FROM part""",
    "memberships": "SELECT l_orderkey AS paper, l_linenumber AS place, l_partkey AS question_id FROM lineitem",
    "favorites": "SELECT question_id, max(created_at) AS created_at FROM attempts WHERE mode = 'purchase' GROUP BY 1",
    "notes": """SELECT question_id, CASE WHEN question_id % 4 = 0 THEN '  ' ELSE concat('seen ', CAST(count(*) AS VARCHAR)) END AS content,
        max(created_at) AS updated_at FROM attempts WHERE mode = 'error' GROUP BY question_id""",
    "exams": """SELECT l_orderkey AS exam_id, l_linenumber AS place, l_partkey AS question_id, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS answer,
        CASE WHEN l_partkey % 2 = 0 THEN 'A' ELSE 'R' END AS key, CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS INT) ELSE 0 END AS seconds FROM lineitem""",
    "reviews": """SELECT a.question_id, count(*) FILTER (WHERE NOT correct) AS wrong_count,
        CAST(count(*) FILTER (WHERE correct AND (created_at, id) > (lw, li)) AS BIGINT) AS correct_streak,
        min(created_at) FILTER (WHERE NOT correct) AS first_wrong_at, max(created_at) AS last_attempt_at, any_value(lc) AS last_cause,
        min(created_at) FILTER (WHERE correct AND (created_at, id) > (lw, li)) AS first_right_at, any_value(lw) AS last_wrong_at
        FROM attempts a JOIN (SELECT question_id, max((created_at, id)) AS w, w[1] AS lw, w[2] AS li,
        arg_max(wrong_cause, (created_at, id)) FILTER (WHERE trim(wrong_cause) <> '') AS lc FROM attempts WHERE NOT correct GROUP BY 1) l ON a.question_id = l.question_id
        GROUP BY a.question_id""",
    "review_state": """SELECT question_id, wrong_count, correct_streak, correct_streak >= 2 AS mastered, last_cause, first_wrong_at, last_attempt_at,
        CASE WHEN correct_streak = 0 THEN last_wrong_at + INTERVAL 1 DAY ELSE first_right_at + INTERVAL 3 DAY END AS due_at,
        CASE WHEN correct_streak >= 2 THEN last_attempt_at END AS completed_at FROM reviews""",
}
_NEEDS = {"favorites": ["attempts"], "notes": ["attempts"], "reviews": ["attempts"], "review_state": ["reviews"]}


def with_tables(sql: str) -> str:
    """The SQL with the logical tables that it names put before it."""
    used: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, []):
            add(other)
        if name not in used:
            used.append(name)

    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    if not used:
        return sql
    heads = ",\n".join(f"{n} AS ({TABLES[n]})" for n in used)
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{heads},\n{body[len(start):]}"
    return f"WITH {heads}\n{body}"
