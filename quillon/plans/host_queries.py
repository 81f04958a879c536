"""Queries over settings, records of variants, protected fields, page types and helpers of evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import sql as S
from quillon.functions import text as T
from quillon.operators import practice, quality, settings, versions
from quillon.plans.model import exams, questions, table
from quillon.plans.registry import query

_DAY = "CASE WHEN c_nationkey % 2 = 0 THEN '2024-02-30' ELSE '2024-03-05' END"
_CLAMPED = "CAST(greatest(least(floor({x} + 0.5), {high}), {low}) AS INT)"
_KINDS = [("smooth", ("POLISHED", "BURNISHED")), ("coated", ("PLATED", "ANODIZED", "BRUSHED")), ("large", ("LARGE", "ECONOMY"))]
_TYPES = {"^(small|medium)": "single", "tin|nickel": "multiple", "steel$": "judge"}
_BLANK = r"\s\x1c-\x1f\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_TEXT = rf"[{_BLANK}，。、；：？！,.;:?!()（）【】\[\]\"''’“”]+"


@query("settings_merged", f"""SELECT c_custkey, 'light' AS theme, {_CLAMPED.format(x='c_nationkey * 10.0', low=85, high=150)} AS ui_scale,
    {_CLAMPED.format(x='CAST(c_acctbal AS DOUBLE) / 10', low=1, high=500)} AS daily_target,
    {_CLAMPED.format(x='CAST(c_acctbal AS DOUBLE)', low=1, high=100)} AS practice_count, 120 AS exam_minutes, 12 AS backups, c_nationkey < 5 AS reduce_motion,
    true AS auto_backup, concat(c_name, ' ', c_mktsegment) AS goal, CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE '2024-03-05' END AS goal_date FROM customer""")
def settings_merged(spark, sf):
    """Every customer's stored settings and a patch of them."""
    bal = F.col("c_acctbal").cast("double")
    stored = F.to_json(F.struct((F.col("c_nationkey") * 10.0).alias("uiScale"), F.lit(3.0).alias("defaultPracticeCount"), (F.col("c_nationkey") < 5).alias("reduceMotion")))
    goal = F.concat(F.lit(" "), "c_name", F.lit(" "), "c_mktsegment", F.lit(" "))
    patch = F.to_json(F.struct((bal / 10).alias("dailyTarget"), bal.alias("defaultPracticeCount"), goal.alias("examGoalName"), F.expr(_DAY).alias("examGoalDate")))
    rows = settings.merged(table(spark, sf, "customer").select("c_custkey", stored.alias("stored"), patch.alias("patch")))
    names = {"theme": "theme", "uiScale": "ui_scale", "dailyTarget": "daily_target", "defaultPracticeCount": "practice_count", "defaultExamMinutes": "exam_minutes",
             "backupRetention": "backups", "reduceMotion": "reduce_motion", "autoBackup": "auto_backup", "examGoalName": "goal", "examGoalDate": "goal_date"}
    return rows.select("c_custkey", *(F.col(f"settings.{k}").alias(v) for k, v in names.items()))


@query("variant_records", """SELECT concat(e.exam_id, '-', e.place) AS id, e.question_id AS source_question_id,
    concat('{"stem":"', q.stem, '","options":["A","R"],"answer":["', e.key, '"],"explanation":"', q.category, '"}') AS variant_json,
    CASE WHEN e.answer IS NULL THEN '[]' ELSE concat('[" ', lower(e.answer), '"]') END AS user_answer_json,
    coalesce(e.answer = e.key, false) AS correct, e.place AS created_at FROM exams e JOIN questions q ON e.question_id = q.id""")
def variant_records(spark, sf):
    """Every item of an exam as an attempt at a variant of its question."""
    q = questions(spark, sf).select(F.col("id").alias("question_id"), "stem", F.col("category").alias("explanation"))
    given = F.when(F.col("answer").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit(" "), F.lower("answer"))))
    rows = exams(spark, sf).join(q, "question_id").select(
        F.concat_ws("-", F.col("exam_id").cast("string"), F.col("place").cast("string")).alias("id"), "question_id", "stem", F.array(F.lit("A"), F.lit("R")).alias("options"),
        F.array("key").alias("answer"), "explanation", given.alias("user_answer"), F.col("place").alias("created_at"))
    return practice.variant_records(rows)


@query("field_protection", """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'F' THEN 'o_orderstatus' END,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'o_orderpriority' END) AS changed FROM orders
    WHERE o_orderstatus = 'F' OR o_orderpriority LIKE '1%'""")
def field_protection(spark, sf):
    """Revised orders of which a protected field is another one."""
    before = table(spark, sf, "orders")
    after = before.withColumns({
        "o_orderstatus": F.when(F.col("o_orderstatus") == "F", None).otherwise(F.col("o_orderstatus")),
        "o_orderpriority": F.when(F.col("o_orderpriority").startswith("1"), "none").otherwise(F.col("o_orderpriority")),
        "o_totalprice": F.col("o_totalprice") * 2,
    })
    changes = versions.protected_changes(before, after, "o_orderkey", ["o_orderstatus", "o_orderpriority"])
    return changes.select("o_orderkey", F.array_join("changed", ",").alias("changed"))


_TAGS = "len(regexp_extract_all(html, '<{t}[ >]'))"


@query("page_types", f"""WITH s AS (SELECT page_id, contains(html, '<footer') AS solved, {_TAGS.format(t='p')} AS lines, {_TAGS.format(t='a')} AS figures,
    contains(html, '<ul') AS grid, {_TAGS.format(t='li')} AS images, len(regexp_extract_all(html, '[0-9][0-9,.%]*')) AS numbers FROM pages)
    SELECT page_id, CASE WHEN solved THEN '解析' WHEN images >= 3 AND lines < 30 THEN '图形推理候选' WHEN figures >= 2 AND (grid OR numbers >= 60) THEN '资料分析'
    WHEN grid AND numbers >= 30 THEN '资料分析' WHEN lines <= 3 AND figures = 0 THEN 'blank-or-cover' ELSE '普通文字' END AS kind,
    CASE WHEN solved THEN 0.9 WHEN images >= 3 AND lines < 30 THEN 0.75 WHEN figures >= 2 AND (grid OR numbers >= 60) THEN 0.8
    WHEN grid AND numbers >= 30 THEN 0.7 WHEN lines <= 3 AND figures = 0 THEN 0.85 ELSE 0.6 END::DOUBLE AS confidence FROM s""")
def page_types(spark, sf):
    """Types of pages by signals counted in their markup."""
    def tags(t: str):
        return F.regexp_count("html", F.lit(f"<{t}[ >]"))

    kind = quality.page_type(F.contains("html", F.lit("<footer")), F.lit(0), tags("p"), tags("a"), F.contains("html", F.lit("<ul")), tags("li"), F.regexp_count("html", F.lit("[0-9][0-9,.%]*")))
    return table(spark, sf, "pages").select("page_id", kind.alias("k")).select("page_id", F.col("k.type").alias("kind"), F.col("k.confidence").alias("confidence"))


@query("unread_page_types", """SELECT doc_id, CASE WHEN n_chars < 300 AND lang <> 'en' THEN 'blank-or-cover' WHEN source = 'wiki' THEN '解析' WHEN lang = 'de' THEN '资料分析'
    WHEN lang = 'en' THEN '图形推理候选' ELSE '普通文字' END AS kind FROM documents""")
def unread_page_types(spark, sf):
    """Coarse types by the length of the text layer, source and language."""
    images = F.when(F.col("lang") == "en", 1).otherwise(0)
    chars = F.when(F.col("n_chars") < 300, 0).otherwise(F.col("n_chars"))
    kind = quality.unread_page_type(chars, images, F.col("source") == "wiki", F.col("lang"), "de", "en")
    return table(spark, sf, "documents").select("doc_id", kind.alias("kind"))


@query("book_kinds", """SELECT p_partkey, CASE WHEN p_type LIKE '%POLISHED%' OR p_type LIKE '%BURNISHED%' THEN 'smooth'
    WHEN p_type LIKE '%PLATED%' OR p_type LIKE '%ANODIZED%' OR p_type LIKE '%BRUSHED%' THEN 'coated'
    WHEN p_type LIKE '%LARGE%' OR p_type LIKE '%ECONOMY%' THEN 'large' ELSE 'other' END AS kind FROM part""")
def book_kinds(spark, sf):
    """The first kind of which a keyword stands in the title."""
    return table(spark, sf, "part").select("p_partkey", T.book_kind(F.col("p_type"), _KINDS, "other").alias("kind"))


@query("coerced_types", """SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^(small|medium)', 'i') THEN 'single' WHEN regexp_matches(p_type, 'tin|nickel', 'i') THEN 'multiple'
    WHEN regexp_matches(p_type, 'steel$', 'i') THEN 'judge' ELSE 'essay' END AS kind FROM part""")
def coerced_types(spark, sf):
    """Types by the first pattern that matches."""
    return table(spark, sf, "part").select("p_partkey", T.coerced(F.col("p_type"), _TYPES, "essay").alias("kind"))


@query("evaluation_texts", f"SELECT doc_id, md5(regexp_replace(text, '{_TEXT}', '', 'g')) AS plain FROM documents")
def evaluation_texts(spark, sf):
    """Whole texts without white space and punctuation."""
    return table(spark, sf, "documents").select("doc_id", F.md5(T.evaluation_text(F.col("text"))).alias("plain"))


@query("evaluation_numbers", "SELECT l_orderkey, l_linenumber, concat(CAST(CAST(l_quantity AS INT) AS VARCHAR), '000.', CAST(l_linenumber AS VARCHAR), '%') AS number FROM lineitem")
def evaluation_numbers(spark, sf):
    """Quantities written with thousands marks and full-width signs."""
    written = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("，000。 "), F.col("l_linenumber").cast("string"), F.lit("　％"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.evaluation_number(written).alias("number"))


_EXCERPT = "CASE WHEN n_chars % 2 = 0 THEN concat('\\n ', substring(text, 10, 60)) ELSE reverse(text) END"
_SQL_EXCERPT = _EXCERPT.replace("'\\n '", "chr(10) || ' '")


def _gone(x: str) -> str:
    return f"regexp_replace({x}, '[{_BLANK}]+', '', 'g')"


@query("excerpt_checks", f"""WITH s AS (SELECT doc_id, {_gone('text')} AS held, substring({_gone(_SQL_EXCERPT)}, 1, 20) AS start FROM documents)
    SELECT doc_id, start <> '' AND contains(held, start) AS found FROM s""")
def excerpt_checks(spark, sf):
    """Excerpts that stand in their whole text, and reversed ones that mostly don't."""
    return table(spark, sf, "documents").select("doc_id", T.has_excerpt(F.col("text"), F.expr(_EXCERPT)).alias("found"))


@query("sql_functions", """SELECT p_partkey, greatest(least(CAST(p_size AS DOUBLE), 40.0), 10.0) AS kept, floor(p_size * 1000.0 / 50 + 0.5) / 10 AS share,
    CAST(CASE WHEN p_size * 2 >= 80 THEN 1 WHEN p_size * 2 >= 65 THEN 2 WHEN p_size * 2 >= 50 THEN 3 WHEN p_size * 2 >= 35 THEN 4 ELSE 5 END AS INT) AS difficulty,
    substring(sha256(concat(p_name, chr(10), p_brand)), 1, 20) AS sid, least(1.0, levenshtein(p_name, p_type) / length(p_name))::DOUBLE AS error_rate FROM part""")
def sql_functions(spark, sf):
    """The helpers as SQL functions of the session."""
    S.register(spark)
    return spark.sql(
        """SELECT p_partkey, quillon_clamp(p_size, 10, 40) AS kept, quillon_percent(p_size, 50) AS share, quillon_difficulty(p_size * 2) AS difficulty,
        quillon_stable_id(array(p_name, p_brand), 20) AS sid, quillon_error_rate(p_name, p_type) AS error_rate FROM {part}""",
        part=table(spark, sf, "part"),
    )
