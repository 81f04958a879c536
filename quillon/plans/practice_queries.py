"""Queries over practice history, the catalogue, reviews and exams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import math as M
from quillon.functions.time import countdown, instant, seconds_between, since
from quillon.operators import catalog, practice, reports
from quillon.plans.model import AS_OF, TIME_ZONE, attempts, exams, favorites, memberships, notes, questions, table
from quillon.plans.registry import query

_PCT = "CASE WHEN {n} = 0 THEN 0.0 ELSE floor({c} * 1000.0 / {n} + 0.5) / 10 END"
_DAY = "CAST(created_at + INTERVAL 8 HOUR AS DATE)"
_AS = f"TIMESTAMP '{AS_OF}'"
_GOOD = _PCT.format(c="count(*) FILTER (WHERE correct)", n="count(*)")


@query("flagship", f"""SELECT q.category, count(*) AS attempts, count(*) FILTER (WHERE correct) AS correct, {_GOOD} AS accuracy,
    CAST(floor(avg(duration_seconds) + 0.5) AS BIGINT) AS mean_seconds FROM attempts a JOIN questions q ON a.question_id = q.id GROUP BY 1""")
def flagship(spark, sf):
    """Report by category over all attempts."""
    snap = questions(spark, sf).select(F.col("id").alias("question_id"), "category")
    return reports.by_category(attempts(spark, sf).join(snap, "question_id"), F.col("category"))


@query("report_by_category_7d", f"""SELECT coalesce(CASE WHEN q.subject = 'a' THEN q.category END, '(none)') AS category, count(*) AS attempts, count(*) FILTER (WHERE correct) AS correct, {_GOOD} AS accuracy,
    CAST(floor(avg(duration_seconds) + 0.5) AS BIGINT) AS mean_seconds FROM attempts a LEFT JOIN questions q ON a.question_id = q.id WHERE created_at >= {_AS} - INTERVAL 7 DAY GROUP BY 1""")
def report_by_category_7d(spark, sf):
    """D11 over B10: the snapshot category is read from JSON and is missing for one subject."""
    snapshot = F.to_json(F.struct(F.when(F.col("subject") == "a", F.col("category")).alias("category")))
    q = questions(spark, sf).select(F.col("id").alias("question_id"), snapshot.alias("question_snapshot"))
    recent = attempts(spark, sf).filter(since("created_at", AS_OF, 7)).join(q, "question_id", "left")
    return reports.by_category(recent, F.get_json_object("question_snapshot", "$.category"))


@query("report_overall_30d", f"SELECT count(*) AS attempts, CAST(coalesce(sum(duration_seconds), 0) AS BIGINT) AS seconds, count(*) FILTER (WHERE correct) AS correct, {_GOOD} AS accuracy FROM attempts WHERE created_at >= {_AS} - INTERVAL 30 DAY")
def report_overall(spark, sf):
    return reports.totals(attempts(spark, sf).filter(since("created_at", AS_OF, 30)))


@query("report_overall_all", f"SELECT count(*) AS attempts, CAST(coalesce(sum(duration_seconds), 0) AS BIGINT) AS seconds, count(*) FILTER (WHERE correct) AS correct, {_GOOD} AS accuracy FROM attempts")
def report_overall_all(spark, sf):
    return reports.totals(attempts(spark, sf).filter(since("created_at", AS_OF, None)))


@query("report_by_day", f"SELECT {_DAY} AS day, count(*) AS attempts, {_GOOD} AS accuracy, CAST(floor(coalesce(sum(duration_seconds), 0) / 60.0 + 0.5) AS BIGINT) AS minutes FROM attempts WHERE created_at >= {_AS} - INTERVAL 30 DAY GROUP BY 1")
def report_by_day(spark, sf):
    return reports.by_day(attempts(spark, sf).filter(since("created_at", AS_OF, 30)), TIME_ZONE)


@query("report_wrong_causes", "SELECT coalesce(nullif(trim(wrong_cause), ''), '(unlabelled)') AS cause, count(*) AS attempts FROM attempts WHERE NOT correct GROUP BY 1")
def report_wrong_causes(spark, sf):
    return reports.wrong_causes(attempts(spark, sf))


@query("dashboard_today", f"SELECT count(*) AS attempts, CAST(coalesce(sum(duration_seconds), 0) AS BIGINT) AS seconds, count(*) FILTER (WHERE correct) AS correct, {_GOOD} AS accuracy FROM attempts WHERE {_DAY} = DATE '2024-01-30'")
def dashboard_today(spark, sf):
    return reports.totals(reports.on_day(attempts(spark, sf), "2024-01-30 05:00:00", TIME_ZONE))


@query("dashboard_activity", f"SELECT {_DAY} AS day, count(*) AS attempts, {_GOOD} AS accuracy FROM attempts WHERE created_at >= {_AS} - INTERVAL 13 DAY GROUP BY 1")
def dashboard_activity(spark, sf):
    return reports.by_day(attempts(spark, sf).filter(since("created_at", AS_OF, 13)), TIME_ZONE).drop("minutes")


@query("calendar_densify", f"""WITH daily AS (SELECT {_DAY} AS day, count(*) AS attempts, {_GOOD} AS accuracy FROM attempts WHERE created_at >= {_AS} - INTERVAL 13 DAY GROUP BY 1)
    SELECT CAST(d AS DATE) AS day, coalesce(attempts, 0) AS attempts, coalesce(accuracy, 0.0) AS accuracy FROM range(DATE '2024-01-18', DATE '2024-02-01', INTERVAL 1 DAY) t(d) LEFT JOIN daily ON daily.day = CAST(d AS DATE)""")
def calendar_densify(spark, sf):
    return reports.calendar(dashboard_activity(spark, sf), AS_OF, TIME_ZONE)


@query("subject_mastery", f"SELECT subject, count(*) AS attempts, {_GOOD} AS accuracy FROM attempts a JOIN questions q ON a.question_id = q.id GROUP BY 1")
def subject_mastery(spark, sf):
    return reports.mastery(attempts(spark, sf), questions(spark, sf))


@query("weakest_subject", f"SELECT subject, accuracy FROM (SELECT category AS subject, {_GOOD} AS accuracy FROM attempts a JOIN questions q ON a.question_id = q.id GROUP BY 1) ORDER BY accuracy, subject LIMIT 1")
def weakest_subject(spark, sf):
    return reports.weakest(reports.mastery(attempts(spark, sf), questions(spark, sf), "category").withColumnRenamed("category", "subject"))


@query("recent_attempts", "SELECT a.id, a.question_id, coalesce(q.stem, '(deleted)') AS title, correct FROM (SELECT * FROM attempts ORDER BY created_at DESC, id DESC LIMIT 8) a LEFT JOIN questions q ON a.question_id = q.id AND q.subject = 'a'")
def recent_attempts(spark, sf):
    """A library that has lost one of its subjects."""
    return reports.recent(attempts(spark, sf), questions(spark, sf).filter("subject = 'a'"))


@query("study_streak", f"""WITH d AS (SELECT DISTINCT {_DAY} AS day FROM attempts), i AS (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INT) AS island FROM d),
    r AS (SELECT count(*) AS n, max(day) AS last FROM i GROUP BY island) SELECT CAST(coalesce(max(n), 0) AS BIGINT) AS streak FROM r WHERE last >= DATE '2024-01-30' AND last <= DATE '2024-01-31'""")
def study_streak(spark, sf):
    return reports.streak(attempts(spark, sf), AS_OF, TIME_ZONE)


_CATS = f"cats AS (SELECT stem AS category, count(*) AS attempts, {_GOOD} AS accuracy FROM attempts a JOIN questions q ON a.question_id = q.id GROUP BY 1)"


def _categories(spark, sf):
    return reports.mastery(attempts(spark, sf), questions(spark, sf), "stem").withColumnRenamed("stem", "category")


@query("diagnosis_strengths", f"WITH {_CATS} SELECT * FROM cats WHERE attempts >= 3 AND accuracy >= 70 ORDER BY accuracy DESC, attempts DESC, category LIMIT 4")
def diagnosis_strengths(spark, sf):
    return reports.strengths(_categories(spark, sf))


@query("diagnosis_weaknesses", f"WITH {_CATS}, s AS (SELECT * FROM cats WHERE attempts >= 3 AND accuracy >= 70 ORDER BY accuracy DESC, attempts DESC, category LIMIT 4) SELECT * FROM cats WHERE accuracy < 80 AND category NOT IN (SELECT category FROM s) ORDER BY accuracy, attempts DESC, category LIMIT 4")
def diagnosis_weaknesses(spark, sf):
    return reports.weaknesses(_categories(spark, sf))


_WEAK = "s AS (SELECT * FROM cats WHERE attempts >= 3 AND accuracy >= 70 ORDER BY accuracy DESC, attempts DESC, category LIMIT 4), w AS (SELECT * FROM cats WHERE accuracy < 80 AND category NOT IN (SELECT category FROM s) ORDER BY accuracy, attempts DESC, category LIMIT 4)"


@query("diagnosis_advice", f"""WITH {_CATS}, {_WEAK}, t AS (SELECT count(*) AS attempts, {_GOOD} AS accuracy FROM attempts), c AS (SELECT coalesce(nullif(trim(wrong_cause), ''), '(unlabelled)') AS cause, count(*) AS n FROM attempts WHERE NOT correct GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
    SELECT 1 AS place, CASE WHEN attempts = 0 THEN 'first_assessment' WHEN accuracy < 60 THEN 'basics' WHEN accuracy < 80 THEN 'alternate' ELSE 'timed_exams' END AS rule, '' AS about, CAST(accuracy AS DOUBLE) AS figure FROM t
    UNION ALL (SELECT 2, 'weakest', category, accuracy FROM w ORDER BY accuracy, attempts DESC, category LIMIT 1) UNION ALL SELECT 3, 'cause', cause, n FROM c WHERE cause <> '(unlabelled)'""")
def diagnosis_advice(spark, sf):
    return reports.recommendations(reports.totals(attempts(spark, sf)), diagnosis_weaknesses(spark, sf), reports.wrong_causes(attempts(spark, sf)))


@query("plan_generation", f"""WITH {_CATS}, {_WEAK}, f AS (SELECT category, row_number() OVER (ORDER BY accuracy, attempts DESC, category) AS n, least(3, count(*) OVER ()) AS m FROM w), g AS (SELECT CAST(d AS INT) AS day, CAST(k AS INT) AS slot FROM range(1, 8) t(d), range(1, 4) u(k))
    SELECT day, slot, CASE WHEN slot = 1 THEN 'read_knowledge' WHEN slot = 2 THEN 'official_practice' WHEN day % 3 = 0 THEN 'ai_variant' ELSE 'official_review' END AS type, f.category,
    CAST(CASE WHEN slot = 1 THEN 15 WHEN slot = 2 THEN 20 WHEN day % 3 = 0 THEN 3 ELSE 5 END AS INT) AS target FROM g JOIN f ON f.n = (g.day - 1) % f.m + 1""")
def plan_generation(spark, sf):
    return reports.plan(diagnosis_weaknesses(spark, sf))


@query("essay_summary", """SELECT count(*) AS essays, count(DISTINCT user_id % 40) AS prompts, CAST(floor(avg(duration_seconds) + 0.5) AS BIGINT) AS mean, CAST(max(duration_seconds) AS DOUBLE) AS best FROM attempts WHERE id % 7 > 1""")
def essay_summary(spark, sf):
    json = F.when(F.col("id") % 7 == 0, F.lit("{broken")).when(F.col("id") % 7 == 1, F.lit('{"score": "high"}')).otherwise(F.concat(F.lit('{"score": '), F.col("duration_seconds").cast("string"), F.lit("}")))
    return reports.essay_summary(attempts(spark, sf).select((F.col("user_id") % 40).alias("prompt_id"), json.alias("evaluation"), "created_at"))


# Catalogue.


@query("catalog_filter", "SELECT id, category, year FROM questions WHERE subject = 'a' AND difficulty = 2 ORDER BY year DESC NULLS LAST, category, id LIMIT 500")
def catalog_filter(spark, sf):
    return catalog.listed(catalog.filtered(questions(spark, sf), {"subject": "a", "difficulty": 2, "category": "", "year": 0})).select("id", "category", "year")


@query("catalog_pool", "SELECT id, category, year FROM questions WHERE category = 'PROMO'")
def catalog_pool(spark, sf):
    return catalog.listed(catalog.filtered(questions(spark, sf), {"category": "PROMO"}), None).select("id", "category", "year")


@query("catalog_search", "SELECT id, stem FROM questions WHERE stem ILIKE '%RED%' OR array_to_string(tags, ' ') ILIKE '%RED%'")
def catalog_search(spark, sf):
    return questions(spark, sf).filter(catalog.keyword([F.col("stem"), F.array_join("tags", " ")], "RED")).select("id", "stem")


@query("catalog_search_literal", "SELECT doc_id, length(text) AS chars FROM documents WHERE contains(lower(text), '%%% ')")
def catalog_search_literal(spark, sf):
    """The marks of LIKE stand for themselves."""
    return table(spark, sf, "documents").filter(catalog.keyword([F.col("text")], "%%% ", literal=True)).select("doc_id", F.char_length("text").alias("chars"))


@query("catalog_search_wildcard", "SELECT question_id, content FROM notes WHERE content ILIKE '%_een%'")
def catalog_search_wildcard(spark, sf):
    return notes(spark, sf).filter(catalog.keyword([F.col("content")], "_een")).select("question_id", "content")


@query("document_search", "SELECT doc_id, source FROM documents WHERE lang = 'en' AND (text ILIKE '%license%' OR source ILIKE '%license%') ORDER BY source, doc_id")
def document_search(spark, sf):
    d = catalog.filtered(table(spark, sf, "documents"), {"lang": "en", "source": None})
    return d.filter(catalog.keyword([F.col("text"), F.col("source")], "license")).orderBy("source", "doc_id").select("doc_id", "source")


@query("only_wrong", "SELECT id, stem FROM questions q WHERE EXISTS (SELECT 1 FROM review_state r WHERE r.question_id = q.id AND NOT mastered)")
def only_wrong(spark, sf):
    return catalog.only(questions(spark, sf), practice.review_state(attempts(spark, sf)).filter("not mastered")).select("id", "stem")


@query("only_favorite", "SELECT id, stem FROM questions q WHERE EXISTS (SELECT 1 FROM favorites f WHERE f.question_id = q.id)")
def only_favorite(spark, sf):
    return catalog.only(questions(spark, sf), favorites(spark, sf)).select("id", "stem")


@query("only_unattempted", "SELECT id, stem FROM questions q WHERE NOT EXISTS (SELECT 1 FROM attempts a WHERE a.question_id = q.id)")
def only_unattempted(spark, sf):
    return catalog.without(questions(spark, sf), attempts(spark, sf)).select("id", "stem")


@query("attempted_ids", "SELECT DISTINCT question_id FROM attempts")
def attempted_ids(spark, sf):
    return attempts(spark, sf).select("question_id").distinct()


@query("wrong_cause_unlabelled", "SELECT id, question_id FROM attempts WHERE NOT correct AND (wrong_cause IS NULL OR trim(wrong_cause) = '')")
def wrong_cause_unlabelled(spark, sf):
    return attempts(spark, sf).filter(~F.col("correct") & catalog.cause_is(F.col("wrong_cause"), "")).select("id", "question_id")


@query("active_vault", "SELECT p_partkey AS id, p_brand AS vault_id FROM part WHERE p_brand = 'Brand#7'")
def active_vault(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("vault_id"))
    vaults = p.select(F.col("vault_id").alias("id")).distinct().withColumn("active", F.col("id") == "Brand#7")
    return catalog.in_active(p, vaults).select("id", "vault_id")


@query("point_lookup", "SELECT id, stem, position FROM questions q JOIN (VALUES (CAST(0 AS INT), 7), (1, 3), (2, 99)) v(position, k) ON q.id = v.k")
def point_lookup(spark, sf):
    return catalog.by_ids(questions(spark, sf), [7, 3, 7, 99, 10**12]).select("id", "stem", "position")


@query("session_attempts", "SELECT id, question_id, correct FROM attempts WHERE session_id = 8")
def session_attempts(spark, sf):
    return attempts(spark, sf).filter("session_id = 8").orderBy("created_at", "id").select("id", "question_id", "correct")


_LIB = """q.stem, q.category, q.subject, coalesce(r.wrong_count, 0) AS wrong_count, coalesce(r.mastered, false) AS mastered, r.due_at, f.question_id IS NOT NULL AS favorite, coalesce(n.content, '') AS note
    FROM {base} b JOIN questions q ON q.id = b.question_id LEFT JOIN review_state r ON r.question_id = b.question_id LEFT JOIN favorites f ON f.question_id = b.question_id LEFT JOIN notes n ON n.question_id = b.question_id"""


def _library(spark, sf, base):
    return catalog.library(base, questions(spark, sf), practice.review_state(attempts(spark, sf)), favorites(spark, sf), notes(spark, sf))


@query("library_wrong", "SELECT b.question_id, b.last_cause, " + _LIB.format(base="(SELECT question_id, last_cause FROM review_state WHERE NOT mastered)"))
def library_wrong(spark, sf):
    return _library(spark, sf, practice.review_state(attempts(spark, sf)).filter("not mastered").select("question_id", "last_cause"))


@query("library_favorites", "SELECT b.question_id, b.created_at, " + _LIB.format(base="favorites"))
def library_favorites(spark, sf):
    return _library(spark, sf, favorites(spark, sf).select("question_id", "created_at"))


@query("library_notes", "SELECT b.question_id, b.updated_at, " + _LIB.format(base="(SELECT * FROM notes WHERE trim(content) <> '')"))
def library_notes(spark, sf):
    return _library(spark, sf, notes(spark, sf).filter(F.trim("content") != "").select("question_id", "updated_at"))


@query("user_metadata", """SELECT i.id AS question_id, f.question_id IS NOT NULL AS favorite, coalesce(n.content, '') AS note, coalesce(r.last_cause, '') AS cause FROM (SELECT DISTINCT id FROM questions) i
    LEFT JOIN favorites f ON f.question_id = i.id LEFT JOIN notes n ON n.question_id = i.id LEFT JOIN review_state r ON r.question_id = i.id""")
def user_metadata(spark, sf):
    return catalog.user_metadata(questions(spark, sf), favorites(spark, sf), notes(spark, sf), practice.review_state(attempts(spark, sf)))


@query("category_counts", "SELECT subject, category, count(*) AS questions FROM questions GROUP BY 1, 2")
def category_counts(spark, sf):
    return catalog.category_counts(questions(spark, sf))


@query("facets", "SELECT DISTINCT 'year' AS facet, CAST(year AS VARCHAR) AS value FROM questions UNION ALL SELECT DISTINCT 'paper', paper FROM questions UNION ALL SELECT DISTINCT 'category', category FROM questions")
def facets(spark, sf):
    return catalog.facets(questions(spark, sf), ["year", "paper", "category"])


@query("paper_rollup", "SELECT m.paper, count(*) AS questions, arg_min(q.year, (m.question_id, m.place)) AS year FROM memberships m JOIN questions q ON q.id = m.question_id GROUP BY 1 HAVING count(*) >= 8")
def paper_rollup(spark, sf):
    return catalog.papers(memberships(spark, sf), questions(spark, sf), least=8)


@query("paper_questions", "SELECT q.id, m.place, q.stem FROM memberships m JOIN questions q ON q.id = m.question_id WHERE m.paper = 7")
def paper_questions(spark, sf):
    return catalog.paper_questions(memberships(spark, sf), questions(spark, sf), 7).select("id", "place", "stem")


@query("paper_posexplode", "SELECT paper, CAST(place AS INT) AS place, question_id FROM (SELECT paper, unnest(ids) AS question_id, unnest(range(1, len(ids) + 1)) AS place FROM (SELECT paper, list(question_id ORDER BY place, question_id) AS ids FROM memberships GROUP BY 1))")
def paper_posexplode(spark, sf):
    ids = memberships(spark, sf).groupBy("paper").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "question_id"))), lambda s: s["question_id"]).alias("ids"))
    return catalog.exploded_memberships(ids)


@query("similar_items", """WITH s AS (SELECT * FROM questions WHERE id = 11), c AS (SELECT q.* FROM questions q, s WHERE q.subject = s.subject ORDER BY q.year DESC NULLS LAST, q.category, q.id LIMIT 2000)
    SELECT c.id, CAST((CASE WHEN c.category = s.category THEN 10 ELSE 0 END) + 3 * len(list_intersect(list_distinct(c.tags), list_distinct(s.tags))) - abs(c.difficulty - s.difficulty) AS INT) AS score FROM c, s WHERE c.id <> 11 AND score > 0 ORDER BY score DESC, c.id LIMIT 20""")
def similar_items(spark, sf):
    return catalog.similar(questions(spark, sf), 11)


@query("palette", """SELECT * FROM (SELECT 'question' AS kind, id, stem AS title FROM questions WHERE stem ILIKE '%ring%' ORDER BY id LIMIT 8) UNION ALL SELECT * FROM (SELECT 'document' AS kind, doc_id AS id, substring(text, 1, 40) AS title FROM documents WHERE contains(lower(text), 'ring') ORDER BY doc_id LIMIT 6)""")
def palette(spark, sf):
    return catalog.palette(questions(spark, sf), table(spark, sf, "documents"), "ring")


# Reviews and selection.


@query("review_state", "SELECT * FROM review_state WHERE wrong_count > 0")
def review_state(spark, sf):
    return practice.review_state(attempts(spark, sf))


@query("review_state_by_user", """WITH w AS (SELECT user_id, question_id, max((created_at, id)) AS w, count(*) AS wrong_count FROM attempts WHERE NOT correct GROUP BY 1, 2)
    SELECT a.user_id, a.question_id, any_value(w.wrong_count) AS wrong_count, CAST(count(*) FILTER (WHERE correct AND (created_at, a.id) > (w.w[1], w.w[2])) AS BIGINT) AS correct_streak, max(created_at) AS last_attempt_at FROM attempts a JOIN w ON w.user_id = a.user_id AND w.question_id = a.question_id GROUP BY 1, 2""")
def review_state_by_user(spark, sf):
    return practice.review_state(attempts(spark, sf), ["user_id", "question_id"]).select("user_id", "question_id", "wrong_count", "correct_streak", "last_attempt_at")


@query("due_reviews", f"SELECT r.question_id, r.due_at, q.stem, q.category FROM review_state r JOIN questions q ON q.id = r.question_id WHERE completed_at IS NULL AND due_at <= {_AS} + INTERVAL 2 DAY ORDER BY due_at, question_id LIMIT 500")
def due_reviews(spark, sf):
    return practice.due_reviews(practice.review_state(attempts(spark, sf)), questions(spark, sf), instant("2024-02-02 00:00:00")).select("question_id", "due_at", "stem", "category")


@query("mastered_counts", f"SELECT count(*) FILTER (WHERE NOT mastered) AS wrong, count(*) FILTER (WHERE mastered) AS mastered, count(*) AS total, count(*) FILTER (WHERE completed_at IS NULL AND due_at <= {_AS}) AS due FROM review_state")
def mastered_counts(spark, sf):
    s = practice.review_state(attempts(spark, sf))
    return s.agg(F.count_if(~F.col("mastered")).alias("wrong"), F.count_if("mastered").alias("mastered"), F.count("*").alias("total"), F.count_if(F.col("completed_at").isNull() & (F.col("due_at") <= instant(AS_OF))).alias("due"))


@query("recent_distinct", "SELECT DISTINCT question_id FROM (SELECT question_id FROM attempts ORDER BY created_at DESC, id DESC LIMIT 60)")
def recent_distinct(spark, sf):
    return practice.recent_distinct(attempts(spark, sf), 60)


_UNITS = "SELECT concat(CASE WHEN in_group THEN 'g' ELSE 'q' END, CAST(CASE WHEN in_group THEN family ELSE id END AS VARCHAR)) AS unit, list(id ORDER BY id % 3, id) AS ids, CAST(count(*) AS INT) AS size FROM (SELECT id, (id % 5 < 3) AS in_group, id // 7 AS family FROM questions) GROUP BY 1"


def _units(spark, sf):
    q = questions(spark, sf)
    return practice.units(q.select("id", F.when(F.col("id") % 5 < 3, F.col("family")).alias("group_id"), (F.col("id") % 3).alias("group_order")))


@query("unit_build", f"SELECT unit, array_to_string(ids, ',') AS ids, size FROM ({_UNITS})")
def unit_build(spark, sf):
    return _units(spark, sf).withColumn("ids", F.array_join("ids", ","))


@query("seeded_shuffle", f"SELECT unit, md5(concat('s1:', unit)) AS draw FROM ({_UNITS})")
def seeded_shuffle(spark, sf):
    return practice.seeded_order(_units(spark, sf), "s1").select("unit", "draw")


@query("unit_packing", f"""WITH RECURSIVE u AS (SELECT ids, size, row_number() OVER (ORDER BY md5(concat('s1:', unit))) AS n FROM ({_UNITS})),
    f(n, got) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT u.n, CASE WHEN len(got) = 0 OR len(got) + u.size <= 50 THEN list_concat(got, u.ids) ELSE got END FROM f JOIN u ON u.n = f.n + 1 WHERE f.n < 400)
    SELECT CAST(unnest(range(0, len(g))) AS INT) AS place, unnest(g) AS id FROM (SELECT got[1:50] AS g FROM f ORDER BY n DESC LIMIT 1)""")
def unit_packing(spark, sf):
    return practice.packed_units(practice.seeded_order(_units(spark, sf), "s1"), 50, "draw").select("place", "id")


@query("adaptive_ranking", f"""WITH {_CATS}, q AS (SELECT * FROM questions), weak AS (SELECT category, CAST(5 - row_number() OVER (ORDER BY accuracy, category) AS INT) AS priority FROM (SELECT q.category, {_GOOD} AS accuracy FROM attempts a JOIN q ON q.id = a.question_id GROUP BY 1) ORDER BY accuracy, category LIMIT 4),
    wq AS (SELECT q.category, q.tags FROM (SELECT question_id FROM review_state WHERE NOT mastered ORDER BY question_id LIMIT 500) r JOIN q ON q.id = r.question_id), wt AS (SELECT DISTINCT unnest(tags) AS t FROM wq), qt AS (SELECT id, count(*) AS n FROM (SELECT DISTINCT id, unnest(tags) AS t FROM q) WHERE t IN (SELECT t FROM wt) GROUP BY 1), rec AS (SELECT DISTINCT question_id FROM (SELECT question_id FROM attempts ORDER BY created_at DESC, id DESC LIMIT 60))
    SELECT q.id, CAST(20 * coalesce(weak.priority, 0) + CASE WHEN q.category IN (SELECT category FROM wq) THEN 12 ELSE 0 END + 3 * coalesce(qt.n, 0)
    + CASE WHEN q.id IN (SELECT question_id FROM attempts) THEN 0 ELSE 8 END - CASE WHEN q.id IN (SELECT question_id FROM rec) THEN 40 ELSE 0 END AS INT) AS score FROM q LEFT JOIN qt ON qt.id = q.id LEFT JOIN weak ON weak.category = q.category""")
def adaptive_ranking(spark, sf):
    a, q = attempts(spark, sf), questions(spark, sf)
    from pyspark.sql import Window

    cats = reports.mastery(a, q, "category").orderBy("accuracy", "category").limit(4)
    weak = cats.select("category", (5 - F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("accuracy", "category"))).alias("priority"))
    return practice.adaptive_scores(q, weak, practice.review_state(a).filter("not mastered"), a, practice.recent_distinct(a, 60))


# Exams, sessions, plans.

_ITEMS = "SELECT e.*, coalesce(answer = key, false) AS ok FROM exams e"


def _graded(spark, sf):
    items = exams(spark, sf).withColumn("answer", F.when(F.col("answer").isNotNull(), F.array(F.lower("answer"), F.lit(" ")))).withColumn("key", F.array("key"))
    return practice.graded(items)


@query("exam_score", f"SELECT exam_id, count(*) AS total, count(*) FILTER (WHERE ok) AS correct, {_PCT.format(c='count(*) FILTER (WHERE ok)', n='count(*)')} AS score FROM ({_ITEMS}) GROUP BY 1")
def exam_score(spark, sf):
    return practice.exam_scores(_graded(spark, sf))


@query("exam_category_breakdown", f"""SELECT category, count(*) AS items, count(*) FILTER (WHERE ok) AS correct, CAST(floor(count(*) FILTER (WHERE ok) * 100.0 / count(*) + 0.5) AS INT) AS accuracy, CAST(sum(seconds) AS BIGINT) AS seconds,
    CAST(coalesce(floor(avg(seconds) FILTER (WHERE seconds > 0) + 0.5), 0) AS BIGINT) AS mean_seconds FROM ({_ITEMS}) e JOIN questions q ON q.id = e.question_id GROUP BY 1""")
def exam_category_breakdown(spark, sf):
    items = _graded(spark, sf).join(questions(spark, sf).select(F.col("id").alias("question_id"), "category"), "question_id")
    return practice.exam_breakdown(items)


@query("session_supersede", "SELECT id, user_id, mode, created_at AS started_at, lead(created_at) OVER w AS ended_at, CASE WHEN lead(created_at) OVER w IS NULL THEN 'active' ELSE 'abandoned' END AS status FROM attempts WINDOW w AS (PARTITION BY user_id, mode ORDER BY created_at, id)")
def session_supersede(spark, sf):
    s = attempts(spark, sf).select("id", "user_id", "mode", F.col("created_at").alias("started_at"))
    return practice.superseded(s, "mode")


@query("latest_per_key", "SELECT user_id, arg_max(id, (created_at, id)) AS id, max(created_at) AS created_at FROM attempts GROUP BY 1")
def latest_per_key(spark, sf):
    return attempts(spark, sf).groupBy("user_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"), F.max("created_at").alias("created_at"))


@query("plan_overlay", "SELECT q.id AS item_id, q.category AS plan_id, CAST(3 AS INT) AS target, CAST(least(coalesce(c.n, 0), 3) AS INT) AS completed, coalesce(c.n, 0) >= 3 AS done FROM questions q LEFT JOIN (SELECT question_id, count(*) AS n FROM attempts WHERE correct GROUP BY 1) c ON c.question_id = q.id")
def plan_overlay(spark, sf):
    items = questions(spark, sf).select(F.col("category").alias("plan_id"), F.col("id").alias("item_id"), F.lit(3).alias("target"))
    done = attempts(spark, sf).filter("correct").groupBy(F.col("question_id").alias("item_id")).agg(F.count("*").cast("int").alias("completed"))
    return practice.plan_overlay(items, done.join(items.select("item_id", "plan_id"), "item_id"))


@query("difficulty_mapping", "SELECT question_id, CAST(CASE WHEN r >= 80 THEN 1 WHEN r >= 65 THEN 2 WHEN r >= 50 THEN 3 WHEN r >= 35 THEN 4 ELSE 5 END AS INT) AS difficulty FROM (SELECT question_id, count(*) FILTER (WHERE correct) * 100.0 / count(*) AS r FROM attempts GROUP BY 1)")
def difficulty_mapping(spark, sf):
    rate = F.count_if("correct") * 100.0 / F.count("*")
    return attempts(spark, sf).groupBy("question_id").agg(rate.alias("r")).select("question_id", M.difficulty_of_rate(F.col("r")).alias("difficulty"))


@query("exam_countdown", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1998-01-01' AS INT) AS days, CASE WHEN days = 0 THEN 'today' WHEN days < 0 THEN 'past' ELSE 'ahead' END AS status FROM orders")
def exam_countdown(spark, sf):
    left = countdown(F.to_date("o_orderdate"), "1998-01-01 00:00:00", TIME_ZONE)
    return table(spark, sf, "orders").select("o_orderkey", left.alias("c")).select("o_orderkey", "c.days", "c.status")


@query("session_duration", "SELECT user_id, CAST(greatest(0, date_diff('microsecond', min(created_at), max(created_at)) // 1000000) AS BIGINT) AS seconds FROM attempts GROUP BY 1")
def session_duration(spark, sf):
    return attempts(spark, sf).groupBy("user_id").agg(seconds_between(F.min("created_at"), F.max("created_at")).cast("long").alias("seconds"))
