"""Queries over ingestion, layout, pairing, gates and metrics, on rows made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import json as J
from quillon.functions import math as M
from quillon.functions import text as T
from quillon.operators import evaluation, extraction, layout, pairing, practice, quality, versions
from quillon.plans.model import table
from quillon.plans.text_queries import _OF_ORDER, _of_order
from quillon.plans.registry import query
from quillon.sources import parsers


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _li(spark, sf):
    return table(spark, sf, "lineitem")


# Parsers: state machines, tested on fixtures; here they run over whole tables.


@query("chunk_documents")
def chunk_documents(spark, sf):
    return parsers.chunk_documents(_docs(spark, sf).select(F.col("doc_id").alias("doc"), "text")).select("doc", "chunk_no", F.char_length("chunk").alias("chars"))


def _book(spark, sf):
    """A booklet for each order: its lines are numbered questions with options."""
    row = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    orders = _li(spark, sf).groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    lines = F.transform("r", lambda x, i: F.array(F.concat((i + 1).cast("string"), F.lit("."), F.lit("question text "), x["p"].cast("string")), F.concat(F.lit("A."), x["s"].cast("string")), F.lit("B.no"), F.lit("C.none"), F.lit("D.all")))
    return orders.select("doc", F.flatten(lines).alias("lines"))


@query("question_detection", "SELECT l_orderkey AS doc, CAST(row_number() OVER w AS INT) AS num, CAST(4 AS INT) AS options, CAST(5 * (row_number() OVER w - 1) AS INT) AS line_no FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)")
def question_detection(spark, sf):
    return parsers.parse_lines(_book(spark, sf), parsers.page_numbers).select("doc", "num", "options", "line_no")


@query("question_book", "SELECT l_orderkey AS doc, CAST(1 AS INT) AS set_no, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS num, concat('question text ', CAST(l_partkey AS VARCHAR)) AS stem, CAST(4 AS INT) AS options FROM lineitem")
def question_book(spark, sf):
    return parsers.parse_lines(_book(spark, sf), parsers.question_book).select("doc", "set_no", "num", "stem", F.size("options").alias("options"))


@query("grouped_answers", "SELECT l_orderkey AS doc, CAST(1 AS INT) AS chapter, CAST(row_number() OVER w AS INT) AS num, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'C' ELSE 'B' END AS answer FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)")
def grouped_answers(spark, sf):
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "C").otherwise("B").alias("a"))
    o = _li(spark, sf).groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    answers = F.concat(F.lit("1-"), F.size("r").cast("string"), F.lit(":"), F.array_join(F.transform("r", lambda x: x["a"]), ""))
    return parsers.parse_lines(o.select("doc", F.array(F.lit("参考答案"), F.lit("第一篇"), answers).alias("lines")), parsers.grouped_answers)


# Layout.

_BOX = "[least(l_discount, l_tax) * 5, l_linenumber / 10, least(l_discount, l_tax) * 5 + l_quantity / 100, l_linenumber / 10 + 0.05]"


def _regions(spark, sf):
    x = F.least("l_discount", "l_tax") * 5
    box = F.array(x, F.col("l_linenumber") / 10, x + F.col("l_quantity") / 100, F.col("l_linenumber") / 10 + 0.05)
    return _li(spark, sf).select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 3 + 1).alias("page"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("region_no"), F.when(F.col("l_returnflag") == "A", "image").otherwise("text").alias("type"), box.alias("bbox"), F.lit("p").alias("img_path"), F.concat(F.col("l_linenumber").cast("string"), F.lit(". t")).alias("text"))


@query("reading_order", f"""WITH r AS (SELECT l_orderkey AS doc, CAST(l_linenumber % 3 + 1 AS INT) AS page, l_partkey * 1000 + l_suppkey AS region_no, {_BOX} AS b FROM lineitem), p AS (SELECT doc, page, count(*) FILTER (WHERE b[3] <= 0.52) >= 0.35 * count(*) AND count(*) FILTER (WHERE b[1] >= 0.48) >= 0.35 * count(*) AS two FROM r GROUP BY 1, 2),
    c AS (SELECT r.*, CAST(CASE WHEN two AND b[1] >= 0.48 THEN 1 ELSE 0 END AS INT) AS col FROM r JOIN p USING (doc, page)) SELECT doc, page, region_no, col AS "column", CAST(row_number() OVER (PARTITION BY doc, page ORDER BY col, b[2], b[1], region_no) AS INT) AS place FROM c""")
def reading_order(spark, sf):
    return layout.reading_order(_regions(spark, sf)).select("doc", "page", "region_no", "column", "place")


@query("graphic_documents", "SELECT doc, count(*) FILTER (WHERE n AND i) >= 2 AS graphic FROM (SELECT l_orderkey AS doc, l_linenumber % 3 + 1 AS page, bool_or(l_returnflag <> 'A') AS n, bool_or(l_returnflag = 'A') AS i FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def graphic_documents(spark, sf):
    return layout.is_graphic(_regions(spark, sf), 2)


@query("segments", "SELECT doc, place, num, CAST(coalesce(sum(CASE WHEN num <= prev THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY place), 0) AS BIGINT) AS segment FROM (SELECT doc, place, num, lag(num) OVER (PARTITION BY doc ORDER BY place) AS prev FROM (SELECT l_orderkey AS doc, l_linenumber AS num, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS INT) AS place FROM lineitem))")
def segments(spark, sf):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber"))
    return layout.segments(_li(spark, sf).select(F.col("l_orderkey").alias("doc"), place.alias("place"), F.col("l_linenumber").alias("num")))


@query("grid_sections", "SELECT doc, place, CAST(sum(CASE WHEN prev IS NULL OR s = 1 OR s - prev >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY place) AS BIGINT) AS section FROM (SELECT doc, place, s, lag(s + 1) OVER (PARTITION BY doc ORDER BY place) AS prev FROM (SELECT l_orderkey AS doc, l_linenumber AS s, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS INT) AS place FROM lineitem))")
def grid_sections(spark, sf):
    s = segments(spark, sf).select("doc", "place", F.col("num").alias("start"), (F.col("num") + 1).alias("end"))
    return layout.grid_sections(s).select("doc", "place", "section")


@query("box_overlaps", f"""WITH r AS (SELECT l_orderkey AS doc, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, {_BOX} AS b FROM lineitem) SELECT x.doc, x.n AS a, y.n AS b, x.p AS pa, y.p AS pb, round(CASE WHEN (x.b[3] - x.b[1]) * 0.05 + (y.b[3] - y.b[1]) * 0.05 > 0 THEN greatest(0.0, least(x.b[3], y.b[3]) - greatest(x.b[1], y.b[1])) / least(x.b[3] - x.b[1], y.b[3] - y.b[1]) ELSE 0 END, 5) AS overlap,
    (x.b[1] + x.b[3]) / 2 >= y.b[1] AND (x.b[1] + x.b[3]) / 2 <= y.b[3] AND (x.b[2] + x.b[4]) / 2 >= y.b[2] AND (x.b[2] + x.b[4]) / 2 <= y.b[4] AS inside FROM r x JOIN r y ON x.doc = y.doc AND x.n < y.n""")
def box_overlaps(spark, sf):
    x = F.least("l_discount", "l_tax") * 5
    box = F.array(x, F.col("l_linenumber") / 10, x + F.col("l_quantity") / 100, F.col("l_linenumber") / 10 + 0.05)
    r = _li(spark, sf).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("a"), F.col("l_partkey").alias("pa"), box.alias("ba"))
    s = r.select("doc", F.col("a").alias("b"), F.col("pa").alias("pb"), F.col("ba").alias("bb"))
    return r.join(s, "doc").filter("a < b").select("doc", "a", "b", "pa", "pb", F.round(M.x_overlap(F.col("ba"), F.col("bb")), 5).alias("overlap"), M.centre_inside(F.col("ba"), F.col("bb")).alias("inside"))


@query("evidence_boxes", f"SELECT l_orderkey AS doc, l_partkey AS p, l_linenumber AS n, list_min(b) >= 0 AND list_max(b) <= 1 AND b[3] > b[1] AND b[4] > b[2] AS valid FROM (SELECT *, {_BOX} AS b FROM lineitem)")
def evidence_boxes(spark, sf):
    x = F.least("l_discount", "l_tax") * 5
    box = F.array(x, F.col("l_linenumber") / 10, x + F.col("l_quantity") / 100, F.col("l_linenumber") / 10 + 0.05)
    return _li(spark, sf).select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("n"), M.box_is_valid(box).alias("valid"))


_LINES = "lines AS (SELECT doc_id AS doc, CAST(i AS INT) AS line_no, string_split(text, chr(10))[CAST(i + 1 AS INT)] AS line FROM (SELECT doc_id, text, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents))"


@query("line_pages", f"WITH {_LINES}, r AS (SELECT doc, line_no, CASE WHEN trim(line) <> '' THEN count(*) FILTER (WHERE trim(line) <> '') OVER (PARTITION BY doc ORDER BY line_no) END AS r FROM lines) SELECT doc, line_no, CAST(CASE WHEN r <= 3 THEN 1 WHEN r <= 6 THEN 2 END AS INT) AS page FROM r")
def line_pages(spark, sf):
    lines = _docs(spark, sf).select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    pages = _docs(spark, sf).select(F.col("doc_id").alias("doc"), F.explode(F.array(F.lit(1), F.lit(2))).alias("page"), F.array_repeat(F.lit("x"), 3).alias("lines"))
    return layout.line_pages(lines, pages).select("doc", "line_no", "page")


# Text to columns.


@query("word_limits", "SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN 100 + p_size WHEN 1 THEN NULL WHEN 2 THEN floor((100 + p_size) * 0.9 + 0.5) ELSE 100 + p_size END AS INT) AS lo, CAST(CASE p_partkey % 4 WHEN 0 THEN 900 WHEN 1 THEN 100 + p_size WHEN 2 THEN floor((100 + p_size) * 1.1 + 0.5) ELSE NULL END AS INT) AS hi FROM part")
def word_limits(spark, sf):
    n = (100 + F.col("p_size")).cast("string")
    k = F.col("p_partkey") % 4
    stem = F.when(k == 0, F.concat(n, F.lit("—900 字"))).when(k == 1, F.concat(F.lit("要求：不超过 "), n, F.lit("字。"))).when(k == 2, F.concat(n, F.lit("字左右"))).otherwise(F.concat(F.lit("不少于"), n, F.lit("字")))
    return table(spark, sf, "part").select("p_partkey", T.word_limit(stem).alias("w")).select("p_partkey", F.col("w.min").alias("lo"), F.col("w.max").alias("hi"))


@query("inline_options", "SELECT p_partkey, concat('A=', p_name, ';B=', p_brand, ';C=', p_type) AS options FROM part")
def inline_options(spark, sf):
    line = F.concat(F.lit("A."), F.col("p_name"), F.lit(" B. "), F.col("p_brand"), F.lit(" C、"), F.col("p_type"))
    o = T.inline_options(line)
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(o, lambda x: F.concat(x["key"], F.lit("="), x["text"])), ";").alias("options"))


@query("option_objects", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('A=', p_name, ';C=', p_type) END AS options FROM part")
def option_objects(spark, sf):
    obj = F.when(F.col("p_partkey") % 5 == 0, F.lit('{"a": ')).otherwise(F.concat(F.lit('{"c": "'), F.col("p_type"), F.lit('", "b": " ", "a": "'), F.col("p_name"), F.lit('"}')))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(J.options(obj), lambda x: F.concat(x["key"], F.lit("="), x["text"])), ";").alias("options"))


@query("loose_json", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_size END AS size FROM part")
def loose_json(spark, sf):
    obj, k = F.concat(F.lit('{"size": '), F.col("p_size").cast("string"), F.lit("}")), F.col("p_partkey") % 4
    text = F.when(k == 0, obj).when(k == 1, F.concat(F.lit("Here:\n```json\n"), obj, F.lit("\n```\n"))).when(k == 2, F.concat(F.lit("so "), obj, F.lit(" it is"))).otherwise(F.lit("nothing { here"))
    return table(spark, sf, "part").select("p_partkey", F.get_json_object(J.loose_object(text), "$.size").cast("int").alias("size"))


@query("paper_regions", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 > 0 THEN n_name END AS region FROM nation")
def paper_regions(spark, sf):
    title = F.when(F.col("n_nationkey") % 3 == 0, "2023年国家公务员录用考试").otherwise(F.concat(F.lit("2021年"), F.col("n_name"), F.lit("公务员录用考试《行测》")))
    return table(spark, sf, "nation").select("n_nationkey", T.region_of_paper(title).alias("region"))


@query("alignment_scores", """WITH t AS (SELECT item_id, substring(regexp_replace(text, '[\\s\\p{P}\\p{S}]', '', 'g'), 1, 140) AS q, substring(regexp_replace(concat(CAST(item_id AS VARCHAR), ' ', text), '[\\s\\p{P}\\p{S}]', '', 'g'), 1, 140) AS e FROM benchmark),
    g AS (SELECT item_id, [substring(q, CAST(i AS INT), 2) for i in range(1, length(q))] AS a, [substring(e, CAST(i AS INT), 2) for i in range(1, length(e))] AS b FROM t) SELECT item_id, round(len([x for x in b if list_contains(a, x)]) / len(list_distinct(a)), 6) AS score FROM g""")
def alignment_scores(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.round(pairing.alignment(F.col("text"), F.concat_ws(" ", F.col("item_id").cast("string"), "text")), 6).alias("score"))


def _books(spark, sf):
    o = _li(spark, sf).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.max("l_returnflag").alias("flag"))
    book = (F.col("l_orderkey") % 50).alias("book")
    return o.select(book, F.col("l_orderkey").alias("set_no"), F.col("l_linenumber").alias("num"), F.concat(F.lit("question text number "), F.col("p").cast("string")).alias("stem"), F.col("l_linenumber").alias("line_no"), "p", "flag")


@query("pair_by_key", "WITH q AS (SELECT l_orderkey % 50 AS book, l_orderkey AS set_no, l_linenumber AS num, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL) SELECT book, set_no, num, CASE flag WHEN 'R' THEN 'B' WHEN 'N' THEN 'C' END AS answer FROM q")
def pair_by_key(spark, sf):
    """C11: returned lines have a solution with a reprint, new ones a grouped answer, the others neither."""
    q = _books(spark, sf)
    s = q.filter("flag <> 'A'").select("book", "set_no", "num", F.when(F.col("flag") == "R", "B").otherwise("").alias("answer"), F.when(F.col("flag") == "R", F.col("stem")).alias("excerpt"))
    a = q.filter("flag = 'N'").select("book", F.col("set_no").alias("chapter"), "num", F.lit("C").alias("answer"))
    return pairing.by_key(q, s, a).select("book", "set_no", "num", "answer")


@query("pairing_summary", "WITH q AS (SELECT l_orderkey % 50 AS book, max(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT book, count(*) FILTER (WHERE flag = 'R') AS paired, count(*) FILTER (WHERE flag <> 'R') AS pending, count(*) FILTER (WHERE flag = 'N') AS unused FROM q GROUP BY 1")
def pairing_summary(spark, sf):
    q = _books(spark, sf)
    return pairing.pairing_summary(q, q.filter("flag <> 'A'"), q.filter("flag = 'R'"))


# State changes.


@query("upsert_retention", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) FILTER (WHERE event_type <> 'error') AS value FROM events GROUP BY 1")
def upsert_retention(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("value"), F.struct("ts", "event_id").alias("at"))
    none = e.filter("false").select("user_id", "event_type", "value")
    return versions.upserted(none, e, ["user_id"], "at", ["value"])


@query("review_decisions", "SELECT d.doc_id AS id, CASE WHEN lang = 'de' THEN 'published' WHEN q = 1 THEN 'approved' WHEN q = 0 THEN 'rejected' ELSE 'pending' END AS status, lang <> 'de' AND q IS NOT NULL AS processed FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id")
def review_decisions(spark, sf):
    """Labels of quality decide on documents; those of one language are out already."""
    rows = _docs(spark, sf).select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "de", "published").otherwise("pending").alias("status"))
    decisions = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.when(F.max("quality") == 1, "approve").otherwise("reject").alias("decision"))
    return versions.reviewed(rows, decisions)


@query("wrong_cause_update", "SELECT r.question_id, CASE WHEN q.subject = 'a' THEN CASE WHEN q.difficulty <> 1 THEN 'slip' END ELSE r.last_cause END AS last_cause FROM review_state r LEFT JOIN questions q ON q.id = r.question_id")
def wrong_cause_update(spark, sf):
    from quillon.plans.model import attempts, questions

    wrong = practice.review_state(attempts(spark, sf)).select("question_id", "last_cause")
    changes = questions(spark, sf).filter("subject = 'a'").select(F.col("id").alias("question_id"), F.when(F.col("difficulty") == 1, "  ").otherwise(" slip ").alias("cause"))
    return versions.with_cause(wrong, changes)


@query("conversion_misses", "WITH k AS (SELECT source, lang, substring(sha256(concat(source, '|', md5(text))), 1, 32) AS key FROM documents) SELECT source AS converter, key FROM k WHERE key NOT IN (SELECT key FROM k WHERE lang = 'en')")
def conversion_misses(spark, sf):
    d = _docs(spark, sf).select(F.col("lang"), F.col("source").alias("converter"), F.md5("text").alias("content_hash"))
    cache = d.filter("lang = 'en'").select(F.substring(F.sha2(F.concat_ws("|", "converter", "content_hash"), 256), 1, 32).alias("key"), F.lit(True).alias("valid")).distinct()
    return versions.missing(d, cache).select("converter", "key")


@query("incremental_index", "SELECT doc_id AS path FROM documents WHERE contains(text, '###') OR text <> trim(text, '.')")
def incremental_index(spark, sf):
    """Files that were indexed with full stops at their ends, but for those with junk, which never were."""
    d = _docs(spark, sf)
    files = d.select(F.col("doc_id").alias("path"), F.md5(F.trim("text", F.lit("."))).alias("content_hash"))
    return versions.to_parse(files, d.filter(~F.col("text").contains("###")).select(F.col("doc_id").alias("path"), F.md5("text").alias("content_hash"))).select("path")


# Metrics.


_MATCHED = "(SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem WHERE l_returnflag <> 'A') t FULL JOIN (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem WHERE l_quantity > 12) f ON t.o = f.o AND t.n = f.n"


def _matched(spark, sf):
    """Lines that weren't returned as what there is, lines of some size as what was found."""
    li = _li(spark, sf).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("num"), F.lit("t").alias("text"), "l_returnflag", "l_quantity")
    truth, found = li.filter("l_returnflag <> 'A'"), li.filter("l_quantity > 12")
    same = ["page", "num", "text"]
    return evaluation.matched_items(truth.select(*same).distinct(), found.select(*same).distinct().withColumn("ordinal", F.col("num")), ["page", "num"])


@query("matched_items", f"SELECT coalesce(t.o, f.o) AS page, coalesce(t.n, f.n) AS num, CASE WHEN t.o IS NULL THEN 'invented' WHEN f.o IS NULL THEN 'missed' ELSE 'matched' END AS state FROM {_MATCHED}")
def matched_items(spark, sf):
    return _matched(spark, sf).select("page", "num", "state")


@query("page_metrics", f"WITH m AS (SELECT coalesce(t.o, f.o) AS page, t.o IS NOT NULL AS t, f.o IS NOT NULL AS f FROM {_MATCHED}) SELECT page, count(*) FILTER (WHERE t) AS truth, count(*) FILTER (WHERE f) AS found, count(*) FILTER (WHERE t AND f) AS matched, count(*) FILTER (WHERE t AND f) / nullif(count(*) FILTER (WHERE t), 0) AS recall, count(*) FILTER (WHERE t AND f) / nullif(count(*) FILTER (WHERE f), 0) AS precision FROM m GROUP BY 1")
def page_metrics(spark, sf):
    return evaluation.page_metrics(_matched(spark, sf)).drop("cer")


@query("completeness", "SELECT count(*) AS total, count(*) FILTER (WHERE length(p_name) >= 9 AND p_size % 4 >= 2) AS complete, floor(count(*) FILTER (WHERE length(p_name) >= 9 AND p_size % 4 >= 2) * 100.0 / count(*) + 0.5) / 100 AS confidence FROM part")
def completeness(spark, sf):
    q = table(spark, sf, "part").select(F.substring("p_name", 2, 100).alias("stem"), F.array_repeat(F.lit("o"), F.col("p_size") % 4).alias("options"))
    return quality.completeness(q)


@query("read_quality", "SELECT event_type AS doc, round_even(avg(value / 500) FILTER (WHERE user_id % 2 = 0), 3) AS confidence, count(*) FILTER (WHERE user_id % 2 = 0 AND value / 500 < 0.8) AS low, count(*) FILTER (WHERE user_id % 2 = 0) AS lines, round_even(count(*) FILTER (WHERE user_id % 2 = 0 AND value / 500 < 0.8) / count(*) FILTER (WHERE user_id % 2 = 0), 3) AS ratio FROM events GROUP BY 1")
def read_quality(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("doc"), F.when(F.col("user_id") % 2 == 0, "ocr").otherwise("text").alias("source"), F.lit("t").alias("text"), (F.col("value") / 500).alias("score"))
    return quality.read_quality(e)


@query("channel_routing", f"SELECT l_orderkey, CASE WHEN a >= 3 THEN 'solutions' WHEN taxed >= 4 THEN 'graphics' WHEN n > 0 AND whole * 2 >= n THEN 'questions' WHEN r > 0 THEN 'essays' WHEN n > 0 THEN 'questions' ELSE 'preserved' END AS channel FROM ({_OF_ORDER})")
def channel_routing(spark, sf):
    """Q-4: orders as documents, counts of their lines as what was found in them."""
    d = _of_order(spark, sf).select("l_orderkey", F.col("a").alias("solution_marks"), F.col("taxed").alias("graphic_pages"), F.col("n").alias("questions"), F.col("whole").alias("complete_questions"), F.col("r").alias("essay_units"))
    return quality.route(d).select("l_orderkey", "channel")


@query("candidate_validation", "SELECT p_partkey AS doc, CASE WHEN p_size % 3 = 0 THEN 'essay' ELSE 'single' END AS type, CASE WHEN p_partkey % 9 > 0 THEN CAST(1990 + p_size AS INT) END AS year, CAST(CASE WHEN p_size % 7 = 0 THEN 2 ELSE least(5, p_size % 7) END AS INT) AS difficulty, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'low_confidence,' END || 'short_explanation' AS warnings FROM part WHERE p_partkey % 8 > 0 AND p_size % 3 <> 1")
def candidate_validation(spark, sf):
    option = lambda k: F.struct(F.lit(k).alias("key"), F.lit(" t ").alias("text"))
    stem, size = F.when(F.col("p_partkey") % 8 == 0, " tiny ").otherwise(F.col("p_name")), F.col("p_size")
    item = F.struct(
        F.lit("question").alias("kind"), stem.alias("stem"), F.slice(F.array(option("a"), option("B")), 1, size % 3).alias("options"), F.array(F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b")).alias("answer"),
        F.when(F.col("p_partkey") % 9 == 0, 1500).otherwise(1990 + size).alias("year"), (size % 7).alias("difficulty"), F.when(size % 2 == 0, 0.9).otherwise(0.5).alias("confidence"),
    )
    # The same item twice: the second is dropped.
    reply = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct(F.array(item, item).alias("items"))), F.lit("\n```"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), F.lit(0).alias("chunk_no"), F.lit("").alias("chunk"), reply.alias("reply"))
    return extraction.candidates(p).select("doc", "type", "year", "difficulty", F.array_join("warnings", ",").alias("warnings"))


@query("evidence_status", "SELECT l_suppkey, l_linenumber, CASE WHEN n = 0 THEN 'unavailable' WHEN unknown > 0 OR n > 60 THEN 'partial' ELSE 'available' END AS status FROM (SELECT l_suppkey, l_linenumber, count(DISTINCT l_partkey) FILTER (WHERE l_partkey >= 1 AND l_returnflag <> 'A') AS n, count(*) FILTER (WHERE l_tax > 0.07 AND l_discount > 0.09) AS unknown FROM lineitem GROUP BY 1, 2)")
def evidence_status(spark, sf):
    """Q-5: a supplier's parts as the pages that a line of evidence names."""
    pages = F.collect_list(F.when(F.col("l_returnflag") != "A", F.col("l_partkey").cast("int")))
    unknown = F.count_if((F.col("l_tax") > 0.07) & (F.col("l_discount") > 0.09))
    e = _li(spark, sf).groupBy("l_suppkey", "l_linenumber").agg(pages.alias("p"), unknown.alias("u"))
    return e.select("l_suppkey", "l_linenumber", quality.evidence_status(F.col("p"), F.col("u")).alias("status"))


@query("case_accuracy", "SELECT lang AS feature, count(*) AS cases, round(avg(CASE WHEN contains(text, '###') OR length(text) < 20 THEN 0 ELSE 1 END), 4) AS accuracy FROM documents GROUP BY 1")
def case_accuracy(spark, sf):
    """Junk and very short texts are failures."""
    fails = F.array_compact(F.array(F.when(F.col("text").contains("###"), "junk"), F.when(F.char_length("text") < 20, "short")))
    return evaluation.passed(_docs(spark, sf).select(F.col("lang").alias("feature"), fails.alias("failures")))


@query("paragraph_rebuild")
def paragraph_rebuild(spark, sf):
    @F.pandas_udf("string")
    def rebuild(texts):
        return texts.map(parsers.rebuilt, na_action="ignore")

    return _docs(spark, sf).select("doc_id", F.md5(rebuild("text")).alias("h"))
