from pyspark.sql import functions as F

from quillon.functions import json as J
from quillon.functions import math as M
from quillon.functions import text as X
from quillon.operators import dedup, evaluation, extraction, layout, pairing, practice, quality, reports, versions
from quillon.plans import practice_queries
from quillon.sources import readers, sinks


def test_by_section(spark):
    s = "book int, section int, title string, num int, line_no int"
    q = spark.createDataFrame([(1, 1, "alpha", 1, 1), (1, 1, "alpha", 2, 2), (1, 2, "beta", 1, 3)], s)
    a = spark.createDataFrame([(1, 1, "beta", 1, 1, "X"), (1, 2, "alpha", 1, 2, "A"), (1, 2, "alpha", 2, 3, "B")], s + ", answer string")
    like = F.when(F.col("q_title") == F.col("s_title"), 1.0).otherwise(0.0)
    assert {(r["q_line"], r["answer"]) for r in pairing.by_section(q, a, like).collect()} == {(1, "A"), (2, "B"), (3, "X")}


def test_exam_review_and_documents(spark):
    e = spark.sql("select 1 as id, array(5L, 6L) as question_ids, map(5L, named_struct('category', 'c', 'answer', array('A'))) as snapshots, map(6L, named_struct('answer', array('B'), 'seconds', 9)) as answers")
    rows = [tuple(r) for r in practice.exam_review(e).orderBy("place").collect()]
    assert rows == [(1, 0, 5, "c", ["A"], [], 0), (1, 1, 6, "", [], ["B"], 9)]
    d = spark.sql("select 2 as id, 's' as subject, 'a<b' as stem, array(named_struct('key', 'A', 'text', 't')) as options, array('A') as answer, 'n' as note")
    assert sinks.library_document(d, notes=True).first()["text"] == "### 2\n\na<b\n\nA. t\n\nAnswer: A\n\nNote: n"
    assert "a&lt;b" in sinks.library_document(d, html=True).first()["text"]


def test_lines_and_evidence(spark):
    lines = spark.createDataFrame([(1, p, t, s, top, top + 5.0, 100.0) for p in range(1, 5) for t, s, top in (("head", 0.9, 20.0), (f"body {p}", 0.9, 50.0), ("7", 0.9, 1.0), ("x", 0.1, 50.0))], "doc int, page int, text string, score double, top double, bottom double, height double")
    assert {r["text"] for r in quality.kept_lines(lines).collect()} == {f"body {p}" for p in range(1, 5)}
    ev = spark.sql("select 'available' as status, array(named_struct('pages', array(named_struct('page', 1, 'exact', true), named_struct('page', 2, 'exact', false)))) as references")
    assert quality.trace_coverage(ev).first().asDict() == {"available": 1, "partial": 0, "unavailable": 0, "exact": 1, "estimated": 1}
    r = spark.createDataFrame([(1, 1, 1, "text", [0.0, 0.2, 0.3, 0.3], "", "b"), (1, 1, 0, "image", [0.0, 0.0, 0.3, 0.1], "p.png", "")], "doc int, page int, region_no int, type string, bbox array<double>, img_path string, text string")
    assert layout.preserved_pages(r).first()["text"] == "![](p.png)\nb"


def test_repair_and_splits(spark):
    assert J.closed('{"a": [1, {"b": "x') == '{"a": [1, {"b": "x"}]}' and J.closed('{"a":') == '{"a":null}' and J.closed(None) is None
    got = evaluation.balanced_split({("s1", "k"): 2, ("s2", "k"): 2, ("s3", "k"): 1}, {"x": {"k": 2}, "y": {"k": 2}})
    assert got is not None and len(set(got.values())) == 2
    assert evaluation.balanced_split({("s1", "k"): 1}, {"x": {"k": 2}}) is None
    page = spark.sql("select 0 as pageNumber, 'odd' as `set`, 'prefill' as annotator, array(named_struct('setNumber', 1, 'number', 5, 'stem', 's'), named_struct('setNumber', 1, 'number', 5, 'stem', ' ')) as questions, array(array(0d, 0d, 1d, 1d)) as boxes")
    assert evaluation.annotation_errors(page).first()["errors"] == ["page", "set", "annotator", "twice", "stem"]


def test_edge_noise(spark):
    s = "doc int, page int, region_no int, type string, bbox array<double>, img_path string, text string"
    rows = [(1, p, 0, "image", [10.0 + 3 * p, 5.0, 110.0 + 3 * p, 60.0], f"d/logo{p}.png", "") for p in range(6)]
    rows += [(1, p, 1, "text", [0.0, 0.0, 9.0, 20.0], "", " 页眉文字 ") for p in range(3)]
    rows += [(1, 0, 2, "image", [200.0, 5.0, 300.0, 60.0], "d/once.png", ""), (1, 0, 3, "image", [10.0, 300.0, 110.0, 400.0], "d/body.png", ""), (1, 1, 4, "discarded", None, None, "水印水印"), (1, None, 5, "image", None, None, None), (None, 0, 0, "text", None, None, None)]
    regions = spark.createDataFrame(rows, s)
    texts, images = quality.edge_texts(regions), quality.header_images(regions)
    assert {r["text"] for r in texts.collect()} == {"页眉文字", "水印水印"}
    assert {r["img_path"] for r in images.collect()} == {f"d/logo{p}.png" for p in range(6)}
    docs = spark.createDataFrame([(1, "页眉文字题干![x](a/logo2.png) ![](d/once.png)水印水印", 7), (2, None, 8), (3, "页眉文字", 9)], "doc int, text string, k int")
    got = {r["doc"]: (r["text"], r["k"]) for r in quality.without_edge_noise(docs, texts, images).collect()}
    assert got == {1: ("题干![](d/once.png)", 7), 2: (None, 8), 3: ("页眉文字", 9)}
    assert quality.header_images(spark.createDataFrame([], s)).count() == 0


def test_extraction_with_a_model_of_the_callers(spark):
    docs = spark.createDataFrame([(1, "第一段的文字" * 20 + "\n\n" + "x" * 2990), (2, None)], "doc int, text string")
    question = '{"kind":"question","subject":"xingce","stem":"题干题干题干","options":[{"key":"a","text":"t"},{"key":"b","text":"u"}],"answer":["b"],"year":"2020","difficulty":9,"confidence":0.9,"explanation":"足够长的解析内容","evidenceExcerpt":"第一段 的文字"}'
    document = '{"title":"标题","content":"' + "内容" * 30 + '","confidence":"?"}'
    bad = '{"kind":"question","stem":"题干题干题干","options":[],"answer":[]},{"title":"扫码","content":"' + "扫码" * 30 + '"},7'
    ask = lambda r: r.withColumn("reply", F.when(F.col("chunk_no") == 0, F.lit(f'```json\n{{"items":[{question},{document},{bad},{question}]}}\n```')).otherwise(F.lit(f"[{question}]")))
    got = sorted(extraction.extracted(docs, ask).collect(), key=lambda r: r["kind"])
    assert [(r["doc"], r["chunk_no"], r["kind"], r["subject"], r["warnings"], r["confidence"], r["title"]) for r in got] == [(1, 0, "document", "common", ["low_confidence"], 0.5, "标题"), (1, 0, "question", "xingce", [], 0.9, "题干题干题干")]
    assert got[1]["type"] == "single" and got[1]["answer"] == ["B"] and got[1]["year"] == 2020 and got[1]["difficulty"] == 5 and len(got[0]["id"]) == 27 and got[0]["category"] == "未分类"
    review = lambda r: r.withColumn("reply", F.lit("nothing"))
    assert extraction.extracted(docs, ask, review).count() == 0 and extraction.extracted(docs, ask, mode="questions").count() == 1


def test_small_expressions(spark):
    one = spark.range(1)
    score = lambda t, k: tuple(one.select(X.essay_score(F.lit(t), F.array(*map(F.lit, k)).cast("array<string>")).alias("s")).first()["s"])
    assert score("首先做甲\n其次做乙" + "字" * 100, ["甲", "丙"]) == (79, 70, 87, 88)
    assert score("短", []) == (64, 73, 55, 55)
    w = one.select(J.warnings(F.array(*map(F.lit, [" a ", "a", "", "b" * 300, "c", "d", "e", "f"]))).alias("w")).first()["w"]
    assert w == ["a", "b" * 200, "c", "d", "e"]
    assert one.select(J.tags(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("Y"), F.lit("Z"))).alias("t")).first()["t"] == ["x", "y", "z"]
    box = lambda *v: F.array(*map(F.lit, v))
    assert one.select(M.iou(box(0.0, 0.0, 2.0, 2.0), box(1.0, 0.0, 3.0, 2.0)).alias("i")).first()["i"] == 2 / 6
    assert abs(one.select(M.reading_score(box(0.5, 0.7), F.array(F.lit("a1"), F.lit("b"))).alias("r")).first()["r"] - 0.61) < 1e-12


def test_reviews_and_readers(spark, tmp_path):
    a = spark.createDataFrame([(1, "approved", True), (2, "approved", False), (3, "pending", True)], "id int, status string, allowed boolean")
    assert [r["status"] for r in versions.published(a).orderBy("id").collect()] == ["published", "approved", "pending"]
    assert [r["id"] for r in versions.reverted(spark.range(1, 5), a).collect()] == [4]
    (tmp_path / "r.json").write_text('{"doc":1,"page":0,"region_no":0,"type":"text","bbox":[0,0,1,1],"text":"t"}\n')
    assert readers.regions(spark, str(tmp_path)).first()["bbox"] == [0.0, 0.0, 1.0, 1.0]
    pages = spark.sql("select 1 as doc, 2 as page, array(named_struct('type', 'figure', 'bbox', array(0.0D), 'text', null, 'path', 'p'), named_struct('type', 'table', 'bbox', array(1.0D), 'text', 'x', 'path', null)) as blocks")
    assert [(r["region_no"], r["type"], r["img_path"], r["text"]) for r in readers.blocks(pages).collect()] == [(0, "image", "p", ""), (1, "table", "", "x")]
    row = spark.sql("select 'c' as category, 'k' as cause, 3 as attempts, 50.0 as accuracy, 120 as seconds, 40 as mean_seconds").first()
    text = sinks.report(row, [row], [row])
    assert "3 attempts, 50.0 % right, 2 minutes" in text and "| c | 3 | 50.0 | 40 |" in text
    clusters = spark.createDataFrame([(1, 2, 0.9), (2, 5, 0.8)], "cluster int, size int, similarity double")
    assert sinks.cluster_report(clusters, 1).splitlines()[-1] == "| 2 | 5 | 0.8 |"


def test_advice_and_plans(spark):
    weak = spark.createDataFrame([("a", 3, 40.0), ("b", 9, 40.0), ("c", 1, 70.0), ("d", 1, 75.0)], "category string, attempts long, accuracy double")
    total = lambda n, a: spark.createDataFrame([(n, a)], "attempts long, accuracy double")
    causes = spark.createDataFrame([("x", 2), ("y", 5)], "cause string, attempts long")
    rows = lambda *a: [tuple(r)[1:3] for r in reports.recommendations(*a).orderBy("place").collect()]
    assert rows(total(9, 59.9), weak, causes) == [("basics", ""), ("weakest", "b"), ("cause", "y")]
    assert rows(total(0, 0.0), weak.limit(0), causes.filter("false")) == [("first_assessment", "")]
    assert rows(total(9, 80.0), weak.limit(0), spark.sql("select '(unlabelled)' as cause, 3L as attempts")) == [("timed_exams", "")]
    p = [tuple(r) for r in reports.plan(weak, 4, 300).orderBy("day", "slot").collect()]
    assert p[:3] == [(1, 1, "read_knowledge", "b", 75), (1, 2, "official_practice", "b", 50), (1, 3, "official_review", "b", 5)]
    assert [r[3] for r in p[::3]] == ["b", "a", "c", "b"] and p[8] == (3, 3, "ai_variant", "c", 3)
    assert {r["category"] for r in reports.plan(weak.limit(0)).collect()} == {"综合能力"} and reports.plan(weak, 99, 1, ["q"]).count() == 90


def test_document_search_has_no_limit(spark, tmp_path):
    rows = [(i, f"a License {i}", "en", "s") for i in range(600)] + [(600, "none", "en", "s"), (601, "license", "fr", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = practice_queries.document_search(spark, str(tmp_path)).collect()
    assert [r["doc_id"] for r in found] == list(range(600))


def test_large_groups_of_copies_stay_whole(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf at night"
    rows = [(i, base + "!" * (i % 3)) for i in range(620)] + [(1000, base + " x"), (2000, "entirely other words without any tie 12345")]
    texts = spark.createDataFrame(rows, "id long, text string")
    near = {(r["a"], r["b"]): (r["kind"], r["similarity"]) for r in dedup.near_links(texts).collect()}
    assert len(near) == 620 and near[0, 619] == ("copy", 1.0) and near[0, 1000][0] == "near" and 0.9 < near[0, 1000][1] < 1
    assert [tuple(r) for r in dedup.duplicate_clusters(texts).collect()] == [(0, 621, 1.0)]
    prints = spark.createDataFrame([(i, "01" * 32) for i in range(620)] + [(999, "10" * 32)], "id long, fp string")
    assert dedup.candidate_pairs(dedup.banded(prints)).count() == 620 * 619 // 2
    assert sorted(map(tuple, dedup.candidate_links(prints).collect())) == [(0, i, "copy") for i in range(1, 620)]
