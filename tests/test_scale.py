"""Hot keys and large orders: the same results in bounded tasks."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillon.operators import evaluation, layout, ordering, pairing, versions
from quillon.sources import parsers as P
from quillon.sources import sinks, table_functions


@pytest.mark.parametrize("small", [0, 7, 10_000])
def test_exact_medians(spark, small):
    r = random.Random(5)
    rows = [("hot", r.choice([r.random() * 1000, 5.0, -1e300, 1e300, r.gauss(0, 1e-9)])) for _ in range(601)]
    rows += [("one", 3.5), ("two", 1.0), ("two", 2.0), ("same", 4.0), ("same", 4.0), ("same", 4.0), ("none", None)]
    rows += [("even", float(x)) for x in range(100)] + [(None, 1.0), (None, 9.0)]
    df = spark.createDataFrame(rows, "engine string, ms double")
    got = {x["engine"]: x["median"] for x in ordering.medians(df, "engine", "ms", small, 8).collect()}
    want = {k: statistics.median([v for e, v in rows if e == k and v is not None]) for k in ("hot", "one", "two", "same", "even")}
    assert {k: got[k] for k in want} == want and "none" not in got
    runs = df.withColumns({"rss": F.lit(1), "error": F.lit(None).cast("string")})
    assert {x["engine"]: (x["pages"], x["median_ms"]) for x in evaluation.timings(runs, max(small, 1)).collect() if x["engine"] in ("none", "two")} == {"none": (1, None), "two": (2, 1.5)}


def test_eviction_with_all_entries_at_one_time(spark):
    r = random.Random(6)
    at = datetime(2024, 1, 1)
    rows = [(f"k{i:04d}", r.randrange(100), at if i < 900 else at - timedelta(hours=r.randrange(50))) for i in range(1000)]
    df = spark.createDataFrame(rows, "key string, bytes long, used_at timestamp_ntz").repartition(5)
    total, want = 0, set()
    for key, size, _ in sorted(rows, key=lambda x: (-x[2].timestamp(), x[0])):
        total += size
        if total > 20_000:
            want.add(key)
    for per_task in (37, 10_000):
        assert {x["key"] for x in versions.evicted(df, 20_000, per_task).collect()} == want and want
    totals = ordering.running_total(df, "bytes", [F.asc("key")], per_task=100)
    largest = totals.count()
    assert largest == 1000 and totals.agg(F.max("total")).first()[0] == sum(x[1] for x in rows)
    assert versions.evicted(df.limit(0), 5).count() == 0


def test_a_file_of_many_pieces(spark, tmp_path):
    n = 30_000
    rows = spark.range(n).select(F.lit("all").alias("subject"), F.col("id"), F.concat(F.lit("stem <"), "id", F.lit(">")).alias("stem"), F.array(F.struct(F.lit("A").alias("key"), F.lit("x").alias("text"))).alias("options"), F.array(F.lit("A")).alias("answer"), F.lit("").alias("note"))
    rows = rows.unionByName(rows.limit(3).withColumn("subject", F.lit("few/odd"))).unionByName(rows.limit(1).withColumn("subject", F.lit(None).cast("string")))
    path = str(tmp_path / "out")
    made = {r["name"]: (r["rows"], r["bytes"]) for r in sinks.write_library(rows, path, per_task=2_000).collect()}
    assert {k: v[0] for k, v in made.items()} == {"all.md": n, "few_odd.md": 3, "item.md": 1}
    want = {r["subject"]: r["text"] for r in sinks.library_document(rows).collect()}
    assert (tmp_path / "out/all.md").read_text() == want["all"] + "\n" and (tmp_path / "out/few_odd.md").read_text() == want["few/odd"] + "\n"
    assert made["all.md"][1] == (tmp_path / "out/all.md").stat().st_size
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    with pytest.raises(FileExistsError):
        sinks.write_library(rows, path)
    sinks.write_library(rows.filter("subject like 'few%'"), str(tmp_path / "h"), html=True)
    page = (tmp_path / "h/few_odd.html").read_text()
    assert page.startswith("<!doctype html>") and "stem &lt;0&gt;" in page
    assert sinks.write_library(rows.limit(0), str(tmp_path / "empty")).count() == 0 and (tmp_path / "empty").is_dir()


def test_one_file_a_question(spark, tmp_path):
    q = spark.createDataFrame([("q1", "c", "s"), ("a/b", "c", "t"), ("a_b", "c", "u")], "id string, category string, stem string").select("*", F.array().cast("array<struct<key:string,text:string>>").alias("options"), F.array(F.lit("A")).alias("answer"), F.lit(2).alias("difficulty"), F.array(F.lit("t")).alias("tags"), F.lit("").alias("explanation"))
    sinks.write_markdown(q, str(tmp_path / "md"))
    names = sorted(p.name for p in (tmp_path / "md").iterdir())
    assert len(names) == 3 and {"q1.md", "a_b.md"} <= set(names)
    from quillon.sources import readers

    assert sorted(r["id"] for r in readers.parse_markdown(readers.files(spark, str(tmp_path / "md"))).collect()) == ["a/b", "a_b", "q1"]


def test_packages_appear_whole(spark, tmp_path):
    t = spark.createDataFrame([(1, None), (2, "x")], "id long, v string")
    with pytest.raises(Exception, match="killed"):
        sinks.package({"a": t, "b": t.select(F.raise_error(F.lit("killed")).alias("id"))}, str(tmp_path / "p"))
    assert not (tmp_path / "p").exists()
    sinks.package({"a": t, "b": t.limit(0)}, str(tmp_path / "p"))
    assert {k: v.count() for k, v in sinks.read_package(spark, str(tmp_path / "p")).items()} == {"a": 2, "b": 0}
    with pytest.raises(FileExistsError):
        sinks.package({"a": t}, str(tmp_path / "p"))
    t.withColumn("v", F.lit("y")).write.mode("overwrite").parquet(str(tmp_path / "p/a"))  # as many rows, other contents
    with pytest.raises(ValueError):
        sinks.read_package(spark, str(tmp_path / "p"))


def plain_run(a, b):
    return max((n for n in range(1, min(len(a), len(b)) + 1) for i in range(len(a) - n + 1) if a[i : i + n] in b), default=0)


def test_longest_common_run():
    r = random.Random(7)
    for _ in range(400):
        a, b = ("".join(r.choice("ab中") for _ in range(r.randint(1, 30))) for _ in range(2))
        assert pairing.common_run(a, b) == plain_run(a, b), (a, b)
    long = "".join(r.choice("abcdefgh") for _ in range(60_000))
    assert pairing.common_run(long[:40_000] + "x", "y" + long[10_000:]) == 30_000
    assert pairing.longest_common(None, "a") == pairing.longest_common("", "") == 0.0


def test_sections_by_their_titles(spark):
    q = spark.createDataFrame([(1, s, t, n, 10 * s + n) for s, t in ((0, "类比推理刷题一"), (1, "定义判断刷题一")) for n in (1, 2)], "book int, section int, title string, num int, line_no int")
    s = spark.createDataFrame([(1, s, t, n, 10 * s + n, a + str(n)) for s, t, a in ((0, "定义判断刷题一解析", "D"), (1, "类比推理刷题一解析", "L")) for n in (1, 2)], "book int, section int, title string, num int, line_no int, answer string")
    got = {(r["q_line"], r["answer"]) for r in pairing.by_section(q, s).collect()}
    assert got == {(1, "L1"), (2, "L2"), (11, "D1"), (12, "D2")}


def plain_order(lines):
    """Two columns by a smoothed histogram, the plainest way."""
    def y_then_x(line):
        return line[2][1], line[2][0], line[0]

    width = int(max(line[2][2] for line in lines)) + 1
    if len(lines) < 6 or width <= 2000:
        return sorted(lines, key=y_then_x)
    counts = [0] * width
    for line in lines:
        counts[int((line[2][0] + line[2][2]) / 2)] += 1
    smooth = [sum(counts[max(0, x - 15) : x + 16]) / 31 for x in range(width)]
    first, last = int(width // 2 * 0.4), int(width // 2 * 1.6)
    gap = min(range(first, last), key=lambda x: (round(smooth[x] * 31), x))
    if smooth[gap] < 0.15 * max(smooth) and smooth[gap] < 1:
        sides = [[x for x in lines if ((x[2][0] + x[2][2]) / 2 >= gap) == side] for side in (False, True)]
        return sorted(sides[0], key=y_then_x) + sorted(sides[1], key=y_then_x)
    return sorted(lines, key=y_then_x)


def test_histogram_order_agrees_with_a_plain_version(spark):
    r = random.Random(8)
    rows, want = [], {}
    for page in range(60):
        wide = page % 3 > 0
        lines = []
        for i in range(r.randint(1, 40)):
            x = r.choice([100, 1500]) + r.randrange(200) if page % 2 else r.randrange(1500)
            lines.append((i, page, [float(x), float(r.randrange(3000)), float(x + (r.randrange(400, 900) if wide else 200)), 0.0]))
        rows += [(1, page, i, box) for i, _, box in lines]
        want[page] = [x[0] for x in plain_order(lines)]
    got = layout.histogram_order(spark.createDataFrame(rows, "doc int, page int, region_no int, bbox array<double>"))
    by_page = {}
    for x in got.orderBy("page", "place").collect():
        by_page.setdefault(x["page"], []).append(x["region_no"])
    assert by_page == want and got.filter("column = 1").count() > 50


def test_numbers_that_drifted():
    put = P.with_numbers_in_place
    assert put(["甲1.乙乙乙乙乙1.", "丙丙丙丙丙"]) == ["甲1.乙乙乙乙乙", "1.丙丙丙丙丙"]  # the end of a line comes first
    assert put(["1.起", "前面的文字2.后面3.再后"]) == ["1.起", "2.前面的文字后面3.再后"]  # the due one of several
    assert put(["1.起", "短2.文字", "后面的文字二3.文"]) == ["1.起", "短2.文字", "3.后面的文字二文"]  # too short before it; the one after next
    assert put(["1.起", "见10、2、12的列举", "比例为2.5倍多", "文件a2.png在"]) == ["1.起", "见10、2、12的列举", "比例为2.5倍多", "文件a2.png在"]
    assert put(["1.起", "云服务、2.", "A.选项", "文字"]) == ["1.起", "云服务、", "A.选项", "文字"]  # lost before an option
    assert put(["1.起", "云服务、2.", "", "2024年的事"]) == ["1.起", "云服务、", "", "2. 2024年的事"]
    assert put(["练习题01套", "1.起", "一二三四2.五", "练习题02套", "一二三四1.五"])[-1] == "1.一二三四五"


def test_table_functions(spark):
    assert len(table_functions.register(spark)) == 10
    book = ["练习题01套", "1.第一题的题干", "A.一", "B.二", "C.三", "D.四", "2.第二题的题干", "A.一", "B.二", "C.三", "D.四"]
    docs = spark.createDataFrame([(1, book), (2, ["1.只有一题", "A.甲", "B.乙"]), (3, [])], "doc long, lines array<string>")
    lines = docs.select("doc", F.posexplode("lines").alias("line_no", "line")).withColumn("more", F.lit(1)).repartition(7)
    lines.createOrReplaceTempView("tf_lines")
    for name, parser in table_functions.PARSERS.items():
        got = spark.sql(f"SELECT * FROM {name}(TABLE(tf_lines))")
        want = P.parse_lines(docs, parser)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
    assert spark.sql("SELECT count(*) FROM quillon_questions(TABLE(SELECT * FROM tf_lines WHERE doc = 1))").first()[0] == 2
    texts = spark.createDataFrame([(1, "a\n\nb"), (2, None), (3, "c" * 7000)], "doc long, text string")
    texts.createOrReplaceTempView("tf_texts")
    assert sorted(map(str, spark.sql("SELECT * FROM quillon_chunks(TABLE(tf_texts))").collect())) == sorted(map(str, P.chunk_documents(texts).collect()))
    with pytest.raises(Exception, match="needs"):
        spark.sql("SELECT * FROM quillon_questions(TABLE(tf_texts))").collect()
