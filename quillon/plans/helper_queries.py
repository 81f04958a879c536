"""Queries over helpers of layout, pairing, evidence and text that no other query runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon.functions import json as J
from quillon.functions import text as T
from quillon.operators import layout, pairing, quality, versions
from quillon.plans.ingest_queries import _li
from quillon.plans.model import attempts, favorites, questions, table
from quillon.plans.registry import query
from quillon.sources import parsers


@query("envelopes", """SELECT p_partkey, concat('<part>', chr(10), '{"p_partkey":', p_partkey, ',"p_name":"', p_name, '","p_size":', p_size, '}', chr(10), '</part>') AS envelope FROM part""")
def envelopes(spark, sf):
    """Every part as a labelled payload."""
    return table(spark, sf, "part").select("p_partkey", J.envelope("part", F.struct("p_partkey", "p_name", "p_size")).alias("envelope"))


@query("reset_tables", "SELECT 'attempts' AS name, 0 AS rows UNION ALL SELECT 'favorites', 0 UNION ALL SELECT 'questions', count(*) FROM questions")
def reset_tables(spark, sf):
    """What the user has done goes, the content stays."""
    held = {"attempts": attempts(spark, sf), "favorites": favorites(spark, sf), "questions": questions(spark, sf)}
    left = versions.emptied(held, ["attempts", "favorites"])
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("clean_titles", "SELECT p_partkey, concat(p_name, ' ', lower(p_type)) AS title FROM part")
def clean_titles(spark, sf):
    """Headings as a table of contents prints them, numbered, with leaders and page numbers."""
    name = F.concat("p_name", F.lit(" "), F.lower("p_type"))
    printed = F.when(F.col("p_size") <= 25, F.concat(F.lit("（一） "), "p_partkey", F.lit("、"), name, F.lit(" …… 12"))).otherwise(F.concat(F.lit("- 3. "), name, F.lit("（"), "p_brand", F.lit("）...... 7")))
    numbered = F.when(F.col("p_partkey") > 999, F.concat(F.lit("12. "), name)).otherwise(printed)
    return table(spark, sf, "part").select("p_partkey", T.clean_title(numbered).alias("title"))


_MATERIAL = "concat('材料1', chr(10), p_name, chr(10), '材料2', chr(10), p_type)"


@query("referenced_materials", f"SELECT p_partkey, CASE WHEN p_size <= 10 THEN {_MATERIAL} WHEN p_size <= 30 THEN concat('材料2', chr(10), chr(10), p_type) ELSE concat('材料1', chr(10), chr(10), p_name, chr(10), chr(10), '材料2', chr(10), chr(10), p_type) END AS material FROM part")
def referenced_materials(spark, sf):
    """Questions that name none, one or both of two materials."""

    @F.pandas_udf(StringType())
    def referenced(material: pd.Series, question: pd.Series) -> pd.Series:
        return pd.Series([parsers.referenced_material(m, q) for m, q in zip(material, question)])

    material = F.concat(F.lit("材料1\n"), "p_name", F.lit("\n材料2\n"), "p_type")
    asked = F.when(F.col("p_size") <= 10, "概括要点").when(F.col("p_size") <= 30, "根据资料2回答").otherwise("根据材料2和资料1回答")
    return table(spark, sf, "part").select("p_partkey", referenced(material, asked).alias("material"))


_LINES = "(SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 4)"


def _four(spark, sf):
    return _li(spark, sf).filter("l_linenumber <= 4").select("l_orderkey", F.col("l_linenumber").alias("n")).distinct()


@query("bound_options", f"SELECT l_orderkey AS doc, chr(64 + l_linenumber) AS key, concat('i', l_linenumber) AS img_path, CAST(20 AS DOUBLE) AS gap FROM {_LINES}")
def bound_options(spark, sf):
    """Labels in a row, each with its image below it, between others out of reach."""
    n = F.col("n")
    x = n * 100.0
    label = F.struct((n * 2).alias("region_no"), F.lit("text").alias("type"), F.array(x, F.lit(0.0), x + 10, F.lit(20.0)).alias("bbox"), F.lit("").alias("img_path"), F.concat(F.char(n + 64), F.lit(".")).alias("text"))
    image = F.struct((n * 2 + 1).alias("region_no"), F.lit("image").alias("type"), F.array(x - 20, F.lit(30.0), x + 40, F.lit(80.0)).alias("bbox"), F.concat(F.lit("i"), n).alias("img_path"), F.lit("").alias("text"))
    far = F.struct((n * 2 + 100).alias("region_no"), F.lit("image").alias("type"), F.array(x - 20, F.lit(900.0), x + 40, F.lit(950.0)).alias("bbox"), F.lit("far").alias("img_path"), F.lit("").alias("text"))
    regions = _four(spark, sf).select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.explode(F.array(label, image, far)).alias("r")).select("doc", "page", "r.*")
    return layout.bound_options(regions).select("doc", "key", "img_path", "gap")


@query("merged_figures", f"SELECT l_orderkey AS doc, CAST(3 * l_linenumber AS INT) AS region_no FROM {_LINES}")
def merged_figures(spark, sf):
    """Of each line a figure, one that nearly covers it, and a banner."""
    n = F.col("n")
    x = n * 0.2
    boxes = [F.array(x, F.lit(0.1), x + 0.1, F.lit(0.3)), F.array(x, F.lit(0.1), x + 0.1, F.lit(0.28)), F.array(F.lit(0.0), n * 0.1, F.lit(1.0), n * 0.1 + 0.02)]
    figures = F.array(*(F.struct((n * 3 + i).alias("region_no"), F.lit("image").alias("type"), b.alias("bbox")) for i, b in enumerate(boxes)))
    regions = _four(spark, sf).select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.explode(figures).alias("r")).select("doc", "page", "r.*")
    return layout.merged_figures(regions).select("doc", "region_no")


@query("pair_by_position", "SELECT o AS book, n AS num, n AS solution_num, CAST(-1 AS INT) AS offset FROM (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem) WHERE (o, n) NOT IN (SELECT (l_orderkey, min(l_linenumber)) FROM lineitem GROUP BY l_orderkey)")
def pair_by_position(spark, sf):
    """Booklets whose first solution is lost, so that each question goes with the solution one place before its own."""
    # Few bytes make many texts: lines are dealt out by book before they have any, to parts that no task is put together from.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 32 * spark.sparkContext.defaultParallelism)
    lines = _li(spark, sf).select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("num")).repartition(parts, "book").distinct()
    # Digits of 64 kinds: with the 16 of a printed hash, two texts of some ten million are alike by chance.
    text = F.base64(F.unhex(F.sha2(F.concat_ws("-", F.col("book").cast("string"), F.col("num").cast("string")), 512)))
    q = lines.select("book", F.lit(1).alias("set_no"), "num", text.alias("stem"), F.col("num").alias("line_no"))
    later = lines.withColumn("first", F.min("num").over(Window.partitionBy("book"))).filter("num <> first or num is null")
    s = later.select("book", F.lit(1).alias("set_no"), "num", F.col("num").alias("line_no"), F.lit("A").alias("answer"), text.alias("excerpt"))
    return pairing.by_position(q, s).select("book", "num", "solution_num", "offset")


@query("trace_coverage", """WITH o AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(sum(a) AS BIGINT) AS exact, CAST(sum(n - a) AS BIGINT) AS estimated,
    count(*) FILTER (WHERE a = n) AS available, count(*) FILTER (WHERE a > 0 AND a < n) AS partial, count(*) FILTER (WHERE a = 0) AS unavailable FROM o""")
def trace_coverage(spark, sf):
    """Orders as evidence, their lines as pages that are exact or estimated."""
    exact = F.col("l_returnflag") == "A"
    page = F.struct(F.col("l_linenumber").alias("page"), exact.alias("exact"))
    orders = _li(spark, sf).groupBy("l_orderkey").agg(F.count_if(exact).alias("a"), F.count("*").alias("n"), F.array(F.struct(F.collect_list(page).alias("pages"))).alias("references"))
    status = F.when(F.col("a") == F.col("n"), "available").when(F.col("a") > 0, "partial").otherwise("unavailable")
    return quality.trace_coverage(orders.select(status.alias("status"), "references"))
