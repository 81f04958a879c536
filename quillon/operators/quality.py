"""Quality of imported text: anomalies, tables, recurring lines, page facts, capability, tiers and the publish gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quillon.functions.text import numeric_anomaly
from quillon.storage import cut

# Thresholds of the page-line filter.
EDGE = 0.06
REPEAT_LENGTH, REPEAT_RATIO, REPEAT_PAGES = 30, 0.5, 4
FRAGMENT_LENGTH, FRAGMENT_SCORE, LOW_CONFIDENCE = 2, 0.6, 0.8
PAIRING_WARNING = "配对待确认"


def numeric_anomalies(lines: DataFrame) -> DataFrame:
    """(doc, line_no, line) to doc, kind, lines and up to five samples, the first by line number."""
    found = lines.select("doc", "line_no", F.substring("line", 1, 60).alias("sample"), numeric_anomaly(F.col("line")).alias("kind")).filter("kind is not null")
    counts = found.groupBy("doc", "kind").agg(F.count("*").alias("lines"))
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("doc", "kind").orderBy("line_no"))).filter("n <= 5")
    samples = first.groupBy("doc", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "sample"))), lambda s: s["sample"]).alias("samples"))
    return counts.join(samples, ["doc", "kind"])


def pipe_tables(lines: DataFrame) -> DataFrame:
    """(doc, line_no, line) to one row for each run of lines between bars: doc, first line, rows, ragged."""
    rows = lines.filter(F.col("line").rlike(r"^\s*\|.*\|\s*$")).select("doc", "line_no", (F.size(F.split("line", r"\|", -1)) - 2).alias("cells"))
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("doc").orderBy("line_no"))
    return rows.withColumn("island", island).groupBy("doc", "island").agg(F.min("line_no").alias("first"), F.count("*").alias("rows"), (F.min("cells") != F.max("cells")).alias("ragged")).drop("island")


def html_tables(text: Column) -> Column:
    """For each HTML table of a text: whether its rows have different numbers of cells."""
    tables = F.regexp_extract_all(text, F.lit(r"(?is)(<table.*?</table>)"), 1)
    rows = lambda t: F.regexp_extract_all(t, F.lit(r"(?is)(<tr.*?</tr>)"), 1)
    return F.transform(tables, lambda t: F.size(F.array_distinct(F.transform(rows(t), lambda r: F.regexp_count(r, F.lit(r"(?i)<t[dh][\s>]"))))) > 1)


def table_quality(docs: DataFrame) -> DataFrame:
    """(doc, text) to doc, tables, ragged and confidence (1 - ragged / tables; null without tables)."""
    lines = docs.select("doc", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    piped = pipe_tables(lines).groupBy("doc").agg(F.count("*").alias("t"), F.count_if("ragged").alias("r"))
    html = html_tables(F.col("text"))
    sums = docs.select("doc", F.size(html).alias("ht"), F.size(F.filter(html, lambda x: x)).alias("hr")).join(piped, "doc", "left")
    tables, ragged = F.col("ht") + F.coalesce("t", F.lit(0)), F.col("hr") + F.coalesce("r", F.lit(0))
    return sums.select("doc", tables.cast("long").alias("tables"), ragged.cast("long").alias("ragged"), F.when(tables > 0, F.floor((1 - ragged / tables) * 100 + 0.5) / 100).alias("confidence"))


def completeness(questions: DataFrame) -> DataFrame:
    """(stem, options array) to total, complete and their share, with two decimals."""
    ok = (F.char_length("stem") >= 8) & (F.size("options") >= 2)
    sums = questions.agg(F.count("*").alias("total"), F.count_if(F.coalesce(ok, F.lit(False))).alias("complete"))
    return sums.withColumn("confidence", F.when(F.col("total") > 0, F.floor(F.col("complete") * 100 / F.col("total") + 0.5) / 100).otherwise(0.0))


def recurring_lines(lines: DataFrame, by: str = "pages", length: int = REPEAT_LENGTH) -> DataFrame:
    """(doc, page, text) to the short texts that stand on at least half of four or more pages: doc, text, pages.

    ``text`` is a line, or an array of a page's lines. ``by`` counts different pages, or with "occurrences" every line.

    A text is on no more pages than rows have it. Those rows are counted map-side, an array's equal lines once, and pages are
    only told apart for texts that enough rows have. Where each row is a page of its own the rows are the pages.
    """
    many, paged = isinstance(lines.schema["text"].dataType, ArrayType), by == "pages"
    rows = lines.filter(F.size("text") > 0) if many else lines
    total = cut(rows.groupBy("doc").agg(F.countDistinct("page").alias("total"), F.count("*").alias("_rows")).filter(F.col("total") >= REPEAT_PAGES), "page-totals")
    texts = F.col("text") if not many else F.explode(F.array_distinct("text") if paged else "text")
    short = lines.select("doc", "page", texts.alias("text")).filter((F.char_length("text") > 0) & (F.char_length("text") <= length))
    often = F.col("pages") / F.col("total") >= REPEAT_RATIO
    found = short.groupBy("doc", "text").agg(F.count("*").alias("pages")).join(total, "doc").filter(often)
    if not paged:
        return found.select("doc", "text", "pages")
    found = cut(found, "recurring")
    whole, split = found.filter("total = _rows").select("doc", "text", "pages"), found.filter("total <> _rows").drop("pages")
    if split.isEmpty():
        return whole
    told = short.join(split, ["doc", "text"]).groupBy("doc", "text", "total").agg(F.countDistinct("page").alias("pages")).filter(often)
    return whole.unionByName(told.select("doc", "text", "pages"))


def repeated_headers(lines: DataFrame, least: int = 3, band: float | None = 0.15) -> DataFrame:
    """(doc, page, text, top from 0 to 1) to the texts at the top of at least ``least`` pages; band None: anywhere."""
    top = lines if band is None else lines.filter(F.col("top") < band)
    return top.groupBy("doc", "text").agg(F.countDistinct("page").alias("pages")).filter(F.col("pages") >= least)


def edge_texts(regions: DataFrame, top: float = 160, least: int = 3) -> DataFrame:
    """(doc, page, type, bbox, text) to doc and text of edge noise: discarded texts, and short ones at the top again and again."""
    text = F.trim("text")
    long, bottom = F.char_length(text), F.element_at("bbox", 4)
    seen = regions.select("doc", text.alias("text"), (F.col("type") == "discarded").alias("out"), ((F.col("type") == "text") & (F.size("bbox") == 4) & (bottom < top) & (long <= REPEAT_LENGTH)).alias("head")).filter(F.char_length("text") >= 3)
    counted = seen.groupBy("doc", "text").agg(F.coalesce(F.max("out"), F.lit(False)).alias("out"), F.count_if("head").alias("n"))
    return counted.filter(F.col("out") | (F.col("n") >= least)).select("doc", "text")


def header_images(regions: DataFrame, share: float = 0.25) -> DataFrame:
    """(doc, page, region_no, type, bbox, img_path) to the small images at the top that stand in one place on many pages.

    Returns doc and img_path. "One place" is first-fit clustering within a tolerance, in reading order; equal boxes
    always share a cluster, so only a document's different boxes are clustered, and pages are counted apart.
    Many: two of up to three pages, else ``share`` of the pages and three at least. Null boxes and pages take no part.
    """
    left, up, right, low = (F.col("bbox")[i] for i in range(4))
    box = F.struct(left.alias("x"), up.alias("y"), (right - left).alias("w"), (low - up).alias("h"))
    pages = regions.groupBy("doc").agg((F.max("page") + 1).alias("total"))
    small = regions.filter((F.col("type") == "image") & (F.char_length("img_path") > 0) & (F.size("bbox") == 4)).select("doc", "page", "region_no", "img_path", box.alias("box"), low.alias("low"))
    # How low, high and wide the image of a header is, and how far apart two may stand.
    small = small.filter((F.col("low") < 155) & (F.col("box.h") > 0) & (F.col("box.h") < 130) & (F.col("box.w") > 0) & (F.col("box.w") < 420) & F.col("page").isNotNull())
    boxes = small.groupBy("doc", "box").agg(F.min(F.struct("page", "region_no")).alias("first")).select("doc", "box.*", "first.*")
    kind = regions.schema["doc"].dataType.simpleString()

    def cluster(frame):
        frame = frame.sort_values(["page", "region_no", "x", "y", "w", "h"])
        heads, found = [], []
        for at in frame[["x", "y", "w", "h"]].itertuples(index=False, name=None):
            fits = (n for n, head in enumerate(heads) if all(abs(a - b) <= t for a, b, t in zip(at, head, (35, 25, 35, 25))))
            n = next(fits, len(heads))
            heads += [at] if n == len(heads) else []
            found.append(n)
        return frame.assign(cluster=found)[["doc", "x", "y", "w", "h", "cluster"]]

    clustered = boxes.select("doc", *(F.col(c).cast("double").alias(c) for c in "xywh"), "page", "region_no").groupBy("doc").applyInPandas(cluster, f"doc {kind}, x double, y double, w double, h double, cluster int")
    flat = small.select("doc", "page", "img_path", *(F.col(f"box.{c}").cast("double").alias(c) for c in "xywh"))
    of_cluster = flat.join(clustered, ["doc", "x", "y", "w", "h"])
    many = of_cluster.groupBy("doc", "cluster").agg(F.countDistinct("page").alias("n")).join(pages, "doc")
    many = many.filter(F.col("n") >= F.when(F.col("total") <= 3, 2).otherwise(F.greatest(F.lit(3), F.ceil(F.col("total") * share))))
    return of_cluster.join(many.select("doc", "cluster"), ["doc", "cluster"], "left_semi").select("doc", "img_path").distinct()


def without_edge_noise(docs: DataFrame, texts: DataFrame, images: DataFrame) -> DataFrame:
    """(doc, text) with the document's noise texts, longest first, and links to its header images taken out."""
    held = texts.groupBy("doc").agg(F.array_sort(F.collect_set("text"), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)).alias("_texts"))
    names = F.concat(F.lit(r"!\[[^\]]*\]\([^)]*\Q"), F.regexp_extract("img_path", "([^/]*)$", 1), F.lit(r"\E\)\s*"))
    linked = images.groupBy("doc").agg(F.array_sort(F.collect_set(names)).alias("_links"))
    none = F.array().cast("array<string>")
    bare = F.aggregate(F.coalesce("_texts", none), F.col("text"), lambda t, x: F.replace(t, x, F.lit("")))
    joined = docs.join(held, "doc", "left").join(linked, "doc", "left").withColumn("text", bare)
    return joined.withColumn("text", F.aggregate(F.coalesce("_links", none), F.col("text"), lambda t, x: F.regexp_replace(t, x, F.lit("")))).select(*docs.columns)


def kept_lines(lines: DataFrame, number: str = r"^[0-9]{1,3}\s*[.、．]") -> DataFrame:
    """(doc, page, text, score, top, bottom, height) without page numbers, fragments, recurring lines and page edges."""
    low, high = F.col("top") < F.col("height") * EDGE, F.col("bottom") > F.col("height") * (1 - EDGE)
    inside = (F.col("bottom") < F.col("height") * EDGE) | (F.col("top") > F.col("height") * (1 - EDGE))
    again = recurring_lines(lines).select("doc", "text", F.lit(True).alias("_again"))
    joined = lines.join(again, ["doc", "text"], "left")
    keep = (
        F.when(F.col("text") == "", False)
        .when(F.col("text").rlike("^[0-9]{1,3}$"), ~F.coalesce(low | high, F.lit(False)))
        .when(F.col("text").rlike(number), True)
        .when((F.char_length("text") <= FRAGMENT_LENGTH) & (F.col("score") < FRAGMENT_SCORE), False)
        .when(F.col("_again").isNotNull(), False)
        .otherwise(~F.coalesce(inside, F.lit(False)))
    )
    return joined.filter(keep).drop("_again")


def read_quality(lines: DataFrame) -> DataFrame:
    """(doc, source, text, score) to mean confidence, low lines, lines and their ratio, of recognised pages alone."""
    ocr = lines.filter((F.col("source") == "ocr") & (F.col("text") != ""))
    low = F.count_if(F.col("score") < LOW_CONFIDENCE)
    sums = ocr.groupBy("doc").agg(F.bround(F.avg("score"), 3).alias("confidence"), low.alias("low"), F.count("*").alias("lines"), F.bround(low / F.count("*"), 3).alias("ratio"))
    return lines.select("doc").distinct().join(sums, "doc", "left").select("doc", "confidence", F.coalesce("low", F.lit(0)).alias("low"), F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("ratio", F.lit(0.0)).alias("ratio"))


def page_facts(files: DataFrame) -> DataFrame:
    """(total_pages, empty_pages) to one row of facts; empty pages are held to 0..total, and odd reports are counted."""
    known = F.col("total_pages").isNotNull() & (F.col("total_pages") > 0)
    empty = F.greatest(F.lit(0), F.least(F.coalesce("empty_pages", F.lit(0)), F.col("total_pages")))
    odd = known & ((F.col("empty_pages") < 0) | (F.col("empty_pages") > F.col("total_pages")))
    return files.agg(F.count_if(known).alias("known_files"), F.coalesce(F.sum(F.when(known, F.col("total_pages"))), F.lit(0)).cast("long").alias("pages"), F.coalesce(F.sum(F.when(known, empty)), F.lit(0)).cast("long").alias("empty"), F.count_if(odd).alias("odd"))


def capability() -> Column:
    """What a file allows, from graphic_candidate, question_count, structured, figure_images, table_count and numeric_anomalies."""
    return (
        F.when(F.col("graphic_candidate"), "graphic-review")
        .when((F.col("question_count") == 0) & F.col("structured") & (F.col("figure_images") >= 5), "image-only-review")
        .when(F.col("question_count") == 0, "unsupported-auto-structure")
        .when((F.col("table_count") > 0) | (F.col("numeric_anomalies") >= 10), "table-review")
        .otherwise("text-supported")
    )


def tier(kind: Column, able: Column) -> Column:
    plain = able.isNull() | (able == "") | (able == "text-supported")
    return F.when(kind == "document", "preserved-source").when(plain, "structured").otherwise("review-required")


def is_gated(able: Column, warnings: Column) -> Column:
    """Whether an artifact may only be published once a person has confirmed it."""
    bounded = F.coalesce(able, F.lit("")).isin("", "text-supported")
    return ~bounded | F.coalesce(F.exists(warnings, lambda w: F.contains(w, F.lit(PAIRING_WARNING))), F.lit(False))


def gate(artifacts: DataFrame) -> DataFrame:
    """Adds ``allowed``: not gated, or confirmed by a person."""
    return artifacts.withColumn("allowed", ~is_gated(F.col("capability"), F.col("warnings")) | F.coalesce("human_confirmed", F.lit(False)))


def batch_facts(artifacts: DataFrame) -> DataFrame:
    """Artifacts by tier and, of those left out, by reason. One row for each."""
    kinds = artifacts.withColumn("tier", tier(F.col("kind"), F.col("capability")))
    by_tier = kinds.filter("skip_reason is null").groupBy(F.lit("tier").alias("fact"), F.col("tier").alias("value")).agg(F.count("*").alias("n"))
    by_reason = kinds.filter("skip_reason is not null").groupBy(F.lit("skipped").alias("fact"), F.col("skip_reason").alias("value")).agg(F.count("*").alias("n"))
    return by_tier.unionByName(by_reason)


def route(docs: DataFrame) -> DataFrame:
    """Which channel takes a document: solutions, questions, essays, graphics or preserved as it is.

    From solution_marks, questions, complete_questions, essay_units and graphic_pages.
    """
    channel = (
        F.when(F.col("solution_marks") >= 3, "solutions")
        .when(F.col("graphic_pages") >= 4, "graphics")
        .when((F.col("questions") > 0) & (F.col("complete_questions") * 2 >= F.col("questions")), "questions")
        .when(F.col("essay_units") > 0, "essays")
        .when(F.col("questions") > 0, "questions")
        .otherwise("preserved")
    )
    return docs.withColumn("channel", channel)


def evidence_status(pages: Column, unknown: Column, most: int = 60) -> Column:
    """available if every line's page is known and there are at most ``most``; unavailable if none is; else partial."""
    n = F.size(F.array_distinct(F.filter(pages, lambda p: p.isNotNull() & (p >= 1))))
    return F.when(n == 0, "unavailable").when((unknown > 0) | (n > most), "partial").otherwise("available")


def trace_coverage(evidence: DataFrame) -> DataFrame:
    """(status, references array of struct(pages array of struct(page, exact))) to counts of statuses and pages."""
    pages = evidence.select(F.explode("references").alias("r")).select(F.explode("r.pages").alias("p"))
    counted = pages.agg(F.count_if("p.exact").alias("exact"), F.count_if(~F.col("p.exact")).alias("estimated")).withColumn("_k", F.lit(1))
    states = evidence.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("available", "partial", "unavailable"))).withColumn("_k", F.lit(1))
    return states.join(F.broadcast(counted), "_k").drop("_k")


# The names of page types.
SOLUTION, FIGURES, MATERIAL, BLANK, PLAIN = "解析", "图形推理候选", "资料分析", "blank-or-cover", "普通文字"


def page_type(solved: Column, layer_chars: Column, lines: Column, figures: Column, grid: Column, images: Column, numbers: Column) -> Column:
    """Struct of a read page's type and confidence by its signals; the first rule that holds counts, a null signal holds in none.

    solved: whether a mark of answers or explanations stands on it; numbers: how many numbers its lines hold.
    """
    rules = [
        (solved, SOLUTION, 0.9),
        ((images >= 3) & (lines < 30), FIGURES, 0.75),
        ((figures >= 2) & (grid | (numbers >= 60)), MATERIAL, 0.8),
        (grid & (numbers >= 30), MATERIAL, 0.7),
        ((lines <= 3) & (layer_chars < 5) & (figures == 0), BLANK, 0.85),
    ]
    out = [F.when(hit, F.struct(F.lit(kind).alias("type"), F.lit(sure).alias("confidence"))) for hit, kind, sure in rules]
    return F.coalesce(*out, F.struct(F.lit(PLAIN).alias("type"), F.lit(0.6).alias("confidence")))


def unread_page_type(chars: Column, images: Column, solutions: Column, subject: Column, material: str = "资料分析", judgement: str = "判断推理") -> Column:
    """A coarse type of a page that hasn't been read, by its text layer, its images, its booklet and its subject."""
    return (
        F.when((chars < 5) & (images <= 0), BLANK)
        .when(solutions, SOLUTION)
        .when(subject == material, MATERIAL)
        .when((subject == judgement) & (images > 0), FIGURES)
        .otherwise(PLAIN)
    )
