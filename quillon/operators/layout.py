"""Geometry of page layouts: reading order, graphic questions, option binding, figure merging and tables from cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.math import box_is_valid

QUESTION_START = r"^[0-9]{1,3}\s*[.、．]"


def reading_order(regions: DataFrame, gutter: float = 0.5, share: float = 0.35) -> DataFrame:
    """(doc, page, bbox in page units 0 to 1, region_no) with column and place in reading order.

    A page has two columns if a share of its regions lies wholly on either side of the gutter; wide regions of such a
    page belong to the first column.
    """
    x0, x1 = F.element_at("bbox", 1), F.element_at("bbox", 3)
    left, right = x1 <= gutter + 0.02, x0 >= gutter - 0.02
    pages = regions.groupBy("doc", "page").agg(((F.count_if(left) >= share * F.count("*")) & (F.count_if(right) >= share * F.count("*"))).alias("_two"))
    column = F.when(F.col("_two") & right, 1).otherwise(0)
    order = Window.partitionBy("doc", "page").orderBy("column", F.element_at("bbox", 2), x0, "region_no")
    return regions.join(pages, ["doc", "page"]).withColumn("column", column).withColumn("place", F.row_number().over(order)).drop("_two")


def histogram_gutter(centres: list[float], width: float, smooth: int = 31, share: float = 0.15, least_width: float = 2000, least_lines: int = 6) -> int | None:
    """The place between two columns of a page in pixels, or None: the emptiest place of its middle in a smoothed histogram of
    the lines' centres, if it is nearly empty next to the fullest one."""
    size = int(width) + 1
    if len(centres) < least_lines or size <= least_width:
        return None
    counts = np.bincount(np.clip(np.asarray(centres, float).astype(int), 0, size - 1), minlength=size)
    smoothed = np.convolve(counts, np.ones(smooth) / smooth, mode="same")
    first, last = int(size // 2 * 0.4), int(size // 2 * 1.6)
    gap = first + int(np.argmin(smoothed[first:last]))
    return gap if smoothed[gap] < share * smoothed.max() and smoothed[gap] < 1 else None


def histogram_order(regions: DataFrame) -> DataFrame:
    """(doc, page, bbox in pixels, region_no) with column and place in reading order, columns parted by ``histogram_gutter``.

    An alternative to ``reading_order``, which suits pages better on the whole: it is for scans whose gutter is off centre.
    """
    centre = (F.element_at("bbox", 1) + F.element_at("bbox", 3)) / 2

    @F.pandas_udf("int")
    def gutter(centres: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([histogram_gutter(c, w) for c, w in zip(centres, width)], dtype="Int32")

    # A page's lines are few, so its array stays small.
    pages = regions.groupBy("doc", "page").agg(F.collect_list(centre).alias("_c"), F.max(F.element_at("bbox", 3)).alias("_w")).select("doc", "page", gutter("_c", "_w").alias("_gap"))
    column = F.when(centre >= F.col("_gap"), 1).otherwise(0)
    order = Window.partitionBy("doc", "page").orderBy("column", F.element_at("bbox", 2), F.element_at("bbox", 1), "region_no")
    return regions.join(pages, ["doc", "page"]).withColumn("column", column).withColumn("place", F.row_number().over(order)).drop("_gap")


def segments(numbers: DataFrame) -> DataFrame:
    """(doc, place, num) with ``segment``: a new one begins where the number falls or repeats."""
    w = Window.partitionBy("doc").orderBy("place")
    return numbers.withColumn("segment", F.sum((F.col("num") <= F.lag("num").over(w)).cast("int")).over(w)).withColumn("segment", F.coalesce("segment", F.lit(0)))


def grid_sections(ranges: DataFrame) -> DataFrame:
    """(doc, place, start, end) of answer grids with ``section``: a new one at a start of one or a jump of two or more."""
    w = Window.partitionBy("doc").orderBy("place")
    new = F.coalesce((F.col("start") == 1) | (F.col("start") - F.lag("end").over(w) >= 2), F.lit(True))
    return ranges.withColumn("section", F.sum(new.cast("int")).over(w))


def is_graphic(regions: DataFrame, least: int = 4) -> DataFrame:
    """doc and whether at least ``least`` of its pages have a question number and an image."""
    pages = regions.groupBy("doc", "page").agg(F.bool_or((F.col("type") != "image") & F.col("text").rlike(QUESTION_START)).alias("n"), F.bool_or(F.col("type") == "image").alias("i"))
    return pages.groupBy("doc").agg((F.count_if(F.coalesce(F.col("n") & F.col("i"), F.lit(False))) >= least).alias("graphic"))


def is_option_quartet(areas: Column) -> Column:
    """Whether four image areas are alike: each within 0.4 to 1.6 of the lower median."""
    middle = F.element_at(F.array_sort(areas), 2)
    return (F.size(areas) == 4) & F.forall(areas, lambda a: (a >= 0.4 * middle) & (a <= 1.6 * middle))


def page_questions(regions: DataFrame) -> DataFrame:
    """A graphic document's question of each page: doc, page, num, stem, images (by place) and confidence.

    high: a number and four like images or one; medium: a number and other images; low: images alone.
    """
    area = lambda b: (F.element_at(b, 3) - F.element_at(b, 1)) * (F.element_at(b, 4) - F.element_at(b, 2))
    num = F.nullif(F.regexp_extract("text", r"^([0-9]{1,3})\s*[.、．]", 1), F.lit("")).cast("int")
    rows = regions.withColumn("_num", num)
    image = F.col("type") == "image"
    pages = rows.groupBy("doc", "page").agg(
        F.min(F.when(~image, F.col("_num"))).alias("num"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~image, F.struct("region_no", "text")))), lambda s: s["text"]), "").alias("stem"),
        F.array_sort(F.collect_list(F.when(image, F.struct("region_no", "img_path", area(F.col("bbox")).alias("area"))))).alias("_images"),
    )
    n, like = F.size("_images"), is_option_quartet(F.transform("_images", lambda i: i["area"]))
    sure = F.when(F.col("num").isNull(), "low").when((n == 1) | like, "high").otherwise("medium")
    return pages.filter(n > 0).select("doc", "page", "num", "stem", F.transform("_images", lambda i: i["img_path"]).alias("images"), sure.alias("confidence"))


def with_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Add answers by number; questions without one stay."""
    return questions.join(answers.select("doc", "num", "answer"), ["doc", "num"], "left")


def preserved_pages(regions: DataFrame) -> DataFrame:
    """Each page as one text in reading order; images as Markdown."""
    shown = F.when(F.col("type") == "image", F.concat(F.lit("![]("), "img_path", F.lit(")"))).otherwise(F.col("text"))
    ordered = reading_order(regions).withColumn("_shown", shown)
    return ordered.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "_shown"))), lambda s: s["_shown"]), "\n").alias("text"))


def bound_options(regions: DataFrame, reach: float = 260.0) -> DataFrame:
    """Bind option labels A to D to the nearest image below or beside them on their page, each image once.

    Labels are taken by key, then by gap, so the result doesn't depend on the order of rows. A page is one row of its
    labels and images, folded in columns: pages are small and very many. doc, page, key, img_path, gap.
    """
    box = F.col("bbox").cast("array<double>")
    text = F.regexp_replace("text", r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")
    image, mark = F.coalesce(F.col("type") == "image", F.lit(False)), F.substring(text, 1, 1)
    label = ~image & mark.isin(*"ABCD") & (F.char_length(text) <= 2)
    pages = regions.groupBy("doc", "page").agg(
        F.array_sort(F.collect_list(F.when(label, F.struct(mark.alias("key"), "region_no", box.alias("bbox"))))).alias("_labels"),
        F.collect_list(F.when(image, F.struct("region_no", "img_path", box.alias("bbox")))).alias("_images"),
    )

    def bind(held: Column, of: Column) -> Column:
        x, y = (of["bbox"][0] + of["bbox"][2]) / 2, (of["bbox"][1] + of["bbox"][3]) / 2
        apart = lambda low, high, at: F.greatest(low - at, F.lit(0.0), at - high)
        places = F.transform("_images", lambda i: F.struct(apart(i["bbox"][0], i["bbox"][2], x).alias("dx"), apart(i["bbox"][1], i["bbox"][3], y).alias("dy"), i.alias("i")))
        straight = F.filter(places, lambda p: (p["dx"] == 0) | (p["dy"] == 0))
        gaps = F.transform(straight, lambda p: F.struct(F.sqrt(p["dx"] * p["dx"] + p["dy"] * p["dy"]).alias("gap"), p["i"]["region_no"].alias("region_no"), p["i"]["img_path"].alias("img_path")))
        near = F.array_min(F.filter(gaps, lambda g: (g["gap"] <= reach) & ~F.exists(held, lambda h: h["region_no"] == g["region_no"])))
        return F.concat(held, F.transform(F.array_compact(F.array(near)), lambda n: F.struct(of["key"].alias("key"), n["img_path"].alias("img_path"), n["gap"].alias("gap"), n["region_no"].alias("region_no"))))

    none = F.array().cast(f"array<struct<key:string,img_path:string,gap:double,region_no:{regions.schema['region_no'].dataType.simpleString()}>>")
    bound = pages.select("doc", F.col("page").cast("int").alias("page"), F.explode(F.aggregate("_labels", none, bind)).alias("b"))
    return bound.select("doc", "page", "b.key", "b.img_path", "b.gap")


def merged_figures(regions: DataFrame, most: float = 0.4, least_area: float = 0.002, banner: float = 8.0) -> DataFrame:
    """Figures without small and banner-shaped ones, and without those that overlap a kept one (first kept) too much."""
    x0, y0, x1, y1 = (F.col("bbox")[i].cast("double") for i in range(4))
    w, h = x1 - x0, y1 - y0
    shaped = (w * h >= least_area) & F.when(h > 0, w / h <= banner)
    figure = F.struct("region_no", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), (w * h).alias("area"))
    pages = regions.filter("type = 'image'").filter(shaped).groupBy("doc", "page").agg(F.array_sort(F.collect_list(figure)).alias("_figures"))

    def overlaps(a: Column, b: Column) -> Column:
        side = lambda low, high: F.greatest(F.lit(0.0), F.least(a[high], b[high]) - F.greatest(a[low], b[low]))
        common = side("x0", "x1") * side("y0", "y1")
        union = a["area"] + b["area"] - common
        return F.when(union > 0, common / union).otherwise(0.0) > most

    none = F.array().cast(f"array<struct<region_no:{regions.schema['region_no'].dataType.simpleString()},x0:double,y0:double,x1:double,y1:double,area:double>>")
    kept = F.aggregate("_figures", none, lambda held, f: F.when(F.exists(held, lambda k: overlaps(f, k)), held).otherwise(F.concat(held, F.array(f))))
    return pages.select("doc", F.col("page").cast("int").alias("page"), F.explode(kept).alias("f")).select("doc", "page", F.col("f.region_no").cast("int").alias("region_no"))


def table_of_cells(cells: DataFrame, bucket: float = 10.0) -> DataFrame:
    """(doc, page, x, y, text) to rows of a table: cells of one y bucket by x, short rows padded with blanks."""
    rows = cells.groupBy("doc", "page", F.round(F.col("y") / bucket).cast("int").alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda c: c["text"]).alias("cells"))
    width = Window.partitionBy("doc", "page")
    n = F.max(F.size("cells")).over(width)
    return rows.withColumn("cells", F.concat("cells", F.array_repeat(F.lit(""), n - F.size("cells")))).withColumn("row", F.row_number().over(width.orderBy("row")))


def from_manifest(pages: DataFrame) -> DataFrame:
    """(doc, manifest JSON) to doc, page and lines; pages without a positive number are dropped, other texts give none."""
    schema = "struct<pages:array<struct<pageNumber:int,source:string,lines:array<string>>>>"
    parsed = pages.select("doc", F.explode(F.from_json("manifest", schema)["pages"]).alias("p"))
    return parsed.filter("p.pageNumber >= 1").select("doc", F.col("p.pageNumber").alias("page"), F.col("p.source").alias("source"), F.coalesce("p.lines", F.array().cast("array<string>")).alias("lines"))


def manifest_of(regions: DataFrame) -> DataFrame:
    """Pages and their texts in place order, from layout regions."""
    return regions.filter("page >= 1").groupBy("doc", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("region_no", "text"))), lambda s: s["text"]).alias("lines"))


def line_pages(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Label lines (doc, line_no, line) with the page whose line of the same rank among lines that aren't blank it is."""
    rank = F.when(F.trim("line") != "", F.count_if(F.trim("line") != "").over(Window.partitionBy("doc").orderBy("line_no")))
    slots = pages.select("doc", "page", F.posexplode("lines").alias("i", "_")).withColumn("_rank", F.row_number().over(Window.partitionBy("doc").orderBy("page", "i")))
    return lines.withColumn("_rank", rank).join(slots.select("doc", "_rank", "page"), ["doc", "_rank"], "left").drop("_rank")


def valid_evidence(regions: DataFrame, pages: int | None = None) -> DataFrame:
    """Adds ``valid``: a box within the page and, if the number of pages is known, a page that exists."""
    ok = box_is_valid(F.col("bbox")) & (F.col("page") >= 1)
    return regions.withColumn("valid", ok if pages is None else ok & (F.col("page") <= pages))
