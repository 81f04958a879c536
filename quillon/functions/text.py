"""Normalisers, extractors and cleaners of text as column expressions. All are JVM-side; none is a Python function."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of page furniture and watermarks in scanned booklets.
WATERMARKS = (r"公考最新资料[、，]?\s*更新进度微信\S*", r"微信SKA\d+", r"公众号[：:]\S+", r"超格学员专用", r"资料分析600[贴折]")
STRUCTURAL_NOISE = r"^[（(]?\s*(?:请回答|请根据.*回答)?\s*第?\s*[0-9]{1,3}\s*[～~-]\s*[0-9]{1,3}\s*题\s*[)）]?$"
WHOLE_ANSWERS = r"【全篇答案】[A-D]{2,}"
NUMERIC_TOKEN = r"^[-+]?[0-9,，]+(?:\.[0-9]+)?[%％]?$"
NUMBER_STREAM = r"(?:[-+]?[0-9][0-9,.]*%?[（(]?\s+){2,}[-+]?[0-9][0-9,.]*%?[）)]?"
QUARANTINED_LINE = "> [图表数据区已隔离，建议对照原图核对数字]"
QUARANTINE_NOTE = "> [图表数字串，OCR 无法确认语义，请对照原图]"
QUESTION_NUMBER = r"^\s*([0-9]{1,3})\s*[.、．](?![0-9])"

# The replacements that turn HTML into text, in order.
HTML_ASSET = r"(?i)<img[^>]*src=[\"']?[a-z-]+-asset://[a-z-]+/([0-9a-f]{40}\.[a-z0-9]+)[\"']?[^>]*>"
HTML_STEPS = (
    (HTML_ASSET, "\n![](assets/$1)\n"),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</(p|div|li|tr|h[1-6]|table)>", "\n"),
    (r"(?i)</t[dh]>", "　"),
    (r"<[^>]+>", ""),
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    (r"\n{3,}", "\n\n"),
    (r"[ \t]+", " "),
)


def replaced(x: Column, *steps: tuple[str, str]) -> Column:
    """Apply (pattern, replacement) pairs in order."""
    for pattern, to in steps:
        x = F.regexp_replace(x, pattern, to)
    return x


def stripped(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def no_space(x: Column) -> Column:
    """Without any white space, wide blanks included."""
    return F.regexp_replace(x, r"(?U)\s+", "")


def letters_and_digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\p{L}\p{N}]+", "")


def for_alignment(x: Column) -> Column:
    """The first 140 characters without white space, punctuation and symbols."""
    return F.substring(F.regexp_replace(x, r"(?U)[\s\p{P}\p{S}]", ""), 1, 140)


def string_list(x: Column) -> Column:
    """Split on commas, semicolons and line ends of both widths; trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(x, "[,，;；\n]"), lambda v: F.trim(v)), lambda v: v != "")


def html_to_text(html: Column) -> Column:
    """Text of HTML: asset images as Markdown, blocks end lines, cells end in a wide blank, six entities decoded."""
    return stripped(replaced(F.coalesce(html, F.lit("")), *HTML_STEPS))


def assets(html: Column) -> Column:
    """Different asset files that the HTML shows."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(HTML_ASSET), 1))


def strict_signature(stem: Column, material: Column | None = None, first_option: Column | None = None) -> Column:
    """Stem, material and the first option's first 50 characters without white space, joined by bars."""
    part = lambda c: F.lit("") if c is None else no_space(F.coalesce(c, F.lit("")))
    return F.concat_ws("|", part(stem), part(material), F.substring(part(first_option), 1, 50))


def loose_signature(stem: Column, material: Column | None = None, first_option: Column | None = None) -> Column:
    """Letters and digits only of all three."""
    part = lambda c: F.lit("") if c is None else letters_and_digits(F.coalesce(c, F.lit("")))
    return F.concat(part(stem), part(material), part(first_option))


def stable_id(*parts: Column, length: int = 24) -> Column:
    """The first hex digits of the SHA-256 of the parts, one to a line."""
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, length)


def shingles(x: Column, n: int = 3) -> Column:
    """Different n-grams of an already normalised text; a shorter text is one n-gram; an empty one has none.

    A look-ahead takes every place in one pass over the text; substrings by place would walk it from its start each
    time, and a split inside the lambda would be made anew for each n-gram.
    """
    grams = F.array_distinct(F.regexp_extract_all(x, F.lit(f"(?s)(?=(.{{{n}}}))"), 1))
    return F.when(F.length(x) == 0, F.array().cast("array<string>")).when(F.length(x) <= n, F.array(x)).otherwise(grams)


def watermark_count(x: Column, marks: tuple[str, ...] = WATERMARKS) -> Column:
    """How many watermarks stand in a line; ``marks`` are the patterns of a publisher's."""
    total = F.lit(0)
    for p in marks:
        total = total + F.regexp_count(x, F.lit(p))
    return total


def without_watermarks(x: Column, marks: tuple[str, ...] = WATERMARKS) -> Column:
    return F.trim(replaced(x, *((p, "") for p in marks), (r"\s{2,}", " ")))


def clean_lines(raw: Column, marks: tuple[str, ...] = WATERMARKS) -> Column:
    """Lines of a text, cleaned: trimmed, runs of tildes made one, whole-book answers and watermarks cut, noise dropped."""
    lines = F.split(raw, r"\r?\n")
    first = F.transform(lines, lambda x: stripped(replaced(stripped(x), ("~+", "～"), (WHOLE_ANSWERS, ""))))
    return F.filter(F.transform(first, lambda x: without_watermarks(x, marks)), lambda x: (x != "") & ~x.rlike(STRUCTURAL_NOISE))


def is_number_stream(line: Column) -> Column:
    """At least six words, three fifths of them numbers, and no Chinese: the remains of a chart or table."""
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    numbers = F.filter(words, lambda w: w.rlike(NUMERIC_TOKEN))
    return (F.size(words) >= 6) & (F.size(numbers) / F.size(words) >= 0.6) & ~line.rlike("[一-鿿]")


def quarantined(line: Column) -> Column:
    """A number stream becomes a notice; runs of three numbers or more within a line are set apart under one."""
    inside = F.regexp_replace(line, "(" + NUMBER_STREAM + r")\s*", f"\n{QUARANTINE_NOTE}\n> $1\n")
    return F.when(is_number_stream(line), QUARANTINED_LINE).otherwise(inside)


def numeric_anomaly(line: Column) -> Column:
    """stream, points (two decimal points in one number), wide (full-width digits), or null."""
    return F.when(is_number_stream(line), "stream").when(line.rlike(r"[0-9]\.[0-9]+\.[0-9]"), "points").when(line.rlike("[０-９]"), "wide")


def safe_title(x: Column, fallback: Column) -> Column:
    """A title for lists and file names: no images, links, or characters that paths forbid; at most 80 characters."""
    t = F.trim(replaced(x, (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r'[\\/:*?"<>|]', " "), (r"(?U)\s+", " ")))
    return F.substring(F.when(t != "", t).otherwise(fallback), 1, 80)


def file_segment(x: Column, fallback: str = "item") -> Column:
    """A name that any file system takes."""
    t = F.trim(replaced(x, (r'[\\/:*?"<>|\x00-\x1f]', "_"), (r"\s+", " "), (r"^\.+|\.+$", "")))
    return F.when(t != "", F.substring(t, 1, 80)).otherwise(F.lit(fallback))


def html_escaped(x: Column) -> Column:
    return replaced(x, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def plain(markdown: Column) -> Column:
    """Markdown without code, images, link targets and marks, on one line."""
    return F.trim(replaced(markdown, (r"(?s)```.*?```", " "), (r"!\[[^\]]*\]\([^)]+\)", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), ("[#>*_`]", " "), (r"\s+", " ")))


def snippet(content: Column, query: str, length: int = 72, before: int = 18) -> Column:
    """What stands around the first hit, whatever its case; null if there is none."""
    needle = query.strip().lower()
    text = plain(content)
    at = F.locate(needle, F.lower(text)) if needle else F.lit(0)
    start = F.greatest(at - 1 - before, F.lit(0))
    cut = F.substring(text, start + 1, F.lit(length))
    dots = lambda c: F.when(c, "…").otherwise("")
    return F.when(at > 0, F.concat(dots(start > 0), cut, dots(start + length < F.char_length(text))))


def word_limit(stem: Column) -> Column:
    """Struct of min and max characters that a prompt asks for (null where it sets none).

    A range first, then at least and at most, then about a number, give or take a tenth.
    """
    x = F.regexp_replace(F.coalesce(stem, F.lit("")), r"(?U)\s+", "")
    num = lambda p, g=1: F.expr("cast(null as int)") if p is None else F.try_to_number(F.nullif(F.regexp_extract(x, p, g), F.lit("")), F.lit("9999")).cast("int")
    # How prompts word their limits.
    between = r"([0-9]{2,4})[—–\-~～至到]([0-9]{2,4})字"
    a, b = num(between, 1), num(between, 2)
    low = F.coalesce(num("(?:不少于|不低于|至少)([0-9]{2,4})字"), num("([0-9]{2,4})字以上"), F.lit(0))
    high = F.coalesce(num("(?:不超过|不高于|(?<!不)少于|控制在|限于|字数(?:控制)?在)([0-9]{2,4})字(?:以内|以下)?"), num("([0-9]{2,4})字(?:以内|以下)"), F.lit(0))
    about = num("([0-9]{2,4})字左右")
    pair = lambda lo, hi: F.struct(lo.cast("int").alias("min"), hi.cast("int").alias("max"))
    null = F.lit(None)
    return (
        F.when((a > 0) & (b >= a), pair(a, b))
        .when((low > 0) & (high >= low), pair(low, high))
        .when(about > 0, pair(F.floor(about * 0.9 + 0.5), F.floor(about * 1.1 + 0.5)))
        .when(low > 0, pair(low, null))
        .when(high > 0, pair(null, high))
    )


def region_of_paper(title: Column) -> Column:
    """The region that a paper's title names; null for national papers."""
    region = F.regexp_extract(title, r"^([0-9]{4})年(.+?)公务员录用考试", 2)
    return F.when((region != "") & (region != "国家"), region)


def book_kind(title: Column, rules: list[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """The first kind of which some keyword is in the title."""
    out = None
    for kind, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(title, F.lit(w))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return F.lit(default) if out is None else out.otherwise(default)


def digit_tokens(x: Column) -> Column:
    """Different numbers of a text, reduced to digits, points and percent signs."""
    found = F.regexp_extract_all(x, F.lit("[0-9][0-9,.%：:]*"), 0)
    return F.array_distinct(F.transform(found, lambda t: F.regexp_replace(t, "[^0-9.%]", "")))


def question_numbers(x: Column) -> Column:
    """Numbers at the start of lines, in order."""
    lines = F.filter(F.split(x, "\n"), lambda v: v.rlike(QUESTION_NUMBER))
    return F.transform(lines, lambda v: F.regexp_extract(v, QUESTION_NUMBER, 1).cast("int"))


def drop_suspects(numbers: Column) -> Column:
    """How often consecutive different numbers don't differ by one."""
    n = F.filter(numbers, lambda x, i: (i == 0) | (x != F.get(numbers, i - 1)))
    return F.size(F.filter(n, lambda x, i: (i > 0) & (x - F.get(n, i - 1) != 1)))


def joined_explanations(parts: list[tuple[str, Column]], default: str) -> Column:
    """Labelled explanations that exist, a blank line between them."""
    shown = F.array(*(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}\n"), c)) for label, c in parts))
    kept = F.filter(shown, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n\n")).otherwise(F.lit(default))


def coerced(x: Column, rules: dict[str, str], default: str) -> Column:
    """The value of the first pattern that matches, whatever the case."""
    out = None
    for pattern, to in rules.items():
        hit = x.rlike("(?i)" + pattern)
        out = F.when(hit, to) if out is None else out.when(hit, to)
    return F.lit(default) if out is None else out.otherwise(default)


def inline_options(line: Column) -> Column:
    """Options A to D on one line as an array of key and text, if at least two stand there in order; else empty."""
    rest = {"A": "BCD", "B": "CD", "C": "D", "D": ""}
    found = []
    for k in "ABCD":
        stop = rf"(?=\s*[{rest[k]}]\s*[.、．]|$)" if rest[k] else "$"
        text = F.regexp_extract(line, rf"(?:^|\s){k}\s*[.、．]\s*(.*?){stop}", 1)
        found.append(F.struct(F.lit(k).alias("key"), F.trim(text).alias("text")))
    kept = F.filter(F.array(*found), lambda o: o["text"] != "")
    return F.when(F.size(kept) >= 2, kept).otherwise(F.filter(kept, lambda o: F.lit(False)))


def essay_score(text: Column, keywords: Column) -> Column:
    """An essay by local rules, 0 to 100: score, and its parts coverage, structure and length.

    Coverage is 45 plus 50 times the share of keywords found (0.55 without any); structure is 55, or 72 from two
    paragraphs on, and 15 more for words that enumerate; length is 88, 72 or 55. They weigh 0.5, 0.3 and 0.2. A null text
    is empty.
    """
    text, keywords = F.coalesce(text, F.lit("")), F.coalesce(keywords, F.array().cast("array<string>"))
    half_up = lambda x: F.floor(x + 0.5).cast("int")
    share = F.when(F.size(keywords) > 0, F.size(F.filter(keywords, lambda k: F.contains(text, k))) / F.size(keywords)).otherwise(0.55)
    paragraphs = F.size(F.filter(F.split(text, "\n+"), lambda p: F.trim(p) != ""))
    n = F.char_length(text)
    coverage = half_up(45 + share * 50)
    structure = F.when(paragraphs >= 2, 72).otherwise(55) + F.when(text.rlike("[一二三四]|首先|其次|最后|一是|二是"), 15).otherwise(0)
    length = F.when(n.between(100, 500), 88).when(n >= 60, 72).otherwise(55)
    score = half_up(coverage * 0.5 + structure * 0.3 + length * 0.2)
    return F.struct(score.alias("score"), coverage.alias("coverage"), structure.alias("structure"), length.alias("length"))


def literal(pattern: str) -> str:
    """A text as a pattern that matches only it."""
    return re.escape(pattern)


def clean_title(x: Column) -> Column:
    """A heading without numbering and bullets before it and without leaders, page numbers and brackets after it.

    Both patterns repeat, so what cleaning once would lay bare is taken too.
    """
    # What stands before and after a heading.
    before = r"^(?:\s*(?:[0-9]{1,3}\s*[.、．]|[（(][0-9一二三四五六七八九十]{1,3}[)）]|[-—·•*#]+)\s*)+"
    after = r"(?:\s*(?:[.。…·•]{2,}\s*[0-9]{0,4}|[（(][^()（）]*[)）]))+\s*$"
    return F.trim(replaced(x, (before, ""), (after, "")))


def has_excerpt(source: Column, excerpt: Column, length: int = 20) -> Column:
    """Whether a source holds the first characters of an excerpt, white space aside. An empty excerpt is in none."""
    start = F.substring(no_space(F.coalesce(excerpt, F.lit(""))), 1, length)
    return (start != "") & F.contains(no_space(F.coalesce(source, F.lit(""))), start)


# What evaluation leaves out of a text.
EVALUATION_MARKS = r"""(?U)[\s\x1c-\x1f，。、；：？！,.;:?!()（）【】\[\]"'’“”]+"""


def evaluation_text(x: Column) -> Column:
    """A text without white space and punctuation, for comparison of what was read with the truth."""
    return F.regexp_replace(x, EVALUATION_MARKS, "")


def evaluation_number(x: Column) -> Column:
    """A number without white space and thousands marks, its full-width percent sign and point made plain."""
    return replaced(x, (r"(?U)[\s\x1c-\x1f,，]+", ""), ("％", "%"), ("。", "."))
