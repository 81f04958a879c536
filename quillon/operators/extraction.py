"""Model-made candidates: requests for chunks, tolerant reading of replies, validation and dedup.

The model is a function of the caller's, from a table of requests to the same table with replies; all else is columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import json as J
from quillon.functions.text import safe_title
from quillon.sources import parsers

# Fixed values.
SUBJECTS = ("xingce", "shenlun", "common")
TYPES = ("single", "multiple", "judge", "essay")
DOCUMENTS = ("knowledge", "method", "pattern")
PROMOTION = r"(?i)添加.{0,6}(微信|群)|扫码|领取更多|下载地址"
CATEGORIES = {"shenlun": "申论综合", "": "未分类"}
UNNAMED = ("未命名题目", "未命名知识")

ITEM = (
    "struct<kind:string,subject:string,category:string,questionType:string,documentKind:string,stem:string,options:array<struct<key:string,text:string>>,answer:array<string>,explanation:string,title:string,summary:string,"
    "content:string,tags:array<string>,year:string,region:string,paper:string,difficulty:string,confidence:string,evidenceExcerpt:string,warnings:array<string>>"
)


def _text(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+\z", "")


def _list(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), _text), lambda x: x != ""))


def _compact(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")


def _number(c: Column, other: float) -> Column:
    """A number; ``other`` where there is none, or where it is zero."""
    x = c.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (x != 0), x).otherwise(F.lit(other))


def requests(docs: DataFrame, instruction: str = "") -> DataFrame:
    """(doc, text) to doc, chunk_no, chunk and the request for each chunk."""
    made = parsers.chunk_documents(docs).withColumn("total", F.count("*").over(Window.partitionBy("doc")))
    task = F.struct((F.col("chunk_no") + 1).alias("current"), "total", F.lit(instruction).alias("instruction"))
    return made.select("doc", "chunk_no", "chunk", F.concat(J.envelope("task", task), F.lit("\n"), J.envelope("source", F.struct("chunk"))).alias("request"))


def items(reply: Column) -> Column:
    """The items of a reply: of its object's ``items``, or of an array that is the whole reply; else none."""
    # Elements are read as texts first, so that one which is no object does not spoil the others.
    whole = F.from_json(reply, "array<string>")
    listed = F.when(F.ltrim(reply).startswith("[") & F.try_parse_json(reply).isNotNull(), whole)
    texts = F.coalesce(listed, F.from_json(J.loose_object(reply), "struct<items:array<string>>")["items"])
    return F.transform(F.filter(texts, lambda t: F.ltrim(t).startswith("{")), lambda t: F.from_json(t, ITEM))


def candidates(replies: DataFrame, mode: str = "mixed", subject: str = "auto", most: int = 10) -> DataFrame:
    """(doc, chunk_no, chunk, reply) to valid candidates, each signature once a document.

    Of a reply the first ``most`` items count, by definition of the request. A question needs a stem of six characters
    and an answer, and unless it is an essay two options and answers among their keys. A document needs a title, 50
    characters of content and no promotion. Subject, type, year, difficulty and confidence are coerced. Replies that are
    null or no JSON give nothing; numbers in text fields are taken as their text.
    """
    # Reading a reply costs far more than its bytes: a small file of replies would be one task.
    replies = replies.repartition(4 * replies.sparkSession.sparkContext.defaultParallelism, "doc", "chunk_no")
    at = replies.select("doc", "chunk_no", "chunk", F.posexplode(F.slice(F.coalesce(items(F.col("reply")), F.array().cast(f"array<{ITEM}>")), 1, most)).alias("place", "i"))
    i = lambda name: F.col(f"i.{name}")
    named = _text(i("subject"))
    own = F.lit(subject) if subject != "auto" else F.when(named.isin(*SUBJECTS), named).otherwise("common")
    options = F.filter(F.transform(F.coalesce(i("options"), F.array().cast("array<struct<key:string,text:string>>")), lambda o: F.struct(F.upper(_text(o["key"])).alias("key"), _text(o["text"]).alias("text"))), lambda o: (o["key"] != "") & (o["text"] != ""))
    year = i("year").try_cast("double")
    rows = at.filter(F.col("i").isNotNull()).select(
        "doc", "chunk_no", "place", F.when(i("kind") == "question", "question").otherwise("document").alias("kind"), own.alias("subject"), _text(i("category")).alias("category"), _text(i("questionType")).alias("type"),
        _text(i("documentKind")).alias("document_kind"), _text(i("stem")).alias("stem"), options.alias("options"), F.transform(_list(i("answer")), F.upper).alias("answer"), _text(i("explanation")).alias("explanation"),
        _text(i("title")).alias("title"), _text(i("content")).alias("content"), _text(i("summary")).alias("summary"), F.slice(_list(i("tags")), 1, 12).alias("tags"), F.when(year.between(1900, 2200) & (year == F.floor(year)), year.cast("int")).alias("year"),
        F.nullif(_text(i("region")), F.lit("")).alias("region"), F.nullif(_text(i("paper")), F.lit("")).alias("paper"), F.greatest(F.lit(1), F.least(F.lit(5), F.floor(_number(i("difficulty"), 2) + 0.5))).cast("int").alias("difficulty"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), _number(i("confidence"), 0.5))).alias("confidence"), F.substring(_text(i("evidenceExcerpt")), 1, 80).alias("evidence"), F.slice(_list(i("warnings")), 1, 8).alias("warnings"), _compact(F.col("chunk")).alias("_source"),
    )
    question = F.col("kind") == "question"
    if mode != "mixed":
        rows = rows.filter(F.col("kind") == mode.removesuffix("s"))
    guess = F.when(F.size("options") == 0, "essay").when(F.size("answer") > 1, "multiple").otherwise("single")
    rows = rows.withColumn("type", F.when(~question, "essay").when(F.col("type").isin(*TYPES), F.col("type")).otherwise(guess))
    answered = (F.char_length("stem") >= 6) & (F.size("answer") > 0) & ((F.col("type") == "essay") | ((F.size("options") >= 2) & (F.size(F.array_except("answer", F.transform("options", lambda o: o["key"]))) == 0)))
    told = (F.char_length("title") >= 2) & (F.char_length("content") >= 50) & ~F.concat_ws("\n", "title", "content").rlike(PROMOTION)
    rows = rows.filter(F.when(question, answered).otherwise(told))
    lacks = (F.col("evidence") != "") & ~F.contains(F.col("_source"), F.substring(_compact(F.col("evidence")), 1, 20))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("warnings", F.concat("warnings", F.when(lacks, F.array(F.lit("evidence_not_found"))).otherwise(none)))
    unsure, short = (F.col("confidence") < 0.75) & (F.size("warnings") == 0), question & (F.char_length("explanation") < 8)
    rows = rows.withColumn("warnings", F.array_distinct(F.concat("warnings", F.when(unsure, F.array(F.lit("low_confidence"))).otherwise(none), F.when(short, F.array(F.lit("short_explanation"))).otherwise(none))))
    signature = F.sha2(F.when(question, F.concat_ws("\n", "subject", "stem", F.to_json("options"))).otherwise(F.concat_ws("\n", "subject", "title", "content")), 256)
    plain = F.regexp_replace("content", "[#>*_`]", "")
    rows = rows.select(
        "doc", "chunk_no", "place", signature.alias("signature"), "kind", "subject", F.when(F.col("category") != "", F.col("category")).when(F.col("subject") == "shenlun", CATEGORIES["shenlun"]).otherwise(CATEGORIES[""]).alias("category"), "type",
        F.when(F.col("document_kind").isin(*DOCUMENTS), F.col("document_kind")).otherwise(DOCUMENTS[0]).alias("document_kind"), "stem", "options", "answer", "explanation", safe_title(F.when(question, F.substring("stem", 1, 60)).otherwise(F.col("title")), F.when(question, UNNAMED[0]).otherwise(UNNAMED[1])).alias("title"), "content",
        F.when(question, F.lit("")).when(F.col("summary") != "", F.col("summary")).otherwise(F.substring(plain, 1, 140)).alias("summary"), "tags", "year", "region", "paper", "difficulty", "confidence", "evidence", "warnings",
    )
    first = rows.groupBy("doc", "signature").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("doc", "signature")]), F.struct("chunk_no", "place")).alias("r"))
    key = F.concat(F.lit("kb-"), F.substring(F.sha2(F.concat_ws("\n", F.col("doc").cast("string"), "signature"), 256), 1, 24))
    return first.select(key.alias("id"), "doc", "signature", "r.*")


def extracted(docs: DataFrame, ask: Callable[[DataFrame], DataFrame], review: Callable[[DataFrame], DataFrame] | None = None, **options) -> DataFrame:
    """Chunk, ask, if wished have the replies reviewed, then validate. ``ask`` and ``review`` set the column ``reply``."""
    replies = ask(requests(docs, options.pop("instruction", "")))
    return candidates(replies if review is None else review(replies), **options)
