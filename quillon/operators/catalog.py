"""The question catalogue: filters, search, membership flags, facets, papers, libraries and similar questions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filtered(questions: DataFrame, where: Mapping[str, object]) -> DataFrame:
    """Equality on each given field. An empty value (None, '', 0) is no condition."""
    for name, value in where.items():
        if value:
            questions = questions.filter(F.col(name) == F.lit(value))
    return questions


def keyword(columns: list[Column], text: str, literal: bool = False) -> Column:
    """Whether any column contains the text, whatever its case. Unless ``literal``, % and _ in it are wildcards."""
    pattern = text
    if literal:
        for c in ("\\", "%", "_"):
            pattern = pattern.replace(c, "\\" + c)
    hits = [c.ilike(f"%{pattern}%") for c in columns]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return F.coalesce(out, F.lit(False))


def only(questions: DataFrame, keys: DataFrame, key: str = "question_id") -> DataFrame:
    """Questions that have a row in ``keys``."""
    return questions.join(keys.select(F.col(key).alias("_key")), F.col("id") == F.col("_key"), "left_semi")


def without(questions: DataFrame, keys: DataFrame, key: str = "question_id") -> DataFrame:
    """Questions that have no row in ``keys``."""
    return questions.join(keys.select(F.col(key).alias("_key")), F.col("id") == F.col("_key"), "left_anti")


def cause_is(cause: Column, wanted: str | None) -> Column:
    """Rows with this cause of error; the empty string asks for rows without a label, None for all."""
    blank = cause.isNull() | (F.trim(cause) == "")
    return F.lit(True) if wanted is None else blank if wanted == "" else cause == wanted


def in_active(content: DataFrame, vaults: DataFrame) -> DataFrame:
    """Content of the active library. One row at most is active, so it is sent to every task."""
    return content.join(F.broadcast(vaults.filter("active").select(F.col("id").alias("vault_id")).limit(1)), "vault_id")


def listed(questions: DataFrame, limit: int | None = 500, most: int = 5000) -> DataFrame:
    """Newest first, then category and id; null years last. None sets no limit."""
    ordered = questions.orderBy(F.desc_nulls_last("year"), "category", "id")
    return ordered if limit is None else ordered.limit(max(1, min(most, limit)))


def by_ids(questions: DataFrame, ids: list[int], most: int = 200) -> DataFrame:
    """The questions of a list, in its order; repeated and unknown ids are left out."""
    wanted = list(dict.fromkeys(ids))[:most]
    listed_ids = questions.sparkSession.createDataFrame(list(enumerate(wanted)), "position int, id long")
    return questions.join(F.broadcast(listed_ids), "id").orderBy("position")


def category_counts(questions: DataFrame, subject: str | None = None) -> DataFrame:
    return filtered(questions, {"subject": subject}).groupBy("subject", "category").agg(F.count("*").alias("questions"))


def facets(questions: DataFrame, names: list[str]) -> DataFrame:
    """Different non-empty values of each field: facet, value. One pass: each row is turned into one for each field."""
    pairs = F.array(*(F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value")) for n in names))
    return questions.select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null and value <> ''").distinct()


def papers(memberships: DataFrame, questions: DataFrame, least: int = 30) -> DataFrame:
    """Papers with at least ``least`` questions: paper, questions, year (of the first question by id)."""
    joined = memberships.join(questions.select(F.col("id").alias("question_id"), "year"), "question_id")
    return joined.groupBy("paper").agg(F.count("*").alias("questions"), F.min_by("year", F.struct("question_id", "place")).alias("year")).filter(F.col("questions") >= least)


def paper_questions(memberships: DataFrame, questions: DataFrame, paper: int) -> DataFrame:
    """A paper's questions in its order."""
    own = memberships.filter(F.col("paper") == paper).select("place", F.col("question_id").alias("id"))
    return own.join(questions.drop("paper"), "id").orderBy("place", "id")


def exploded_memberships(ordered: DataFrame) -> DataFrame:
    """(paper, ids array) to one row for each question with its place from 1."""
    return ordered.select("paper", F.posexplode("ids").alias("place", "question_id")).withColumn("place", F.col("place") + 1)


def library(base: DataFrame, questions: DataFrame, reviews: DataFrame, favorites: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows of ``base`` (question_id and its own columns) with their question and what the user keeps on it.

    Everything is keyed by question_id, so one shuffle of each side serves all four joins.
    """
    q = questions.select(F.col("id").alias("question_id"), "stem", "category", "subject")
    r = reviews.select("question_id", "wrong_count", "mastered", "due_at")
    f = favorites.select("question_id", F.lit(True).alias("_favorite"))
    n = notes.select("question_id", F.col("content").alias("_note"))
    joined = base.join(q, "question_id").join(r, "question_id", "left").join(f, "question_id", "left").join(n, "question_id", "left")
    return joined.select(
        *base.columns,
        "stem",
        "category",
        "subject",
        F.coalesce("wrong_count", F.lit(0).cast("long")).alias("wrong_count"),
        F.coalesce("mastered", F.lit(False)).alias("mastered"),
        "due_at",
        F.col("_favorite").isNotNull().alias("favorite"),
        F.coalesce("_note", F.lit("")).alias("note"),
    )


def user_metadata(ids: DataFrame, favorites: DataFrame, notes: DataFrame, reviews: DataFrame, most: int | None = None) -> DataFrame:
    """What is kept on each id, of the first ``most`` if so many are asked for, with defaults for ids that have nothing."""
    wanted = ids.select(F.col("id").alias("question_id")).distinct()
    wanted = wanted if most is None else wanted.orderBy("question_id").limit(most)
    f = favorites.select("question_id", F.lit(True).alias("_favorite"))
    n = notes.select("question_id", F.col("content").alias("_note"))
    r = reviews.select("question_id", F.col("last_cause").alias("_cause"))
    joined = wanted.join(f, "question_id", "left").join(n, "question_id", "left").join(r, "question_id", "left")
    return joined.select("question_id", F.col("_favorite").isNotNull().alias("favorite"), F.coalesce("_note", F.lit("")).alias("note"), F.coalesce("_cause", F.lit("")).alias("cause"))


def similar(questions: DataFrame, source_id: int, k: int = 20, pool: int = 2000) -> DataFrame:
    """The k questions of the source's subject most like it: id, score.

    +10 for the same category, +3 for each shared tag, minus the difference in difficulty; only scores above zero,
    among the first ``pool`` of the subject in catalogue order. The one source row is sent to every task.
    """
    source = questions.filter(F.col("id") == source_id).select(F.col("subject").alias("s_subject"), F.col("category").alias("s_category"), F.col("tags").alias("s_tags"), F.col("difficulty").alias("s_difficulty")).limit(1)
    joined = questions.join(F.broadcast(source), F.col("subject") == F.col("s_subject"))
    candidates = listed(joined, pool, pool).filter(F.col("id") != source_id)
    score = F.when(F.col("category") == F.col("s_category"), 10).otherwise(0) + 3 * F.size(F.array_intersect("tags", "s_tags")) - F.abs(F.col("difficulty") - F.col("s_difficulty"))
    return candidates.select("id", score.cast("int").alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(k)


def palette(questions: DataFrame, documents: DataFrame, text: str, n_questions: int = 8, n_documents: int = 6) -> DataFrame:
    """Global search: the first hits among questions (of two characters or more) and documents, one list."""
    q = questions.filter(keyword([F.col("stem")], text) if len(text) >= 2 else F.lit(False)).orderBy("id").limit(n_questions)
    d = documents.filter(F.contains(F.lower("text"), F.lit(text.lower()))).orderBy("doc_id").limit(n_documents)
    return q.select(F.lit("question").alias("kind"), F.col("id"), F.col("stem").alias("title")).unionByName(d.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("title")))
