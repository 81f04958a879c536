"""One function for each analytical request: a facade over the operators for a library's tables.

A ``Library`` holds the tables as DataFrames; every method returns a DataFrame and nothing runs until it is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.time import instant, since
from quillon.operators import catalog, practice, reports


@dataclass
class Library:
    """questions, attempts, favorites, notes and memberships; ``as_of`` is the present and ``zone`` the user's.

    Some requests need more: documents (doc_id, text and what they are filtered by), exams (exam_id, place, category, answer
    and key arrays, seconds), essays (prompt_id, evaluation, created_at), conversations (conv_id, updated_at, messages).
    """

    questions: DataFrame
    attempts: DataFrame
    favorites: DataFrame
    notes: DataFrame
    memberships: DataFrame
    as_of: str
    zone: str = "Asia/Shanghai"
    documents: DataFrame | None = None
    exams: DataFrame | None = None
    essays: DataFrame | None = None
    conversations: DataFrame | None = None

    def search(self, text: str = "", limit: int | None = 500, **where: object) -> DataFrame:
        q = catalog.filtered(self.questions, where)
        return catalog.listed(q.filter(catalog.keyword([F.col("stem"), F.array_join("tags", " ")], text)) if text else q, limit)

    def reviews(self) -> DataFrame:
        return practice.review_state(self.attempts)

    def due(self, limit: int = 500) -> DataFrame:
        return practice.due_reviews(self.reviews(), self.questions, instant(self.as_of), limit)

    def wrong_book(self, cause: str | None = None) -> DataFrame:
        base = self.reviews().filter(~F.col("mastered") & catalog.cause_is(F.col("last_cause"), cause)).select("question_id", "last_cause")
        return catalog.library(base, self.questions, self.reviews(), self.favorites, self.notes)

    def favorite_book(self) -> DataFrame:
        return catalog.library(self.favorites.select("question_id", "created_at"), self.questions, self.reviews(), self.favorites, self.notes)

    def note_book(self) -> DataFrame:
        return catalog.library(self.notes.filter(F.trim("content") != "").select("question_id", "updated_at"), self.questions, self.reviews(), self.favorites, self.notes)

    def find(self, text: str) -> DataFrame:
        """The first hits among questions and documents."""
        return catalog.palette(self.questions, self._needed("documents"), text)

    def find_documents(self, text: str = "", **where: object) -> DataFrame:
        d = catalog.filtered(self._needed("documents"), where)
        return d.filter(catalog.keyword([F.col("text")], text)) if text else d

    def get(self, ids: list[int]) -> DataFrame:
        return catalog.by_ids(self.questions, ids)

    def user_metadata(self, ids: list[int]) -> DataFrame:
        wanted = self.questions.sparkSession.createDataFrame([(i,) for i in ids], "id long")
        return catalog.user_metadata(wanted, self.favorites, self.notes, self.reviews())

    def categories(self, subject: str | None = None) -> DataFrame:
        return catalog.category_counts(self.questions, subject)

    def facets(self) -> DataFrame:
        return catalog.facets(self.questions, ["year", "paper", "category"])

    def papers(self, least: int = 30) -> DataFrame:
        return catalog.papers(self.memberships, self.questions, least)

    def paper(self, paper: int) -> DataFrame:
        return catalog.paper_questions(self.memberships, self.questions, paper)

    def similar(self, question_id: int, k: int = 20) -> DataFrame:
        return catalog.similar(self.questions, question_id, k)

    def today(self) -> DataFrame:
        return reports.totals(reports.on_day(self.attempts, self.as_of, self.zone))

    def streak(self) -> DataFrame:
        return reports.streak(self.attempts, self.as_of, self.zone)

    def activity(self, days: int = 13) -> DataFrame:
        return reports.calendar(reports.by_day(self.attempts.filter(since("created_at", self.as_of, days)), self.zone).drop("minutes"), self.as_of, self.zone, days + 1)

    def totals(self, days: int | None = None) -> DataFrame:
        return reports.totals(self.attempts.filter(since("created_at", self.as_of, days)))

    def causes(self, days: int | None = None) -> DataFrame:
        return reports.wrong_causes(self.attempts.filter(since("created_at", self.as_of, days)))

    def mastery(self, by: str = "subject") -> DataFrame:
        return reports.mastery(self.attempts, self.questions, by)

    def by_category(self, days: int | None = None) -> DataFrame:
        rows = self.attempts.filter(since("created_at", self.as_of, days)).join(self.questions.select(F.col("id").alias("question_id"), "category"), "question_id", "left")
        return reports.by_category(rows, F.col("category"))

    def by_day(self, days: int | None = None) -> DataFrame:
        return reports.by_day(self.attempts.filter(since("created_at", self.as_of, days)), self.zone)

    def weakest(self) -> DataFrame:
        return reports.weakest(self.mastery())

    def recent(self, n: int = 8) -> DataFrame:
        return reports.recent(self.attempts, self.questions, n)

    def session(self, session_id: int) -> DataFrame:
        """A session's attempts in the order in which they were made."""
        return self.attempts.filter(F.col("session_id") == session_id).orderBy("created_at", "id")

    def advice(self) -> DataFrame:
        return reports.recommendations(reports.totals(self.attempts), self.weaknesses(), reports.wrong_causes(self.attempts))

    def plan(self, days: int = 7, minutes: int = 60, focus: list[str] | None = None) -> DataFrame:
        return reports.plan(self.weaknesses(), days, minutes, focus)

    def exam_scores(self) -> DataFrame:
        """Total, right answers and score of every exam; what wasn't answered is wrong."""
        return practice.exam_scores(self._graded())

    def exam_breakdown(self, exam_id: int) -> DataFrame:
        return practice.exam_breakdown(self._graded().filter(F.col("exam_id") == exam_id))

    def exam_history(self, limit: int = 100) -> DataFrame:
        return self.exam_scores().orderBy(F.desc("exam_id")).limit(limit)

    def essay_summary(self, days: int | None = None) -> DataFrame:
        return reports.essay_summary(self._needed("essays"), self.as_of, days)

    def essay_history(self, prompt_id: int | None = None, days: int | None = None, limit: int = 100) -> DataFrame:
        """The latest evaluations, 500 at most."""
        rows = self._needed("essays").filter(since("created_at", self.as_of, days))
        rows = rows if prompt_id is None else rows.filter(F.col("prompt_id") == prompt_id)
        return rows.orderBy(F.desc("created_at"), "prompt_id").limit(min(max(limit, 1), 500))

    def recent_conversations(self, limit: int = 100) -> DataFrame:
        return self._needed("conversations").orderBy(F.desc("updated_at"), "conv_id").limit(min(max(limit, 1), 100))

    def _needed(self, name: str) -> DataFrame:
        found = getattr(self, name)
        if found is None:
            raise ValueError(f"this library has no {name}")
        return found

    def _graded(self) -> DataFrame:
        return practice.graded(self._needed("exams"), require_answered=True)

    def weaknesses(self) -> DataFrame:
        return reports.weaknesses(self.mastery("category"))

    def strengths(self) -> DataFrame:
        return reports.strengths(self.mastery("category"))

    def select(self, count: int, mode: str = "sequence", seed: str = "0", ids: list[int] | None = None) -> DataFrame:
        """Questions for a practice: an explicit list, or by mode: review (due), sequence (the first of the catalogue),
        adaptive (by weakness) or random (drawn by a seed)."""
        if ids is not None:
            return catalog.by_ids(self.questions, ids).select("id")
        if mode == "review":
            return self.due(count).select(F.col("question_id").alias("id"))
        if mode == "sequence":
            return catalog.listed(self.questions, count).select("id")
        if mode == "adaptive":
            weak = self.mastery("category").orderBy("accuracy", "category").limit(4)
            place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("accuracy", "category"))
            scores = practice.adaptive_scores(self.questions, weak.select("category", (5 - place).alias("priority")), self.reviews().filter("not mastered"), self.attempts, practice.recent_distinct(self.attempts, 60))
            return scores.orderBy(F.desc("score"), "id").limit(count).select("id")
        if mode != "random":
            raise ValueError(f"no such mode: {mode}")
        pool = self.questions
        for name in ("group_id", "group_order"):
            if name not in pool.columns:
                pool = pool.withColumn(name, F.lit(None).cast("long"))
        return practice.packed_units(practice.seeded_order(practice.units(pool), seed), count, "draw").select("id")
