"""Requests that change a library, over a versioned store: each is one commit, in batches of rows.

What the library holds: questions, documents, attempts, review_state, favorites, notes, sessions, exams, answers, plans,
completions, settings. Every request takes a DataFrame of changes, so one row and a million are the same request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.api import Library
from quillon.operators import practice, settings, versions
from quillon.sources import store as st
from quillon.sources import submission
from quillon.sources.store import Store
from quillon.storage import cut

#: Tables of what a user has done, which ``reset`` empties.
LEARNING = ("attempts", "review_state", "favorites", "notes", "sessions", "exams", "answers", "plans", "completions")
#: Columns and keys of the tables that requests write.
TABLES = {
    "favorites": ("question_id long, created_at timestamp_ntz", "question_id"),
    "notes": ("question_id long, content string, updated_at timestamp_ntz", "question_id"),
    "sessions": ("id long, kind string, ids array<long>, index int, uncertain array<long>, started_at timestamp_ntz, status string", "id"),
    "exams": ("exam_id long, place int, question_id long, category string, key array<string>, status string", "exam_id"),
    "answers": ("exam_id long, question_id long, answer array<string>, seconds int", "exam_id"),
    "plans": ("plan_id long, item_id long, type string, category string, target int, status string", "plan_id"),
    "completions": ("plan_id long, item_id long, completed int", "plan_id"),
    "settings": ("id int, stored string", "id"),
}


class Workbench:
    """A library in a store at ``path``; ``read`` gives a table as it is now, empty if it was never written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    def has(self, table: str) -> bool:
        version = self.store.version()
        return version is not None and table in version.tables

    def read(self, table: str) -> DataFrame:
        return self.store.read(table) if self.has(table) else self.spark.createDataFrame([], TABLES[table][0])

    def _put(self, reason: str, **tables: DataFrame) -> int:
        return self.store.commit(tables, keys={t: TABLES[t][1] for t in tables if t in TABLES}, n_parts=16, reason=reason)

    def _upserted(self, table: str, changes: DataFrame, keys: list[str]) -> DataFrame:
        """The table with the changes' rows in place of those of the same keys."""
        columns = self.read(table).columns
        return self.read(table).join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*columns))

    # Content.

    def index(self, questions: DataFrame, documents: DataFrame | None = None, keep: int = 5) -> dict[str, int]:
        """Replace the content by a newly indexed one; the version before stays as a snapshot, the last ``keep`` versions do.

        Returns how many questions were added, updated and removed; questions need id and content_hash.
        """
        counts = {"added": 0, "updated": 0, "removed": 0}
        if self.has("questions"):
            old = self.read("questions")
            for r in versions.diff(old, questions).groupBy("change").count().collect():
                if r["change"] in counts:
                    counts[r["change"]] = r["count"]
        else:
            counts["added"] = questions.count()
        tables = {"questions": questions, **({"documents": documents} if documents is not None else {})}
        self.store.commit(tables, keys={"questions": "id"}, n_parts=16, reason="index")
        self.store.prune(keep)
        return counts

    def snapshots(self) -> list[tuple[int, str, str, int]]:
        """Kept versions, the last first: number, time, reason and questions."""
        return [(v.number, v.created_at, v.reason, v.tables["questions"].rows if "questions" in v.tables else 0) for v in self.store.versions()]

    def rollback_content(self, number: int) -> int:
        """Bring back questions and documents of a kept version; what the user has done since stays."""
        kept = self.store.version(number).tables
        content = {t: self.store.read(t, number) for t in ("questions", "documents") if t in kept}
        return self.store.commit(content, n_parts=16, reason=f"rollback {number}")

    # Practice.

    def submit(self, attempts: DataFrame, number: int) -> int | None:
        """A numbered batch of attempts, graded, with the review state that follows; None if it was taken before."""
        return submission.submit(self.store, attempts, number, self.read("questions") if self.has("questions") else None)

    def set_favorites(self, changes: DataFrame) -> int:
        """(question_id, favorite, created_at): set and unset; of repeated ids the last counts."""
        last = changes.groupBy("question_id").agg(F.max_by(F.struct("favorite", "created_at"), "created_at").alias("c")).select("question_id", "c.*")
        kept = self.read("favorites").join(last, "question_id", "left_anti")
        return self._put("favorites", favorites=kept.unionByName(last.filter("favorite").select(*kept.columns)))

    def save_notes(self, changes: DataFrame) -> int:
        """(question_id, content, updated_at): the last of each question, cut to 200,000 characters; blank ones go."""
        last = changes.groupBy("question_id").agg(F.max_by("content", "updated_at").alias("content"), F.max("updated_at").alias("updated_at"))
        new = last.withColumn("content", versions.capped_note(F.col("content")))
        every = self._upserted("notes", new, ["question_id"])
        return self._put("notes", notes=every.filter(F.trim(F.coalesce("content", F.lit(""))) != ""))

    def set_causes(self, changes: DataFrame) -> int:
        """(question_id, cause) of questions in the wrong-book already; a blank cause becomes null."""
        return self._put("causes", review_state=versions.with_cause(self.store.read("review_state"), changes))

    # Sessions and exams.

    def start_sessions(self, sessions: DataFrame) -> int:
        """(id, kind, ids, started_at): a new session of a kind ends the open ones of that kind."""
        new = sessions.select("id", "kind", "ids", F.lit(0).alias("index"), F.array().cast("array<long>").alias("uncertain"), "started_at", F.lit("active").alias("status"))
        newest = new.groupBy("kind").agg(F.max_by("id", F.struct("started_at", "id")).alias("_newest"))
        every = self._upserted("sessions", new, ["id"]).join(newest, "kind", "left")
        status = F.when((F.col("status") == "active") & (F.col("_newest") != F.col("id")), "abandoned").otherwise(F.col("status"))
        return self._put("sessions", sessions=every.withColumn("status", status).select(*new.columns))

    def update_sessions(self, changes: DataFrame) -> int:
        """(id, index, uncertain, status), null where nothing changes: the index is held to the session's ids, uncertain ids to
        those among them; a session that ended stays as it is."""
        c = changes.select("id", F.col("index").alias("_i"), F.col("uncertain").alias("_u"), F.col("status").alias("_s"))
        old = self.read("sessions")
        joined = old.join(c, "id", "left").withColumn("_open", F.col("status") == "active")
        for name, new in (("index", "_i"), ("uncertain", "_u"), ("status", "_s")):
            joined = joined.withColumn(name, F.when(F.col("_open"), F.coalesce(new, name)).otherwise(F.col(name)))
        return self._put("sessions", sessions=practice.session_state(joined).select(*old.columns))

    def create_exam(self, exam_id: int, ids: DataFrame) -> int:
        """An exam of the questions (id, place), with their keys and categories as they are now; open exams are abandoned."""
        snapshot = self.read("questions").select("id", "category", F.col("answer").alias("key"))
        new = ids.join(snapshot, "id").select(F.lit(exam_id).cast("long").alias("exam_id"), F.col("place").cast("int").alias("place"), F.col("id").alias("question_id"), "category", "key", F.lit("active").alias("status"))
        old = self.read("exams").withColumn("status", F.when(F.col("status") == "active", "abandoned").otherwise(F.col("status")))
        return self._put("exam created", exams=old.filter(F.col("exam_id") != exam_id).unionByName(new))

    def save_answers(self, answers: DataFrame) -> int:
        """(exam_id, question_id, answer, seconds) of open exams; the last of each question counts."""
        open_ = self.read("exams").filter("status = 'active'").select("exam_id", "question_id")
        new = answers.join(open_, ["exam_id", "question_id"], "left_semi").groupBy("exam_id", "question_id").agg(F.last("answer").alias("answer"), F.last("seconds").cast("int").alias("seconds"))
        return self._put("answers", answers=self._upserted("answers", new, ["exam_id", "question_id"]))

    def exam_items(self) -> DataFrame:
        """Every exam's items with the answers given; none for what wasn't answered."""
        items = self.read("exams").join(self.read("answers"), ["exam_id", "question_id"], "left")
        return items.withColumn("answer", F.coalesce("answer", F.array().cast("array<string>"))).withColumn("seconds", F.coalesce("seconds", F.lit(0)))

    def finish_exam(self, exam_id: int, at: str, number: int) -> int | None:
        """End an open exam; its items are a numbered batch of attempts, an unanswered one a wrong one. The exam's own end is
        committed first, so a finish that broke off is made whole by the next."""
        items = cut(practice.graded(self.exam_items().filter(F.col("exam_id") == exam_id), require_answered=True), "exam")
        done = F.when((F.col("exam_id") == exam_id) & (F.col("status") == "active"), "finished").otherwise(F.col("status"))
        self._put("exam finished", exams=self.read("exams").withColumn("status", done))
        rows = items.select((F.lit(exam_id) * 1_000_000 + F.col("place")).cast("long").alias("id"), "question_id", F.col("right").alias("correct"), F.col("seconds").alias("duration_seconds"), F.expr(f"timestamp_ntz '{at}'").alias("created_at"))
        return submission.submit(self.store, rows, number, self.read("questions"), source="exams")

    # Plans and settings.

    def apply_plan(self, plan_id: int, items: DataFrame) -> int:
        """Make a plan (day, slot, type, category, target) the active one; the one before is cancelled."""
        new = items.select(F.lit(plan_id).cast("long").alias("plan_id"), (F.col("day") * 10 + F.col("slot")).cast("long").alias("item_id"), "type", "category", F.col("target").cast("int").alias("target"), F.lit("active").alias("status"))
        old = self.read("plans").withColumn("status", F.when(F.col("status") == "active", "cancelled").otherwise(F.col("status")))
        return self._put("plan", plans=old.filter(F.col("plan_id") != plan_id).unionByName(new))

    def complete_items(self, changes: DataFrame) -> int:
        """(plan_id, item_id, completed): progress is held to 0 and the item's target; a plan whose items are done is completed."""
        last = changes.groupBy("plan_id", "item_id").agg(F.last("completed").cast("int").alias("completed"))
        completions = cut(self._upserted("completions", last, ["plan_id", "item_id"]), "completions")
        plans = self.read("plans")
        overlay = practice.plan_overlay(plans.select("plan_id", "item_id", "target"), completions)
        done = practice.plan_status(overlay).filter("status = 'completed'").select("plan_id", F.lit(True).alias("_done"))
        status = F.when((F.col("status") == "active") & F.col("_done"), "completed").otherwise(F.col("status"))
        held = overlay.join(completions.select("plan_id", "item_id"), ["plan_id", "item_id"], "left_semi").select(*completions.columns)
        return self._put("progress", completions=held, plans=plans.join(done, "plan_id", "left").withColumn("status", status).select(*plans.columns))

    def plan_items(self) -> DataFrame:
        """Items of the active plan with their progress."""
        active = self.read("plans").filter("status = 'active'")
        return practice.plan_overlay(active, self.read("completions"))

    def save_settings(self, patch: str) -> int:
        """Merge a JSON patch into the settings; what isn't of a setting's type is left out, numbers are held to their limits."""
        stored = self.read("settings").unionByName(self.spark.createDataFrame([(1, None)], TABLES["settings"][0])).groupBy("id").agg(F.max("stored").alias("stored"))
        merged = settings.merged(stored.withColumn("patch", F.lit(patch)))
        return self._put("settings", settings=merged.select("id", F.to_json("settings").alias("stored")))

    def settings(self) -> DataFrame:
        """One row: the settings as they are, defaults where none was saved."""
        stored = self.read("settings").unionByName(self.spark.createDataFrame([(1, None)], TABLES["settings"][0])).groupBy("id").agg(F.max("stored").alias("stored"))
        return settings.merged(stored.withColumn("patch", F.lit(None).cast("string"))).select("settings.*")

    def reset(self, confirmation: str, needed: str = "RESET") -> int:
        """Empty everything that the user has done, in one version; ValueError unless it is confirmed."""
        if confirmation != needed:
            raise ValueError("not confirmed")
        present = [t for t in LEARNING if self.has(t)]
        return self._put("reset", **versions.emptied({t: self.read(t) for t in present}, present))

    # Backups.

    def back_up(self, folder: str, reason: str = st.MANUAL, keep: int | None = None) -> str:
        name = st.back_up(self.store, folder, reason)
        if keep is not None:
            st.prune_backups(self.spark, folder, keep)
        return name

    def backups(self, folder: str) -> list[st.Backup]:
        return st.backups(self.spark, folder)

    def restore(self, folder: str, name: str) -> int:
        return st.restore(self.store, folder, name)

    # Reading.

    def library(self, as_of: str, zone: str = "Asia/Shanghai") -> Library:
        """The analytical requests over the tables as they are now; an exam's items are those of all exams."""
        none = self.spark.createDataFrame([], "paper long, place int, question_id long")
        attempts = self.store.read("attempts").filter("counted").withColumn("session_id", F.lit(None).cast("long")) if self.has("attempts") else self.spark.createDataFrame([], "id long, question_id long, correct boolean, wrong_cause string, feedback string, duration_seconds int, created_at timestamp_ntz, session_id long")
        memberships = self.store.read("memberships") if self.has("memberships") else none
        documents = self.store.read("documents") if self.has("documents") else None
        return Library(self.read("questions"), attempts, self.read("favorites"), self.read("notes"), memberships, as_of, zone, documents=documents, exams=self.exam_items())
