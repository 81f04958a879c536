"""Attempts and the review state that follows from them, in one commit.

A store holds two tables: ``attempts``, which only grows, and ``review_state``, a row for each question ever attempted. Each
numbered batch changes both by one version of the store, once: a batch that comes again, or that broke off before its
manifest was out, has changed neither.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.practice import is_right, review_state, review_state_after
from quillon.sources.store import Store
from quillon.storage import cut

COLUMNS = ("id", "question_id", "correct", "wrong_cause", "feedback", "duration_seconds", "created_at", "counted")


def graded(batch: DataFrame, questions: DataFrame | None) -> DataFrame:
    """Rows as they are kept: graded by the questions' keys unless they are already, ``counted`` if the question is there."""
    rows = batch
    if questions is None:
        rows = rows.withColumn("counted", F.lit(True))
    else:
        known = questions.select(F.col("id").alias("question_id"), F.lit(True).alias("_known"), *([F.col("answer").alias("_key")] if "correct" not in batch.columns else []))
        rows = rows.join(known, "question_id", "left").withColumn("counted", F.coalesce("_known", F.lit(False)))
        if "correct" not in batch.columns:
            rows = rows.withColumn("correct", is_right(F.col("answer"), F.col("_key")))
    for name, kind in (("wrong_cause", "string"), ("feedback", "string"), ("duration_seconds", "int")):
        rows = rows.withColumn(name, (F.col(name) if name in batch.columns else F.lit(None)).cast(kind))
    return rows.withColumn("duration_seconds", F.greatest(F.lit(0), F.col("duration_seconds"))).select(*COLUMNS)


def folded(attempts: DataFrame) -> DataFrame:
    """``review_state`` of all these attempts, with a row of zeros for each question that was never answered wrongly."""
    last = attempts.groupBy("question_id").agg(F.max("created_at").alias("_last"))
    state = last.join(review_state(attempts), "question_id", "left")
    zero = {"wrong_count": F.lit(0).cast("long"), "correct_streak": F.lit(0).cast("long"), "mastered": F.lit(False), "last_attempt_at": F.col("_last")}
    for name, value in zero.items():
        state = state.withColumn(name, F.coalesce(name, value))
    return state.drop("_last")


def submit(store: Store, batch: DataFrame, number: int, questions: DataFrame | None = None, source: str = "attempts", n_parts: int = 64) -> int | None:
    """Commit a batch of attempts (id, question_id, answer or correct, created_at and more) with the state that follows.

    Returns the new version, or None if this number was committed before. A question's state is folded on from the one
    before where all its new attempts are later; where one comes late the question's attempts are read again, so any order
    of batches leads to the same states. Attempts at questions that the library hasn't got are kept and don't count.
    Null question ids are kept and don't count either. The states lie in ``n_parts`` parts.
    """
    done = store.mark(source)
    if done is not None and done >= number:
        return None
    rows = cut(graded(batch, questions).withColumn("counted", F.col("counted") & F.col("question_id").isNotNull()), "graded")
    new = rows.filter("counted")
    present = store.version()
    if present is None or "review_state" not in present.tables:
        state = folded(new)
    else:
        prior = store.read("review_state", present.number)
        first = new.groupBy("question_id").agg(F.min("created_at").alias("_first"))
        touched = first.join(prior.select("question_id", "last_attempt_at"), "question_id", "left")
        late = cut(touched.filter(F.col("last_attempt_at") >= F.col("_first")).select("question_id"), "late")
        on = review_state_after(prior.join(first, "question_id", "left_semi").join(late, "question_id", "left_anti"), new.join(late, "question_id", "left_anti"))
        every = store.read("attempts", present.number).filter("counted").unionByName(new)
        state = prior.join(first, "question_id", "left_anti").unionByName(on)
        if not late.isEmpty():
            state = state.unionByName(folded(every.join(late, "question_id", "left_semi")))
    return store.commit({"review_state": state}, {"attempts": rows}, {"review_state": "question_id", "attempts": "id"}, n_parts, batch=(source, number))


def states(store: Store, number: int | None = None) -> DataFrame:
    """The review state of every question that was ever answered wrongly, as a version has it."""
    return store.read("review_state", number).filter("wrong_count > 0")


def submitter(store: Store, questions: DataFrame | None = None, source: str = "attempts") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that submits each micro-batch under its number."""

    def put(batch: DataFrame, number: int) -> None:
        submit(store, batch, number, questions, source)

    return put
