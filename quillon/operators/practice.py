"""Practice: grading, the spaced-repetition fold, due reviews, selection, sessions and exams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.math import percent
from quillon.functions.time import plus_days


def normal_answer(answer: Column) -> Column:
    """An array of answers trimmed, in upper case, without repeats and blanks, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(answer, lambda x: F.upper(F.trim(x))), lambda x: x.isNotNull() & (x != ""))))


def is_right(answer: Column, key: Column, require_answered: bool = False) -> Column:
    """Whether an answer equals the key. Two empty ones are equal, unless an answer is required."""
    a = normal_answer(F.coalesce(answer, F.array().cast("array<string>")))
    same = a == normal_answer(F.coalesce(key, F.array().cast("array<string>")))
    return same & (F.size(a) > 0) if require_answered else same


def review_state(attempts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """State of every question with a wrong attempt, as a fold over its attempts in order of created_at and id.

    wrong: one more wrong, streak 0, not mastered, due in a day. Right after a wrong: feedback 'forgot' sets the
    streak to 0, 'hard' leaves it, 'normal' and 'easy' add one; mastered from a streak of two by 'normal' or 'easy',
    else due in 5 (easy), 3 (normal) or 1 day. A blank cause keeps the one before.

    The fold is rewritten as aggregates, so a question with very many attempts is summed map-side and is never
    gathered into one row: the last reset (a wrong or a forgotten answer) fixes where the streak starts, and what
    follows it is counted. Column feedback is optional (null: normal).
    """
    keys = keys or ["question_id"]
    fb = F.coalesce(F.col("feedback"), F.lit("normal")) if "feedback" in attempts.columns else F.lit("normal")
    at = F.struct(F.col("created_at").alias("t"), F.col("id").alias("i"))
    rows = attempts.select(*keys, "correct", F.when(F.trim("wrong_cause") != "", F.col("wrong_cause")).alias("cause"), fb.alias("fb"), at.alias("at"))
    wrong = ~F.col("correct")
    first = rows.groupBy(*keys).agg(
        F.count_if(wrong).alias("wrong_count"),
        F.min(F.when(wrong, F.col("at"))).alias("first_wrong"),
        F.max(F.when(wrong | (F.col("fb") == "forgot"), F.col("at"))).alias("reset"),
        F.max("at").alias("last"),
        F.max_by("cause", F.when(wrong & F.col("cause").isNotNull(), F.col("at"))).alias("last_cause"),
    )
    first = first.filter("wrong_count > 0")
    after = rows.join(first.select(*keys, "reset", "last"), keys).filter(F.col("at") >= F.col("reset"))
    step = F.col("correct") & F.col("fb").isin("normal", "easy") & (F.col("at") > F.col("reset"))
    second = after.groupBy(*keys).agg(
        F.count_if(step).alias("correct_streak"),
        F.min(F.when(step, F.struct("at", "fb"))).alias("first_step"),
        # Other answers after the reset ('hard') leave the streak but set a date; so does the reset itself.
        F.max(F.when(~step, F.struct("at", "fb"))).alias("other"),
        F.max_by("fb", "at").alias("last_fb"),
    )
    mastered = (F.col("correct_streak") >= 2) & F.col("last_fb").isin("normal", "easy")
    # The date comes from the last answer that did not master: the first step, or a later one that is no step.
    from_step = F.col("first_step.at") > F.col("other.at")
    base = F.when(from_step, F.col("first_step.at.t")).otherwise(F.col("other.at.t"))
    days = F.when(from_step & (F.col("first_step.fb") == "easy"), 5).when(from_step, 3).otherwise(1)
    return first.join(second, keys).select(
        *keys,
        "wrong_count",
        "correct_streak",
        mastered.alias("mastered"),
        "last_cause",
        F.col("first_wrong.t").alias("first_wrong_at"),
        F.col("last.t").alias("last_attempt_at"),
        plus_days(base, days).alias("due_at"),
        F.when(mastered, F.col("last.t")).alias("completed_at"),
    )


def review_state_after(prior: DataFrame, attempts: DataFrame) -> DataFrame:
    """States of the attempted questions, from their states before (none: never attempted) and later attempts alone.

    ``prior`` has the columns of ``review_state`` and also rows with a wrong_count of zero; so has the result. All attempts
    must be later than their question's last_attempt_at. The same aggregates as ``review_state``: the prior state takes the
    place of all attempts up to it, unless a wrong or forgotten answer among the new ones starts the streak anew.
    """
    fb = F.coalesce(F.col("feedback"), F.lit("normal")) if "feedback" in attempts.columns else F.lit("normal")
    at = F.struct(F.col("created_at").alias("t"), F.col("id").alias("i"))
    rows = attempts.select("question_id", "correct", F.when(F.trim("wrong_cause") != "", F.col("wrong_cause")).alias("cause"), fb.alias("fb"), at.alias("at"))
    wrong = ~F.col("correct")
    first = rows.groupBy("question_id").agg(
        F.count_if(wrong).alias("wrong"),
        F.min(F.when(wrong, F.col("at.t"))).alias("first_wrong"),
        F.max(F.when(wrong | (F.col("fb") == "forgot"), F.col("at"))).alias("reset"),
        F.max("at").alias("last"),
        F.max_by("cause", F.when(wrong & F.col("cause").isNotNull(), F.col("at"))).alias("cause"),
    )
    after = rows.select("question_id", "correct", "fb", "at").join(first.select("question_id", "reset"), "question_id").filter(F.col("reset").isNull() | (F.col("at") >= F.col("reset")))
    step = F.col("correct") & F.col("fb").isin("normal", "easy") & (F.col("reset").isNull() | (F.col("at") > F.col("reset")))
    second = after.groupBy("question_id").agg(
        F.count_if(step).alias("steps"),
        F.min(F.when(step, F.struct("at", "fb"))).alias("first_step"),
        F.max(F.when(~step, F.col("at"))).alias("other"),
        F.max_by("fb", "at").alias("last_fb"),
    )
    old = prior.select("question_id", F.col("wrong_count").alias("_wrong"), F.col("correct_streak").alias("_streak"), F.col("last_cause").alias("_cause"), F.col("first_wrong_at").alias("_first"), F.col("due_at").alias("_due"))
    before = F.when(F.col("reset").isNull(), F.coalesce("_streak", F.lit(0))).otherwise(0)
    streak = before + F.col("steps")
    count = F.coalesce("_wrong", F.lit(0)) + F.col("wrong")
    mastered = (streak >= 2) & F.col("last_fb").isin("normal", "easy")
    # A step masters unless it is the first of its streak.
    from_step = (before == 0) & F.col("first_step").isNotNull() & (F.col("other").isNull() | (F.col("first_step.at") > F.col("other")))
    days = F.when(F.col("first_step.fb") == "easy", 5).otherwise(3)
    due = F.when(from_step, plus_days(F.col("first_step.at.t"), days)).when(F.col("other").isNotNull(), plus_days(F.col("other.t"), F.lit(1))).otherwise(F.col("_due"))
    some = count > 0
    return first.join(second, "question_id").join(old, "question_id", "left").select(
        "question_id",
        count.alias("wrong_count"),
        F.when(some, streak).otherwise(0).alias("correct_streak"),
        F.coalesce(some & mastered, F.lit(False)).alias("mastered"),
        F.when(some, F.coalesce("cause", "_cause")).alias("last_cause"),
        F.coalesce("_first", "first_wrong").alias("first_wrong_at"),
        F.col("last.t").alias("last_attempt_at"),
        F.when(some, due).alias("due_at"),
        F.when(some & mastered, F.col("last.t")).alias("completed_at"),
    )


def due_reviews(state: DataFrame, questions: DataFrame, as_of: Column, limit: int | None = 500) -> DataFrame:
    """Questions of the library whose review is open and due, earliest first; a limit of None gives all."""
    open_ = state.filter(F.col("completed_at").isNull() & (F.col("due_at") <= as_of))
    due = open_.join(questions.select(F.col("id").alias("question_id"), "stem", "category"), "question_id").orderBy("due_at", "question_id")
    return due if limit is None else due.limit(limit)


def recent_distinct(attempts: DataFrame, n: int) -> DataFrame:
    """Different questions of the last n attempts (not the last n questions)."""
    return attempts.orderBy(F.desc("created_at"), F.desc("id")).limit(n).select("question_id").distinct()


def units(pool: DataFrame) -> DataFrame:
    """Selection units: a group's questions together, in group order; every other question alone. unit, ids, size.

    A group is the questions of one shared material, so its array stays small.
    """
    return pool.groupBy(F.coalesce(F.concat(F.lit("g"), F.col("group_id").cast("string")), F.concat(F.lit("q"), F.col("id").cast("string"))).alias("unit")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("group_order", F.lit(0)).alias("o"), "id"))), lambda s: s["id"]).alias("ids"), F.count("*").cast("int").alias("size")
    )


def seeded_order(units_: DataFrame, seed: str, key: str = "unit") -> DataFrame:
    """A random order that a seed reproduces: by the md5 of seed and unit."""
    return units_.withColumn("draw", F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string"))))


def packed_units(ordered: DataFrame, count: int, order: str = "position") -> DataFrame:
    """Take units in order while they fit into ``count`` questions; the first always; later ones fill what is left.

    Among units of one size those taken are the first in order, and no more than count / size of them: so the fold
    runs over a list bounded by ``count``, whatever the pool. Returns id and place.
    """
    head = ordered.orderBy(order).limit(1)
    nth = F.row_number().over(Window.partitionBy("size").orderBy(order))
    fitting = ordered.filter(F.col("size") <= count).withColumn("_nth", nth).filter(F.col("_nth") <= count).filter(F.col("_nth") * F.col("size") <= count).drop("_nth")
    near = head.unionByName(fitting).distinct()
    listed = near.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "ids", "size"))).alias("us"))
    empty = F.array().cast(ordered.schema["ids"].dataType)
    fold = F.aggregate(
        "us",
        empty,
        lambda acc, u: F.when((F.size(acc) == 0) | (F.size(acc) + u["size"] <= count), F.concat(acc, u["ids"])).otherwise(acc),
        lambda acc: F.slice(acc, 1, count),
    )
    return listed.select(F.posexplode(fold).alias("place", "id"))


def adaptive_scores(questions: DataFrame, weakness: DataFrame, wrong: DataFrame, attempted: DataFrame, recent: DataFrame, wrong_limit: int = 500) -> DataFrame:
    """Score of every question: 20 x its category's weakness rank (highest first), +12 if some wrong question has its
    category, +3 for each of its tags that wrong questions have, +8 if never tried, -40 if tried of late."""
    ranks = weakness.select("category", "priority")
    wrong_rows = wrong.orderBy("question_id").limit(wrong_limit).join(questions.select(F.col("id").alias("question_id"), "category", "tags"), "question_id")
    categories = wrong_rows.select("category").distinct().withColumn("_wrong", F.lit(12))
    tags = F.broadcast(wrong_rows.select(F.explode("tags").alias("t")).distinct().agg(F.collect_set("t").alias("wrong_tags")).withColumn("_one", F.lit(1)))
    tried = attempted.select(F.col("question_id").alias("id")).distinct().withColumn("_tried", F.lit(0))
    late = recent.select(F.col("question_id").alias("id")).distinct().withColumn("_late", F.lit(-40))
    joined = questions.join(ranks, "category", "left").join(categories, "category", "left").withColumn("_one", F.lit(1)).join(tags, "_one").join(tried, "id", "left").join(late, "id", "left")
    score = 20 * F.coalesce("priority", F.lit(0)) + F.coalesce("_wrong", F.lit(0)) + 3 * F.size(F.array_intersect("tags", "wrong_tags")) + F.coalesce("_tried", F.lit(8)) + F.coalesce("_late", F.lit(0))
    return joined.select("id", score.cast("int").alias("score"))


def exam_scores(items: DataFrame) -> DataFrame:
    """(exam_id, right) items to total, right and score with one decimal."""
    sums = items.groupBy("exam_id").agg(F.count("*").alias("total"), F.count_if("right").alias("correct"))
    return sums.select("exam_id", "total", "correct", percent(F.col("correct"), F.col("total")).alias("score"))


def exam_breakdown(items: DataFrame) -> DataFrame:
    """(category, right, seconds) to whole accuracy, total time and mean time over items that took any."""
    sums = items.groupBy("category").agg(F.count("*").alias("items"), F.count_if("right").alias("correct"), F.sum("seconds").cast("long").alias("seconds"), F.avg(F.when(F.col("seconds") > 0, F.col("seconds"))).alias("mean"))
    return sums.select("category", "items", "correct", F.floor(F.col("correct") * 100 / F.col("items") + 0.5).cast("int").alias("accuracy"), "seconds", F.coalesce(F.floor(F.col("mean") + 0.5), F.lit(0)).cast("long").alias("mean_seconds"))


def superseded(sessions: DataFrame, kind: str = "kind") -> DataFrame:
    """Starting a session ends the open one of its kind: adds ended_at (null while open) and status."""
    nxt = F.lead("started_at").over(Window.partitionBy("user_id", kind).orderBy("started_at", "id"))
    return sessions.withColumn("ended_at", nxt).withColumn("status", F.when(nxt.isNull(), "active").otherwise("abandoned"))


def session_state(session: DataFrame) -> DataFrame:
    """Clamp a session's index to its ids and keep uncertain ids only if they are among them."""
    n = F.size("ids")
    return session.withColumn("index", F.greatest(F.lit(0), F.least(F.col("index"), F.greatest(n - 1, F.lit(0))))).withColumn("uncertain", F.array_intersect("uncertain", "ids"))


def plan_overlay(items: DataFrame, completions: DataFrame) -> DataFrame:
    """Plan items (plan_id, item_id, target) with completed (0 to target) and done."""
    joined = items.join(completions.select("plan_id", "item_id", "completed"), ["plan_id", "item_id"], "left")
    got = F.greatest(F.lit(0), F.least(F.coalesce("completed", F.lit(0)), F.col("target")))
    return joined.withColumn("completed", got).withColumn("done", got >= F.col("target"))


def plan_status(overlay: DataFrame) -> DataFrame:
    """A plan is completed once all its items are done."""
    return overlay.groupBy("plan_id").agg(F.when(F.bool_and("done"), "completed").otherwise("active").alias("status"))


def exam_review(sessions: DataFrame) -> DataFrame:
    """Items of a session in order: its ids, with the snapshot and answer kept in its maps, defaults where missing."""
    items = sessions.select("id", "snapshots", "answers", F.posexplode("question_ids").alias("place", "question_id"))
    answer = F.try_element_at("answers", F.col("question_id"))
    snap = F.try_element_at("snapshots", F.col("question_id"))
    return items.select(F.col("id").alias("exam_id"), "place", "question_id", F.coalesce(snap["category"], F.lit("")).alias("category"), F.coalesce(snap["answer"], F.array().cast("array<string>")).alias("key"), F.coalesce(answer["answer"], F.array().cast("array<string>")).alias("answer"), F.coalesce(answer["seconds"], F.lit(0)).alias("seconds"))


def graded(items: DataFrame, require_answered: bool = False) -> DataFrame:
    """Adds ``right`` to rows with answer and key arrays; a missing answer is an empty one."""
    return items.withColumn("right", is_right(F.col("answer"), F.col("key"), require_answered))


def variant_records(attempts: DataFrame) -> DataFrame:
    """Attempts at variants of questions as rows to append: the variant and the answer as JSON, and whether it is right.

    Takes id, question_id, stem, options, answer, explanation, user_answer and created_at. An answer is right if it has
    the key's different values, trimmed and in upper case, in whatever order; a blank is a value, null is no answer.
    """

    def values(x: str) -> Column:
        given = F.coalesce(F.col(x), F.array().cast("array<string>"))
        return F.array_sort(F.array_distinct(F.transform(given, lambda v: F.upper(F.trim(v)))))

    return attempts.select(
        "id",
        F.col("question_id").alias("source_question_id"),
        F.to_json(F.struct("stem", "options", "answer", "explanation")).alias("variant_json"),
        F.to_json("user_answer").alias("user_answer_json"),
        (values("answer") == values("user_answer")).alias("correct"),
        "created_at",
    )
