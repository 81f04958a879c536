"""Reports over practice history: totals, days, streaks, mastery, diagnosis, essays and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.math import percent
from quillon.functions.time import local_date, midnight_plus, since


def totals(attempts: DataFrame) -> DataFrame:
    """One row: attempts, seconds, correct and accuracy; zeros for none."""
    sums = attempts.agg(F.count("*").alias("attempts"), F.coalesce(F.sum("duration_seconds"), F.lit(0)).cast("long").alias("seconds"), F.count_if("correct").alias("correct"))
    return sums.withColumn("accuracy", percent(F.col("correct"), F.col("attempts")))


def on_day(attempts: DataFrame, as_of: str, zone: str) -> DataFrame:
    """Attempts of the local day of ``as_of``."""
    return attempts.filter(local_date("created_at", zone) == midnight_plus(as_of, zone, 0))


def by_category(attempts: DataFrame, category: Column, none: str = "(none)") -> DataFrame:
    """attempts, correct, accuracy and rounded mean seconds by a category of each attempt (as it was at that time)."""
    groups = attempts.groupBy(F.coalesce(category, F.lit(none)).alias("category"))
    sums = groups.agg(F.count("*").alias("attempts"), F.count_if("correct").alias("correct"), F.avg("duration_seconds").alias("mean"))
    return sums.select("category", "attempts", "correct", percent(F.col("correct"), F.col("attempts")).alias("accuracy"), F.floor(F.col("mean") + 0.5).cast("long").alias("mean_seconds"))


def by_day(attempts: DataFrame, zone: str) -> DataFrame:
    """attempts, accuracy and rounded minutes by local day."""
    days = attempts.groupBy(local_date("created_at", zone).alias("day"))
    sums = days.agg(F.count("*").alias("attempts"), F.count_if("correct").alias("correct"), F.coalesce(F.sum("duration_seconds"), F.lit(0)).cast("long").alias("seconds"))
    return sums.select("day", "attempts", percent(F.col("correct"), F.col("attempts")).alias("accuracy"), F.floor(F.col("seconds") / 60 + 0.5).cast("long").alias("minutes"))


def wrong_causes(attempts: DataFrame, none: str = "(unlabelled)") -> DataFrame:
    cause = F.coalesce(F.nullif(F.trim("wrong_cause"), F.lit("")), F.lit(none))
    return attempts.filter(~F.col("correct")).groupBy(cause.alias("cause")).agg(F.count("*").alias("attempts"))


def mastery(attempts: DataFrame, questions: DataFrame, by: str = "subject") -> DataFrame:
    """attempts and accuracy by a field of the questions as they are now."""
    joined = attempts.join(questions.select(F.col("id").alias("question_id"), by), "question_id")
    sums = joined.groupBy(by).agg(F.count("*").alias("attempts"), F.count_if("correct").alias("correct"))
    return sums.select(by, "attempts", percent(F.col("correct"), F.col("attempts")).alias("accuracy"))


def weakest(mastered: DataFrame, by: str = "subject") -> DataFrame:
    """The field's value with the lowest accuracy; ties go to the first by name."""
    return mastered.agg(F.min_by(by, F.struct("accuracy", by)).alias(by), F.min("accuracy").alias("accuracy"))


def streak(attempts: DataFrame, as_of: str, zone: str) -> DataFrame:
    """Length of the run of local days with attempts that ends today or yesterday; 0 if there is none.

    Days are counted back from ``as_of`` after being reduced to different days, so the window over them is as short
    as the history is in days.
    """
    today = midnight_plus(as_of, zone, 0)
    days = attempts.select(local_date("created_at", zone).alias("day")).distinct().filter(F.col("day") <= today)
    islands = days.withColumn("island", F.date_sub("day", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("day"))))
    runs = islands.groupBy("island").agg(F.count("*").alias("days"), F.max("day").alias("last"))
    return runs.filter(F.col("last") >= F.date_sub(today, 1)).agg(F.coalesce(F.max("days"), F.lit(0)).cast("long").alias("streak"))


def calendar(daily: DataFrame, as_of: str, zone: str, days: int = 14) -> DataFrame:
    """The last ``days`` local days, with zeros for those without attempts. ``daily``: day, attempts, accuracy."""
    first, last = midnight_plus(as_of, zone, 1 - days), midnight_plus(as_of, zone, 0)
    every = daily.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    return every.join(daily, "day", "left").select("day", F.coalesce("attempts", F.lit(0).cast("long")).alias("attempts"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))


def recent(attempts: DataFrame, questions: DataFrame, n: int = 8, none: str = "(deleted)") -> DataFrame:
    """The last n attempts with their question's title, or a default if it is gone."""
    last = attempts.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    return last.join(questions.select(F.col("id").alias("question_id"), "stem"), "question_id", "left").select("id", "question_id", F.coalesce("stem", F.lit(none)).alias("title"), "correct")


def strengths(categories: DataFrame, least: int = 3, accuracy: float = 70.0, top: int = 4) -> DataFrame:
    """Categories with enough attempts and a good accuracy, best first."""
    return categories.filter((F.col("attempts") >= least) & (F.col("accuracy") >= accuracy)).orderBy(F.desc("accuracy"), F.desc("attempts"), "category").limit(top)


def weaknesses(categories: DataFrame, below: float = 80.0, top: int = 4) -> DataFrame:
    """Categories below an accuracy that are no strengths, worst first."""
    rest = categories.join(F.broadcast(strengths(categories).select("category")), "category", "left_anti")
    return rest.filter(F.col("accuracy") < below).orderBy("accuracy", F.desc("attempts"), "category").limit(top)


def recommendations(total: DataFrame, weak: DataFrame, causes: DataFrame, none: str = "(unlabelled)") -> DataFrame:
    """Advice by rules, in order: place, rule, what it is about and its figure.

    By the accuracy of all attempts: first_assessment (there are none), basics (below 60), alternate (below 80) or
    timed_exams. Then the weakest category, and the commonest cause of errors if that is labelled.
    """
    level = F.when(F.col("attempts") == 0, "first_assessment").when(F.col("accuracy") < 60, "basics").when(F.col("accuracy") < 80, "alternate").otherwise("timed_exams")
    overall = total.select(F.lit(1).alias("place"), level.alias("rule"), F.lit("").alias("about"), F.col("accuracy").cast("double").alias("figure"))
    worst = weak.agg(F.min_by(F.struct("category", "accuracy"), F.struct("accuracy", -F.col("attempts"), "category")).alias("w"))
    weakest_one = worst.filter(F.col("w").isNotNull()).select(F.lit(2).alias("place"), F.lit("weakest").alias("rule"), F.col("w.category").alias("about"), F.col("w.accuracy").cast("double").alias("figure"))
    common = causes.agg(F.min_by(F.struct("cause", "attempts"), F.struct(-F.col("attempts"), "cause")).alias("c"))
    cause = common.filter(F.col("c").isNotNull() & (F.col("c.cause") != none)).select(F.lit(3).alias("place"), F.lit("cause").alias("rule"), F.col("c.cause").alias("about"), F.col("c.attempts").cast("double").alias("figure"))
    return overall.unionByName(weakest_one).unionByName(cause)


def essay_summary(evaluations: DataFrame, as_of: str | None = None, days: int | None = None) -> DataFrame:
    """Rows prompt_id, evaluation (JSON), created_at to count, prompts, rounded mean and best score.

    Evaluations that don't parse or have no number as score are skipped.
    """
    rows = evaluations if days is None else evaluations.filter(since("created_at", as_of, days))
    score = F.expr("try_variant_get(try_parse_json(evaluation), '$.score', 'double')")
    scored = rows.select("prompt_id", score.alias("score")).filter("score is not null")
    sums = scored.agg(F.count("*").alias("essays"), F.countDistinct("prompt_id").alias("prompts"), F.avg("score").alias("mean"), F.max("score").alias("best"))
    return sums.select("essays", "prompts", F.floor(F.col("mean") + 0.5).cast("long").alias("mean"), "best")


def plan(weak: DataFrame, days: int = 7, minutes: int = 60, focus: list[str] | None = None, other: str = "综合能力") -> DataFrame:
    """Three items a day on a category in rotation: day (from 1), slot, type, category, target.

    The categories are those asked for (six at most), else the three weakest, else ``other``. A day has reading of a
    quarter of its minutes (10 at least), practice of a question for three minutes (5 to 50) and, each third day, three
    variants, else five reviews. Days are held to 1..30 and minutes to 10..300.
    """
    days, minutes = min(max(int(days + 0.5), 1), 30), min(max(int(minutes + 0.5), 10), 300)
    reading, practice = max(10, int(minutes * 0.25 + 0.5)), min(max(int(minutes / 3 + 0.5), 5), 50)
    if focus:
        chosen = weak.sparkSession.range(1).select(F.array(*map(F.lit, focus[:6])).alias("focus"))
    else:
        worst = weak.orderBy("accuracy", F.desc("attempts"), "category").limit(3).agg(F.array_sort(F.collect_list(F.struct("accuracy", (-F.col("attempts")).alias("n"), "category"))).alias("w"))
        found = F.transform("w", lambda x: x["category"])
        chosen = worst.select(F.when(F.size("w") > 0, found).otherwise(F.array(F.lit(other))).alias("focus"))
    day, slot = F.explode(F.sequence(F.lit(1), F.lit(days))), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    third = F.col("day") % 3 == 0
    kind = F.when(F.col("slot") == 1, "read_knowledge").when(F.col("slot") == 2, "official_practice").when(third, "ai_variant").otherwise("official_review")
    target = F.when(F.col("slot") == 1, reading).when(F.col("slot") == 2, practice).when(third, 3).otherwise(5)
    items = chosen.select("focus", day.alias("day")).select("focus", "day", slot.alias("slot"))
    return items.select("day", "slot", kind.alias("type"), F.element_at("focus", (F.col("day") - 1) % F.size("focus") + 1).alias("category"), target.alias("target"))
