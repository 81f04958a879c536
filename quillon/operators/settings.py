"""Settings as rows: defaults, what is stored and a patch of it, merged and kept within their limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.math import clamp
from quillon.functions.time import calendar_date

# Default, least and most of the numeric settings; the other defaults.
NUMBERS = {
    "uiScale": (100, 85, 150),
    "dailyTarget": (30, 1, 500),
    "defaultPracticeCount": (10, 1, 100),
    "defaultExamMinutes": (120, 10, 300),
    "backupRetention": (12, 1, 100),
}
THEME = "light"
FLAGS = {"reduceMotion": False, "autoBackup": True}
NAME_LENGTH = 40

_SCHEMA = ", ".join(["theme string", *(f"{n} double" for n in NUMBERS), *(f"{n} boolean" for n in FLAGS), "examGoalName string", "examGoalDate string"])


def merged(rows: DataFrame, stored: str = "stored", patch: str = "patch") -> DataFrame:
    """Adds a struct ``settings`` to rows with two JSON columns: the patch goes before what is stored, that before the defaults.

    Numbers are rounded, halves up, and clamped; the goal's name is trimmed and cut, a goal's date that doesn't exist is
    empty. A null, or a value that isn't of the setting's type, counts as not given; so does JSON that can't be read.
    """
    new, old = (F.from_json(F.col(c), _SCHEMA) for c in (patch, stored))

    def given(name: str, default: object) -> Column:
        return F.coalesce(new[name], old[name], F.lit(default))

    numbers = [clamp(F.floor(given(n, float(d)) + 0.5), low, high).cast("int").alias(n) for n, (d, low, high) in NUMBERS.items()]
    flags = [given(n, d).alias(n) for n, d in FLAGS.items()]
    day = F.trim(given("examGoalDate", ""))
    goal = [
        F.substring(F.trim(given("examGoalName", "")), 1, NAME_LENGTH).alias("examGoalName"),
        F.when(calendar_date(day).isNotNull(), day).otherwise("").alias("examGoalDate"),
    ]
    return rows.withColumn("settings", F.struct(given("theme", THEME).alias("theme"), *numbers, *flags, *goal))
