"""Helpers of the library as SQL functions of a session, written in SQL, so that Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters and result, and body of each function.
FUNCTIONS: dict[str, tuple[str, str]] = {
    "quillon_clamp": ("(x DOUBLE, low DOUBLE, high DOUBLE) RETURNS DOUBLE", "greatest(least(x, high), low)"),
    "quillon_percent": ("(part DOUBLE, whole DOUBLE) RETURNS DOUBLE", "CASE WHEN whole = 0 THEN 0D ELSE floor(part * 1000 / whole + 0.5D) / 10 END"),
    "quillon_difficulty": (
        "(rate DOUBLE) RETURNS INT",
        "CASE WHEN rate IS NULL THEN 2 WHEN rate >= 80 THEN 1 WHEN rate >= 65 THEN 2 WHEN rate >= 50 THEN 3 WHEN rate >= 35 THEN 4 ELSE 5 END",
    ),
    "quillon_stable_id": ("(parts ARRAY<STRING>, length INT) RETURNS STRING", r"substring(sha2(array_join(parts, '\n', ''), 256), 1, length)"),
    "quillon_error_rate": (
        "(truth STRING, found STRING) RETURNS DOUBLE",
        "CASE WHEN length(truth) = 0 THEN IF(length(found) = 0, 0D, 1D) ELSE least(1D, levenshtein(truth, found) / length(truth)) END",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session, or replaces them; returns their names."""
    for name, (signature, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{signature} RETURN {body}")
    return list(FUNCTIONS)
