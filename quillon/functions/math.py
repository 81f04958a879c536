"""Clamps, rates, overlaps and error rates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def percent(part: Column, whole: Column) -> Column:
    """A share in percent with one decimal, halves up; zero for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.floor(part * 1000 / whole + 0.5) / 10)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, or null for an empty whole."""
    return F.try_divide(part, whole)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.when(precision.isNotNull() & recall.isNotNull(), F.lit(0.0)))


def difficulty_of_rate(rate: Column) -> Column:
    """1 (easy) to 5 from the percentage of right answers; 2 if unknown."""
    return F.when(rate.isNull(), 2).when(rate >= 80, 1).when(rate >= 65, 2).when(rate >= 50, 3).when(rate >= 35, 4).otherwise(5)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays of different elements; zero if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def character_error_rate(truth: Column, read: Column) -> Column:
    """Edit distance over the truth's length, at most 1; for an empty truth, whether anything was read."""
    n = F.char_length(truth)
    return F.when(n == 0, F.when(F.char_length(read) == 0, 0.0).otherwise(1.0)).otherwise(F.least(F.lit(1.0), F.levenshtein(truth, read) / n))


def _edges(box: Column) -> list[Column]:
    return [F.try_element_at(box, F.lit(i)) for i in (1, 2, 3, 4)]


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes [x0, y0, x1, y1]."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = _edges(a), _edges(b)
    common = F.greatest(F.lit(0.0), F.least(aw, bw) - F.greatest(ax, bx)) * F.greatest(F.lit(0.0), F.least(ah, bh) - F.greatest(ay, by))
    union = (aw - ax) * (ah - ay) + (bw - bx) * (bh - by) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def x_overlap(a: Column, b: Column) -> Column:
    """Share of the narrower box's width that both cover."""
    (ax, _, aw, _), (bx, _, bw, _) = _edges(a), _edges(b)
    narrow = F.least(aw - ax, bw - bx)
    return F.when(narrow > 0, F.greatest(F.lit(0.0), F.least(aw, bw) - F.greatest(ax, bx)) / narrow).otherwise(0.0)


def centre_inside(inner: Column, outer: Column) -> Column:
    (ax, ay, aw, ah), (bx, by, bw, bh) = _edges(inner), _edges(outer)
    x, y = (ax + aw) / 2, (ay + ah) / 2
    return (x >= bx) & (x <= bw) & (y >= by) & (y <= bh)


def box_is_valid(box: Column) -> Column:
    """Four numbers between 0 and 1 with a positive area."""
    x0, y0, x1, y1 = _edges(box)
    inside = F.forall(box, lambda v: v.isNotNull() & (v >= 0) & (v <= 1))
    return F.coalesce((F.size(box) == 4) & inside & (x1 > x0) & (y1 > y0), F.lit(False))


def reading_score(scores: Column, lines: Column) -> Column:
    """Mean score of recognised lines plus 0.02 for the share of lines that hold a digit."""
    n = F.size(lines)
    mean = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size(scores)
    digits = F.size(F.filter(lines, lambda x: x.rlike("[0-9]")))
    return F.when(n > 0, mean + 0.02 * digits / n).otherwise(0.0)
