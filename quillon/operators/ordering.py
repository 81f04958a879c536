"""Orders over whole tables without a task that holds them: running totals and exact medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.storage import cut


def running_total(rows: DataFrame, amount: str, order: list[Column], total: str = "total", per_task: int = 500_000) -> DataFrame:
    """``rows`` with the sum of ``amount`` over all rows up to each, in an order that should leave no ties.

    Two levels: rows are dealt out in ranges of the order, about ``per_task`` each; a range's sum is added to those behind
    it, and only within a range do rows run one by one. The ranges' sums, one row each, are the only thing in one task.
    """
    n = -(-rows.count() // per_task) or 1
    placed = cut(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = placed.groupBy("_range").agg(F.coalesce(F.sum(amount), F.lit(0)).alias("_sum"))
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum(amount).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return placed.join(F.broadcast(before), "_range").withColumn(total, F.col("_before") + within).drop("_range", "_before")


def medians(rows: DataFrame, key: str, value: str, small: int = 100_000, buckets: int = 1024) -> DataFrame:
    """``key`` and the exact median of ``value`` as ``median``: for an even number of values the mean of the middle two.

    Keys with up to ``small`` values are aggregated as they are. For larger ones the ranks of the middle are sought by
    counting: each round counts the values of ``buckets`` equal parts of the range that is left, map-side, and goes on in
    the part that holds the rank, until its least and greatest value are one. No task gathers a key's values. Nulls are
    left out; NaN and infinite values raise no error but have no place here.
    """
    v = F.col(value).cast("double")
    given = rows.select(key, v.alias("_v")).filter("_v is not null")
    sizes = cut(given.groupBy(key).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "sizes")
    calm = given.join(sizes.filter(F.col("_n") <= small).select(key), key, "left_semi").groupBy(key).agg(F.median("_v").alias("median"))
    hot = sizes.filter(F.col("_n") > small)
    if hot.isEmpty():
        return calm
    middle = F.array(F.expr("(_n - 1) div 2"), F.expr("_n div 2"))
    sought = cut(hot.select(key, F.posexplode(middle).alias("_which", "_rank"), "_lo", "_hi"), "ranks")
    found = sought.filter("_lo = _hi").select(key, "_lo")
    while True:
        open_ = sought.filter("_lo < _hi")
        if open_.isEmpty():
            break
        # Halves keep the difference of two large values finite.
        part = F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * buckets), F.lit(buckets - 1))
        inside = given.join(open_, key).filter("_v between _lo and _hi").withColumn("_part", part)
        counts = inside.groupBy(key, "_which", "_part").agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.first("_rank").alias("_rank"))
        before = F.sum("_c").over(Window.partitionBy(key, "_which").orderBy("_part")) - F.col("_c")
        hit = counts.withColumn("_before", before).filter((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
        sought = cut(hit.select(key, "_which", (F.col("_rank") - F.col("_before")).alias("_rank"), F.col("_least").alias("_lo"), F.col("_most").alias("_hi")), "ranks")
        found = found.unionByName(sought.filter("_lo = _hi").select(key, "_lo"))
    return calm.unionByName(found.groupBy(key).agg((F.sum(F.col("_lo") / 2)).alias("median")))
