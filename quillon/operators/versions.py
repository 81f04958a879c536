"""Upserts, diffs, snapshots and state changes over library tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.ordering import running_total


def diff(old: DataFrame, new: DataFrame, key: str = "id", content: str = "content_hash") -> DataFrame:
    """key and change (added, updated, removed, same) between two versions of a library; a null content equals a null one."""
    o, n = (df.select(key, F.struct(F.col(content).alias("c")).alias(side)) for df, side in ((old, "_old"), (new, "_new")))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_old.c").eqNullSafe(F.col("_new.c")), "updated").otherwise("same")
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def to_parse(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, content_hash) that are new or changed; all others are taken over as they are."""
    return files.join(known.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def reused(files: DataFrame, known: DataFrame) -> DataFrame:
    """Known rows whose file hasn't changed."""
    return known.join(files.select("path", "content_hash"), ["path", "content_hash"], "left_semi")


def replaced(old: DataFrame, new: DataFrame, key: str = "id", content: str = "content_hash") -> DataFrame:
    """The new version's rows; those whose content didn't change keep the old row."""
    same = diff(old, new, key, content).filter("change = 'same'").select(key)
    return old.join(same, key, "left_semi").select(*new.columns).unionByName(new.join(same, key, "left_anti"))


def retained(snapshots: DataFrame, group: str, order: str, keep: int = 5, tie: str = "id") -> DataFrame:
    """The latest ``keep`` rows of each group."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order), F.desc(tie)))
    return snapshots.withColumn("_n", n).filter(F.col("_n") <= keep).drop("_n")


def upserted(current: DataFrame, changes: DataFrame, key: list[str], order: str, keep_if_null: list[str]) -> DataFrame:
    """Latest row by key; a null in a field of ``keep_if_null`` keeps the last value that isn't null."""
    every = current.withColumn("_at", F.lit(None).cast(changes.schema[order].dataType)).unionByName(changes.withColumn("_at", F.col(order)).select(*current.columns, "_at"))
    at = F.struct(F.coalesce(F.col("_at"), F.lit(None)).isNotNull(), F.col("_at"))
    out = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) if c in keep_if_null else F.max_by(F.col(c), at).alias(c) for c in current.columns if c not in key]
    return every.groupBy(*key).agg(*out).select(*current.columns)


def latest(log: DataFrame, key: list[str], order: str, tie: str) -> DataFrame:
    """The last row of each key of an append-only log."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, tie)).alias("_r")).select(*key, "_r.*").select(*log.columns)


def toggled(log: DataFrame, key: str, order: str) -> DataFrame:
    """Keys that were switched an odd number of times, with the last time."""
    return log.groupBy(key).agg((F.count("*") % 2 == 1).alias("_on"), F.max(order).alias(order)).filter("_on").drop("_on")


def capped_note(content: Column, most: int = 200_000) -> Column:
    return F.substring(content, 1, most)


def with_cause(wrong: DataFrame, changes: DataFrame, most: int = 40) -> DataFrame:
    """Set causes (question_id, cause) of rows that are in the wrong-book already; a blank one becomes null."""
    new = changes.select("question_id", F.lit(True).alias("_set"), F.nullif(F.substring(F.trim("cause"), 1, most), F.lit("")).alias("_cause"))
    return wrong.join(new, "question_id", "left").withColumn("last_cause", F.when(F.col("_set"), F.col("_cause")).otherwise(F.col("last_cause"))).drop("_set", "_cause")


def reviewed(artifacts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply approve, reject and reopen to pending, approved and rejected artifacts; published ones never change."""
    joined = artifacts.join(decisions.select("id", "decision"), "id", "left")
    to = F.when(F.col("decision") == "approve", "approved").when(F.col("decision") == "reject", "rejected").when(F.col("decision") == "reopen", "pending")
    may = F.col("decision").isNotNull() & (F.col("status") != "published") & to.isNotNull() & (to != F.col("status"))
    return joined.withColumn("processed", may).withColumn("status", F.when(may, to).otherwise(F.col("status"))).drop("decision")


def published(artifacts: DataFrame) -> DataFrame:
    """Approved artifacts that the gate allows become published."""
    return artifacts.withColumn("status", F.when((F.col("status") == "approved") & F.col("allowed"), "published").otherwise(F.col("status")))


def reverted(library: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The library without the rows that an import published."""
    return library.join(artifacts.select("id"), "id", "left_anti")


def remapped(table: DataFrame, mapping: DataFrame, column: str = "question_id") -> DataFrame:
    """Replace ids by ``mapping`` (old, new); rows whose id isn't mapped are left out."""
    joined = table.join(mapping.select(F.col("old").alias(column), F.col("new").alias("_new")), column)
    return joined.select(*[F.col("_new").alias(c) if c == column else F.col(c) for c in table.columns])


def switched(rows: DataFrame, chosen: object, key: str = "id") -> DataFrame:
    """Exactly the chosen row is active."""
    return rows.withColumn("active", F.col(key) == F.lit(chosen))


def evicted(entries: DataFrame, most_bytes: int, per_task: int = 500_000) -> DataFrame:
    """Cache entries (key, bytes, used_at) that have to go, the longest unused first, until the rest fits.

    The running total over all entries is summed by ranges of about ``per_task`` entries, whatever times they share.
    """
    totals = running_total(entries.select("key", "bytes", "used_at"), "bytes", [F.desc("used_at"), F.asc("key")], per_task=per_task)
    return totals.filter(F.col("total") > most_bytes).select("key", "bytes", "used_at")


def missing(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Conversions (converter, content_hash) that the cache doesn't hold, with their key."""
    key = F.substring(F.sha2(F.concat_ws("|", "converter", "content_hash"), 256), 1, 32)
    return wanted.withColumn("key", key).join(cache.filter("valid").select("key"), "key", "left_anti")


def protected_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows whose protected fields a revision changed, with those fields' names in order; null equals null.

    Keys that only one side has, and null keys, take no part: a new or deleted row changes no field.
    """
    old = before.select(F.col(key), F.struct(*fields).alias("_old"))
    new = after.select(F.col(key), F.struct(*fields).alias("_new"))
    changed = F.array_compact(F.array(*(F.when(~F.col(f"_old.{f}").eqNullSafe(F.col(f"_new.{f}")), F.lit(f)) for f in fields)))
    return old.join(new, key).select(key, changed.alias("changed")).filter(F.size("changed") > 0)


def emptied(tables: dict[str, DataFrame], names: list[str]) -> dict[str, DataFrame]:
    """The tables with those of the given names emptied, their columns kept; the rest as they are."""
    unknown = set(names) - set(tables)
    if unknown:
        raise ValueError(f"no such tables: {sorted(unknown)}")
    return {n: t.limit(0) if n in names else t for n, t in tables.items()}
