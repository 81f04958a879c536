"""Evaluation and sampling: surveys, strata, splits without leakage, agreement, precision and recall, error rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.math import f1, jaccard
from quillon.functions.text import digit_tokens
from quillon.operators.ordering import medians


def survey(pages: DataFrame) -> DataFrame:
    """(book, subject, file, page, has_text, images) to files, pages, scan ratio and images by file, subject and in all."""
    n, scanned = F.count("*"), F.count_if(~F.col("has_text"))
    return (
        pages.cube("subject", "file")
        .agg(F.grouping_id().alias("level"), F.countDistinct("file").alias("files"), n.alias("pages"), F.bround(scanned / n, 4).alias("scan_ratio"), F.sum("images").cast("long").alias("images"))
        .filter("level <> 2")
    )


def lengths_by_type(pages: DataFrame) -> DataFrame:
    """(type, text) to pages and rounded mean characters."""
    return pages.groupBy("type").agg(F.count("*").alias("pages"), F.bround(F.avg(F.char_length("text"))).cast("long").alias("mean_chars"))


def timings(runs: DataFrame, small: int = 100_000) -> DataFrame:
    """(engine, ms, rss, error) to exact median ms, peak rss and errors; engines with over ``small`` runs are sought by rank."""
    sums = runs.groupBy("engine").agg(F.count("*").alias("pages"), F.max("rss").alias("peak"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    middle = medians(runs, "engine", "ms", small).withColumnRenamed("median", "median_ms")
    return sums.join(middle, "engine", "left").select("engine", "pages", "median_ms", "peak", "errors")


def digit_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean Jaccard index of the numbers that two runs (page, text) read, over pages in which either read any."""
    ta, tb = a.select("page", digit_tokens(F.col("text")).alias("ta")), b.select("page", digit_tokens(F.col("text")).alias("tb"))
    both = ta.join(tb, "page").filter((F.size("ta") > 0) | (F.size("tb") > 0))
    return both.agg(F.count("*").alias("pages"), F.round(F.avg(jaccard(F.col("ta"), F.col("tb"))), 6).alias("agreement"))


def stratified(rows: DataFrame, strata: list[str], quota: int | Column, seed: str, key: str) -> DataFrame:
    """The first ``quota`` rows of each stratum in an order that the seed draws. The quota is the feature."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    n = F.row_number().over(Window.partitionBy(*strata).orderBy(draw, key))
    return rows.withColumn("_n", n).filter(F.col("_n") <= quota).drop("_n")


def split_of(source: Column, seed: str, shares: tuple[tuple[str, float], ...] = (("tune", 0.6), ("check", 0.2), ("final", 0.2))) -> Column:
    """The set that a source belongs to, by its hash: all its rows go to one set, so none leaks into another."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), source.cast("string"))), 1, 6), 16, 10).cast("long") / float(1 << 24)
    out, edge = None, 0.0
    for name, share in shares[:-1]:
        edge += share
        out = F.when(draw < edge, name) if out is None else out.when(draw < edge, name)
    return F.lit(shares[0][0]) if out is None else out.otherwise(shares[-1][0])


def leakage_free(rows: DataFrame, source: str, kind: str, key: str, seed: str, per_source: int = 4, quota: int = 6) -> DataFrame:
    """Rows with their set: at most ``per_source`` of a source and ``quota`` of a kind in each set, drawn by the seed."""
    drawn = stratified(rows, [source], per_source, seed, key).withColumn("set", split_of(F.col(source), seed))
    return stratified(drawn, ["set", kind], quota, seed + "#", key)


def balanced_split(counts: dict[tuple[str, str], int], wanted: dict[str, dict[str, int]], per_source: int = 4) -> dict[str, str] | None:
    """A set for each source, so that every set gets its exact number of rows of each kind; None if there is no way.

    ``counts``: rows by (source, kind). ``wanted``: rows by set and kind. The search is exact and runs on the driver,
    over sources (a few hundred at most), those with the most rows first.
    """
    sources = sorted({s for s, _ in counts}, key=lambda s: (-sum(n for (t, _), n in counts.items() if t == s), s))
    left = {name: dict(kinds) for name, kinds in wanted.items()}
    chosen: dict[str, str] = {}

    def place(i: int) -> bool:
        if all(n <= 0 for kinds in left.values() for n in kinds.values()):
            return True
        if i == len(sources):
            return False
        own = {k: min(n, per_source) for (s, k), n in counts.items() if s == sources[i]}
        for name in sorted(left):
            use = {k: min(n, left[name].get(k, 0)) for k, n in own.items()}
            if not any(use.values()):
                continue
            for k, n in use.items():
                left[name][k] -= n
            chosen[sources[i]] = name
            if place(i + 1):
                return True
            del chosen[sources[i]]
            for k, n in use.items():
                left[name][k] += n
        return place(i + 1)

    return chosen if place(0) else None


def confusion(rows: DataFrame, truth: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """True and false positives and negatives, precision, recall and F1 (null where nothing can be divided)."""
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(predicted, F.lit(False))
    sums = rows.groupBy(*(by or [])).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    scored = sums.withColumn("precision", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 6)).withColumn("recall", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 6))
    return scored.withColumn("f1", F.round(f1(F.col("precision"), F.col("recall")), 6))


def matched_items(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer match of two lists on their keys: matched, missed and invented. The last of repeated found rows counts."""
    last = found.groupBy(*keys).agg(F.max_by("text", "ordinal").alias("read"))
    t = truth.select(*keys, F.col("text").alias("truth")).withColumn("_t", F.lit(True))
    joined = t.join(last.withColumn("_f", F.lit(True)), keys, "full_outer")
    state = F.when(F.col("_t") & F.col("_f"), "matched").when(F.col("_t"), "missed").otherwise("invented")
    return joined.select(*keys, "truth", "read", state.alias("state"))


def page_metrics(matched: DataFrame, page: str = "page") -> DataFrame:
    """Of each page: truth, found, matched, recall, precision and mean character error rate of the matched."""
    from quillon.functions.math import character_error_rate

    hit = F.count_if(F.col("state") == "matched")
    truth, found = F.count_if(F.col("state") != "invented"), F.count_if(F.col("state") != "missed")
    error = F.when(F.col("state") == "matched", character_error_rate(F.col("truth"), F.col("read")))
    return matched.groupBy(page).agg(truth.alias("truth"), found.alias("found"), hit.alias("matched"), F.try_divide(hit, truth).alias("recall"), F.try_divide(hit, found).alias("precision"), F.avg(error).alias("cer"))


def aggregated(metrics: DataFrame, means: list[str], sums: list[str], by: tuple[str, str] = ("set", "type")) -> DataFrame:
    """Means that skip nulls and sums, in all, by each field and not by both: level says which."""
    a, b = by
    return (
        metrics.cube(a, b)
        .agg(F.grouping_id().alias("level"), F.count("*").alias("pages"), *(F.bround(F.avg(m), 6).alias(m) for m in means), *(F.sum(s).cast("long").alias(s) for s in sums))
        .filter("level <> 0")
    )


def annotation_errors(pages: DataFrame, sets: tuple[str, ...] = ("tune", "check", "final")) -> DataFrame:
    """Adds ``errors`` to annotations (pageId, pageNumber, set, annotator, questions of setNumber, number and stem, boxes)."""
    keys = F.transform("questions", lambda q: F.struct(q["setNumber"].alias("s"), q["number"].alias("n")))
    box_ok = lambda b: F.coalesce((F.size(b) == 4) & (F.get(b, F.lit(2)) > F.get(b, F.lit(0))) & (F.get(b, F.lit(3)) > F.get(b, F.lit(1))), F.lit(False))
    checks = {
        "page": F.col("pageNumber") < 1,
        "set": ~F.col("set").isin(*sets),
        "annotator": F.trim("annotator").isin("", "prefill"),
        "number": F.exists("questions", lambda q: ~q["number"].between(1, 999)),
        "twice": F.size(F.array_distinct(keys)) < F.size(keys),
        "stem": F.exists("questions", lambda q: F.trim(q["stem"]) == ""),
        "box": F.exists("boxes", lambda b: ~box_ok(b)),
    }
    return pages.withColumn("errors", F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in checks.items())), lambda e: e.isNotNull()))


def passed(cases: DataFrame) -> DataFrame:
    """(feature, failures array) to cases and the share without failures."""
    return cases.groupBy("feature").agg(F.count("*").alias("cases"), F.round(F.avg((F.size("failures") == 0).cast("int")), 4).alias("accuracy"))


def sequence_accuracy(truth: list | None, read: list | None) -> float | None:
    """Share of the truth that a longest common subsequence of both lists keeps; None for an empty truth."""
    truth, read = list(truth if truth is not None else []), list(read if read is not None else [])
    if not truth:
        return None
    row = [0] * (len(read) + 1)
    for t in truth:
        corner = 0
        for j, r in enumerate(read, 1):
            corner, row[j] = row[j], corner + 1 if t == r else max(row[j], row[j - 1])
    return row[-1] / len(truth)
