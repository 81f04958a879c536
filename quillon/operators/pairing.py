"""Pairing of questions with solutions: by key, by position with an offset, and by section."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from quillon.functions.text import for_alignment, shingles

THRESHOLD, ABORT_SHARE, ABORT_LEAST = 0.55, 0.4, 10


def alignment(stem: Column, excerpt: Column) -> Column:
    """Bigrams of a reprint that are in the stem, with repeats, over the stem's different bigrams; may exceed 1.

    1 without an excerpt, which nothing speaks against; 0 if either has fewer than four characters.
    """
    q, t = for_alignment(F.coalesce(stem, F.lit(""))), for_alignment(excerpt)
    # All lists are bound once: inside a lambda, an outer expression would be evaluated for every element. Common bigrams
    # meet by hash; a place is looked up among these few only, and not at all where every bigram of the reprint is one.
    every = F.regexp_extract_all(t, F.lit("(?s)(?=(.{2}))"), 1)
    both = F.transform(F.array(F.struct(shingles(q, 2).alias("grams"), every.alias("every"))), lambda b: F.struct(b["grams"].alias("grams"), b["every"].alias("every"), F.array_intersect(b["grams"], b["every"]).alias("common"), F.array_distinct(b["every"]).alias("kinds")))
    held = lambda b: F.when(F.size(b["common"]) == F.size(b["kinds"]), F.size(b["every"])).otherwise(F.size(F.filter(b["every"], lambda g: F.array_contains(b["common"], g))))
    score = F.transform(both, lambda b: held(b) / F.size(b["grams"]))[0]
    return F.when(F.coalesce(excerpt, F.lit("")) == "", 1.0).when((F.length(q) < 4) | (F.length(t) < 4), 0.0).otherwise(score)


def by_key(questions: DataFrame, solutions: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Questions (book, set_no, num, stem) with the solution of their set and number, else a grouped answer.

    score is the alignment, verifiable whether there was an excerpt; pairs below the threshold have no answer. A book
    with ten verifiable pairs or more, of which over 40 % fail, is aborted: all its pairs are marked.
    """
    keys = ["book", "set_no", "num"]
    s = solutions.select(*keys, "answer", "excerpt")
    joined = questions.join(s, keys, "left")
    if answers is not None:
        joined = joined.join(answers.select("book", F.col("chapter").alias("set_no"), "num", F.col("answer").alias("_grouped")), keys, "left")
    else:
        joined = joined.withColumn("_grouped", F.lit(None).cast("string"))
    scored = joined.withColumn("score", alignment(F.col("stem"), F.col("excerpt"))).withColumn("verifiable", F.coalesce(F.col("excerpt") != "", F.lit(False)))
    bad = F.col("verifiable") & (F.col("score") < THRESHOLD)
    books = scored.groupBy("book").agg(F.count_if("verifiable").alias("_v"), F.count_if(bad).alias("_b"))
    flagged = scored.join(books, "book").withColumn("aborted", (F.col("_v") >= ABORT_LEAST) & (F.col("_b") > ABORT_SHARE * F.col("_v"))).withColumn("unconfirmed", (F.col("_v") > 0) & (F.col("_v") == F.col("_b")))
    answer = F.when(~bad, F.coalesce(F.nullif("answer", F.lit("")), F.col("_grouped")))
    return flagged.withColumn("answer", F.when(~F.col("aborted"), answer)).drop("_grouped", "_v", "_b", "excerpt")


def by_position(questions: DataFrame, solutions: DataFrame, reach: int = 2) -> DataFrame:
    """Pair the nth question of a set with the (n + offset)th solution, for the offset with the most verified pairs.

    Ties prefer 0, then the smaller shift, then the negative one. One row for each verified pair, with its offset.

    Both sides meet in one table by set, so a text is shuffled once, cut to what is aligned; pairs are made and judged
    where a set's rows stand in order, and only what is verified is shuffled again.
    """
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    q = questions.select("book", "set_no", F.lit(False).alias("_side"), "num", "line_no", none(solutions, "num").alias("solution_num"), none(solutions, "line_no").alias("_line"), none(solutions, "answer").alias("answer"), for_alignment(F.coalesce(F.col("stem"), F.lit(""))).alias("_text"))
    s = solutions.select("book", "set_no", F.lit(True).alias("_side"), none(questions, "num").alias("num"), none(questions, "line_no").alias("line_no"), F.col("num").alias("solution_num"), F.col("line_no").alias("_line"), "answer", for_alignment(F.coalesce(F.col("excerpt"), F.lit(""))).alias("_text"))
    both = q.union(s).filter("book is not null and set_no is not null")
    numbered = both.withColumn("_n", F.row_number().over(Window.partitionBy("book", "set_no", "_side").orderBy("num", "line_no", "solution_num", "_line")))
    # Shorter texts are never alike, but have their places.
    ordered = numbered.filter(F.length("_text") >= 4).withColumn("_first", F.row_number().over(Window.partitionBy("book", "set_no").orderBy("_n", "_side")) == 1)
    columns = ["book", "set_no", "num", "solution_num", "answer"]
    schema = StructType([*(StructField(c, ordered.schema[c].dataType) for c in columns), StructField("offset", IntegerType()), StructField("score", DoubleType())])
    rows = ordered.select(*columns, "_side", "_n", "_first", "_text").sortWithinPartitions("book", "set_no", "_n", "_side")
    # By set at once: the counts of its offsets and the best of them then meet where its pairs are.
    pairs = rows.mapInArrow(_judged(columns, reach), schema).repartition("book", "set_no")
    counted = pairs.withColumn("_n", F.count("*").over(Window.partitionBy("book", "set_no", "offset")))
    best = F.max_by("offset", F.struct("_n", -F.abs("offset"), -F.col("offset"))).over(Window.partitionBy("book", "set_no"))
    return counted.withColumn("_best", best).filter("offset = _best").select("book", "set_no", "num", "solution_num", "offset", "answer", "score")


#: Rows that are judged at once, and places of a text's sketch.
_ROWS, _PLACES = 4096, 256


def _bigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bigrams of texts of two characters or more in turn, as numbers of 42 bits, and how many each text has."""
    c, lengths = _codes("".join(texts.to_pylist())), pa.compute.utf8_length(texts).to_numpy().astype(np.int64)
    return np.delete(c[:-1] << np.uint64(21) | c[1:], np.cumsum(lengths)[:-1] - 1), lengths - 1


def _scores(texts: pa.Array, grams: np.ndarray, counts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``alignment`` of the stems i with the excerpts j, by their bigrams; of equal texts no bigram is looked up."""
    starts = np.cumsum(counts) - counts

    def of(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = counts[rows]
        first = np.cumsum(n) - n
        return np.repeat(keys.astype(np.uint64) << np.uint64(42), n) | grams[np.repeat(starts[rows] - first, n) + np.arange(n.sum())], first

    stems, key = np.unique(i, return_inverse=True)
    known = np.sort(of(stems, np.arange(len(stems)))[0])
    known = known[np.append(True, known[1:] != known[:-1])]
    sizes = np.bincount((known >> np.uint64(42)).astype(np.int64))
    held = counts[j]
    other = np.flatnonzero(pa.compute.not_equal(texts.take(pa.array(i)), texts.take(pa.array(j))).to_numpy(zero_copy_only=False))
    if len(other):
        asked, first = of(j[other], key[other])
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        held[other] = np.add.reduceat((known[at] == asked).astype(np.int64), first)
    return held / sizes[key]


def _judged(columns: list[str], reach: int):
    """A function of rows in the order of their sets and places: the verified pairs within reach, with offset and score."""

    def pairs(table: pa.Table, fresh: int) -> pa.RecordBatch:
        n, side = table.column("_n").to_numpy().astype(np.int64), table.column("_side").to_numpy()
        place = np.cumsum(table.column("_first").to_numpy()) * (n.max() + 2 * reach + 2) + n
        q, s = np.flatnonzero(~side), np.flatnonzero(side)
        found = []
        for offset in range(-reach, reach + 1) if len(s) else ():
            at = np.minimum(np.searchsorted(place[s], place[q] + offset), len(s) - 1)
            met = (place[s[at]] == place[q] + offset) & ((q >= fresh) | (s[at] >= fresh))
            found.append((q[met], s[at[met]], np.full(met.sum(), offset)))
        i, j, offsets = map(np.concatenate, zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        score = np.zeros(0)
        if len(i):
            texts = table.column("_text").combine_chunks()
            grams, counts = _bigrams(texts)
            # A place that only the excerpt has stands for a bigram of its own, a place of the stem for one at least.
            bits = np.zeros((len(counts), _PLACES), bool)
            bits[np.repeat(np.arange(len(counts)), counts), (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)] = True
            sketch = np.packbits(bits, axis=1).view(np.uint64)
            held = counts[j] - np.bitwise_count(sketch[j] & ~sketch[i]).sum(axis=1, dtype=np.int64)
            kept = held >= THRESHOLD * np.bitwise_count(sketch).sum(axis=1, dtype=np.int64)[i] - 1e-9
            i, j, offsets = i[kept], j[kept], offsets[kept]
        if len(i):
            score = _scores(texts, grams, counts, i, j)
            kept = score >= THRESHOLD
            i, j, offsets, score = i[kept], j[kept], offsets[kept], score[kept]
        sides = {"solution_num": j, "answer": j}
        return pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks().take(pa.array(sides.get(c, i))) for c in columns), pa.array(offsets, pa.int32()), pa.array(score, pa.float64())], names=[*columns, "offset", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                table = pa.Table.from_batches([batch.slice(at, _ROWS)])
                fresh = 0 if before is None else before.num_rows
                table = table if before is None else pa.concat_tables([before, table])
                yield pairs(table, fresh)
                # What rows of the next ones may reach: the last places of the last set.
                n, sets = table.column("_n").to_numpy(), np.cumsum(table.column("_first").to_numpy())
                before = table.filter(pa.array((sets == sets[-1]) & (n >= n[-1] - reach)))

    return run


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def common_run(a: str, b: str) -> int:
    """Length of the longest run of characters that both texts hold.

    Bisection over the length: hashes of all runs of one length, from prefix sums, meet or don't; where some meet the runs
    themselves are compared, as runs whose hashes alone are equal would not count.
    """
    x, y = _codes(a), _codes(b)
    power = np.ones(max(len(x), len(y)) + 1, np.uint64)
    power[1:] = 0x9E3779B97F4A7C15
    np.multiply.accumulate(power, out=power)

    def prefix(c: np.ndarray) -> np.ndarray:
        mixed = (c + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        return np.concatenate(([np.uint64(0)], np.cumsum((mixed ^ (mixed >> np.uint64(31))) * power[: len(c)])))

    px, py = prefix(x), prefix(y)

    def shared(n: int) -> bool:
        # Each run's sum is brought to the power of the last place, so that places don't matter.
        hx = (px[n:] - px[:-n]) * power[len(x) - n :: -1][: len(x) - n + 1]
        hy = (py[n:] - py[:-n]) * power[len(y) - n :: -1][: len(y) - n + 1]
        shift = len(x) - len(y)
        hx, hy = (hx, hy * power[shift]) if shift >= 0 else (hx * power[-shift], hy)
        both = np.intersect1d(hx, hy)
        if not len(both):
            return False
        runs = {a[i : i + n] for i in np.flatnonzero(np.isin(hx, both)).tolist()}
        return any(b[i : i + n] in runs for i in np.flatnonzero(np.isin(hy, both)).tolist())

    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if shared(middle) else (low, middle - 1)
    return low


def longest_common(a: str | None, b: str | None) -> float:
    """Length of the longest common run of characters over the shorter text's length; 0 if either is empty."""
    return common_run(a, b) / min(len(a), len(b)) if a and b else 0.0


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """``longest_common`` of two columns, batch by batch."""
    return pd.Series([longest_common(x, y) for x, y in zip(a, b)], dtype="float64")


def by_section(questions: DataFrame, solutions: DataFrame, titles: Column | None = None, least: float = 0.6, gap: int = 3) -> DataFrame:
    """Pair by number within sections that match by title, each solution once. ``titles``: the likeness of q_title and s_title,
    their longest common run over the shorter's length by default.

    A section goes to the one with the most alike title (``least`` or more), else to the one in its position. Of several
    candidates the nearest in order wins; pairs whose orders within their sections differ by more than ``gap`` are left out.
    """
    qs = questions.select("book", F.col("section").alias("q_section"), F.col("title").alias("q_title")).distinct()
    ss = solutions.select("book", F.col("section").alias("s_section"), F.col("title").alias("s_title")).distinct()
    like = qs.join(ss, "book").withColumn("likeness", likeness("q_title", "s_title") if titles is None else titles)
    named = like.filter(F.col("likeness") >= least).groupBy("book", "q_section").agg(F.max_by("s_section", F.struct("likeness", -F.col("s_section"))).alias("s_section"))
    placed = qs.join(named.select("book", "q_section"), ["book", "q_section"], "left_anti").select("book", "q_section", F.col("q_section").alias("s_section"))
    sections = named.unionByName(placed)
    rank = lambda df, p: df.withColumn(p, F.row_number().over(Window.partitionBy("book", "section").orderBy("num", "line_no")))
    q = rank(questions, "_q").select("book", F.col("section").alias("q_section"), "num", "_q", F.col("line_no").alias("q_line"))
    s = rank(solutions, "_s").select("book", F.col("section").alias("s_section"), "num", "_s", F.col("line_no").alias("s_line"), "answer")
    pairs = q.join(sections, ["book", "q_section"]).join(s, ["book", "s_section", "num"]).withColumn("_d", F.abs(F.col("_q") - F.col("_s"))).filter(F.col("_d") <= gap)
    for side in ("s_line", "q_line"):
        other = "q_line" if side == "s_line" else "s_line"
        pairs = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("book", side).orderBy("_d", other))).filter("_r = 1").drop("_r")
    return pairs.select("book", "num", "q_line", "s_line", "answer")


def pairing_summary(questions: DataFrame, solutions: DataFrame, pairs: DataFrame) -> DataFrame:
    """book, paired, pending questions and unused solutions."""
    n = lambda df, name: df.groupBy("book").agg(F.count("*").alias(name))
    joined = n(questions, "q").join(n(solutions, "s"), "book", "full_outer").join(n(pairs, "paired"), "book", "left").na.fill(0)
    return joined.select("book", "paired", (F.col("q") - F.col("paired")).alias("pending"), (F.col("s") - F.col("paired")).alias("unused"))
