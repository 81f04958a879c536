"""Spelling variants: words one edit apart, each led to its most frequent form.

One edit leaves the first or the last half of the shorter word of a pair intact. So all words stand in two sorted
dictionaries, one by their beginnings and one by their endings read backwards, each once for pairs with words of the same
length or longer by one, and once as the longer ones. Ranges of words that share such a half are blocks, and a scan in
sorted order meets each as a whole. Of a block with too many words, what lies between the shared ends is halved in turn:
the edit leaves a half of that intact too. Pairs within a block are verified letter by letter; of the blocks that hold a
pair only one counts it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.arrow import id_and_text, map_batches
from quillon.storage import cut

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
#: Blocks of a worker are halved down to so many words before their pairs are verified.
_FEW = 8
#: Rows of results in a batch.
_ROWS = 8192

Items = list[tuple[str, int]]


def with_planted_slip(doc_id: int | None, word: str) -> str:
    """The word without one letter, where the checksum of the document's id and the word says so; null ids count as no text."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    at = h % len(word)
    return word if h % 199 else word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, least_letters: int = 6, least: int = 5, plant: bool = False) -> DataFrame:
    """word and n, its occurrences in all whole texts: runs of Latin letters, A to Z in lower case.

    ``plant`` first drops a letter where ``with_planted_slip`` says so. Words of less than ``least_letters`` code points or
    ``least`` occurrences are left out. Counts are summed for each part of a batch, then map-side, before the one shuffle.
    """

    def make(batch: pa.RecordBatch) -> dict:
        total: Counter[str] = Counter()
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            raw = Counter(_RUN.findall(text or ""))
            if not plant:
                for run, n in raw.items():
                    if len(run) >= least_letters:
                        total[run.translate(_LOWER)] += n
                continue
            for run, n in raw.items():
                if len(run) >= least_letters:
                    total[with_planted_slip(doc_id, run.translate(_LOWER))] += n
        kept = [(w, n) for w, n in total.items() if len(w) >= least_letters]
        return {"word": [w for w, _ in kept], "n": [n for _, n in kept]}

    return map_batches(id_and_text(docs), make, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def is_near(u: str, v: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(u) > len(v):
        u, v = v, u
    if len(v) - len(u) > 1 or u == v:
        return False
    i = next((i for i, (x, y) in enumerate(zip(u, v)) if x != y), len(u))
    return u[i + 1 :] == v[i + 1 :] if len(u) == len(v) else u[i:] == v[i + 1 :]


def _shared(size: int, path: str) -> tuple[int, int]:
    """How many letters at the beginning and at the end all words of a block share, by its halvings."""
    first = last = 0
    for way in path:
        half = (size - first - last) // 2
        first, last = (first + half, last) if way == "f" else (first, last + half)
    return first, last


def _counts_here(u: str, v: str, size: int, path: str) -> bool:
    """Whether this is the block that counts the pair: at each halving the front one, where the pair shares that."""
    first = last = 0
    for way in path:
        half = (size - first - last) // 2
        if way == "f":
            first += half
        elif u[first : first + half] == v[first : first + half]:
            return False
        else:
            last += half
    return True


def block_pairs(size: int, path: str, items: Items) -> Iterator[tuple[str, int, str, int]]:
    """The near pairs that a block counts; the shorter word of each has ``size`` letters."""
    first, last = _shared(size, path)
    half = (size - first - last) // 2
    if len(items) > _FEW and half:
        for way in "fr":
            groups: defaultdict[str, Items] = defaultdict(list)
            for item in items:
                w = item[0]
                end = len(w) - last
                groups[w[first : first + half] if way == "f" else w[end - half : end]].append(item)
            for group in groups.values():
                if len(group) > 1:
                    yield from block_pairs(size, path + way, group)
        return
    short = [x for x in items if len(x[0]) == size]
    long = [x for x in items if len(x[0]) > size]
    for i, (u, n) in enumerate(short):
        for others in (short[i + 1 :], long):
            for v, k in others:
                if is_near(u, v) and _counts_here(u, v, size, path):
                    yield u, n, v, k


_BLOCK = ("size", "path", "shared")


def _halved(rows: DataFrame) -> DataFrame:
    """Each word in two blocks more, those of the front and the back half of what lies between its shared ends."""
    half = F.expr("(size - first - last) div 2")
    both = rows.select(
        "word", "n", "size",
        F.explode(F.array(
            F.struct(F.concat("path", F.lit("f")).alias("path"), (F.col("first") + half).cast("int").alias("first"), F.col("last")),
            F.struct(F.concat("path", F.lit("r")).alias("path"), F.col("first"), (F.col("last") + half).cast("int").alias("last")),
        )).alias("b"),
    ).select("word", "n", "size", "b.*")
    # Words hold letters only: a blank parts the shared beginning from the shared ending, which is read backwards.
    return both.withColumn("shared", F.concat(F.expr("substring(word, 1, first)"), F.lit(" "), F.expr("substring(reverse(word), 1, last)")))


def near_pairs(words: DataFrame, block: int = 20_000) -> DataFrame:
    """word, near, near_n: every pair of ``words`` (word, n; each word once) that one edit parts, either way round.

    A task holds one block at a time, of ``block`` words at most; larger ones are halved first, counted and joined in
    Spark, as often as it takes. A block that can't be halved has one letter between its ends, so it holds a few thousand
    words at most.
    """
    each = words.withColumn("size", F.explode(F.array(F.char_length("word"), F.char_length("word") - 1)))
    rows = _halved(each.select("word", "n", "size", F.lit("").alias("path"), F.lit(0).alias("first"), F.lit(0).alias("last")))
    scanned = None
    while True:
        large = cut(rows.filter("size - first - last >= 2").groupBy(*_BLOCK).count().filter(F.col("count") > block).select(*_BLOCK), "large_blocks")
        none = large.isEmpty()
        fit = rows if none else rows.join(large, list(_BLOCK), "left_anti").select(rows.columns)
        scanned = fit if scanned is None else scanned.unionByName(fit)
        if none:
            break
        rows = cut(_halved(rows.join(large, list(_BLOCK), "left_semi").drop("shared")), "halved_blocks")
    ordered = scanned.select(*_BLOCK, "word", "n").repartitionByRange(*_BLOCK).sortWithinPartitions(*_BLOCK, "word")
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, str, int]] = []
        for (size, path), items in _ranges(batches):
            for u, n, v, k in block_pairs(size, path, items):
                out += [(u, v, k), (v, u, n)]
                if len(out) >= _ROWS:
                    yield _batch(out, schema)
                    out = []
        if out:
            yield _batch(out, schema)

    return ordered.mapInArrow(scan, "word string, near string, near_n long")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows), schema)], schema=schema)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, str], Items]]:
    """The words of each block, from rows in order; a block may go on in the next batch."""
    key, items = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*_BLOCK, "word", "n")]
        for size, path, shared, word, n in zip(*columns):
            if (size, path, shared) != key:
                if len(items) > 1:
                    yield key[:2], items
                key, items = (size, path, shared), []
            items.append((word, n))
    if len(items) > 1:
        yield key[:2], items


def group_variants(docs: DataFrame, least_letters: int = 6, least: int = 5, ratio: int = 5, block: int = 20_000, plant: bool = False) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word with enough letters and occurrences.

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of largest n,
    of these the smallest by code points, if that n is at least ``ratio`` times its own, else null; its root is what forms
    lead to in the end. Null and empty texts have no words, repeated rows count each, null ids count as other ids do,
    further columns are ignored and an empty table gives no rows. ``ratio`` of two or more ends every chain.
    """
    if ratio < 2:
        raise ValueError("ratio must be two or more")
    words = cut(word_counts(docs, least_letters, least, plant), "words")
    near = near_pairs(words, block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    kept = F.col("best.less") * -1 >= F.col("n") * ratio
    joined = words.join(near, "word", "left")
    judged = cut(joined.select("word", F.when(kept, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(kept, -F.col("best.less")).alias("form_n")), "judged")
    ends = _followed(judged.filter("form is not null").select("word", F.col("form").alias("up")))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("up", "word").alias("root"), "n", "n_near", "form_n")


def _followed(links: DataFrame) -> DataFrame:
    """word and the end of its chain: each round doubles the steps taken; chains are as long as n can grow by the ratio."""
    while True:
        on = links.select(F.col("word").alias("up"), F.col("up").alias("further"))
        stepped = cut(links.join(on, "up", "left").select("word", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), "chains")
        if stepped.filter("moved").isEmpty():
            return stepped.drop("moved")
        links = stepped.drop("moved")
