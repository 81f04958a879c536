"""Nearest neighbours by multi-index hashing.

Vectors are turned by a learned rotation and their signs are a binary code. Codes are cut into substrings of 8 bits, and
a block of rows has an index of every substring: for each of its 256 values the rows that have it, as a bitmap.
Two codes within a Hamming radius r = m s + a differ by at most s bits in one of the first a + 1 of m substrings, or by
at most s - 1 in one of the others (pigeonhole), so looking up the values at that distance retrieves every code within r.
The bitmaps of all values at a distance from one are joined once for a block; a query then looks up one for a substring.
Only what is looked up has its whole code compared, and only what is within the radius is ranked, by the inner product of
the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.arrow import _arrow_schema
from quillon.storage import cut

_FOUND = "query_id long, vec_id long, score double, compared long"
_VALUES = np.arange(256, dtype=np.uint8)
#: Pairs that are looked up at a time.
_CELLS = 1 << 20
#: Bytes of vectors of either side that a cell of the grid gets, about.
_CELL = 32 << 20
_ROWS = ("ids", "vectors", "codes")
_ASKED = ("qids", "qvectors", "qcodes")


@dataclass
class Codes:
    """``rotation`` has a column for each bit; ``radius`` is searched first."""

    centre: np.ndarray
    rotation: np.ndarray
    radius: int

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of bytes."""
        return np.packbits((x - self.centre) @ self.rotation > 0, axis=1)


def usable(table: DataFrame) -> DataFrame:
    """vec_id and embedding (array of doubles) of the rows that take part: no null, non-finite or all-zero vectors."""
    v = F.col("embedding").cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).filter(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))


def learn(rows: DataFrame, bits: int | None = None, sample: int = 8000, rounds: int = 30, recall: float = 0.94, k: int = 20) -> Codes:
    """Learn rotations by iterative quantisation on at most ``sample`` rows, the first by a hash of vec_id.

    There are two bits for each dimension, 64 at least: each rotation gives one for a dimension. The radius is the
    smallest that holds ``recall`` of the k nearest of 300 of these rows among the sample; of more rows the nearest are
    nearer, and more of them are found.
    """
    n = rows.count()
    # A hash picks half as many again as are wanted before any task sends rows; repeated ids count once.
    picked = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(min(1.0, max(1.5 * sample, 100) / max(n, 1)) * (1 << 30)))
    drawn = picked.groupBy("vec_id").agg(F.first("embedding").alias("embedding")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    x = np.array(drawn.column("embedding").to_pylist(), float)
    if not len(x):
        return Codes(np.zeros(1), np.zeros((1, 8)), 0)
    dim = x.shape[1]
    bits = bits or max(64, 16 * math.ceil(dim / 8))
    centre = x.mean(axis=0)
    rng = np.random.default_rng(11)
    turns, some = [], x - centre
    for at in range(0, bits, dim):
        width = min(dim, bits - at)
        # Random rotations to begin with, so that further bits of the same dimensions differ.
        turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :width]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(some.T @ np.where(some @ turn > 0, 1.0, -1.0), full_matrices=False)
            turn = u @ vt
        turns.append(turn)
    codes = Codes(centre, np.concatenate(turns, axis=1), 0)
    packed = codes.encode(x)
    asked = np.arange(min(300, len(x)))
    scores = x[asked] @ x.T
    scores[asked, asked] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, len(x) - 1)]
    distances = np.sort(np.bitwise_count(packed[asked][:, None] ^ packed[near]).sum(axis=2, dtype=np.int64).ravel())
    codes.radius = int(distances[min(len(distances) - 1, int(recall * len(distances)))]) if len(distances) else bits
    return codes


class Block:
    """A block of rows with an index of each substring of their codes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray):
        self.ids, self.vectors, self.words = ids, vectors, _words(codes)
        rows = np.arange(len(ids))
        self.index = []
        for j in range(codes.shape[1]):
            has = np.zeros((256, len(ids)), bool)
            has[codes[:, j], rows] = True
            self.index.append([np.packbits(has, axis=1)])

    def _near(self, j: int, reach: int) -> np.ndarray:
        """For each value of a substring: the rows whose value differs by at most ``reach`` bits."""
        held = self.index[j]
        while len(held) <= reach:
            wider = held[-1].copy()
            for bit in range(8):
                wider |= held[-1][_VALUES ^ np.uint8(1 << bit)]
            held.append(wider)
        return held[reach]

    def looked_up(self, codes: np.ndarray, radius: int) -> np.ndarray:
        """Numbers (query number times rows, plus row) of all pairs that agree enough in some substring, each once."""
        m = codes.shape[1]
        met = np.zeros((len(codes), (len(self.ids) + 7) // 8), np.uint8)
        for j in range(m):
            reach = min(8, radius // m - (j > radius % m))
            if reach >= 0:
                met |= self._near(j, reach)[codes[:, j]]
        return np.flatnonzero(np.unpackbits(met, axis=1, count=len(self.ids)))

    def within(self, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (query, row) of codes within the radius: looked up, then compared whole."""
        asked, rows, words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], _words(codes)
        step = max(1, _CELLS // max(1, len(self.ids)))
        for at in range(0, len(codes), step):
            q, r = np.divmod(self.looked_up(codes[at : at + step], radius), len(self.ids))
            q += at
            near = np.zeros(len(q), np.uint16)
            for own, other in zip(self.words, words):
                near += np.bitwise_count(own[r] ^ other[q])
            keep = near <= radius
            asked.append(q[keep]), rows.append(r[keep])
        return np.concatenate(asked), np.concatenate(rows)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, codes: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Query numbers, ids and scores of each query's k best rows within the radius, and how many were scored."""
        q, r = self.within(codes, radius)
        other = query_ids[q] != self.ids[r]
        q, r = q[other], r[other]
        scores = np.empty(len(q))
        for at in range(0, len(q), 1 << 15):
            part = slice(at, at + (1 << 15))
            # Every score is worked out alike, so that equal vectors have equal scores.
            scores[part] = (self.vectors[r[part]] * queries[q[part]]).sum(axis=1)
        return *best(q, self.ids[r], scores, k), len(q)


def _words(codes: np.ndarray) -> list[np.ndarray]:
    """Codes as columns of 64 bits."""
    wide = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), np.uint8)
    wide[:, : codes.shape[1]] = codes
    return [np.ascontiguousarray(c) for c in wide.view(np.uint64).T]


def best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, best first; equal scores by id."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    keep = place < k
    return q[keep], ids[keep], scores[keep]


def _pack(rows: DataFrame, codes: Codes, size: int, slots: int, names: tuple[str, ...]) -> DataFrame:
    """Rows as blocks of at most ``size``, dealt out to slots in turn: ids, vectors and codes.
    Each task packs what it reads, so no vector is shuffled for this."""
    ddl = "slot int, " + ", ".join(f"{n} binary" for n in names)
    schema = _arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        waiting = 0

        def block(table: pa.Table) -> pa.RecordBatch:
            x = np.array(table.column("embedding").to_pylist(), float)
            made = codes.encode(x)
            columns = (table.column("vec_id").to_numpy().astype("<i8"), x.astype("<f8"), made)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((number % slots, *(c.tobytes() for c in columns)), schema)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                held.append(batch.slice(at, size))
                waiting += held[-1].num_rows
                if waiting >= size:
                    table = pa.Table.from_batches(held)
                    yield block(table.slice(0, size))
                    number += 1
                    held, waiting = table.slice(size).to_batches(), waiting - size
        if waiting:
            yield block(pa.Table.from_batches(held))

    return rows.select("vec_id", "embedding").mapInArrow(run, ddl)


def _blocks(table: pa.Table, names: tuple[str, ...], dim: int, m: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors and codes of each block."""
    for batch in table.to_batches():
        for i in range(batch.num_rows):
            ids, vectors, packed = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in zip(names, ("<i8", "<f8", np.uint8)))
            yield ids, vectors.reshape(-1, dim), packed.reshape(-1, m)


def _searched(index: DataFrame, asked: DataFrame, codes: Codes, slots: int, groups: int, radius: int, k: int) -> DataFrame:
    """query_id, vec_id, score of each query's best within the radius; and, on some rows, how many pairs were scored."""
    schema, m, dim = _arrow_schema(_FOUND), codes.bits // 8, codes.rotation.shape[0]

    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        """A cell: its blocks of rows are indexed one after the other, and each query block keeps its k best so far."""
        sought = list(_blocks(queries, _ASKED, dim, m))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        found = [(*none, 0) for _ in sought]
        for own in _blocks(rows, _ROWS, dim, m) if sought else ():
            block = Block(*own)
            for i, query_block in enumerate(sought):
                *new, n = block.search(*query_block, radius, k)
                *old, compared = found[i]
                found[i] = (*best(*(np.concatenate(c) for c in zip(old, new)), k), compared + n)
        out = []
        for (query_ids, _, _), (q, ids, scores, compared) in zip(sought, found):
            first = np.zeros(len(q), np.int64)
            first[:1] = compared
            out.append(pa.table([query_ids[q], ids, scores, first], schema=schema))
        return pa.concat_tables([schema.empty_table(), *out])

    # Rows are dealt into slots and queries into groups, and a block is sent once to each cell of its slot or group. There
    # are as many slots as the root of the number of blocks: then neither what is sent nor the partial results, k for each
    # query and slot, grow with the product of both.
    held = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    sent = asked.withColumnRenamed("slot", "group").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    # Said how many: cells are few bytes and much work, so they must not be put together by their size.
    keys, cells = ["group", "slot"], 2 * groups * slots
    return cut(held.repartition(cells, *keys).groupBy(*keys).cogroup(sent.repartition(cells, *keys).groupBy(*keys)).applyInArrow(search, _FOUND), "found")


def nearest(table: DataFrame, queries: DataFrame, k: int = 20, codes: Codes | None = None, block: int = 2048, query_block: int = 512) -> DataFrame:
    """The k rows of ``table`` with the largest inner product with each query: query_id, rank, vec_id, score.

    Both tables have vec_id and embedding; a query's own vec_id is no candidate. Vectors that are null, zero or hold
    a null or non-finite component take no part; vectors of different lengths have no product, so each length is
    searched by itself (ValueError beyond 64 lengths). Equal scores go to the smaller vec_id; repeated rows count as one
    candidate each; a query id that repeats is asked with the smallest of its vectors; with fewer than k candidates all
    are returned; empty tables give no rows.

    The query set meets all rows in blocks, in the cells of a grid: a block of either side is sent once to a cell and indexed
    there once; what a pair of blocks looks up within the radius is ranked.
    Queries with fewer than k rows within it are searched again with a wider one, in the end with all bits.
    """
    spark = table.sparkSession
    rows, asked = usable(table), usable(queries)
    sizes = sorted(r["n"] for r in rows.groupBy(F.size("embedding").alias("n")).count().limit(65).collect())
    if len(sizes) > 64:
        raise ValueError("more than 64 different lengths of vectors")
    found = [_nearest(rows.filter(F.size("embedding") == n), asked.filter(F.size("embedding") == n), k, codes, block, query_block) for n in sizes]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(rows: DataFrame, queries: DataFrame, k: int, codes: Codes | None, block: int, query_block: int) -> DataFrame:
    """query_id, vec_id, score: at least each query's k best, of vectors of one length."""
    codes = codes or learn(rows, k=k)
    blocks = max(1, math.ceil(rows.count() / block))
    dim = codes.rotation.shape[0]
    slots = max(math.ceil(math.sqrt(blocks)), math.ceil(blocks * block * dim * 8 / _CELL))
    # Few blocks, and whole ones: small files are packed together, without a shuffle.
    index = cut(_pack(rows.coalesce(blocks), codes, block, slots, _ROWS), "index")
    left = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    radius, found = codes.radius, []
    while True:
        left = cut(left, "asked")
        n = left.count()
        if not n:
            break
        groups = max(1, min(math.ceil(math.sqrt(blocks) / 2), math.ceil(n / query_block)), math.ceil(n * dim * 8 / _CELL))
        asked = cut(_pack(left.coalesce(max(1, math.ceil(n / query_block))), codes, query_block, groups, _ASKED), "queries")
        found.append(_searched(index, asked, codes, slots, groups, radius, k).drop("compared"))
        if radius >= codes.bits:
            break
        enough = found[-1].groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
        left = left.join(enough, F.col("vec_id") == F.col("query_id"), "left_anti")
        # What a wider search finds includes what a narrower one did.
        found[-1] = found[-1].join(enough.select("query_id"), "query_id", "left_semi")
        radius = codes.bits if radius >= codes.bits * 3 // 4 else (radius + codes.bits) // 2
    return reduce(DataFrame.unionByName, found) if found else index.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
