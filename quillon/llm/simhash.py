"""SimHash near-duplicates: fingerprints, exact links within a radius by tiles, and their components.

Different fingerprints are put in tiles by the population counts of their four 16-bit quarters. Two fingerprints
within ``radius`` bits have counts that differ by no more than ``radius`` over all quarters, so every other pair of
tiles is skipped unseen. Blocks hold tiles with the same counts of the upper two quarters; pairs of blocks whose counts
differ by more are skipped. The tiles that remain are compared whole with exclusive-or and bit counts. Blocks meet in the
cells of a grid, and each cell returns a spanning forest of its links: all that components need, and no more rows than
fingerprints.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.arrow import id_and_text, map_batches
from quillon.operators.graph import connected_components
from quillon.storage import cut

_BLOCK = 2048
_CELLS = 1 << 18
#: Links of a cell before they are merged to a forest.
_LINKS = 1 << 20


def fingerprint_of(text: str | None, shingle: int = 4) -> int:
    """64-bit fingerprint of a text; zero if it has no word."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = min(shingle, len(words))
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""

    def make(batch: pa.RecordBatch) -> dict:
        prints = np.fromiter((fingerprint_of(t, shingle) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
        return {"doc_id": batch.column("doc_id"), "fp": prints.view(np.int64)}

    return map_batches(id_and_text(docs), make, "doc_id long, fp long")


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places, among the pairs (a, b), of a spanning forest of them. Nodes are small whole numbers."""
    parent = np.arange(max(int(a.max()), int(b.max())) + 1)
    keep = []
    left = np.arange(len(a))
    while len(left):
        ra, rb = parent[a[left]], parent[b[left]]
        left, ra, rb = left[ra != rb], ra[ra != rb], rb[ra != rb]
        if not len(left):
            break
        high, low = np.maximum(ra, rb), np.minimum(ra, rb)
        # Each root hooks on one smaller root at most, so no cycle can close.
        roots, first = np.unique(high, return_index=True)
        parent[roots] = low[first]
        keep.append(left[first])
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return np.concatenate(keep) if keep else np.zeros(0, np.int64)


def _tiles(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints ordered by tile, the counts of each tile's quarters, and where each tile begins (one more number)."""
    counts = np.bitwise_count(prints.view(np.uint16).reshape(-1, 4)).astype(np.int64)
    key = counts @ np.array([1, 32, 1024, 32768])
    order = np.argsort(key, kind="stable")
    _, first = np.unique(key[order], return_index=True)
    return prints[order], counts[order[first]], np.append(first, len(prints))


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within the radius, a bounded number of cells at a time."""
    a, b = [], []
    step = max(1, _CELLS // max(1, len(y)))
    for at in range(0, len(x), step):
        i, j = np.nonzero(np.bitwise_count(x[at : at + step, None] ^ y[None, :]) <= radius)
        a.append(i + at), b.append(j)
    return np.concatenate(a), np.concatenate(b)


def links_between(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two blocks of fingerprints (within one, if they are the same)."""
    if not len(x) or not len(y):
        return x[:0], y[:0]
    x, counts_x, first_x = _tiles(x)
    y, counts_y, first_y = _tiles(y)
    # Small blocks are compared at once: telling their tiles apart would take longer.
    at_once = len(x) * len(y) <= _CELLS // 4
    left, right = ([np.arange(len(x))], [np.arange(len(y))]) if at_once else ([], [])
    for i in range(0 if at_once else len(counts_x)):
        beside = np.abs(counts_y - counts_x[i]).sum(axis=1) <= radius
        if beside.any():
            left.append(np.arange(first_x[i], first_x[i + 1]))
            right.append(np.flatnonzero(np.repeat(beside, np.diff(first_y))))
    pairs_a, pairs_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for rows, columns in zip(left, right):
        i, j = _near(x[rows], y[columns], radius)
        pairs_a.append(rows[i]), pairs_b.append(columns[j])
    a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
    both, inverse = np.unique(np.concatenate((x, y)), return_inverse=True)
    na, nb = inverse[a], inverse[len(x) + b]
    differ = na != nb
    na, nb = na[differ], nb[differ]
    if not len(na):
        return x[:0], y[:0]
    keep = _forest(na, nb)
    return both[na[keep]], both[nb[keep]]


def _near_keys(radius: int) -> list[int]:
    """Differences of two blocks' keys (counts of the upper quarters, base 32) that can hold links, each pair once."""
    span = range(-radius, radius + 1)
    return sorted(k for k in (a * 32 + b for a, b in product(span, repeat=2) if abs(a) + abs(b) <= radius) if k >= 0)


def _groups_for(rows: int) -> int:
    """How many groups blocks are dealt out to: half the root of the blocks, so that neither the blocks that a cell holds nor
    the cells that a block is sent to grow faster than that root."""
    return 1 if rows <= 2 * _BLOCK else max(8, -(-int(np.sqrt(rows / _BLOCK)) // 2))


def _merged(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all these links."""
    x, y = np.concatenate(a), np.concatenate(b)
    if not len(x):
        return x, y
    both, inverse = np.unique(np.concatenate((x, y)), return_inverse=True)
    keep = _forest(inverse[: len(x)], inverse[len(x) :])
    return both[inverse[: len(x)][keep]], both[inverse[len(x) :][keep]]


def cell_links(xs: list[tuple[int, np.ndarray]], ys: list[tuple[int, np.ndarray]] | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two groups of blocks (key and fingerprints), or within one; pairs of blocks
    whose keys differ too much are skipped."""
    steps = {k for d in _near_keys(radius) for k in (d, -d)}
    none = np.zeros(0, np.uint64)
    a, b, held = [none], [none], 0
    for i, (kx, x) in enumerate(xs):
        for ky, y in xs[i:] if ys is None else ys:
            if ky - kx in steps:
                p, q = links_between(x, y, radius)
                a.append(p), b.append(q)
                held += len(p)
                if held > _LINKS:
                    p, q = _merged(a, b)
                    a, b, held = [p], [q], 0
    return _merged(a, b)


def fingerprint_links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Links ``(a, b)`` that join the same fingerprints as all pairs of at most ``radius`` differing bits do.

    ``prints`` has different fingerprints in column fp. Blocks hold about 2,048, so neither a tile's size nor a group
    of near copies decides how much a task holds. Blocks are dealt out to groups, and a cell of the grid of groups gets the
    blocks of its row and its column once each; pairs of blocks are made within it. What is shuffled grows with power 1.5
    of the fingerprints.
    """
    quarter = lambda q: F.bit_count(F.expr(f"shiftrightunsigned(fp, {16 * q}) & 65535"))
    keyed = prints.select("fp", (quarter(3) * 32 + quarter(2)).cast("int").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"))
    # At most 17^2 small rows, so this join never grows with the documents.
    salted = keyed.join(F.broadcast(sizes), "key").select("key", "fp", F.expr(f"cast(pmod(xxhash64(fp), cast(ceil(n / {_BLOCK}) as bigint)) as int)").alias("salt"))
    blocks = cut(salted.groupBy("key", "salt").agg(F.collect_list("fp").alias("fps")), "blocks")
    groups = _groups_for(blocks.agg(F.coalesce(F.sum(F.size("fps")), F.lit(0))).first()[0])
    own = F.pmod(F.xxhash64("key", "salt"), F.lit(groups)).cast("int")
    dealt = blocks.select("key", "fps", own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cells = dealt.select(F.least("own", "other").alias("row"), F.greatest("own", "other").alias("column"), "own", "key", "fps")

    def compare(table: pa.Table) -> pa.Table:
        first, second = table.column("row")[0].as_py(), table.column("column")[0].as_py()
        sides: dict[int, list[tuple[int, np.ndarray]]] = {first: [], second: []}
        for batch in table.to_batches():
            fps = batch.column("fps")
            prints_, ends = fps.values.to_numpy().view(np.uint64), fps.offsets.to_numpy()
            for i, (o, k) in enumerate(zip(batch.column("own").to_pylist(), batch.column("key").to_pylist())):
                sides[o].append((k, prints_[ends[i] : ends[i + 1]]))
        a, b = cell_links(sides[first], None if first == second else sides[second], radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    # Said how many: cells are few bytes and much work, so they must not be put together by their size.
    spread = cells.repartition(groups * (groups + 1) // 2, "row", "column")
    return cut(spread.groupBy("row", "column").applyInArrow(compare, "a long, b long"), "links")


def _grouped(prints: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """(fp, group) of every fingerprint in ``prints``, and (group, low), the smallest doc_id of each group."""
    # Copies meet in one row here, after counting within each task, however many there are.
    different = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "different")
    groups = connected_components(fingerprint_links(different.select("fp"), radius))
    linked = different.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("group"))
    return linked.select("fp", "group"), linked.groupBy("group").agg(F.min("low").alias("low"))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) of every row.

    Null or empty texts have fingerprint zero and link like any other; a null doc_id gets its group's component and
    never names one, unless no row of the group has an id; repeated rows stay; an empty table gives no rows.
    """
    prints = cut(fingerprints(docs, shingle), "fingerprints")
    groups, named = _grouped(prints, radius)
    names = groups.join(named, "group").select("fp", F.col("low").alias("component_id"))
    return prints.join(names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id's, and of its texts the one of smallest hash.

    Rows without an id come last: they stay only where no row of their group has one. A doc_id that several texts share
    is judged text by text; rows that repeat both are one document, and stay or go together. Columns stay as they are;
    an empty table gives no rows.
    """
    text_hash = F.xxhash64(F.col("text").cast("string"))

    def make(batch: pa.RecordBatch) -> dict:
        found = np.fromiter((fingerprint_of(t, shingle) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
        return {"doc_id": batch.column("doc_id"), "hash": batch.column("hash"), "fp": found.view(np.int64)}

    prints = cut(map_batches(id_and_text(docs).withColumn("hash", F.xxhash64("text")), make, "doc_id long, hash long, fp long"), "fingerprints")
    groups, named = _grouped(prints, radius)
    of_row = prints.join(groups.join(named, "group"), "fp").filter("doc_id <=> low")
    stays = cut(of_row.groupBy("group").agg(F.first("low").alias("_id"), F.min("hash").alias("_hash")).select("_id", "_hash"), "stays")
    return docs.join(stays, docs["doc_id"].cast("long").eqNullSafe(stays["_id"]) & (text_hash == stays["_hash"]), "left_semi")
