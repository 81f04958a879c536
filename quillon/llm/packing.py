"""Best-fit packing of documents into sequences, by bin completion on the histogram of lengths.

How many pieces there are of each length decides the packing, so the search sees a histogram of at most ``capacity``
numbers, however many documents there are. Its result is a list of fillings with the number of sequences that use
each. Pieces then find their place by their rank among the pieces of their length; no piece is sent to the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.arrow import _arrow_schema, encoder, id_and_text, parts
from quillon.storage import cut

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@dataclass
class Filling:
    """So many sequences hold these pieces: (length, how many of it), longest first."""

    pieces: tuple[tuple[int, int], ...]
    sequences: int


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: the larger of the total's bound and Martello and Toth's L2."""
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    for small in range(0, capacity // 2 + 1):
        alone = sum(c for n, c in counts.items() if n > capacity - small)
        over = {n: c for n, c in counts.items() if capacity - small >= n > capacity / 2}
        rest = sum(n * c for n, c in counts.items() if capacity / 2 >= n >= small)
        room = sum(over.values()) * capacity - sum(n * c for n, c in over.items())
        best = max(best, alone + sum(over.values()) + max(0, -(-(rest - room) // capacity)))
    return best


def middle_bound(counts: dict[int, int], capacity: int) -> tuple[int, int]:
    """A bound for pieces of about a third to a half of a sequence, and the length from which pieces count half a sequence.

    A piece of length n weighs a third of a sequence, more or less by its distance from a third of the capacity, such that
    those of length t and more weigh half of one; nothing below zero. No sequence holds more than a weight of one: for
    three pieces the weights rise with their sum, four weigh less, and for two they are a half at most. So the weights'
    sum is a bound for each t from over a third to a half of the capacity, of which the best is taken.
    """
    n, c = (np.array(x, float) for x in (list(counts), list(counts.values())))
    third = capacity / 3
    best, at = 0, capacity // 2
    for t in range(int(third) + 1, capacity // 2 + 1):
        weight = np.clip(1 / 3 + (n - third) / (6 * (t - third)), 0, 0.5)
        found = int(np.ceil((weight * c).sum() - 1e-6))
        if found > best:
            best, at = found, t
    return best, at


def paired(counts: dict[int, int], capacity: int, least: int) -> list[Filling]:
    """The pieces from ``least`` to half the capacity two by two, the longest together; an odd one is left out."""
    out, held = [], 0
    for n in sorted((n for n in counts if least <= n <= capacity // 2), reverse=True):
        c = counts[n]
        if held and c:
            out.append(Filling(((held, 1), (n, 1)), 1))
            held, c = 0, c - 1
        if c > 1:
            out.append(Filling(((n, 2),), c // 2))
        held = n if c % 2 else held
    return out


def best_fit(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Best-fit decreasing: each piece, longest first, goes to the fullest sequence that takes it."""
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    rooms = np.zeros(capacity + 1, np.int64)  # sequences by the room they have

    def put(room: int, pieces: tuple, sequences: int) -> None:
        open_.setdefault(room, []).append((pieces, sequences))
        rooms[room] += sequences

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            fits = np.flatnonzero(rooms[n:])
            room = int(fits[0]) + n if len(fits) else capacity
            if len(fits):
                pieces, there = open_[room].pop()
                rooms[room] -= there
            else:
                pieces, there = (), left
            each = min(room // n, left)
            use = min(there, left // each)
            if len(fits) and there > use:
                put(room, pieces, there - use)
            put(room - each * n, (*pieces, (n, each)), use)
            left -= use * each
    return [Filling(p, s) for groups in open_.values() for p, s in groups]


def completions(room: int, lengths: list[int], left: dict[int, int], most_waste: int, width: int, steps: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Undominated ways to fill ``room``: (waste, pieces), least waste first, at most ``width``.

    ``lengths`` falls. A filling that another piece would still fit in is dominated and isn't listed; and where one
    piece fills the room exactly, every other filling is.
    """
    found: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    budget = [steps]
    least = lengths[-1] if lengths else room + 1

    def go(i: int, room: int, chosen: tuple[tuple[int, int], ...]) -> bool:
        budget[0] -= 1
        if budget[0] < 0:
            return True
        if room < least:
            if room <= most_waste:
                found.append((room, chosen))
            return len(found) >= width and found[-1][0] == 0
        fitted = False
        while i < len(lengths):
            n = lengths[i]
            if n <= room:
                most = min(left[n], room // n)
                if most:
                    fitted = True
                    for k in range(most, 0, -1):
                        if go(i + 1, room - k * n, (*chosen, (n, k))):
                            return True
            i += 1
        if not fitted and room <= most_waste:
            used = dict(chosen)
            if not any(n <= room and left[n] > used.get(n, 0) for n in lengths):
                found.append((room, chosen))
        return len(found) >= 4 * width

    go(0, room, ())
    found.sort(key=lambda f: (f[0], [(-n, -k) for n, k in f[1]]))
    single = [f for f in found if f[0] == 0 and len(f[1]) == 1 and f[1][0][1] == 1]
    return (single or found)[:width]


@dataclass
class Plan:
    """Fillings, how many sequences they are, and how many any packing needs at least."""

    fillings: list[Filling]
    sequences: int
    bound: int


def plan(counts: dict[int, int], capacity: int, nodes: int = 4000, width: int = 3, steps: int = 3000) -> Plan:
    """Branch and bound over the fillings around the longest piece left, from the best-fit incumbent.

    The search starts from all pieces, and from what is left once the pieces that ``middle_bound`` counts as half a
    sequence, or some more or fewer, are paired: those fill sequences best two by two, though a filling with less waste
    may be had for each. A branch is cut when its waste exceeds what a packing with one sequence less than the
    incumbent may waste. The search ends at the bound or after ``nodes`` fillings; the best packing met is returned. At
    the bound it is optimal; else that isn't proven, even where no branch is left, as at most ``width`` fillings are
    followed at each node, found in ``steps`` steps, and each is used as often as it fits, or half as often as a later
    branch. Equal fillings go by longest piece first.
    """
    counts = {n: c for n, c in counts.items() if c > 0}
    if not counts:
        return Plan([], 0, 0)
    half, at = middle_bound(counts, capacity)
    bound = max(lower_bound(counts, capacity), half)
    total = sum(n * c for n, c in counts.items())
    best = best_fit(counts, capacity)
    size = sum(f.sequences for f in best)
    # Each entry: pieces left, waste so far, fillings so far, their sequences. Depth first, best completion on top.
    roots: list[tuple[dict[int, int], int, tuple, int]] = [(counts, 0, (), 0)]
    if size > bound:
        for least in dict.fromkeys(int(at * x) for x in (1.0, 0.98, 1.02, 0.95, 1.05)):
            pairs = paired(counts, capacity, least)
            path, left, used = (), dict(counts), 0
            for f in pairs:
                path, used = (path, f.pieces, f.sequences), used + f.sequences
                for n, k in f.pieces:
                    left[n] -= k * f.sequences
            if pairs:
                left = {n: c for n, c in left.items() if c}
                roots.append((left, used * capacity - (total - sum(n * c for n, c in left.items())), path, used))
    # All pieces with whole branches, then each root with halved ones as well.
    for root, halved, share in [(roots[0], False, nodes), *((r, True, nodes // 4) for r in [*roots[1:], roots[0]])]:
        spent, stack = 0, [root]
        while stack and size > bound and spent < share:
            left, waste, path, used = stack.pop()
            if waste > (size - 1) * capacity - total:
                continue
            if not left:
                if used < size:
                    size, best = used, _listed(path)
                continue
            spent += 1
            lengths = sorted(left, reverse=True)
            top = lengths[0]
            after = dict(left)
            after[top] -= 1
            room = capacity - top
            allowed = (size - 1) * capacity - total - waste
            ways = completions(room, [n for n in lengths if n <= room], after, allowed, width, steps) if room >= lengths[-1] else ([(room, ())] if room <= allowed else [])
            branches = []
            for lost, pieces in ways:
                each = dict(pieces)
                each[top] = each.get(top, 0) + 1
                times = min(left[n] // k for n, k in each.items())
                if lost:
                    times = min(times, max(1, allowed // lost))
                for t in dict.fromkeys((times, -(-times // 2)) if halved else (times,)):
                    rest = {n: c - t * each.get(n, 0) for n, c in left.items()}
                    branches.append((t != times, ({n: c for n, c in rest.items() if c}, waste + lost * t, (path, tuple(sorted(each.items(), reverse=True)), t), used + t)))
            # Those that use a filling as often as it fits come first.
            stack += [entry for _, entry in sorted(branches, key=lambda b: b[0])[::-1]]
    return Plan(best, size, bound)


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 4000, width: int = 3, steps: int = 3000) -> list[Filling]:
    """The fillings of ``plan``."""
    return plan(counts, capacity, nodes, width, steps).fillings


def _listed(path: tuple) -> list[Filling]:
    out = []
    while path:
        path, pieces, times = path
        out.append(Filling(pieces, times))
    return out[::-1]


def _runs(fillings: list[Filling], most: int) -> dict[str, np.ndarray]:
    """For each length and filling: the ranks that go there and where. Sorted by length and first rank."""
    taken: dict[int, int] = {}
    rows = []
    first = 0
    for f in fillings:
        offset = 0
        for n, k in f.pieces:
            rows.append((n, taken.get(n, 0), first, f.sequences, offset))
            taken[n] = taken.get(n, 0) + k * f.sequences
            offset += n * k
        first += f.sequences
    if len(rows) > most:
        raise ValueError(f"{len(rows)} runs; at most {most} are sent to the executors")
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "sequences", "offset"), table.T.copy()))


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Every document's pieces with their rank among the pieces of their length in the same task."""
    schema = _arrow_schema(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        encode = encoder(path).encode
        for batch in (part for whole in batches for part in parts(whole, 2048)):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or min(len(ids), capacity)
                start = 0
                for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    n = stop - start
                    rows.append((doc_id, piece, start, n, zlib.crc32(ids[start:stop].tobytes()), part, int(seen[n])))
                    seen[n] += 1
                    start = stop
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return id_and_text(docs).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, nodes: int = 4000, most_runs: int = 2_000_000) -> DataFrame:
    """Pack all documents into as few sequences of ``capacity`` tokens as the search finds.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null text is packed
    as the end id alone; null or repeated doc_ids are packed row by row; an empty table gives no rows; further
    columns are ignored. Pieces of equal length are interchangeable, and take their places in the order of their tasks. A document over ``capacity`` is cut into full pieces, of which the first may be shorter.
    """
    # Ranks hold only for the task that gave them, so the pieces are written before they are counted and placed.
    pieces = cut(cut_pieces(docs, tokenizer, capacity, end_id), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {int(r["length"]): int(r["n"]) for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = _runs(bin_completion(counts, capacity, nodes), most_runs)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # Documents of one length may be a third of all; keyed by part too, no key has more rows than one task had.
    ranked = pieces.join(bases, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    schema = _arrow_schema(PLACED)
    keys = runs["length"] * (1 << 48) + runs["rank"] if len(runs) else np.zeros(0, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, n * (1 << 48) + rank, side="right") - 1
            nth = rank - runs["rank"][at]
            sequence = runs["sequence"][at] + nth % runs["sequences"][at]
            offset = runs["offset"][at] + nth // runs["sequences"][at] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).cast(f.type) for f in schema if f.name not in ("sequence_id", "offset")), pa.array(sequence), pa.array(offset)], schema=schema)

    return ranked.mapInArrow(place, PLACED)
