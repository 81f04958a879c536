"""Stretches of words that repeat with a period.

A harmonic grid: for each period p, the words 0, p, 2p and so on are grid points, about n ln n in all for n words. A run of
three periods or more holds two grid points of its period with all that lies between them. All pairs of period and grid
point are laid out as NumPy arrays, block by block; prefix hashes tell at once at which points the next nine words repeat
one period on, and a binary search over the same hashes finds for all of these how far the words repeat to either side.
The words of each stretch found are compared themselves before it counts.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.arrow import id_and_text, map_batches

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Shortest run, in words, and least number of periods in one.
LEAST, TIMES = 24, 3
#: In a run the words repeat one period on for max(LEAST - p, 2 p) words; the first grid point there has at most p - 1 of
#: these before it, so nine or more follow it, whatever the period is.
_PROBE = 9
#: Pairs of period and grid point in memory at a time.
_POINTS = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]


def numbered(words: list[str]) -> np.ndarray:
    """Each word's number; the same words have the same."""
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


class _Hashes:
    """Prefix sums of hashed words times powers of an odd number, modulo 2^64."""

    def __init__(self, ids: np.ndarray):
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        self.powers = np.ones(len(ids) + 1, np.uint64)
        self.powers[1:] = _BASE
        np.multiply.accumulate(self.powers, out=self.powers)
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum((x ^ (x >> np.uint64(32))) * self.powers[:-1], out=self.sums[1:])

    def same(self, at: np.ndarray, size: np.ndarray | int, period: np.ndarray) -> np.ndarray:
        """Whether ``size`` words from ``at`` are those one period on, but for collisions."""
        s = self.sums
        return (s[at + size] - s[at]) * self.powers[period] == s[at + period + size] - s[at + period]


class _PrimeHashes:
    """The same modulo two primes, for words arranged so that sums modulo 2^64 meet."""

    _PRIMES = (2_147_483_647, 2_147_483_629)

    def __init__(self, ids: np.ndarray):
        self.tables = []
        for m in self._PRIMES:
            powers = np.ones(1, np.int64)
            step = 1_000_003
            while len(powers) <= len(ids):
                powers = np.concatenate((powers, powers * step % m))
                step = step * step % m
            sums = np.concatenate(([0], np.cumsum((ids * 7_919 + 104_729) % m * powers[: len(ids)] % m) % m))
            self.tables.append((m, powers, sums))

    def same(self, at: np.ndarray, size: np.ndarray | int, period: np.ndarray) -> np.ndarray:
        out = np.ones(len(at), bool)
        for m, powers, s in self.tables:
            out &= (s[at + size] - s[at]) % m * powers[period] % m == (s[at + period + size] - s[at + period]) % m
        return out


def _extended(h: _Hashes | _PrimeHashes, n: int, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words before each grid point, and from it on, repeat one period on: one binary search for all points."""
    low, high = np.full(len(at), _PROBE), n - period - at
    while (low < high).any():
        middle = (low + high + 1) // 2
        yes = h.same(at, middle, period)
        low, high = np.where(yes, middle, low), np.where(yes, high, middle - 1)
    back, top = np.zeros(len(at), np.int64), at.copy()
    while (back < top).any():
        middle = (back + top + 1) // 2
        yes = h.same(at - middle, middle, period)
        back, top = np.where(yes, middle, back), np.where(yes, top, middle - 1)
    return back, low


def _stretches(ids: np.ndarray, period: int) -> list[tuple[int, int]]:
    """Starts and ends of all maximal stretches that keep a period, from the words themselves."""
    same = np.concatenate(([False], ids[:-period] == ids[period:], [False]))
    turns = np.flatnonzero(same[1:] != same[:-1])
    return [(int(a), int(b) + period) for a, b in zip(turns[::2], turns[1::2])]


def runs(ids: np.ndarray) -> list[Run]:
    """Start, length and smallest period of every maximal run, by start, then period.

    A run has at least LEAST words and TIMES periods, and neither neighbour keeps its period. The longer runs of a multiple
    of the smallest period are the same stretch of words, as a run holds more than both periods together, so the first
    period of each stretch is kept.
    """
    if len(ids) < LEAST:
        return []
    for hashes in (_Hashes, _PrimeHashes):
        found = _by_hashes(ids, hashes(ids))
        if all(_confirmed(ids, s, e, p) for (s, e), p in found.items()):
            break
    else:  # hashes met by chance twice: the words themselves decide for every period
        found = {}
        for p in range(1, len(ids) // TIMES + 1):
            for s, e in _stretches(ids, p):
                if e - s >= max(LEAST, TIMES * p):
                    found.setdefault((s, e), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def _by_hashes(ids: np.ndarray, h: _Hashes | _PrimeHashes) -> dict[tuple[int, int], int]:
    """Starts and ends of the runs by hashes alone, with their smallest periods."""
    n = len(ids)
    periods = np.arange(1, n // TIMES + 1)
    counts = np.maximum(n - periods - _PROBE, -1) // periods + 1
    ends = np.cumsum(counts)
    found: dict[tuple[int, int], int] = {}
    first = 0
    while first < len(periods):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + _POINTS, "right")))
        for p, at in _points(periods[first:last], counts[first:last]):
            hit = h.same(at, _PROBE, p)
            if hit.any():
                p, at = p[hit], at[hit]
                # A grid point that the one before it reaches stands in the same stretch.
                fresh = (at < p) | ~h.same(np.maximum(at - p, 0), p, p)
                _collect(n, h, p[fresh], at[fresh], found)
        first = last
    return found


def _points(periods: np.ndarray, counts: np.ndarray):
    """Arrays of periods and grid points; one period's points come in several where they are many."""
    if len(periods) == 1 and counts[0] > _POINTS:
        for k in range(0, int(counts[0]), _POINTS):
            at = np.arange(k, min(k + _POINTS, int(counts[0]))) * periods[0]
            yield np.full(len(at), periods[0]), at
        return
    p = np.repeat(periods, counts)
    yield p, (np.arange(len(p)) - np.repeat(np.cumsum(counts) - counts, counts)) * p


def _collect(n: int, h: _Hashes | _PrimeHashes, period: np.ndarray, at: np.ndarray, found: dict[tuple[int, int], int]) -> None:
    back, on = _extended(h, n, at, period)
    start, end = at - back, at + on + period
    long = end - start >= np.maximum(LEAST, TIMES * period)
    if not long.any():
        return
    for s, e, p in zip(start[long].tolist(), end[long].tolist(), period[long].tolist()):
        if p < found.get((s, e), p + 1):
            found[s, e] = p


def _confirmed(ids: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether the words of a stretch repeat with the period, and neither neighbour does."""
    return (
        bool((ids[start : end - period] == ids[start + period : end]).all())
        and (start == 0 or ids[start - 1] != ids[start - 1 + period])
        and (end == len(ids) or ids[end] != ids[end - period])
    )


def strongest(found: list[Run]) -> Run | None:
    """The run with the most periods, compared exactly; then the first, then the one with the shortest period."""
    best = None
    for run in found:  # by start, then period: a later one must be stronger
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, found: list[Run]) -> np.ndarray:
    """Flags of the words that no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def with_planted_period(doc_id: int | None, words: list[str]) -> list[str]:
    """The words of one document in ten, by its id's checksum, made periodic from some word on; others and null ids as they are."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * ((n - a) // p + 1))[: n - a]


def collapsed(text: str | None) -> str | None:
    """The text's words without what its runs repeat, joined by blanks; null stays null."""
    if text is None:
        return None
    words = _WORD.findall(text)
    return " ".join(w for w, keep in zip(words, kept_words(len(words), runs(numbered(words)))) if keep)


def find_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Periodic runs of the words of every whole text.

    Returns doc_id, n_words, n_runs; start, length, period and exponent_milli of the strongest run, null without any;
    runs_sha256 of all runs and collapsed_sha256 of the words that stay; n_kept. ``plant`` first makes one document in ten
    periodic, by its id. Null and empty texts have no words and no runs; repeated rows are judged each; null ids stay null
    and are never planted; further columns are ignored; an empty table gives no rows. No shuffle; memory grows with the
    longest text only.
    """

    def make(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": batch.column("doc_id"), **{c: [] for c in ("n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_kept")}}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            words = _WORD.findall(text or "")
            if plant:
                words = with_planted_period(doc_id, words)
            found = runs(numbered(words))
            keep = [w for w, k in zip(words, kept_words(len(words), found)) if k] if found else words
            best = strongest(found)
            out["n_words"].append(len(words))
            out["n_runs"].append(len(found))
            for name, value in zip(("start", "length", "period"), best or (None, None, None)):
                out[name].append(value)
            out["exponent_milli"].append(best and 1000 * best[1] // best[2])
            out["runs_sha256"].append(hashlib.sha256("".join(f"{s},{size},{p}\n" for s, size, p in found).encode()).hexdigest())
            out["collapsed_sha256"].append(hashlib.sha256(" ".join(keep).encode("utf-8", "surrogatepass")).hexdigest())
            out["n_kept"].append(len(keep))
        return out

    longs = "n_words long, n_runs long, start long, length long, period long, exponent_milli long"
    return map_batches(id_and_text(docs), make, f"doc_id long, {longs}, runs_sha256 string, collapsed_sha256 string, n_kept long")
