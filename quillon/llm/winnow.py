"""Benchmark decontamination by winnowing.

Of every ``window`` consecutive words the smallest k-gram hash is kept, with k = 5 by default; two texts that share
``window`` words therefore share a kept hash. Kept hashes are matched first; around each match the whole window's
hash is then compared and the words themselves after it, and matching windows are extended over all words they cover.
Items shorter than a window are one window of their own length, whose fingerprint is that of all its words.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.arrow import id_and_text, map_batches, text_column

_CHUNK = 500_000
#: Bytes of words that are compared at a time.
_COMPARED = 1 << 22
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_FACTORS, _PLACES, _WHOLE, _AGAIN = _random(1 << 16, 1), _random(64, 2), _random(4096, 3), _random(4096, 4)
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _bytes(texts: list[str | None]) -> tuple[np.ndarray, list[bytes]]:
    """All texts' bytes in lower case, a blank after each; and each text's own."""
    # In UTF-8, every byte of a character from U+0080 on is 0x80 or more: words can be told byte by byte.
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b" ".join(raw).lower() + b" ", np.uint8), raw


def spelled(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as bytes, a blank after each, and where each word begins (one more number than words)."""
    data, _ = _bytes(texts)
    inside = _WORD[data]
    # Each word ends before a byte outside of words, as a blank stands after every text.
    kept = inside | np.concatenate(([False], inside[:-1]))
    data = np.where(inside, data, np.uint8(0x20))[kept]
    return data, np.concatenate(([0], np.flatnonzero(data == 0x20) + 1))


def _spelled_alike(a: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> np.ndarray:
    """Which stretches of bytes of ``a`` equal those of ``b``; a bounded number of bytes is compared at a time."""
    same = a_to - a_from == b_to - b_from
    left = np.flatnonzero(same)
    sizes = (a_to - a_from)[left]
    parts = np.searchsorted(np.cumsum(sizes), np.arange(_COMPARED, int(sizes.sum()) + _COMPARED, _COMPARED), side="left") + 1
    for part, n in zip(np.split(left, parts), np.split(sizes, parts)):
        if len(part):
            first = np.cumsum(n) - n
            inner = np.arange(n.sum()) - np.repeat(first, n)
            same[part] = np.logical_and.reduceat(a[np.repeat(a_from[part], n) + inner] == b[np.repeat(b_from[part], n) + inner], first)
    return same


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (one more number than texts)."""
    data, raw = _bytes(texts)
    inside = _WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    begins = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)))
    bounds = np.searchsorted(starts, begins)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    lengths = stops - starts
    kept = data[inside]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(kept)) - np.repeat(first, lengths)
    sums = np.add.reduceat((kept.astype(np.uint64) + np.uint64(1)) * _FACTORS[place & 0xFFFF], first)
    return _mix(sums + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), bounds


def _sums(words: np.ndarray, factors: np.ndarray, k: int) -> np.ndarray:
    out = words[: len(words) - k + 1] * factors[0]
    for j in range(1, k):
        out += words[j : len(words) - k + 1 + j] * factors[j]
    return _mix(out)


def winnowed(words: np.ndarray, k: int, window: int) -> np.ndarray:
    """For each run of ``window`` words, the smallest hash of its k-grams."""
    grams = _sums(words, _PLACES, k)
    n = len(words) - window + 1
    low = grams[:n].copy()
    for j in range(1, window - k + 1):
        np.minimum(low, grams[j : j + n], out=low)
    return low


def _within(bounds: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which runs of ``length`` words that start at 0..n-length lie in one text."""
    stop = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(n - length + 1) + length <= stop[: n - length + 1]


def _is_in(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_, values)
    at[at == len(sorted_)] = 0
    return sorted_[at] == values if len(sorted_) else np.zeros(len(values), bool)


class Fingerprints:
    """The benchmark's kept hashes and windows, as sorted arrays, about 28 bytes for each window, and its words."""

    def __init__(self, items: list[tuple[object, str | None]], k: int = 5, window: int = 13):
        self.k, self.window = k, window
        texts = sorted((str(i), t) for i, t in items if i is not None and t)
        #: Items' names, sorted as strings, so their numbers sort alike.
        self.names = sorted({i for i, _ in texts})
        number = {i: n for n, i in enumerate(self.names)}
        #: All items' words, in bytes, and where each begins.
        self.words, self.word_at = spelled([t for _, t in texts])
        kept: list[np.ndarray] = []
        found: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
        before = 0
        for item, text in texts:
            words, _ = word_hashes([text])
            if len(words):
                n = min(window, len(words))
                if n == window:
                    kept.append(np.unique(winnowed(words, k, window)))
                hashes = _sums(words, _WHOLE, n)
                found[n].append((hashes, _sums(words, _AGAIN, n), np.full(len(hashes), number[item], np.int32), before + np.arange(len(hashes))))
                before += len(words)
        self.kept = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.uint64)
        #: By window length: the different windows' hashes, where each one's items begin (one more number), and the items'
        #: numbers. Windows are told apart by a second hash, so different ones with the same first hash stand in turn.
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        #: By window length: the number of the first word of each different window.
        self.starts: dict[int, np.ndarray] = {}
        for n, rows in found.items():
            columns = [np.concatenate(c) for c in zip(*rows)]
            order = np.lexsort((columns[2], columns[1], columns[0]))
            hashes, again, members, starts = (c[order] for c in columns)
            new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (again[1:] != again[:-1])))
            fresh = new | np.concatenate(([True], members[1:] != members[:-1]))
            hashes, members, starts, new = hashes[fresh], members[fresh], starts[fresh], new[fresh]
            first = np.flatnonzero(new)
            self.lengths[n] = (hashes[first], np.append(first, len(hashes)), members)
            self.starts[n] = starts[first]

    def _slots(self, n: int, at: np.ndarray, whole: np.ndarray, words: np.ndarray, word_at: np.ndarray) -> np.ndarray:
        """Of each run of n words of ``words`` that starts at ``at`` and has a window's hash: the number of the window that has
        its very words, or -1."""
        order, starts = self.lengths[n][0], self.starts[n]
        slot, found, left = np.searchsorted(order, whole), np.full(len(at), -1), np.arange(len(at))
        while len(left):
            own = starts[slot[left]]
            same = _spelled_alike(words, word_at[at[left]], word_at[at[left] + n], self.words, self.word_at[own], self.word_at[own + n])
            found[left[same]] = slot[left[same]]
            # Other windows with the same hash come next.
            left = left[~same]
            slot[left] += 1
            left = left[slot[left] < len(order)]
            left = left[order[slot[left]] == whole[left]]
        return found

    def judge(self, texts: list[str | None]) -> list[tuple[int, int, list[str]]]:
        """Of each text: words, words hit, items found (sorted as strings)."""
        out: list[tuple[int, int, list[str]]] = []
        part: list = []
        size = 0
        for t in texts:
            part.append(t)
            size += len(t or "") + 1
            if size >= _CHUNK:
                out += self._judge(part)
                part, size = [], 0
        return out + (self._judge(part) if part else [])

    def _judge(self, texts: list[str | None]) -> list[tuple[int, int, list[str]]]:
        words, bounds = word_hashes(texts)
        hit = np.zeros(len(words) + 1, np.int64)
        items: dict[int, set] = defaultdict(set)
        own: tuple[np.ndarray, np.ndarray] | None = None
        for n, (order, begins, members) in self.lengths.items():
            if len(words) < n:
                continue
            if n == self.window:
                low = winnowed(words, self.k, n)
                # A hash is mostly kept for several windows in turn: look each such stretch up once.
                turn = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
                found = np.repeat(_is_in(self.kept, low[turn]), np.diff(np.append(turn, len(low))))
                at = np.flatnonzero(found & _within(bounds, len(words), n))
                whole = np.zeros(len(at), np.uint64)
                for j in range(n):
                    whole += words[at + j] * _WHOLE[j]
                whole = _mix(whole)
            else:
                at = np.flatnonzero(_within(bounds, len(words), n))
                whole = _sums(words, _WHOLE, n)[at]
            real = _is_in(order, whole)
            at, whole = at[real], whole[real]
            if len(at):
                own = own or spelled(texts)
                slots = self._slots(n, at, whole, *own)
                at, slots = at[slots >= 0], slots[slots >= 0]
                np.add.at(hit, at, 1)
                np.add.at(hit, at + n, -1)
                texts_of = np.searchsorted(bounds, at, side="right") - 1
                for d, slot in set(zip(texts_of.tolist(), slots.tolist())):
                    items[d].update(members[begins[slot] : begins[slot + 1]].tolist())
        covered = np.concatenate(([0], np.cumsum(np.cumsum(hit[:-1]) > 0)))
        n_hit = covered[bounds[1:]] - covered[bounds[:-1]]
        return [(int(b - a), int(h), [self.names[i] for i in sorted(items.get(d, ()))]) for d, (a, b, h) in enumerate(zip(bounds[:-1], bounds[1:], n_hit))]


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = 5, window: int = 13, share: int = 20, most_bytes: int = 64 << 20, most_windows: int = 1_000_000) -> DataFrame:
    """Words of each document inside any benchmark window, and the items that have such windows.

    Null texts have no words; items without words or id can't be found; repeated items count once; a document row
    is judged alone, whatever rows repeat it. Contaminated: n_hit > 0 and share * n_hit >= n_words. The benchmark's
    size is read first: up to ``most_windows`` words, and so windows, in ``most_bytes`` of text its fingerprints go to
    every executor, where each window with a benchmark window's hash is held against its words; beyond, both sides' fingerprints are
    shuffled and joined by 128 bits, with the same result.
    """
    items = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text"))
    held = _collected(items, k, window, most_bytes, most_windows)
    if held is None:
        return _joined(docs, items, k, window, share)

    def make(batch: pa.RecordBatch) -> dict:
        judged = held.judge(batch.column("text").to_pylist())
        return {
            "doc_id": batch.column("doc_id"),
            "n_words": [n for n, _, _ in judged],
            "n_hit": [h for _, h, _ in judged],
            "n_items": [len(i) for _, _, i in judged],
            "items_sha256": [hashlib.sha256(",".join(i).encode()).hexdigest() for _, _, i in judged],
            "contaminated": [h > 0 and share * h >= n for n, h, _ in judged],
        }

    return map_batches(id_and_text(docs), make, RESULT)


def _stretches(texts: list[str | None], k: int, window: int, lengths: list[int]) -> list[tuple[int, int, int, int, np.ndarray, np.ndarray]]:
    """Of all texts: (text, run length, kept hash, first place, both window hashes of the places that share that kept hash)."""
    words, bounds = word_hashes(texts)
    out = []
    for n in lengths:
        if len(words) < n:
            continue
        whole, again = _sums(words, _WHOLE, n), _sums(words, _AGAIN, n)
        low = winnowed(words, k, n) if n == window else whole
        text = np.searchsorted(bounds, np.arange(len(low)), side="right") - 1
        ok = _within(bounds, len(words), n)
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        new = np.concatenate(([True], (low[at[1:]] != low[at[:-1]]) | (np.diff(at) > 1) | (text[at[1:]] != text[at[:-1]])))
        edges = np.append(np.flatnonzero(new), len(at)).tolist()
        for i, j in zip(edges[:-1], edges[1:]):
            d, run = int(text[at[i]]), slice(at[i], at[j - 1] + 1)
            out.append((d, n, int(low[at[i]].view(np.int64)), int(at[i] - bounds[d]), whole[run].view(np.int64), again[run].view(np.int64)))
    return out


def _joined(docs: DataFrame, items: DataFrame, k: int, window: int, share: int) -> DataFrame:
    """contamination() for a benchmark of any size: fingerprints of both sides meet in a shuffle, and windows are compared
    by two hashes of 64 bits, as their words would be many times as much to send."""

    def item_windows(batch: pa.RecordBatch) -> dict:
        rows = []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
            words, _ = word_hashes([text])
            if len(words) and item is not None:
                n = min(window, len(words))
                kept = winnowed(words, k, n) if n == window else _sums(words, _WHOLE, n)
                hashes = (kept, _sums(words, _WHOLE, n), _sums(words, _AGAIN, n))
                rows += [(str(item), n, *h) for h in zip(*(x.view(np.int64).tolist() for x in hashes))]
        names = ("item", "n", "fp", "w", "v")
        return dict(zip(names, zip(*rows))) if rows else {c: [] for c in names}

    windows = map_batches(items.select("item_id", "text"), item_windows, "item string, n int, fp long, w long, v long").distinct()
    lengths = [r[0] for r in windows.select("n").distinct().collect()]

    def doc_stretches(batch: pa.RecordBatch) -> dict:
        names = ("doc_id", "text_hash", "n", "fp", "place", "ws", "vs")
        ids, hashes = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
        rows = [(ids[d], hashes[d], *rest) for d, *rest in _stretches(batch.column("text").to_pylist(), k, window, lengths)]
        return dict(zip(names, zip(*rows))) if rows else {c: [] for c in names}

    def count_words(batch: pa.RecordBatch) -> dict:
        _, bounds = word_hashes(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "n_words": np.diff(bounds)}

    keyed = id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    stretches = map_batches(keyed, doc_stretches, "doc_id long, text_hash long, n int, fp long, place long, ws array<long>, vs array<long>")
    near = stretches.join(windows.select("n", "fp").distinct(), ["n", "fp"], "left_semi")
    places = near.select("doc_id", "text_hash", "n", "place", F.posexplode(F.arrays_zip("ws", "vs")).alias("i", "h"))
    places = places.select("doc_id", "text_hash", "n", "place", "i", F.col("h.ws").alias("w"), F.col("h.vs").alias("v")).distinct()
    hits = places.join(windows.select("n", "w", "v", "item").distinct(), ["n", "w", "v"])
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct((F.col("place") + F.col("i")).alias("at"), "n")), lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))
    found = hits.groupBy("doc_id", "text_hash").agg(F.size(covered).cast("long").alias("hit"), F.array_sort(F.collect_set("item")).alias("items"))
    counted = map_batches(keyed, count_words, "doc_id long, text_hash long, n_words long").alias("c")
    joined = counted.join(found.alias("f"), F.expr("c.doc_id <=> f.doc_id and c.text_hash = f.text_hash"), "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    return joined.select(
        "c.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", F.array().cast("array<string>"))), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def _collected(items: DataFrame, k: int, window: int, most_bytes: int, most_windows: int) -> Fingerprints | None:
    """The benchmark's fingerprints, if its texts have no more than so many bytes and words."""
    words = F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    n, size = items.agg(F.coalesce(F.sum(words), F.lit(0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return Fingerprints([(r[0], r[1]) for r in items.select("item_id", "text").collect()], k, window) if size <= most_bytes and n <= most_windows else None


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, window: int = 13, share: int = 20, most_bytes: int = 64 << 20, most_windows: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` whose text the benchmark doesn't contaminate, with all their columns.

    Every row is judged by its text alone, so null ids and repeated rows need no care; null texts stay.
    """
    held = _collected(benchmark.select("item_id", F.col("text").cast("string").alias("text")), k, window, most_bytes, most_windows)
    text = docs["text"].cast("string")
    if held is not None:

        def clean(texts: list[str | None]) -> list[bool]:
            return [not (h > 0 and share * h >= n) for n, h, _ in held.judge(texts)]

        return docs.filter(text_column(text, clean, "boolean"))
    # Texts stand for their rows here, so that rows without an id are judged too.
    judged = contamination(docs.select(F.xxhash64(text).alias("doc_id"), text.alias("text")), benchmark, k, window, share, most_bytes, most_windows)
    bad = judged.filter("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.xxhash64(text) == bad["_bad"], "left_anti")
