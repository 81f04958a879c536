"""Substring dedup by sliding runs of sentences.

A text is cut into sentences; a long sentence is also cut after words that a hash of the word alone picks out, so a
passage is cut alike wherever it stands. From each sentence the shortest run of at least ``sentences`` sentences with
at least ``words`` words is hashed, to 96 bits and in lower case. Runs are joined globally; every run that isn't the first
of its hash, by doc_id, text and place, covers its sentences, and these are removed.

``repeated_runs`` covers every run that repeats, not the shortest from each sentence only. A text is cut into pieces:
at the ends of its sentences and, in each ``_WINDOW`` words without one, after the word with the smallest hash, so two
copies of a passage have the same cuts but for the first and last of these windows, where a passage that starts or ends
within a sentence may keep some words. Two kinds of runs are hashed: each
two neighbouring sentences, whatever their length, which cover every run of whole sentences; and for the rest from each
cut the shortest run of at least ``words`` words, and the shortest that ends there, which together cover every longer
run of pieces.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.arrow import cuts, id_and_text, kept, map_batches
from quillon.storage import cut

_WORD = re.compile(r"\S+")
_ENDS = (".", "!", "?", "…")
_CUT = 16
_WINDOW = 15
_STOPS = frozenset(".!?…。！？．｡")
_CLOSERS = "\"'”’»›)]}」』）】》〉*_"
# Scripts without blank space between words: each character is a word, with the stops and closing marks behind it.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_UNIT = re.compile(rf"{_UNSPACED.pattern}[。！？．｡.!?…]*[{re.escape(_CLOSERS)}]*|(?:(?!{_UNSPACED.pattern})\S)+")
# Two bases, for the two halves of a run's hash, each followed by its inverse.
_BASES = tuple(x for b in (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F | 5) for x in (b, pow(b, -1, 1 << 64)))
# ``inside``: 30 bits of the text's hash, which tell texts with one doc_id apart, and 31 of the first piece's number.
_RUN = "h long, g int, doc_id long, inside long, n int"
_TAG = (1 << 30) - 1


def sentences_of(text: str) -> tuple[list[int], list[int], list[int]]:
    """Starts, ends and numbers of words of a text's sentences; line ends close a sentence too."""
    starts, ends, sizes = [], [], []
    open_ = last = n = 0
    for m in _WORD.finditer(text):
        a, b = m.span()
        if n and "\n" in text[last:a]:
            starts.append(open_), ends.append(last), sizes.append(n)
            n = 0
        if not n:
            open_ = a
        n, last = n + 1, b
        if text[b - 1] in _ENDS or zlib.crc32(m[0].encode("utf-8", "surrogatepass")) % _CUT == 0:
            starts.append(open_), ends.append(b), sizes.append(n)
            n = 0
    if n:
        starts.append(open_), ends.append(last), sizes.append(n)
    return starts, ends, sizes


def runs_of(text: str, sentences: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in two halves, first sentences and lengths in sentences of a text's runs."""
    from xxhash import xxh128_digest

    starts, ends, sizes = sentences_of(text)
    if len(starts) < sentences:
        return (np.zeros(0, np.int64),) * 4
    total = np.concatenate(([0], np.cumsum(sizes)))
    stop = np.searchsorted(total, total[:-1] + words)
    stop = np.maximum(stop, np.arange(len(sizes)) + sentences)
    firsts = np.flatnonzero(stop <= len(sizes))
    stops = stop[firsts]
    # Blank space between words doesn't count: a run is the bytes of its words, joined.
    joined = " ".join(text.split()).lower()
    raw = joined.encode("utf-8", "surrogatepass")
    lengths = np.fromiter((len(w) for w in raw.split(b" ")), np.int64)
    places = np.concatenate(([0], np.cumsum(lengths + 1)))
    begin, end = places[total[firsts]].tolist(), (places[total[stops]] - 1).tolist()
    halves = np.frombuffer(b"".join(xxh128_digest(raw[a:b]) for a, b in zip(begin, end)), "<i8").reshape(-1, 2)
    return halves[:, 0], halves[:, 1], firsts, stops - firsts


def _run_rows(docs: DataFrame, runs) -> DataFrame:
    """The runs of every text with an id; ``runs`` gives a text's hashes, places and lengths."""

    def make(batch: pa.RecordBatch) -> dict:
        found = [runs(t) for t in batch.column("text").to_pylist()]
        sizes = [len(f[0]) for f in found]
        h, g, at, n = (np.concatenate(x) for x in zip(*found))
        doc_id, tag = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("doc_id", "text_hash"))
        return {"h": h, "g": g.astype(np.int32), "doc_id": doc_id, "inside": (tag & _TAG) << 31 | at, "n": n}

    texts = id_and_text(docs).filter("doc_id is not null and text is not null").withColumn("text_hash", F.xxhash64("text"))
    return map_batches(texts, make, _RUN)


class _Words(dict):
    """Hash of a word; the lowest bit is set when it closes a sentence."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 200_000:
            self.clear()
        h = xxh64_intdigest(word.encode("utf-8", "surrogatepass")) & ~1
        self[word] = h | (word[-1] in _STOPS or word.rstrip(_CLOSERS)[-1:] in _STOPS)
        return self[word]


class _State:
    """What a process keeps: words' hashes, and powers of the bases as far as the longest text so far needs them."""

    def __init__(self):
        self.words = _Words()
        self.powers = [np.ones(1, np.uint64)] * len(_BASES)

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.powers[0]) < n:
            self.powers = [np.concatenate((np.ones(1, np.uint64), np.full(n + n // 4, b, np.uint64))).cumprod(dtype=np.uint64) for b in _BASES]
        return self.powers


def _state() -> _State:
    return kept("spans", _State)


def _words_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words in lower case, and whether a sentence ends behind each: at a stop or a line's end."""
    low, hashes, lines, words = text.lower(), [], [], _state().words
    split = _UNIT.findall if _UNSPACED.search(low) else str.split
    for line in low.split("\n"):
        hashes += map(words.__getitem__, split(line))
        lines.append(len(hashes))
    h = np.array(hashes, np.uint64)
    closes = (h & np.uint64(1)).astype(bool)
    closes[np.array(lines)[np.array(lines) > 0] - 1] = True
    return h, closes


def _cuts_of(h: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """Numbers of words before each piece's end, with 0 first. Among a window's words the last of the smallest wins, and
    a word that closes a sentence is smallest."""
    n = len(h)
    chosen = closes.copy()
    chosen[-1:] = True
    if n >= _WINDOW:
        key = (np.where(closes, 0, (h >> np.uint64(34)) + np.uint64(1)).astype(np.int64) << 32) + np.arange(n, 0, -1)
        least = key
        for step in (1, 2, 4):
            least = np.minimum(least[:-step], least[step:])
        least = np.minimum(least[: n - _WINDOW + 1], least[_WINDOW - 8 :])
        chosen[n - (least & 0xFFFFFFFF)] = True
    return np.concatenate(([0], np.flatnonzero(chosen) + 1))


def pieces_of(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of a text's pieces."""
    cuts = _cuts_of(*_words_of(text))
    places = [m.span() for m in (_UNIT if _UNSPACED.search(text.lower()) else _WORD).finditer(text)]
    return [places[i][0] for i in cuts[:-1]], [places[i - 1][1] for i in cuts[1:]]


def all_runs_of(text: str, sentences: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in two halves, first pieces and lengths in pieces of the runs that stand for every run of a text."""
    h, closes = _words_of(text)
    n = len(h)
    cuts = _cuts_of(h, closes)
    last = len(cuts) - 1
    whole = np.concatenate(([True], closes, [True]))[: n + 1]
    whole[n] = True
    bounds = np.flatnonzero(whole[cuts])
    # Every `sentences` neighbouring sentences.
    a, b = [bounds[:-sentences]], [bounds[sentences:]]
    # From each cut, and up to each cut, until there are enough words and pieces.
    at = np.arange(last + 1)
    stop = np.maximum(np.searchsorted(cuts, cuts + words), at + sentences)
    a.append(at[stop <= last]), b.append(stop[stop <= last])
    start = np.minimum(np.searchsorted(cuts, cuts - words, "right") - 1, at - sentences)
    a.append(start[start >= 0]), b.append(at[start >= 0])
    a, b = np.concatenate(a), np.concatenate(b)
    # Runs of whole sentences, enough of them, are covered by the first kind.
    between = np.searchsorted(bounds, b) - np.searchsorted(bounds, a)
    needless = whole[cuts[a]] & whole[cuts[b]] & (between >= sentences)
    needless[: max(0, len(bounds) - sentences)] = False
    pairs = np.unique(a[~needless] * (last + 1) + b[~needless])
    a, b = pairs // (last + 1), pairs % (last + 1)
    powers, halves = _state().upto(n + 1), []
    for k, word in enumerate((h | np.uint64(1), (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1))):
        up, down = powers[2 * k], powers[2 * k + 1]
        total = np.concatenate((np.zeros(1, np.uint64), (word * up[:n]).cumsum(dtype=np.uint64)))
        x = (total[cuts[b]] - total[cuts[a]]) * down[cuts[a]] + (cuts[b] - cuts[a]).astype(np.uint64)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        halves.append((x ^ (x >> np.uint64(31))).view(np.int64))
    return *halves, a, b - a


def repeated_sentences(docs: DataFrame, sentences: int = 2, words: int = 20) -> DataFrame:
    """Texts that lose sentences: doc_id, tag, removed (places of sentences, ascending) and first_doc_ids.

    first_doc_ids are the documents that keep the text; tag, 30 bits of xxhash64(text), tells texts with one doc_id
    apart. Upper and lower case and the amount of blank space make no difference. Rows with null doc_id or text take no
    part. Rows that share a doc_id and a text count as one row. An empty table gives no rows.
    """
    return _removed(cut(_run_rows(docs, lambda t: runs_of(t, sentences, words)), "runs"))


def repeated_runs(docs: DataFrame, sentences: int = 2, words: int = 20) -> DataFrame:
    """As repeated_sentences(), for every run of sentences or pieces: doc_id, tag, removed (places of pieces),
    first_doc_ids."""
    return _removed(cut(_run_rows(docs, lambda t: all_runs_of(t, sentences, words)), "runs"))


def _removed(runs: DataFrame) -> DataFrame:
    # One number orders places by doc_id, then by text and place: a minimum of numbers is found by hash, where one of
    # structs would sort all runs.
    unit = F.lit(1 << 61).cast("decimal(19,0)")
    placed = runs.withColumn("place", F.col("doc_id").cast("decimal(19,0)") * unit + F.col("inside").cast("decimal(19,0)"))
    # A run that very many documents share is counted within each task first, and is one row from there on.
    firsts = placed.groupBy("h", "g").agg(F.count("*").alias("copies"), F.min("place").alias("first"))
    repeated = cut(firsts.filter("copies > 1").select("h", "g", "first"), "repeated")
    # One side has one row for a hash and the other any number, each straight from a table: adaptive execution can split it.
    joined = runs.join(repeated, ["h", "g"]).withColumn("place", F.col("doc_id").cast("decimal(19,0)") * unit + F.col("inside").cast("decimal(19,0)"))
    own = F.expr("first - pmod(first, cast(2305843009213693952 as decimal(38,0)))")
    later = joined.filter("place <> first").select("doc_id", F.expr("shiftright(inside, 31)").alias("tag"), F.expr("cast(inside & 2147483647 as int)").alias("at"), "n", (own / unit).cast("long").alias("first_id"))
    marked = later.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("at", "n")).alias("spans"), F.array_sort(F.collect_set("first_id")).alias("first_doc_ids"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))))
    return marked.select("doc_id", "tag", covered.alias("removed"), "first_doc_ids")


def without(text: str, removed: list[int], ends: list[int] | None = None) -> str:
    """The text without these sentences, or pieces that end there, and without the blank space before each."""
    ends = sentences_of(text)[1] if ends is None else ends
    out, at = [], 0
    for i in removed:
        out.append(text[at : ends[i - 1] if i else 0] if at <= (ends[i - 1] if i else 0) else "")
        at = ends[i]
    return "".join(out) + text[at:]


def remove_repeats(docs: DataFrame, sentences: int = 2, words: int = 20) -> DataFrame:
    """``docs`` with every repeated run removed from text; every row and every other column stays."""
    found = repeated_runs(docs, sentences, words).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.col("removed").alias("_gone"))

    @F.arrow_udf("string")
    def clean(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for a, b in cuts(texts):
            pairs = zip(texts.slice(a, b - a).to_pylist(), gone.slice(a, b - a).to_pylist())
            out.append(pa.array([without(t, g, pieces_of(t)[1]) if t and g else t for t, g in pairs], pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    text = docs["text"].cast("string")
    joined = docs.join(found, (docs["doc_id"].cast("long") == found["_id"]) & (F.xxhash64(text).bitwiseAND(_TAG) == found["_tag"]), "left")
    return joined.select(*(clean(text, found["_gone"]).alias("text") if c == "text" else docs[c] for c in docs.columns))
