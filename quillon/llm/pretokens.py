"""Token ids of whole texts, made word by word.

A byte-level BPE never merges across the boundaries of its pre-tokens, so the ids of a text are the ids of its
pre-tokens in order. Boundaries are found here for many texts at once with numpy, each *different* pre-token goes
through the ``tokenizers`` library once, and its ids are looked up for every occurrence. Texts with characters whose
class or normal form depends on neighbours (anything outside plain Latin), and texts with the string of an added token,
such as an end mark, are given to the library whole, so the ids are the library's for every text.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

# Character classes.
LETTER, NUMBER, OTHER, SPACE, BREAK, UNSAFE = range(6)
_SAFE_PUNCTUATION = (0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2026, 0x20AC)

_CHUNK = 600_000
_KEEP = 1_000_000
_RECENT = 30_000


def _class_table() -> np.ndarray:
    import unicodedata

    table = np.full(0x110000, UNSAFE, np.uint8)
    for cp in [*range(0x180), *_SAFE_PUNCTUATION]:
        kind = unicodedata.category(chr(cp))
        if cp in (9, 10, 11, 12, 13, 32):
            table[cp] = SPACE
        elif cp < 32 or 0x7F <= cp < 0xA1 or cp in (0x130, 0x149, 0x17F):
            continue
        elif kind[0] == "L":
            table[cp] = LETTER
        elif kind[0] == "N":
            table[cp] = NUMBER
        elif kind[0] != "M":
            table[cp] = OTHER
    return table


def _span_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all spans, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class WordEncoder:
    """Encodes texts with a ``tokenizers`` file; ``spaces`` says whether blanks belong to the pre-tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        probe = self.tokenizer.encode(" a", add_special_tokens=False).ids
        self.spaces = probe != self.tokenizer.encode("a", add_special_tokens=False).ids
        self.table = _class_table()
        self.factors = np.random.default_rng(7).integers(0, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._forget()

    def _forget(self) -> None:
        # Words by hash, with where their ids begin and how many they have: most words, and those met of late.
        self.words = self.recent = (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text (uint32); null counts as empty."""
        out: list[np.ndarray] = []
        part: list[str] = []
        size = 0
        for t in texts:
            t = t or ""
            part.append(t)
            size += len(t) + 1
            if size >= _CHUNK:
                out += self._encode_chunk(part)
                part, size = [], 0
        return out + (self._encode_chunk(part) if part else [])

    def _has_added(self, text: str) -> bool:
        low = text.lower()
        return any(a in low for a in self.added)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encode_chunk(self, texts: list[str]) -> list[np.ndarray]:
        big = "\0".join(texts) + "\0"
        cps = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1) - 1
        classes = self.table[cps]
        classes[ends] = BREAK
        odd = np.flatnonzero(classes == UNSAFE)
        whole = set(np.unique(np.searchsorted(ends, odd)).tolist()) if len(odd) else set()
        if self._has_added(big):
            whole.update(i for i, t in enumerate(texts) if self._has_added(t))
        starts, stops = self._boundaries(cps, classes)
        ids, counts = self._lookup(big, cps, starts, stops)
        total = np.concatenate(([0], np.cumsum(counts)))
        cut = total[np.searchsorted(starts, np.concatenate(([0], ends)))]
        out = [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        for i in whole:
            out[i] = self._whole(texts[i])
        return out

    def _boundaries(self, cps: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(cps)
        start = np.ones(n, bool)
        np.not_equal(classes[1:], classes[:-1], out=start[1:])
        blank = classes == SPACE
        if self.spaces:
            # The last blank before a word starts a pre-token of its own; a plain space takes the word along.
            last = blank.copy()
            last[:-1] &= (classes[1:] != SPACE) & (classes[1:] != BREAK)
            last[-1] = False
            taken = np.zeros(n, bool)
            taken[1:] = last[:-1] & (cps[:-1] == 32)
            start = (start & ~taken) | last
        else:
            start |= classes == NUMBER
        start |= classes == BREAK
        self._contractions(cps, classes, start)
        at = np.flatnonzero(start)
        stop = np.append(at[1:], n)
        keep = classes[at] != BREAK
        if not self.spaces:
            keep &= classes[at] != SPACE
        return at[keep], stop[keep]

    def _contractions(self, cps: np.ndarray, classes: np.ndarray, start: np.ndarray) -> None:
        """'s 't 're 've 'm 'll 'd, where the apostrophe starts a pre-token, end that pre-token."""
        at = np.flatnonzero((cps[:-1] == 39) & start[:-1] & (classes[1:] == LETTER))
        if not len(at):
            return
        lower = 0 if self.spaces else 32
        first, second = cps[at + 1].copy(), np.where(classes[np.minimum(at + 2, len(cps) - 1)] == LETTER, cps[np.minimum(at + 2, len(cps) - 1)], 0)
        if lower:  # this file's normaliser lowers the case before the split
            first = np.where((first >= 65) & (first <= 90), first + 32, first)
            second = np.where((second >= 65) & (second <= 90), second + 32, second)
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = ~one & (((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l")))
        for hit, n in ((one, 2), (two, 3)):
            p = at[hit]
            start[p + 1] = False
            rest = p[classes[p + n] == LETTER] + n
            start[rest] = True

    def _lookup(self, big: str, cps: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all pre-tokens and how many each has."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lengths = stops - starts
        index = _span_index(starts, lengths)
        begins = np.cumsum(lengths) - lengths
        place = index - np.repeat(starts, lengths)
        hashes = np.add.reduceat((cps[index].astype(np.uint64) + np.uint64(1)) * self.factors[place & 0xFFFF], begins)
        hashes ^= hashes >> np.uint64(29)
        hashes = (hashes + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(32)
        values, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.words[0]) > _KEEP or self.used > 8 * _KEEP:
            self._forget()
        at, size = np.zeros(len(values), np.int32), np.zeros(len(values), np.int32)
        left = np.arange(len(values))
        for known, places, sizes in (self.words, self.recent):
            slot = np.minimum(np.searchsorted(known, values[left]), max(0, len(known) - 1))
            hit = known[slot] == values[left] if len(known) else np.zeros(len(left), bool)
            at[left[hit]], size[left[hit]] = places[slot[hit]], sizes[slot[hit]]
            left = left[~hit]
        if len(left):
            words = [big[a:b] for a, b in zip(starts[first[left]].tolist(), stops[first[left]].tolist())]
            made = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            new = np.fromiter(map(len, made), np.int32, len(made))
            flat = np.fromiter(chain.from_iterable(made), np.uint32, int(new.sum()))
            if self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros(len(self.flat) + len(flat), np.uint32)))
            self.flat[self.used : self.used + len(flat)] = flat
            at[left], size[left] = self.used + np.cumsum(new) - new, new
            self.used += len(flat)
            self.recent = _merged(self.recent, (values[left], at[left], size[left]))
            if len(self.recent[0]) > max(_RECENT, len(self.words[0]) // 8):
                self.words, self.recent = _merged(self.words, self.recent), tuple(x[:0] for x in self.recent)
        counts = size[inverse].astype(np.int64)
        return self.flat[_span_index(at[inverse], counts)], counts


def _merged(words: tuple[np.ndarray, ...], more: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Both, by hash; they have none in common."""
    put = np.searchsorted(words[0], more[0])
    return tuple(np.insert(a, put, b) for a, b in zip(words, more))
