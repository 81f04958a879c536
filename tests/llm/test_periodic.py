import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from quillon.llm import periodic, queries


def brute_runs(words):
    """All maximal runs, word by word."""
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(24, 3 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    gone = {i for s, size, p in found for i in range(s + p, s + size)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (
        len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{size},{p}\n" for s, size, p in found).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_whole_table(spark, documents):
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, "/root/testdata/sf0.01").collect()}
    texts = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert len(got) == len(texts)
    small = [(d, t) for d, t in texts if len((t or "").split()) < 1500]
    assert len(small) > 900
    for d, t in small:
        assert tuple(got[d][c] for c in COLUMNS) == brute(d, t), d
    assert sum(r["n_runs"] > 0 for r in got.values()) > 40


def test_runs_of_random_words():
    rng = random.Random(2)
    for _ in range(500):
        words = []
        for _ in range(rng.randint(1, 5)):
            some = [rng.randint(0, rng.choice([1, 2, 50])) for _ in range(rng.randint(1, 25))]
            words += (some * 40)[: rng.choice([len(some), rng.randint(1, 130)])]
        assert periodic.runs(np.array(words)) == brute_runs(words), words


def test_words_whose_hashes_meet():
    """In Thue-Morse order the sums modulo 2^64 meet for any multiplier."""
    words = np.tile(np.array([bin(i).count("1") % 2 for i in range(4096)]), 4)
    assert periodic.runs(words) == [(0, 16384, 4096)]
    assert periodic._by_hashes(words, periodic._Hashes(words)) != {(0, 16384): 4096}


def test_long_texts_and_one_period_many_points():
    assert periodic.runs(np.zeros(600_000, np.int64)) == [(0, 600_000, 1)]
    assert periodic.runs(np.arange(600_000) % 70_001) == [(0, 600_000, 70_001)]
    assert periodic.runs(np.arange(600_000)) == []


def test_collapsed():
    assert periodic.collapsed("a b c " * 8 + "d") == "a b c d"
    assert periodic.collapsed("a b c " * 7) == "a b c " * 6 + "a b c"  # 21 words are too few
    assert periodic.collapsed(None) is None and periodic.collapsed("") == ""


def test_odd_rows(odd, none):
    rows = sorted((r["doc_id"] is not None, r["doc_id"] or 0, *(tuple(r[c] for c in COLUMNS))) for r in periodic.find_runs(odd, plant=True).collect())
    assert len(rows) == odd.count()
    for r in odd.filter("length(text) < 1000 or text is null").collect():
        assert (r["doc_id"] is not None, r["doc_id"] or 0, *brute(r["doc_id"], r["text"])) in rows
    assert periodic.find_runs(none).count() == 0
