import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quillon.llm import queries, spelling


def brute(rows):
    """The contract by the plainest means: all words against all one-edit deletions and wildcards."""
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    n = {w: k for w, k in total.items() if len(w) >= 6 and k >= 5}
    near = defaultdict(set)
    wild, shorter = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            wild[w[:i], w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in n:
                shorter[w].add(w[:i] + w[i + 1 :])
    for group in wild.values():
        for w in group:
            near[w] |= group - {w}
    for w, group in shorter.items():
        near[w] |= group
        for v in group:
            near[v].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_whole_table(spark, documents):
    got = [tuple(r) for r in queries.op13_spelling(spark, "/root/testdata/sf0.01").collect()]
    want = brute([(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()])
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(r[1] is not None for r in got) > 10 and any(r[1] != r[2] for r in got if r[1])


@pytest.mark.parametrize("block", [2, 20_000])
def test_small_blocks_are_halved_and_nothing_is_lost(spark, block):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(40)]
    words = set(stems)
    for w in stems:
        for _ in range(4):
            i = rng.randrange(len(w))
            words |= {w[:i] + w[i + 1 :], w[:i] + rng.choice("abc") + w[i:], w[:i] + rng.choice("abc") + w[i + 1 :]}
    text = " ".join(w for w in sorted(words) for _ in range(rng.choice([5, 6, 30, 200])))
    rows = [(1, text, None, None, None, None, None), (2, "x" * 70_000 + " " + "x" * 70_001, None, None, None, None, None)]
    rows += [(k, ("y" * 5_000 + " ") * 5 + ("y" * 4_999 + " ") * 30, None, None, None, None, None) for k in (3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n long, form string, near string, size int")
    got = {tuple(r) for r in spelling.group_variants(docs, block=block, plant=True).collect()}
    assert got == brute([(r[0], r[1]) for r in rows]) and max(r[4] for r in got) > 5


def test_every_pair_is_counted_once():
    rng = random.Random(5)
    for _ in range(300):
        words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([6, 7]))) for _ in range(rng.randint(2, 40))})
        items = [(w, 1) for w in words]
        found = [tuple(sorted((u, v))) for size in (5, 6, 7) for u, _, v, _ in spelling.block_pairs(size, "", [x for x in items if len(x[0]) - size in (0, 1)])]
        assert len(found) == len(set(found))
        assert set(found) == {(u, v) for i, u in enumerate(words) for v in words[i + 1 :] if spelling.is_near(u, v)}


def test_is_near():
    for u, v, want in [("abcdef", "abcdef", False), ("abcdef", "abcde", True), ("abcdef", "bcdef", True), ("abcdef", "abXdef", True), ("abcdef", "abXdeY", False), ("abcdef", "abdcef", False), ("aaaaaa", "aaaaaaa", True), ("abcdef", "abcdefgh", False)]:
        assert spelling.is_near(u, v) is want and spelling.is_near(v, u) is want


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert {tuple(r) for r in spelling.group_variants(odd, plant=True).collect()} == brute(rows)
    assert spelling.group_variants(none).count() == 0
    with pytest.raises(ValueError):
        spelling.group_variants(none, ratio=1)
