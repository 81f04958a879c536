import hashlib
import re

import numpy as np
import pytest

from quillon.llm import winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for a in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[a : a + n]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[k]
        yield d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_against_brute_force(spark, documents, benchmark):
    want = sorted(brute([(r["doc_id"], r["text"]) for r in documents.collect()], [(r[0], r[1]) for r in benchmark.select("item_id", "text").collect()]), key=str)
    assert rows(winnow.contamination(documents, benchmark)) == want
    assert sum(r[5] for r in want) > 3
    # A benchmark over the size bound goes another way, to the same result.
    assert rows(winnow.contamination(documents, benchmark, most_bytes=0)) == want
    bad = {r[0] for r in want if r[5]}
    for most in (1 << 20, 0):
        kept = winnow.keep_uncontaminated(documents, benchmark, most_bytes=most)
        assert kept.columns == documents.columns
        assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in want} - bad


def test_short_items_and_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "five six"), (2, "Seven"), (3, None), (4, "!!"), (None, "one two"), (5, "long " * 13), (5, "long " * 13)], "item_id long, text string")
    want = sorted(brute([(r["doc_id"], r["text"]) for r in odd.collect()], [(i, t) for i, t in items.collect() if i is not None]), key=str)
    assert rows(winnow.contamination(odd, items)) == want
    assert rows(winnow.contamination(odd, items, most_bytes=0)) == want
    assert winnow.contamination(none, items).count() == 0
    assert winnow.contamination(odd, items.limit(0)).filter("n_hit > 0").count() == 0


def test_clashing_columns_and_the_size_of_fingerprints(spark, benchmark):
    item = benchmark.filter("length(text) > 200").first()
    docs = spark.createDataFrame([(None, item["text"], 1, 2), (1, "clean words only", 3, 4), (1, None, 5, 6)], "doc_id long, text string, _text_hash long, _bad int")
    for most in (1 << 20, 0):
        kept = winnow.keep_uncontaminated(docs, benchmark, most_bytes=most)
        assert sorted(map(tuple, kept.collect()), key=str) == [(1, "clean words only", 3, 4), (1, None, 5, 6)]
    assert rows(winnow.contamination(docs, benchmark, most_windows=0)) == rows(winnow.contamination(docs, benchmark))
    text = " ".join(f"w{i}" for i in range(50_000))
    held = winnow.Fingerprints([(1, text), (2, text)])
    order, begins, members = held.lengths[13]
    assert len(order) == 50_000 - 12 and len(members) == 2 * len(order) and held.names == ["1", "2"]
    assert held.judge([text])[0] == (50_000, 50_000, ["1", "2"])


@pytest.mark.parametrize("bits", [0, 3, 64])
def test_words_decide_where_hashes_meet(monkeypatch, rng, bits):
    """With hashes of few bits nearly all windows meet; the words must tell them apart."""
    true = winnow._sums

    def narrow(words, factors, k):
        return true(words, factors, k) & np.uint64((1 << bits) - 1) if factors is winnow._WHOLE else true(words, factors, k)

    monkeypatch.setattr(winnow, "_sums", narrow)
    monkeypatch.setattr(winnow, "_COMPARED", 50)
    some = ["a", "bb", "cé", "d1", "中"]
    text = lambda n: " ".join(rng.choice(some, n))
    items = [(i, text(n)) for i, n in enumerate([2, 2, 3, 5, 9, 13, 14, 20, 40])] + [(90, "a bb"), (91, "A, bb!")]
    docs = [(d, t) for d, t in enumerate([items[8][1] + " x " + items[7][1].upper(), text(300), "", None, "--", "a", items[6][1]])]
    held = winnow.Fingerprints(items)
    if bits < 64:

        def judged(texts):
            words, bounds = winnow.word_hashes(texts)
            spell = winnow.spelled(texts)
            out = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                hit, found = set(), set()
                for n, (order, begins, members) in held.lengths.items():
                    at = np.arange(a, b - n + 1)
                    if len(at):
                        w = narrow(words, winnow._WHOLE, n)[at]
                        at, w = at[np.isin(w, order)], w[np.isin(w, order)]
                        for i, slot in zip(at, held._slots(n, at, w, *spell)):
                            if slot >= 0:
                                hit.update(range(i, i + n))
                                found.update(members[begins[slot] : begins[slot + 1]].tolist())
                out.append((int(b - a), len(hit), [held.names[i] for i in sorted(found)]))
            return out
    else:
        judged = held.judge
    got = judged([t for _, t in docs])
    want = list(brute(docs, items))
    assert [(n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest()) for n, h, i in got] == [w[1:5] for w in want]
