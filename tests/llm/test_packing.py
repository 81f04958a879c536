import zlib
from collections import defaultdict
from itertools import combinations_with_replacement, permutations

import numpy as np
from tokenizers import Tokenizer

from quillon.llm import packing
from quillon.llm.arrow import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def check_packed(docs, packed, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    rows = packed.collect()
    of, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    copies = defaultdict(list)
    for r in docs.collect():
        copies[r["doc_id"]].append(np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4"))
    total = 0
    for d, texts in copies.items():
        want = []
        for ids in texts:
            total += len(ids)
            first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
            edges = [0, *range(first, len(ids) + 1, capacity)]
            want += [(i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in of[d]) == sorted(want)
    return len(sequences), -(-total // capacity)


def test_whole_table(documents):
    n, bound = check_packed(documents, packing.pack(documents, PATH), 2048)
    assert n <= 1.01 * bound + 1


def test_odd_rows(odd, none):
    check_packed(odd, packing.pack(odd, PATH, capacity=64), 64)
    assert packing.pack(none, PATH).count() == 0


def fewest(sizes, capacity):
    best = len(sizes)
    for order in set(permutations(sizes)):
        n, room = 1, capacity
        for s in order:
            if s > room:
                n, room = n + 1, capacity
            room -= s
        best = min(best, n)
    return best


def test_search_is_optimal_on_small_cases(rng):
    for _ in range(60):
        sizes = sorted(rng.integers(1, 21, 7).tolist())
        counts = {n: sizes.count(n) for n in set(sizes)}
        fillings = packing.bin_completion(counts, 20)
        got = defaultdict(int)
        for f in fillings:
            assert sum(n * k for n, k in f.pieces) <= 20
            for n, k in f.pieces:
                got[n] += k * f.sequences
        assert dict(got) == counts
        assert packing.lower_bound(counts, 20) <= sum(f.sequences for f in fillings) == fewest(sizes, 20)


def test_lower_bound_never_exceeds_best_fit():
    for sizes in combinations_with_replacement((3, 5, 7, 9, 11), 5):
        counts = {n: sizes.count(n) for n in set(sizes)}
        assert packing.lower_bound(counts, 12) <= sum(f.sequences for f in packing.best_fit(counts, 12))


def test_a_table_that_best_fit_packs_worse(spark, rng):
    """Lengths for which best fit needs more sequences than the bound, and the search doesn't."""
    while True:
        sizes = rng.integers(4, 13, 24).tolist()
        counts = {n: sizes.count(n) for n in set(sizes)}
        bound = packing.lower_bound(counts, 24)
        if sum(f.sequences for f in packing.best_fit(counts, 24)) > bound == sum(f.sequences for f in packing.bin_completion(counts, 24)):
            break
    docs = spark.createDataFrame([(i, "a" + " a" * (n - 2)) for i, n in enumerate(sizes)], "doc_id long, text string")
    n, _ = check_packed(docs, packing.pack(docs, PATH, capacity=24), 24)
    assert n == bound


def test_bounds_hold_and_the_search_meets_them_on_small_cases(rng):
    for _ in range(60):
        capacity = int(rng.choice([12, 20, 24, 30]))
        sizes = sorted(rng.integers(capacity // 5, capacity * 3 // 5, 7).tolist())
        counts = {n: sizes.count(n) for n in set(sizes)}
        found = packing.plan(counts, capacity)
        assert packing.middle_bound(counts, capacity)[0] <= fewest(sizes, capacity)
        assert found.bound <= found.sequences == fewest(sizes, capacity)


def test_tables_of_middle_lengths(rng):
    """Pieces of a third to a half of a sequence, which best fit packs badly: how far from the bound the search ends."""
    for n, low, high, gap, gain in ((20_000, 500, 999, 0.02, 0.05), (3_000, 680, 999, 0.005, 0.0), (500, 600, 799, 0.06, 0.02), (2_000, 300, 1099, 0.01, 0.01)):
        lengths, c = np.unique(rng.integers(low, high + 1, n), return_counts=True)
        counts = dict(zip(lengths.tolist(), c.tolist()))
        found = packing.plan(counts, 2048)
        got = defaultdict(int)
        for f in found.fillings:
            assert sum(x * k for x, k in f.pieces) <= 2048
            for x, k in f.pieces:
                got[x] += k * f.sequences
        assert dict(got) == counts and sum(f.sequences for f in found.fillings) == found.sequences
        fit = sum(f.sequences for f in packing.best_fit(counts, 2048))
        assert found.bound <= found.sequences <= (1 + gap) * found.bound + 1
        assert found.sequences <= (1 - gain) * fit
