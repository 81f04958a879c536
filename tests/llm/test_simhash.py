import numpy as np
import xxhash

from quillon.llm import simhash


def brute(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius, groups):
    g = groups(len(prints))
    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius):
            g.join(i, i + 1 + int(j))
    return [g.find(i) for i in range(len(a))]


def test_against_brute_force(documents, groups):
    texts = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    prints = [brute(t) for _, t in texts]
    group = components(prints, 4, groups)
    low = {}
    for (d, _), g in zip(texts, group):
        low.setdefault(g, d)
    want = {d: (f"{p:016x}", low[g]) for (d, _), p, g in zip(texts, prints, group)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents).collect()}
    assert got == want and len(set(low.values())) < len(texts)
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns and sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(low.values())


def test_links_keep_chains_and_dense_groups(spark, groups, rng):
    centres = rng.integers(0, 2**63, 30, dtype=np.uint64)
    prints = set(centres.tolist())
    for c in centres.tolist():
        for _ in range(100):  # a dense group, and chains that lead out of the radius
            c2 = c
            for _ in range(int(rng.integers(1, 4))):
                c2 ^= 1 << int(rng.integers(0, 64))
                prints.add(c2)
            c = c2 if rng.random() < 0.3 else c
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    links = [(r["a"], r["b"]) for r in simhash.fingerprint_links(df).collect()]
    place = {int(np.uint64(p).view(np.int64)): i for i, p in enumerate(prints)}
    g = groups(len(prints))
    for a, b in links:
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= 4
        g.join(place[a], place[b])
    want = components(prints, 4, groups)
    got = [g.find(i) for i in range(len(prints))]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    zero = [r for r in rows if r["doc_id"] in (4, 5, 6)]
    assert {(r["fingerprint"], r["component_id"]) for r in zero} == {("0" * 16, 4)}
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert simhash.near_duplicates(none).count() == 0
    kept = [r["doc_id"] for r in simhash.keep_one(odd).collect()]
    # The text without an id is like no other; the row without id and text is one of the empty ones.
    assert kept.count(None) == 1 and kept.count(1) == 2 and not {2, 5, 6} & set(kept)
    assert simhash.keep_one(none).count() == 0


def test_texts_that_share_an_id_are_judged_each(spark):
    t, u = "one two three four five six", "something else altogether that nobody has said"
    rows = [(1, t, "a"), (2, t, "b"), (2, u, "c"), (None, u, "d"), (None, "only here and only once", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hash string")
    assert sorted(r["_hash"] for r in simhash.keep_one(docs).collect()) == ["a", "c", "e"]


def test_blocks_against_all_pairs(rng, groups):
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    for n, m in ((900, 700), (30, 20), (800, 800)):
        x = np.unique(np.concatenate((base, rng.integers(0, 2**63, n - 400 if n > 400 else 0, dtype=np.uint64))))[:n]
        y = x if n == m else np.unique(np.concatenate((near, rng.integers(0, 2**63, 300, dtype=np.uint64))))[:m]
        both = np.unique(np.concatenate((x, y)))
        want, got = groups(len(both)), groups(len(both))
        for i, j in np.argwhere(np.bitwise_count(x[:, None] ^ y[None]) <= 4):
            want.join(np.searchsorted(both, x[i]), np.searchsorted(both, y[j]))
        a, b = simhash.links_between(x, y, 4)
        assert (np.bitwise_count(a ^ b) <= 4).all()
        for p, q in zip(a, b):
            got.join(np.searchsorted(both, p), np.searchsorted(both, q))
        pairs = {(want.find(i), got.find(i)) for i in range(len(both))}
        assert len(pairs) == len({p for p, _ in pairs}) == len({q for _, q in pairs})


def test_grid_of_cells_against_all_pairs(spark, groups, rng):
    """Enough fingerprints for many cells: the same components as all pairs give, chains of near ones across cells."""
    base = rng.integers(0, 1 << 63, 7000, dtype=np.uint64)
    chain = [base[0]]
    for _ in range(300):
        chain.append(chain[-1] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 4, dtype=np.uint64)))
    near = base[1:1200] ^ (np.uint64(1) << rng.integers(0, 64, 1199, dtype=np.uint64))
    every = np.unique(np.concatenate((base, chain, near)))
    assert simhash._groups_for(len(every)) > 1
    links = [(r["a"], r["b"]) for r in simhash.fingerprint_links(spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp long")).collect()]
    place = {int(x): i for i, x in enumerate(every.view(np.int64))}
    got, want = groups(len(every)), groups(len(every))
    for a, b in links:
        assert int(np.bitwise_count(every[place[a]] ^ every[place[b]])) <= 4
        got.join(place[a], place[b])
    for i in range(len(every)):
        for j in np.flatnonzero(np.bitwise_count(every[i] ^ every[i + 1 :]) <= 4).tolist():
            want.join(i, i + 1 + j)
    assert len({want.find(i) for i in range(len(every))}) < len(every) - 1400
    same = {}
    for i in range(len(every)):
        assert same.setdefault(got.find(i), want.find(i)) == want.find(i)
    assert len(same) == len({want.find(i) for i in range(len(every))})


def test_what_is_sent_grows_with_power_one_and_a_half():
    sent = [n * simhash._groups_for(n) for n in (10**7, 10**9)]
    assert sent[1] / sent[0] < 1.1 * 100**1.5
    held = [2 * n / simhash._groups_for(n) for n in (10**7, 10**9)]
    assert held[1] / held[0] < 1.1 * 100**0.5
