import math

import numpy as np
import pyarrow as pa

from quillon.llm import mih

from .conftest import SF


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    for q, v in queries:
        s = (x * np.array(v, float)).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        yield q, [(int(ids[i]), float(s[i])) for i in order]


def test_recall(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {}
    for r in mih.nearest(table, table.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    hits = total = 0
    for q, want in brute(rows, [r for r in rows if r[0] % 20 == 0], 20):
        assert sorted(got[q]) == list(range(1, 21))
        found = [got[q][i] for i in range(1, 21)]
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        hits += len({v for v, _ in want} & {v for v, _ in found})
        total += 20
    assert hits / total >= 0.9


def test_every_code_within_the_radius_is_found(rng):
    codes = rng.integers(0, 256, (500, 8), dtype=np.uint8)
    block = mih.Block(np.arange(500), rng.normal(size=(500, 4)), codes)
    for radius in (0, 5, 13, 20, 29, 64):
        want = np.bitwise_count(codes[:40, None] ^ codes[None]).sum(axis=2) <= radius
        got = np.zeros(want.shape, bool)
        got[block.within(codes[:40], radius)] = True
        assert np.array_equal(got, want)
    # What is looked up for a small radius is a small part of all pairs.
    assert len(block.looked_up(codes[:40], 5)) < 0.1 * 40 * 500


def test_only_what_is_within_the_radius_is_scored(rng):
    centres = rng.normal(size=(20, 32))
    x = (centres[rng.integers(0, 20, 2000)] + 0.1 * rng.normal(size=(2000, 32))).astype(float)
    turn = np.linalg.qr(rng.normal(size=(64, 64)))[0][:32]
    codes = mih.Codes(x.mean(axis=0), turn, 12)
    packed = codes.encode(x)
    q, ids, scores, compared = mih.Block(np.arange(2000), x, packed).search(np.arange(50), x[:50], packed[:50], 12, 5)
    assert compared < 0.2 * 50 * 2000 and len(q) == 250
    assert np.allclose(scores, (x[ids] * x[q]).sum(axis=1))


def test_recall_on_fifty_thousand_rows(spark, rng):
    centres = rng.normal(size=(500, 32))
    x = centres[rng.integers(0, 500, 50_000)] + 0.7 * rng.normal(size=(50_000, 32))
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(50_000), "embedding": pa.array(x.tolist())}))
    asked = np.arange(0, 50_000, 250)
    got = {}
    for r in mih.nearest(table, table.filter("vec_id % 250 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20]
    assert sum(len(got[q] & set(w.tolist())) for q, w in zip(asked.tolist(), want)) >= 0.9 * want.size


def test_odd_rows(spark):
    nan, v = float("nan"), [1.0, 2.0, 0.5]
    rows = [(0, v), (1, v), (2, v), (2, v), (3, [0.0, 0.0, 0.0]), (4, None), (5, [1.0, None, 2.0]), (6, [nan, 1.0, 1.0]), (7, [1.0, math.inf, 0.0]), (None, v), (8, [1.0]), (9, []), (20, [3.0, 1.0, 1.0]), (40, [-1.0, -2.0, -0.5])]
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<float>, rank int, score string")
    got = {}
    for r in mih.nearest(table, table.filter("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, x) for i, x in rows if i in (0, 1, 2, 20, 40)]
    want = {q: [(n + 1, i, s) for n, (i, s) in enumerate(r)] for q, r in brute(good, [g for g in good if g[0] % 20 == 0], 20)}
    assert {q: sorted(r) for q, r in got.items()} == want
    assert mih.nearest(table.limit(0), table).count() == 0
    assert mih.nearest(table, table.limit(0)).count() == 0
