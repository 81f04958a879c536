"""Findings of the fourth round, each with what failed before."""

import collections
import itertools
import random

from pyspark.sql import functions as F

from quillon.operators import dedup, pairing
from quillon.plans import all_queries

Q = all_queries.QUERIES

BASE = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf at night"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_f2_candidates_are_pairs_of_documents(spark, tmp_path):
    # Copies were listed with their representative only, and other texts with that of a group.
    sf = documents(spark, tmp_path, [BASE, BASE + "!", BASE, None, "qwertzuiop" * 3, "ab"])
    found = Q["lsh_candidates"](spark, sf)
    assert found.columns == ["a", "b"]
    assert sorted(map(tuple, found.collect())) == [(0, 1), (0, 2), (1, 2)]


def test_f3_near_pairs_are_pairs_of_documents(spark, tmp_path):
    sf = documents(spark, tmp_path, [BASE, BASE + " x", BASE + "!", None, BASE, BASE + " x.", "qwertzuiop" * 3])
    found = Q["shingle_jaccard_pairs"](spark, sf)
    assert found.columns == ["a", "b", "similarity"]
    grams = [{t[i : i + 3] for i in range(len(t) - 2)} for t in (BASE.replace(" ", ""), BASE.replace(" ", "") + "x")]
    other = round(len(grams[0] & grams[1]) / len(grams[0] | grams[1]), 9)
    want = {(a, b): 1.0 if (a in (1, 5)) == (b in (1, 5)) else other for a, b in itertools.combinations((0, 1, 2, 4, 5), 2)}
    assert {(r["a"], r["b"]): r["similarity"] for r in found.collect()} == want


def test_f3_classes_of_several_blocks_meet_once(spark):
    ids = random.Random(3).sample(range(1000), 60)
    texts = [(i, BASE + (" x" if n % 3 == 0 else "") + "!" * (n % 2)) for n, i in enumerate(ids)] + [(1000, "entirely other words without any tie 12345")]
    found = [tuple(r) for r in dedup.near_pairs(spark.createDataFrame(texts, "id long, text string"), block=8).select("a", "b").collect()]
    assert len(found) == 60 * 59 // 2 and set(found) == set(itertools.combinations(sorted(ids), 2))


def test_f1_places_are_judged_as_alignment_says(spark):
    # Pairs were made, with both texts, by a shuffle of every stem for each offset.
    r = random.Random(4)
    words = ["甲乙丙丁", "戊己庚辛", "ab", "cd", "，", " x", "ef", "子丑", None, ""]
    text = lambda: None if r.random() < 0.05 else "".join(w for w in r.choices(words, k=r.randint(0, 9)) if w)
    stems = [(b, k, n, r.randint(0, 3), text()) for b in (1, 2, None) for k in (1, 2, None) for n in range(1, r.choice((45, 90)))]
    texts = {(b, k, n): x for b, k, n, _, x in stems}
    excerpts = [(b, k, n, 0, "AB"[n % 2], r.choice((texts.get((b, k, n + (b or 0) - 1)), (texts.get((b, k, n + (b or 0) - 1)) or "")[1:], text()))) for b, k in ((1, 1), (1, 2), (2, 1), (3, 1), (None, 1)) for n in range(1, 70)]
    q = spark.createDataFrame(stems, "book int, set_no int, num int, line_no int, stem string")
    s = spark.createDataFrame(excerpts, "book int, set_no int, num long, line_no int, answer string, excerpt string")
    pairs = [(*x[:3], y[2], o, y[4], x[4], y[5]) for b in (1, 2) for k in (1, 2) for o in range(-2, 3) for x, y in placed([v for v in stems if v[:2] == (b, k)], [v for v in excerpts if v[:2] == (b, k)], o) if y[5]]
    scored = spark.createDataFrame(pairs, "book int, set_no int, num int, solution_num long, offset int, answer string, q string, t string").withColumn("score", pairing.alignment(F.col("q"), F.col("t")))
    good = [tuple(x) for x in scored.filter(F.col("score") >= pairing.THRESHOLD).drop("q", "t").collect()]
    counts = collections.Counter((x[0], x[1], x[4]) for x in good)
    best = {key[:2]: max((o for b, k, o in counts if (b, k) == key[:2]), key=lambda o: (counts[*key[:2], o], -abs(o), -o)) for key in counts}
    want = sorted(x for x in good if best[x[:2]] == x[4])
    assert len(want) > 50 and len(set(best.values())) > 1
    found = pairing.by_position(q, s)
    assert found.columns == ["book", "set_no", "num", "solution_num", "offset", "answer", "score"]
    assert sorted(map(tuple, found.collect())) == want
    assert "Generate" not in plan(found) and "Join" not in plan(found)


def placed(stems, excerpts, offset):
    """Each question with the solution that many places on."""
    q, s = (sorted(rows, key=lambda v: v[2:4]) for rows in (stems, excerpts))
    return [(x, s[n + offset]) for n, x in enumerate(q) if 0 <= n + offset < len(s)]


def test_f1_sets_go_on_from_batch_to_batch(spark):
    rows = [(b, n, "".join(chr(0x4E00 + 97 * b + 11 * n + i) for i in range(10))) for b in range(3) for n in range(1, 40)]
    q = spark.createDataFrame([(b, 1, n, 0, t) for b, n, t in rows], "book int, set_no int, num int, line_no int, stem string")
    s = q.filter("num > 1").select("book", "set_no", "num", "line_no", F.lit("A").alias("answer"), F.col("stem").alias("excerpt"))
    want = sorted(tuple(x) for x in pairing.by_position(q, s).collect())
    assert {(b, n) for b, n, _ in rows if n > 1} == {(x[0], x[2]) for x in want if x[2] == x[3]}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(tuple(x) for x in pairing.by_position(q, s).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_f1_texts_of_a_booklet_are_not_shuffled(spark, tmp_path):
    spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 5), (None, 3), (3, None), (3, 4), (3, 6)], "l_orderkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = Q["pair_by_position"](spark, str(tmp_path))
    before = plan(found).split("MapInArrow")[1]
    assert "sha2" in before and "REPARTITION_BY_NUM" in before and "ENSURE_REQUIREMENTS" not in before
    assert sorted(map(tuple, found.filter("book < 3").collect())) == [(1, 2, 2, -1)]
