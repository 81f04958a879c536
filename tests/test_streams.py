"""Attempts in any order give the batch's states."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillon.operators import practice
from quillon.streaming import review

SCHEMA = "id long, question_id long, created_at timestamp_ntz, correct boolean, wrong_cause string, feedback string"


def attempts(n, seed):
    r = random.Random(seed)
    base = datetime(2024, 1, 1)
    return [(i, 0 if r.random() < 0.3 else r.randrange(20), base + timedelta(minutes=r.randrange(2000)), r.random() < 0.75, r.choice([None, " ", "slip", "gap"]), r.choice([None, "normal", "easy", "hard", "forgot"])) for i in range(n)]


def shown(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("order", ["in order", "backwards", "shuffled"])
def test_stream_equals_batch_in_any_order(spark, tmp_path, order):
    data = sorted(attempts(400, 7), key=lambda x: (x[2], x[0]))
    if order == "backwards":
        data.reverse()
    elif order == "shuffled":
        random.Random(2).shuffle(data)
    for i in range(0, 400, 100):
        spark.createDataFrame(data[i : i + 100], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/src/b{i:03d}")
    out, stream = str(tmp_path / "out"), spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/src/*")
    run = lambda s: s.writeStream.outputMode("update").foreachBatch(review.keep_latest(out, "question_id", "last_attempt_at")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    run(review.review_stream(stream))
    want = practice.review_state(spark.createDataFrame(data, SCHEMA))
    assert shown(review.latest(spark, out, "question_id", "last_attempt_at").select(want.columns)) == shown(want)
    # Restarted from its checkpoint with one more late attempt, the wrong one before all others.
    more = [(1000, 0, datetime(2023, 1, 1), False, "late", None)]
    spark.createDataFrame(more, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/src/b900")
    run(review.review_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/src/*")))
    want = practice.review_state(spark.createDataFrame(data + more, SCHEMA))
    assert shown(review.latest(spark, out, "question_id", "last_attempt_at").select(want.columns)) == shown(want)


def test_review_log_needs_rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    other = spark.newSession()
    other.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    with pytest.raises(ValueError, match=name):
        review.review_stream(other.readStream.format("rate").load().select(F.col("value").alias("id")))


def test_f16_a_task_gives_a_question_one_reset_and_what_follows(spark):
    base = datetime(2024, 1, 1)
    rows = [(i, 1, base + timedelta(minutes=i), i % 5 > 1, ["slip", " ", "x", None, "x"][i % 5], None) for i in range(30_000)]
    rows += [(40_000 + i, None, base, i != 3, "gap", "forgot" if i == 5 else None) for i in range(8)]
    random.Random(3).shuffle(rows)
    found = review.tails(spark.createDataFrame(rows, SCHEMA).coalesce(1)).orderBy("question_id", "us", "id").collect()
    assert [(r.question_id, r.id, r.resets, r.wrong, r.cause_id, r.cause) for r in found] == [
        (None, 40_005, True, 0, 0, None), (None, 40_006, False, 0, 0, None), (None, 40_007, False, 1, 40_003, "gap"),
        (1, 29_996, True, 0, 0, None), (1, 29_997, False, 0, 0, None), (1, 29_998, False, 0, 0, None), (1, 29_999, False, 12_000, 29_995, "slip"),
    ]
    assert found[2].first_wrong == found[0].us and found[6].first_wrong == found[6].us - 29_999 * 60_000_000


def test_f16_micro_batches_do_not_grow_with_files(spark, tmp_path, monkeypatch):
    from quillon.plans import source_queries
    from quillon.plans.model import attempts as of

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(5).write.parquet(f"{tmp_path}/in/events.parquet")
    monkeypatch.setattr(source_queries, "fresh_path", lambda spark, label: f"{tmp_path}/{label}")
    monkeypatch.setattr(spark, "newSession", lambda: spark)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task, and a file, for each file that is read
    try:
        found = source_queries.streamed_review_state(spark, f"{tmp_path}/in")
        assert shown(found) == shown(practice.review_state(of(spark, f"{tmp_path}/in")).select(found.columns))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert len(list((tmp_path / "attempts-stream").glob("*.parquet"))) == 20
    assert sorted(p.name for p in (tmp_path / "states").iterdir()) == ["batch=0", "batch=1"]
