"""Jobs: progress, stopping and going on, failing files, streams with a listener."""

import time

import pytest
from pyspark.sql import functions as F

from quillon.sources.store import Store
from quillon.streaming import jobs
from quillon.streaming.jobs import StopFlag


def parse(files):
    """A file is a list of words; one with "bad" in it can't be read."""
    text = F.decode("content", "UTF-8")
    error = F.when(text.contains("bad"), "bad word")
    return files.select("path", F.explode(F.split(text, " ")).alias("word"), error.alias("error"))


def words(store):
    return sorted((r["path"].rsplit("/", 1)[-1], r["word"]) for r in jobs.indexed(store).collect())


def test_failing_files_are_offered_again(spark, tmp_path):
    lib, s = tmp_path / "lib", Store(spark, str(tmp_path / "s"))
    lib.mkdir()
    (lib / "a.md").write_text("one two")
    (lib / "b.md").write_text("bad three")
    (lib / "c.md").write_text("bad forever")
    calls, good = [], []

    def counted(files):
        calls.append(sorted(r["path"].rsplit("/", 1)[-1] for r in files.select("path").collect()))
        # b.md fails twice and then succeeds, as if what it needs came back.
        healed = F.lit(bool(good)) & F.col("path").endswith("b.md")
        return parse(files).withColumn("error", F.when(~healed, F.col("error")))

    look = lambda **k: jobs.index_files(s, jobs.contents(spark, str(lib)), counted, **k)
    assert look() == jobs.Progress(3, 3, 2, "done")
    assert look() == jobs.Progress(2, 2, 2, "done")
    assert {(r["path"][-4:], r["state"], r["tries"], r["error"]) for r in jobs.dead_letters(s).collect()} == {("b.md", "failed", 2, "bad word"), ("c.md", "failed", 2, "bad word")}
    good.append(True)
    assert look() == jobs.Progress(2, 2, 1, "done")
    assert words(s) == [("a.md", "one"), ("a.md", "two"), ("b.md", "bad"), ("b.md", "three")]  # b.md once
    assert {(r["path"][-4:], r["state"]) for r in jobs.dead_letters(s).collect()} == {("c.md", "given_up")}
    assert look() == jobs.Progress(0, 0, 0, "done")
    given_up = [r["path"] for r in jobs.dead_letters(s).collect()]
    assert look(only=given_up).total == 1
    # A change counts anew; a content that was there before isn't parsed again; what is gone leaves the index.
    (lib / "c.md").write_text("fine")
    (lib / "a.md").write_text("uno")
    assert look() == jobs.Progress(2, 2, 0, "done")
    (lib / "a.md").write_text("one two")
    (lib / "b.md").unlink()
    n = len(calls)
    assert look() == jobs.Progress(1, 1, 0, "done") and calls[n:] == [[]]
    assert words(s) == [("a.md", "one"), ("a.md", "two"), ("c.md", "fine")]
    (lib / "c.md").unlink()
    look()
    assert words(s) == [("a.md", "one"), ("a.md", "two")]


def test_a_job_is_stopped_and_goes_on(spark, tmp_path):
    lib, s, flag = tmp_path / "lib", Store(spark, str(tmp_path / "s")), StopFlag(spark, str(tmp_path / "stop"))
    lib.mkdir()
    for i in range(12):
        (lib / f"{i}.md").write_text(f"w{i}")
    log = jobs.log_to(spark, str(tmp_path / "log"))

    def report(p):
        log(p)
        if p.done >= 3:
            flag.set()

    first = jobs.index_files(s, jobs.contents(spark, str(lib)), parse, slices=6, stop=flag, report=report)
    assert first.state == "stopped" and 3 <= first.done < 12
    assert jobs.indexed(s).count() == first.done
    assert jobs.told(spark, str(tmp_path / "log")).filter("state = 'stopped'").count() == 1
    flag.clear()
    # Dies in the middle: whole slices stay.
    seen = []

    def dying(files):
        seen.append(1)
        if len(seen) == 2:
            raise OSError("killed")
        return parse(files)

    with pytest.raises(OSError):
        jobs.index_files(s, jobs.contents(spark, str(lib)), dying, slices=6)
    middle = jobs.indexed(s).count()
    assert first.done < middle < 12
    last = jobs.index_files(s, jobs.contents(spark, str(lib)), parse, slices=2)
    assert last == jobs.Progress(12 - middle, 12 - middle, 0, "done")
    assert words(s) == sorted((f"{i}.md", f"w{i}") for i in range(12))


def test_streams_tell_and_stop(spark, tmp_path):
    log, flag = jobs.QueryLog(), StopFlag(spark, str(tmp_path / "stop"))
    spark.streams.addListener(log)
    try:
        rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 5).option("numPartitions", 1).load()
        q = rate.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
        wait = time.time() + 60
        while log.rows(q) < 10 and time.time() < wait:
            time.sleep(0.1)
        flag.set()
        assert jobs.run_until(q, flag, 0.2) and log.rows(q) >= 10
        bad = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 5).load().select(F.raise_error(F.lit("broken")).alias("x"))
        b = bad.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "d")).start()
        with pytest.raises(Exception, match="broken"):
            jobs.run_until(b, StopFlag(spark, str(tmp_path / "never")))
        wait = time.time() + 30
        while log.states.get(str(b.runId)) != "failed" and time.time() < wait:
            time.sleep(0.1)
        assert log.states[str(q.runId)] == "ended" and "broken" in log.errors[str(b.runId)]
    finally:
        spark.streams.removeListener(log)
