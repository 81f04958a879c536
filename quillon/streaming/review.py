"""Streams: practice attempts to review state by question, and folders to an index kept up to date."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.sources import readers
from quillon.storage import cut, file_system, names_in, remove

OUT = "question_id long, wrong_count long, correct_streak long, mastered boolean, last_cause string, first_wrong_at timestamp_ntz, last_attempt_at timestamp_ntz, due_at timestamp_ntz, completed_at timestamp_ntz"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY = 86_400_000_000
_EPOCH = datetime(1970, 1, 1)


def step(s: tuple, us: int, correct: bool, cause: str | None, feedback: str) -> tuple:
    """The state after one more attempt."""
    wrong, streak, mastered, last_cause, first, last, due, done = s
    if not correct:
        kept = cause if cause and cause.strip() else last_cause
        return wrong + 1, 0, False, kept, us if first is None else first, us, us + _DAY, None
    if not wrong:
        return wrong, streak, mastered, last_cause, first, us, due, done
    streak = 0 if feedback == "forgot" else streak if feedback == "hard" else streak + 1
    mastered = streak >= 2 and feedback in ("normal", "easy")
    if mastered:
        return wrong, streak, True, last_cause, first, us, due, us
    return wrong, streak, False, last_cause, first, us, us + {"easy": 5, "normal": 3}.get(feedback, 1) * _DAY, None


_FOLD = (
    "wrong long, first_wrong long, reset_us long, reset_id long, last_us long, last_id long, last_fb string, cause_us long, cause_id long, cause string, "
    "steps long, step_us long, step_id long, step_fb string, other_us long, other_id long"
)
_EMPTY = (0, None, None, None, None, None, None, None, None, None, 0, None, None, None, None, None)
_TIMES = ("first_wrong_at", "last_attempt_at", "due_at", "completed_at")


def _later(us: int, number: int, than_us: int | None, than_id: int | None) -> bool:
    return than_us is None or (us, number) > (than_us, than_id)


class ReviewLog(StatefulProcessor):
    """The review fold of one question, whatever order its attempts come in.

    Two states: a summary, and a log of the attempts after the last reset (a wrong or forgotten answer), by time and id. An
    attempt before the reset changes the summary's counts only. One after it is logged and counted. A new last reset, also
    one that comes late, drops the log up to it and counts the rest anew. Frames of ``tails`` are taken one at a time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fold = handle.getValueState("fold", _FOLD)
        self.log = handle.getMapState("log", "us long, id long", "fb string, step boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        s = list(self.fold.get() if self.fold.exists() else _EMPTY)
        names = [c.split()[0] for c in _FOLD.split(", ")]
        f = dict(zip(names, s))
        for frame in rows:
            self._take(f, frame)
        self.fold.update(tuple(f[n] for n in names))
        if f["wrong"]:
            yield _shown(key[0], f)

    def _take(self, f: dict, frame: pd.DataFrame) -> None:
        fresh, moved = [], False
        for r in frame.itertuples():
            us, number, fb = int(r.us), int(r.id), r.feedback
            if _later(us, number, f["last_us"], f["last_id"]):
                f["last_us"], f["last_id"], f["last_fb"] = us, number, fb
            if r.wrong:
                f["wrong"] += int(r.wrong)
                f["first_wrong"] = int(r.first_wrong) if f["first_wrong"] is None else min(int(r.first_wrong), f["first_wrong"])
            if isinstance(r.cause, str) and _later(int(r.cause_us), int(r.cause_id), f["cause_us"], f["cause_id"]):
                f["cause_us"], f["cause_id"], f["cause"] = int(r.cause_us), int(r.cause_id), r.cause
            if not _later(us, number, f["reset_us"], f["reset_id"]):
                continue
            if r.resets:
                f["reset_us"], f["reset_id"], moved = us, number, True
            else:
                fresh.append((us, number, fb, fb in ("normal", "easy")))
        for us, number, fb, step in fresh:
            if _later(us, number, f["reset_us"], f["reset_id"]):
                self.log.updateValue((us, number), (fb, step))
                if not moved:
                    _count(f, us, number, fb, step)
        if moved:
            f.update(steps=0, step_us=None, step_id=None, step_fb=None, other_us=f["reset_us"], other_id=f["reset_id"])
            gone = []
            for (us, number), (fb, step) in self.log.iterator():
                if _later(us, number, f["reset_us"], f["reset_id"]):
                    _count(f, us, number, fb, step)
                else:
                    gone.append((us, number))
            for at in gone:
                self.log.removeKey(at)

    def close(self) -> None:
        pass


def _count(f: dict, us: int, number: int, fb: str, step: bool) -> None:
    """One more attempt after the last reset: a step of the streak, or another that only sets a date."""
    if not step:
        if _later(us, number, f["other_us"], f["other_id"]):
            f["other_us"], f["other_id"] = us, number
        return
    f["steps"] += 1
    if f["step_us"] is None or (us, number) < (f["step_us"], f["step_id"]):
        f["step_us"], f["step_id"], f["step_fb"] = us, number, fb


def _shown(question: int, f: dict) -> pd.DataFrame:
    mastered = f["steps"] >= 2 and f["last_fb"] in ("normal", "easy")
    if f["steps"] and (f["other_us"] is None or (f["step_us"], f["step_id"]) > (f["other_us"], f["other_id"])):
        due = f["step_us"] + (5 if f["step_fb"] == "easy" else 3) * _DAY
    else:
        due = f["other_us"] + _DAY
    row = (question, f["wrong"], f["steps"], mastered, f["cause"], *(None if us is None else _EPOCH + timedelta(microseconds=us) for us in (f["first_wrong"], f["last_us"], due, f["last_us"] if mastered else None)))
    return pd.DataFrame([row], columns=[c.split()[0] for c in OUT.split(", ")]).astype(dict.fromkeys(_TIMES, "datetime64[us]"))


_TAIL = ("question_id", "id", "us", "feedback", "resets", "wrong", "first_wrong", "cause_us", "cause_id", "cause")
#: Rows from which a task gives on what it holds: with so many different questions there is little to drop.
_HELD = 1 << 15


def tails(attempts: DataFrame) -> DataFrame:
    """Attempts without those that an attempt of the same task makes needless: what ``ReviewLog`` takes.

    Of each question a task keeps its last reset and the attempts after it; the newest row also has the number of wrong
    ones, the time of the first and the last cause, of the dropped ones too. No row of a batch is more than one attempt,
    so a question with very many attempts is a few rows a task before the shuffle.
    """
    fb = F.coalesce("feedback", F.lit("normal")) if "feedback" in attempts.columns else F.lit("normal")
    us, number = F.unix_micros(F.col("created_at").cast("timestamp")), F.col("id").cast("long")
    wrong = ~F.coalesce("correct", F.lit(False))
    cause = F.when(wrong & (F.trim("wrong_cause") != ""), F.col("wrong_cause"))
    rows = attempts.select("question_id", number.alias("id"), us.alias("us"), fb.alias("feedback"), (wrong | (fb == "forgot")).alias("resets"), wrong.cast("long").alias("wrong"), us.alias("first_wrong"), us.alias("cause_us"), number.alias("cause_id"), cause.alias("cause"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.column("id").null_count or batch.column("us").null_count:
                raise ValueError("an attempt has no id or no time")
            fresh = pa.Table.from_arrays(batch.columns, names=_TAIL)
            held = _tail(fresh if held is None else pa.concat_tables([held, fresh]))
            if held.num_rows > _HELD:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    return rows.mapInArrow(run, rows.schema)


def _tail(rows: pa.Table) -> pa.Table:
    """Of each question the last reset and what follows it, the newest row with the summary of all."""
    rows = rows.combine_chunks()
    n = rows.num_rows
    if not n:
        return rows
    of = lambda name: rows[name].to_numpy()
    question = rows["question_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    question = (question.chunk(0) if isinstance(question, pa.ChunkedArray) else question).indices.to_numpy()
    order = np.lexsort((of("resets"), of("id"), of("us"), question))
    place = np.arange(n)
    last = np.append(np.flatnonzero(np.diff(question[order])), n - 1)
    first = np.append(0, last[:-1] + 1)
    reset = np.maximum.reduceat(np.where(of("resets")[order], place, -1), first)
    kept = place >= np.repeat(reset, last - first + 1)
    wrong = of("wrong")[order]
    counts = np.add.reduceat(wrong, first)
    earliest = np.minimum.reduceat(np.where(wrong > 0, of("first_wrong")[order], np.iinfo(np.int64).max), first)
    caused = np.lexsort((of("cause_id"), of("cause_us"), rows["cause"].is_valid().to_numpy(), question))[last]
    # Which question a row is the newest of; none for the others.
    newest = np.full(n, -1)
    newest[last] = np.arange(len(last))
    newest = newest[kept]
    held, of_newest = rows.take(order[kept]), pa.array(newest, mask=newest < 0)
    put = {"wrong": np.where(newest < 0, 0, counts[newest]), "first_wrong": np.where(newest < 0, 0, earliest[newest])}
    put |= {name: np.where(newest < 0, 0, of(name)[caused][newest]) for name in ("cause_us", "cause_id")}
    put |= {"cause": rows["cause"].combine_chunks().take(pa.array(caused)).take(of_newest)}
    return pa.table({name: put.get(name, held[name]) for name in _TAIL})


def review_stream(attempts: DataFrame) -> DataFrame:
    """Streaming attempts (id, question_id, correct, wrong_cause, created_at, optional feedback) to changed states.

    Each batch gives the new state of every question in it that has ever been answered wrongly (update mode), equal to
    ``practice.review_state`` of all attempts so far: attempts may come late, in any order. There is no watermark and
    attempts never expire; what is kept of a question is a summary and its attempts after the last wrong or forgotten answer.
    A session whose state store is not RocksDB raises ValueError: keyed logs need it (``spark.sql.streaming.stateStore.providerClass``).
    """
    if not attempts.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    return tails(attempts).groupBy("question_id").transformWithStateInPandas(ReviewLog(), OUT, "Update", "None")


def keep_latest(target: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes the latest row of each key of a batch, under the batch's number: replays
    overwrite, so a batch counts once. ``latest`` reads what is left of all batches."""

    def put(batch: DataFrame, number: int) -> None:
        _latest(batch, key, order).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return put


def latest(spark: SparkSession, target: str, key: str, order: str) -> DataFrame:
    """Of each key the row with the greatest ``order`` in all batches at ``target``; of equal ones the last batch's."""
    rows = spark.read.parquet(target)
    return _latest(rows.withColumn("_order", F.struct(order, "batch")), key, "_order").drop("batch", "_order")


def _latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    # An aggregate and not a window: a key with very many rows is one row a task before the shuffle.
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("_row")).select("_row.*")


def folder_changes(spark: SparkSession, folder: str, known: DataFrame | None, pattern: str = "*.md") -> DataFrame:
    """Files that were added, changed or deleted since ``known`` (path, content_hash): path, status, content_hash, content.

    Contents decide, not times: a file that was touched or moved back is no change. Content is null for deleted files.
    """
    now = readers.with_content(readers.paths(spark, folder, pattern))
    now = now.select("path", F.sha2("content", 256).alias("content_hash"), "content")
    if known is None:
        return now.select("path", F.lit("added").alias("status"), "content_hash", "content")
    k = known.select(F.col("path").alias("_path"), F.col("content_hash").alias("_hash"))
    status = F.when(F.col("_path").isNull(), "added").when(F.col("path").isNull(), "deleted").when(F.col("content_hash") != F.col("_hash"), "changed")
    joined = now.join(k, F.col("path") == F.col("_path"), "full").withColumn("status", status)
    return joined.filter("status is not null").select(F.coalesce("path", "_path").alias("path"), "status", "content_hash", "content")


def poll(spark: SparkSession, folder: str, index: Callable[[DataFrame, int], None], state: str, pattern: str = "*.md") -> bool:
    """One look at a folder: what changed since the last one is given to ``index``; whether there was anything.

    Each look that finds something leaves a table of all paths and hashes at ``state``, after ``index`` is done: if that
    fails, the next look finds the same changes under the same number.
    """
    fs, root = file_system(spark, state)
    looks = sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(root) if fs.exists(file_system(spark, f"{state}/{f.getPath().getName()}/_SUCCESS")[1])) if fs.exists(root) else []
    known = spark.read.schema("path string, content_hash string").parquet(f"{state}/look={looks[-1]}") if looks else None
    number = looks[-1] + 1 if looks else 0
    changes = cut(folder_changes(spark, folder, known, pattern), "changes")
    if changes.isEmpty():
        return False
    index(changes, number)
    after = changes.filter("status <> 'deleted'").select("path", "content_hash")
    if known is not None:
        after = known.join(changes.select("path"), "path", "left_anti").unionByName(after)
    after.write.mode("overwrite").parquet(f"{state}/look={number}")
    return True


def watch(spark, folder: str, index: Callable[[DataFrame, int], None], checkpoint: str, pattern: str = "*.md", every: str | None = "3 seconds"):
    """Index files as they come: each micro-batch of (path, content) is given to ``index``. A stream knows files by path;
    ``poll`` also finds those that were changed or deleted.

    ``every`` None handles what is there and stops. A query restarted from its checkpoint goes on where it stopped.

    Spark's file source would list, remember and name every file in the driver, and each micro-batch would list its files
    again one by one. Here each micro-batch of a clock is a look: tasks list the folder, and paths that are in no earlier
    look's list are written as this look's, beside the checkpoint, before ``index`` has them. A look that is tried again
    has the same files under the same number; a look that finds nothing isn't given to ``index``.
    """
    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    lists = f"{checkpoint}/found"

    def look(_: DataFrame, number: int) -> None:
        earlier = [n for n in names_in(spark, lists) if int(n.split("=")[1]) < number]
        if not file_system(spark, lists)[0].exists(file_system(spark, f"{lists}/batch={number}/_SUCCESS")[1]):
            found = readers.paths(spark, folder, pattern).select("path")
            if earlier:
                seen = spark.read.schema("path string, batch long").parquet(lists).filter(F.col("batch") < number)
                found = found.join(seen.select("path"), "path", "left_anti")
            found.write.mode("overwrite").parquet(f"{lists}/batch={number}")
        fresh = spark.read.schema("path string").parquet(f"{lists}/batch={number}")
        if fresh.isEmpty():
            remove(spark, f"{lists}/batch={number}")
        else:
            index(readers.with_content(fresh), number)

    writer = clock.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()
