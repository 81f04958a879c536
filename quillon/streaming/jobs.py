"""Indexing jobs over a folder: progress, stopping, going on, and failed files that are offered again.

A store holds two tables. ``files`` has a row for each file: its content's hash, state, number of tries and last error.
``rows`` has what the parser made of each content. A job goes through its files in slices; each slice is one version of
the store, both tables at once, so a job that is stopped or dies has done whole slices and the next one does the rest.
"""

from __future__ import annotations

import json
import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

from quillon.sources.store import Store
from quillon.storage import cut, file_system, write_text

INDEXED, FAILED, GIVEN_UP = "indexed", "failed", "given_up"
FILES = "path string, content_hash string, state string, tries int, error string"


@dataclass(frozen=True)
class Progress:
    """How far a job is: files it was started for, done of these, and of the done those that failed."""

    total: int
    done: int
    failed: int
    state: str  # running, done, stopped


class StopFlag:
    """A file in a shared folder that asks jobs to stop; whoever reaches the folder may set it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def set(self) -> None:
        if not self.is_set():
            write_text(self.spark, self.path, "stop")

    def clear(self) -> None:
        fs, target = file_system(self.spark, self.path)
        fs.delete(target, False)

    def is_set(self) -> bool:
        fs, target = file_system(self.spark, self.path)
        return fs.exists(target)


def contents(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """path, content_hash and content of a folder's files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return raw.select("path", F.sha2("content", 256).alias("content_hash"), "content")


def index_files(
    store: Store,
    files: DataFrame,
    parse: Callable[[DataFrame], DataFrame],
    slices: int = 1,
    most_tries: int = 3,
    stop: StopFlag | None = None,
    report: Callable[[Progress], None] | None = None,
    only: list[str] | None = None,
) -> Progress:
    """Index all of ``files`` (path, content_hash, content) that are new, changed or failed before.

    ``parse`` makes rows of (path, content_hash, content); it keeps path, and says in a column ``error`` (null: none) why a
    file can't be read. A file with any error leaves no rows; it is tried again by the next job, ``most_tries`` times in all
    for one content, then given up until it changes or ``only`` names it. A content that was indexed before under its path
    is not parsed again. Files that are gone leave the index with the first slice. ``report`` hears of every slice.
    """
    spark = store.spark
    now = cut(files.select("path", "content_hash"), "now")
    present = store.version()
    known = store.read("files", present.number) if present and "files" in present.tables else spark.createDataFrame([], FILES)
    todo = cut(_todo(now, known, most_tries, only), "todo")
    total = todo.count()
    done = failed = 0
    gone = known.join(now, "path", "left_anti")
    if total == 0 and not gone.isEmpty():
        store.commit({"files": known.join(now.select("path"), "path", "left_semi")}, keys={"files": "path"}, reason="files gone")
    for i in range(slices if total else 0):
        if stop is not None and stop.is_set():
            return _told(report, Progress(total, done, failed, "stopped"))
        part = cut(todo.filter(F.pmod(F.xxhash64("path"), F.lit(slices)) == i), "slice")
        n = part.count()
        if not n:
            continue
        failed += _index_slice(store, files, now, part, parse, most_tries)
        done += n
        _told(report, Progress(total, done, failed, "running" if done < total else "done"))
    return Progress(total, done, failed, "done")


def _told(report: Callable[[Progress], None] | None, p: Progress) -> Progress:
    if report:
        report(p)
    return p


def _todo(now: DataFrame, known: DataFrame, most_tries: int, only: list[str] | None) -> DataFrame:
    k = known.select("path", F.col("content_hash").alias("_hash"), "state", "tries")
    joined = now.join(k, "path", "left")
    same = F.coalesce(F.col("content_hash") == F.col("_hash"), F.lit(False))
    again = F.col("state") == FAILED
    if only is not None:
        again = F.col("state").isin(FAILED, GIVEN_UP) & F.col("path").isin(only)
    return joined.filter(~same | F.coalesce(again, F.lit(False))).select("path", "content_hash", F.when(same, F.col("tries")).otherwise(0).alias("tries"))


def _index_slice(store: Store, files: DataFrame, now: DataFrame, part: DataFrame, parse: Callable[[DataFrame], DataFrame], most_tries: int) -> int:
    """Parse and commit one slice; how many of its files failed."""
    spark, present = store.spark, store.version()
    tables = present.tables if present else {}
    before = store.read("rows", present.number) if "rows" in tables else None
    held = before.select("path", "content_hash").distinct() if before is not None else None
    fresh = part.join(held, ["path", "content_hash"], "left_anti") if held is not None else part
    parsed = cut(parse(files.join(fresh.select("path", "content_hash"), ["path", "content_hash"], "left_semi")), "parsed")
    wrong = parsed.filter("error is not null").groupBy("path").agg(F.min("error").alias("error"))
    rows = parsed.join(part.select("path", "content_hash"), "path").join(wrong.select("path"), "path", "left_anti").drop("error")
    rows = rows.select("path", "content_hash", *(c for c in parsed.columns if c not in ("path", "content_hash", "error")))
    tries = F.when(F.col("error").isNull(), F.col("tries")).otherwise(F.col("tries") + 1)
    state = F.when(F.col("error").isNull(), INDEXED).when(F.col("tries") + 1 >= most_tries, GIVEN_UP).otherwise(FAILED)
    new = cut(part.join(wrong, "path", "left").select("path", "content_hash", state.alias("state"), tries.alias("tries"), "error"), "states")
    old = store.read("files", present.number) if "files" in tables else spark.createDataFrame([], FILES)
    kept = old.join(new.select("path"), "path", "left_anti").join(now.select("path"), "path", "left_semi")
    store.commit({"files": kept.unionByName(new)}, {"rows": rows}, {"files": "path", "rows": "path"}, n_parts=8, reason="index")
    return new.filter("error is not null").count()


def indexed(store: Store) -> DataFrame:
    """The rows of all files that are there and readable, of each as its content is now."""
    good = store.read("files").filter(F.col("state") == INDEXED).select("path", "content_hash")
    return store.read("rows").join(good, ["path", "content_hash"], "left_semi")


def dead_letters(store: Store) -> DataFrame:
    """Files that couldn't be read: path, state (failed: offered again; given_up), tries and error."""
    return store.read("files").filter(F.col("state") != INDEXED).select("path", "state", "tries", "error")


# Streams.


class QueryLog(StreamingQueryListener):
    """Progress of a session's streaming queries: attach with ``spark.streams.addListener``.

    Keeps the last ``most`` batches of each query, and whether it runs, failed or ended.
    """

    def __init__(self, most: int = 100):
        self.most = most
        self.batches: dict[str, deque[dict]] = {}
        self.states: dict[str, str] = {}
        self.errors: dict[str, str] = {}

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.states[str(event.runId)] = "running"
        self.batches.setdefault(str(event.runId), deque(maxlen=self.most))

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        kept = self.batches.setdefault(str(p.runId), deque(maxlen=self.most))
        kept.append({"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "ms": p.durationMs.get("triggerExecution"), "at": p.timestamp})

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        self.states[str(event.runId)] = "idle"

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.states[str(event.runId)] = "failed" if event.exception else "ended"
        if event.exception:
            self.errors[str(event.runId)] = event.exception

    def rows(self, query: StreamingQuery) -> int:
        """Rows that the kept batches of a query had."""
        return sum(b["rows"] for b in self.batches.get(str(query.runId), ()))


def run_until(query: StreamingQuery, stop: StopFlag, every_seconds: float = 1.0) -> bool:
    """Wait for a streaming query; end it between batches once the flag is set. Whether the flag ended it.

    Started again from its checkpoint the query goes on where it was.
    """
    while not query.awaitTermination(every_seconds):
        if stop.is_set():
            query.stop()
            return True
    return False


def log_to(spark: SparkSession, folder: str) -> Callable[[Progress], None]:
    """A ``report`` that leaves each step as a small JSON file, for whoever watches a job from elsewhere; ``told`` reads them."""

    def put(p: Progress) -> None:
        name = f"{p.done:010d}-{uuid.uuid4().hex[:8]}"
        write_text(spark, f"{folder}/{name}.json", json.dumps(asdict(p)))

    return put


def told(spark: SparkSession, folder: str) -> DataFrame:
    """What ``log_to`` left: total, done, failed, state."""
    return spark.read.schema("total long, done long, failed long, state string").json(folder)
