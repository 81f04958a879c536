"""Token counts by source, language and tokenizer version, maintained by signed batches.

A batch holds signed rows: +1 brings a document's tokens in, -1 takes them out, and a revised count is one of each.
Each batch is summed and committed once, as a small table of its own under the ledger's path; totals are sums of
batches, so the order and number of commits don't matter and nothing is ever counted anew.

A ledger's folder holds ``batch=<id>``, a table for each committed batch, and ``sum=<n>``, the sum of all batches whose ids
stand in its own list. The highest ``sum`` counts, with the batches that its list doesn't have. Both appear by one
rename that fails where the name is taken: a commit or a compaction that breaks off anywhere has either happened or not.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.arrow import encoder, map_batches
from quillon.storage import file_system, remove

KEY = ("source", "lang", "tokenizer")
TEXT = ("text_hash", "text_hash2")
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,199}")


def count_tokens(docs: DataFrame, path: str, version: str) -> DataFrame:
    """doc_id, source, lang, tokenizer, text_hash, text_hash2 and n_tokens of every row.

    Null and empty texts have no tokens; repeated rows are counted each; null sources and languages stay null; further
    columns are ignored; an empty table gives no rows. The two hashes tell texts apart.
    """

    def make(batch: pa.RecordBatch) -> dict:
        ids = encoder(path).encode(batch.column("text").to_pylist())
        return {**{c: batch.column(c) for c in ("doc_id", "source", "lang", *TEXT)}, "tokenizer": [version] * len(ids), "n_tokens": list(map(len, ids))}

    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("text_hash"),
        F.xxhash64(F.lit(7), "text").alias("text_hash2"),
    )
    return map_batches(read, make, "doc_id long, source string, lang string, tokenizer string, text_hash long, text_hash2 long, n_tokens long", 2048)


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Rows with n_tokens as a batch that brings them in (+1) or takes them out (-1).

    A null n_tokens counts as none; repeated rows count each; no rows make a batch that changes nothing.
    """
    return rows.select(*KEY, F.lit(sign).cast("long").alias("sign"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """A batch that replaces the counts of some documents, as they stand in the ledger, by new ones."""
    return signed(before, -1).unionByName(signed(after, 1))


class TokenLedger:
    """Totals at ``path``, a folder that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, kind: str) -> list[str]:
        fs, root = file_system(self.spark, self.path)
        if not fs.exists(root):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory())
        return sorted(n.removeprefix(f"{kind}=") for n in names if n.startswith(f"{kind}="))

    def _publish(self, pending: str, name: str) -> bool:
        """Give a written folder its name, unless the name is taken; whether it was given."""
        jvm = self.spark._jvm
        fs, source = file_system(self.spark, pending)
        _, target = file_system(self.spark, f"{self.path}/{name}")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(source, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(source, True)
            if fs.exists(target):
                return False
            raise e
        return True

    def _pending(self) -> str:
        return f"{self.path}/_pending-{uuid.uuid4().hex}"

    def _latest(self) -> str | None:
        """The number of the sum that counts, if there is one."""
        return max(self._names("sum"), default=None)

    def _ids(self, latest: str | None) -> DataFrame:
        """Ids of the batches in a sum; of none without a sum."""
        return self.spark.read.schema("id string").parquet(f"{self.path}/sum={latest}/ids") if latest else self.spark.createDataFrame([], "id string")

    def _new(self, names: list[str], latest: str | None) -> list[str]:
        """Those of these batches that aren't in the sum; ids of batches long summed stay where they are."""
        if not (names and latest):
            return names
        held = {r[0] for r in self._ids(latest).join(F.broadcast(self.spark.createDataFrame([(n,) for n in names], "id string")), "id", "left_semi").collect()}
        return [n for n in names if n not in held]

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch of signed rows, unless this batch_id was committed before; whether it was applied now.

        A batch_id is a letter or digit and then at most 199 letters, digits, dots, dashes or underscores.
        """
        if not _ID.fullmatch(batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if batch_id in self._names("batch") or not self._new([batch_id], self._latest()):
            return False
        # Map-side sums first: however many rows one source has, it is one row for each task in the shuffle.
        delta = changes.groupBy(*KEY).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"))
        pending = self._pending()
        delta.coalesce(8).write.parquet(pending)
        return self._publish(pending, f"batch={batch_id}")

    def batches(self) -> list[str]:
        """Ids of all batches that were ever committed."""
        return sorted({*self._names("batch"), *(r[0] for r in self._ids(self._latest()).collect())})

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; groups that hold nothing any more are left out."""
        latest = self._latest()
        return self._summed(latest, self._new(self._names("batch"), latest))

    def _summed(self, latest: str | None, names: list[str]) -> DataFrame:
        """The totals of a sum, if there is one, and these batches."""
        paths = [f"{self.path}/sum={latest}/sums"] * (latest is not None) + [f"{self.path}/batch={b}" for b in names]
        tables = [self.spark.read.schema(_DELTA).parquet(p) for p in paths]
        deltas = reduce(DataFrame.unionByName, tables) if tables else self.spark.createDataFrame([], _DELTA)
        return deltas.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> bool:
        """Put one sum in the place of all batches; their ids stay known, so a batch that comes again changes nothing.

        False if another compaction came first. What was summed is deleted after the switch; readers don't count it.
        """
        latest = self._latest()
        # Listed once: a batch that comes in from here on is neither summed nor held to be.
        names = self._new(self._names("batch"), latest)
        pending = self._pending()
        self._summed(latest, names).coalesce(1).write.parquet(f"{pending}/sums")
        self._ids(latest).unionByName(self.spark.createDataFrame([(n,) for n in names], "id string")).coalesce(1).write.parquet(f"{pending}/ids")
        if not self._publish(pending, f"sum={int(latest or 0) + 1:010d}"):
            return False
        self.tidy()
        return True

    def tidy(self) -> None:
        """Delete what the sum that counts has made needless, as a compaction that broke off may have left it."""
        latest, names = self._latest(), self._names("batch")
        for n in self._names("sum"):
            if n != latest:
                remove(self.spark, f"{self.path}/sum={n}")
        for b in sorted({*names} - {*self._new(names, latest)}):
            remove(self.spark, f"{self.path}/batch={b}")


def copies_leaving(counted: DataFrame) -> DataFrame:
    """Signed rows that take out all copies of a text but one, of the smallest doc_id: all rows out, one back in.

    A text's copies are summed by key before the shuffle, so a text that a third of all documents share is a few rows.
    Null texts are copies of each other; a row with a null doc_id is the one that stays before all others, and rows that
    share a doc_id go by source, language and tokenizer. No rows, or none that repeat, make an empty batch.
    """
    one = counted.groupBy(*TEXT).agg(F.min(F.struct("doc_id", *KEY, "n_tokens")).alias("kept"), F.count("*").alias("copies")).filter("copies > 1")
    back = one.select("kept.*").select(*KEY, F.lit(1).cast("long").alias("sign"), "n_tokens")
    per_text = counted.groupBy(*TEXT, *KEY).agg(F.count("*").alias("n"), F.min("n_tokens").alias("each"))
    out = per_text.join(one.select(*TEXT), [*TEXT], "left_semi").select(*KEY, (-F.col("n")).alias("sign"), F.col("each").alias("n_tokens"))
    return out.unionByName(back)
