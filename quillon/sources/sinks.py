"""Renderers and writers: Markdown, HTML, ledgers, reports and packages."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.text import file_segment, html_escaped
from quillon.sources.store import checksums
from quillon.storage import arrow_file_system, cut, file_system, remove, rename_once


def question_markdown() -> Column:
    """A question's file: front matter in JSON values, then stem, options and explanation."""
    field = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit('""')))
    quoted = lambda c: F.to_json(F.array(F.coalesce(c, F.lit("")))).substr(F.lit(2), F.char_length(F.to_json(F.array(F.coalesce(c, F.lit(""))))) - 2)
    head = F.concat_ws("\n", F.lit("---"), field("id", quoted(F.col("id").cast("string"))), field("category", quoted(F.col("category"))), field("answer", F.to_json("answer")), field("difficulty", F.col("difficulty").cast("string")), field("tags", F.to_json("tags")), F.lit("---"))
    options = F.array_join(F.transform("options", lambda o: F.concat(o["key"], F.lit(". "), o["text"])), "\n")
    tail = F.when(F.coalesce("explanation", F.lit("")) != "", F.concat(F.lit("## 解析\n\n"), "explanation"))
    return F.concat_ws("\n\n", head, F.col("stem"), F.nullif(options, F.lit("")), tail)


def library_body(answers: bool = True, notes: bool = False, html: bool = False) -> Column:
    """A question of a library's document: (id, stem, options, answer, note) as Markdown or HTML."""
    show = (lambda c: html_escaped(c)) if html else (lambda c: c)
    options = F.array_join(F.transform("options", lambda o: F.concat(o["key"], F.lit(". "), show(o["text"]))), "<br>" if html else "\n")
    parts = [F.concat(F.lit("<h3>" if html else "### "), F.col("id").cast("string"), F.lit("</h3>" if html else "")), show(F.col("stem")), F.nullif(options, F.lit(""))]
    if answers:
        parts.append(F.concat(F.lit("Answer: "), F.array_join("answer", "")))
    if notes:
        parts.append(F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("Note: "), show(F.col("note")))))
    return F.concat_ws("<br>\n" if html else "\n\n", *parts)


def library_document(rows: DataFrame, answers: bool = True, notes: bool = False, html: bool = False) -> DataFrame:
    """One text for each subject, its questions in order of id, for libraries of which a subject fits a row; ``write_library``
    writes any."""
    texts = rows.select("subject", F.struct("id", library_body(answers, notes, html).alias("t")).alias("e"))
    return texts.groupBy("subject").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["t"]), "\n\n").alias("text"))


def write_library(rows: DataFrame, path: str, answers: bool = True, notes: bool = False, html: bool = False, per_task: int = 200_000) -> DataFrame:
    """A file for each subject, its questions in order of id: what ``library_document`` says, of any size. Returns what
    ``write_ordered`` does."""
    head, foot = ("<!doctype html>\n<meta charset=\"utf-8\">\n", "\n") if html else ("", "\n")
    name = F.concat(file_segment(F.col("subject")), F.lit(".html" if html else ".md"))
    texts = rows.select(name.alias("name"), "id", library_body(answers, notes, html).alias("text"))
    return write_ordered(texts, path, ["id"], between="\n\n", head=head, foot=foot, per_task=per_task)


def write_ordered(rows: DataFrame, path: str, order: list[str], between: str = "\n", head: str = "", foot: str = "", per_task: int = 200_000) -> DataFrame:
    """A file for each ``name`` of (name, text and the columns of order): its texts in order, ``between`` them a separator.

    Rows are sorted in ranges of about ``per_task``. Each task streams its range: a name that begins and ends within the range
    is a file at once, and only the first and the last name of a range are pieces, which one task for each such file streams
    into it. No task holds more than a batch of rows or a block of bytes, and one name may have any number of texts. The
    folder appears whole, by one rename; FileExistsError if it is there. Null names and texts are left out. Returns name, rows
    and bytes of each file.
    """
    spark = rows.sparkSession
    fs, target = file_system(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    full = str(fs.makeQualified(target).toString())
    pending = f"{full}._pending-{uuid.uuid4().hex}"
    given = rows.filter("name is not null and text is not null")
    n = -(-given.count() // per_task) or 1
    keys = ["name", *order]
    ranged = given.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id()).select("name", "text", "_range")
    glue, start, end = between.encode(), head.encode(), foot.encode()
    schema = "name string, number long, place string, headed boolean, rows long, bytes long"
    types = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = arrow_file_system(pending)
        attempt, name, out, count, size, made, headed = uuid.uuid4().hex[:12], None, None, 0, 0, 0, False
        done: list[tuple] = []

        def close(whole: bool) -> None:
            nonlocal size
            if whole:
                size += out.write(end) if end else 0
            out.close()
            if whole:
                system.move(f"{root}/{place}", f"{root}/files/{name}")  # another attempt's file, if any, holds the same
            done.append((name, number, None if whole else place, headed, count, size))

        number, place = 0, ""
        for batch in batches:
            for this, text, range_ in zip(*(batch.column(c).to_pylist() for c in ("name", "text", "_range"))):
                if this != name:
                    if out is None:
                        for part in ("pieces", "files"):
                            system.create_dir(f"{root}/{part}", recursive=True)
                    else:
                        close(headed)
                    # The range before may end with the first name, so its head is left to the task that joins.
                    headed = out is not None
                    name, number, count, size = this, range_, 0, 0
                    place = f"pieces/{range_:08d}-{made:08d}-{attempt}"
                    made += 1
                    out = system.open_output_stream(f"{root}/{place}")
                    size += out.write(start) if headed and start else 0
                else:
                    size += out.write(glue) if glue else 0
                size += out.write(text.encode("utf-8", "surrogatepass"))
                count += 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=schema.replace(",", "").split()[::2])
                done.clear()
        if out is not None:
            close(False)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=schema.replace(",", "").split()[::2])

    made = cut(ranged.mapInArrow(pieces, schema), "pieces")
    # A file has one piece for each range at most.
    parts = made.filter("place is not null").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("number", "place", "headed"))).alias("parts"), F.sum("rows").alias("rows"))
    files = parts.select("name", F.transform("parts", lambda p: p["place"]).alias("places"), F.col("parts")[0]["headed"].alias("headed"), "rows")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = arrow_file_system(pending)
        system.create_dir(f"{root}/files", recursive=True)
        for batch in batches:
            for name, places, headed, count in zip(*(batch.column(c).to_pylist() for c in ("name", "places", "headed", "rows"))):
                unfinished, size = f"{root}/pieces/whole-{uuid.uuid4().hex}", 0
                with system.open_output_stream(unfinished) as out:
                    size += out.write(start) if start and not headed else 0
                    for i, place in enumerate(places):
                        size += out.write(glue) if i and glue else 0
                        with system.open_input_stream(f"{root}/{place}") as piece:
                            while block := piece.read(1 << 20):
                                size += out.write(block)
                    size += out.write(end) if end else 0
                system.move(unfinished, f"{root}/files/{name}")  # another attempt's file, if any, holds the same
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["name", "rows", "bytes"])

    joined = files.repartition("name").mapInArrow(join, "name string, rows long, bytes long")
    written = cut(made.filter("place is null").select("name", "rows", "bytes").unionByName(joined), "files")
    file_system(spark, f"{pending}/files")[0].mkdirs(file_system(spark, f"{pending}/files")[1])
    moved = rename_once(spark, f"{pending}/files", full)
    remove(spark, pending)
    if not moved:
        raise FileExistsError(path)
    return written


def write_markdown(questions: DataFrame, path: str, per_task: int = 5_000) -> DataFrame:
    """One Markdown file for each question, named by its id; the folder appears whole. Returns name, rows and bytes.

    Ids whose safe names are the same get a suffix of their hash; of repeated ids the texts follow each other.
    """
    segment = file_segment(F.col("id").cast("string"))
    plain = F.lower(segment) == F.col("id").cast("string")
    name = F.concat(F.when(plain, segment).otherwise(F.concat(segment, F.lit("-"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 8))), F.lit(".md"))
    return write_ordered(questions.select(name.alias("name"), question_markdown().alias("text")), path, ["text"], foot="\n", per_task=per_task)


def ledger(rows: DataFrame, path: str) -> None:
    """One JSON object to a line."""
    rows.write.mode("overwrite").json(path)


def markdown_table(rows: list[Row], names: list[str]) -> str:
    """A small result, already ordered and limited, as a Markdown table."""
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *("| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows)]
    return "\n".join(lines) + "\n"


def cluster_report(clusters: DataFrame, most: int = 200) -> str:
    """The largest clusters as a table; the limit is the report's."""
    return markdown_table(clusters.orderBy(F.desc("size"), "cluster").limit(most).collect(), ["cluster", "size", "similarity"])


def report(total: Row, categories: list[Row], causes: list[Row]) -> str:
    """A practice report from its small aggregates."""
    head = f"# Report\n\n{total['attempts']} attempts, {total['accuracy']} % right, {total['seconds'] // 60} minutes.\n"
    return "\n".join([head, "## By category\n", markdown_table(categories, ["category", "attempts", "accuracy", "mean_seconds"]), "## Causes of errors\n", markdown_table(causes, ["cause", "attempts"])])


def metrics_json(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)


def template_csv(pages: DataFrame, path: str) -> None:
    """An annotation template with a head, for spreadsheets."""
    pages.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


_MANIFEST = "name string, version int, rows long, checksum string, schema string"


def package(tables: dict[str, DataFrame], path: str, version: int = 1) -> None:
    """A folder with every table and a manifest of their rows and checksums. It appears whole, by one rename; FileExistsError
    if it is there already."""
    spark = next(iter(tables.values())).sparkSession
    fs, target = file_system(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    pending = f"{path.rstrip('/')}._pending-{uuid.uuid4().hex}"
    manifest = []
    for name, df in tables.items():
        df.write.parquet(f"{pending}/{name}")
        sums = checksums(spark.read.schema(df.schema).parquet(f"{pending}/{name}")).first()
        manifest.append((name, version, sums["rows"], sums["checksum"], df.schema.json()))
    spark.createDataFrame(manifest, _MANIFEST).coalesce(1).write.json(f"{pending}/manifest")
    if not rename_once(spark, pending, path.rstrip("/")):
        raise FileExistsError(path)


def read_package(spark, path: str) -> dict[str, DataFrame]:
    """The tables of a package; ValueError if any hasn't the contents that the manifest names."""
    out = {}
    for row in spark.read.schema(_MANIFEST).json(f"{path}/manifest").collect():
        table = spark.read.schema(T.StructType.fromJson(json.loads(row["schema"]))).parquet(f"{path}/{row['name']}")
        if tuple(checksums(table).first()) != (row["rows"], row["checksum"]):
            raise ValueError(f"{row['name']} has not the contents that the manifest names")
        out[row["name"]] = table
    return out
