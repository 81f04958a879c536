"""Parsers as table functions of SQL: ``SELECT * FROM quillon_questions(TABLE(lines))``.

Each takes a table of lines (doc, line_no, line), of documents with their lines (doc, lines) or, for chunks, of texts (doc,
text). The functions themselves say that a document's lines go together and in what order, so a call needs no PARTITION BY.
Documents with their lines are rows already: they are neither shuffled nor sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quillon.sources import parsers


def _analyzed(table: AnalyzeArgument, needed: tuple[str, ...], schema: StructType, **more) -> AnalyzeResult:
    if not table.isTable:
        raise ValueError("the argument is a table: TABLE(name) or TABLE(SELECT ...)")
    names = [f.name for f in table.dataType]
    if missing := [n for n in needed if n not in names]:
        raise ValueError(f"the table has no {missing}; it needs {list(needed)}")
    return AnalyzeResult(StructType([StructField("doc", table.dataType["doc"].dataType), *schema]), **more)


def _of_lines(parser: Callable[..., Iterator[dict]]):
    """A table function that calls a parser once for each document, with its lines in order; null lines are none.

    A table that has ``lines`` has a row for each document.
    """
    schema = StructType.fromDDL(parsers.SCHEMAS[parser])
    names = schema.names

    class Lines:
        def __init__(self):
            self.doc, self.lines = None, []

        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            if table.isTable and "lines" in [f.name for f in table.dataType]:
                return _analyzed(table, ("doc", "lines"), schema)
            return _analyzed(table, ("doc", "line_no", "line"), schema, partitionBy=[PartitioningColumn("doc")], orderBy=[OrderingColumn("line_no")])

        def eval(self, row: Row) -> Iterator[tuple]:
            if "lines" in row.__fields__:
                for found in parser([x for x in row["lines"] or [] if x is not None]):
                    yield (row["doc"], *(found[n] for n in names))
                return
            self.doc = row["doc"]
            if row["line"] is not None:
                self.lines.append(row["line"])

        def terminate(self) -> Iterator[tuple]:
            for found in parser(self.lines):
                yield (self.doc, *(found[n] for n in names))

    return Lines


_CHUNK = StructType([StructField("chunk_no", IntegerType()), StructField("chunk", StringType())])


class Chunks:
    """``parsers.chunks`` of each text."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _analyzed(table, ("doc", "text"), _CHUNK)

    def eval(self, row: Row) -> Iterator[tuple]:
        for c in parsers.chunks(row["text"]):
            yield row["doc"], c["chunk_no"], c["chunk"]


#: Name and parser of each function of lines.
PARSERS = {
    "quillon_questions": parsers.question_book,
    "quillon_solutions": parsers.solution_book,
    "quillon_grouped_answers": parsers.grouped_answers,
    "quillon_essays": parsers.essay_book,
    "quillon_essay_documents": parsers.essay_documents,
    "quillon_essay_tasks": parsers.essay_tasks,
    "quillon_anchored_questions": parsers.anchored_questions,
    "quillon_solution_pages": parsers.solution_pages,
    "quillon_page_numbers": parsers.page_numbers,
}


def register(spark: SparkSession) -> list[str]:
    """Register the functions with a session; their names."""
    for name, parser in PARSERS.items():
        spark.udtf.register(name, udtf(_of_lines(parser)))
    spark.udtf.register("quillon_chunks", udtf(Chunks))
    return [*PARSERS, "quillon_chunks"]
