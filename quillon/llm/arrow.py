"""Small helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}

_ROWS, _BYTES = 256, 4 << 20
_KEPT: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]):
    """What ``make`` returns, made once and kept by this Python process until it keeps something else.

    Spark uses a worker for one stage after another; tables, automata and caches of an earlier one are let go here.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """The encoder of a tokenizer file."""
    from quillon.llm.pretokens import WordEncoder

    return kept(("encoder", path), lambda: WordEncoder(path))


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only what the operators read; further columns of the input can't clash with theirs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def cuts(texts: pa.Array, rows: int = _ROWS) -> Iterator[tuple[int, int]]:
    """First and past-the-last rows of parts with at most ``rows`` texts and, beyond one text, about 4 MB."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    first = held = 0
    for i, size in enumerate(sizes):
        if i > first and (i - first == rows or held + size > _BYTES):
            yield first, i
            first, held = i, 0
        held += size
    if sizes:
        yield first, len(sizes)


def parts(batch: pa.RecordBatch, rows: int = _ROWS) -> Iterator[pa.RecordBatch]:
    """A batch in such parts: what an operator holds besides the batch doesn't depend on Spark's batch size."""
    for first, stop in cuts(batch.column("text"), rows):
        yield batch.slice(first, stop - first)


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, list]], schema: str, rows: int = _ROWS) -> DataFrame:
    """``make`` turns each part of a batch, which has a column text, into columns of ``schema``."""
    target = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, rows):
                columns = make(part)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def text_column(text: Column, make: Callable[[list[str | None]], list], kind: str) -> Column:
    """A column of type ``kind`` (DDL) that ``make`` works out from the texts, part by part."""
    target = _arrow_schema(f"x {kind}").field(0).type

    @F.arrow_udf(kind)
    def apply(texts: pa.Array) -> pa.Array:
        found = [pa.array(make(texts.slice(a, b - a).to_pylist()), target) for a, b in cuts(texts)]
        return pa.concat_arrays(found) if found else pa.array([], target)

    return apply(text)


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))
