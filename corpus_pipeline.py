"""Documents to packed training sequences: the stages, their order, and one run of them all.

Rows with a null or empty text, or one without a letter, go in the first stage. Null ids, repeated rows, null columns and
columns that the operators name as well are kept as they are by all stages but the last; very long texts are read whole;
an empty table gives an empty one with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import langid, packing, pii, simhash, winnow
from quillon.llm.arrow import TOKENIZERS, tokenizer_path
from quillon.storage import cut


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is known; null texts and those without any letter go, and all do if no row that may
    be learned from has a language."""
    return langid.keep_identified(docs, langid.train(docs.filter(~langid.held_out(docs["doc_id"]))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest doc_id, of each group of near copies; rows that repeat id and text are
    one document, and rows without an id stay only where their group has none with one."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more stands in benchmark items; null texts hold none."""
    return winnow.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; keeps every document, null texts as they are."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences of 2,048 tokens; a null text has its end's token alone."""
    return packing.pack(docs, tokenizer_path(TOKENIZERS["byte"]))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: The stages hash, learn and search in ways that SQL can't express; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
