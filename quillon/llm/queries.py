"""The registered queries of this subpackage, one for each operator, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import idfile, langid, licenses, mih, packing, periodic, pii, secretscan, simhash, spans, spelling, tokencounts, winnow
from quillon.llm.arrow import TOKENIZERS, tokenizer_path
from quillon.storage import cut, fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents come in uncounted, their counts are revised, and all copies of a text
    but the first go out."""
    counted = cut(tokencounts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZERS["byte"]), "byte_bpe_50k"), "counted")
    uncounted = counted.withColumn("n_tokens", F.lit(0).cast("long"))
    ledger = tokencounts.TokenLedger(spark, fresh_path(spark, "ledger"))
    ledger.commit("documents", tokencounts.signed(uncounted, 1))
    ledger.commit("counts", tokencounts.revised(uncounted, counted))
    ledger.commit("copies", tokencounts.copies_leaving(counted))
    ledger.compact()
    ledger.commit("documents", tokencounts.signed(uncounted, 1))  # a batch that comes again changes nothing
    return ledger.totals()


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs.filter(~langid.held_out(docs["doc_id"]))))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    return mih.nearest(table, table.filter(F.col("vec_id") % 20 == 0), k=20)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZERS["word"]))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.repeated_runs(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZERS["byte"]))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secretscan.find_secrets(docs, secretscan.train(docs))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.find_runs(_table(spark, sf_dir, "documents"), plant=True)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents"), plant=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_token_counts": op2_token_counts,
    "op3_language": op3_language,
    "op4_nearest": op4_nearest,
    "op5_licenses": op5_licenses,
    "op6_token_ids": op6_token_ids,
    "op7_decontaminate": op7_decontaminate,
    "op8_repeats": op8_repeats,
    "op9_simhash": op9_simhash,
    "op10_pack": op10_pack,
    "op11_secrets": op11_secrets,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling": op13_spelling,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w"

#: The other operators train, hash or encode in ways that SQL can't express; their tests hold them against brute force.
SQL: dict[str, str] = {
    "op7_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS} FROM documents), b AS (SELECT item_id, {_WORDS} FROM benchmark),
    bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
    dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
    h AS (SELECT dw.doc_id, dw.n, i, item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.k = dw.k),
    c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
    t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS s FROM h GROUP BY 1)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
}
