import corpus_pipeline
from quillon.llm import langid, pii, simhash
from quillon.storage import cut

from .conftest import SF
from .test_packing import check_packed
from .test_simhash import components
from .test_winnow import brute as contaminated


def test_each_stage_on_what_the_one_before_kept(spark, documents, benchmark, groups):
    functions = dict(corpus_pipeline.STAGES)
    assert list(functions) == ["language", "near_duplicates", "decontamination", "personal_data", "packing"]
    rows = {r["doc_id"]: r for r in documents.collect()}

    kept = cut(functions["language"](spark, documents, SF), "t1")
    assert kept.columns == documents.columns
    want = {d for d, r in rows.items() if len(langid.ngrams(r["text"]))}
    assert {r[0] for r in kept.select("doc_id").collect()} == want

    kept = cut(functions["near_duplicates"](spark, kept, SF), "t2")
    ids = sorted(want)
    first = {}
    for d, g in zip(ids, components([simhash.fingerprint_of(rows[d]["text"]) for d in ids], 4, groups)):
        first.setdefault(g, d)
    want = set(first.values())
    assert kept.columns == documents.columns and {r[0] for r in kept.select("doc_id").collect()} == want

    kept = cut(functions["decontamination"](spark, kept, SF), "t3")
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    want -= {r[0] for r in contaminated([(d, rows[d]["text"]) for d in sorted(want)], items) if r[5]}
    assert kept.columns == documents.columns and {r[0] for r in kept.select("doc_id").collect()} == want

    kept = cut(functions["personal_data"](spark, kept, SF), "t4")
    got = {r["doc_id"]: r for r in kept.collect()}
    assert kept.columns == documents.columns and set(got) == want
    for d, r in got.items():
        assert r["text"] == pii.redacted(rows[d]["text"]) and r["n_chars"] == len(r["text"])
        base, _ = pii.finder().spans(r["text"])
        assert base == []

    check_packed(kept, functions["packing"](spark, kept, SF), 2048)
    assert corpus_pipeline.ORACLE_SQL is None


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 500 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)


def test_each_stage_on_odd_rows_and_on_none(spark, odd, none):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing columns; and no rows at all."""
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, SF)
            assert kept.schema.simpleString() == docs.schema.simpleString(), name
            rows = kept.collect()
            assert len(rows) <= docs.count() and not (docs is none and rows)
            if name == "personal_data":
                assert len(rows) == docs.count()
            if name == "language":
                assert {r["doc_id"] for r in rows} <= {1, 2, 3, 8, 9, 10, None} and all(r["text"] for r in rows)
            if name == "near_duplicates" and docs is odd:
                # Rows 1, 1 and 2 have one text; a repeated row is one document. Null and blank texts are near each other.
                assert sorted(r["doc_id"] for r in rows if r["doc_id"] in (1, 2)) == [1, 1]
                assert [r["doc_id"] for r in rows if r["doc_id"] in (4, 5, 6)] == [4]
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert (packed.count() > 0) == (docs is odd)


def test_run_on_odd_rows_and_on_none(spark, odd, none, benchmark, tmp_path):
    for name, docs in (("odd", odd), ("none", none)):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        benchmark.write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert {r["doc_id"] for r in out.collect()} >= ({1, 8} if name == "odd" else set())
        assert name == "odd" or out.count() == 0
