from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from quillon.llm import tokencounts
from quillon.llm.arrow import tokenizer_path
from quillon.storage import fresh_path

PATH = tokenizer_path("byte_bpe_50k.json")


def brute(rows):
    tokenizer = Tokenizer.from_file(PATH)
    out = defaultdict(lambda: [0, 0])
    for r in rows:
        n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)
        for i, x in enumerate((1, n)):
            out[r["source"], r["lang"], "v1"][i] += x
    return {k: tuple(v) for k, v in out.items()}


def totals(ledger):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()}


def test_batches(spark, documents, odd, none):
    for docs in (documents, odd):
        counted = tokencounts.count_tokens(docs, PATH, "v1").cache()
        ledger = tokencounts.TokenLedger(spark, fresh_path(spark, "test-ledger"))
        assert totals(ledger) == {}
        assert ledger.commit("a", tokencounts.signed(counted, 1)) and not ledger.commit("a", tokencounts.signed(counted, 1))
        rows = docs.collect()
        assert totals(ledger) == brute(rows)
        ledger.commit("b", tokencounts.copies_leaving(counted))
        first = {}
        for r in sorted((r for r in rows), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
            first.setdefault(r["text"], r)
        got = totals(ledger)
        assert sum(n for n, _ in got.values()) == len(first)
        assert sum(n for _, n in got.values()) == sum(n for _, n in brute(first.values()).values())
        # A revised count: out with the old, in with the new.
        ledger.commit("c", tokencounts.signed(counted.limit(1), -1).unionByName(tokencounts.signed(counted.limit(1).selectExpr("*").withColumn("n_tokens", counted["n_tokens"] + 5), 1)))
        assert sum(n for _, n in totals(ledger).values()) == sum(n for _, n in got.values()) + 5
        before = totals(ledger)
        assert ledger.compact() and totals(ledger) == before
        assert ledger.batches() == ["a", "b", "c"] and not ledger.commit("a", tokencounts.signed(counted, 1)) and totals(ledger) == before
        # Out with everything: groups that hold nothing are left out.
        ledger.commit("d", counted.sparkSession.createDataFrame([(*k, -n, t // n if n else t) for k, (n, t) in before.items() if n and t % n == 0], "source string, lang string, tokenizer string, sign long, n_tokens long"))
        assert totals(ledger) == {k: v for k, v in before.items() if v[1] % v[0]}
    assert tokencounts.count_tokens(none, PATH, "v1").count() == 0
    empty = tokencounts.count_tokens(none, PATH, "v1")
    assert ledger.commit("none", tokencounts.signed(empty, 1)) and ledger.commit("none2", tokencounts.copies_leaving(empty))


def test_an_empty_ledger_and_bad_ids(spark, none):
    ledger = tokencounts.TokenLedger(spark, fresh_path(spark, "test-ledger"))
    assert totals(ledger) == {} and ledger.compact() and totals(ledger) == {} and ledger.batches() == []
    for bad in ("", "../x", "a/b", "_x", "a b"):
        with pytest.raises(ValueError):
            ledger.commit(bad, none)


@pytest.mark.parametrize("step", ["before the switch", "after the switch", "while deleting"])
def test_a_compaction_that_breaks_off(spark, documents, step, monkeypatch):
    rows = spark.createDataFrame([("s", "en", "v", 3), ("s", None, "v", None), ("t", "en", "v", 9)], "source string, lang string, tokenizer string, n_tokens long")
    ledger = tokencounts.TokenLedger(spark, fresh_path(spark, "test-ledger"))
    for name in "abc":
        ledger.commit(name, tokencounts.signed(rows, 1))
    before = totals(ledger)
    assert before["s", None, "v"] == (3, 0)

    class Broken(Exception):
        pass

    def broken(*_):
        raise Broken

    with monkeypatch.context() as m:
        if step == "before the switch":
            m.setattr(ledger, "_publish", broken)
        elif step == "after the switch":
            m.setattr(ledger, "tidy", broken)
        else:
            m.setattr(tokencounts, "remove", broken)
        with pytest.raises(Broken):
            ledger.compact()
    assert totals(ledger) == before and ledger.batches() == ["a", "b", "c"]
    assert not ledger.commit("b", tokencounts.signed(rows, 1)) and totals(ledger) == before
    assert ledger.compact() and totals(ledger) == before
    assert ledger._names("batch") == [] and len(ledger._names("sum")) == 1
    # A second writer of the same name loses.
    pending = ledger._pending()
    tokencounts.signed(rows, 1).write.parquet(pending)
    assert not ledger._publish(pending, "sum=" + ledger._names("sum")[0]) and totals(ledger) == before


def test_a_batch_that_comes_in_while_others_are_summed(spark, tmp_path, monkeypatch):
    """It is in neither the sum nor the ids of that sum, and counts by itself."""
    row = lambda n: tokencounts.signed(spark.createDataFrame([("s", "en", "t", n)], "source string, lang string, tokenizer string, n_tokens long"), 1)
    ledger = tokencounts.TokenLedger(spark, str(tmp_path / "l"))
    assert ledger.commit("a", row(3)) and ledger.compact() and ledger.commit("b", row(5))
    pending = ledger._pending

    def late():
        monkeypatch.undo()
        assert ledger.commit("c", row(7))
        return pending()

    monkeypatch.setattr(ledger, "_pending", late)
    assert ledger.compact()
    assert [tuple(r) for r in ledger.totals().select("n_docs", "n_tokens").collect()] == [(3, 15)]
    assert ledger._names("batch") == ["c"] and ledger.batches() == ["a", "b", "c"]
    for b in "abc":
        assert not ledger.commit(b, row(1))
    assert ledger.compact() and ledger.batches() == ["a", "b", "c"] and [r["n_tokens"] for r in ledger.totals().collect()] == [15]
