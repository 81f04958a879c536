import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import idfile, jvmcoder
from quillon.llm.arrow import tokenizer_path
from quillon.llm.pretokens import WordEncoder
from quillon.storage import fresh_path

PATH = tokenizer_path("word_bpe_49k.json")
_PIECES = ["a", "b", "S", "s", "'s", "'", "'re", "'LL", " ", "  ", "\n", "\t", "1", "23", "!", "?", "é", "É", "’", "|", "re", "ve", "ll", "d", "İ", "中", "́", "<|endoftext|>", " ", " ", "ſ", "ŉ"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_library_s(name):
    mine, library = WordEncoder(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(_PIECES), max_size=12).map("".join) | st.text(max_size=12), max_size=6))
    def check(texts):
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in mine.encode(texts)] == want

    check()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**20) | st.integers(0, 3), max_size=60), max_size=5))
def test_payload_round_trip(documents):
    ids = [np.array(d, np.uint32) for d in documents]
    names = [None if i % 3 == 2 else i * 7 - 3 for i in range(len(ids))]
    got_names, got = idfile.from_payload(idfile.to_payload(names, ids))
    assert got_names == names and [g.tolist() for g in got] == documents


def test_long_round_trip_and_damage(rng):
    ids = np.concatenate((rng.integers(0, 49_408, 3000), np.tile(rng.integers(0, 49_408, 500), 20), np.zeros(2000, int))).astype(np.uint32)
    payload = idfile.to_payload([1], [ids])
    assert len(payload) < 2 * len(ids) and np.array_equal(idfile.from_payload(payload)[1][0], ids)
    with pytest.raises(ValueError):
        idfile.from_payload(payload[:100] + bytes([payload[100] ^ 1]) + payload[101:])


def _check(docs, got):
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted(((r["doc_id"], np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1])))
    rows = sorted(got.collect(), key=lambda r: r["start"])
    assert len(rows) == len(want)
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in rows] == [d for d, _ in want]
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=key) == sorted(((d, len(i), zlib.crc32(i.tobytes())) for d, i in want), key=key)


def test_files(documents, odd, none):
    _check(documents, idfile.round_trip(documents, PATH))
    _check(odd, idfile.round_trip(odd, PATH))
    assert idfile.round_trip(none, PATH).count() == 0


def test_the_executors_coder_makes_the_same_bytes(spark, rng):
    repeated = np.concatenate((rng.integers(0, 49_408, 3000), np.tile(rng.integers(0, 49_408, 500), 20), np.zeros(2000, int)))
    cases = [[], [[]], [[1]], [rng.integers(0, 49_408, 5000), [], [7, 7]], [repeated, [3] * 100], [rng.integers(0, 2**25 - 1, 9000)], [rng.zipf(1.3, 40_000).clip(0, 49_407)]]
    cases = [[np.array(d, np.uint32) for d in c] for c in cases]
    rows, want = [], []
    for n, c in enumerate(cases):
        names = [None if i % 2 else i * 7 - 3 for i in range(len(c))]
        ids = np.concatenate(c) if c else np.zeros(0, np.uint32)
        rows.append((n, bytearray(idfile.head(names, c, ids)), bytearray(ids.astype("<u4").tobytes()), idfile.BLOCK))
        want.append((names, idfile.to_payload(names, c)))
    made = spark.createDataFrame(rows, "n int, head binary, raw binary, length int").select("n", jvmcoder.encoded(spark, "head", "raw", "length").alias("payload"))
    assert [bytes(r["payload"]) for r in made.orderBy("n").collect()] == [w for _, w in want]
    for r, (names, _), c in zip(made.select("n", jvmcoder.decoded(spark, "payload", True).alias("docs")).orderBy("n").collect(), want, cases):
        assert [d["doc_id"] for d in r["docs"]] == names
        assert [bytes(d["ids"]) for d in r["docs"]] == [d.astype("<u4").tobytes() for d in c]


def test_the_executors_coder_finds_damage(spark):
    whole = idfile.to_payload([1], [np.arange(3000, dtype=np.uint32)])
    for bad in (b"", whole[:30], whole[:100] + bytes([whole[100] ^ 1]) + whole[101:]):
        with pytest.raises(Exception, match="damaged"):
            spark.createDataFrame([(bytearray(bad),)], "payload binary").select(jvmcoder.decoded(spark, "payload", False)).collect()


def test_ids_read_back(spark, odd):
    path = fresh_path(spark, "ids")
    idfile.write_ids(odd, path, PATH)
    for r in idfile.read_ids(spark, path, with_ids=True).collect():
        assert len(r["ids"]) == 4 * r["n_tokens"] and zlib.crc32(r["ids"]) == r["ids_crc32"] and bytes(r["ids"][-4:]) == b"\1\0\0\0"


def test_size_against_order_0(spark, documents):
    tokenizer = Tokenizer.from_file(PATH)
    ids = np.array([i for r in documents.orderBy("doc_id").limit(300).collect() for i in tokenizer.encode(r["text"] or "", add_special_tokens=False).ids], np.uint32)
    _, counts = np.unique(ids, return_counts=True)
    entropy = -(counts * np.log2(counts / len(ids))).sum() / 8
    whole = spark.createDataFrame([(bytearray(idfile.head([1], [ids], ids)), bytearray(ids.astype("<u4").tobytes()), idfile.BLOCK)], "head binary, raw binary, length int")
    size = whole.select(F.octet_length(jvmcoder.encoded(spark, "head", "raw", "length"))).first()[0]
    # Order 0's share knows all counts in advance, and every block starts from nothing.
    assert size < 1.05 * entropy


def test_each_order_predicts():
    # After (1, 2) comes 3 and after (9, 2) comes 4, so order 1 is often wrong and order 2 right; and order 1's guess
    # helps where order 2's is wrong.
    turns = np.random.default_rng(1).integers(0, 2, 4000)
    ids = np.concatenate([[1, 2, 3] if t else [9, 2, 4] for t in turns]).astype(np.uint32)
    assert len(idfile.to_payload([1], [ids])) < 0.2 * len(ids)
