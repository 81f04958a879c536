"""Token ids in a compact binary format: a context-mixing range coder over independent, checksummed blocks.

Ids are cut into blocks that each start from a fresh model, so any block can be decoded alone. Each order predicts an id.
Where the two ids before it (order 2), or the one before it (order 1), have been followed by some id, that id is the
guess, and whether it is right is coded with a probability mixed from both orders' records and the hit rate so far; the
mixer's weights learn as it goes. If order 2 guessed wrong and order 1 has another guess, that one's turn is next. What
neither guessed is coded by order 0, four bits at a time, under adaptive counts for each beginning of an id. All
arithmetic is on whole numbers: files decode alike everywhere.

The executors' JVMs code and decode (``jvmcoder``). The same coder in numpy, which takes many blocks in step with each
other, one id of each at a time, reads and writes single payloads without Spark; a test holds their bytes equal.

Layout of a payload (little-endian): magic ``QID2``; u32 documents, u32 block length, u64 ids, u8 digits per id, u8 0;
per document i64 doc_id, u8 whether it is null, u64 ids; per block u32 ids, u32 coded bytes, u32 crc32 of its ids; the
blocks' bytes. The end holds the crc32 of all before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import jvmcoder
from quillon.llm.arrow import _arrow_schema, encoder, id_and_text, parts
from quillon.storage import fresh_path

MAGIC = b"QID2"
#: Ids of a block: long enough to learn from, and little to lose where one is damaged.
BLOCK = 16_384
_HEAD = struct.Struct("<4sIIQBB")
_SEGMENTS = "file_no int, segment int, documents long, ids long, head binary, raw binary, length int"
_SLOTS = 1024
_FULL = 1 << 48
_LOW = 1 << 32
_ONE = 14
_NODES = 4096
_RATES = np.array([6, 6, 5, 3, 3, 3, 3, 3], np.int16)

_STRETCH: np.ndarray | None = None
_SQUASH: np.ndarray | None = None
_TARGETS = np.array([[i if i <= s else (1 << _ONE) - 16 + i for i in range(17)] for s in range(16)], np.int16)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """ln(p / (1 - p)) of 12-bit probabilities, in 256ths, and its inverse; made of whole numbers only at the end."""
    global _STRETCH, _SQUASH
    if _STRETCH is None:
        x = np.arange(-2047, 2048)
        _SQUASH = np.clip(np.round(4096 / (1 + np.exp(-x / 256.0))), 1, 4095).astype(np.int64)
        p = (np.arange(4096) + 0.5) / 4096
        _STRETCH = np.clip(np.round(np.log(p / (1 - p)) * 256), -2047, 2047).astype(np.int64)
    return _STRETCH, _SQUASH


class _Lanes:
    """The models of many blocks in step."""

    def __init__(self, lanes: int, digits: int):
        self.lanes, self.digits = lanes, digits
        self.stretch, self.squash = _tables()
        self.rows = np.arange(lanes)
        self.range = np.full(lanes, _FULL - 1, np.int64)
        self.before1 = np.zeros(lanes, np.int64)
        self.before2 = np.zeros(lanes, np.int64)
        # What followed a context, and in the low five bits how sure that is; orders 2 and 1 one after the other.
        self.guess = np.zeros(2 * lanes * _SLOTS, np.int32)
        # Records of 16-bit hit probabilities: by order 2's and order 1's sureness and agreement, and of all guesses.
        self.hit = np.full(3 * lanes * 64, 1 << 15, np.int64)
        self.weights = np.full((3, lanes), 1 << 15, np.int64)
        # Order 1's hit probabilities after order 2 was wrong, by order 1's sureness.
        self.again = np.full((lanes, 32), 1 << 15, np.int64)
        self.of_order = np.array([[0], [lanes * _SLOTS]]) + self.rows * _SLOTS
        self.of_record = np.array([[0], [lanes * 64], [2 * lanes * 64]]) + self.rows * 64
        # Order-0 counts: for each place the nodes of the digits before it, hashed where they are many.
        self.nodes = [min(16**d, _NODES) for d in range(digits)]
        self.first = np.cumsum([0, *self.nodes])
        self.counts = np.tile((np.arange(17) << (_ONE - 4)).astype(np.int16), (lanes * int(self.first[-1]), 1))

    def guesses(self, n: int) -> tuple:
        """For the first n lanes: slots and what they hold, the guess and the next one (or -1), the guess's mixed
        probability and what was mixed."""
        b1 = self.before1[:n]
        slots = self.of_order[:, :n].copy()
        slots[0] += (b1 * 0x9E3B + self.before2[:n] * 0x85EB) >> 3 & (_SLOTS - 1)
        slots[1] += b1 * 0x9E37 >> 2 & (_SLOTS - 1)
        held = self.guess[slots].astype(np.int64)
        sure = held & 31
        ids = (held >> 5) - 1
        guess = np.where(sure[0] > 0, ids[0], ids[1])
        second = np.where(ids[1] == guess, -1, ids[1])
        place = self.of_record[:, :n].copy()
        place[:2] += 2 * sure + (ids[0] == ids[1])
        p = self.hit[place]
        st = self.stretch[p >> 4]
        dot = (self.weights[:, :n] * st).sum(axis=0) >> 16
        np.minimum(dot, 2047, out=dot)
        np.maximum(dot, -2047, out=dot)
        return slots, sure, ids, guess, second, place, p, st, self.squash[dot + 2047]

    def learn_hit(self, at: np.ndarray, hit: np.ndarray, place: np.ndarray, p: np.ndarray, st: np.ndarray, mixed: np.ndarray) -> None:
        """Adjust records and weights of lanes ``at``, whose guesses were right or not."""
        one = hit.astype(np.int64)
        was = p[:, at]
        # Shifts keep a record between 16 and 65,519, so it never reaches a sure 0 or 1.
        self.hit[place[:, at]] = was + ((one * 65519 + (1 - one) * 16 - was) >> 4)
        self.weights[:, at] += (st[:, at] * ((one << 12) - mixed[at]) * 6) >> 10

    def second_chance(self, at: np.ndarray, sure: np.ndarray) -> np.ndarray:
        return np.clip(self.again[at, sure[1, at]] >> 4, 1, 4095)

    def learn_second(self, at: np.ndarray, hit: np.ndarray, sure: np.ndarray) -> None:
        one = hit.astype(np.int64)
        was = self.again[at, sure[1, at]]
        self.again[at, sure[1, at]] = was + ((one * 65519 + (1 - one) * 16 - was) >> 4)

    def learn_id(self, n: int, x: np.ndarray, slots: np.ndarray, sure: np.ndarray, ids: np.ndarray) -> None:
        right = ids == x
        fresh = ~right & (sure <= 1)
        kept = np.where(right, np.minimum(sure + 1, 31), sure >> 1)
        self.guess[slots] = np.where(fresh, ((x + 1) << 5) | 1, ((ids + 1) << 5) | kept)
        self.before2[:n] = self.before1[:n]
        self.before1[:n] = x

    def node(self, digit: int, at: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        own = prefix if self.nodes[digit] == 16**digit else (prefix * 37 + (prefix >> 8)) & (_NODES - 1)
        return at * int(self.first[-1]) + (own + int(self.first[digit]))


class _Writer(_Lanes):
    def __init__(self, lanes: int, digits: int, length: int):
        super().__init__(lanes, digits)
        self.low = np.zeros(lanes, np.int64)
        # The first unit only takes a carry. No step takes more than 14 bits.
        self.out = np.zeros((lanes, length * (digits + 2) + 8), np.uint16)
        self.place = np.ones(lanes, np.int64)

    def put(self, at: np.ndarray, start: np.ndarray, size: np.ndarray, bits: int) -> None:
        """Code for lanes ``at`` the part [start, start + size) of 2^bits."""
        step = self.range[at] >> bits
        self.low[at] += start * step
        span = size * step
        self.range[at] = span
        go = at[span < _LOW]
        while len(go):
            self._emit(go)
            self.range[go] <<= 16
            go = go[self.range[go] < _LOW]

    def _emit(self, lane: np.ndarray) -> None:
        low, place = self.low[lane], self.place[lane]
        over = low >= _FULL
        if over.any():
            carry, back = lane[over], place[over] - 1
            while len(carry):  # a carry runs on through units that are full
                self.out[carry, back] += 1
                on = self.out[carry, back] == 0
                carry, back = carry[on], back[on] - 1
        self.out[lane, place] = (low >> 32) & 0xFFFF
        self.place[lane] = place + 1
        self.low[lane] = (low & (_LOW - 1)) << 16

    def finish(self) -> list[bytes]:
        for _ in range(3):
            self._emit(self.rows)
        return [self.out[i, :n].astype("<u2").tobytes() for i, n in enumerate(self.place.tolist())]


class _Reader(_Lanes):
    def __init__(self, blocks: list[bytes], digits: int):
        super().__init__(len(blocks), digits)
        size = max(map(len, blocks)) // 2 + 4
        self.data = np.zeros((len(blocks), size), np.uint16)
        for i, b in enumerate(blocks):
            self.data[i, : len(b) // 2] = np.frombuffer(b, "<u2")
        first = self.data[:, :4].astype(np.int64)
        # What is left of the number above the interval's start; the first unit held the carry alone.
        self.code = (first[:, 0] << 48) | (first[:, 1] << 32) | (first[:, 2] << 16) | first[:, 3]
        self.place = np.full(len(blocks), 4, np.int64)

    def peek(self, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        step = self.range[at] >> bits
        return np.minimum(self.code[at] // step, (1 << bits) - 1), step

    def take(self, at: np.ndarray, start: np.ndarray, size: np.ndarray, step: np.ndarray) -> None:
        self.code[at] -= start * step
        span = size * step
        self.range[at] = span
        go = at[span < _LOW]
        while len(go):
            place = self.place[go]
            self.code[go] = (self.code[go] << 16) | self.data[go, np.minimum(place, self.data.shape[1] - 1)]
            self.place[go] = place + 1
            self.range[go] <<= 16
            go = go[self.range[go] < _LOW]


def _digits(ids: np.ndarray) -> int:
    top = int(ids.max()) if len(ids) else 0
    return max(1, -(-top.bit_length() // 4))


def encode_blocks(ids: np.ndarray, length: int, digits: int) -> list[bytes]:
    """Code ids in blocks of ``length`` (the last may be shorter)."""
    lanes = -(-len(ids) // length)
    if not lanes:
        return []
    table = np.zeros((lanes, length), np.uint32)
    table.reshape(-1)[: len(ids)] = ids
    table = np.ascontiguousarray(table.T)
    short = len(ids) - (lanes - 1) * length
    w = _Writer(lanes, digits, length)
    for t in range(length):
        n = lanes if t < short else lanes - 1
        if not n:
            break
        x = table[t, :n].astype(np.int64)
        slots, sure, held, guess, second, place, p, st, mixed = w.guesses(n)
        hit = x == guess
        has = np.flatnonzero(guess >= 0)
        if len(has):
            h, m = hit[has], mixed[has]
            w.put(has, np.where(h, 0, m), np.where(h, m, 4096 - m), 12)
            w.learn_hit(has, h, place, p, st, mixed)
        also = np.flatnonzero(~hit & (second >= 0))
        if len(also):
            h, chance = x[also] == second[also], w.second_chance(also, sure)
            w.put(also, np.where(h, 0, chance), np.where(h, chance, 4096 - chance), 12)
            w.learn_second(also, h, sure)
            hit[also] = h
        at = np.flatnonzero(~hit)
        if len(at):
            # All digits are known here, and no two share a node: their counts are read and adjusted together.
            v = x[at]
            digit = np.stack([(v >> 4 * (digits - 1 - d)) & 15 for d in range(digits)])
            node = np.stack([w.node(d, at, v >> 4 * (digits - d)) for d in range(digits)])
            counts = w.counts[node]
            start = np.take_along_axis(counts, digit[:, :, None], axis=2)[:, :, 0].astype(np.int64)
            stop = np.take_along_axis(counts, digit[:, :, None] + 1, axis=2)[:, :, 0]
            w.counts[node] = counts + ((_TARGETS[digit] - counts) >> _RATES[:digits, None, None])
            for d in range(digits):
                w.put(at, start[d], stop[d] - start[d], _ONE)
        w.learn_id(n, x, slots, sure, held)
    return w.finish()


def decode_blocks(blocks: list[bytes], sizes: list[int], digits: int) -> np.ndarray:
    """The ids of blocks of which only the last may be shorter than the others."""
    if not blocks:
        return np.zeros(0, np.uint32)
    lanes, length, short = len(blocks), max(sizes), sizes[-1]
    table = np.zeros((length, lanes), np.uint32)
    r = _Reader(blocks, digits)
    for t in range(length):
        n = lanes if t < short else lanes - 1
        slots, sure, held, guess, second, place, p, st, mixed = r.guesses(n)
        x = guess.copy()
        has = np.flatnonzero(guess >= 0)
        miss = guess < 0
        if len(has):
            m = mixed[has]
            value, step = r.peek(has, 12)
            h = value < m
            r.take(has, np.where(h, 0, m), np.where(h, m, 4096 - m), step)
            r.learn_hit(has, h, place, p, st, mixed)
            miss[has] = ~h
        also = np.flatnonzero(miss & (second >= 0))
        if len(also):
            chance = r.second_chance(also, sure)
            value, step = r.peek(also, 12)
            h = value < chance
            r.take(also, np.where(h, 0, chance), np.where(h, chance, 4096 - chance), step)
            r.learn_second(also, h, sure)
            x[also[h]] = second[also[h]]
            miss[also] = ~h
        at = np.flatnonzero(miss)
        if len(at):
            v = np.zeros(len(at), np.int64)
            k = np.arange(len(at))
            for d in range(digits):
                node = r.node(d, at, v)
                counts = r.counts[node]
                value, step = r.peek(at, _ONE)
                digit = (counts[:, 1:16] <= value.astype(np.int16)[:, None]).sum(axis=1)
                start = counts[k, digit].astype(np.int64)
                r.take(at, start, counts[k, digit + 1] - start, step)
                r.counts[node] = counts + ((_TARGETS[digit] - counts) >> _RATES[d])
                v = v * 16 + digit
            x[at] = v
        table[t, :n] = x
        r.learn_id(n, x, slots, sure, held)
    return np.ascontiguousarray(table.T).reshape(-1)[: (lanes - 1) * length + short]


def head(doc_ids: list[int | None], documents: list[np.ndarray], ids: np.ndarray, block: int = BLOCK) -> bytes:
    """What stands before the blocks' heads."""
    if len(ids) and int(ids.max()) >= 1 << 25:
        raise ValueError("ids of 2^25 and more are not provided for")
    out = [_HEAD.pack(MAGIC, len(documents), block, len(ids), _digits(ids), 0)]
    out.append(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    out.append(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    out.append(np.array([len(d) for d in documents], "<u8").tobytes())
    return b"".join(out)


def to_payload(doc_ids: list[int | None], documents: list[np.ndarray], block: int = BLOCK) -> bytes:
    """Documents' ids as one payload, coded here; ``write_ids`` has the executors' JVMs make the same bytes."""
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    coded = encode_blocks(ids, block, _digits(ids))
    out = [head(doc_ids, documents, ids, block)]
    raw = ids.astype("<u4")
    for i, b in enumerate(coded):
        part = raw[i * block : (i + 1) * block]
        out.append(struct.pack("<III", len(part), len(b), zlib.crc32(part.tobytes())))
    out += coded
    whole = b"".join(out)
    return whole + struct.pack("<I", zlib.crc32(whole))


def from_payload(payload: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """The doc_ids and ids of a payload; ValueError if a checksum is wrong."""
    if len(payload) < _HEAD.size + 4 or zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("the payload is damaged")
    magic, n, length, total, digits, _ = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not an id file")
    at = _HEAD.size
    doc_ids = np.frombuffer(payload, "<i8", n, at)
    nulls = np.frombuffer(payload, np.uint8, n, at + 8 * n)
    sizes = np.frombuffer(payload, "<u8", n, at + 9 * n).astype(np.int64)
    at += 17 * n
    lanes = -(-total // length)
    heads = np.frombuffer(payload, "<u4", 3 * lanes, at).reshape(-1, 3).astype(np.int64)
    at += 12 * lanes
    ends = at + np.cumsum(heads[:, 1])
    blocks = [payload[e - s : e] for e, s in zip(ends.tolist(), heads[:, 1].tolist())]
    ids = decode_blocks(blocks, heads[:, 0].tolist(), digits)
    raw = ids.astype("<u4")
    for i, crc in enumerate(heads[:, 2].tolist()):
        if zlib.crc32(raw[i * length : (i + 1) * length].tobytes()) != crc:
            raise ValueError(f"block {i} is damaged")
    edges = np.concatenate(([0], np.cumsum(sizes))).tolist()
    return [None if z else int(d) for d, z in zip(doc_ids, nulls)], [ids[a:b] for a, b in zip(edges[:-1], edges[1:])]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, segment: int = 4_000_000) -> None:
    """Encode whole texts (null: empty), end each with ``end_id`` and write them to ``path`` in ascending doc_id order.

    Null ids come first; rows with the same id follow each other in order of a hash of their texts. A segment is closed at the first
    document that brings it to ``segment`` ids.
    """
    schema = _arrow_schema(_SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_no, number = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer).encode
        doc_ids, held, size = [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = (file_no, number, len(held), size, head(doc_ids, held, ids), ids.astype("<u4").tobytes(), BLOCK)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in (part for whole in batches for part in parts(whole, 2048)):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                doc_ids.append(doc_id)
                held.append(np.append(ids, np.uint32(end_id)))
                size += len(ids) + 1
                if size >= segment:
                    yield close()
                    doc_ids, held, size, number = [], [], 0, number + 1
        if held:
            yield close()

    # The text's hash deals out rows without an id, and orders rows that share one.
    in_order = id_and_text(docs).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    segments = in_order.mapInArrow(run, _SEGMENTS)
    segments.select("file_no", "segment", "documents", "ids", jvmcoder.encoded(docs.sparkSession, "head", "raw", "length").alias("payload")).write.parquet(path)


def read_ids(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Decode the files at ``path``: doc_id, start, n_tokens and ids_crc32 of each document.

    With ``with_ids`` also ids, as little-endian unsigned 32-bit integers. A wrong checksum fails the query.
    """
    files = spark.read.parquet(path)
    # One number for each file comes to the driver; segments are summed up within their file.
    totals = sorted((r["file_no"], r["n"]) for r in files.groupBy("file_no").agg(F.sum("ids").alias("n")).collect())
    begins, at = [], 0
    for file_no, n in totals:
        begins.append((file_no, at))
        at += n
    by_file = spark.createDataFrame(begins, "file_no int, begin long")
    earlier = Window.partitionBy("file_no").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = files.select("file_no", "segment", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("earlier")).join(by_file, "file_no")
    bases = segments.select("file_no", "segment", (F.col("begin") + F.col("earlier")).alias("base"))
    unpacked = F.inline(jvmcoder.decoded(spark, "payload", with_ids))
    if with_ids:  # a payload is shorter than its ids, and longer than the few numbers of its documents
        documents = files.select("file_no", "segment", "payload").join(bases, ["file_no", "segment"]).select("base", unpacked)
    else:
        documents = files.select("file_no", "segment", unpacked).join(bases, ["file_no", "segment"])
    return documents.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the ids of all documents to files in the shared folder, read these back and return what they hold.

    doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "ids")
    write_ids(docs, path, tokenizer, end_id)
    return read_ids(spark, path)
