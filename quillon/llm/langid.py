"""Language identification with string kernels.

The kernel of two texts is the share of different n-grams of 1 to 3 characters that they have in common (a blended
spectrum of presence, normalised). Nyström's method approximates it by a few landmark texts, and one kernel ridge
regression for each language learns on that. All of a batch is scored by products of matrices.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.arrow import id_and_text, kept, map_batches, text_column

_BITS = 18
_SPACE = 1 << _BITS
_A, _B, _C = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
UNKNOWN = "und"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Code points of letters, with zero for all others; and a flag for each n-gram's number."""
    return np.fromiter((cp if chr(cp).isalpha() else 0 for cp in range(0x110000)), np.uint32, 0x110000), np.zeros(_SPACE, bool)


def ngrams(text: str | None) -> np.ndarray:
    """Numbers of the text's different n-grams (1 to 3 letters; all that isn't a letter is one boundary), sorted."""
    letters, flags = kept("letters", _tables)
    cps = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = letters[cps]
    if not c.any():
        return np.zeros(0, np.int32)
    # Several boundaries in turn count as one, and each text begins and ends with one.
    c = np.concatenate((np.zeros(1, np.uint32), c, np.zeros(1, np.uint32)))
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    shift = np.uint32(32 - _BITS)
    one = c * _A
    two = (one[:-1] ^ (c[1:] + np.uint32(1)) * _B) * _C
    three = (two[:-1] ^ (c[2:] + np.uint32(2)) * _A) * _B
    for h in (one[one != 0], two, three):
        flags[h >> shift] = True
    found = np.flatnonzero(flags).astype(np.int32)
    flags[found] = False
    return found


@dataclass
class KernelModel:
    """``columns`` maps n-grams to rows of ``marks`` (landmarks' presence); ``weights`` turn kernels into scores."""

    languages: list[str]
    columns: np.ndarray
    marks: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    step: int = 64

    def kernels(self, grams: list[np.ndarray]) -> np.ndarray:
        out = []
        wide = np.zeros((min(self.step, len(grams)), len(self.marks) + 1), np.float32)
        for at in range(0, len(grams), self.step):
            part = grams[at : at + self.step]
            wide[:] = 0
            for i, g in enumerate(part):
                wide[i, self.columns[g]] = 1  # n-grams that no landmark has fall into the last column
            roots = np.sqrt(np.maximum([len(g) for g in part], 1))
            out.append(wide[: len(part), :-1] @ self.marks / (roots[:, None] * self.roots[None, :]))
        return np.concatenate(out) if out else np.zeros((0, len(self.roots)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        grams = [ngrams(t) for t in texts]
        scores = self.kernels(grams) @ self.weights
        best = scores.argmax(axis=1)
        top = np.clip((scores[np.arange(len(best)), best] + 1) / 2, 0, 1)
        none = np.fromiter((len(g) == 0 for g in grams), bool, len(grams))
        return [UNKNOWN if e else self.languages[b] for b, e in zip(best, none)], np.where(none, 0.0, top).tolist()


def held_out(doc_id: Column) -> Column:
    """The documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, sample: int = 3000, landmarks: int = 40, ridge: float = 1e-3) -> KernelModel:
    """Learn from columns doc_id, text and lang.

    About ``sample`` texts are learned from, as many of each language as may be, the first by a hash of doc_id;
    ``landmarks`` of each language are landmarks. Their whole texts are read, on the executors; the driver gets
    their n-grams. Rows with null text or lang are left out, and rows that repeat a doc_id count once. Every label is
    learned; more labels than ``sample`` raise ValueError, as a column like that holds no languages.
    """
    rows = labelled.filter("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("draw"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(sample + 1).collect()}
    if len(sizes) > sample:
        raise ValueError(f"more than {sample} labels")
    if not sizes:
        return KernelModel([], np.zeros(_SPACE, np.int32), np.zeros((0, 0), np.float32), np.zeros(0), np.zeros((0, 0)))
    each = max(1, sample // len(sizes))
    # A hash picks half as many again of each language as are wanted, 50 at least, before any row is moved.
    share = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, max(1.5 * each, 50) / n))))
    drawn = rows.filter(F.pmod("draw", F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003).groupBy("lang", "doc_id", "draw").agg(F.min("text").alias("text"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("draw"), "doc_id")
    drawn = drawn.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= each).select("lang", "text", "place")

    def grams(batch: pa.RecordBatch) -> dict:
        return {"lang": batch.column("lang"), "place": batch.column("place"), "grams": [ngrams(t) for t in batch.column("text").to_pylist()]}

    got = map_batches(drawn, grams, "lang string, place int, grams array<int>").toArrow().sort_by([("lang", "ascending"), ("place", "ascending")])
    langs = got.column("lang").to_pylist()
    texts = [np.array(g, np.int32) for g in got.column("grams").to_pylist()]
    filled = [i for i, g in enumerate(texts) if len(g)]
    langs, texts = [langs[i] for i in filled], [texts[i] for i in filled]
    names = sorted(set(langs))
    chosen = [i for name in names for i in [i for i, lang in enumerate(langs) if lang == name][:landmarks]]
    held = np.unique(np.concatenate([texts[i] for i in chosen])) if chosen else np.zeros(0, np.int32)
    columns = np.full(_SPACE, len(held), np.int32)
    columns[held] = np.arange(len(held))
    marks = np.zeros((len(held), len(chosen)), np.float32)
    for k, i in enumerate(chosen):
        marks[columns[texts[i]], k] = 1
    roots = np.sqrt([len(texts[i]) for i in chosen])
    model = KernelModel(names, columns, marks, roots, np.zeros((len(chosen), len(names))))
    among = model.kernels([texts[i] for i in chosen]).astype(np.float64)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    keep = values > 1e-6 * values.max()
    to_features = vectors[:, keep] / np.sqrt(values[keep])
    x = model.kernels(texts).astype(np.float64) @ to_features
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # Languages weigh the same, however many texts each has.
    per = np.array([1 / langs.count(lang) for lang in langs])[:, None] * len(langs) / len(names)
    solved = np.linalg.solve(x.T @ (per * x) + ridge * len(x) * np.eye(x.shape[1]), x.T @ (per * y))
    model.weights = to_features @ solved
    return model


def identify(docs: DataFrame, model: KernelModel) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every row, from its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0; so is all if nothing was learned. Repeated rows
    and null ids are judged each; ties go to the first language in order of name.
    """

    def make(batch: pa.RecordBatch) -> dict:
        langs, scores = model.predict(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "lang_pred": langs, "score": scores}

    judged = map_batches(id_and_text(docs), make, "doc_id long, lang_pred string, score double")
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: KernelModel, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a score of at least ``least``.

    Rows with null texts or texts without a letter go; null ids, repeated rows and further columns stay as they are.
    """

    def known(texts: list[str | None]) -> list[bool]:
        return [lang != UNKNOWN and s >= least for lang, s in zip(*model.predict(texts))]

    return docs.filter(text_column(F.col("text").cast("string"), known, "boolean"))
