"""License notices by a trained classifier of paragraphs.

A logistic regression over sparse word 1- and 2-grams tells licence families and an unknown class apart. It is trained
here on templates, varied by rule, against paragraphs of the corpus; a temperature fitted on templates that were held
out whole calibrates its probabilities. A prediction counts when the family's templates confirm it: the place where a
template fits best is the notice, and what stands before and behind it is judged again, so one line may hold several.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.arrow import id_and_text, kept, map_batches

UNKNOWN = "unknown"

# Notices in common use, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL": ("Licensed under the GNU Affero General Public License, version 3.", "This program is distributed under the terms of the GNU Affero General Public License.", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "SPDX-License-Identifier: Apache-2.0", "Released under the Apache 2.0 license."),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.", "Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "GPL": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.", "Licensed under the GNU GPL version 2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-only"),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "SPDX-License-Identifier: ISC"),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 3.", "This library is free software under the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
}
# Sentences about licences that grant none, for the unknown class.
DISTRACTORS = (
    "The driver lost his license after the accident.",
    "You need a fishing license to fish in this lake.",
    "The company sells licenses of its software every year.",
    "Poetic license allows the author to bend the rules.",
    "Read the license before you install the program.",
    "Apache is the name of several peoples of the southwest.",
    "She studied at MIT before she moved to the coast.",
    "The general public was admitted to the work of art.",
    "Version 2.0 of the report will be released under a new title.",
    "The commons were open to the creative work of all.",
)

# Words that turn a notice into its opposite when they stand just before it.
NEGATIONS = frozenset({"not", "never", "neither", "nor", "no", "isn", "aren", "wasn", "without", "cannot", "unlicensed"})
# Words too common to look for.
COMMON = frozenset("a all an and any are as at be by can file following for free from has in is it may not of on or person possible terms that the this to under use version which with without work you".split())

_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9.+-]+\)*(?:[ \t]+(?:OR|AND|WITH)[ \t]+\(*[A-Za-z0-9.+-]+\)*)+)", re.I)
_SPDX_ID = re.compile(r"(?:(WITH)[ \t]+)?([A-Za-z0-9.+-]+)", re.I)
_WORDS = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_LONG = 60
_STEP = 30


def features(words: list[str]) -> set[str]:
    """Word 1- and 2-grams."""
    return {*words, *map(" ".join, zip(words, words[1:]))}


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Places of a text's lines that aren't blank."""
    out, at = [], 0
    for line in text.split("\n"):
        if line.strip():
            out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def blocks(lines: list[tuple[int, int]], text: str) -> list[tuple[int, int]]:
    """Numbers of the first and past the last line of each paragraph: lines with no blank line between."""
    starts = [0, *(i for i in range(1, len(lines)) if text.count("\n", lines[i - 1][1], lines[i][0]) > 1), len(lines)]
    return list(zip(starts, starts[1:]))


@dataclass
class LicenseModel:
    families: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.5
    confirm: float = 0.6
    #: Single words that occur in a template: a window without two of these has nothing to confirm it.
    cues: frozenset[str] = frozenset()
    grams: dict[str, list[set]] = field(default_factory=dict)
    #: How many words each template has, repeated ones too.
    sizes: dict[str, list[int]] = field(default_factory=dict)

    def __post_init__(self):
        self.pairs = {tuple(g.split(" ")) for ts in self.grams.values() for t in ts for g in t if " " in g}

    def probabilities(self, found: list[set[str]]) -> np.ndarray:
        scores = np.repeat(self.bias[None, :], len(found), axis=0)
        for i, f in enumerate(found):
            known = [self.vocabulary[g] for g in f if g in self.vocabulary]
            scores[i] += self.weights[known].sum(axis=0) / np.sqrt(max(1, len(known)))
        scores /= self.temperature
        scores -= scores.max(axis=1, keepdims=True)
        e = np.exp(scores)
        return e / e.sum(axis=1, keepdims=True)

    def likeness(self, family: str, found: set[str]) -> float:
        """Largest share of a template's features that are in the text."""
        return max((len(t & found) / len(t) for t in self.grams[family]), default=0.0)

    def needed(self) -> int:
        """Word 2-grams of templates that a confirmed notice has at least, even with all of a template's words."""
        shares = [self.confirm * len(t) - sum(" " not in g for g in t) for ts in self.grams.values() for t in ts]
        return max(0, int(np.ceil(min(shares, default=0) - 1e-9)))

    def telling(self) -> list[str]:
        """Words without which no template can be confirmed: a paragraph that has none of them needs no judging.

        Of each template so many words, rare and long ones first, that the features without them are too few.
        """
        out: set[str] = set()
        for t in (t for ts in self.grams.values() for t in ts):
            words = sorted((g for g in t if " " not in g), key=lambda w: (w in COMMON, -len(w), w))
            gone: set[str] = set()
            while sum(gone.isdisjoint(g.split(" ")) for g in t) >= self.confirm * len(t) - 1e-9:
                gone.add(next(w for w in words if w not in gone))
            out |= gone
        return sorted(out)

    def _place(self, words: list[str], family: str) -> tuple[int, int]:
        """Where one of the family's templates fits best: first word and past the last."""
        best = (-1.0, 0, 0)  # of equal places the longer one wins
        for t, size in zip(self.grams[family], self.sizes[family]):
            size = min(len(words), size)
            for at in range(len(words) - size + 1):
                like = len(t & features(words[at : at + size])) / len(t)
                if like > best[0] + 1e-9 or like > best[0] - 1e-9 and size > best[2] - best[1]:
                    best = (like, at, at + size)
        # Words at the ends that the templates don't have are none of the notice.
        own = set().union(*self.grams[family])
        _, first, stop = best
        while first < stop and words[first] not in own:
            first += 1
        while stop > first and words[stop - 1] not in own:
            stop -= 1
        return first, stop

    def _judge(self, words: list[str], spans: list[tuple[int, int]], at: int, size: int) -> list[tuple[int, int, str, float, float]]:
        """Confirmed notices of a window: the likeliest family's, and then those of what is left on both sides of it."""
        part = words[at : at + size]
        if len(self.cues.intersection(part)) < 2:
            return []
        found = features(part)
        p = self.probabilities([found])[0]
        best = int(p.argmax())
        family = self.families[best]
        if family == UNKNOWN or p[best] < self.least or (like := self.likeness(family, found)) < self.confirm:
            return []
        first, stop = self._place(part, family)
        if stop <= first:
            return []
        before, behind = self._judge(words, spans, at, first), self._judge(words, spans, at + stop, len(part) - stop)
        denied = NEGATIONS.intersection(words[max(0, at + first - 3) : at + first])
        row = [] if denied else [(spans[at + first][0], spans[at + stop - 1][1], family, float(p[best]), like)]
        return before + row + behind

    def _expressions(self, text: str) -> list[tuple[int, int, str, float, float]]:
        """Each licence of SPDX expressions with several, judged as an identifier of its own."""
        out = []
        for m in _SPDX.finditer(text):
            for name in _SPDX_ID.finditer(m[1]):
                if not name[1] and name[2].upper() not in ("OR", "AND", "WITH"):
                    words = [w.lower() for w in _WORDS.findall("SPDX-License-Identifier: " + name[2])]
                    a, b = m.start(1) + name.start(2), m.start(1) + name.end(2)
                    out += [(a, b, *row[2:]) for row in self._judge(words, [(a, b)] * len(words), 0, len(words))]
        return out

    def scan(self, text: str | None) -> list[tuple[int, int, str, float, float]]:
        """Confirmed notices of a whole text by place: start, end, family, probability, likeness. Null has none.

        Lines are judged by themselves, long ones by windows. A paragraph, the lines between two blank ones, is also judged
        as one text, for notices wrapped over lines: by windows, and from each of its lines by as many lines as a window
        holds. Of notices that overlap the one most like its template counts, then the longest, then the first; families
        that are equally likely go by order of name.
        """
        text = text or ""
        low = text.lower()
        tell = kept(("telling", *self.families), lambda: _automaton(self.telling()))
        at = sorted({last for last, _ in tell.iter(low)})
        if not at:
            return []
        lines = paragraphs(text)
        needed, pairs = self.needed(), self.pairs
        out: list[tuple[int, int, str, float, float]] = []

        expressions = [(m.start(), m.end()) for m in _SPDX.finditer(text)]
        for first, last in blocks(lines, text):
            # Lower case may be longer, by a rare letter; places then don't tell paragraphs apart.
            if len(low) == len(text) and bisect_left(at, lines[first][0]) == bisect_left(at, lines[last - 1][1]):
                continue
            spans, words, begins = [], [], [0]
            for a, b in lines[first:last]:
                own = [(m.start() + a, m.end() + a) for m in _WORDS.finditer(text[a:b])]
                spans += own
                words += [text[x:y].lower() for x, y in own]
                begins.append(len(words))
            hits = [i for i, pair in enumerate(zip(words, words[1:])) if pair in pairs]
            if len(hits) < needed:
                continue
            found: list[tuple[int, int, str, float, float]] = []
            # Windows with too few 2-grams of templates can't be confirmed.
            hopeful = lambda x, y: bisect_left(hits, y - 1) - bisect_left(hits, x) >= needed
            for x, y in zip(begins, begins[1:]):
                for i in [x] if y - x <= _LONG else range(x, y - _STEP, _STEP):
                    if y > x and hopeful(i, min(i + _LONG, y)):
                        found += self._judge(words, spans, i, min(_LONG, y - i))
            if last - first > 1:
                wide: dict[tuple[int, int], None] = {}
                begins = sorted(set(begins))
                for i, x in enumerate(begins):
                    for j in range(i + 2, len(begins)):
                        if begins[j] - x > _LONG:
                            break
                        wide[x, begins[j]] = None
                for i in range(0, max(1, len(words) - _STEP), _STEP):
                    wide[i, min(i + _LONG, len(words))] = None
                for x, y in wide:
                    if hopeful(x, y):
                        found += self._judge(words, spans, x, y - x)
            taken: list[tuple[int, int]] = [e for e in expressions if e[0] < lines[last - 1][1] and lines[first][0] < e[1]]
            for r in sorted(set(found), key=lambda r: (-round(r[4], 6), r[0] - r[1], r)):
                if not any(a < r[1] and r[0] < b for a, b in taken):
                    taken.append(r[:2])
                    out.append(r)
        out += self._expressions(text)
        return sorted(out)


def _automaton(words: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, w)
    out.make_automaton()
    return out


def _varied(template: str, noise: list[str], rng: np.random.Generator, n: int) -> list[list[str]]:
    """The template's words, with up to a sixth left out and words of the corpus around them."""
    words = [w.lower() for w in _WORDS.findall(template)]
    out = [words]
    for _ in range(n):
        kept = [w for w in words if rng.random() > 1 / 12] if len(words) > 5 else list(words)
        around = [noise[i] for i in rng.integers(0, len(noise), int(rng.integers(0, 40)))] if noise else []
        at = int(rng.integers(0, len(around) + 1))
        out.append(around[:at] + kept + around[at:])
    return out


@dataclass
class _Sparse:
    """Rows of features as places in a vocabulary; each row weighs one over the root of how many it has."""

    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    n: int

    @classmethod
    def of(cls, texts: list[list[str]], vocabulary: dict[str, int]) -> _Sparse:
        held = [sorted(vocabulary[g] for g in features(t) if g in vocabulary) for t in texts]
        sizes = np.array([len(h) for h in held], np.int64)
        values = np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes)
        return cls(np.repeat(np.arange(len(held)), sizes), np.array([c for h in held for c in h], np.int64), values, len(held))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.rows, self.values * w[self.columns], self.n) for w in weights.T], axis=1)

    def transposed_times(self, errors: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(self.columns, self.values * e[self.rows], size) for e in errors.T], axis=1)


def _fit(x: _Sparse, y: np.ndarray, size: int, classes: int, rounds: int, rate: float, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by gradient descent with momentum; classes weigh the same, however many rows each has."""
    weights, bias = np.zeros((size, classes)), np.zeros(classes)
    moving, moving_bias = np.zeros_like(weights), np.zeros_like(bias)
    one = np.eye(classes)[y]
    per = (1 / np.bincount(y, minlength=classes).clip(1))[y][:, None]
    per = per / per.sum()
    for _ in range(rounds):
        error = per * (_softmax(x.times(weights) + bias) - one)
        moving = 0.9 * moving - rate * 10 * (x.transposed_times(error, size) + penalty * weights / len(y))
        moving_bias = 0.9 * moving_bias - rate * error.sum(axis=0)
        weights += moving
        bias += moving_bias
    return weights, bias


def train(docs: DataFrame, sample: int = 1500, copies: int = 24, rounds: int = 120, rate: float = 1.0, penalty: float = 1e-2, paragraph_chars: int = 2000, noise_words: int = 20_000, least_paragraphs: int = 5) -> LicenseModel:
    """Learn from the templates and, as unknown, from a paragraph of each of at most ``sample`` documents.

    Documents are drawn by a hash of doc_id, on the executors; of a drawn paragraph ``paragraph_chars`` characters are the
    example, and ``noise_words`` words of all examples stand around varied templates. Those that name a licence are left
    out. Words and pairs of at least ``least_paragraphs`` examples count besides those of templates. For the temperature
    a first model learns without the last template of each family with several, and without a fifth of the examples.
    Rows with null doc_id or text teach nothing, repeated doc_ids teach once. Works on an empty corpus too.
    """
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null").withColumn("h", F.xxhash64("doc_id"))
    n = drawn.count()
    # A hash picks half as many again as are wanted, before any task sends rows.
    share = min(1.0, max(1.5 * sample, 100) / max(n, 1))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    picked = drawn.filter(F.pmod("h", F.lit(1 << 30)) < F.lit(share * (1 << 30))).select("doc_id", "h", lines.alias("l")).filter(F.size("l") > 0)
    examples = picked.select("doc_id", "h", F.substring(F.element_at("l", F.pmod("h", F.size("l")).cast("int") + 1), 1, paragraph_chars).alias("p")).groupBy("doc_id", "h").agg(F.min("p").alias("p"))
    corpus = [r["p"] for r in examples.orderBy("h", "doc_id").limit(sample).collect()]
    naming = re.compile(r"licen[sc]e|copyright|spdx|public domain|redistribut", re.I)
    plain = [[w.lower() for w in _WORDS.findall(p)] for p in corpus if not naming.search(p)]
    noise = [w for p in plain for w in p][:noise_words]
    rng = np.random.default_rng(5)
    families = [UNKNOWN, *TEMPLATES]
    # Words, class, and whether the row is held out for the temperature.
    texts: list[tuple[list[str], int, bool]] = [(p, 0, bool(rng.random() < 0.2)) for p in plain]
    for family, templates in TEMPLATES.items():
        for i, t in enumerate(templates):
            texts += [(v, families.index(family), 0 < i == len(templates) - 1) for v in _varied(t, noise, rng, copies)]
    texts += [(v, 0, i % 5 == 4) for i, t in enumerate(DISTRACTORS) for v in _varied(t, noise, rng, copies)]
    seen: dict[str, int] = {}
    for p in plain:
        for g in features(p):
            seen[g] = seen.get(g, 0) + 1
    own = {g for t in (*[t for ts in TEMPLATES.values() for t in ts], *DISTRACTORS) for g in features([w.lower() for w in _WORDS.findall(t)])}
    vocabulary = {g: i for i, g in enumerate(sorted(own | {g for g, k in seen.items() if k >= least_paragraphs}))}
    y, held = np.array([c for _, c, _ in texts]), np.array([h for _, _, h in texts])
    first = [t for t, _, h in texts if not h]
    raw_weights, raw_bias = _fit(_Sparse.of(first, vocabulary), y[~held], len(vocabulary), len(families), rounds, rate, penalty)
    raw = _Sparse.of([t for t, _, h in texts if h], vocabulary).times(raw_weights) + raw_bias
    heat = min(np.geomspace(0.3, 3, 25), key=lambda t: -np.log(_softmax(raw / t)[np.arange(len(raw)), y[held]] + 1e-9).mean())
    weights, bias = _fit(_Sparse.of([t for t, _, _ in texts], vocabulary), y, len(vocabulary), len(families), rounds, rate, penalty)
    grams = {f: [features([w.lower() for w in _WORDS.findall(t)]) for t in ts] for f, ts in TEMPLATES.items()}
    cues = frozenset(w for ts in TEMPLATES.values() for t in ts for w in map(str.lower, _WORDS.findall(t)))
    return LicenseModel(families, vocabulary, weights, bias, float(heat), cues=cues, grams=grams, sizes={f: [len(_WORDS.findall(t)) for t in ts] for f, ts in TEMPLATES.items()})


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def scan(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """Every confirmed notice: doc_id, start, end (code points), family, probability, likeness.

    Null and empty texts have none; repeated rows are scanned each; an empty table gives no rows.
    """

    def make(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("doc_id", "start", "end", "family", "probability", "likeness")}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            for row in model.scan(text):
                for name, value in zip(out, (doc_id, *row)):
                    out[name].append(value)
        return out

    return map_batches(id_and_text(docs), make, "doc_id long, start long, end long, family string, probability double, likeness double")
