from quillon.llm import licenses


def test_notices_and_clean_text(documents, odd, none):
    model = licenses.train(documents)
    for family, text in {"MIT": "Released under the MIT License.", "GPL": "This work is licensed under the GNU General Public License, version 3.", "Apache-2.0": "licensed under the apache license, version 2.0", "CC-BY-NC": "Licensed under CC BY-NC 4.0.", "CC-BY": "Licensed under CC BY 4.0."}.items():
        assert [r[2] for r in model.scan("thre of ouin.\n" + text + "\nonha")] == [family]
        inside = model.scan("onha edat " * 80 + text + " thre of" * 90)
        assert [r[2] for r in inside] == [family]
    for text in licenses.DISTRACTORS:
        assert model.scan(text) == []
    found = {r["doc_id"] for r in licenses.scan(documents, model).collect()}
    cue = documents.filter("text rlike '(?i)(licensed under|released under the)'").select("doc_id").collect()
    assert found == {r[0] for r in cue} and found
    assert licenses.scan(odd, model).count() == 0 and licenses.scan(none, model).count() == 0
    assert licenses.train(none).scan("Released under the MIT License.")[0][2] == "MIT"


def test_notices_wrapped_over_lines(documents):
    model = licenses.train(documents)
    for family, templates in licenses.TEMPLATES.items():
        for words in map(str.split, templates):
            for k in range(1, len(words)) if len(words) > 5 else ():
                text = "/*\n * Copyright 2020 some person\n * " + " ".join(words[:k]) + "\n * " + " ".join(words[k:]) + "\n */\nint main(void)\n"
                assert family in [r[2] for r in model.scan(text)], text
    lines = "Released under the MIT License.\nThis work is licensed under the GNU General Public License, version 3."
    assert [r[2] for r in model.scan(lines)] == ["MIT", "GPL"]
    assert model.scan("\n".join(licenses.DISTRACTORS)) == []


def test_several_notices_denials_and_expressions(documents):
    model = licenses.train(documents)
    two = "Released under the MIT License. Licensed under the Apache License, Version 2.0."
    assert [(r[2], two[r[0] : r[1]]) for r in model.scan(two)] == [("MIT", "Released under the MIT License"), ("Apache-2.0", "Licensed under the Apache License, Version 2.0")]
    for text in ("This project is not released under the MIT License.", "It isn't licensed under the Mozilla Public License 2.0.", "never licensed under CC BY 4.0"):
        assert model.scan(text) == []
    for text, want in {
        "SPDX-License-Identifier: MIT OR Apache-2.0": ["MIT", "Apache-2.0"],
        "// SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 OR MIT) AND BSD-3-Clause": ["GPL", "MIT", "BSD"],
        "SPDX-License-Identifier: LGPL-2.1-or-later": ["LGPL"],
    }.items():
        assert [r[2] for r in model.scan(text)] == want


def brute(text):
    """Families and places of every template that stands in the text word for word, the longest where several begin."""
    spans = [m.span() for m in licenses._WORDS.finditer(text)]
    words = [text[a:b].lower() for a, b in spans]
    found = {}
    for family, templates in licenses.TEMPLATES.items():
        for t in ([w.lower() for w in licenses._WORDS.findall(t)] for t in templates):
            for i in range(len(words) - len(t) + 1):
                if words[i : i + len(t)] == t and len(t) > found.get(i, ("", 0))[1]:
                    found[i] = (family, len(t))
    inside = {i for i, (_, n) in found.items() for j, (_, m) in found.items() if j < i < i + n <= j + m}
    return {(spans[i][0], spans[i + n - 1][1], f) for i, (f, n) in found.items() if i not in inside}


def test_against_an_independent_search(spark, documents, rng):
    model = licenses.train(documents)
    rows = []
    noise = [w for r in documents.filter("not text rlike '(?i)licen|copyright|spdx'").orderBy("doc_id").limit(30).collect() for w in r["text"].split()]
    every = [t for ts in licenses.TEMPLATES.values() for t in ts]
    for d in range(150):
        paragraphs = []
        for _ in range(int(rng.integers(1, 5))):
            words = list(rng.choice(noise, int(rng.integers(0, 12))))
            if rng.random() < 0.6:
                words += every[int(rng.integers(0, len(every)))].split()
            words += list(rng.choice(noise, int(rng.integers(0, 12))))
            mark, width, lines = ["", "# ", " * ", "// "][int(rng.integers(0, 4))], int(rng.integers(4, 14)), []
            for i in range(0, len(words), width):
                lines.append(mark + " ".join(words[i : i + width]))
            paragraphs.append("\n".join(lines))
        rows.append((d, "\n\n".join(paragraphs)))
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        got.setdefault(r["doc_id"], set()).add((r["start"], r["end"], r["family"]))
    total = 0
    for d, text in rows:
        want = brute(text)
        total += len(want)
        # Every planted notice is found with its family, at its place; and nothing is found where none stands.
        for a, b, f in want:
            assert any(g == f and x < b and a < y for x, y, g in got.get(d, ())), (text, a, b, f, got.get(d))
        for x, y, g in got.get(d, ()):
            assert any(a < y and x < b and g == f for a, b, f in want), (text, x, y, g)
    assert total > 150


def test_texts_without_a_telling_word_have_no_notice(documents):
    model = licenses.train(documents)
    telling = set(model.telling())
    for templates in model.grams.values():
        for t in templates:
            rest = {g for g in t if telling.isdisjoint(g.split(" "))}
            assert len(rest) < model.confirm * len(t)


def test_long_runs_of_blanks_take_linear_time(spark, documents):
    """A million blanks on one line of a text that names a licence, and a million blank lines."""
    import time

    model = licenses.train(documents)
    start = time.time()
    for blanks in (" " * 1_000_000, "\n" * 1_000_000, " \t" * 200_000 + "\n" + "  " * 200_000):
        found = model.scan("Licensed under the MIT License." + blanks + "\nReleased under the BSD 3-Clause License.")
        assert [f[2] for f in found] == ["MIT", "BSD"]
    assert time.time() - start < 30
    assert licenses.paragraphs("a\n \n\n b \r\n") == [(0, 1), (5, 9)]
