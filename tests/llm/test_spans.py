from collections import defaultdict

from quillon.llm import spans


def brute(rows, k=2, words=20):
    seen = defaultdict(set)
    for d, t in rows:
        s, e, n = spans.sentences_of(t)
        for i in range(len(s)):
            j = i + k
            while j <= len(s) and sum(n[i:j]) < words:
                j += 1
            if j <= len(s):
                seen[" ".join(t[s[i] : e[j - 1]].lower().split())].add((d, i, j))
    out = defaultdict(set)
    for places in seen.values():
        for d, i, j in sorted(places)[1:]:
            out[d].update(range(i, j))
    return {d: sorted(v) for d, v in out.items()}


def test_against_brute_force(documents):
    got = {r["doc_id"]: r["removed"] for r in spans.repeated_sentences(documents).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in documents.collect()]) and len(got) > 50


def test_planted_passage_without_full_stops(spark):
    passage = " ".join(f"word{i} item{i * 7 % 50}" for i in range(40))
    rows = [(1, f"A start. Then {passage} goes on. End"), (2, f"Other text here\n{passage}"), (3, "Nothing of the kind stands here. It is clean. " + " ".join(f"free{i}" for i in range(60)))]
    got = {r["doc_id"]: r for r in spans.repeated_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {2} and got[2]["first_doc_ids"] == [1]
    clean = {r["doc_id"]: r["text"] for r in spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # Runs that both copies have whole go; the passage's ends, cut off by other words, may stay.
    assert {d: r["removed"] for d, r in got.items()} == brute(rows)
    assert clean[1] == rows[0][1] and clean[3] == rows[2][1] and len(rows[1][1].split()) - len(clean[2].split()) >= 20


def test_odd_rows(odd, none):
    got = {r["doc_id"]: r["removed"] for r in spans.repeated_sentences(odd).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None and r["text"] is not None]) and {2, 3} <= set(got)
    kept = spans.remove_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert spans.repeated_sentences(none).count() == 0


def test_without_keeps_the_rest():
    text = "One is here.  Two is here!\nThree is here? Four"
    starts, ends, _ = spans.sentences_of(text)
    n = len(starts)
    assert spans.without(text, list(range(n))) == "" and spans.without(text, []) == text
    assert spans.without(text, [0]).strip() == text[starts[1] :]


def brute_all(rows, same_cuts, k=2, words=20):
    """Every run of k whole sentences or more, and every run of k pieces or more with enough words; with ``same_cuts``,
    only those repeat that are cut alike too."""
    seen = defaultdict(set)
    for d, t in rows:
        h, closes = spans._words_of(t)
        cuts = spans._cuts_of(h, closes).tolist()
        unit = spans._UNIT if spans._UNSPACED.search(t) else spans._WORD
        tokens = unit.findall(t.lower())
        whole = [c in (0, len(tokens)) or bool(closes[c - 1]) for c in cuts]
        for i in range(len(cuts)):
            for j in range(i + k, len(cuts)):
                sentences = whole[i] and whole[j] and sum(whole[i:j]) >= k
                if sentences or cuts[j] - cuts[i] >= words:
                    inner = [(cuts[x] - cuts[i], whole[x]) for x in range(i, j + 1)] if same_cuts else []
                    seen[(*tokens[cuts[i] : cuts[j]], *inner)].add((d, i, j))
    out = defaultdict(set)
    for places in seen.values():
        first = min((d, i) for d, i, _ in places)
        for d, i, j in places:
            if (d, i) != first:
                out[d].update(range(i, j))
    return {d: sorted(v) for d, v in out.items()}


def _found(spark, rows):
    return {r["doc_id"]: r["removed"] for r in spans.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_every_run_against_brute_force(spark, rng):
    vocabulary = [f"w{i}" for i in range(30)] + ["end.", 'said."', "stop!", "line\n", "。"]
    blocks = [" ".join(rng.choice(vocabulary, int(n))) for n in rng.integers(3, 70, 25)]
    rows = [(d, " ".join(blocks[i] if rng.random() < 0.6 else " ".join(rng.choice(vocabulary, 15)) for i in rng.integers(0, 25, 5))) for d in range(60)]
    got, least, most = _found(spark, rows), brute_all(rows, True), brute_all(rows, False)
    assert set(least) <= set(got) <= set(most) and len(least) > 40
    assert all(set(least.get(d, ())) <= set(got[d]) <= set(most[d]) for d in got)


def test_tails_and_short_sentences_are_found(spark):
    long = " ".join(f"long{i}" for i in range(25))
    tail = f"{long}. One two three. Four five six. Seven eight nine."
    rows = [(1, tail), (2, f"Other words. {tail}"), (3, "We came late. They left. Nobody knew."), (4, "It rained. We came late. They left. So it went."), (5, 'He said "Go on." Then "No!" she cried. Off.'), (6, 'x y z. He said "Go on." Then "No!" she cried. p q.'), (7, "第一句话在这里。第二句话在那里！完了"), (8, "别的话。第一句话在这里。第二句话在那里！其他")]
    got = _found(spark, rows)
    texts = {r["doc_id"]: r["text"] for r in spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {2, 4, 6, 8}
    assert [texts[i].strip() for i in (2, 4, 6, 8)] == ["Other words.", "It rained. So it went.", "x y z. p q.", "别的话。其他"]


def test_every_passage_without_full_stops_is_found(spark, rng):
    rows = []
    for p in range(150):
        passage = " ".join(f"p{p}x{i}" for i in range(51))
        for d in (2 * p, 2 * p + 1):
            before, after = (" ".join(f"d{d}{side}{i}" for i in range(int(rng.integers(0, 30)))) for side in "ab")
            rows.append((d, f"A start {before} {passage} {after} goes on."))
    got = _found(spark, rows)
    assert set(got) == {2 * p + 1 for p in range(150)}


def test_texts_that_share_an_id_and_clashing_columns(spark):
    passage = "One two three four. Five six seven eight. Nine ten eleven twelve."
    rows = [(1, passage, 5, "x"), (1, f"Other. {passage}", 6, "y"), (1, passage, 7, "z"), (None, passage, 8, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _gone string")
    got = {r["_id"]: r["text"].strip() for r in spans.remove_repeats(docs).collect()}
    # Rows with one id and one text are one row, so it keeps its text in both; of the two texts the one of smaller hash does.
    assert got[8] == passage and got[5] == got[7] and sorted((got[5], got[6])) in ([passage, "Other."], ["", f"Other. {passage}"])


def test_hashes_have_two_independent_halves():
    a, b = spans.all_runs_of("One two. Three four. Five six. Seven eight.", 2, 20)[:2]
    assert len(a) == 3 and not set(a.tolist()) & set(b.tolist())
    assert spans.all_runs_of("one  TWO. three four.", 2, 20)[0].tolist() == a[:1].tolist()
