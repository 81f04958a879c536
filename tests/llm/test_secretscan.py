import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import queries, secretscan

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def brute(text):
    """Base spans by the contract's own patterns."""
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, a, b) for a, _, k, b in sorted(out)]


@pytest.fixture(scope="module")
def paragraphs(documents):
    return [r["text"][:300] for r in documents.filter("length(text) > 100").orderBy("doc_id").limit(300).collect()]


@pytest.fixture(scope="module")
def model(paragraphs):
    return secretscan.fitted(paragraphs)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["password", "PASSWD", "Secret", "token", "apikey", "API_KEY", "=", ":", " ", '"', "'", "abcdefgh", "AKIA", "ABCDEFGH2345", "0123456789abcdef", "a", "F", "-", ".", "é", "\n", "://u:", "@h"]), max_size=24).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    base = secretscan.base_spans(text)
    assert base == brute(text)
    more = secretscan.further_candidates(text, base)
    taken = sorted((a, b) for _, a, b in more)
    assert all(b <= c for (_, b), (c, _) in zip(taken, taken[1:]))
    assert not any(a < d and c < b for _, a, b in base for c, d in taken)


def test_query_digest(spark, documents):
    got = {r["doc_id"]: r for r in queries.op11_secrets(spark, "/root/testdata/sf0.01").collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert set(got) == set(texts)
    for d, r in got.items():
        want = brute(texts[d])
        assert [r[f"n_{k}"] for k in secretscan.BASE] == [sum(s[0] == k for s in want) for k in secretscan.BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert set(r["spans"].split(",")) >= {f"{k}:{a}:{b}" for k, a, b in want}
        assert (r["top_score"] is None) == (r["spans"] == "")
    assert sum(r["n_assign"] for r in got.values()) > 5


def test_held_out_findings(model, paragraphs):
    """Findings drawn anew: the thresholds keep about the recall that they were set for, and let little else through."""
    found = secretscan.labelled_findings(paragraphs, 150, seed=77)
    p = 1 / (1 + np.exp(-model.logits([c for _, _, c, _ in found]) / model.heat))
    kinds, truth = np.array([k for k, *_ in found]), np.array([y for *_, y in found])
    above = p >= np.array([model.thresholds[k] for k in kinds])
    assert above[truth].mean() > 0.9 and above[~truth].mean() < 0.05
    for k in secretscan.BASE + secretscan.ADDED:
        assert above[truth & (kinds == k)].mean() > 0.8, k
        assert above[~truth & (kinds == k)].mean() < 0.15, k
    # Calibration: of those with a probability in a band about that share are secrets.
    assert abs(p.mean() - truth.mean()) < 0.05


def test_candidates_are_judged_whole_and_alone(model):
    """Neither the other candidates of a batch nor the piece size changes a score."""
    rng = np.random.default_rng(1)
    text = "key " + secretscan._draw(rng, secretscan._ALNUM, 40) + " and " + "Ab1" * 40_000 + " end " + secretscan._draw(rng, secretscan._ALNUM, 30)
    spans = secretscan.further_candidates(text, [])
    assert [b - a for _, a, b in spans] == [40, 120_000, 30]
    together = model.probabilities(text, spans)
    for s, p in zip(spans, together):
        assert abs(model.probabilities(text, [s])[0] - p) < 1e-5
    # The one convolution, position by position, for the first candidate.
    codes = secretscan.codes_of(text, *spans[0][1:])
    x = np.concatenate((codes, np.zeros(secretscan._WIDTH, np.int64)))
    conv = np.array([sum(model.taps[j][x[i + j]] for j in range(secretscan._WIDTH)) for i in range(len(codes))])
    edges = [0, 32, 72, 88]
    tops = np.stack([conv[a:b].max(axis=0) for a, b in zip(edges, edges[1:])]) + model.bias
    flat = np.concatenate((np.maximum(tops, 0).ravel(), [np.log2(41) / 8]))
    logit = np.maximum(flat @ model.hidden + model.hidden_bias, 0) @ model.out + model.out_bias
    assert abs(1 / (1 + np.exp(-logit / model.heat)) - together[0]) < 1e-4


def test_added_findings(model):
    rng = np.random.default_rng(2)
    secrets = ["ghp_" + secretscan._draw(rng, secretscan._ALNUM, 36) for _ in range(20)]
    links = [f"postgres://app:{secretscan._draw(rng, secretscan._ALNUM, 18)}@db.internal/x" for _ in range(20)]
    hit = sum(len(model.findings(f"we use {s} to log in here")[1]) for s in secrets) + sum(len(model.findings(f"connect to {u} now")[1]) for u in links)
    assert hit >= 34
    plain = ["see src/main/java/com/example/Reader2.java for it", "id 123e4567-e89b-12d3-a456-426614174000 of the row", "ftp://anonymous:anonymous@ftp.example.org", "pass: everything else", "-----BEGIN PRIVATE KEY----- ..."]
    assert sum(len(model.findings(t)[1]) for t in plain) <= 1


def test_odd_rows(odd, none, model):
    assert secretscan.find_secrets(odd, model).count() == odd.count()
    assert secretscan.find_secrets(none, model).count() == 0 and secretscan.findings(none, model).count() == 0
    trained = secretscan.train(none, each=8, rounds=1)
    assert secretscan.find_secrets(odd, trained).count() == odd.count()
    secret = odd.sparkSession.createDataFrame([(1, 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y', "k"), (2, None, "k"), (None, "api_key: abcdefgh1", None)], "doc_id long, text string, kind string")
    assert [r["text"] for r in secretscan.redact(secret, model).collect()] == ['x [SECRET]" y', None, "[SECRET]"]
    rows = secretscan.findings(secret, model).collect()
    assert [(r["doc_id"], r["kind"]) for r in rows] == [(1, "assign"), (1, "hex"), (None, "assign")]
    assert rows[1]["value_sha256"] == hashlib.sha256(b"24be64439e3e49cf46b2d7c90f3602a3d0b907ff").hexdigest()
