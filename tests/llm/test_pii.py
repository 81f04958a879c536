import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from([*"0123456789", "4111111111111111", "+1", "@", ".", "-", " ", "(", ")", "a", "b.c", "é", "%", "http://", "u:p@h.io", "token = ", "IBAN ", "255", "256"]), max_size=24).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    base, added = pii.finder().spans(text)
    assert base == brute(text)
    assert not set(base) & set(added) and all(0 <= a < b <= len(text) for _, a, b in added)


def test_query_digest(documents):
    got = {r["doc_id"]: r for r in pii.find_pii(documents).collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert len(got) == len(texts)
    for d, r in got.items():
        want = brute(texts[d] or "")
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in want) for k in pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
    assert sum(r["n_email"] for r in got.values()) > 10


def test_added_spans():
    text = "x +1 (726) 555-7857 4325404893167225 y token = \"f33e61083db5dbdf4bd2\" IBAN DE89370400440532013000 z"
    base, added = pii.finder().spans(text)
    assert {(k, text[a:b]) for k, a, b in base + added} >= {("phone", "+1 (726) 555-7857"), ("card", "4325404893167225"), ("account", "f33e61083db5dbdf4bd2"), ("iban", "DE89370400440532013000")}
    assert pii.redacted(text) == 'x [PHONE] [CARD] y token = "[ACCOUNT]" IBAN [IBAN] z'
    jwt = "eyJhbGciOiJIUzI1NiJ9." + "eyJzdWIiOiIxMjM0NTY3ODkwIn0" * 8 + ".dozjgNryP4J3jVmNHl0w5N"
    for text, value in {
        "Password: hunter2abc": "hunter2abc",
        "Account: 12345678": "12345678",
        "account number: 12345678.": "12345678",
        "ACCOUNT NO. 12345678": None,
        "Acct no.: 12345678": "12345678",
        "API_KEY=abcd1234": "abcd1234",
        "api-key: abcd1234": "abcd1234",
        '{"Api Key": "abcd1234"}': "abcd1234",
        f"token: {jwt}": jwt,
        "secret: something": None,
        "passwords: forgotten1 by all": None,
        "İ secret=abcd1234": "abcd1234",
    }.items():
        found = [text[a:b] for k, a, b in pii.finder().spans(text)[1] if k == "account"]
        assert found == ([value] if value else []), text
    assert [s[0] for s in pii.finder().spans("Iban: DE89370400440532013000 HTTPS://Joe:pw@host.org/x mailto:a@b.org")[1]] == ["url", "iban"]
    assert pii.redacted(None) is None and pii.redacted("") == ""


def test_odd_rows(odd, none):
    assert pii.find_pii(odd).count() == odd.count()
    assert pii.find_pii(none).count() == 0
    clean = pii.redact(odd)
    assert clean.columns == odd.columns
    rows = clean.collect()
    assert len(rows) == odd.count() and not any("@c.org" in (r["text"] or "") for r in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
