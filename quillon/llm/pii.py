"""Personal data by anchor expansion.

One Aho-Corasick pass over a text in lower case finds the anchors: at-signs, plus signs, digits, schemes and identifier cues. At each
anchor a deterministic local parser expands to the span's boundaries and validates it. Kinds email, ip, card and phone
have base spans: leftmost, non-overlapping within their kind, failing ones dropped without a retry. To these the
method adds what a retry at an inner boundary finds (kinds card and phone), links that carry credentials (kind url),
IBANs (kind iban) and values after an identifier cue (kind account).
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.arrow import id_and_text, kept, map_batches, text_column

# Kinds in the order of results, base kinds first.
BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "account")

# Anchors.
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("iban", "token", "api_key", "api-key", "api key", "apikey", "secret", "password", "passwd", "account", "acct")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"(?i:https?|ftp)://[A-Za-z0-9._%~-]+:[^\s@/:]+@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s<>\"']*)?")
_IBAN = re.compile(r"[\s:=#]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
# A noun may stand between a cue and its mark. Values are of eight characters or more, in parts joined by dots and the like.
_VALUE = re.compile(r"(?:[ _-]?(?i:numbers?|nr|no|id|key|code|value)\b\.?)?[\"']?\s?[:=#]\s?[\"']?((?=[A-Za-z0-9._~+/-]{8})[A-Za-z0-9_-]+(?:[._~+/][A-Za-z0-9_-]+)*={0,2})")
_UPPER = {i: i + 32 for i in range(65, 91)}
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the digits' check digit is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def iban_is_valid(value: str) -> bool:
    """Whether the remainder by 97 is one."""
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, words in (("@", "@"), ("+", "+"), ("d", "0123456789"), ("s", SCHEMES), ("c", CUES)):
        for w in words:
            out.add_word(w, (kind, len(w)))
    out.make_automaton()
    return out


class Finder:
    """Finds spans in one text after another."""

    def __init__(self):
        self.anchors = _automaton()

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """Base and added spans, each by kind as listed, then by start. Ends are exclusive; null counts as empty."""
        text = text or ""
        low = text.lower()
        if len(low) != len(text):  # a rare letter got longer
            low = text.translate(_UPPER)
        base: dict[str, list[Span]] = {k: [] for k in BASE}
        added: dict[str, list[Span]] = {k: [] for k in BASE + ADDED}
        email_end = ip_end = card_end = phone_end = url_end = iban_end = 0
        for last, (kind, size) in self.anchors.iter(low):
            at = last - size + 1
            if kind == "d":
                if at >= card_end and (m := _DIGITS.match(text, at)):
                    card_end = m.end()
                    n = len(digits := m[0].replace(" ", "").replace("-", ""))
                    if 16 <= n <= 19 and luhn(digits):
                        base["card"].append(("card", at, card_end))
                    elif n > 16:
                        added["card"] += _inner_cards(text, at, card_end)
                if at >= ip_end and (at == ip_end or not "0" <= text[at - 1 : at] <= "9") and (m := _IP.match(text, at)):
                    ip_end = m.end()
                    if all(len(g.lstrip("0")) <= 3 and int(g) <= 255 for g in m.groups()):
                        base["ip"].append(("ip", at, ip_end))
            elif kind == "@":
                start = at
                while start > email_end and text[start - 1] in _LOCAL_CHARS:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at)):
                    email_end = m.end()
                    base["email"].append(("email", start, email_end))
            elif kind == "+":
                if at >= phone_end and (m := _PHONE.match(text, at)):
                    phone_end = m.end()
                    n = sum(c.isdigit() for c in m[0])
                    if 8 <= n <= 15:
                        base["phone"].append(("phone", at, phone_end))
                    elif n > 15 and (end := _inner_phone(text, at, phone_end)):
                        added["phone"].append(("phone", at, end))
            elif kind == "s":
                if at >= url_end and (m := _URL.match(text, at)):
                    url_end = m.end()
                    added["url"].append(("url", at, url_end))
            elif low.startswith("iban", at):
                if (m := _IBAN.match(text, last + 1)) and m.start(1) >= iban_end:
                    value = m[1]
                    while not iban_is_valid(value) and " " in value:  # capitals or digits may follow it
                        value = value.rpartition(" ")[0]
                    if iban_is_valid(value):
                        iban_end = m.start(1) + len(value)
                        added["iban"].append(("iban", m.start(1), iban_end))
            elif (m := _VALUE.match(text, last + 1)) and len(m[1]) >= 8 and any(c.isdigit() for c in m[1]):
                if not added["account"] or added["account"][-1][2] <= m.start(1):
                    added["account"].append(("account", m.start(1), m.end(1)))
        return [s for k in BASE for s in base[k]], [s for k in BASE + ADDED for s in added[k]]


def _inner_cards(text: str, start: int, end: int) -> list[Span]:
    """Card numbers made of whole groups of a run of digits that is none itself."""
    groups = [(m.start() + start, m.end() + start) for m in re.finditer(r"[0-9]+", text[start:end])]
    out, i = [], 0
    while i < len(groups):
        digits = ""
        for j in range(i, len(groups)):
            digits += text[slice(*groups[j])]
            if len(digits) > 19:
                break
            if len(digits) >= 16 and luhn(digits):
                out.append(("card", groups[i][0], groups[j][1]))
                i = j
                break
        i += 1
    return out


def _inner_phone(text: str, start: int, end: int) -> int:
    """End of the longest beginning of a too long phone number that stops at a blank and has 8 to 15 digits; or 0."""
    best = n = 0
    for i in range(start, end):
        if text[i].isdigit():
            n += 1
            if n > 15:
                break
            if n >= 8 and text[i + 1 : i + 2] == " ":
                best = i + 1
    return best


def finder() -> Finder:
    return kept("finder", Finder)


def _joined(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(BASE + ADDED)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def find_pii(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every whole text.

    Returns doc_id; n_email, n_ip, n_card, n_phone and base_sha256 of the base spans; spans, all of them. Places count
    code points. Null counts as empty; repeated rows are searched each; null ids stay null; further columns are ignored;
    an empty table gives no rows. Spans of different kinds may overlap; spans of one kind never do: the first wins.
    """

    def make(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": batch.column("doc_id"), "base_sha256": [], "spans": [], **{f"n_{k}": [] for k in BASE}}
        find = finder().spans
        for text in batch.column("text").to_pylist():
            base, added = find(text)
            for k in BASE:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(base + added))
        return out

    return map_batches(id_and_text(docs), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    if not text:
        return text
    base, added = finder().spans(text)
    out, at, until = [], 0, 0
    for kind, start, end in sorted(base + added, key=lambda s: (s[1], -s[2])):
        if start >= until:
            out += [text[at:start], f"[{kind.upper()}]"]
        until = at = max(until, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with redacted texts and, where there is such a column, the new n_chars; all else stays, null texts too."""

    def clean(texts: list[str | None]) -> list[str | None]:
        return [redacted(t) for t in texts]

    out = docs.withColumn("text", text_column(F.col("text").cast("string"), clean, "string"))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
