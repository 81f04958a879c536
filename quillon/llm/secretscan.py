"""Secrets: rules propose candidates, a character convolutional network judges each in its context.

Three kinds have base spans, which always stay: values assigned to a cue, access key ids and long hexadecimal runs. Further
candidates are key blocks, links with credentials, values after wider cues and tokens that mix letters and digits. The
network, plain NumPy, reads each candidate whole with the characters around it: one convolution over characters, told
apart by whether they stand inside the candidate, the maximum of each filter before, in and behind it, and two dense
layers. It is trained here on labelled findings, rendered into paragraphs of the corpus. A temperature from held-out findings
calibrates its probabilities; each kind's threshold is the highest that keeps the stated recall on them.
"""

from __future__ import annotations

import hashlib
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.arrow import id_and_text, map_batches, text_column

# Kinds in the order of results, base kinds first.
BASE = ("assign", "access", "hex")
ADDED = ("block", "link", "value", "token")

# Patterns of the base kinds.
_ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----")
_LINK = re.compile(r"://[^\s:/@\"'<>]+:([^\s@/\"'<>]+)@")
_VALUE = re.compile(
    r"(?ai:\b(?:pwd|pass(?:phrase|code)?|auth(?:orization)?|bearer|credentials?|(?:private|access|signing|encryption)[ _-]?key|(?:api|client|auth)[ _-]?(?:key|token|secret)|conn(?:ection)?[ _-]?str(?:ing)?)\b)"
    r"[\"']?(?:\s?[:=]|\s(?=\S*[0-9]))\s?[\"']?([A-Za-z0-9+/_.=~!$%^*-]{8,})"
)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")

#: Characters of context before and behind a candidate, width and number of filters, width of characters and dense layer.
_BEFORE, _BEHIND, _WIDTH, _FILTERS, _DIMS, _HIDDEN = 32, 16, 5, 32, 12, 24
#: Classes of characters: end, white space, other non-ASCII letters, all others, then printable ASCII.
_CLASSES = 4 + 95
#: Positions convolved at a time.
_STEP = 1 << 15

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Base spans: of each kind leftmost and non-overlapping, failing matches dropped without a retry; by start, then kind."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return _sorted(found)


def _sorted(spans: list[Span]) -> list[Span]:
    order = {k: i for i, k in enumerate(BASE + ADDED)}
    return sorted(spans, key=lambda s: (s[1], order[s[0]], s[2]))


def further_candidates(text: str, base: list[Span]) -> list[Span]:
    """Candidates that overlap no base span, none another: the kind listed first wins, then the first."""
    found: list[Span] = []
    if "-----BEGIN " in text:
        for m in _BLOCK.finditer(text):
            tail = text.find("-----END ", m.end())
            stop = text.find("-----", tail + 9) + 5 if tail >= 0 else -1
            again = text.find("-----BEGIN ", m.end(), max(tail, m.end()))
            found.append(("block", m.start(), stop if stop > tail + 9 and again < 0 else m.end()))
    if "://" in text:
        found += [("link", *m.span(1)) for m in _LINK.finditer(text)]
    found += [("value", *m.span(1)) for m in _VALUE.finditer(text)]
    found += [("token", *m.span()) for m in _TOKEN.finditer(text) if _DIGIT.search(m[0]) and _LETTER.search(m[0])]
    if not found:
        return []
    return _free(found, base)


def _free(found: list[Span], taken: list[Span]) -> list[Span]:
    """Those of ``found`` that meet neither ``taken`` nor one kept before them."""
    import bisect

    starts = sorted((a, b) for _, a, b in taken)
    # Base spans of different kinds may overlap, so ends are made to grow.
    edges, top = [], 0
    for a, b in starts:
        top = max(top, b)
        edges.append((a, top))
    kept: list[Span] = []
    order = {k: i for i, k in enumerate(ADDED)}
    for kind, a, b in sorted(found, key=lambda s: (order[s[0]], s[1])):
        i = bisect.bisect_left(edges, (b, 0))
        if i and edges[i - 1][1] > a:
            continue
        bisect.insort(edges, (a, max(b, edges[i - 1][1] if i else 0)))
        kept.append((kind, a, b))
    return _sorted(kept)


def _class_table() -> np.ndarray:
    table = np.full(0x110000, 3, np.uint8)
    table[[cp for cp in range(128, 0x3000) if chr(cp).isalpha()]] = 2
    table[[9, 10, 11, 12, 13, 0x85, 0xA0]] = 1
    table[32:127] = np.arange(95) + 4
    return table


_TABLE = _class_table()


def codes_of(text: str, start: int, end: int) -> np.ndarray:
    """Numbers of a candidate's characters and of those around it; a gap of ends follows, so that no filter sees what comes next."""
    left, right = text[max(0, start - _BEFORE) : start], text[end : end + _BEHIND]
    inner = _TABLE[np.frombuffer(text[start:end].encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64) + _CLASSES
    out = np.zeros(_BEFORE + len(inner) + _BEHIND + _WIDTH, np.int64)
    out[_BEFORE - len(left) : _BEFORE] = _TABLE[np.frombuffer(left.encode("utf-32-le", "surrogatepass"), np.uint32)]
    out[_BEFORE : _BEFORE + len(inner)] = inner
    out[_BEFORE + len(inner) : _BEFORE + len(inner) + len(right)] = _TABLE[np.frombuffer(right.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return out


@dataclass
class SecretModel:
    """``taps`` hold what each character adds to each filter at each place of the convolution; then two dense layers."""

    taps: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    heat: float
    thresholds: dict[str, float]

    def _pooled(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The maximum of each filter over each region; codes are convolved piece by piece, whatever their length."""
        best = np.full((len(starts), _FILTERS), -np.inf, np.float32)
        n = len(codes)
        codes = np.concatenate((codes, np.zeros(_WIDTH, np.int64)))
        for a in range(0, n, _STEP):
            b = min(a + _STEP, n)
            y = self.taps[0][codes[a:b]].copy()
            for j in range(1, _WIDTH):
                y += self.taps[j][codes[a + j : b + j]]
            first, last = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")
            part = np.maximum.reduceat(y, np.maximum(starts[first:last] - a, 0), axis=0)
            best[first:last] = np.maximum(best[first:last], part)
        return best

    def logits(self, codes: list[np.ndarray]) -> np.ndarray:
        if not codes:
            return np.zeros(0)
        sizes = np.array([len(c) for c in codes])
        inner = sizes - _BEFORE - _BEHIND - _WIDTH
        at = np.cumsum(sizes) - sizes
        starts = np.stack((at, at + _BEFORE, at + _BEFORE + inner, at + _BEFORE + inner + _BEHIND), axis=1).ravel()
        pooled = self._pooled(np.concatenate(codes), starts).reshape(len(codes), 4, _FILTERS)[:, :3]
        x = np.maximum(pooled + self.bias, 0).reshape(len(codes), -1)
        x = np.concatenate((x, _length(inner)), axis=1)
        return np.maximum(x @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias

    def probabilities(self, text: str, spans: list[Span]) -> np.ndarray:
        """How likely each candidate of a text is a secret."""
        out, part, held = [], [], 0
        for _, a, b in spans:
            part.append(codes_of(text, a, b))
            held += b - a
            if held > _STEP:
                out.append(self.logits(part))
                part, held = [], 0
        out.append(self.logits(part))
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out) / self.heat, -30, 30)))

    def findings(self, text: str | None) -> tuple[list[Span], list[tuple[Span, float]]]:
        """Base spans, and all spans with their probabilities; null counts as empty."""
        text = text or ""
        base = base_spans(text)
        more = further_candidates(text, base)
        if not base and not more:
            return [], []
        p = self.probabilities(text, base + more).tolist()
        kept = {s: x for s, x in zip(base + more, p) if s[0] in BASE or x >= self.thresholds[s[0]]}
        return base, [(s, kept[s]) for s in _sorted(list(kept))]


def _length(inner: np.ndarray) -> np.ndarray:
    return (np.log2(inner[:, None] + 1) / 8).astype(np.float32)


# Labelled findings. Places to fill: {v} is the value; all else is as written.
# How secrets stand in texts, by kind of candidate.
_FRAMES = {
    "token": ("{v}", "use {v} to log in", "export KEY {v}", "curl -H 'X-Auth {v}'", "({v})", "key {v},", "Bearer\n{v}", "set {v} in the header"),
    "value": ("pwd: {v}", "passphrase = {v}", "Authorization: {v}", "client-secret = \"{v}\"", "access key: {v}", "connection string = {v}", "credentials: {v}", "auth={v}", "private_key='{v}'", "bearer {v}"),
    "link": ("postgres://app:{v}@db.internal/x", "https://ci:{v}@host.example.org/r.git", "amqp://svc:{v}@10.0.0.7:5672", "redis://default:{v}@cache:6379"),
}
# What stands there harmlessly.
_PLAIN_FRAMES = {
    "token": ("sha256 {v}", "commit {v}", "see https://example.org/{v}", "id {v}", "file {v}", "{v}", "checksum {v}", "isbn {v}", "data:image/png;base64,{v}"),
    "value": ("pass: {v}", "auth: {v}", "credentials: {v}", "access key: {v}", "authorization = {v}", "pwd: {v}", "passcode: {v}"),
    "link": ("http://user:{v}@host", "ftp://anonymous:{v}@ftp.example.org", "https://login:{v}@example.org"),
}
# Stand-ins and plain words where a secret could stand.
_STAND_INS = ("required", "disabled", "everything", "your_password_here", "xxxxxxxxxxxxxxxx", "changeme", "example-value", "none.needed", "password", "anonymous", "${PASSWORD}", "YOUR-KEY-GOES-HERE-0000", "********", "placeholder1", "optional", "see-the-manual", "forgotten", "123456789012345", "undefined", "localhost")

_ALNUM = string.ascii_letters + string.digits


def _draw(rng: np.random.Generator, alphabet: str, n: int) -> str:
    return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))


def _secret(rng: np.random.Generator, kind: str) -> str:
    """A value in one of the public formats of keys and tokens, or a made-up password."""
    b64 = _ALNUM + "+/"
    if kind == "token":
        jwt = "eyJ" + ".".join((_draw(rng, _ALNUM + "_-", 24), "eyJ" + _draw(rng, _ALNUM + "_-", int(rng.integers(20, 80))), _draw(rng, _ALNUM + "_-", 43)))
        forms = ("ghp_" + _draw(rng, _ALNUM, 36), "xoxb-" + _draw(rng, string.digits, 11) + "-" + _draw(rng, _ALNUM, 24), "sk_live_" + _draw(rng, _ALNUM, 24), "AIza" + _draw(rng, _ALNUM + "_-", 35), jwt, _draw(rng, b64, 40), "glpat-" + _draw(rng, _ALNUM + "_-", 20), "npm_" + _draw(rng, _ALNUM, 36), _draw(rng, _ALNUM, int(rng.integers(20, 65))), _draw(rng, b64, 86) + "==")
        return forms[rng.integers(0, len(forms))]
    if rng.random() < 0.4:
        return _draw(rng, _ALNUM, int(rng.integers(10, 41)))
    return _draw(rng, _ALNUM + "_.=+-" + ("!$%^*" if kind == "value" else ""), int(rng.integers(10, 25)))


def _harmless(rng: np.random.Generator, kind: str, words: list[str]) -> str:
    """A value that looks like one, but is a number, a name, a path, a checksum or a stand-in."""
    def some(n: int) -> list[str]:
        return [words[i] for i in rng.integers(0, len(words), n)]

    if kind != "token" or rng.random() < 0.1:
        return _STAND_INS[rng.integers(0, len(_STAND_INS))] if rng.random() < 0.6 else rng.choice(["-", "_", "."]).join(some(2))
    hexes = "0123456789abcdef"
    forms = (
        "-".join(_draw(rng, hexes, n) for n in (8, 4, 4, 4, 12)), _draw(rng, hexes.upper(), 40), "_".join(some(3)) + f"_{rng.integers(0, 99)}", "/".join(some(3)) + f"/{rng.integers(2000, 2030)}.html",
        "".join(w.capitalize() for w in some(3)) + f"V{rng.integers(1, 30)}", f"20{rng.integers(10, 30)}-0{rng.integers(1, 9)}-1{rng.integers(0, 9)}T0{rng.integers(0, 9)}:00", f"{'-'.join(some(3))}-{rng.integers(1, 9)}.{rng.integers(0, 20)}.tar.gz",
        f"{some(1)[0]}.{rng.integers(1, 99)}.example.com/{some(1)[0]}", "iVBORw0KGgo" + _draw(rng, _ALNUM + "+/", int(rng.integers(60, 200))), f"978-{rng.integers(0, 9)}-{rng.integers(10000, 99999)}-{rng.integers(100, 999)}-x", "=" * 20 + "x1", f"{some(1)[0]}{'.' * 18}{rng.integers(1, 300)}",
        _draw(rng, hexes, 31),
    )
    return forms[rng.integers(0, len(forms))]


def _block(rng: np.random.Generator, secret: bool, words: list[str]) -> str:
    name = rng.choice(["", "RSA ", "EC ", "OPENSSH "])
    if secret:
        body = "\n".join(_draw(rng, _ALNUM + "+/", 64) for _ in range(int(rng.integers(2, 7))))
        return f"-----BEGIN {name}PRIVATE KEY-----\n{body}\n-----END {name}PRIVATE KEY-----"
    inner = rng.choice(["...", "<your key>", " ".join(words[i] for i in rng.integers(0, len(words), 12)), "MII..."])
    return f"-----BEGIN {name}PRIVATE KEY-----\n{inner}\n-----END {name}PRIVATE KEY-----" if rng.random() < 0.6 else f"-----BEGIN {name}PRIVATE KEY----- {inner}"


def labelled_findings(paragraphs: list[str], each: int, seed: int = 11) -> list[tuple[str, str, np.ndarray, bool]]:
    """Kind, value, codes and label of candidates: ``each`` secrets and as many harmless ones of each kind, within paragraphs.

    Base candidates take their labels from how they were rendered as well: a random value is a secret, a stand-in none.
    """
    rng = np.random.default_rng(seed)
    words = sorted({w for p in paragraphs for w in re.findall(r"[A-Za-z]{3,12}", p)})[:20_000] or ["some", "plain", "words"]
    out = []
    for kind in (*BASE, *ADDED):
        for label in (True, False):
            for _ in range(each):
                if kind == "assign":
                    cue = rng.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "Token", "API_KEY"])
                    value = _secret(rng, "token") if label else re.sub(r"[^A-Za-z0-9+/_.=-]", "x", _harmless(rng, "value", words)).ljust(8, "x")
                    text = rng.choice(['{c} = "{v}"', "{c}: {v}", "{c}={v}", '"{c}": "{v}"']).format(c=cue, v=value)
                elif kind == "access":
                    value = "AKIA" + (_draw(rng, string.ascii_uppercase + "234567", 16) if label else rng.choice(["EXAMPLEEXAMPLE", "XXXXXXXXXXXXXXXX", "SANDTHEOTHERS", "0000000000000000"]))
                    text = rng.choice(["{v}", "key {v}", "aws: {v}"]).format(v=value)
                elif kind == "hex":
                    value = _draw(rng, "0123456789abcdef", int(rng.choice([32, 40, 64])))
                    text = rng.choice(["key = {v}", "hmac {v}", "secret key {v}"] if label else ["commit {v}", "md5 {v}", "sha1: {v}", "etag {v}"]).format(v=value)
                elif kind == "block":
                    value = text = _block(rng, label, words)
                else:
                    frames = (_FRAMES if label else _PLAIN_FRAMES)[kind]
                    value = _secret(rng, kind) if label else _harmless(rng, kind, words)
                    text = frames[rng.integers(0, len(frames))].format(v=value)
                around = paragraphs[rng.integers(0, len(paragraphs))] if paragraphs else ""
                middle = int(rng.integers(0, len(around) + 1))
                front = around[:middle] + rng.choice([" ", "\n", ". "])
                whole = front + text + rng.choice([" ", "\n", ", "]) + around[middle:]
                base = base_spans(whole)
                for k, a, b in [*base, *further_candidates(whole, base)]:
                    if k == kind and a < len(front) + len(text) and b > len(front) and b - a <= 512:
                        out.append((kind, whole[a:b], codes_of(whole, a, b), label))
                        break
    return out


def _fit(codes: list[np.ndarray], y: np.ndarray, rounds: int, rate: float, penalty: float, seed: int) -> SecretModel:
    """Minibatches of Adam on the logistic loss; the gradient of a maximum goes to the place that attains it."""
    rng = np.random.default_rng(seed)
    n, rows = len(codes), 2 * _CLASSES
    w = {
        "chars": rng.normal(0, 0.5, (rows, _DIMS)), "kernel": rng.normal(0, 1 / np.sqrt(_WIDTH * _DIMS), (_WIDTH, _DIMS, _FILTERS)), "bias": np.zeros((3, _FILTERS)),
        "hidden": rng.normal(0, 1 / np.sqrt(3 * _FILTERS + 1), (3 * _FILTERS + 1, _HIDDEN)), "hidden_bias": np.zeros(_HIDDEN), "out": rng.normal(0, 1 / np.sqrt(_HIDDEN), _HIDDEN), "out_bias": np.zeros(1),
    }
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    inner = np.array([len(c) for c in codes]) - _BEFORE - _BEHIND - _WIDTH
    order, t = np.argsort(inner, kind="stable"), 0
    groups = [order[i : i + 128] for i in range(0, n, 128)]  # of like lengths, so that little is padded
    for _ in range(rounds):
        for g in rng.permutation(len(groups)):
            rows_ = groups[g]
            long = int(inner[rows_].max()) + _BEFORE + _BEHIND
            x = np.zeros((len(rows_), long + _WIDTH), np.int64)
            for i, r in enumerate(rows_):
                x[i, : len(codes[r])] = codes[r][: long + _WIDTH]
            taps = np.einsum("cd,jdf->jcf", w["chars"], w["kernel"]).astype(np.float32)
            conv = taps[0][x[:, :long]].copy()
            for j in range(1, _WIDTH):
                conv += taps[j][x[:, j : j + long]]
            place = np.arange(long)[None, :]
            stop = _BEFORE + inner[rows_][:, None]
            regions = (place < _BEFORE, (place >= _BEFORE) & (place < stop), (place >= stop) & (place < stop + _BEHIND))
            at = [np.where(mask[:, :, None] if mask.shape[0] > 1 else np.broadcast_to(mask, x[:, :long].shape)[:, :, None], conv, -np.inf).argmax(axis=1) for mask in regions]
            tops = np.stack([np.take_along_axis(conv, a[:, None, :], axis=1)[:, 0] for a in at], axis=1) + w["bias"]
            flat = np.concatenate((np.maximum(tops, 0).reshape(len(rows_), -1), _length(inner[rows_])), axis=1)
            pre = flat @ w["hidden"] + w["hidden_bias"]
            hid = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(hid @ w["out"] + w["out_bias"], -30, 30)))
            d = (p - y[rows_]) / len(rows_)
            grad = {"out": hid.T @ d, "out_bias": d.sum(keepdims=True)}
            dh = d[:, None] * w["out"][None, :] * (pre > 0)
            grad["hidden"], grad["hidden_bias"] = flat.T @ dh, dh.sum(axis=0)
            dt = (dh @ w["hidden"].T)[:, :-1].reshape(tops.shape) * (tops > 0)
            grad["bias"] = dt.sum(axis=0)
            dtaps = np.zeros((_WIDTH, rows * _FILTERS))
            filters = np.arange(_FILTERS)[None, :]
            for k in range(3):
                for j in range(_WIDTH):
                    seen = np.take_along_axis(x, at[k] + j, axis=1)
                    dtaps[j] += np.bincount((seen * _FILTERS + filters).ravel(), dt[:, k].ravel(), rows * _FILTERS)
            dtaps = dtaps.reshape(_WIDTH, rows, _FILTERS)
            grad["chars"] = np.einsum("jcf,jdf->cd", dtaps, w["kernel"])
            grad["kernel"] = np.einsum("cd,jcf->jdf", w["chars"], dtaps)
            t += 1
            for name, value in w.items():
                step = grad[name] + penalty * value
                m1[name] = 0.9 * m1[name] + 0.1 * step
                m2[name] = 0.999 * m2[name] + 0.001 * step * step
                value -= rate * (m1[name] / (1 - 0.9**t)) / (np.sqrt(m2[name] / (1 - 0.999**t)) + 1e-8)
    taps = np.einsum("cd,jdf->jcf", w["chars"], w["kernel"]).astype(np.float32)
    small = {k: w[k].astype(np.float32) for k in ("bias", "hidden", "hidden_bias", "out")}
    return SecretModel(taps, small["bias"], small["hidden"], small["hidden_bias"], small["out"], float(w["out_bias"][0]), 1.0, dict.fromkeys(BASE + ADDED, 0.5))


def train(docs: DataFrame, sample: int = 1000, paragraph_chars: int = 400, each: int = 300, rounds: int = 20, recall: float = 0.95, rate: float = 3e-3, penalty: float = 1e-5) -> SecretModel:
    """Learn from labelled findings within a paragraph of each of at most ``sample`` documents.

    Documents are drawn by a hash of doc_id, on the executors; ``paragraph_chars`` characters of one line of each come to the
    driver. ``each`` secrets and as many harmless candidates of each kind are rendered into them; every fourth is held out
    for the temperature and for the thresholds, each the highest that keeps ``recall`` of its kind's secrets there. Rows with null doc_id or text teach nothing, repeated doc_ids once. Works on an empty table too.
    """
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null").withColumn("h", F.xxhash64("doc_id"))
    n = drawn.count()
    share = min(1.0, max(1.5 * sample, 100) / max(n, 1))  # half as many again as are wanted, before any task sends rows
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    picked = drawn.filter(F.pmod("h", F.lit(1 << 30)) < F.lit(share * (1 << 30))).select("doc_id", "h", lines.alias("l")).filter(F.size("l") > 0)
    examples = picked.select("doc_id", "h", F.substring(F.element_at("l", F.pmod("h", F.size("l")).cast("int") + 1), 1, paragraph_chars).alias("p")).groupBy("doc_id", "h").agg(F.min("p").alias("p"))
    return fitted([r["p"] for r in examples.orderBy("h", "doc_id").limit(sample).collect()], each, rounds, recall, rate, penalty)


def fitted(paragraphs: list[str], each: int = 300, rounds: int = 20, recall: float = 0.95, rate: float = 3e-3, penalty: float = 1e-5) -> SecretModel:
    """The model of labelled findings within these paragraphs."""
    found = labelled_findings(paragraphs, each)
    y = np.array([label for *_, label in found], float)
    held = np.arange(len(found)) % 4 == 3
    model = _fit([c for (_, _, c, _), h in zip(found, held) if not h], y[~held], rounds, rate, penalty, 7)
    kinds = np.array([k for k, *_ in found])[held]
    raw, truth = model.logits([c for (_, _, c, _), h in zip(found, held) if h]), y[held] > 0
    model.heat = float(min(np.geomspace(0.5, 5, 40), key=lambda t: np.logaddexp(0, np.where(truth, -raw, raw) / t).mean()))
    p = 1 / (1 + np.exp(-raw / model.heat))
    for kind in model.thresholds:
        right = np.sort(p[truth & (kinds == kind)])
        # All but the share that may be missed lie at or above it.
        model.thresholds[kind] = float(right[int((1 - recall) * len(right))]) if len(right) else 0.5
    return model


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, model: SecretModel) -> DataFrame:
    """Secrets of every whole text, one row for each row of ``docs``.

    Returns doc_id; n_assign, n_access, n_hex and base_sha256 of the base spans; spans, all of them, by start, then kind;
    n_added; top_score, the largest probability of any, null without spans. Places count code points, ends are exclusive.
    Null counts as empty; repeated rows are searched each; null ids stay null; further columns are ignored; an empty table
    gives no rows. No shuffle.
    """

    def make(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": batch.column("doc_id"), **{f"n_{k}": [] for k in BASE}, "base_sha256": [], "spans": [], "n_added": [], "top_score": []}
        for text in batch.column("text").to_pylist():
            base, found = model.findings(text)
            for k in BASE:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined([s for s, _ in found]))
            out["n_added"].append(len(found) - len(base))
            out["top_score"].append(max((p for _, p in found), default=None))
        return out

    return map_batches(id_and_text(docs), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long, top_score double")


def findings(docs: DataFrame, model: SecretModel) -> DataFrame:
    """Every finding: doc_id, kind, start, end, probability, and value_sha256 in place of the value itself.

    Null and empty texts have none; repeated rows are searched each; null ids stay null; an empty table gives no rows.
    """

    def make(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("doc_id", "kind", "start", "end", "probability", "value_sha256")}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            for (kind, a, b), p in model.findings(text)[1]:
                value = hashlib.sha256(text[a:b].encode("utf-8", "surrogatepass")).hexdigest()
                for name, x in zip(out, (doc_id, kind, a, b, p, value)):
                    out[name].append(x)
        return out

    return map_batches(id_and_text(docs), make, "doc_id long, kind string, start long, end long, probability double, value_sha256 string")


def redact(docs: DataFrame, model: SecretModel) -> DataFrame:
    """``docs`` with each secret replaced by ``[SECRET]``; overlapping ones become one; null texts and other columns stay."""

    def clean(texts: list[str | None]) -> list[str | None]:
        out = []
        for text in texts:
            parts, at, until = [], 0, 0
            for (_, a, b), _ in model.findings(text)[1]:
                if a >= until:
                    parts += [text[at:a], "[SECRET]"]
                until = at = max(until, b)
            out.append("".join(parts) + text[at:] if parts else text)
        return out

    return docs.withColumn("text", text_column(F.col("text").cast("string"), clean, "string"))
