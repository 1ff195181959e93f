"""PII redaction by candidate gradient boosting.

Generators with high recall propose spans that may overlap: runs around an @, runs of digits
with and without separators, dotted quads, hexadecimal groups between colons, long strings of
letters, digits and the signs of base64, with or without a digit. Boosted trees
judge each by its format (length, kinds of signs, groups, checksum, octets, case, ...) and by its
context (words before it, signs around it). A threshold for each kind, calibrated on the spans of
sentences held out, selects; it is kept between ``FLOOR`` and ``CEILING``, as examples that are easily told
apart would put it anywhere between 0 and 1. Of overlapping spans the one with the highest probability is redacted.

The trees are fitted in the driver to ``examples()``, made up from formats, of a number that is
a parameter. Texts are read whole, row by row; nothing is shuffled.

Defined cases: null texts have null redactions and no spans; the empty text stays empty; texts
without an @, digit, address or long string come back unchanged; equal probabilities go to the longer span, then
the earlier one; rows that repeat are treated alike; offsets count code points; further
columns pass unchanged through ``redact``.
"""

from __future__ import annotations

import ipaddress
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import small_batches
from folioscan.llm.textvec import slices

KINDS = ("email", "phone", "ip", "card", "national_id", "iban", "secret")
EXAMPLES, ROUNDS, DEPTH, PRECISION, FLOOR, CEILING = 8000, 60, 3, 0.995, 0.05, 0.9

_NUMBER = re.compile(r"(?<![\w.])[+(]?\d(?:[ ().\-/]{0,2}\d){5,}(?!\w)")
_PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .\-]?)?\(?\d{2,4}\)?[ .\-]\d{3,4}[ .\-]\d{3,4}(?![\w\-])")
_RUN = re.compile(r"(?<![A-Za-z0-9])\d{8,19}(?![A-Za-z0-9])")
_QUAD = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)")
_IDS = re.compile(r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
_GROUPS = re.compile(r"(?<!\w)(?:[0-9A-Fa-f]{0,4}:){2,7}(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]{0,4})(?![\w:])")
_LONG = re.compile(r"(?<![A-Za-z0-9_\-])[A-Za-z0-9_\-]{20,}(?![A-Za-z0-9_\-])")
_BASE64 = re.compile(r"(?<![A-Za-z0-9_\-+/])[A-Za-z0-9_\-+/]{20,}={0,2}(?![A-Za-z0-9_\-+/])")
_LOCAL = re.compile(r"[\w.+\-%']")
_DOMAIN = re.compile(r"(?:[^\W_][\w\-]*+(?<![_\-])\.)+[^\W\d_]{2,}")
_WORDS = re.compile(r"[^\W\d_]+")

_CUES = (
    ("mail", "email", "contact", "write"), ("phone", "tel", "call", "mobile", "fax", "whatsapp"), ("ip", "host", "server", "address", "login", "client"),
    ("card", "visa", "credit", "payment", "account", "konto", "iban"), ("ssn", "social", "passport", "id", "identity"), ("token", "secret", "key", "password", "api", "passwd", "bearer"),
    ("order", "invoice", "isbn", "issn", "tracking", "item", "part", "serial", "sku", "doi", "commit", "sha", "md5", "hash", "checksum", "id"), ("version", "v", "release", "section", "chapter", "fig", "table", "page"),
    ("total", "population", "year", "price", "eur", "usd", "date", "since", "between", "from"),
)


def proposals(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all that could be personal; spans may overlap."""
    out = set()
    at = text.find("@")
    while at >= 0:
        a = at  # no sign of a local part is an @, so that each is looked at once
        while a and _LOCAL.match(text, a - 1):
            a -= 1
        if a < at and (b := _DOMAIN.match(text, at + 1)):
            out.add(("email", a, b.end()))
        at = text.find("@", at + 1)
    for m in _NUMBER.finditer(text):
        n = sum(map(str.isdigit, m.group()))
        if 7 <= n <= 15:
            out.add(("phone", *m.span()))
        if 13 <= n <= 19:
            out.add(("card", *m.span()))
    out.update(("phone", *m.span()) for m in _PHONE.finditer(text))
    for m in _RUN.finditer(text):
        if len(m.group()) >= 13:
            out.add(("card", *m.span()))
        elif 8 <= len(m.group()) <= 12:
            out.add(("national_id", *m.span()))
    for kind, pattern in (("ip", _QUAD), ("ip", _GROUPS), ("national_id", _IDS), ("iban", _IBAN), ("secret", _LONG), ("secret", _BASE64)):
        out.update((kind, *m.span()) for m in pattern.finditer(text))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def ipv6(s: str) -> bool:
    """Whether these groups are an address of 128 bits."""
    try:
        return bool(ipaddress.IPv6Address(s))
    except ValueError:
        return False


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of one span."""
    s = text[start:end]
    ascii_digits = [c for c in s if "0" <= c <= "9"]
    digits = "".join(ascii_digits)
    n = len(s)
    letters = sum(map(str.isalpha, s))
    groups = re.findall(r"\d+", s)
    freq = [s.count(c) / n for c in set(s)]
    before, after = text[max(0, start - 48) : start], text[end : end + 16]
    words = [w.lower() for w in _WORDS.findall(before)][-4:]
    near = re.search(r"(\S?)(\s*)\Z", before)
    octets = [int(g[:6]) for g in groups]
    quad = len(octets) == 4 and s.count(".") == 3
    hexed = sum(c in "0123456789abcdefABCDEF" for c in s) / n
    first = digits[:1]
    cases = "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-" for c in s)
    return [
        *(float(kind == k) for k in KINDS),
        n, len(digits), letters, n - len(digits) - letters, len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(len(digits) >= 12 and luhn(digits)), float(quad and max(octets) <= 255), float(quad and min(octets[:1]) > 0 and max(octets) > 30),
        float("+" in s), float("(" in s), s.count("-"), s.count("."), s.count(" "), s.count("/"), float("@" in s),
        s.rpartition("@")[2].count(".") if "@" in s else -1, len(s.rpartition("@")[0]) if "@" in s else -1, len(s.rpartition(".")[2]) if "@" in s else -1,
        hexed, -sum(f * math.log2(f) for f in freq), sum(a.isupper() for a in s) / n, float(first.isdigit() and int(first or 0) in (3, 4, 5, 6)),
        s.count(":"), float(kind == "ip" and ":" in s and ipv6(s)), s.count("_"), s.count("="), max(map(len, re.findall("a+", cases)), default=0) / n, sum(a != b for a, b in zip(cases, cases[1:])) / n, sum(c in "aeiouAEIOU" for c in s) / max(1, letters),
        len(set(digits)), float(bool(re.fullmatch(r"(?:19|20)\d\d[ ./\-]\d\d?[ ./\-]\d\d?|\d\d?[ ./\-]\d\d?[ ./\-](?:19|20)\d\d", s))),
        *(float(any(w in cue for w in words)) for cue in _CUES), *(float(bool(words) and words[-1] in cue) for cue in _CUES),
        float(near is not None and near.group(1) == "#"), float(near is not None and near.group(1) in "=:\"'" and near.group(1) != ""), float(near is not None and near.group(1) in "$€£"), float(near is not None and near.group(2) == "" and near.group(1) != ""),
        float(after[:1].isalnum()), float(after[:1] in "\"'"), float(after[:1] == "%" and after[:3] != "%%%"), float(after[1:4].lower() in ("eur", "usd", "km ", "kg ")),
    ]


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _digits(r: random.Random, n: int, first: str = "123456789") -> str:
    return r.choice(first) + "".join(r.choice("0123456789") for _ in range(n - 1))


def _card(r: random.Random, valid: bool) -> str:
    base = _digits(r, 15, "23456")
    return next(base + c for c in "0123456789" if luhn(base + c)) if valid else base + r.choice("0123456789")


def _word(r: random.Random) -> str:
    return "".join(r.choice(["an", "the", "er", "on", "la", "ei", "ch", "os", "ción", "re", "é", "st", "in", "ä", "ur"]) for _ in range(r.randint(1, 4)))


def _ascii_word(r: random.Random, parts: int = 0) -> str:
    return "".join(r.choice(["an", "the", "er", "on", "la", "ei", "ch", "os", "re", "st", "in", "ur", "ing", "al", "ver", "con"]) for _ in range(parts or r.randint(2, 4)))


def examples(count: int = EXAMPLES, seed: int = 5) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, personal) from made-up sentences; what the generators propose besides the planted span counts as not personal where it doesn't overlap it."""
    r = random.Random(seed)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(r.choice(_LETTERS + _LETTERS.upper() + "0123456789") for _ in range(n - 1)) + r.choice("0123456789")
    sep = lambda *xs: r.choice(" -.").join(xs)
    base64 = lambda n: "".join(r.choice(_LETTERS + _LETTERS.upper() + "0123456789+/") for _ in range(n)) + r.choice(["", "", "=", "=="])
    plain = lambda n: "".join(r.choice(_LETTERS + _LETTERS.upper()) for _ in range(n))
    group = lambda: f"{r.randrange(1 << 16):x}"
    groups = lambda n: ":".join(group() for _ in range(n))
    run = lambda sign, n: sign.join(_ascii_word(r) for _ in range(n))
    name = lambda: r.choice([_word(r), _word(r) + r.choice(["", ".", "_", "-"]) + _word(r)])
    octet = lambda: str(r.randint(1, 255))
    yes = {
        "email": lambda: f"{name()}{r.choice(['', '.', ''])}{r.choice(['', _digits(r, r.randint(1, 4))])}@{r.choice(['mail', 'post', 'web', _word(r)])}{r.choice(['', _digits(r, 1)])}.{r.choice(['example.com', 'com', 'org', 'de', 'co.uk', 'example.net'])}",
        "phone": lambda: r.choice([f"+{r.randint(1, 99)} ({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}", f"({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}", f"+{r.randint(30, 99)} {sep(_digits(r, 3), _digits(r, 3), _digits(r, 4))}", sep(_digits(r, 3), _digits(r, 3), _digits(r, 4)), f"+{_digits(r, 11)}", f"0{_digits(r, 3)} {_digits(r, 6)}"]),
        "ip": lambda: r.choice([*[".".join(octet() for _ in range(4))] * 4, groups(8), f"2001:db8:{groups(r.randint(0, 2))}::{groups(r.randint(1, 3))}".replace(":::", "::"), f"fe80::{groups(r.randint(1, 4))}", f"::ffff:{'.'.join(octet() for _ in range(4))}"]),
        "card": lambda: (lambda c: r.choice([c, c, c, " ".join(c[i : i + 4] for i in (0, 4, 8, 12)), "-".join(c[i : i + 4] for i in (0, 4, 8, 12))]))(r.choice([_card(r, True), _digits(r, 16)])),
        "national_id": lambda: f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}",
        "iban": lambda: (lambda b: r.choice([b, " ".join(b[i : i + 4] for i in range(0, len(b), 4))]))(r.choice(["DE", "FR", "ES", "GB", "NL"]) + _digits(r, 2) + _digits(r, r.choice([16, 18, 20]))),
        "secret": lambda: r.choice([hexes(40), hexes(32), hexes(64), mixed(r.randint(24, 48)), "AKIA" + mixed(16).upper(), "AKIA" + "".join(r.choice(_LETTERS.upper() + "0123456789") for _ in range(16)), "ghp_" + mixed(36), base64(r.randint(24, 64)), base64(40), plain(r.randint(20, 48))]),
    }
    lead = {
        "email": ["email ", "contact: ", "mail ", "", "", ""], "phone": ["call ", "tel. ", "phone: ", "", "", ""], "ip": ["from host ", "ip ", "server ", "", "", ""], "card": ["card ", "visa ", "account ", "", "", ""],
        "national_id": ["ssn ", "social ", "id ", "", ""], "iban": ["iban ", "konto ", "", ""], "secret": ["token = \"", "api_key=\"", "secret: ", "password ", "TOKEN = \"", "key '", ""],
    }
    no = [
        lambda: ("version ", f"{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 999)}"), lambda: (r.choice(["order ", "invoice ", "tracking ", "order #", "item id "]), _digits(r, r.randint(8, 16))),
        lambda: (r.choice(["isbn ", "issn "]), f"978-{_digits(r, 1)}-{_digits(r, 4)}-{_digits(r, 4)}-{_digits(r, 1)}"), lambda: (r.choice(["since ", "date ", "on ", ""]), r.choice([f"20{_digits(r, 2)}-0{_digits(r, 1)}-1{_digits(r, 1)}", f"1{_digits(r, 1)}.0{_digits(r, 1)}.19{_digits(r, 2)}", f"2{_digits(r, 1)}/1{r.randint(0, 2)}/20{_digits(r, 2)}"])),
        lambda: (r.choice(["population ", "total $", "price "]), f"{_digits(r, 3)}.{_digits(r, 3)}.{_digits(r, 3)}"), lambda: (r.choice(["commit ", "sha ", "md5 ", "checksum "]), hexes(r.choice([32, 40, 64]))), lambda: ("", "1 2 3 4 5 6 7 8"), lambda: ("between ", f"19{_digits(r, 2)}-20{_digits(r, 2)}"),
        lambda: ("section ", f"{r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(1, 9)}"), lambda: ("", f"{_digits(r, 1)}.{_digits(r, r.randint(7, 12))}"), lambda: ("part ", f"{r.choice('ABCD')}{_digits(r, 3)}-long-name-of-a-part-{_digits(r, 2)}"), lambda: ("total ", _digits(r, r.randint(8, 12))),
        lambda: ("", _word(r) + "-" + _word(r) + "-of-the-long-url-path-" + _digits(r, r.randint(1, 4))), lambda: ("sku ", mixed(22)), lambda: ("serial ", _digits(r, 16)),
        lambda: (r.choice(["", "at ", "key ", "see "]), run(r.choice("-_"), r.randint(4, 8))), lambda: (r.choice(["", "the "]), _ascii_word(r, 8)), lambda: (r.choice(["class ", "", "api "]), "".join(_ascii_word(r).title() for _ in range(r.randint(4, 7)))), lambda: (r.choice(["", "in ", "path "]), r.choice(["/", "/usr/", "https://www.site.example/"]) + run("/", r.randint(4, 8))),
        lambda: ("", r.choice("-_=/+") * r.randint(20, 60)), lambda: ("checksum ", base64(r.choice([24, 43]))), lambda: (r.choice(["at ", "since ", ""]), f"{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}"), lambda: (r.choice(["ratio ", "part "]), ":".join(_digits(r, 1) for _ in range(r.randint(3, 5)))),
        lambda: (r.choice(["device ", "serial ", ""]), ":".join(hexes(2) for _ in range(6))), lambda: (r.choice(["", "a "]), r.choice(["::", "a::b", "::add"])),
    ]
    out = []
    while len(out) < count:
        kind = r.choice(KINDS) if r.random() < 0.55 else None
        front, value = (r.choice(lead[kind]), yes[kind]()) if kind else r.choice(no)()
        back = front[-1] if front[-1:] in ("\"", "'") else r.choice(["", ".", ",", "!!", "$$$", " |", "###"])
        pre = " ".join(_word(r) for _ in range(r.randint(0, 8)))
        text = f"{pre}{' ' if pre else ''}{front}{value}{back} {' '.join(_word(r) for _ in range(r.randint(0, 5)))}"
        a = text.index(front + value) + len(front)
        b = a + len(value)
        for k, s, e in proposals(text):
            good = kind is not None and k == kind and (s, e) == (a, b)
            if good or kind is None or e <= a or s >= b or k != kind:
                out.append((text, k, s, e, int(good)))
    return out[:count]


@dataclass
class Trees:
    """Complete binary trees of one depth: per tree the features and bounds of its inner nodes and the values of its leaves."""

    feature: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, b, v in zip(self.feature, self.bound, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            while len(f) and node[0] < len(f) if len(x) else False:
                node = 2 * node + 1 + (x[rows, f[node]] > b[node])
            z += v[node - len(f)]
        return 1 / (1 + np.exp(-z))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = 0.3, ridge: float = 1.0, bins: int = 32) -> Trees:
    """Gradient boosting for the logistic loss with second-order gains over binned features."""
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1)  # column value > cut b  <=>  bin > b
    z = np.full(len(y), base)
    inner = 2**depth - 1
    features, bounds, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        f, b = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for i in range(inner):
            here = np.flatnonzero(node == i)
            best = 1e-9
            if len(here):
                gs, hs = g[here], h[here]
                whole = gs.sum() ** 2 / (hs.sum() + ridge)
                for k, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(binned[here, k], gs, len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[here, k], hs, len(c) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + ridge) - whole
                    j = int(gain.argmax())
                    if gain[j] > best:
                        best, f[i], b[i] = gain[j], k, c[j]
                node[here] = 2 * i + 1 + (x[here, f[i]] > b[i])
        v = np.zeros(inner + 1)
        at = node - inner
        v = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        z += v[at]
        features.append(f)
        bounds.append(b)
        leaves.append(v)
    return Trees(np.array(features), np.array(bounds), np.array(leaves), base)


@dataclass
class Model:
    trees: Trees
    thresholds: dict[str, float]


def fit(rows: list[tuple[str, str, int, int, int]] | None = None, precision: float = PRECISION) -> Model:
    """Trees from four fifths of the sentences; for each kind the lowest threshold with that precision on the last fifth, within bounds, 0.5 where none has it."""
    rows = examples() if rows is None else rows
    x, y = np.array([features(t, k, a, b) for t, k, a, b, _ in rows]), np.array([float(r[4]) for r in rows])
    sentence: dict[str, int] = {}
    held = np.array([sentence.setdefault(r[0], len(sentence)) % 5 == 0 for r in rows])
    trees = boost(x[~held], y[~held])
    p = trees.probability(x[held])
    thresholds = {}
    for i, kind in enumerate(KINDS):
        mine = x[held][:, i] == 1
        q, t = p[mine], y[held][mine]
        fine = [c for c in np.unique(np.round(q, 3)) if (q >= c).any() and t[q >= c].mean() >= precision]
        thresholds[kind] = float(min(max(min(fine), FLOOR), CEILING)) if fine else 0.5
    return Model(trees, thresholds)


def spans(model: Model, text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, probability) of what is to be redacted, in order."""
    found = proposals(text) if text else []
    if not found:
        return []
    p = model.trees.probability(np.array([features(text, *s) for s in found]))
    chosen: list[tuple[str, int, int, float]] = []
    for i in sorted(range(len(found)), key=lambda i: (-round(p[i], 6), found[i][1] - found[i][2], found[i][1], found[i][0])):
        kind, a, b = found[i]
        if p[i] >= model.thresholds[kind] and all(b <= c or a >= d for _, c, d, _ in chosen):
            chosen.append((kind, a, b, round(float(p[i]), 6)))
    return sorted(chosen, key=lambda s: s[1])


def redacted(text: str, found: list[tuple[str, int, int, float]]) -> str:
    """The text with [KIND] in place of each span."""
    out, at = [], 0
    for kind, a, b, _ in found:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def _column(model: Model):
    kind = pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])))])

    @F.arrow_udf("struct<text:string,spans:array<struct<kind:string,start:int,end:int,probability:double>>>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            out = []
            for t in (t for texts in slices(part) for t in texts):
                s = spans(model, t)
                out.append({"text": None if t is None else redacted(t, s), "spans": [{"kind": k, "start": a, "end": b, "probability": p} for k, a, b, p in s]})
            yield pa.array(out, type=kind)

    return run


def redactions(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, redacted, spans, n_spans) of the rows in which something is redacted."""
    r = small_batches(docs).select("doc_id", _column(model or fit())("text").alias("r")).filter(F.size("r.spans") > 0)
    return r.select("doc_id", F.col("r.text").alias("redacted"), F.col("r.spans").alias("spans"), F.size("r.spans").alias("n_spans"))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Every row of ``docs``, its text redacted."""
    return small_batches(docs).withColumn("text", _column(model or fit())("text")["text"])
