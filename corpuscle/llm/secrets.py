"""Secret scans: candidates by expression, false positives removed by a random forest.

Candidates are cast wide: what is issued in a known form, what is assigned to a telling name, and any
opaque run of letters and digits or of digits alone. The forest sees a candidate's length, its character
transitions, how far dictionary words cover it, the path, and the neighbouring words. It is trained from
labelled findings: rows of (before, value, after, path, label); labelled_findings() makes a set of many
families of values, users may pass their own. The dictionary is the list of whole words of a public
tokenizer's vocabulary (its path is a parameter), so it shares nothing with the generator.

Edge cases: null and empty texts have no findings; repeated rows each get their findings; a null path
is the empty path; an empty table gives an empty table; columns besides the text, the id and the path
are not read by scan(), and are kept by redact() whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import forest
from corpuscle.llm.bpe import default_tokenizer
from corpuscle.llm.common import trim

CONTEXT = 48
THRESHOLD = 0.5
#: Alternatives in order of trust; the secret itself is the group of that name.
CANDIDATE = re.compile(
    r"(?P<aws>\b(?:AKIA|ASIA)[0-9A-Z]{16}\b)"
    r"|(?P<forge>\b(?:gh[pousr]_|glpat-|npm_|pypi-|sk_live_|rk_live_|SG\.|AIza)[A-Za-z0-9_.-]{16,})"
    r"|(?P<chat>\bxox[abprs]-[A-Za-z0-9-]{10,})"
    r"|(?P<signed>\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"
    r"|(?P<private>-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?)"
    r"|://[^\s:/@]{1,64}:(?P<login>[^\s:/@]{6,})@"
    r"|(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?\s{0,3}[:=]\s{0,3}[\"']?(?P<assigned>[A-Za-z0-9+/_=!@$%^&*.-]{8,})"
    r"|(?P<number>(?<![A-Za-z0-9+/_=-])[0-9][0-9-]{11,}(?![A-Za-z0-9+/_=-]))"
    r"|(?P<opaque>(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]{0,64}[0-9])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-]))",
    re.I,
)
#: A text without a digit and without any of these has no candidate; this is a cheap first look.
HINTS = ("akia", "asia", "gh", "glpat", "npm_", "pypi", "k_live_", "sg.", "aiza", "xox", "eyj", "begin ", "://", "passw", "pwd", "secret", "token", "key", "auth")
DIGIT = re.compile("[0-9]")
KINDS = ("aws", "forge", "chat", "signed", "private", "login", "assigned", "number", "opaque")
GOOD_WORDS = re.compile(r"passw|pwd|secret|token|api|key|auth|credential|login|bearer", re.I)
BAD_WORDS = re.compile(r"example|sample|placeholder|dummy|fingerprint|checksum|sha|md5|digest|commit|hash|uuid|revision|etag|integrity|version|card|phone|order|isbn|account|invoice|blob|image", re.I)
BAD_PATH = re.compile(r"test|example|sample|fixture|mock|doc|vendor|lock", re.I)
FEATURES = (
    "length", "entropy", "digits", "upper", "lower", "other", "class_changes", "repeats", "vowel_runs", "hex", "covered",
    "good_before", "bad_before", "bad_after", "bad_path", "path_depth", *(f"kind_{k}" for k in KINDS), "sequential", "assigned_before", "scheme",
)
_SHOWN = re.compile(r"[:=]\s*[\"']?$")
_REFERENCE = re.compile(r"^(?:\$|%|\{|<|\*|config\.|process\.|os\.|env\.|self\.|get)|[()\[\]]|\.\.\.$", re.I)


@lru_cache(maxsize=2)
def dictionary(path: str | None = None) -> frozenset[str]:
    """The lower-cased whole words, of four letters and more, of a byte-level vocabulary file."""
    words = set()
    with open(path or default_tokenizer()[0], "rb") as f:
        for line in f:
            t = base64.b64decode(line.split()[0])
            if len(t) > 4 and t[:1] == b" " and t[1:].isalpha() and t.isascii():
                words.add(t[1:].decode().lower())
    return frozenset(words)


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def covered(value: str) -> float:
    """The share of the characters inside dictionary words, the longest first at each place."""
    low, hit, at, known = value.lower(), 0, 0, dictionary()
    while at < len(low):
        n = next((n for n in range(min(12, len(low) - at), 3, -1) if low[at].isalpha() and low[at : at + n] in known), 0)
        hit += n
        at += n or 1
    return hit / max(1, len(low))


def describe(before: str, value: str, after: str, path: str, kind: str) -> list[float]:
    n = max(1, len(value))
    counts = {c: value.count(c) for c in set(value)}
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    kinds = [_class(c) for c in value]
    pairs = list(zip(value, value[1:]))
    letters = [c for c in value.lower() if c.isalpha()]
    alternate = sum((a in "aeiou") != (b in "aeiou") for a, b in zip(letters, letters[1:])) / max(1, len(letters) - 1)
    return [
        float(len(value)), entropy, *(kinds.count(k) / n for k in (0, 1, 2, 3)),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        sum(a == b for a, b in pairs) / n, alternate,
        sum(c in string.hexdigits for c in value) / n, covered(value),
        float(bool(GOOD_WORDS.search(before))), float(bool(BAD_WORDS.search(before))), float(bool(BAD_WORDS.search(after))),
        float(bool(BAD_PATH.search(path))), float(path.count("/")), *(float(kind == k) for k in KINDS),
        sum(ord(b) - ord(a) == 1 for a, b in pairs) / n, float(bool(_SHOWN.search(before))), float(bool(_REFERENCE.search(value))),
    ]


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of each candidate in the text."""
    if not DIGIT.search(text):
        low = text.lower()
        if not any(h in low for h in HINTS):
            return
    for m in CANDIDATE.finditer(text):
        kind = m.lastgroup
        yield m.start(kind), m.end(kind), kind


class _Maker:
    """Values and their surroundings, from a seed."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def pick(self, chars: str, k: int) -> str:
        return "".join(self.rng.choice(chars) for _ in range(k))

    def hexa(self, k: int) -> str:
        return self.pick("0123456789abcdef", k)

    def word(self) -> str:
        """Invented, or common in code and prose."""
        if self.rng.random() < 0.4:
            return "".join(self.rng.choice("bcdfghklmnprstvw") + self.rng.choice("aeiou") for _ in range(self.rng.randint(1, 4)))
        return self.rng.choice(_COMMON)

    def words(self, k: int) -> str:
        return " ".join(self.word() for _ in range(k))

    def path(self, poor: bool) -> str:
        rng = self.rng
        if rng.random() < 0.3:
            return self.word() + str(rng.randint(0, 99))
        parts = [self.word() for _ in range(rng.randint(0, 3))]
        if poor and rng.random() < 0.5:
            parts.insert(0, rng.choice(["tests", "docs", "vendor", "fixtures", "examples", "mocks"]))
        return "/".join([*parts, self.word() + rng.choice([".py", ".js", ".env", ".yaml", ".md", ".txt", ".json", ".lock", ".cfg", ""])])

    def given(self) -> tuple[str, str]:
        """Before and after an assigned value."""
        rng = self.rng
        quote = rng.choice(['"', "'", ""])
        name = rng.choice(["password", "token", "api_key", "secret", "auth", "access_key", "apikey", "passwd", "pwd", "API_KEY", "client_secret", "AUTH_TOKEN"])
        return self.words(rng.randint(0, 3)) + " " + name + rng.choice([" = ", "=", ": ", ":"]) + quote, quote + rng.choice([" ", "\n", ", "]) + self.words(3)

    def said(self) -> tuple[str, str]:
        return self.words(self.rng.randint(1, 4)) + " ", " " + self.words(3)

    def told(self, *names: str) -> tuple[str, str]:
        return self.words(self.rng.randint(0, 3)) + " " + self.rng.choice(names) + self.rng.choice([" ", ": ", "="]), self.rng.choice([" ", ".", "\n"]) + self.words(2)


_COMMON = "release ran the value deploy notes and see line of in is user client data build server config name file main list read write open set get call run".split()
_ALNUM = string.ascii_letters + string.digits
#: What services issue and people choose; what is often taken for it.
SECRET_FAMILIES = {
    "aws": lambda m: ("AKIA" + m.pick(string.ascii_uppercase + string.digits, 16), m.rng.choice([m.said, m.given])()),
    "aws_secret": lambda m: (m.pick(_ALNUM + "+/", 40), m.given()),
    "github": lambda m: (m.rng.choice(["ghp_", "gho_", "ghs_"]) + m.pick(_ALNUM, 36), m.rng.choice([m.said, m.given])()),
    "npm": lambda m: ("npm_" + m.pick(_ALNUM, 36), m.rng.choice([m.said, m.given])()),
    "stripe": lambda m: ("sk_live_" + m.pick(_ALNUM, 24), m.rng.choice([m.said, m.given])()),
    "google": lambda m: ("AIza" + m.pick(_ALNUM + "-_", 35), m.rng.choice([m.said, m.given])()),
    "chat": lambda m: ("xoxb-" + m.pick(string.digits, 12) + "-" + m.pick(_ALNUM, 24), m.rng.choice([m.said, m.given])()),
    "signed": lambda m: ("eyJ" + m.pick(_ALNUM, 20) + "." + m.pick(_ALNUM, 40) + "." + m.pick(_ALNUM + "_-", 43), m.rng.choice([m.said, m.given])()),
    "private": lambda m: ("-----BEGIN PRIVATE KEY-----\n" + m.pick(_ALNUM + "+/", 200) + "\n-----END PRIVATE KEY-----", m.said()),
    "mixed": lambda m: (m.pick(_ALNUM, m.rng.randint(14, 48)), m.given()),
    "password": lambda m: (m.pick(_ALNUM + "!@$%^&*", m.rng.randint(10, 24)), m.given()),
    "hex": lambda m: (m.hexa(m.rng.choice([32, 40, 48, 64])), m.given()),
    "upper_hex": lambda m: (m.hexa(m.rng.choice([32, 40])).upper(), m.given()),
    "login": lambda m: (m.pick(_ALNUM + "!$%^", m.rng.randint(10, 20)), (m.word() + " postgres://" + m.word() + ":", "@" + m.word() + ".net/db")),
}
OTHER_FAMILIES = {
    "commit": lambda m: (m.hexa(40), m.told("commit", "revision", "sha", "hash")),
    "checksum": lambda m: (m.hexa(m.rng.choice([32, 64])), m.told("sha256", "checksum", "fingerprint", "md5", "digest", "integrity", "etag")),
    "bare_hex": lambda m: (m.hexa(m.rng.choice([32, 40])).upper(), m.said()),
    "uuid": lambda m: ("-".join(m.hexa(k) for k in (8, 4, 4, 4, 12)), m.rng.choice([m.said, lambda: m.told("uuid", "id")])()),
    "placeholder": lambda m: (m.rng.choice(["changeme123", "your_password_here", "your-api-key-here", "xxxxxxxxxxxx", "placeholder", "example-token-value", "insert_token_here", "********", "todo-replace-1"]), m.given()),
    "phrase": lambda m: (m.rng.choice(["", "-", "_"]).join(m.rng.choice([w, w.title()]) for w in (m.word() for _ in range(m.rng.randint(3, 5)))) + m.rng.choice(["", "1", "_name", "Value"]), m.given()),
    "call": lambda m: ("get_" + "_".join(m.word() for _ in range(3)) + "()", m.given()),
    "reference": lambda m: (m.rng.choice(["config.", "process.env.", "os.environ.", "self."]) + ".".join(m.word() for _ in range(2)), m.given()),
    "route": lambda m: ("/".join(m.word() for _ in range(6)) + "2", m.said()),
    "sequence": lambda m: ("1234567890" * m.rng.randint(2, 4), m.rng.choice([m.said, m.given])()),
    "ruler": lambda m: ("=" * 30 + "2" + "-" * 4, m.said()),
    "card": lambda m: (m.pick(string.digits, 16), m.rng.choice([m.said, lambda: m.told("card", "account", "order", "invoice")])()),
    "long_number": lambda m: (m.pick(string.digits, m.rng.randint(12, 40)), m.said()),
    "phone": lambda m: ("-".join(m.pick(string.digits, k) for k in (3, 3, 3, 4)), m.rng.choice([m.said, lambda: m.told("phone", "call")])()),
    "moment": lambda m: (f"20{m.pick('012', 2)}-0{m.pick('123456789', 1)}-1{m.pick(string.digits, 1)}-{m.pick(string.digits, 6)}", m.said()),
    "version": lambda m: (f"{m.word()}{m.word()}-{m.pick(string.digits, 2)}-{m.pick(string.digits, 2)}-{m.word()}{m.word()}{m.word()}", m.rng.choice([m.said, lambda: m.told("version")])()),
    "image": lambda m: ("iVBORw0KGgoAAAANSUhEUgAA" + m.pick(_ALNUM + "+/", m.rng.randint(40, 200)), m.told("base64,", "image", "blob")),
}


def labelled_findings(n: int = 3000, seed: int = 11, without: tuple[str, ...] = (), only: tuple[str, ...] = ()) -> list[tuple[str, str, str, str, int]]:
    """Made-up findings, as many secrets as others, in equal parts from each family (but `without`, or of `only` some)."""
    m = _Maker(seed)
    chosen = {
        label: [f for name, f in families.items() if name not in without and (not only or name in only)]
        for label, families in ((1, SECRET_FAMILIES), (0, OTHER_FAMILIES))
    }
    out = []
    for i in range(n):
        families = chosen[i % 2] or chosen[1 - i % 2]
        value, (before, after) = m.rng.choice(families)(m)
        label = int(families is chosen[1])
        out.append((before, value, after, m.path(poor=not label), label))
    return out


def train(findings: list[tuple[str, str, str, str, int]] | None = None, seed: int = 0) -> forest.Forest:
    """A forest from labelled findings; the candidate's kind is what the expression calls it."""
    x, y = [], []
    for before, value, after, path, label in findings or labelled_findings():
        text = before + value + after
        kind = next((k for a, b, k in candidates(text) if a < len(before) + len(value) and b > len(before)), "opaque")
        x.append(describe(before[-CONTEXT:], value, after[:CONTEXT], path, kind))
        y.append(label)
    return forest.train(np.array(x), np.array(y), seed=seed)


def _judged(text: str, path: str, model: forest.Forest) -> list[tuple[int, int, str, float]]:
    got = list(candidates(text))
    if not got:
        return []
    x = [describe(text[max(0, a - CONTEXT) : a], text[a:b], text[b : b + CONTEXT], path, k) for a, b, k in got]
    return [(a, b, k, float(p)) for (a, b, k), p in zip(got, model.predict(np.array(x)))]


def masked(value: str) -> str:
    """The first characters, at most four and a quarter of them, and the length."""
    return f"{value[: min(4, len(value) // 4)]}...({len(value)})"


def scan(df: DataFrame, model: forest.Forest | None = None, text_col: str = "text", id_col: str = "doc_id", path_col: str = "source") -> DataFrame:
    """Every candidate: id, start, length (code points), kind, masked, sha256 (of the value), probability, is_secret.

    Values are not returned in clear; start and length say where they are.
    """
    sent = df.sparkSession.sparkContext.broadcast(model or train())

    @F.pandas_udf("array<struct<start:int,length:int,kind:string,masked:string,sha256:string,probability:double>>")
    def run(texts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([
            [(a, b - a, k, masked(t[a:b]), hashlib.sha256(t[a:b].encode()).hexdigest(), p) for a, b, k, p in _judged(t, q or "", sent.value)] if t else []
            for t, q in zip(texts, paths)
        ])

    found = df.select(F.col(id_col), F.explode(run(F.col(text_col), F.col(path_col).cast("string"))).alias("f"))
    return found.select(id_col, "f.*", (F.col("f.probability") >= THRESHOLD).alias("is_secret"))


def redact(df: DataFrame, model: forest.Forest | None = None, text_col: str = "text", path_col: str = "source", mask: str = "[SECRET]") -> DataFrame:
    """df with every secret found in the text replaced by the mask."""
    sent = df.sparkSession.sparkContext.broadcast(model or train())

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, paths in batches:
            out = []
            for t, q in zip(texts, paths):
                if t:
                    for a, b, _, p in reversed(_judged(t, q or "", sent.value)):
                        if p >= THRESHOLD:
                            t = t[:a] + mask + t[b:]
                out.append(t)
            yield pd.Series(out, dtype=object)
        trim()

    return df.withColumn(text_col, run(F.col(text_col), F.col(path_col).cast("string")))
