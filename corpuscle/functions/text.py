"""Tokens, n-grams and token windows as columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, numbers and the underscore: what Python's \w is, which Java's is not.
WORD = r"[\p{L}\p{N}_]+"
NON_ASCII = r"[^\x00-\x7F]"
#: The method of ICU's Normalizer, which comes with Spark, and whether it maps compatible characters.
NORMALIZERS = {"NFC": ("compose", False), "NFD": ("decompose", False), "NFKC": ("compose", True), "NFKD": ("decompose", True)}


@dataclass(frozen=True)
class RegexTokenizer:
    """Normalise, lower-case and find all matches.

    The default pattern runs in the JVM, normalising too: no text passes through Python. Other patterns
    are Python expressions and run in Arrow batches.
    """

    pattern: str = r"\w+"
    lowercase: bool = True
    normalize: str | None = "NFC"

    def __post_init__(self) -> None:
        if self.normalize is not None and self.normalize not in NORMALIZERS:
            raise ValueError(f"unknown normal form {self.normalize!r}")

    def __call__(self, text: str) -> list[str]:
        if self.normalize:
            text = unicodedata.normalize(self.normalize, text)
        return re.findall(self.pattern, text.lower() if self.lowercase else text)

    def column(self, text: Column) -> Column:
        if self.pattern != r"\w+":
            return python_tokens(self)(F.coalesce(text, F.lit("")))
        text = F.coalesce(text, F.lit(""))
        if self.normalize:
            # below U+0300 and in this block of punctuation nothing changes under NFC
            odd = r"[^\x{0}-\x{2FF}\x{2010}-\x{203F}]"
            text = F.when(text.rlike(odd if self.normalize == "NFC" else NON_ASCII), normal(text, self.normalize)).otherwise(text)
        text = F.lower(text) if self.lowercase else text
        return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


@dataclass(frozen=True)
class NgramTokenizer:
    """All n-grams of another tokenizer's tokens; with include_lower the shorter ones come first."""

    base: RegexTokenizer | Callable[[str], list[str]] = RegexTokenizer()
    n: int = 2
    sep: str = "_"
    include_lower: bool = False

    def __post_init__(self) -> None:
        if self.n < 1:
            raise ValueError("n must be at least 1")

    def __call__(self, text: str) -> list[str]:
        tokens = self.base(text)
        sizes = range(1, self.n + 1) if self.include_lower else [self.n]
        return [self.sep.join(tokens[i : i + k]) for k in sizes for i in range(len(tokens) - k + 1)]

    def column(self, text: Column) -> Column:
        return ngrams(tokenize(text, self.base), self.n, self.sep, self.include_lower)


def normal(text: Column, form: str) -> Column:
    """A normal form of a text that isn't null. Spark takes methods called by name for nondeterministic, so this is no argument of an aggregate."""
    method, compatible = NORMALIZERS[form]
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), text, F.lit(compatible))


def python_tokens(tokenizer: Callable[[str], list[str]]):
    """An Arrow function around any callable from text to a list of tokens."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(tokenizer(t or "")))

    return run


def tokenize(text: Column, tokenizer=None) -> Column:
    tokenizer = tokenizer or RegexTokenizer()
    return tokenizer.column(text) if hasattr(tokenizer, "column") else python_tokens(tokenizer)(text)


def ngrams(tokens: Column, n: int = 2, sep: str = "_", include_lower: bool = False) -> Column:
    def of(t: Column, k: int) -> Column:
        if k == 1:
            return t
        grams = F.transform(F.sequence(F.lit(1), F.size(t) - (k - 1)), lambda i: F.array_join(F.slice(t, i, k), sep))
        return F.when(F.size(t) >= k, grams).otherwise(F.array().cast("array<string>"))

    sizes = range(1, n + 1) if include_lower else [n]
    # bound to a variable, so that the tokens are found once and not for each n-gram
    return F.flatten(F.transform(F.array(tokens), lambda t: F.concat(*[of(t, k) for k in sizes])))


def positions(tokens: Column, target: Column | str) -> Column:
    """The 1-based positions of a token."""
    target = F.lit(target) if isinstance(target, str) else target
    return F.filter(F.transform(tokens, lambda t, i: F.when(t == target, i + 1)), lambda p: p.isNotNull())


def left_of(tokens: Column, at: Column, window: int) -> Column:
    start = F.greatest(at - window, F.lit(1))
    return F.slice(tokens, start, at - start)


def right_of(tokens: Column, at: Column, window: int) -> Column:
    return F.slice(tokens, at + 1, F.lit(window))
