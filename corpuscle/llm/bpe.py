"""Byte-level BPE: encoding in overlapping chunks, decoding by concatenation.

A text is cut into chunks that overlap; each chunk is pre-tokenised on its own. A pre-token depends only
on where it starts and on what follows, so two neighbours that share a boundary in their overlap agree
from there on: the text is cut there, and the pieces are encoded on their own. A cut has no white space
before it, as white space is split by what follows. Where an overlap holds no shared boundary (a run
without any boundary longer than the overlap), pre-tokens are followed from the last sure boundary on,
until one ends where a later chunk has a boundary too.

Texts of up to long_chars go through this within their row; the chunks and pieces of longer ones are
spread over tasks.

Edge cases: null counts as the empty text, which has no tokens; repeated rows each get their row; an
empty table gives an empty table; other columns are kept, and the columns added replace columns of the
same name.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import free, trim

CHUNK_CHARS = 1_024
OVERLAP_CHARS = 64
#: Texts above are spread over tasks, in chunks that are longer by as much.
LONG_CHARS = 32_768


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def boundaries(text: str, pattern: str) -> list[int]:
    """Where pre-tokens start or end. The pattern covers every character."""
    return [0, *(m.end() for m in _pattern(pattern).finditer(text))]


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _summary(enc, ids: list[int]) -> tuple[int, str, str]:
    raw = enc.decode_bytes(ids)
    return len(ids), hashlib.sha256(_pack(ids)).hexdigest(), hashlib.sha256(raw).hexdigest()


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _chunks(batches, chunk: int, overlap: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for k, text in zip(pdf["k"], pdf["text"]):
            for i, start in enumerate(range(0, len(text), chunk)):
                end = start + chunk + overlap
                yield pd.DataFrame({"k": [k], "i": [i], "ends": [end >= len(text)], "part": [text[start:end]]})
    trim()


def marks(part: str, start: int, ends: bool, pattern: str, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """The boundaries of the chunk at start: in the overlap with the chunk before it, and with the one after it."""
    at = boundaries(part, pattern)
    if not ends:
        # what touches the end of a chunk might go on beyond it
        at = [p for p in at if p < len(part) - 1]
    return [start + p for p in at if p <= overlap], [start + p for p in at if p >= chunk]


def cut_points(text: str, heads: list[list[int]], tails: list[list[int]], pattern: str, chunk: int, overlap: int) -> list[int]:
    """Starts of the pieces and the end, from the boundaries near each chunk's head and tail."""
    cuts, j, last = [0], 0, len(heads) - 1
    while j < last:
        both = sorted(set(tails[j]).intersection(heads[j + 1]))
        if both:  # the next chunk is in step
            j += 1
        else:
            both, j = _walk(text, max(tails[j], default=cuts[-1]), heads, j + 1, pattern, chunk, overlap)
        cut = next((p for p in both if p > cuts[-1] and not text[p - 1].isspace()), None)
        if cut is not None:
            cuts.append(cut)
    if len(text) > cuts[-1]:
        cuts.append(len(text))
    return cuts


def _walk(text: str, at: int, heads: list[list[int]], k: int, pattern: str, chunk: int, overlap: int) -> tuple[list[int], int]:
    """Pre-tokens from a sure boundary on, until one ends at a boundary of chunk k or a later one: (that boundary, the chunk)."""
    for m in _pattern(pattern).finditer(text, at):
        p = m.end()
        while k < len(heads) and p > k * chunk + overlap:
            k += 1
        if k == len(heads):
            break
        if p >= k * chunk and p in heads[k]:
            return [p], k
    return [], len(heads) - 1


def pieces(text: str, pattern: str, chunk: int, overlap: int) -> list[str]:
    """Runs of whole pre-tokens that make up the text."""
    if len(text) <= chunk + overlap:
        return [text]
    found = [
        marks(text[at : at + chunk + overlap], at, at + chunk + overlap >= len(text), pattern, chunk, overlap) for at in range(0, len(text), chunk)
    ]
    cuts = cut_points(text, [h for h, _ in found], [t for _, t in found], pattern, chunk, overlap)
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def _piece_rows(long: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(k, piece, text) for long (k, text): whole pre-tokens, in pieces of about a chunk."""
    spread = long.mapInPandas(lambda b: _chunks(b, chunk, overlap), "k string, i long, ends boolean, part string")

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [marks(part, i * chunk, ends, pattern, chunk, overlap) for i, ends, part in zip(pdf["i"], pdf["ends"], pdf["part"])]
            yield pd.DataFrame({"k": pdf["k"], "i": pdf["i"], "head": [h for h, _ in got], "tail": [t for _, t in got]})
        trim()

    marked = spread.repartition("k", "i").mapInPandas(mark, "k string, i long, head array<long>, tail array<long>")
    parts = marked.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "head", "tail"))).alias("parts"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, text, got in zip(pdf["k"], pdf["text"], pdf["parts"]):
                cuts = cut_points(text, [list(p["head"]) for p in got], [list(p["tail"]) for p in got], pattern, chunk, overlap)
                for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    yield pd.DataFrame({"k": [k], "piece": [n], "text": [text[a:b]]})
        trim()

    return long.join(parts, "k").select("k", "text", "parts").mapInPandas(cut, "k string, piece long, text string")


def encode(
    df: DataFrame,
    text_col: str = "text",
    tokenizer_path: str | None = None,
    pattern: str | None = None,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
    long_chars: int = LONG_CHARS,
    digests_only: bool = False,
) -> DataFrame:
    """df with ids (array<int>), or with digests_only n_tokens, ids_sha256 and decoded_sha256 in its place.

    Long texts are encoded once per different text. A long text's ids are put together in one row,
    as the text itself is.
    """
    path, pat = default_tokenizer()
    path, pat = tokenizer_path or path, pattern or pat
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests_only else ["ids"]
    df = df.drop(*[c for c in added if c != text_col])
    fields = DIGESTS if digests_only else "ids array<int>"

    @F.pandas_udf(f"struct<{', '.join(f.replace(' ', ':') for f in fields.split(', '))}>")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = _encoding(path, pat)
        one = enc._core_bpe.encode_ordinary
        for texts in batches:
            ids = ([i for piece in pieces(t or "", pat, chunk_chars, overlap_chars) for i in one(piece)] for t in texts)
            yield pd.DataFrame([_summary(enc, x) for x in ids], columns=added) if digests_only else pd.DataFrame({"ids": list(ids)})
        trim()

    is_long = F.coalesce(F.length(text_col) > long_chars, F.lit(False))
    out, key = free(df, "e", "k")
    short = df.filter(~is_long).withColumn(out, whole(F.col(text_col)))
    keyed = df.filter(is_long).withColumn(key, F.sha2(F.col(text_col), 256))
    long = keyed.groupBy(F.col(key).alias("k")).agg(F.first(text_col).alias("text"))

    def encode_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(path, pat)
        for pdf in batches:
            ids = [_pack(enc._core_bpe.encode_ordinary(t)) for t in pdf["text"]]
            yield pd.DataFrame({"k": pdf["k"], "piece": pdf["piece"], "ids": ids})
        trim()

    done = (
        _piece_rows(long, pat, long_chars, max(overlap_chars, min(OVERLAP_CHARS * 16, long_chars // 4)))
        .repartition("k", "piece")
        .mapInPandas(encode_pieces, "k string, piece long, ids binary")
        .groupBy("k")
        .agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("pieces"))
    )

    @F.pandas_udf(f"struct<{', '.join(f.replace(' ', ':') for f in fields.split(', '))}>")
    def join_pieces(rows: pd.Series) -> pd.DataFrame:
        enc = _encoding(path, pat)
        ids = []
        for row in rows:
            raw = b"".join(p["ids"] for p in row)
            ids.append(list(struct.unpack(f"<{len(raw) // 4}I", raw)))
        if digests_only:
            return pd.DataFrame([_summary(enc, x) for x in ids], columns=added)
        return pd.DataFrame({"ids": ids})

    done = done.select(F.col("k").alias(key), join_pieces("pieces").alias(out))
    both = short.unionByName(keyed.join(done, key).drop(key))
    return both.select(*df.columns, f"{out}.*")


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", tokenizer_path: str | None = None) -> DataFrame:
    """df with the bytes of each row's ids concatenated (binary); null ids give empty bytes."""
    path, pat = default_tokenizer()
    path = tokenizer_path or path

    @F.pandas_udf("binary")
    def run(ids: pd.Series) -> pd.Series:
        enc = _encoding(path, pat)
        return pd.Series([b"" if x is None else enc.decode_bytes([int(i) for i in x]) for x in ids])

    return df.withColumn(out_col, run(F.col(ids_col)))
