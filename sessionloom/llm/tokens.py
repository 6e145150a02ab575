"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where both sides provably agree.

A pretoken (what the tokenizer's splitter hands to its merges) is cut from left to right and looks only at the text from its own start
on. So once two chunks begin a pretoken at the same place, everything after it is the same in both. A chunk is trusted up to `GUARD`
characters before its end, where text cut off could still change a pretoken or an added token. Two neighbours are spliced at a pretoken start that both
have inside that stretch, never the first one of the later chunk. If they have none in common, the later chunk starts further left
and the overlap doubles, at last to the whole text before.

Defined results: null text counts as empty (0 bytes, 0 tokens); texts are never cut or sampled; special strings in a text are
handled as the library's default does; every input row gives one output row.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 65_536
OVERLAP = 1_024
GUARD = 64


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _starts(tokenizer, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character where each token's pretoken starts, and whether the token is the first of it."""
    encoding = tokenizer.encode(text, add_special_tokens=False)
    pieces = np.array([-1 if w is None else w for w in encoding.word_ids], np.int64)
    spans = np.array(encoding.offsets, np.int64).reshape(-1, 2)
    first = np.ones(len(pieces), bool)
    first[1:] = (pieces[1:] != pieces[:-1]) | (pieces[1:] < 0)
    return spans[:, 0], first


def count_long(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text, encoding `chunk` characters at a time."""
    if len(text) <= chunk:
        return len(tokenizer.encode(text, add_special_tokens=False).ids)
    # Leading spaces belong to the pretoken; trimmed offsets would hide them.
    begin, end, total, done = 0, chunk, 0, 0
    places, first = _starts(tokenizer, text[:end])
    while end < len(text):
        # `done`: start of the first pretoken of this chunk that is not counted yet.
        back = overlap
        after = min(end + chunk, len(text))
        while True:
            start = max(done, end - back)
            later, later_first = _starts(tokenizer, text[start:after])
            later = later + start
            ours = places[first & (places <= end - GUARD) & (places > done)]
            theirs = later[later_first][1:]
            common = np.intersect1d(ours, theirs)
            if len(common):
                splice = int(common[-1])
                break
            if start == done:
                # The later chunk starts at a proven pretoken start and covers all that is left of this one.
                splice = done
                break
            back *= 2
        total += int(np.count_nonzero((places >= done) & (places < splice)))
        places, first, begin, end, done = later, later_first, start, after, splice
    return total + int(np.count_nonzero(places >= done))


def token_counts(path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    """Pandas UDF: text -> number of tokens of the tokenizer file at `path`; several short texts are encoded together."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _untrimmed(path)
        for texts in batches:
            out = np.zeros(len(texts), np.int64)
            values = texts.tolist()
            small: list[int] = []
            held = 0
            for i, value in enumerate(values):
                if not value:
                    continue
                if len(value) > chunk:
                    out[i] = count_long(tokenizer, value, chunk, overlap)
                    continue
                small.append(i)
                held += len(value)
                if held > 1_000_000:
                    out[small] = _lengths(tokenizer, [values[j] for j in small])
                    small, held = [], 0
            if small:
                out[small] = _lengths(tokenizer, [values[j] for j in small])
            yield pd.Series(out)

    return count


def _lengths(tokenizer, texts: list[str]) -> list[int]:
    return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def _untrimmed(path: str):
    """The tokenizer with offsets that keep a pretoken's leading space."""
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = _tokenizer(path)
    if isinstance(tokenizer.pre_tokenizer, ByteLevel):
        tokenizer.pre_tokenizer.trim_offsets = False
    return tokenizer


def count_tokens(
    docs: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    text: str | Column = "text",
    limit: int = 1_024,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; nothing is shuffled."""
    value = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    own = docs.select(F.col(doc_id).alias("doc_id"), value.alias("text"))
    return own.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        token_counts(path, chunk, overlap)("text").alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
