"""Recursive character splitting of texts into chunks for retrieval.

The first separator that occurs divides the text and stays at the head of the
following piece; pieces below the size are merged greedily, the tail of a chunk
of at most ``overlap`` characters is carried over, longer pieces go on with the
next separators or stay whole. Merged chunks are trimmed; empty ones are dropped.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE, OVERLAP, SEPARATORS = 150, 50, (";",)


def _cut(text: str, separator: str) -> list[str]:
    if not separator:
        return list(text)
    parts = text.split(separator)
    return [p for p in [parts[0], *[separator + x for x in parts[1:]]] if p]


def _merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    held: deque[str] = deque()
    total = 0
    for p in pieces:
        if total + len(p) > size and held:
            out.append("".join(held))
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.popleft())
        held.append(p)
        total += len(p)
    if held:
        out.append("".join(held))
    return [c for c in map(str.strip, out) if c]


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS) -> list[str]:
    if not separators:
        return [text]
    k = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    rest = [] if not separators[k] else list(separators[k + 1 :])
    out: list[str] = []
    small: list[str] = []
    for p in _cut(text, separators[k]):
        if len(p) < size:
            small.append(p)
            continue
        if small:
            out += _merge(small, size, overlap)
            small = []
        out += split_text(p, size, overlap, rest) if rest else [p]
    return out + (_merge(small, size, overlap) if small else [])


def chunks(text: Column | str, size: int = SIZE, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS) -> Column:
    """Array of chunks."""
    sep = tuple(separators)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([split_text(t, size, overlap, sep) if isinstance(t, str) else None for t in texts], dtype=object)

    # nondeterministic: else the planner would run it twice, in a filter that it infers below an explode
    return run.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def pieces(text: Column | str, separator: str) -> Column:
    """The pieces of one separator, in the JVM: the separator heads the following piece."""
    return F.filter(F.split(F.col(text) if isinstance(text, str) else text, f"(?={re.escape(separator)})"), lambda p: p != "")


def chunk_table(df: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS) -> DataFrame:
    """(key, chunk_idx, chunk); a text without any separator is one chunk."""
    return df.select(key, chunks(text, size, overlap, separators).alias("_chunks")).select(key, F.posexplode("_chunks").alias("chunk_idx", "chunk"))
