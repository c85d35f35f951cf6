"""Text embeddings behind one interface: offline hashing, a local model, or an HTTP endpoint.

The model is made once for each partition, not for each document.
"""

from __future__ import annotations

import json
import math
import re
import urllib.request
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.operators import chunking, retrieval
from garimpo.session import ship


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


_WORDS = re.compile(r"\w+")


@lru_cache(1 << 16)
def _crc(word: str) -> int:
    return zlib.crc32(word.encode())


@dataclass(frozen=True)
class Hashing:
    """Signed counts of hashed words at length 1; deterministic and without any model."""

    size: int = 256

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            ws = _WORDS.findall((t or "").lower())
            slots = np.fromiter(map(_crc, ws), np.int64, len(ws))
            v = np.bincount(slots % self.size, np.where(slots >> 31, 1.0, -1.0), self.size)
            out.append((v / (math.sqrt((v * v).sum()) or 1.0)).tolist())
        return out


def device(asked: str | None = None) -> str:
    """The asked device, else the first there is of cuda, mps and cpu."""
    if asked:
        return asked
    try:
        import torch
    except ImportError:
        return "cpu"
    if torch.cuda.is_available():
        return "cuda"
    mps = getattr(torch.backends, "mps", None)
    return "mps" if mps is not None and mps.is_available() else "cpu"


class LocalModel:
    """A sentence-transformers model, normalised; needs that package on the executors."""

    def __init__(self, name: str, on: str | None = None) -> None:
        from sentence_transformers import SentenceTransformer

        self.model = SentenceTransformer(name, device=device(on))

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return self.model.encode(list(texts), normalize_embeddings=True).tolist()


@dataclass(frozen=True)
class HttpModel:
    """An endpoint that takes {"model", "input"} and gives {"embeddings"}."""

    url: str
    model: str
    timeout: float = 300

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": list(texts)}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as r:  # noqa: S310
            return json.load(r)["embeddings"]


def backend(name: str, url: str = "http://localhost:11434/api/embed") -> Callable[[], Embedder]:
    """A name with a slash is a local model, any other one is asked for over HTTP."""
    return (lambda: LocalModel(name)) if "/" in name else (lambda: HttpModel(url, name))


def with_embedding(df: DataFrame, text: str, make: Callable[[], Embedder], out: str = "embedding") -> DataFrame:
    ship(df.sparkSession)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out}` array<float>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield b.assign(**{out: model.embed([t if isinstance(t, str) else "" for t in b[text]])})

    return df.mapInPandas(run, schema)


def question_contexts(
    docs: DataFrame, key: str, text: str, questions: DataFrame, query: str, question: str, make: Callable[[], Embedder], k: int, size: int, overlap: int, separators: Sequence[str], max_chars: int | None = 30_000
) -> DataFrame:
    """The context of each question about a document: its k nearest chunks in rank order, ties by place.

    ``questions`` has the document's key, which ``docs`` has once, so a question
    about one company of a document finds the chunks of that document only, and a
    query's id need be unique within its document only. Returns the key,
    ``query_id`` and ``contexto``; a question about a document without chunks has
    no row.

    A text is shuffled to its questions once; its chunks and their vectors are
    made there, for questions that follow one another once, and go nowhere.
    """
    ship(docs.sparkSession)
    asked = questions.select(key, F.col(query).alias("query_id"), F.col(question).alias("_question"))
    rows = docs.select(key, F.col(text).alias("_text")).join(asked, key).select(key, "query_id", "_question", "_text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:2])
    sep = tuple(separators)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        last: str | None = None
        parts: list[str] = []
        vectors = np.zeros((0, 0))
        for b in batches:
            keep: list[int] = []
            out: list[str] = []
            asked_ = b.column(2).to_pylist()
            for i, (q, t) in enumerate(zip(asked_, b.column(3).to_pylist())):
                if t is None:
                    continue
                if t != last:
                    last, parts = t, chunking.split_text(t, size, overlap, sep)
                    vectors = np.array(model.embed(parts), np.float32).astype(np.float64) if parts else vectors
                if parts:
                    ranked = retrieval.nearest_rows(np.array(model.embed([q or ""])[0], np.float32).astype(np.float64), vectors, k)
                    context = "\n\n".join([parts[n] for n in ranked])
                    keep.append(i)
                    out.append(context if max_chars is None else context[:max_chars])
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(out, pa.string())], names=[*b.schema.names[:2], "contexto"])

    return rows.mapInArrow(run, f"{schema}, contexto string")
