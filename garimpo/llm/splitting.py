"""Problem 4: oversized items cut into pieces at natural boundaries, with overlap.

Agglomerative merging: a text begins as atomic segments between natural
boundaries; every adjacent pair waits in a heap under the strength of its
boundary, and the weakest boundary is merged first while the combined size plus
the overlap fits. What is left are the strongest boundaries that the size
allows. Pieces are stretches of the original text: without their overlaps they
give it back exactly.

Strengths: 5 blank line or form feed, 4 line end, 3 sentence end, 2 clause mark,
1 white space, 0 none. Atoms reach down to a weaker level only where a stretch
is too long without it; a hard cut never parts a letter from its combining marks
or a carriage return from its line feed.

Each piece but the first starts with the last ``overlap`` characters of the piece
before, or with fewer, from the first natural boundary among them. Sizes are in
Unicode code points.

Defined results: null and short texts (at most ``limit``) are not oversized and
give no row; blank text of any length is cut like other
text; repeated ids are cut row by row; of boundaries of equal strength the
smaller merged size goes first, then the earlier; other columns are kept.
"""

from __future__ import annotations

import re
import unicodedata as U
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


LIMIT, OVERLAP = 4000, 200
_EOL = r"(?:\r\n|[\n\r\f\v\x85  ])"
_STRONG = re.compile(rf"[ \t]*{_EOL}(?:[ \t]*{_EOL})*[ \t]*|(?<=[.!?…;])[\"'”’»)\]]*[ \t\xa0]+(?=[\"'“‘«(\[¿¡]*[^\Wa-z_])")
_CLAUSE = re.compile(r"(?<=[,:;.!?)])\s+|\s+(?=[(\[–—])")
_SPACE = re.compile(r"\s+")
PIECE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("inicio", "fim", "sobreposicao", "forca")])


def _strength(gap: str) -> int:
    ends = len(re.findall(_EOL, gap))
    return 5 if ends > 1 or "\f" in gap else 4 if ends else 3


def _hard(text: str, at: int, low: int) -> int:
    """The cut at or before ``at`` that parts no cluster; ``at`` itself if there is none above ``low``."""
    p = at
    while p > low and (U.combining(text[p]) or text[p] in "‍︎️" or text[p - 1] == "‍" or text[p - 1 : p + 1] == "\r\n"):
        p -= 1
    return p if p > low else at


def atoms(text: str, most: int) -> tuple[list[int], list[int]]:
    """Ends of the atomic segments and the strength of the boundary at each; the last end is the text's."""
    ends: list[int] = []
    strengths: list[int] = []

    def cut(a: int, b: int, level: int, last: int) -> None:
        if b - a <= most:
            ends.append(b)
            strengths.append(last)
        elif level == 0:
            while b - a > most:
                a = _hard(text, a + most, a)
                ends.append(a)
                strengths.append(0)
            if b > a:
                ends.append(b)
                strengths.append(last)
            else:
                strengths[-1] = last
        else:
            at = a
            for m in (_SPACE, _CLAUSE)[level - 1].finditer(text, a, b):
                if at < m.end() < b:
                    cut(at, m.end(), level - 1, level)
                    at = m.end()
            cut(at, b, level - 1, last)

    at = 0
    for m in _STRONG.finditer(text):
        end = m.end()
        if at < end < len(text):
            cut(at, end, 2, _strength(m[0]))
            at = end
    cut(at, len(text), 2, 9)
    return ends, strengths


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(begin, end, overlap, strength of the boundary at the end) of each piece; begin includes the overlap."""
    if len(text) <= limit:
        return [(0, len(text), 0, 9)]
    most = limit - overlap
    ends, strengths = atoms(text, most)
    n = len(ends)
    begin = [0, *ends[:-1]]
    after = list(range(1, n + 1))  # the next live segment
    before = list(range(-1, n - 1))
    live = [True] * n
    heap = []
    for i in range(n - 1):
        size = ends[i + 1] - begin[i]
        if size <= (limit if i == 0 else most):
            heap.append((strengths[i], size, i, i + 1))
    heapify(heap)
    while heap:
        strength, size, i, j = heappop(heap)
        if not live[i] or after[i] != j or ends[j] - begin[i] != size:
            continue
        ends[i], strengths[i] = ends[j], strengths[j]
        live[j] = False
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            size = ends[k] - begin[i]
            if size <= (limit if i == 0 else most):
                heappush(heap, (strengths[i], size, i, k))
        h = before[i]
        if h >= 0:
            size = ends[i] - begin[h]
            if size <= (limit if h == 0 else most):
                heappush(heap, (strengths[h], size, h, i))
    out = []
    i, start = 0, 0
    while i < n:
        a, b = begin[i], ends[i]
        own = 0
        if out:
            own = _overlap(text, max(start, a - overlap), a)
        start = a - own
        out.append((start, b, own, strengths[i]))
        i = after[i]
    return out


def _overlap(text: str, low: int, end: int) -> int:
    """Length of the natural stretch that ends at ``end`` and begins at or after ``low``."""
    if low == 0 or text[low - 1].isspace() and not text[low].isspace():
        return end - low
    m = _SPACE.search(text, low, end)
    if m and m.end() < end:
        return end - m.end()
    return end - low


@F.pandas_udf(T.ArrayType(PIECE))
def _cuts(texts: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series(
        [None if not isinstance(t, str) else [dict(zip(PIECE.names, c)) for c in cuts(t, int(a), int(b))] for t, a, b in zip(texts, limit, overlap)], dtype=object
    )


# else the planner would run it a second time, in a filter that it infers below an explode
_cuts = _cuts.asNondeterministic()


def split_oversized(df: DataFrame, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The rows whose text is longer than ``limit``, with ``pecas``, an array of pieces in order."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be below half the limit")
    return df.filter(F.length(text) > limit).withColumn("pecas", _cuts(F.col(text), F.lit(limit), F.lit(overlap)))


def pieces(split: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each piece, with its text."""
    p: Column = F.col("_p")
    return split.select(F.col(key), F.col(text).alias("_text"), F.posexplode("pecas").alias("peca", "_p")).select(
        key,
        "peca",
        p.inicio.alias("inicio"),
        p.fim.alias("fim"),
        p.sobreposicao.alias("sobreposicao"),
        p.forca.alias("forca"),
        F.col("_text").substr(p.inicio + 1, p.fim - p.inicio).alias("texto"),
    )
