"""Exact top-k retrieval by squared L2 distance, and context assembly.

Within a document the query and its chunks meet in an equi-join, for a document
bounds both. Against a whole table, or a scope that may hold much of it, queries are taken in blocks of bounded size: a block is shipped, every
partition keeps its k best for each query, and only those candidates are
shuffled. One matrix product a batch gives rough distances; the rows that these
don't rule out by a bound of their rounding get exact ones, so ties go to the
least ids whatever the partitions and batches are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries in one block, all that is shipped at once.
BLOCK = 4096
#: Queries of a block that are compared with a batch at once.
STEP = 256


def unit(v: Column | str) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    v = (F.col(v) if isinstance(v, str) else v).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def top_k_in_scope(queries: DataFrame, chunks: DataFrame, scope: str, query: str, chunk: str, vector: str, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest chunks of the query's own document, with the columns ``keep`` of the chunk; ties by chunk id. Fewer chunks than k give all."""
    q = queries.select(scope, F.col(query).alias("_q"), F.col(vector).alias("_qv"))
    c = chunks.select(scope, F.col(chunk).alias("_c"), F.col(vector).alias("_cv"), *keep)
    near = q.join(c, scope).select(scope, "_q", "_c", squared_distance(F.col("_qv"), F.col("_cv")).alias("dist"), *keep)
    by = Window.partitionBy(scope, "_q").orderBy("dist", "_c")
    return near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select(scope, F.col("_q").alias("query_id"), F.col("_c").alias("chunk_id"), "rank", "dist", *keep)


def nearest_rows(q: np.ndarray, x: np.ndarray, k: int) -> list[int]:
    """Rows of ``x`` nearest to one vector, in order, ties by row; the distances are those of squared_distance to the last bit."""
    t = q[None, :] - x
    d = np.add.accumulate(t * t, axis=1)[:, -1]  # one dimension after the other, as there
    return np.argsort(d, kind="stable")[:k].tolist()


def _nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ids) of the k nearest of each query among ``x`` and the ``best`` so far, ties by id; the distances are those of squared_distance to the last bit."""
    size = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :]
    rough = size - 2 * q @ x.T
    # rough and exact distance err by at most about 4 (dimensions + 4) roundings of size, whatever the order of the sums; this is twice as much
    slack = size * (4 * (q.shape[1] + 8) * np.finfo(np.float64).eps)
    limit = np.partition(rough + slack, k - 1, axis=1)[:, k - 1] if len(ids) >= k else np.full(len(q), np.inf)
    if best is not None and best[0].shape[1] == k:
        limit = np.fmin(limit, best[0][:, -1])
    r, c = np.nonzero(~(rough - slack > limit[:, None]))  # what is no number stays
    d, i = np.zeros(len(r)), ids[c]
    for n in range(q.shape[1]):
        t = q[r, n] - x[c, n]
        d += t * t
    if best is not None:
        r = np.concatenate([np.repeat(np.arange(len(q)), best[0].shape[1]), r])
        d, i = np.concatenate([best[0].ravel(), d]), np.concatenate([best[1].ravel(), i])
    order = np.lexsort((i, d, r))
    r = r[order]
    order = order[np.arange(len(r)) - np.searchsorted(r, r) < k]
    return d[order].reshape(len(q), -1), i[order].reshape(len(q), -1)


def top_k(queries: DataFrame, rows: DataFrame, query: str, row: str, vector: str, k: int, scope: str | None = None) -> DataFrame:
    """The k nearest of all rows for each query, or of those with the query's ``scope`` where a scope may be large.

    Reads the queries block by block when called. Ties by row id; null vectors
    and null scopes match nothing.
    """
    spark = rows.sparkSession
    here = F.col(scope).cast("string") if scope else F.lit("")

    def scan(block: list) -> DataFrame:
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by: dict[str, list] = {}
            for q, s, v in held.value:
                by.setdefault(s, []).append((q, v))
            groups = {s: (np.array([q for q, _ in g]), np.array([v for _, v in g], np.float64)) for s, g in by.items()}
            best: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                ids = b.column(0).to_numpy(zero_copy_only=False)
                vectors = np.array(b.column(1).to_pylist(), np.float64)
                at: dict[str, list[int]] = {}
                for n, s in enumerate(b.column(2).to_pylist()):
                    if s in groups:
                        at.setdefault(s, []).append(n)
                for s, ns in at.items():
                    q, x, i = groups[s][1], vectors[ns], ids[ns]
                    for n in range(0, len(q), STEP):
                        best[s, n] = _nearest(q[n : n + STEP], x, i, k, best.get((s, n)))
            for (s, n), (_, i) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(groups[s][0][n : n + STEP], i.shape[1])), pa.array(i.ravel())], names=["_q", "_c"])

        return rows.select(F.col(row).cast("long"), vector, here.alias("_s")).filter(F.col(vector).isNotNull()).mapInArrow(run, "_q long, _c long")

    blocks, block = [], []
    for r in queries.select(F.col(query).cast("long"), here, vector).filter(F.col(vector).isNotNull()).toLocalIterator():
        block.append(tuple(r))
        if len(block) == BLOCK:
            blocks.append(scan(block))
            block = []
    if block:
        blocks.append(scan(block))
    if not blocks:
        return spark.createDataFrame([], "query_id long, chunk_id long, rank int, dist double")
    candidates = reduce(DataFrame.unionByName, blocks)
    q = queries.select(F.col(query).cast("long").alias("_q"), F.col(vector).alias("_qv"))
    c = rows.select(F.col(row).cast("long").alias("_c"), F.col(vector).alias("_cv"))
    near = candidates.join(q, "_q").join(c, "_c").select("_q", "_c", squared_distance(F.col("_qv"), F.col("_cv")).alias("dist"))
    by = Window.partitionBy("_q").orderBy("dist", "_c")
    return near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select(F.col("_q").alias("query_id"), F.col("_c").alias("chunk_id"), "rank", "dist")


def contexts(ranked: DataFrame, keys: str | Sequence[str], chunk: str, max_chars: int | None = 30_000) -> DataFrame:
    """Chunks of each query joined in rank order, cut to ``max_chars`` if given."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(chunk).alias("chunk")))), lambda s: s.chunk)
    joined = F.array_join(parts, "\n\n")
    return ranked.groupBy(*keys).agg((joined if max_chars is None else F.substring(joined, 1, max_chars)).alias("contexto"))
