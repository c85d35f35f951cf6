"""Problem 6: evaluation passages inside training text.

One Aho-Corasick automaton holds every window of ``n`` consecutive words of every
test item, each word as a code of four letters; the text of a document is turned
into the same codes (U+0000 for words of no item) and read once. Codes keep the
automaton's nodes narrow, and stretches of fewer than n coded words hold no
window, so they are passed over. Case, accents,
punctuation, spacing and line breaks play no part; a match is reported in words
and in characters of the original text.

The test items are the stated query set; the automaton is shipped to the
executors, so its size is bounded: items go into blocks of at most
``BLOCK_WORDS`` words, taken to the driver one block at a time, with one
automaton and one pass over the corpus per block. An item longer than a block is
cut into stretches that overlap by n - 1 words. What is found is joined again
into passages before it is counted, so rows are the same for any block size.

Defined results: null and empty documents or items match nothing, and so do
items of fewer than n words; of one item found several times in a document all
passages count, in one row; items that share a passage are all reported; rows
of equal ids count as one document or item; an empty table on either side gives
no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm.words import spans, words

N_WORDS = 12
BLOCK_WORDS = 400_000
RUNS = "array<struct<a: int, b: int, inicio: int, fim: int>>"
_RUN = pa.struct([(x, pa.int32()) for x in ("a", "b", "inicio", "fim")])


class Passages:
    """The automaton over the windows of some items."""

    def __init__(self, items: list[tuple[int, str]], n: int = N_WORDS) -> None:
        import ahocorasick

        self.n = n
        rows = [(item, words(text)) for item, text in items]
        known = dict.fromkeys(w for _, row in rows for w in row)
        self.width = width = next(k for k in range(1, 14) if 26**k >= len(known))
        self.codes = {w: "".join(chr(97 + k // 26**j % 26) for j in range(width)) for k, w in enumerate(known)}
        self.stretch = re.compile("[^\0]{%d,}" % (n * width))
        windows: dict[str, list[int]] = {}
        for item, row in rows:
            coded = [self.codes[w] for w in row]
            for i in range(len(coded) - n + 1):
                ids = windows.setdefault("".join(coded[i : i + n]), [])
                if not ids or ids[-1] != item:
                    ids.append(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_STRING)
        for window, ids in windows.items():
            self.automaton.add_word(window, tuple(dict.fromkeys(ids)))
        self.empty = not windows
        if windows:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
        """For each item in the text its passages: first and last word, begin and end in characters."""
        if self.empty:
            return []
        code, width = self.codes.get, self.width
        row = "".join([code(w, "\0") for w in words(text)])
        runs: dict[int, list[list[int]]] = {}
        for m in self.stretch.finditer(row):
            begin = m.start()
            before = row.count("\0", 0, begin)
            first = before + (begin - before) // width
            for end, ids in self.automaton.iter(m[0]):
                if (end + 1) % width:  # across two codes
                    continue
                last = first + end // width
                for item in ids:
                    own = runs.setdefault(item, [])
                    if own and last - self.n + 1 <= own[-1][1] + 1:
                        own[-1][1] = last
                    else:
                        own.append([last - self.n + 1, last])
        if not runs:
            return []
        at = spans(text)
        return [(item, [(a, b, at[a][0], at[b][1]) for a, b in own]) for item, own in runs.items()]


def _blocks(items: DataFrame, key: str, text: str, n: int, size: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most ``size`` words as windows have them, or one window; fetched row by row."""
    block: list[tuple[int, str]] = []
    held = 0
    for r in items.select(key, text).filter(F.col(key).isNotNull() & F.col(text).isNotNull()).toLocalIterator():
        count, most = len(words(r[1])), max(size, n)
        at = spans(r[1]) if count > most else []
        for i in range(0, max(count - n + 1, 1), most - n + 1):
            own = min(count - i, most)
            if held + own > size and block:
                yield block
                block, held = [], 0
            block.append((r[0], r[1][at[i][0] : at[i + own - 1][1]] if at else r[1]))
            held += own
    if block:
        yield block


_RUNNING: list[tuple[object, int, Passages]] = []


def _running(items: list[tuple[int, str]], n: int) -> Passages:
    """The automaton of a block, built once in a worker."""
    for held, k, found in _RUNNING:
        if held is items and k == n:
            return found
    found = Passages(items, n)
    _RUNNING[:] = [(items, n, found)]
    return found


def _merged(runs: str) -> str:
    """SQL for passages of one document and item, in order: those that overlap or touch become one."""
    wider = "named_struct('a', element_at(st, -1).a, 'b', greatest(element_at(st, -1).b, x.b), 'inicio', element_at(st, -1).inicio, 'fim', greatest(element_at(st, -1).fim, x.fim))"
    return f"""aggregate(array_sort({runs}), cast(array() as {RUNS}), (st, x) ->
        if(size(st) > 0 and x.a <= element_at(st, -1).b + 1, concat(slice(st, 1, size(st) - 1), array({wider})), concat(st, array(x))))"""


def leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, n: int = N_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and item that share at least n consecutive words. Reads the items when called."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc).cast("long"), F.col(text).cast("string"))
    schema = f"_doc long, _item long, runs {RUNS}"

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _running(held.value, n)
            for b in batches:
                rows = [(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t and d is not None for hit in found.find(t)]
                if rows:
                    runs = pa.array([[dict(zip(("a", "b", "inicio", "fim"), x)) for x in r] for _, _, r in rows], pa.list_(_RUN))
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), runs], names=["_doc", "_item", "runs"])

        return source.mapInArrow(run, schema)

    scans = [scan(b) for b in _blocks(items, item, item_text, n, block_words)]
    found = reduce(DataFrame.unionByName, scans) if scans else spark.createDataFrame([], schema)
    if len(scans) > 1:  # windows of one item may be in several automata
        found = found.groupBy("_doc", "_item").agg(F.flatten(F.collect_list("runs")).alias("runs")).withColumn("runs", F.expr(_merged("runs")))
    first = F.col("runs")[0]
    return found.select(
        F.col("_doc").alias(doc),
        F.col("_item").alias(item),
        F.aggregate("runs", F.lit(0), lambda k, x: k + x.b - x.a + 1).alias("n_palavras"),
        F.size("runs").alias("n_trechos"),
        first.inicio.alias("inicio"),
        first.fim.alias("fim"),
    )
