"""Raw delimited files, read in splits although a quoted field may hold line ends.

Problem 3 over files: every split of a file is a chunk. A first pass gives each
split's transition function, from "a record begins here" and from "inside
quotes" to either of the two, and its size; the functions are composed along the
file, which gives each split its start state and true offset. A second pass cuts
every split into records from its own start state. Records that run over the end
of a split leave fragments, which are put together again by the split they began
in. No file is read by one task.

What reaches the driver is one short row for each split, as many as the driver
lists to plan the scan. Fragments are grouped by record, so a group is one record.

Defined results: an empty file has no records; blank lines between records are
no records; a quote that is never closed makes the rest of the file one record,
which is rejected at its end; a broken record ends with its line. Offsets are in
bytes of the file; inside a record, in characters.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.operators import quarantine as Q
from garimpo.session import ship

csv.field_size_limit((1 << 31) - 1)
BLANK = " \t\r"
OPEN, INSIDE = 0, 1  # a record begins with this line, or it goes on inside quotes


class Lines(Q.Delimited):
    """The machine of one line. Strict quoting is that of ``Delimited``; loose quoting takes quotes inside a bare value as they are."""

    def __init__(self, separator: str, strict: bool) -> None:
        super().__init__(separator, "\n", True)
        self.strict = strict

    def step(self, state: int, c: str) -> int:
        if self.strict or c != '"':
            return super().step(state, c)
        return {Q.START: Q.QUOTED, Q.QUOTED: Q.CLOSED, Q.CLOSED: Q.QUOTED}.get(state, Q.BARE)

    def plain(self, state: int, blank: bool) -> int:
        if self.strict:
            return super().plain(state, blank)
        return state if state == Q.QUOTED else Q.BARE

    def after(self, line: str, inside: int) -> int:
        """OPEN or INSIDE after a line and its end."""
        if '"' not in line:
            return inside
        state = self.transition(line, 0, len(line))[Q.QUOTED if inside else Q.START]
        return INSIDE if state == Q.QUOTED else OPEN


@lru_cache(8)
def _machine(separator: str, strict: bool) -> Lines:
    return Lines(separator, strict)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """Lines of each split, in order, as they come."""
    for b in batches:
        lines, names, begins = (b.column(i).to_pylist() for i in range(3))
        at = 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or (names[i], begins[i]) != (names[at], begins[at]):
                yield (names[at], begins[at]), lines[at:i]
                at = i


Reader = Callable[[str], tuple]
_PARSED = [pa.list_(pa.string()), pa.string(), pa.string(), pa.int32()]
_NAMES = ["campos", "motivo", "detalhe", "em"]
PARSED = "campos array<string>, motivo string, detalhe string, em int"


def records(spark: SparkSession, path: str, separator: str = ",", strict: bool = True) -> DataFrame:
    """(origem, posicao, registro): the records of a file or of the files of a folder. Reads the files once when called."""
    whole, joined = _records(spark, path, separator, strict, None)
    whole = whole.select("origem", "posicao", "registro")
    return whole if joined is None else whole.unionByName(joined)


def _parsed(spark: SparkSession, path: str, separator: str, strict: bool, read: Reader) -> DataFrame:
    """(origem, posicao, campos, motivo, detalhe, em) of the records that are not blank; whole ones are read where they are cut."""
    whole, joined = _records(spark, path, separator, strict, read)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [read(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(_PARSED)]], names=["origem", "posicao", *_NAMES])

    whole = whole.select("origem", "posicao", *_NAMES)
    return whole if joined is None else whole.unionByName(joined.filter(F.trim("registro", F.lit(BLANK)) != "").mapInArrow(run, f"origem string, posicao long, {PARSED}"))


def _records(spark: SparkSession, path: str, separator: str, strict: bool, read: Reader | None) -> tuple[DataFrame, DataFrame | None]:
    """Records inside a split, read if there is a reader, and those put together from fragments, if there are any."""
    ship(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _machine(separator, strict)
        found: dict[tuple[str, int], list[int]] = {}
        for key, run in _runs(batches):
            own = found.setdefault(key, [0, OPEN, INSIDE, 0, 0])  # bytes, end state and whether a record ended, from either start
            whole = "\n".join(run)
            own[0] += len(whole.encode()) + 1
            if '"' not in whole:
                for start in (OPEN, INSIDE):
                    own[3 + start] |= own[1 + start] == OPEN
                continue
            for line in run:
                for start in (OPEN, INSIDE):
                    own[1 + start] = m.after(line, own[1 + start])
                    own[3 + start] |= own[1 + start] == OPEN
        rows = [(*k, *v) for k, v in found.items()]
        kinds = [pa.string(), *[pa.int64()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["f", "b", "n", "e0", "e1", "c0", "c1"])

    splits: dict[tuple[str, int], tuple[int, int, int]] = {}
    broken: set[tuple[str, int]] = set()  # splits with a part of a record that runs over their begin or end
    name, state, offset, origin = None, OPEN, 0, 0
    for r in lines.mapInArrow(transitions, "f string, b long, n long, e0 long, e1 long, c0 long, c1 long").orderBy("f", "b").toLocalIterator():
        if r.f != name:
            name, state, offset, origin = r.f, OPEN, 0, 0
        splits[r.f, r.b] = (state, offset, origin)
        if state == OPEN or (r.c0, r.c1)[state]:
            origin = r.b  # where a record that is open at the end of this split began
        begun, state, offset = state, (r.e0, r.e1)[state], offset + r.n
        if INSIDE in (begun, state):
            broken.add((r.f, r.b))
    held = spark.sparkContext.broadcast((splits, broken))

    def cut(batches: Iterator[pa.RecordBatch], fragments: bool) -> Iterator[pa.RecordBatch]:
        starts, broken = held.value
        m = _machine(separator, strict)
        key, state, at, origin = None, OPEN, 0, 0
        buffer: list[str] = []
        begin, part = 0, False
        out: list[tuple] = []

        def put(open_: bool) -> None:
            # a whole record, or a fragment of the one that began in the split ``origin``
            if (part or open_) == fragments:
                out.append((key[0], begin, origin if part or open_ else None, key[1], "\n".join(buffer)))
            buffer.clear()

        def flush() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            names = ["origem", "posicao", "o", "b", "registro"]
            rows = out
            if read and not fragments:
                rows = [(*r[:4], None, *read(r[4])) for r in out if r[4].strip(BLANK)]
                kinds, names = [*kinds, *_PARSED], [*names, *_NAMES]
            got = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
            out.clear()
            return got

        for k, run in _runs(batches):
            if fragments and k not in broken:
                continue
            if k != key:
                if buffer:
                    put(True)
                key = k
                state, at, origin = starts[k]
                begin, part = at, state == INSIDE
                origin = origin if part else k[1]
            for line in run:
                if state == OPEN and '"' not in line:  # a record by itself
                    if not fragments:
                        out.append((key[0], at, None, key[1], line))
                    at += (len(line) if line.isascii() else len(line.encode())) + 1
                    begin, part, origin = at, False, key[1]
                    continue
                buffer.append(line)
                at += (len(line) if line.isascii() else len(line.encode())) + 1
                state = m.after(line, state)
                if state == OPEN:
                    put(False)
                    begin, part, origin = at, False, key[1]
            if len(out) > 10_000:
                yield flush()
        if buffer:
            put(True)
        yield flush()

    columns = "origem string, posicao long, o long, b long, registro string"
    whole = lines.mapInArrow(partial(cut, fragments=False), columns + (f", {PARSED}" if read else ""))
    if not broken:
        return whole, None
    joined = (
        lines.mapInArrow(partial(cut, fragments=True), columns)
        .groupBy("origem", "o")
        .agg(F.min("posicao").alias("posicao"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "registro"))), lambda x: x.registro), "\n").alias("registro"))
        .select("origem", "posicao", "registro")
    )
    return whole, joined


def strict_rows(spark: SparkSession, path: str, columns: Sequence[str], separator: str = ",", header: bool = True) -> tuple[DataFrame, DataFrame]:
    """The records that have all columns, as (origem, posicao, columns), and the others as (origem, posicao, motivo, detalhe, em).

    ``posicao`` is where the record begins in its file, ``em`` the offset of the
    fault inside the record. Values are trimmed.
    """
    ship(spark)
    n = len(columns)

    def read(record: str) -> tuple:
        try:
            fields = Q.Delimited(separator, "\n", True).records(record.removesuffix("\r"))[0]
        except Q.Rejected as e:
            return None, e.motivo, e.detalhe, e.at
        if len(fields) != n:
            return None, "colunas", f"{len(fields)} campos", fields[min(len(fields) - 1, n)][0]
        return [v for _, v in fields], None, None, None

    got = _parsed(spark, path, separator, True, read)
    got = got.filter("posicao > 0") if header else got
    good = got.filter("motivo is null").select("origem", "posicao", *[F.col("campos")[i].alias(c) for i, c in enumerate(columns)])
    return good, got.filter("motivo is not null").select("origem", "posicao", "motivo", "detalhe", "em")


def loose_rows(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(origem, posicao, campos) with the quoting of spreadsheets; the header is a record like others."""

    def read(record: str) -> tuple:
        return next(csv.reader([record.removesuffix("\r")], delimiter=separator), []), None, None, None

    return _parsed(spark, path, separator, False, read).select("origem", "posicao", "campos")
