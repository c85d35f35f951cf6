"""Problem 1: one consistent form for text that only looks the same.

A longest-match transducer over grapheme clusters. Its mapping is compiled once,
on the driver, from Unicode's own decompositions (widths, accents, spaces, letter
ligatures, font variants) and a short table of look-alike letters, and is checked
for conflicts: a key has one output, no output can be rewritten again, and no
ordinary character is a key. The compiled tables, whose size is fixed, are sent
to the executors.

Each text is read once, cluster by cluster: the base goes through the table of
single characters, marks join it for as long as the table of joins has a longer
match, and invisible characters are consumed without output. The state beside it
is the word's: the scripts of its letters so far. A cluster has one output as it
stands and one in look-alike letters; which of them counts is settled at the end
of the word, by its state.

Look-alike letters are rewritten only in a word that mixes scripts: words wholly
in another script are ordinary and stay as they are. If the word holds letters
of another script that have no Latin twin, its Latin twins go to that script
instead.

Defined results: null stays null; the empty text stays empty; text of ordinary
characters is returned unchanged whatever its length; applying the operator
twice changes nothing more. Columns of the input other than the one named are
kept, and ties or repeated rows are treated row by row.
"""

from __future__ import annotations

import unicodedata as U
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters with a Latin twin, by script: the n-th letter on the left looks like the n-th on the right. Fixed values.
TWINS = (
    ("Cyrillic", "АВЕКМНОРСТУХІЈЅԚԜѴԌҮаеорсухіјѕһԁԛԝѵӏкгүёїѐ", "ABEKMHOPCTYXIJSQWVGYaeopcyxijshdqwvlkryëïè"),
    ("Greek", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿαονιρυκγϲϳχηωάόίύΆΈΊΌ", "ABEZHIKMNOPTYXCJaovipukycjxnwáóíúÁÉÍÓ"),
    ("Armenian", "ՏԼՕՍոսցօհզքյռ", "SLOUnugohqpjn"),
    ("Cherokee", "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),
)
# Latin letters and signs that look like ASCII ones. Fixed values.
SIGNS = dict(zip("ɑɡɩ−⁄∕․ʼ;∶∣", "agi-//.’;:|"))
# Characters that cannot be seen, besides those of the category Cf and control characters. Fixed values.
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍᠎᠏ㅤﾠ"
VARIATION = [(0xFE00, 0xFE0F), (0xE0100, 0xE01EF)]
#: Arabic and other prefixed format signs can be seen.
SEEN_FORMAT = set("؀؁؂؃؄؅۝܏࢐࢑࣢\U000110bd\U000110cd")
PLAIN_SPACE = "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85"


class Conflict(ValueError):
    """The mapping would be ambiguous."""


def unseen(c: str) -> bool:
    k = U.category(c)
    if k == "Cf":
        return c not in SEEN_FORMAT
    if k == "Cc":
        return c not in PLAIN_SPACE
    return c in UNSEEN or any(a <= ord(c) <= b for a, b in VARIATION)


def _assigned() -> list[tuple[str, str]]:
    """Characters with their categories, without ideographs and Hangul syllables."""
    spans = (range(0x34FF), range(0x4DC0, 0x4E00), range(0xA000, 0xAC00), range(0xD7A4, 0xD800), range(0xFB00, 0x20000), range(0xE0000, 0xE0200))
    found = [(c, U.category(c)) for span in spans for c in map(chr, span)]
    return [(c, k) for c, k in found if k not in ("Cn", "Co")]


def _singles() -> dict[str, str]:
    """One character each: widths, font variants, ligatures, roman numerals, spaces and canonical twins."""
    out: dict[str, str] = {}
    for c, k in _assigned():
        n = ord(c)
        if n < 0x80 or unseen(c):
            continue
        if k in ("Zs", "Zl", "Zp"):
            out[c] = " "
            continue
        how = U.decomposition(c)
        if not how:
            continue
        if how[0] == "<":
            tag = how[1 : how.index(">")]
            if tag in ("wide", "narrow", "font", "noBreak") or tag == "compat" and (0xFB00 <= n <= 0xFB06 or 0x2160 <= n <= 0x217F):
                out[c] = U.normalize("NFKC", c)
        elif U.normalize("NFC", c) != c and not U.combining(c):
            out[c] = U.normalize("NFC", c)
    out.pop("ª", None), out.pop("º", None)
    return out


def _clusters() -> dict[str, str]:
    """Decomposed clusters of every composed letter, canonical order."""
    out = {}
    for c, _ in _assigned():
        how = U.decomposition(c)
        if how and how[0] != "<" and U.normalize("NFC", c) == c:
            full = U.normalize("NFD", c)
            if len(full) > 1:
                out[full] = c
    return out


@lru_cache(1)
def mapping() -> tuple[dict[str, str], dict[str, str], dict[str, dict[str, str]]]:
    """(general mapping, look-alikes to Latin, Latin to each script); raises Conflict."""
    general: dict[str, str] = {}

    def add(to: dict[str, str], key: str, value: str) -> None:
        if to.setdefault(key, value) != value:
            raise Conflict(f"{key!a} has two outputs, {to[key]!a} and {value!a}")

    for k, v in _singles().items():
        add(general, k, v)
    for k, v in SIGNS.items():
        general.pop(k, None)
        add(general, k, v)
    for k, v in _clusters().items():
        add(general, k, v)
    twins: dict[str, str] = {}
    back: dict[str, dict[str, str]] = {}
    for script, theirs, latin in TWINS:
        if len(theirs) != len(latin):
            raise Conflict(f"the {script} table is uneven")
        for a, b in zip(theirs, latin):
            add(twins, a, b)
            back.setdefault(script, {}).setdefault(b, a)
    for k, v in [*general.items(), *twins.items()]:
        if any(x in general or unseen(x) or k in twins and x in twins for x in v):
            raise Conflict(f"the output of {k!a}, {v!a}, would be rewritten again")
        if k.isascii() or k in "ªº–—‘’“”":
            raise Conflict(f"{k!a} is ordinary")
    return general, twins, back


@dataclass(frozen=True)
class Compiled:
    """The transducer's tables: plain dictionaries of fixed size."""

    single: dict[str, str]
    #: Canonical decompositions, in full.
    parts: dict[str, str]
    #: Starter and mark to their composed letter.
    joins: dict[tuple[str, str], str]
    #: Combining marks with their classes.
    marks: dict[str, int]
    unseen: frozenset[str]
    script: dict[str, str]
    twins: dict[str, str]
    back: dict[str, dict[str, str]]


@lru_cache(1)
def compiled() -> Compiled:
    general, twins, back = mapping()
    every = _assigned()
    parts, joins = {}, {}
    for c, _ in every:
        how = U.decomposition(c)
        if how and how[0] != "<":
            parts[c] = U.normalize("NFD", c)
            if U.normalize("NFC", c) == c and " " in how:
                joins[tuple(chr(int(x, 16)) for x in how.split())] = c
    letters = "".join(c for c, k in every if k[0] == "L")
    script = {c: s for s in ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee") for c in regex.findall(rf"\p{{Script={s}}}", letters)}
    return Compiled(
        {k: v for k, v in general.items() if len(k) == 1},
        parts,
        joins,
        {c: U.combining(c) for c, k in every if k[0] == "M"},
        frozenset(c for c, _ in every if unseen(c)),
        script,
        twins,
        back,
    )


class Transducer:
    """Runs the compiled mapping. ``consistent`` rewrites one text."""

    #: Clusters whose outputs are remembered.
    MEMO = 100_000

    def __init__(self, tables: Compiled) -> None:
        self.tables = t = tables
        self.extends = frozenset(t.marks) | t.unseen
        #: A text without any of these is in its consistent form already.
        self.special = frozenset(t.single) | self.extends | frozenset(t.twins)
        self.memo: dict[str, tuple[str, str, frozenset[str]]] = {}

    def _joined(self, chars: list[str]) -> str:
        """Marks in the order of their classes, each joined to the letter before as long as there is a longer match."""
        marks, joins = self.tables.marks, self.tables.joins
        i = 0
        while i < len(chars):  # a stable sort of each run of marks
            j = i
            while j < len(chars) and marks.get(chars[j], 0):
                j += 1
            chars[i:j] = sorted(chars[i:j], key=marks.__getitem__)
            i = j + 1
        out: list[str] = []
        starter, last = -1, 0
        for c in chars:
            k = marks.get(c, 0)
            if starter >= 0 and (last == 0 and starter == len(out) - 1 or 0 < last < k):
                longer = joins.get((out[starter], c))
                if longer:
                    out[starter] = longer
                    continue
            if k:
                last = k
            else:
                starter, last = len(out), 0
            out.append(c)
        return "".join(out)

    def _cluster(self, cluster: str) -> tuple[str, str, frozenset[str]]:
        """A cluster's output, its output in look-alike letters, and the scripts of its letters."""
        got = self.memo.get(cluster)
        if got is None:
            t = self.tables
            seen = [t.single.get(c, c) for c in cluster if c not in t.unseen]
            own = "".join(seen)
            if len(seen) > 1 or own in t.marks:
                own = self._joined(list("".join([t.parts.get(c, c) for c in own])))
            twin = own
            if any(c in t.twins for c in own):
                twin = "".join([t.twins.get(c, c) for c in own])
                if len(twin) > 1:
                    twin = self._joined(list("".join([t.parts.get(c, c) for c in twin])))
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            got = self.memo[cluster] = (own, twin, frozenset([t.script[c] for c in own if c in t.script]))
        return got

    def _settled(self, clusters: list[tuple[str, str, frozenset[str]]], scripts: set[str]) -> str:
        """The output of a word, by its state."""
        t = self.tables
        if len(scripts) > 1:
            letters = [c for own, _, _ in clusters for c in own if c in t.script]
            bound = {t.script[c] for c in letters if t.script[c] != "Latin" and c not in t.twins}
            to = t.back.get(next(iter(bound)), {}) if len(bound) == 1 else {}
            if to and scripts == bound | {"Latin"} and all(c in to for c in letters if t.script[c] == "Latin"):
                return "".join([to.get(c, c) for own, _, _ in clusters for c in own])
            return "".join([twin for _, twin, _ in clusters])
        return "".join([own for own, _, _ in clusters])

    def consistent(self, text: str | None) -> str | None:
        if text is None or text.isascii() or self.special.isdisjoint(text):
            return text
        extends = self.extends
        out: list[str] = []
        word: list[tuple[str, str, frozenset[str]]] = []
        scripts: set[str] = set()
        i, n = 0, len(text)
        while i < n:
            c = text[i]
            j = i + 1
            while j < n and text[j] in extends:
                j += 1
            got = self._cluster(text[i:j])
            if c.isalpha() or c in extends:
                word.append(got)
                scripts |= got[2]
            else:
                if word:
                    out.append(self._settled(word, scripts))
                    word, scripts = [], set()
                out.append(got[0])
            i = j
        if word:
            out.append(self._settled(word, scripts))
        return "".join(out)


@lru_cache(1)
def transducer() -> Transducer:
    return Transducer(compiled())


def consistent(spark: SparkSession, text: Column | str) -> Column:
    """The text in its one consistent form. Sends the compiled tables, of fixed size, to the executors."""
    held = spark.sparkContext.broadcast(compiled())

    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        t = _running(held)
        return pa.array([t.consistent(x) for x in texts.to_pylist()], pa.string())

    return run(F.col(text) if isinstance(text, str) else text)


_RUNNING: dict[int, Transducer] = {}


def _running(held) -> Transducer:
    """One transducer for each worker and broadcast."""
    got = _RUNNING.get(id(held.value))
    if got is None:
        _RUNNING.clear()
        got = _RUNNING[id(held.value)] = Transducer(held.value)
    return got


def with_consistent(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``, the consistent form, and ``<out>_changed``; null text gives null and false."""
    return df.withColumn(out, consistent(df.sparkSession, F.col(text))).withColumn(f"{out}_changed", F.coalesce(F.col(out) != F.col(text), F.lit(False)))
