"""Problem 8: reading level of each document, by regularised ordinal regression.

Features: length, words a sentence, letters a word, share of long words, lexical
diversity (two length-corrected type-token measures), word rarity, connectives,
and a clause-depth proxy (subordinating words and commas a sentence). They are
standardised and clipped, and a proportional-odds model with an L2 penalty maps
them to the graded levels. The estimate is the expected level, so it is
comparable across sources and with the grades.

Word rarity is the mean surprisal of the words under counts over the whole
corpus. The counts are exact and stay distributed, as a checkpoint in the shared
folder. The ``VOCABULARY`` most frequent words (whole classes of equal frequency,
by logarithmic bins) have their own surprisal; all others share that of their
mean count, so a rare word is rare in a corpus of any size. That table and the
sizes of the bins are all of the corpus that reaches the driver and is broadcast.
The model is fitted to at most ``MOST_LABELS`` labelled rows, least hash of the
id first.

Words a sentence count up to 200 and letters a word up to 30 (number tables and
endless lines), and a standardised feature up to four deviations.

Defined results: a null, empty or wordless text has no estimate (null level, 0
words); texts of any length are read whole; rows without a level are left out of
the fit, and several judgements of one document each count; with fewer than
``LEAST_LABELS`` usable labels there is no model and all levels are null; an
empty corpus gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm.words import normalised
from garimpo.session import shared_dir

#: Most words with a count of their own.
VOCABULARY = 1 << 17
#: Bins of word counts for each doubling.
BINS = 64
MOST_LABELS = 20_000
LEAST_LABELS = 8
LEVELS = 5
LONG_WORD = 10
MEMO = 300_000
PENALTY = 1.0

# Words that link statements, and words that open subordinate clauses; without accents. Fixed values.
CONNECTIVES = frozenset(
    b"porque pois portanto assim entao alem tambem contudo todavia entretanto porem mas ademais outrossim destarte logo conforme consoante porquanto "
    b"conquanto embora enquanto quando depois antes alias inclusive subsidiariamente preliminarmente ontologicamente finalmente primeiro segundo "
    b"sino pero aunque ademas tambien luego entonces because therefore however moreover thus hence although while".split()
)
SUBORDINATORS = frozenset(
    b"que cujo cuja cujos cujas qual quais onde se caso embora conquanto porquanto quando enquanto conforme consoante salvo ainda maxime como "
    b"cuyo cuya cual donde aunque which whose that where if unless although whereas".split()
)
FEATURES = ("log_palavras", "palavras_por_frase", "letras_por_palavra", "palavras_longas", "diversidade", "diversidade_log", "raridade", "conectivos", "subordinadas_por_frase", "virgulas_por_frase")


@dataclass(frozen=True)
class Rarity:
    """Surprisal of words in bits: of frequent ones their own, of all others one value."""

    words: list[bytes]
    bits: np.ndarray
    other: float


class Measure:
    def __init__(self, rarity: Rarity) -> None:
        # rows of the table: the words, connectives and subordinators without a count of their own, other short and long words
        words = list(dict.fromkeys([*rarity.words, *sorted(CONNECTIVES | SUBORDINATORS)]))
        self.rows = _Rows(zip(words, range(len(words))))
        self.table = np.zeros((len(words) + 2, 4))
        self.table[:, 0] = rarity.other
        self.table[: len(rarity.words), 0] = rarity.bits
        self.table[:-2, 1:] = [(len(w) >= LONG_WORD, w in CONNECTIVES, w in SUBORDINATORS) for w in words]
        self.table[-1, 1] = 1

    def features(self, text: str | None) -> list[float] | None:
        ws = normalised(text).split() if text else ()
        n = len(ws)
        if not n:
            return None
        types = len(set(ws))
        bits, long, connectives, subordinators = self.table[np.fromiter(map(self.rows.__getitem__, ws), np.int64, n)].sum(0).tolist()
        letters = sum(map(len, ws))
        ends = text.count(". ") + text.count(".\n") + text.count("? ") + text.count("! ") + text.count("?\n") + text.count("!\n") + text.count(".\r")
        sentences = max(1, ends + (text.rstrip()[-1:] in ".!?"))
        return [
            math.log(n),
            min(n / sentences, 200.0),
            min(letters / n, 30.0),
            long / n,
            types / math.sqrt(2 * n),
            math.log(types + 1) / math.log(n + 1),
            bits / n,
            connectives / n,
            subordinators / sentences,
            text.count(",") / sentences,
        ]


class _Rows(dict):
    """word -> row of the table; other words take the last two rows, counted from the end."""

    def __missing__(self, w: bytes) -> int:
        return -1 if len(w) >= LONG_WORD else -2


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n) of all words of all texts, counted in the partitions before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return got

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    counts.update(normalised(t).split())
                    if len(counts) > MEMO:
                        yield flush()
        yield flush()

    return df.select(F.col(text).cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rarity(counts: DataFrame, most: int | None = None) -> Rarity:
    """Surprisal under the counts, with one added for each word. Reads ``counts`` twice."""
    most = VOCABULARY if most is None else most
    at = F.floor(F.log2("n") * BINS).cast("int")
    bins = counts.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).orderBy(F.desc("bin")).collect()
    held, least = 0, None
    for r in bins:
        if held + r.words > most:
            break
        held, least = held + r.words, r.bin
    rest = [r for r in bins if least is None or r.bin < least]
    types, total = sum(r.words for r in bins), sum(r.n for r in bins)
    few, kinds = sum(r.n for r in rest), sum(r.words for r in rest)
    # at most ``most`` rows
    own = counts.filter(at >= least).orderBy("word").toArrow() if held else pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
    bits = np.log2((total + types) / (own["n"].to_numpy() + 1.0))
    return Rarity(own["word"].to_pylist(), bits, math.log2((total + types) / (few / kinds + 1)) if kinds else 0.0)


def known_words(docs: DataFrame, text: str) -> Rarity:
    """The rarity of the words of all documents. Runs jobs."""
    shared_dir(docs.sparkSession)
    return rarity(word_counts(docs, text).checkpoint())


@dataclass(frozen=True)
class Ordinal:
    """Proportional odds: P(level <= k) = logistic(cut[k] - x . weight)."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cuts: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4) @ self.weight
        below = 1 / (1 + np.exp(-(self.cuts[None, :] - z[:, None])))
        below = np.hstack([np.zeros((len(x), 1)), below, np.ones((len(x), 1))])
        return np.diff(below, axis=1)

    def expected(self, x: np.ndarray) -> np.ndarray:
        return self.probabilities(x) @ np.arange(1, LEVELS + 1)


def fit(x: np.ndarray, level: np.ndarray, penalty: float = PENALTY, rounds: int = 1500) -> Ordinal:
    """Full-batch gradient descent with momentum and adaptive steps; deterministic."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    xs = np.clip((x - mean) / scale, -4, 4)
    n, d = xs.shape
    y = level.astype(int) - 1
    share = np.clip(np.cumsum(np.bincount(y, minlength=LEVELS)) / n, 0.01, 0.99)[:-1]
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(d), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        w, first, gaps = p[:d], p[d], np.exp(p[d + 1 :])
        cuts = first + np.concatenate([[0.0], np.cumsum(gaps)])
        edge = np.concatenate([[-50.0], cuts, [50.0]])
        z = xs @ w
        hi, lo = 1 / (1 + np.exp(-(edge[y + 1] - z))), 1 / (1 + np.exp(-(edge[y] - z)))
        prob = np.maximum(hi - lo, 1e-12)
        fh, fl = hi * (1 - hi) / prob, lo * (1 - lo) / prob
        gw = xs.T @ (fh - fl) / n + penalty * w / n
        gc = np.zeros(LEVELS + 1)
        np.add.at(gc, y + 1, -fh)
        np.add.at(gc, y, fl)
        gc = gc[1:-1] / n
        tail = np.cumsum(gc[::-1])[::-1]
        g = np.concatenate([gw, [tail[0]], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    gaps = np.exp(p[d + 1 :])
    return Ordinal(mean, scale, p[:d], p[d] + np.concatenate([[0.0], np.cumsum(gaps)]))


def labelled_features(docs: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, level: str, known: Rarity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, features, levels) of the bounded sample of labelled rows. Runs a job."""
    spark = docs.sparkSession
    usable = labels.select(F.col(label_key).cast("long").alias("_id"), F.col(level).cast("int").alias("_level")).filter(f"_id is not null and _level between 1 and {LEVELS}")
    rows = usable.orderBy(F.xxhash64("_id"), "_id", "_level").limit(MOST_LABELS).toArrow()
    ids, levels = rows["_id"].to_numpy(), rows["_level"].to_numpy()
    if not len(ids):
        return ids, np.zeros((0, len(FEATURES))), levels
    wanted = spark.createDataFrame(pa.table({"_id": np.unique(ids)}))
    held = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Measure(held.value).features
        for b in batches:
            got = [(k, f) for k, f in zip(b.column(0).to_pylist(), map(of, b.column(1).to_pylist())) if f]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), pa.array([f for _, f in got], pa.list_(pa.float64()))], names=["_id", "x"])

    # at most MOST_LABELS ids
    chosen = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(wanted), "_id", "left_semi")
    got = chosen.mapInArrow(run, "_id long, x array<double>").toArrow()
    by = dict(zip(got["_id"].to_pylist(), got["x"].to_pylist()))
    keep = np.array([i in by for i in ids.tolist()], bool)
    x = np.array([by[i] for i in ids[keep].tolist()]).reshape(-1, len(FEATURES))
    return ids[keep], x, levels[keep]


def held_out(docs: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, level: str, parts: int = 2) -> DataFrame:
    """How near the model comes to labels it has not seen: documents are dealt into parts by id, each judged by a model of the others.

    One row for each part and level: labels, how many have that level as the
    likeliest, how many are at most one level off, and the mean error.
    """
    spark = docs.sparkSession
    ids, x, y = labelled_features(docs, key, text, labels, label_key, level, known_words(docs, text))
    part = np.array([zlib.crc32(str(i).encode()) % parts for i in ids.tolist()], int)
    rows = []
    for k in range(parts):
        own = part == k
        if own.any() and (~own).sum() >= LEAST_LABELS:
            p = fit(x[~own], y[~own]).probabilities(x[own])
            off = np.abs(p.argmax(1) + 1 - y[own])
            error = np.abs(p @ np.arange(1, LEVELS + 1) - y[own])
            rows += [(k, v, int(here.sum()), int((off[here] == 0).sum()), int((off[here] <= 1).sum()), float(error[here].mean())) for v in range(1, LEVELS + 1) if (here := y[own] == v).any()]
    return spark.createDataFrame(rows, "parte int, nivel int, rotulos int, exatos int, ate_um int, erro_medio double")


def levels(docs: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, level: str, keep: Sequence[str] = ()) -> DataFrame:
    """``key``, the columns of ``keep``, ``palavras``, ``nivel_estimado`` (1 to 5, real) and ``nivel`` (the likeliest). Fits when called."""
    spark = docs.sparkSession
    known = known_words(docs, text)
    _, x, y = labelled_features(docs, key, text, labels, label_key, level, known)
    model = fit(x, y) if len(y) >= LEAST_LABELS else None
    held = spark.sparkContext.broadcast((known, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, fitted = held.value
        of = Measure(table).features
        for b in batches:
            got = [of(t) for t in b.column(b.num_columns - 1).to_pylist()]
            here = [i for i, f in enumerate(got) if f]
            real: list[float | None] = [None] * len(got)
            best: list[int | None] = [None] * len(got)
            if here and fitted is not None:
                p = fitted.probabilities(np.array([got[i] for i in here]))
                for i, e, k in zip(here, (p @ np.arange(1, LEVELS + 1)).tolist(), (p.argmax(1) + 1).tolist()):
                    real[i], best[i] = e, k
            n = [round(math.exp(f[0])) if f else 0 for f in got]
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(real, pa.float64()), pa.array(best, pa.int32())], names=[*b.schema.names[:-1], "palavras", "nivel_estimado", "nivel"])

    source = docs.select(F.col(key), *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    out = source.mapInArrow(run, f"{kept}, palavras long, nivel_estimado double, nivel int")
    return out.withColumnsRenamed({f"_keep{i}": c for i, c in enumerate(keep)})
