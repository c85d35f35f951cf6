"""Problem 7: sources mixed to target weights, with capped repetition.

Sizes are tokens of a public tokenizer. The requested total is divided by the
target weights; a source that cannot give its share within its cap gives what it
can, and the rest is divided again among the others by their weights. Each
source is then a stream of its documents in hash order, epoch after epoch, cut
into blocks of equal size.

The streams are interleaved by Pfair scheduling: block j of a source with n of N
blocks is released at slot floor(jN/n), has its deadline at ceil((j+1)N/n), and
the released block with the earliest deadline goes first. At every prefix of the
result a source is less than one block from its share (besides the document that
straddles a block's end). ``block_tokens`` is the size of a block, whatever the
size of the data, and so the bound of that deviation.

The positions in a stream are prefix sums in two steps, over at most ``BUCKETS``
hash buckets of each source and then inside a bucket, so that no source is held
by one task; rows are shuffled by bucket once, without texts. The schedule is
made in an executor, row after row: it needs the state of each source only, and
some microseconds for a block. It is joined by source and block, and is
broadcast only up to ``MOST_BROADCAST`` blocks. The driver sees
the targets and the token totals of the listed sources.

Defined results: a source that is null, has no target, or has target 0 or less
or a cap below 1 gives nothing; a listed source without documents gets share 0
and its weight goes to the others; null text has 0 tokens; repeated texts under
other ids are documents of their own; a run of more than ``PIECE`` white-space
characters is counted in cuts, any other text whole; repeated target rows of one source are
added up, with the greatest cap; an empty corpus gives no documents and shares
of 0. Ties of the hash go by id. Other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garimpo.session import shared_dir

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# The word pattern that these vocabularies were made with. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS
#: Tokens of a block of the schedule.
BLOCK_TOKENS = 1 << 16
#: Blocks of a schedule that is broadcast at most; a longer one is joined by shuffle.
MOST_BROADCAST = 1 << 18
#: Most targets that are taken to the driver.
MOST_TARGETS = 10_000
#: Characters that the tokenizer is given at once, as it fails on longer white space; cuts go where no token can reach across.
PIECE = 100_000
_CUT = re.compile(r"(?<=\S)(?=\s)")


@dataclass(frozen=True)
class Target:
    source: str
    weight: float
    repeats: int


@dataclass(frozen=True)
class Share:
    """What is taken from one source, in tokens."""

    source: str
    weight: float
    available: int
    taken: int


def encoding(tokenizer: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, tokenizer.splitlines()) if a}
    return tiktoken.Encoding("garimpo", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(encode, text: str | None) -> int:
    """Tokens of a text. A very long one is counted in pieces that end before white space, which begins a token."""
    if not text:
        return 0
    n, at = 0, 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end > at and not (text[end].isspace() and not text[end - 1].isspace()):
            end -= 1
        if end == at and text[at + PIECE].isspace():  # white space only
            end = at + PIECE
        elif end == at:
            later = _CUT.search(text, at + PIECE)
            end = later.start() if later else len(text)
        n += len(encode(text[at:end]))
        at = end
    return n + len(encode(text[at:]))


def with_tokens(df: DataFrame, key: str, source: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(_id, _source, _tokens) of each document. The vocabulary file is read when called."""
    spark = df.sparkSession
    with open(tokenizer, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(held.value).encode_ordinary
        for b in batches:
            n = pa.array([count_tokens(encode, t) for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=["_id", "_source", "_tokens"])

    cols = [F.col(key).cast("long").alias("_id"), F.col(source).cast("string").alias("_source"), F.col(text).cast("string").alias("_text")]
    return df.select(*cols).mapInArrow(run, "_id long, _source string, _tokens long")


def targets(df: DataFrame, source: str, weight: str, repeats: str) -> list[Target]:
    rows = (
        df.filter(F.col(source).isNotNull() & (F.col(weight) > 0) & (F.col(repeats) >= 1))
        .groupBy(F.col(source).cast("string").alias("s"))
        .agg(F.sum(F.col(weight).cast("double")).alias("w"), F.max(F.col(repeats).cast("int")).alias("r"))
        .orderBy("s")
        .limit(MOST_TARGETS + 1)
        .collect()
    )
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} sources")
    return [Target(r.s, r.w, r.r) for r in rows]


def allot(wanted: list[Target], available: dict[str, int], total: int) -> list[Share]:
    """Water filling: shares by weight, capped sources at their cap, the rest divided again."""
    cap = {t.source: available.get(t.source, 0) * t.repeats for t in wanted}
    weight = {t.source: t.weight for t in wanted}
    taken: dict[str, int] = {}
    open_ = [t.source for t in wanted]
    left = min(total, sum(cap.values()))
    while open_:
        sum_w = sum(weight[s] for s in open_)
        full = [s for s in open_ if cap[s] <= left * weight[s] / sum_w]
        if not full:
            taken |= {s: int(left * weight[s] / sum_w) for s in open_}
            break
        for s in full:
            taken[s] = cap[s]
        left -= sum(cap[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return [Share(t.source, t.weight, available.get(t.source, 0), taken.get(t.source, 0)) for t in wanted]


def pfair(blocks: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) by release times, deadlines and earliest deadline first."""
    total = sum(blocks.values())
    names = sorted(blocks)
    coming = [(0, k, 0) for k, s in enumerate(names) if blocks[s]]  # (release, source, block)
    heapq.heapify(coming)
    ready: list[tuple[int, int, int]] = []  # (deadline, source, block)
    for slot in range(total):
        while coming and coming[0][0] <= slot:
            _, k, j = heapq.heappop(coming)
            n = blocks[names[k]]
            heapq.heappush(ready, (-(-(j + 1) * total // n), k, j))
            if j + 1 < n:
                heapq.heappush(coming, ((j + 1) * total // n, k, j + 1))
        _, k, j = heapq.heappop(ready)
        yield names[k], j, slot


def schedule(spark: SparkSession, blocks: dict[str, int]) -> DataFrame:
    """The rows of ``pfair``, made in one task that holds a batch at a time."""

    def run(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pfair(blocks)
        while batch := list(islice(rows, 1 << 16)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*batch), (pa.string(), pa.int64(), pa.int64()))], names=["_source", "_block", "slot"])

    return spark.range(1, numPartitions=1).mapInArrow(run, "_source string, _block long, slot long")


@dataclass
class Mixture:
    """``documents``: the chosen copies in order of (slot, posicao); ``shares``: one row for each target."""

    documents: DataFrame
    shares: DataFrame


def mix(docs: DataFrame, key: str, source: str, text: str, wanted: list[Target], total_tokens: int | None = None, tokenizer: str = TOKENIZER, seed: int = 0, block_tokens: int = BLOCK_TOKENS) -> Mixture:
    """Chooses documents for ``total_tokens`` (none given: as many as the listed sources hold once).

    Counts the tokens when called and keeps the counts, without texts, as a
    checkpoint in the shared folder; the rest is lazy.
    """
    spark = docs.sparkSession
    names = [t.source for t in wanted]
    counted = with_tokens(docs.filter(F.col(source).isin(names)) if names else docs.limit(0), key, source, text, tokenizer)
    shared_dir(spark)
    hashed = counted.withColumn("_hash", F.xxhash64("_id", F.lit(seed)))
    counted = hashed.withColumn("_bucket", F.shiftrightunsigned("_hash", 64 - BUCKET_BITS).cast("int")).checkpoint()

    sums = counted.groupBy("_source", "_bucket").agg(F.sum("_tokens").alias("_sum"))
    by_source = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    available = {r[0]: int(r[1]) for r in counted.groupBy("_source").agg(F.sum("_tokens")).collect()}
    shares = allot(wanted, available, sum(available.values()) if total_tokens is None else total_tokens)

    plan = spark.createDataFrame([(s.source, s.weight, s.available, s.taken) for s in shares], "_source string, _weight double, _available long, _taken long")
    blocks = {s.source: -(-s.taken // block_tokens) for s in shares if s.taken}
    slots = schedule(spark, blocks)
    slots = F.broadcast(slots) if sum(blocks.values()) <= MOST_BROADCAST else slots.hint("shuffle_merge")  # the planner can't know its size
    prefix = sums.select("_source", "_bucket", F.coalesce(F.sum("_sum").over(by_source), F.lit(0)).alias("_before"))
    in_bucket = Window.partitionBy("_source", "_bucket").orderBy("_hash", "_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        counted.withColumn("_inside", F.coalesce(F.sum("_tokens").over(in_bucket), F.lit(0)))
        .join(prefix, ["_source", "_bucket"])
        .join(F.broadcast(plan), "_source")  # at most MOST_TARGETS rows
        .withColumn("_at", F.col("_before") + F.col("_inside"))
    )
    epochs = F.expr("if(_available > 0, _taken div _available, 0L)")
    copies = epochs + F.expr("if(_at < _taken - if(_available > 0, _taken div _available, 0L) * _available, 1, 0)")
    chosen = (
        placed.withColumn("_copies", copies.cast("int"))
        .filter("_copies > 0")
        .withColumn("repeticao", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .withColumn("posicao", (F.col("repeticao") - 1) * F.col("_available") + F.col("_at"))
        .withColumn("_block", F.expr(f"posicao div {block_tokens}L"))
        .join(slots, ["_source", "_block"], "left")
        .select(F.col("_id").alias(key), F.col("_source").alias(source), "repeticao", F.col("_tokens").alias("tokens"), "slot", "posicao")
    )
    got = chosen.groupBy(F.col(source).alias("_source")).agg(F.sum("tokens").alias("tokens"), F.countDistinct(key).alias("documentos"), F.count(F.lit(1)).alias("copias"), F.max("repeticao").alias("max_repeticao"))
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # over one row for each target
    zero = F.lit(0).cast("long")
    report = (
        F.broadcast(plan)
        .join(got, "_source", "left")
        .select(
            F.col("_source").alias(source),
            F.col("_weight").alias("peso_alvo"),
            F.col("_available").alias("tokens_disponiveis"),
            F.coalesce("tokens", zero).alias("tokens"),
            F.coalesce("documentos", zero).alias("documentos"),
            F.coalesce("copias", zero).alias("copias"),
            F.coalesce("max_repeticao", F.lit(0)).alias("max_repeticao"),
            F.coalesce(F.try_divide(F.col("tokens").cast("double"), whole.cast("double")), F.lit(0.0)).alias("peso_real"),
        )
    )
    return Mixture(chosen, report)
