"""Problem 5: duplicates hidden by formatting differences, by progressive partition refinement.

Records are compared inside a scope (here: the table and the file). A class is
refined step by step and only classes that still have several members go on:

1. scope and a histogram of digits and letters, counted in the values as stored.
   A letter counts under its base letter, in either case and with any accent, so
   that equal records have equal histograms however they are written;
2. the multiset of stripped values, in whichever field each value stands. Only
   members of classes with several are stripped.

Stripping composes accents (canonical equivalents are one text), folds letter
case in full (``ß`` and ``SS``) and keeps letters, marks and digits only, so that
white space, punctuation, signs and characters that cannot be seen play no part;
accents count. Null, empty and punctuation-only values are no value.

Step 1 is a partial aggregation, so a scope or a group of copies that holds a
third of all rows is combined before the shuffle; its counts are joined back as
one row per class, which lets AQE split a skewed class. Pairs are listed block
against block: a class is dealt into blocks of some ``BLOCK`` members, and no
task holds more than two blocks of a class at once.

Defined results: a null scope equals no other, so such rows stay alone; records
without any value in one scope are copies of one another; rows equal as stored
are copies (a pair has two ids, none of them null); of equal candidates the least id is kept; empty
tables give empty results; other columns of the input are ignored, whatever
their names.
"""

from __future__ import annotations

import unicodedata as U
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the comparison disregards.
DISREGARDED = r"[^\p{L}\p{M}\p{N}]"
#: Groups of base letters and digits that are counted; none of them comes out of folding another letter. Fixed values.
COUNTED = ("0123456789", "e", "o", "rc", "ud")
#: Members of a class that are held at once.
BLOCK = 1024


def _forms(base: str) -> str:
    """The characters that are a base letter, in either case, with or without accents."""
    return "".join(c for c in map(chr, (*range(0x30, 0x250), *range(0x1E00, 0x1F00))) if U.normalize("NFD", c)[0].lower() in base)


GROUPS = tuple(map(_forms, COUNTED))


def stripped(x: Column) -> Column:
    """The value as it is compared; '' for no value."""
    upper = F.upper(F.coalesce(x.cast("string"), F.lit("")))
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), upper, F.lit(False))
    kept = F.regexp_replace(F.when(upper.rlike(r"\p{M}"), composed).otherwise(upper), DISREGARDED, "")
    return F.translate(F.lower(kept), "ς", "σ")


def histogram(whole: Column) -> Column:
    """Twelve bits for each group, folded into one long; only a filter, so that overflow does no harm."""
    counts = [F.length(whole) - F.length(F.translate(whole, g, "")) for g in GROUPS]
    return reduce(lambda a, b: a.bitwiseXOR(b), [F.shiftleft(n.cast("long"), 12 * i) for i, n in enumerate(counts)])


def _profile(df: DataFrame, scope: Sequence[str], key: str, fields: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Rows with their cheap invariants, and the names of the columns that make a cheap class."""
    scopes = [f"_scope{i}" for i in range(len(scope))]
    df = df.select(*[F.col(s).alias(n) for s, n in zip(scope, scopes)], F.col(key).alias("_id"), *[F.col(f).cast("string").alias(f"_raw{i}") for i, f in enumerate(fields)])
    return df.withColumn("_hist", histogram(F.concat_ws("", *[F.col(f"_raw{i}") for i in range(len(fields))]))), [*scopes, "_hist"]


def _sized(rows: DataFrame, cheap: list[str], how: str) -> DataFrame:
    """Rows with ``_n``, the members of their cheap class if there are several."""
    several = rows.groupBy(*cheap).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return rows.join(several, cheap, how)


def _exact(fields: int) -> Column:
    return F.array_sort(F.filter(F.array(*[stripped(F.col(f"_raw{i}")) for i in range(fields)]), lambda v: v != ""))


def _list(scope: str | Sequence[str]) -> list[str]:
    return [scope] if isinstance(scope, str) else list(scope)


def duplicate_pairs(df: DataFrame, scope: str | Sequence[str], key: str, fields: Sequence[str], block: int = BLOCK) -> DataFrame:
    """The scope and every pair of copies (id_menor, id_maior). Quadratic in a group by its very result."""
    scope = _list(scope)
    rows, cheap = _profile(df, scope, key, fields)
    rows = rows.dropna(subset=cheap[:-1])
    rows = _sized(rows, cheap, "inner").select(*cheap[:-1], "_id", F.expr(f"cast((_n - 1) div {block} + 1 as int)").alias("_blocks"), _exact(len(fields)).alias("_key"))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda j: F.struct(F.least(F.col("_block"), j).alias("a"), F.greatest(F.col("_block"), j).alias("b")))
    rows = rows.withColumn("_meet", F.explode(meets))
    group = F.struct(*cheap[:-1], "_key", "_meet").alias("_group")
    ids = [F.sort_array(F.collect_list(F.when(F.col("_block") == F.col(f"_meet.{x}"), F.col("_id")))).alias(f"_{x}") for x in "ab"]
    # one column, so that a hot class is shuffled by block again and not held where its cheap class is
    held = rows.select(group, "_block", "_id", "_meet").groupBy("_group").agg(*ids)
    own = F.col("_group._meet.a") == F.col("_group._meet.b")
    held = held.filter((F.size("_a") > F.when(own, 1).otherwise(0)) & (F.size("_b") > 0))
    held = held.select("_group", "_a", "_b", F.posexplode("_a").alias("_at", "_x"))
    rest = F.when(own, F.slice("_b", F.col("_at") + 2, F.size("_b"))).otherwise(F.col("_b"))
    pairs = held.select("_group", "_x", F.explode(rest).alias("_y"))
    out = [F.col(f"_group.{n}").alias(s) for n, s in zip(cheap, scope)]
    return pairs.select(*out, F.least("_x", "_y").alias("id_menor"), F.greatest("_x", "_y").alias("id_maior")).filter("id_menor < id_maior")


def collapse(df: DataFrame, scope: str | Sequence[str], key: str, fields: Sequence[str]) -> DataFrame:
    """One record per class: the one with the least id, and how many copies there are (1: no other)."""
    scope = _list(scope)
    rows, cheap = _profile(df, scope, key, fields)
    rows = _sized(rows, cheap, "left")
    alone = F.col("_n").isNull()
    group = F.struct(*cheap[:-1], F.when(~alone, _exact(len(fields))).alias("_key"), F.when(alone, F.col("_id")).alias("_alone"), F.when(alone, F.monotonically_increasing_id()).alias("_row"))
    kept = F.struct(*[F.col(f"_raw{i}") for i in range(len(fields))])
    classes = rows.withColumn("_group", group).groupBy("_group").agg(F.min("_id").alias("_id"), F.min_by(kept, "_id").alias("_kept"), F.count(F.lit(1)).alias("copias"))
    out = [F.col(f"_group.{n}").alias(s) for n, s in zip(cheap, scope)]
    return classes.select(*out, F.col("_id").alias(key), *[F.col(f"_kept._raw{i}").alias(f) for i, f in enumerate(fields)], "copias")
