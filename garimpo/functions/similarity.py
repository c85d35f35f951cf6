"""Order-sensitive similarity of two strings (Ratcliff-Obershelp), where equality is not enough."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ratio(a: str, b: str) -> float:
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    return _ratio(a, b)


def may_reach(a: Column, b: Column, tolerance: float) -> Column:
    """A necessary condition in the JVM: the lengths alone bound the similarity."""
    la, lb = F.length(a), F.length(b)
    return (a == b) | (2.0 * F.least(la, lb) >= tolerance * (la + lb))


def possible(a: str, b: str, tolerance: float) -> bool:
    return 2 * min(len(a), len(b)) >= tolerance * (len(a) + len(b))
