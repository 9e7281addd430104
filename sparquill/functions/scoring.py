"""BM25+ and expansion weights as Column arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BM25:
    k: float = 1.2
    b: float = 0.7
    d: float = 0.5


def _d(x: float) -> Column:
    return F.lit(float(x))


def idf(df: Column, n: Column) -> Column:
    return F.log(_d(1) + (n - df + _d(0.5)) / (df + _d(0.5)))


def bm25(tf: Column, df: Column, n: Column, length: Column, average: Column, p: BM25 = BM25()) -> Column:
    """The lower bound d stands inside the product with the inverse document frequency."""
    share = tf * _d(p.k + 1) / (tf + _d(p.k) * (_d(1 - p.b) + _d(p.b) / average * length))
    return idf(df, n) * (_d(p.d) + share)


def prefix_weight(weight: float, length: Column, query_length: int) -> Column:
    return _d(weight) * length / (length + _d(0.3) * (length - _d(query_length)))


def fuzzy_weight(weight: float, length: Column, distance: Column) -> Column:
    return _d(weight) * length / (length + distance)


def max_distance(term_length: int, fuzzy: float | bool, max_fuzzy: int) -> int:
    """Edit distance allowed: a fraction of the length below 1 (capped), else the number itself."""
    if not fuzzy:
        return 0
    f = 0.2 if fuzzy is True else float(fuzzy)
    return min(max_fuzzy, math.floor(term_length * f + 0.5)) if f < 1 else math.floor(f)
