"""Edit-similarity scores in percent: ratio, partial ratio, token set ratio.

Similarity counts insertions and deletions only: 200 * (longest common subsequence) / (both lengths).
The subsequence is found with one integer per text position set (bit-parallel), so a pair costs a few
machine words a character.  Exposed as Arrow-batched UDFs, as Spark has no such expression.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    return 200.0 * common_length(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer one (windows may overhang the ends)."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    if n == len(b):
        return ratio(a, b)
    return max(ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def token_set_ratio(a: str, b: str) -> float:
    """Ratio on word sets: words in common against them with either side's own words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    left, right = (" ".join(sorted(s)) for s in (x - y, y - x))
    with_left, with_right = (f"{both} {s}" if both else s for s in (left, right))
    best = ratio(with_left, with_right)
    if both:
        best = max(best, ratio(both, with_left), ratio(both, with_right))
    return best


def _udf(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    run.__name__ = f.__name__
    return F.pandas_udf(run, DoubleType())


ratio_udf, partial_ratio_udf, token_set_ratio_udf = (_udf(f) for f in (ratio, partial_ratio, token_set_ratio))
