"""String similarity: a native edit-distance ratio and an LCS ratio computed on Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shipping import by_value_arrow_udf

METRICS = ("indel", "levenshtein")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 when either side is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(
        1 - F.levenshtein(a, b) / longest)


def _indel_on_batches(a: pa.Array, b: pa.Array) -> pa.Array:
    # Self-contained, so that it is shipped to the workers by value.
    import pyarrow

    def lcs(x: str, y: str) -> int:
        """Longest common subsequence length by bit-parallel row updates."""
        mask: dict[str, int] = {}
        for i, ch in enumerate(x):
            mask[ch] = mask.get(ch, 0) | (1 << i)
        full = (1 << len(x)) - 1
        row = full
        for ch in y:
            hit = row & mask.get(ch, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(x) - row.bit_count()

    def score(x: str | None, y: str | None) -> float:
        if not x or not y:
            return 0.0
        return 1.0 if x == y else 2.0 * lcs(x, y) / (len(x) + len(y))

    return pyarrow.array([score(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], type=pyarrow.float64())


def indel_ratio(a: Column, b: Column) -> Column:
    """2 * LCS / total length (insertions and deletions only)."""
    return by_value_arrow_udf(_indel_on_batches, T.DoubleType())(a, b)


def similarity(metric: str, a: Column, b: Column) -> Column:
    if metric == "indel":
        return indel_ratio(a, b)
    if metric == "levenshtein":
        return levenshtein_ratio(a, b)
    raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared distinct tokens over all distinct tokens."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def shorter_bound(metric: str, threshold: float) -> float:
    """Smallest shorter/longer length ratio at which ``threshold`` can still be reached."""
    return threshold / (2 - threshold) if metric == "indel" else threshold


def length_bound(metric: str, a: Column, b: Column, threshold: float) -> Column:
    """Necessary condition on the two lengths for the similarity to reach ``threshold``."""
    la, lb = F.length(a), F.length(b)
    return F.least(la, lb) >= F.greatest(la, lb) * F.lit(shorter_bound(metric, threshold) - 1e-9)
