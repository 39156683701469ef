"""Agreement statistics as column expressions over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv


def ratio(num: Column, den: Column) -> Column:
    """Guarded division: NULL when the denominator is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def kappa(p_o: Column, p_e: Column, degenerate: str = "null", tol: float = 1e-12) -> Column:
    """Cohen's kappa. At p_e = 1: NULL, or 1/0 by whether agreement is full (``one_zero``)."""
    flat = F.abs(p_e - 1) < tol
    if degenerate == "one_zero":
        special = F.when(p_o == 1, F.lit(1.0)).otherwise(F.lit(0.0))
    elif degenerate == "null":
        special = F.lit(None).cast("double")
    else:
        raise ValueError(f"degenerate must be 'null' or 'one_zero', not {degenerate!r}")
    return F.when(flat, special).otherwise((p_o - p_e) / (1 - p_e))


def wilson(x: Column, n: Column, z: float = fv.Z_95) -> tuple[Column, Column]:
    """Wilson score interval of x/n; both ends NULL when n = 0."""
    x, n = x.cast("double"), n.cast("double")
    p = x / n
    den = 1 + F.lit(z * z) / n
    mid = (p + F.lit(z * z) / (2 * n)) / den
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / den
    ok = n > 0
    return (F.when(ok, F.greatest(F.lit(0.0), mid - half)), F.when(ok, F.least(F.lit(1.0), mid + half)))


def round_half_even(c: Column) -> Column:
    """Nearest integer, ties to even, as bigint (sample sizes)."""
    return F.bround(c, 0).cast("bigint")
