"""Rounding and clamping rules shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column | str, digits: int = 2) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d`` -- one rounding rule everywhere.

    Matches ``Math.round(x*100)/100`` (half-up toward +inf), unlike Spark's
    ``round`` which rounds half away from zero on the decimal value.
    """
    col = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return (F.floor(col * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).cast("double")


def clamp(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return out
