"""Rounding that two engines agree on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int) -> Column:
    """floor(x * 10**digits + 0.5) / 10**digits, all in doubles; what is too large to have such digits, or not finite, stays."""
    scale = float(10**digits)
    return F.when(F.abs(x) < F.lit(2.0**52 / scale), F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).otherwise(x.cast("double"))


def none_if_zero(x: Column) -> Column:
    """An average of exactly 0 shows as absent."""
    return F.nullif(x, F.lit(0.0))
