"""Numeric column expressions shared by the operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ringwatch import constants as K

BINS_PER_OCTAVE = 1024
BIN_SHIFT = 1100 * BINS_PER_OCTAVE


def to_number(col: Column | str) -> Column:
    """Text or number as double; anything unreadable counts as zero."""
    return F.coalesce(try_number(col), F.lit(0.0))


def try_number(col: Column | str) -> Column:
    value = (F.col(col) if isinstance(col, str) else col).try_cast("double")
    return F.when(~F.isnan(value), value)


def value_bin(value: Column) -> Column:
    """Whole number that never falls when the value rises: sign, exponent, 10 mantissa bits."""
    size = F.floor(F.least(F.log2(F.abs(value)), F.lit(1025.0)) * BINS_PER_OCTAVE) + BIN_SHIFT
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("bigint"))


def grid_index(value: Column, grid: list[float]) -> Column:
    """How many thresholds of the sorted grid the value reaches, as a balanced CASE tree."""

    def branch(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value >= F.lit(float(grid[mid])), branch(mid + 1, hi)).otherwise(branch(lo, mid))

    return branch(0, len(grid))


def risk_score(probability: Column | str) -> Column:
    p = F.col(probability) if isinstance(probability, str) else probability
    return F.bround(F.lit(100.0) * p, 0).cast("int")


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return a / (F.abs(b) + F.lit(K.RATIO_EPSILON))


def ladder(value: Column, steps: list[tuple[float, str]], default: str) -> Column:
    """First step whose bound the value reaches, else the default (also for null)."""
    out = F.lit(default)
    for bound, name in reversed(steps):
        out = F.when(value >= bound, F.lit(name)).otherwise(out)
    return out
