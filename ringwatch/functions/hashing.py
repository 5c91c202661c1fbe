"""Reproducible pseudo-random draws from row identity, independent of partitioning."""

import math
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def digest(seed: int | str, *cols: Column | str) -> Column:
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def uniform(seed: int | str, *cols: Column | str) -> Column:
    """A value in [0, 1) from the first 32 bits of the digest."""
    return F.conv(F.substring(digest(seed, *cols), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(seed: int | str, *cols: Column | str) -> Column:
    """A standard normal draw (Box and Muller) from two uniforms of one row."""
    u = F.greatest(uniform(f"{seed}a", *cols), F.lit(1e-12))
    v = uniform(f"{seed}b", *cols)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)


#: the cumulative distribution of a Poisson variable of mean one
_ONE = [
    0.36787944117144233, 0.73575888234288467, 0.91969860292860584, 0.98101184312384626,
    0.99634015317265635, 0.99940581518241833, 0.99991675885071193, 0.99998975080332537,
    0.99999887479740201, 0.99999988857452143,
]


def poisson_one(seed: int | str, *cols: Column | str) -> Column:
    """Poisson draw with mean one: how many steps of the cumulative distribution the uniform of the row passes.

    The 32 bits of the uniform are compared as hex text, whose order is theirs, and no number is
    made of them.
    """
    bits = F.substring(digest(seed, *cols), 1, 8)
    return reduce(add, [(bits >= format(math.ceil(cut * 2**32), "08x")).cast("int") for cut in _ONE])


def log_factorial(m: Column) -> Column:
    """ln m! of a whole number: exact up to 20, then Stirling's series, good to 12 digits."""
    x = m.cast("double")
    series = 1.0 / (12.0 * x) - 1.0 / (360.0 * x * x * x) + 1.0 / (1260.0 * x * x * x * x * x)
    large = x * F.log(x) - x + 0.5 * F.log(F.lit(6.283185307179586) * x) + series
    return F.when(m <= 20, F.log(F.factorial(F.least(m, F.lit(20)).cast("int")).cast("double"))).otherwise(large)


def poisson_mode(mean: Column) -> Column:
    """The probability of the mean itself, of a whole mean; 0 for a mean of 0."""
    lam, m = mean.cast("double"), mean.cast("long")
    return F.when(m > 0, F.exp(m * F.log(lam) - lam - log_factorial(m))).otherwise(F.lit(0.0))


def _walk(u: np.ndarray, m: np.ndarray, p: np.ndarray) -> np.ndarray:
    lam, drawn = m.astype(np.float64), m.copy()
    last = np.ceil(10 * np.sqrt(lam)).astype(np.int64) + 12
    at = np.flatnonzero((m > 0) & ~(u < p))
    rest, up, down, m, lam, last = u[at] - p[at], p[at], p[at], m[at], lam[at], last[at]
    j = 0
    while len(at):
        j += 1
        up, down = up * lam / (m + j), np.where(j <= m, down * (m - j + 1) / lam, 0.0)
        above = rest < up
        below = ~above & (rest - up < down)
        drawn[at[above]], drawn[at[below]] = m[above] + j, m[below] - j
        rest = rest - up - down
        go = ~above & ~below & (j < last)
        if not go.all():
            at, rest, up, down, m, lam, last = (v[go] for v in (at, rest, up, down, m, lam, last))
    return drawn


@F.pandas_udf(T.LongType())
def _poisson(u: pd.Series, mean: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(_walk(u.to_numpy(np.float64), mean.fillna(0).to_numpy(np.int64), p.to_numpy(np.float64)))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _poisson_lists(u: pd.Series, mean: pd.Series, p: pd.Series) -> pd.Series:
    if not u.map(len).sum():
        return u.map(lambda row: np.zeros(0, dtype=np.int64))
    drawn = _walk(*[np.concatenate(v.to_numpy()).astype(kind) for v, kind in ((u, np.float64), (mean, np.int64), (p, np.float64))])
    return pd.Series(np.split(drawn, np.cumsum(u.map(len).to_numpy())[:-1]))


def poisson(u: Column, mean: Column) -> Column:
    """Poisson draw with a whole mean, exact for small and large ones.

    The unit interval is cut into the probabilities of the mean, one above, one below, two above and
    so on; each follows from the one before, and ten standard deviations are walked at most. All
    draws of a batch walk together, and a draw that has arrived takes no more steps.
    """
    return _poisson(u, mean.cast("long"), poisson_mode(mean))


def poisson_lists(u: Column, mean: Column, mode: Column) -> Column:
    """`poisson` for lists of uniforms, whole means and their `poisson_mode`."""
    return _poisson_lists(u, mean, mode)
