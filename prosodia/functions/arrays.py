"""Numeric helpers on columns and arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosodia.functions.deferred import arrow_function


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0))


def min_max(x: Column, over, least: float = 1e-9) -> Column:
    """(x - min) / (max - min) in a window, 0 where the range is at most ``least``."""
    lo, hi = F.min(x).over(over), F.max(x).over(over)
    return F.when(hi - lo <= least, 0.0).otherwise((x - lo) / (hi - lo))


def min_max_array(a: Column, least: float = 1e-9) -> Column:
    lo, hi = F.array_min(a), F.array_max(a)
    return F.transform(a, lambda v: F.when(hi - lo <= least, 0.0).otherwise((v - lo) / (hi - lo)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


def robust_z(df: DataFrame, key: str, value: str, mask: Column | None = None, style: str = "fallback", limit: float = 5.0) -> DataFrame:
    """Add ``z``: (value - median) / scale per key, clipped, with statistics of the rows in ``mask``.

    Scale: IQR / 1.349. ``fallback``: the deviation (at least 1e-6) if that is below 1e-6. ``greatest``: the largest of IQR / 1.349,
    the deviation and 1e-6. Deviations are of the population; percentiles interpolate linearly.
    """
    x = F.when(mask, F.col(value)) if mask is not None else F.col(value)
    s = df.groupBy(key).agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__q"), F.stddev_pop(x).alias("__sd"))
    spread, sd = (F.col("__q")[2] - F.col("__q")[0]) / 1.349, F.coalesce("__sd", F.lit(0.0))
    scale = F.when(spread < 1e-6, F.greatest(sd, F.lit(1e-6))).otherwise(spread) if style == "fallback" else F.greatest(spread, sd, F.lit(1e-6))
    z = (F.col(value) - F.col("__q")[1]) / scale
    return df.join(s, key).withColumn("z", F.greatest(F.lit(-limit), F.least(F.lit(limit), z))).drop("__q", "__sd")


def fit_length(a: Column, n: Column | int, fill: float | None = 0.0) -> Column:
    """An array cut or padded to n; ``fill`` None repeats the last value."""
    n = n if isinstance(n, Column) else F.lit(n)
    pad = F.element_at(a, -1) if fill is None else F.lit(fill)
    return F.concat(F.slice(a, F.lit(1), n), F.array_repeat(pad, F.greatest(F.lit(0), n - F.size(a))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-8)


def centralization(f1: Column, f2: Column, to: tuple[float, float] = (500.0, 1500.0)) -> Column:
    """Distance of two formants from a neutral vowel, one decimal; -1 if either is missing."""
    return F.when(f1.isNull() | f2.isNull(), -1.0).otherwise(F.round(F.hypot(f1 - to[0], f2 - to[1]), 1))


def plausible_formants(f: Column) -> Column:
    """The first two formants can be those of a vowel."""
    return (F.get(f, F.lit(0)) >= 100) & (F.get(f, F.lit(1)) >= 500)


def resample(values: np.ndarray, n: int) -> np.ndarray:
    values = np.asarray(values, dtype=float)
    if not len(values) or n <= 0:
        return np.zeros(max(n, 0))
    return np.interp(np.linspace(0, len(values) - 1, n), np.arange(len(values)), values)


@arrow_function("array<double>")
def resampled(values: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([resample(v, int(k)).tolist() for v, k in zip(values, n, strict=True)])


# What stands for zero in a divisor, most rounds, and the relative change that ends them.
TINY, ROUNDS, CLOSE = 1e-30, 199, 3e-7


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function of whole columns, by the modified Lentz method.

    A row stops when its own value settles, so rows don't depend on each other.
    """
    floor = lambda v: np.where(np.abs(v) > TINY, v, TINY)
    c, d = np.ones_like(x), 1.0 / floor(1.0 - (a + b) * x / (a + 1.0))
    h, going = d.copy(), np.ones(x.shape, dtype=bool)
    for m in range(1, ROUNDS + 1):
        if not going.any():
            break
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 / floor(1.0 + term * d)
            c = floor(1.0 + term / c)
            h = np.where(going, h * d * c, h)
        going &= np.abs(d * c - 1.0) >= CLOSE
    return h


def incomplete_beta(a, b, x):
    """The regularised incomplete beta function, of numbers or columns."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=np.float64) for v in (a, b, x)))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    gamma = lambda v: np.array([math.lgamma(z) for z in v.ravel()]).reshape(v.shape)
    front = np.exp(gamma(a + b) - gamma(a) - gamma(b) + a * np.log(inside) + b * np.log1p(-inside))
    low = inside < (a + 1) / (a + b + 2)
    first, second = np.where(low, a, b), np.where(low, b, a)
    part = front * beta_fraction(first, second, np.where(low, inside, 1 - inside)) / first
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(low, part, 1 - part)))
    return out if out.ndim else float(out)


def two_sided_p(t, df):
    """Two-sided p of Student's t, of numbers or columns."""
    df = np.asarray(df, dtype=np.float64)
    return incomplete_beta(df / 2, 0.5, df / (df + np.square(t)))


@arrow_function("double")
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    t, df = (v.to_numpy(dtype=np.float64, na_value=np.nan) for v in (t, df))
    known = np.isfinite(t) & ~np.isnan(df)
    out = np.where(np.isinf(t) & ~np.isnan(df), 0.0, np.nan)
    if known.any():
        out[known] = two_sided_p(t[known], df[known])
    return pd.Series(out)  # Arrow takes NaN of pandas as null


def sorted_unique(*arrays: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


def positions(df: DataFrame, key: str, order: str) -> Column:
    return F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
