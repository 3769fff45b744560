"""Column expressions and scalar helpers: windows, complex products, quantiles, units."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def hamming(n: Column, size: int) -> Column:
    """The symmetric Hamming window at place n of `size`."""
    return F.lit(0.54) - F.lit(0.46) * F.cos(F.lit(2 * math.pi) * n / F.lit(float(size - 1)))


def turn(f: Column, n: Column, size: int) -> Column:
    """The angle 2 pi f n / size, reduced first so that large products lose no digits."""
    return F.lit(2 * math.pi / size) * F.pmod(f.cast("long") * n.cast("long"), F.lit(size))


def cmul_conj(ar, ai, br, bi) -> tuple[Column, Column]:
    """conj(a) * b as (re, im)."""
    return ar * br + ai * bi, ar * bi - ai * br


def cmul(ar, ai, br, bi) -> tuple[Column, Column]:
    return ar * br - ai * bi, ar * bi + ai * br


def tidy(c: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def gamma_cdf(n: int, x: float) -> float:
    """Regularised lower incomplete gamma function for integer shape n (a finite sum)."""
    if x <= 0:
        return 0.0
    term, total = 0.0, -math.inf
    for k in range(n):
        if k:
            term += math.log(x) - math.log(k)
        total = term if total == -math.inf else max(total, term) + math.log1p(math.exp(-abs(total - term)))
    return 1.0 - math.exp(total - x)


def gamma_cdf_inverse(n: int, p: float) -> float:
    lo, hi = 0.0, float(n + 1)
    while gamma_cdf(n, hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_cdf(n, mid) < p else (lo, mid)
    return (lo + hi) / 2


def confidence_factors(n_blocks: int, level: float) -> tuple[float, float]:
    """(lower, upper) factors of the chi-squared interval of an eigenvalue."""
    return n_blocks / gamma_cdf_inverse(n_blocks, level), n_blocks / gamma_cdf_inverse(n_blocks, 1 - level)


#: Hours in a unit.
HOURS = {"minutes": 1 / 60, "hours": 1.0, "days": 24.0, "months": 24 * 365.25 / 12, "years": 24 * 365.25}


def period_units(hours: Column) -> tuple[Column, Column]:
    """A period in hours as (value, unit), in the largest unit of which it holds at least one."""
    value, unit = hours / HOURS["minutes"], F.lit("minutes")
    for name in ("hours", "days", "months", "years"):
        value = F.when(hours >= HOURS[name], hours / HOURS[name]).otherwise(value)
        unit = F.when(hours >= HOURS[name], F.lit(name)).otherwise(unit)
    return value, unit


def block_share(total: int, parts: int, part: Column) -> tuple[Column, Column]:
    """(count, start) of a part when `total` items are dealt out evenly, the first ones getting one more."""
    q, r = divmod(total, parts)
    return F.lit(q) + F.when(part < r, 1).otherwise(0), part * q + F.least(part, F.lit(r))


def register(spark: SparkSession) -> None:
    """SQL functions hamming(n, size), cmul_re/cmul_im, the aggregate weighted_inner(a, b, w) and the table function dft(array)."""
    import numpy as np
    from pyspark.sql.functions import udtf

    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hamming(n INT, size INT) RETURNS DOUBLE RETURN 0.54D - 0.46D * cos(2D * pi() * n / (size - 1))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cmul_re(ar DOUBLE, ai DOUBLE, br DOUBLE, bi DOUBLE) RETURNS DOUBLE RETURN ar * br - ai * bi")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cmul_im(ar DOUBLE, ai DOUBLE, br DOUBLE, bi DOUBLE) RETURNS DOUBLE RETURN ar * bi + ai * br")

    @udtf(returnType="f int, re double, im double")
    class Dft:
        def eval(self, values):
            for k, c in enumerate(np.fft.fft(np.asarray(values, float))):
                yield k, float(c.real), float(c.imag)

    spark.udtf.register("dft", Dft)

    @F.pandas_udf("double")
    def weighted_inner(a: pd.Series, b: pd.Series, w: pd.Series) -> float:
        return float((a * b * w).sum())

    spark.udf.register("weighted_inner", weighted_inner)


def inner_product(a, b, w) -> Column:
    """The weighted inner product as a built-in aggregate, which adds up before rows are shuffled."""
    return F.sum(F.col(a) * F.col(b) * F.col(w))
