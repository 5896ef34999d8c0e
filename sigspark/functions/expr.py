"""Numeric column expressions. Complex numbers are pairs of double columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# fixed value: power floor under every logarithm
EPS = 1e-30


def r(c: Column, digits: int = 6) -> Column:
    """Round for output; adding zero turns -0.0 into 0.0."""
    return F.round(c, digits) + F.lit(0.0)


def let(value: Column, fn) -> Column:
    """fn(value) with `value` computed once, however often fn uses it; keeps generated methods small."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def db(c: Column) -> Column:
    return 10.0 * F.log10(F.greatest(c, F.lit(EPS)))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def ratio(num: Column, den: Column) -> Column:
    """num/den, NULL on an empty denominator."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def share(cond: Column, among: Column | None = None) -> Column:
    """Aggregate: share of rows that satisfy `cond` among those that satisfy `among`."""
    if among is None:
        return ratio(F.count_if(cond), F.count(F.lit(1)))
    return ratio(F.count_if(cond & among), F.count_if(among))


def cabs2(re: Column, im: Column) -> Column:
    return re * re + im * im


def cmul(ar: Column, ai: Column, br: Column, bi: Column) -> tuple[Column, Column]:
    return ar * br - ai * bi, ar * bi + ai * br


def cpow2(re: Column, im: Column) -> tuple[Column, Column]:
    return re * re - im * im, 2.0 * re * im


def cpow(re: Column, im: Column, order: int) -> tuple[Column, Column]:
    """Power-of-two power by repeated squaring."""
    while order > 1:
        re, im = cpow2(re, im)
        order //= 2
    return re, im


def rotate(re: Column, im: Column, cycles: Column) -> tuple[Column, Column]:
    """(re + j im) * exp(-2j*pi*cycles)."""
    a = F.lit(2.0 * math.pi) * cycles
    c, s = F.cos(a), F.sin(a)
    return re * c + im * s, im * c - re * s


def finite_or_null(c: Column) -> Column:
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(~bad, c)


def finite_array(c: Column) -> Column:
    return F.transform(c, finite_or_null)


def sample_to_time(n: Column, rate) -> Column:
    return n.cast("double") / rate


def baseband_to_rf(c: Column, tuning: Column) -> Column:
    return c + F.coalesce(tuning, F.lit(0.0))
