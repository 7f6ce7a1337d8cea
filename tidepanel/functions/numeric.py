"""Numeric column helpers (ANSI-safe)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, NULL where den is 0 or NULL."""
    d = col(den)
    return F.when(d != 0, col(num) / d)


def clip(c: Column | str, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL."""
    x = col(c)
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def finite(c: Column | str) -> Column:
    """The value where it is a finite number, else NULL."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def invert_ratio(c: Column | str, scale: float) -> Column:
    """1 at zero falling to 0 at `scale`."""
    return clip(F.lit(1.0) - col(c) / F.lit(float(scale)))


def variance_ratio(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """Larger over smaller variance; 1 if both vanish, infinity if one does."""
    return (
        F.when((a <= eps) & (b <= eps), F.lit(1.0))
        .when((a <= eps) | (b <= eps), F.lit(float("inf")))
        .otherwise(F.greatest(a, b) / F.least(a, b))
    )
