"""Elementwise operators: columns in, a column out; null is missing and propagates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def both(x: Column, y: Column, out: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), out)


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(x: Column, y: Column, least: float) -> Column:
    """x / y where abs(y) is above `least`, else null."""
    return F.when(F.abs(y) > least, x / y)


def protected_div(x: Column, y: Column) -> Column:
    return both(x, y, F.when(F.abs(y) > 1e-3, x / y).otherwise(1.0))


def protected_inv(x: Column) -> Column:
    return F.when(x.isNotNull(), F.when(F.abs(x) > 1e-3, 1 / x).otherwise(0.0))


def signed_power(x: Column, p: float) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(p))


UNARY = {
    "cs_sin": F.sin, "cs_cos": F.cos, "cs_tan": F.tan, "cs_abs": F.abs, "cs_neg": lambda x: -x, "cs_sqrt": lambda x: F.sqrt(F.abs(x)), "cs_inv": protected_inv,
    "cs_log": lambda x: F.log1p(F.abs(x)), "cs_power_third": lambda x: signed_power(x, 1 / 3), "cs_power_2": lambda x: x * x, "cs_power_3": lambda x: x * x * x,
    "cs_sigmoid": lambda x: 1 / (1 + F.exp(-x)), "cs_sign": F.signum, "cs_signed_square": lambda x: finite(F.signum(x) * x * x),
}
BINARY = {
    "cs_add": lambda x, y: x + y, "cs_sub": lambda x, y: x - y, "cs_mul": lambda x, y: x * y, "cs_div": protected_div,
    "cs_max": lambda x, y: both(x, y, F.greatest(x, y)), "cs_min": lambda x, y: both(x, y, F.least(x, y)), "cs_imbalance_coef": lambda x, y: ratio(x - y, x + y, 1e-10),
}
TERNARY = {
    "cs_condition_and": lambda x, y, z: F.when((y > 0) & (z > 0), x), "cs_condition_or": lambda x, y, z: F.when((y > 0) | (z > 0), x),
    "cs_mask_ifelse": lambda x, y, z: F.when(x > 0, y).when(x <= 0, z),
}
