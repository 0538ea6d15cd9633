"""Tail probabilities. Spark SQL has no error function, and reports hold only a few of them."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F


def normal_tail(z: float) -> float:
    """P(Z > z) for a standard normal."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_tail(x: float, df: int) -> float:
    """P(X > x) for a chi-square with integer degrees of freedom.

    The survival function steps up two degrees at a time from exp(-x/2) (even) or
    erfc(sqrt(x/2)) (odd), each step adding one closed-form term.
    """
    if x <= 0:
        return 1.0
    half = x / 2.0
    if df % 2:
        tail, order = math.erfc(math.sqrt(half)), 0.5
    else:
        tail, order = math.exp(-half), 1.0
    while order < df / 2.0:
        tail += math.exp(order * math.log(half) - half - math.lgamma(order + 1.0))
        order += 1.0
    return min(1.0, tail)


def normal_tail_column(z: Column) -> Column:
    @F.pandas_udf("double")
    def tail(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or math.isnan(v)
                          else 0.5 * math.erfc(v / math.sqrt(2.0)))

    return tail(z)
