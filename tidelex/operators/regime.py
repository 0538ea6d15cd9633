"""Calm and stressed sessions, per instrument, from lagged trailing volatility."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tidelex.errors import MissingColumn
from tidelex.operators.ordered import exact_quantile, with_lookback, with_position
from tidelex.session import checkpointed

# Window length, stress quantile, sessions in a year, labels.
LOOKBACK = 21
STRESS_QUANTILE = 2 / 3
SESSIONS_PER_YEAR = 252
CALM, STRESSED, UNKNOWN = "calm", "stressed", "unknown"


def month_of(day: str):
    return F.year(day) * 12 + F.month(day)


def _clean(column):
    """NaN is how a missing number arrives from pandas; inside the engine it is NULL."""
    number = column.cast("double")
    return F.when(~F.isnan(number), number)


def trailing_volatility(panel: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Add `trailing_vol`: annualised mean of sqrt(rv_gk) over the sessions before each row.

    NULL unless all `lookback` preceding sessions are present, so no session enters its own label.
    """
    if "rv_gk" not in panel.columns:
        raise MissingColumn(
            "the panel has no rv_gk column; close-to-close volatility is no substitute for it")
    placed = with_position(panel, ["ticker"], ["session_date"], month_of("session_date"))
    daily = F.sqrt(_clean(F.col("rv_gk")))
    before = (Window.partitionBy("ticker", "chunk_id").orderBy("position")
              .rowsBetween(-lookback, -1))
    vol = F.when(F.count(daily).over(before) == lookback,
                 F.avg(daily).over(before) * math.sqrt(SESSIONS_PER_YEAR))
    return (with_lookback(placed, "position", lookback).withColumn("trailing_vol", vol)
            .where(~F.col("is_copy")).drop("is_copy", "chunk_id", "position"))


def classify_panel(panel: DataFrame, quantile: float = STRESS_QUANTILE,
                   lookback: int = LOOKBACK) -> DataFrame:
    """Add `trailing_vol`, `regime` and `stressed` (1.0, 0.0 or NULL), each ticker on its own."""
    # Read again for the quantile: cut it, so the windows behind it run once.
    measured = checkpointed(trailing_volatility(panel, lookback))
    cuts = exact_quantile(measured, ["ticker"], "trailing_vol", quantile, "stress_cut")
    vol, cut = F.col("trailing_vol"), F.col("stress_cut")
    regime = (F.when(vol.isNull(), F.lit(UNKNOWN)).when(vol >= cut, F.lit(STRESSED))
              .otherwise(F.lit(CALM)))
    return (measured.join(cuts, "ticker", "left").withColumn("regime", regime)
            .withColumn("stressed", F.when(F.col("regime") == STRESSED, F.lit(1.0))
                        .when(F.col("regime") == CALM, F.lit(0.0)))
            .drop("stress_cut"))


def regime_crosstab(frame: DataFrame) -> DataFrame:
    """Sessions per ticker and regime, absent cells as 0."""
    return (frame.groupBy("ticker").pivot("stressed", [0.0, 1.0]).count()
            .select("ticker", F.coalesce(F.col("`0.0`"), F.lit(0)).alias("calm"),
                    F.coalesce(F.col("`1.0`"), F.lit(0)).alias("stressed")))
