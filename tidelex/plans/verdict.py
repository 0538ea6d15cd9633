"""The statistical reports: nested contrasts in sample and the out-of-sample comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidelex.operators import forecast, regime, regress
from tidelex.session import checkpointed


def contrast_report(signals: DataFrame, panel: DataFrame) -> dict[str, DataFrame]:
    # Every contrast reads the frame again: one row per read unit, cut from the joins behind it.
    frame = checkpointed(regress.build_frame(signals, panel))
    crossed = [f"{c}_x_stressed" for c in regress.TEXT]
    shown = [*regress.TEXT, *crossed]
    columns = [*regress.HAR, "stressed", *shown]
    sums = regress.moments(regress.with_interactions(frame), columns)
    coefficients = regress.coefficient_table(sums, columns, shown)
    return {
        "cells": regime.regime_crosstab(frame),
        "contrasts": regress.as_rows(frame, regress.contrasts(sums), regress.CONTRAST_SCHEMA),
        "coefficients": regress.as_rows(frame, coefficients, regress.COEFFICIENT_SCHEMA),
        "within_regimes": regress.as_rows(frame, regress.within_regimes(frame),
                                          regress.CONTRAST_SCHEMA),
    }


def forecast_report(signals: DataFrame, panel: DataFrame,
                    min_train: int = forecast.MIN_TRAIN) -> dict[str, DataFrame]:
    frame = checkpointed(regress.build_frame(signals, panel))
    ahead = checkpointed(forecast.out_of_sample(frame, min_train).withColumn(
        "gain", forecast.gain()))
    saved = checkpointed(regress.in_sample_contributions(frame, forecast.BLOCK))
    return {
        "clark_west": forecast.clark_west(ahead),
        "concentration": forecast.concentration(ahead, "gain", forecast.ROW),
        "without_best": forecast.retest_without_best(ahead),
        "in_sample_concentration": forecast.concentration(saved, "gain", ["position"]),
        "in_sample_without_best": regress.as_rows(
            frame, [in_sample_retest(frame, saved)], regress.CONTRAST_SCHEMA)
        .withColumn("still_significant", F.col("p_hac") < 0.05),
    }


def in_sample_retest(frame: DataFrame, saved: DataFrame, k: int = 10) -> dict:
    """The amplitude contrast without the k rows that save most."""
    rest = forecast.without_best(
        frame.join(saved.select("position", "gain"), "position"), "gain", k, ["position"])
    return regress.nested_test(regress.renumbered(rest), regress.HAR,
                               regress.HAR + forecast.BLOCK, f"without {k}")
