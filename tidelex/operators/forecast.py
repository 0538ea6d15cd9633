"""Out-of-sample forecasts from an expanding window, their comparison and how few rows carry it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidelex.functions.tails import normal_tail_column
from tidelex.operators.ordered import running_sums, with_position
from tidelex.operators.regime import month_of
from tidelex.operators.regress import HAR
from tidelex.session import checkpointed

# Rows before the first forecast and the block added to the price columns.
MIN_TRAIN = 80
BLOCK = ["amplitude"]
#: Names one forecast: sessions of a ticker repeat where the tags of several runs overlap.
ROW = ["date", "ticker", "position"]


def out_of_sample(frame: DataFrame, min_train: int = MIN_TRAIN,
                  block: list[str] = BLOCK) -> DataFrame:
    """One row per forecast, with both models' squared errors and predictions.

    The normal equations of "all earlier rows of this ticker" are running sums of products, so no
    row looks back at its history: Spark accumulates the products and each row solves two small
    systems. Rows of one session are taken in order of `position`.
    """
    terms = ["_one", *HAR, *block, "y"]
    columns = ["position", "ticker", "session_date", "stressed", "y", *HAR, *block]
    pairs = list(combinations_with_replacement(range(len(terms)), 2))
    placed = checkpointed(with_position(
        frame.select(*columns), ["ticker"], ["session_date", "position"],
        month_of("session_date"), "at").withColumn("_one", F.lit(1.0)))
    summed = running_sums(placed, ["ticker"], "at", {
        f"s{i}_{j}": F.col(terms[i]) * F.col(terms[j]) for i, j in pairs})
    k, k_har = len(terms) - 1, 1 + len(HAR)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gram = np.zeros((len(batch), k + 1, k + 1))
            for i, j in pairs:
                gram[:, i, j] = gram[:, j, i] = batch[f"s{i}_{j}"].to_numpy()
            row = batch[terms[:k]].to_numpy(dtype=float)
            out = {}
            for label, size in (("har", k_har), ("text", k)):
                inverse = np.linalg.pinv(gram[:, :size, :size], rcond=1e-14, hermitian=True)
                beta = np.einsum("nij,nj->ni", inverse, gram[:, :size, k])
                out[f"p_{label}"] = (row[:, :size] * beta).sum(axis=1)
            actual = batch["y"].to_numpy()
            yield pd.DataFrame({
                "date": batch["session_date"], "ticker": batch["ticker"],
                "position": batch["position"], "stressed": batch["stressed"],
                "e2_har": (actual - out["p_har"]) ** 2, "e2_text": (actual - out["p_text"]) ** 2,
                **out})

    return summed.where(F.col("at") >= min_train).mapInPandas(
        solve, "date date, ticker string, position long, stressed double, e2_har double, "
               "e2_text double, p_har double, p_text double")


def gain() -> Column:
    return F.col("e2_har") - F.col("e2_text")


def clark_west(forecasts: DataFrame, by_regime: bool = True) -> DataFrame:
    """Adjusted-MSPE statistic and one-sided p for all rows and, if asked, per regime."""
    f = gain() + (F.col("p_har") - F.col("p_text")) ** 2
    measures = [F.count(F.lit(1)).alias("n"),
                (F.avg(f) / (F.stddev_samp(f) / F.sqrt(F.count(F.lit(1))))).alias("statistic")]
    if by_regime:
        table = forecasts.rollup("stressed").agg(
            F.grouping_id().alias("_all"), *measures)
        name = (F.when(F.col("_all") == 1, F.lit("all"))
                .when(F.col("stressed") == 1.0, F.lit("stressed")).otherwise(F.lit("calm")))
    else:
        table, name = forecasts.agg(*measures), F.lit("all")
    return table.select(name.alias("sample"), "n", "statistic").withColumn(
        "p_one_sided", normal_tail_column(F.col("statistic")))


def effective_n(value: Column) -> Column:
    """Kish: squared sum over sum of squares, 0 when the sum is 0."""
    return F.when(F.sum(value) == 0, F.lit(0.0)).otherwise(
        F.sum(value) ** 2 / F.sum(value * value))


def best(rows: DataFrame, value: str, k: int, order: list[str]) -> DataFrame:
    """The k largest rows; equal values by `order`. Planned as a distributed top-k."""
    return rows.orderBy(F.desc(value), *order).limit(k)


def without_best(rows: DataFrame, value: str, k: int, order: list[str]) -> DataFrame:
    # k rows, a constant of the report: the broadcast does not grow with the data.
    return rows.join(F.broadcast(best(rows, value, k, order).select(*order)), order, "left_anti")


def concentration(rows: DataFrame, value: str, order: list[str], top: int = 5) -> DataFrame:
    """Kish n, rows, share of the top rows in the total gain, and rows with a negative gain."""
    # `top` rows, a constant of the report.
    head = F.broadcast(best(rows, value, top, order).select(*order, F.lit(True).alias("_head")))
    share = F.sum(F.when(F.col("_head"), F.col(value))) / F.sum(value)
    return rows.join(head, order, "left").agg(
        effective_n(F.col(value)).alias("effective_n"), F.count(F.lit(1)).alias("n"),
        share.alias(f"top{top}_share"), F.count_if(F.col(value) < 0).alias("worse"))


def retest_without_best(forecasts: DataFrame, drops: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Clark-West after removing the rows with the largest gain, for each number of them."""
    rows = forecasts.withColumn("gain", gain())
    out = None
    for k in drops:
        test = clark_west(without_best(rows, "gain", k, ROW), by_regime=False).select(
            F.lit(k).alias("dropped"), "n", "statistic", "p_one_sided",
            (F.col("p_one_sided") < 0.05).alias("still_significant"))
        out = test if out is None else out.unionByName(test)
    return out
