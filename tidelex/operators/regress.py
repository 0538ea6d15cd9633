"""Nested regressions: OLS with instrument effects, Newey-West covariance, Wald tests.

Instrument effects are taken out by centring every column on its ticker's mean (Frisch-Waugh):
slopes, residuals and the slope block of the covariance are those of the regression with a constant
and one dummy per instrument, and the matrices stay as small as the list of columns however many
instruments there are. Spark reduces the rows; the driver only sees k x k sums.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from tidelex.functions import tails
from tidelex.operators.ordered import CHUNK, with_global_position, with_lookback
from tidelex.operators.regime import classify_panel, month_of
from tidelex.session import checkpointed

# The price-only block, the text block and the Newey-West lags.
HAR = ["ln_rv_d", "ln_rv_w", "ln_rv_m"]
TEXT = ["tone", "ambiguity", "amplitude"]
LAGS = 5
MIN_REGIME_ROWS = 40


def build_frame(signals: DataFrame, panel: DataFrame) -> DataFrame:
    """Signals joined to the regime-labelled panel, complete rows only.

    The regime is computed on the whole panel before the join. A panel column that a signal column
    shadows gets the suffix `_panel`. `position` is the row's place in (tag, ticker, session)
    order, on which the lagged covariance depends.
    """
    key = ["ticker", "session_date"]
    signals = signals.withColumn("session_date", F.to_date("session"))
    if "tag_order" not in signals.columns:
        signals = signals.withColumn("tag_order", F.lit(0))
    labelled = classify_panel(panel.withColumn("session_date", F.to_date("session_date")))
    for name in set(labelled.columns) & set(signals.columns) - set(key):
        labelled = labelled.withColumnRenamed(name, f"{name}_panel")
    # One row per read session, used several times below: cut it from the joins behind it.
    merged = checkpointed(signals.join(labelled, key).dropna(
        subset=["y", *HAR, "trailing_vol", "stressed", *TEXT]))
    lane = F.concat(F.lpad(F.col("tag_order").cast("string"), 6, "0"), F.lit("|"), "ticker")
    return with_global_position(merged.withColumn("_lane", lane), "_lane", ["session_date"],
                                month_of("session_date")).drop("_lane")


def with_interactions(frame: DataFrame, columns: list[str] = TEXT) -> DataFrame:
    return frame.withColumns({f"{c}_x_stressed": F.col(c) * F.col("stressed") for c in columns})


@dataclass
class Moments:
    """Centred rows of a frame and their sums of products, from which any subset is fitted."""

    columns: list[str]
    gram: np.ndarray                            # of y and the columns
    tss: float
    n: int
    centred: DataFrame


@dataclass
class Fit:
    columns: list[str]
    slopes: np.ndarray
    rsquared: float
    n: int
    inverse: np.ndarray
    centred: DataFrame

    def residual(self) -> Column:
        fitted = reduce(add, [F.col(f"c_{c}") * F.lit(float(b))
                              for c, b in zip(self.columns, self.slopes)])
        return F.col("c_y") - fitted


def centred_on_ticker(frame: DataFrame, columns: list[str]) -> DataFrame:
    names = ["y", *columns]
    means = frame.groupBy("ticker").agg(*[F.avg(c).alias(f"_{c}") for c in names])
    return frame.join(means, "ticker").select(
        "position", "ticker", "session_date", "stressed", "y",
        *[(F.col(c) - F.col(f"_{c}")).alias(f"c_{c}") for c in names])


def moments(frame: DataFrame | Moments, columns: list[str]) -> Moments:
    """One pass over the rows for all models whose columns are among `columns`."""
    if isinstance(frame, Moments):
        return frame
    # The residuals of every model are taken from these rows again.
    centred = checkpointed(centred_on_ticker(frame, columns))
    names = ["c_y", *[f"c_{c}" for c in columns]]
    upper = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = centred.agg(F.count(F.lit(1)).alias("n"), (F.var_pop("y") * F.count("y")).alias("tss"),
                       *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}")
                         for i, j in upper]).first()
    gram = np.zeros((len(names), len(names)))
    for i, j in upper:
        gram[i, j] = gram[j, i] = sums[f"s{i}_{j}"] or 0.0
    return Moments(columns, gram, sums["tss"], sums["n"], centred)


def fit(frame: DataFrame | Moments, columns: list[str]) -> Fit:
    sums = moments(frame, columns)
    places = [sums.columns.index(c) + 1 for c in columns]
    inverse = np.linalg.pinv(sums.gram[np.ix_(places, places)], rcond=1e-13, hermitian=True)
    against_y = sums.gram[places, 0]
    slopes = inverse @ against_y
    rss = sums.gram[0, 0] - slopes @ against_y
    return Fit(columns, slopes, float(1.0 - rss / sums.tss), sums.n, inverse, sums.centred)


def newey_west(model: Fit, lags: int = LAGS) -> np.ndarray:
    """Covariance of the slopes with Bartlett weights over `lags` rows in frame order."""
    return newey_west_together([model], lags)[0]


def newey_west_together(models: list[Fit], lags: int = LAGS) -> list[np.ndarray]:
    """The covariances of models that were fitted from the same moments, in one pass.

    With g the score rows and w the weights, S = G0 + sum w_l (G_l + G_l'), so S = M + M' where M
    pairs each row with g_t / 2 + sum w_l g_(t-l). The residuals of all models stand side by side;
    the rows a lookback needs are copied once, and the k x k sums of all models are one aggregate.
    """
    used = sorted({c for model in models for c in model.columns})
    # Only columns and residuals are copied; scores are their products, made after that.
    carried = with_lookback(
        models[0].centred.select("position", *[f"c_{c}" for c in used], *[
            model.residual().alias(f"e{m}") for m, model in enumerate(models)]), "position", lags)
    names = [(m, i, c) for m, model in enumerate(models) for i, c in enumerate(model.columns)]
    scored = carried.select("chunk_id", "position", "is_copy", *[
        (F.col(f"c_{c}") * F.col(f"e{m}")).alias(f"g{m}_{i}") for m, i, c in names])
    order = Window.partitionBy("chunk_id").orderBy("position")
    reached = scored.select("is_copy", *[f"g{m}_{i}" for m, i, _ in names], *[
        reduce(add, [F.col(f"g{m}_{i}") / 2, *[
            F.coalesce(F.lag(f"g{m}_{i}", lag).over(order), F.lit(0.0)) * (1 - lag / (lags + 1))
            for lag in range(1, lags + 1)]]).alias(f"h{m}_{i}")
        for m, i, _ in names]).where(~F.col("is_copy"))
    sums = reached.agg(*[
        F.sum(F.col(f"g{m}_{i}") * F.col(f"h{m}_{j}")).alias(f"m{m}_{i}_{j}")
        for m, model in enumerate(models) for i in range(len(model.columns))
        for j in range(len(model.columns))]).first()
    out = []
    for m, model in enumerate(models):
        k = len(model.columns)
        half = np.array([[sums[f"m{m}_{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])
        out.append(model.inverse @ (half + half.T) @ model.inverse)
    return out


def nested_test(frame: DataFrame | Moments, base: list[str], full: list[str], label: str,
                lags: int = LAGS) -> dict:
    """Wald chi-square that the columns of `full` absent from `base` are jointly zero."""
    return nested_tests(frame, [(base, full, label)], lags)[0]


def nested_tests(frame: DataFrame | Moments, cases: list[tuple[list[str], list[str], str]],
                 lags: int = LAGS) -> list[dict]:
    """Several such tests over the same rows: one pass for the moments, one for all covariances."""
    sums = moments(frame, list(dict.fromkeys(c for _, full, _ in cases for c in full)))
    fits = [(fit(sums, base), fit(sums, full)) for base, full, _ in cases]
    covariances = newey_west_together([big for _, big in fits], lags)
    rows = []
    for (base, full, label), (small, big), covariance in zip(cases, fits, covariances):
        added = [i for i, c in enumerate(full) if c not in base]
        block = big.slopes[added]
        chi2 = float(block @ np.linalg.pinv(covariance[np.ix_(added, added)]) @ block)
        rows.append({
            "contrast": label, "columns_added": len(added),
            "r2_base": round(small.rsquared, 4), "r2_full": round(big.rsquared, 4),
            "r2_gain": round(big.rsquared - small.rsquared, 4),
            "wald_chi2": round(chi2, 3), "p_hac": round(tails.chi2_tail(chi2, len(added)), 4),
            "n": int(big.n),
        })
    return rows


def coefficient_table(frame: DataFrame | Moments, columns: list[str], shown: list[str],
                      lags: int = LAGS) -> list[dict]:
    model = fit(frame, columns)
    errors = np.sqrt(np.diag(newey_west(model, lags)))
    rows = []
    for name, slope, error in zip(columns, model.slopes, errors):
        if name in shown:
            t = slope / error
            rows.append({"term": name, "coef": round(float(slope), 4),
                         "t_hac": round(float(t), 2), "p": round(tails.two_sided(t), 4)})
    return rows


def contrasts(frame: DataFrame | Moments, lags: int = LAGS) -> list[dict]:
    """Text against prices; the same beside the regime; text under stress against text."""
    level, crossed = [*HAR, "stressed"], [f"{c}_x_stressed" for c in TEXT]
    sums = moments(frame if isinstance(frame, Moments) else with_interactions(frame),
                   level + TEXT + crossed)
    return nested_tests(sums, [
        (HAR, HAR + TEXT, "N1 - N0"), (level, level + TEXT, "N1 - N0 given regime"),
        (level + TEXT, level + TEXT + crossed, "N2 - N1")], lags)


def within_regimes(frame: DataFrame, lags: int = LAGS) -> list[dict]:
    """N1 - N0 inside each regime; a regime under 40 rows is reported without an estimate."""
    rows = []
    for value, label in ((0.0, "calm"), (1.0, "stressed")):
        inside = renumbered(frame.where(F.col("stressed") == value))
        n = inside.count()
        if n >= MIN_REGIME_ROWS:
            rows.append(nested_test(inside, HAR, HAR + TEXT, label, lags))
        elif n:
            rows.append({"contrast": label, "columns_added": len(TEXT), "n": n})
    return rows


def renumbered(frame: DataFrame) -> DataFrame:
    """Close the gaps in `position` after a filter, keeping the order."""
    lane = F.floor(F.col("position") / CHUNK)
    return with_global_position(frame.withColumn("_lane", lane).withColumnRenamed("position", "_old"),
                                "_lane", ["_old"], F.lit(0)).drop("_lane", "_old")


def in_sample_contributions(frame: DataFrame, block: list[str]) -> DataFrame:
    """Squared error each row saves in sample when `block` joins the price columns."""
    sums = moments(frame, HAR + block)
    small, big = fit(sums, HAR), fit(sums, HAR + block)
    both = big.centred.withColumn("e_text", big.residual()).withColumn("e_har", small.residual())
    return both.select("position", "ticker", "session_date", "stressed",
                       (F.col("e_har") ** 2 - F.col("e_text") ** 2).alias("gain"))


def as_rows(frame: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(",")]
    return frame.sparkSession.createDataFrame(
        [Row(**{n: row.get(n) for n in names}) for row in rows], schema)


CONTRAST_SCHEMA = ("contrast string, columns_added int, r2_base double, r2_full double, "
                   "r2_gain double, wald_chi2 double, p_hac double, n long")
COEFFICIENT_SCHEMA = "term string, coef double, t_hac double, p double"
