"""From typed readings to one numeric row per unit, and from replicates to one row per session.

Readings are one long table: ticker, session, replicate, tier (analyst, debate, forecast, panel or
single), seat and the fields of that tier; only validated readings are in it. One grouping computes
all tiers, so a unit is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

KEY = ["ticker", "session", "replicate"]

# Shock kinds from outside the issuer, width of the amplitude scale, panel seats,
# and the fields combined over replicates.
EXOGENOUS_KINDS = ("macro_policy", "geopolitical", "sector_wide")
AMPLITUDE_SCALE_WIDTH = 3.0 - (-1.6)
PANEL_SEATS = ("extreme", "central", "conservative")
MEDIAN_FIELDS = (
    "tone", "ambiguity", "analyst_spread", "exogeneity", "novelty",
    "mandate_gap", "signed_cancellation", "conviction_gap",
    "amplitude", "panel_dispersion", "measured_confidence", "interval_width",
    "forecast_amplitude", "amplitude_shift", "amplitude_multiple",
)
ANALYST_FIELDS = ("tone", "ambiguity", "analyst_spread", "exogeneity", "novelty", "n_analysts")
DEBATE_FIELDS = ("mandate_gap", "signed_cancellation", "conviction_gap", "debate_complete")
PANEL_FIELDS = ("amplitude", "panel_dispersion", "measured_confidence", "interval_width",
                "n_seats")
UNIT_FIELDS = (*ANALYST_FIELDS, *DEBATE_FIELDS, *PANEL_FIELDS,
               "forecast_amplitude", "amplitude_shift", "amplitude_multiple")


def _zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def _of_tier(tier: str, column: Column | str) -> Column:
    return F.when(F.col("tier") == tier, F.col(column) if isinstance(column, str) else column)


def _of_seat(tier: str, seat: str, column: str) -> Column:
    return F.max(F.when((F.col("tier") == tier) & (F.col("seat") == seat), F.col(column)))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Plain mean when every weight is zero, 0 when there is nothing."""
    return _zero(F.when(F.sum(weight) > 0, F.sum(value * weight) / F.sum(weight))
                 .otherwise(F.avg(value)))


def _analyst_measures() -> dict[str, Column]:
    def own(column):
        return _of_tier("analyst", column)

    return {
        "tone": weighted_mean(own(F.col("polarity") * F.col("intensity")), own("relevance")),
        "ambiguity": weighted_mean(own("ambiguity"), own("relevance")),
        "analyst_spread": _zero(F.stddev_pop(own("polarity"))),
        "exogeneity": _zero(F.avg(own(
            F.col("shock_kind").isin(*EXOGENOUS_KINDS).cast("double")))),
        "novelty": _zero(F.avg(own(F.col("is_new_information").cast("double")))),
        "n_analysts": F.count(own(F.lit(1))).cast("double"),
    }


def _debate_parts() -> dict[str, Column]:
    return {f"_{seat}_{field}": _of_seat("debate", seat, field)
            for seat in ("supportive", "adverse") for field in ("polarity", "conviction")}


def _debate_measures() -> dict[str, Column]:
    for_, against = F.col("_supportive_polarity"), F.col("_adverse_polarity")
    return {
        "mandate_gap": _zero(F.abs(for_ - against)),
        "signed_cancellation": _zero(for_ + against),
        "conviction_gap": _zero(F.when(
            for_.isNotNull() & against.isNotNull(),
            F.col("_supportive_conviction") - F.col("_adverse_conviction"))),
        "debate_complete": (for_.isNotNull() & against.isNotNull()).cast("double"),
    }


def _panel_parts() -> dict[str, Column]:
    seats = {f"_{seat}": _of_seat("panel", seat, "log_amplitude") for seat in PANEL_SEATS}
    return {**seats, "_spread": F.stddev_pop(_of_tier("panel", "log_amplitude")),
            "_width": F.avg(_of_tier("panel", F.col("upper") - F.col("lower"))),
            "_seats": F.count(_of_tier("panel", "log_amplitude"))}


def _panel_measures() -> dict[str, Column]:
    # At most three seats sit: their median is read off the sorted array, which stays inside the
    # hash aggregate where a percentile would need a map per group.
    levels = F.array_sort(F.array_compact(F.array(*[F.col(f"_{s}") for s in PANEL_SEATS])))
    n = F.col("_seats")
    middle = F.when(n == 1, levels[0]).when(n == 2, (levels[0] + levels[1]) / 2).when(
        n == 3, levels[1])
    share = F.least(F.lit(1.0), F.col("_spread") / F.lit(AMPLITUDE_SCALE_WIDTH / 2.0))
    return {
        "amplitude": _zero(middle),
        "panel_dispersion": _zero(F.col("_spread")),
        "measured_confidence": _zero(1.0 - share),
        "interval_width": _zero(F.col("_width")),
        "n_seats": n.cast("double"),
    }


def aggregate_analysts(readings: DataFrame, key: list[str] = KEY) -> DataFrame:
    return readings.where("tier = 'analyst'").groupBy(*key).agg(
        *[c.alias(n) for n, c in _analyst_measures().items()])


def aggregate_debate(readings: DataFrame, key: list[str] = KEY) -> DataFrame:
    parts = readings.where("tier = 'debate'").groupBy(*key).agg(
        *[c.alias(n) for n, c in _debate_parts().items()])
    return parts.select(*key, *[c.alias(n) for n, c in _debate_measures().items()])


def aggregate_panel(readings: DataFrame, key: list[str] = KEY) -> DataFrame:
    parts = readings.where("tier = 'panel'").groupBy(*key).agg(
        *[c.alias(n) for n, c in _panel_parts().items()])
    return parts.select(*key, *[c.alias(n) for n, c in _panel_measures().items()])


def aggregate_units(readings: DataFrame, key: list[str] = KEY) -> DataFrame:
    """All 18 columns of every unit that has at least one reading."""
    forecast = F.max(_of_tier("forecast", "log_amplitude"))
    parts = readings.groupBy(*key).agg(*[c.alias(n) for n, c in {
        **_analyst_measures(), **_debate_parts(), **_panel_parts(), "_forecast": forecast,
    }.items()])
    tiers = parts.select(*key, *ANALYST_FIELDS, "_forecast", *[
        c.alias(n) for n, c in {**_debate_measures(), **_panel_measures()}.items()])
    shift = F.when(F.col("n_seats") > 0, F.col("amplitude") - F.col("_forecast"))
    return (tiers.withColumn("forecast_amplitude", _zero(F.col("_forecast")))
            .withColumn("amplitude_shift", _zero(shift))
            .withColumn("amplitude_multiple", F.exp("amplitude"))
            .select(*key, *UNIT_FIELDS))


def aggregate_singles(readings: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The one-call control on the same columns: levels, no spread, confidence 1."""
    zero, one, level = F.lit(0.0), F.lit(1.0), F.col("log_amplitude")
    measures = {
        "tone": F.col("polarity") * F.col("intensity"), "ambiguity": F.col("ambiguity"),
        "analyst_spread": zero,
        "exogeneity": F.col("shock_kind").isin(*EXOGENOUS_KINDS).cast("double"),
        "novelty": F.col("is_new_information").cast("double"), "n_analysts": one,
        "mandate_gap": zero, "signed_cancellation": zero, "conviction_gap": zero,
        "debate_complete": zero, "amplitude": level, "panel_dispersion": zero,
        "measured_confidence": one, "interval_width": zero, "n_seats": zero,
        "forecast_amplitude": level, "amplitude_shift": zero, "amplitude_multiple": F.exp(level),
    }
    return readings.where("tier = 'single'").select(
        *key, *[measures[name].alias(name) for name in UNIT_FIELDS])


def fill_empty_units(units: DataFrame, measured: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Every unit with its 18 columns; a unit without readings gets zeros and multiple 1."""
    blanks = {name: 0.0 for name in UNIT_FIELDS if name != "amplitude_multiple"}
    return (units.join(measured, key, "left")
            .fillna({**blanks, "amplitude_multiple": 1.0}))


def combine_replicates(rows: DataFrame, k_required: int) -> DataFrame:
    """Median over replicates of units with exactly `k_required` failure-free rows.

    One row more than required already shows that a unit is not complete, so no more are sent and
    the lists the medians are read from hold at most that many.
    """
    fields = [f for f in MEDIAN_FIELDS if f in rows.columns]
    numbered = Window.partitionBy("ticker", "session").orderBy("replicate")
    usable = (rows.where(F.col("n_failures") == 0)
              .withColumn("_nth", F.row_number().over(numbered))
              .where(F.col("_nth") <= k_required + 1))
    units = (
        usable.groupBy("ticker", "session")
        .agg(F.first("has_document").alias("has_document"),
             F.first("n_documents").cast("long").alias("n_documents"),
             F.count(F.lit(1)).alias("replicates_used"),
             F.sum("calls").cast("long").alias("calls"), F.sum("cost_usd").alias("cost_usd"),
             F.collect_list(F.struct(*[F.col(f).cast("double").alias(f) for f in fields]))
             .alias("_rows"))
        .where(F.col("replicates_used") == k_required))
    return units.select(
        "ticker", "session", "has_document", "n_documents", "replicates_used", "calls",
        "cost_usd", *[_middle(F.col("_rows")[f], k_required).alias(f) for f in fields])


def _middle(values: Column, n: int) -> Column:
    ordered, half = F.sort_array(values), n // 2
    return ordered[half] if n % 2 else (ordered[half - 1] + ordered[half]) / 2


def dropped_units(rows: DataFrame, k_required: int) -> DataFrame:
    """Units with another number of rows, or with failures."""
    return (
        rows.groupBy("ticker", "session")
        .agg(F.count("replicate").alias("replicates"), F.sum("n_failures").alias("failures"),
             F.first("n_documents").alias("documents"))
        .where((F.col("replicates") != k_required) | (F.col("failures") > 0)))
