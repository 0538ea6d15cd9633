import math

import pytest
from pyspark.sql import functions as F

from tidelex.operators import rollup
from tidelex.plans import committee

READINGS = ("ticker string, session string, replicate int, tier string, seat string, "
            "relevance double, polarity double, intensity double, ambiguity double, "
            "is_new_information boolean, shock_kind string, conviction double, "
            "log_amplitude double, lower double, upper double")


def analyst(seat="a1", relevance=.8, polarity=.5, intensity=.6, ambiguity=.3, new=True,
            kind="issuer_results"):
    return ("analyst", seat, relevance, polarity, intensity, ambiguity, new, kind, None, None,
            None, None)


def position(side, polarity, conviction=.6):
    return ("debate", side, None, polarity, None, None, None, None, conviction, None, None, None)


def view(seat, level=.7, tier="panel"):
    return (tier, seat, None, None, None, None, None, None, None, level, max(-1.6, level - .3),
            min(3.0, level + .3))


def unit(spark, *readings):
    floats = [[float(v) if type(v) is int else v for v in r] for r in readings]
    frame = spark.createDataFrame([("T", "2025-01-15", 0, *r) for r in floats], READINGS)
    units = spark.createDataFrame([("T", "2025-01-15", 0)],
                                  "ticker string, session string, replicate int")
    return rollup.fill_empty_units(units, rollup.aggregate_units(frame)).first()


def test_tone_is_weighted_by_relevance_and_intensity(spark):
    assert unit(spark, analyst("a", 1, 1, 1), analyst("b", 0, -1, 1))["tone"] == 1.0
    assert unit(spark, analyst(polarity=-1, intensity=.1))["tone"] == pytest.approx(-.1)


def test_zero_relevance_falls_back_to_the_plain_mean(spark):
    row = unit(spark, analyst("a", 0, .4), analyst("b", 0, -.4))
    assert row["tone"] == pytest.approx(0)
    assert row["ambiguity"] == pytest.approx(.3)


def test_spread_is_the_population_deviation(spark):
    assert unit(spark, analyst("a", polarity=1), analyst("b", polarity=-1))[
        "analyst_spread"] == 1.0
    assert unit(spark, analyst())["analyst_spread"] == 0.0


def test_exogeneity_and_novelty_are_shares(spark):
    kinds = ["macro_policy", "geopolitical", "issuer_results", "none"]
    row = unit(spark, *[analyst(str(i), kind=k, new=i == 0) for i, k in enumerate(kinds)])
    assert (row["exogeneity"], row["novelty"], row["n_analysts"]) == (.5, .25, 4.0)


def test_debate(spark):
    row = unit(spark, position("supportive", .9, .8), position("adverse", -.9, .5))
    assert row["mandate_gap"] == pytest.approx(1.8)
    assert row["signed_cancellation"] == pytest.approx(0)
    assert row["conviction_gap"] == pytest.approx(.3)
    assert unit(spark, position("supportive", .4), position("adverse", .6))[
        "signed_cancellation"] > 0
    alone = unit(spark, position("supportive", .9))
    assert (alone["debate_complete"], alone["mandate_gap"], alone["conviction_gap"]) == (0, 0, 0)


def test_panel_takes_the_median_and_measures_confidence(spark):
    row = unit(spark, view("extreme", 3.0), view("central", .2), view("conservative", .3))
    assert row["amplitude"] == .3
    assert row["measured_confidence"] < 1
    assert unit(spark, view("extreme", .2), view("central", .4))["amplitude"] == pytest.approx(.3)
    calm = unit(spark, *[view(s, .7) for s in rollup.PANEL_SEATS])
    assert calm["measured_confidence"] == 1.0
    assert calm["interval_width"] == pytest.approx(.6)


def test_shift_from_the_forecast(spark):
    row = unit(spark, view("forecaster", .5, "forecast"),
               *[view(s, 1.0) for s in rollup.PANEL_SEATS])
    assert (row["forecast_amplitude"], row["amplitude_shift"]) == (.5, .5)
    alone = unit(spark, view("forecaster", .5, "forecast"))
    assert (alone["forecast_amplitude"], alone["amplitude_shift"]) == (.5, 0)


def test_empty_unit(spark):
    row = unit(spark)
    assert row["amplitude_multiple"] == 1.0
    assert all(row[f] == 0.0 for f in rollup.UNIT_FIELDS if f != "amplitude_multiple")


def test_control_fills_the_same_columns(spark):
    reading = ("single", "s", .5, -.5, .2, .4, True, "macro_policy", None, 1.2, None, None)
    frame = spark.createDataFrame([("T", "2025-01-15", 0, *reading)], READINGS)
    row = rollup.aggregate_singles(frame).first()
    assert set(row.asDict()) == {*rollup.KEY, *rollup.UNIT_FIELDS}
    assert row["tone"] == pytest.approx(-.1)
    assert (row["exogeneity"], row["measured_confidence"], row["panel_dispersion"]) == (1, 1, 0)
    assert row["amplitude_multiple"] == pytest.approx(math.exp(1.2))


def raw(spark, rows):
    return spark.createDataFrame(
        rows, "ticker string, session string, replicate int, n_failures int, tone double"
    ).withColumns({"has_document": F.lit(True), "n_documents": F.lit(2), "calls": F.lit(9),
                   "cost_usd": F.lit(.5)})


def test_only_complete_units_are_combined_and_the_rest_is_reported(spark):
    rows = raw(spark, [
        ("T", "d1", 0, 0, .1), ("T", "d1", 1, 0, .9), ("T", "d1", 2, 0, .2),
        ("T", "d2", 0, 0, .1), ("T", "d2", 1, 0, .2),
        ("T", "d3", 0, 0, .1), ("T", "d3", 1, 0, .2), ("T", "d3", 2, 1, .3)])
    kept = rollup.combine_replicates(rows, 3).collect()
    assert [(r["session"], r["tone"], r["calls"], r["cost_usd"], r["replicates_used"])
            for r in kept] == [("d1", .2, 27, 1.5, 3)]
    lost = {r["session"]: (r["replicates"], r["failures"])
            for r in rollup.dropped_units(rows, 3).collect()}
    assert lost == {"d2": (2, 0), "d3": (3, 1)}
    even = rollup.combine_replicates(rows.where("session = 'd2'"), 2).first()
    assert even["tone"] == pytest.approx(.15)


@pytest.mark.parametrize("debate,panel,calls", [(1, 1, 9), (2, 1, 11), (1, 2, 12)])
def test_calls_are_known_before_the_run(debate, panel, calls):
    assert committee.calls_per_unit(debate, panel) == calls
    assert committee.calls_per_unit(debate, panel, with_adjudicator=True) == calls + 1


@pytest.mark.parametrize("debate,panel", [(0, 1), (1, 0)])
def test_a_tier_cannot_be_skipped(debate, panel):
    with pytest.raises(ValueError):
        committee.route(debate, panel)


def test_route_alternates_and_cycles():
    turns = committee.route(2, 2)
    assert [s for t, s in turns if t == "debate"] == ["supportive", "adverse"] * 2
    assert [s for t, s in turns if t == "panel"] == ["extreme", "conservative", "central"] * 2
    assert [t for t, _ in turns][:3] == ["analyst"] * 3
    assert turns.index(("forecast", "forecaster")) == 7
