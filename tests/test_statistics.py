import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelex.errors import MissingColumn
from tidelex.functions import tails
from tidelex.operators import forecast, ordered, regime, regress, sampling


def panel(spark, **series):
    rows = []
    for ticker, values in series.items():
        days = pd.bdate_range("2021-01-04", periods=len(values)).date
        rows += [(ticker, d, None if v is None else float(v)) for d, v in zip(days, values)]
    return spark.createDataFrame(rows, "ticker string, session_date date, rv_gk double")


def labels(frame):
    return regime.classify_panel(frame).toPandas().sort_values(["ticker", "session_date"])


def test_a_spike_is_not_labelled_by_itself(spark):
    got = labels(panel(spark, A=[1e-4] * 26 + [1.0] + [1e-4] * 5))
    vol = got["trailing_vol"].tolist()
    assert got["regime"].tolist()[27] == "stressed"
    assert vol[26] == pytest.approx(vol[25]) and vol[27] > vol[26]


def test_the_first_21_sessions_are_unknown(spark):
    got = labels(panel(spark, A=[2e-4] * 31))
    assert (got["regime"][:21] == "unknown").all() and got["stressed"][:21].isna().all()
    assert (got["regime"][21:] != "unknown").all()


def test_about_a_third_is_stressed_per_instrument(spark):
    got = labels(panel(spark, A=np.linspace(1e-4, .05, 111)))
    share = got["stressed"].dropna().mean()
    assert .25 < share < .42 and set(got["stressed"].dropna()) == {0.0, 1.0}


def test_instruments_are_labelled_apart(spark):
    quiet, loud = np.linspace(1e-6, 2e-6, 81), np.linspace(1e-2, 2e-2, 81)
    got = labels(panel(spark, quiet=quiet, loud=loud))
    for ticker in ("quiet", "loud"):
        assert set(got[got.ticker == ticker]["stressed"].dropna()) == {0.0, 1.0}
    assert (got[(got.ticker == "quiet") & (got.stressed == 1)]["trailing_vol"].max()
            < got[(got.ticker == "loud") & (got.stressed == 0)]["trailing_vol"].min())


def test_rv_gk_is_required(spark):
    with pytest.raises(MissingColumn, match="rv_gk"):
        regime.classify_panel(panel(spark, A=[1.0]).drop("rv_gk"))


def test_trailing_volatility_over_chunks_and_gaps(spark, monkeypatch):
    rng = np.random.default_rng(3)
    values = [None if i in (40, 41, 90) else v for i, v in enumerate(rng.uniform(1e-5, 1e-3, 200))]
    values[60] = float("nan")
    monkeypatch.setattr(ordered.with_lookback, "__defaults__", (32,))
    got = regime.trailing_volatility(panel(spark, A=values)).toPandas().sort_values("session_date")
    daily = np.sqrt(pd.Series(values, dtype=float))
    expected = (daily.rolling(21).mean() * math.sqrt(252)).shift(1)
    np.testing.assert_allclose(got["trailing_vol"].to_numpy(float), expected, rtol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_exact_quantile_equals_linear_interpolation(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.lognormal(0, 3, n), 2)
    frame = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double")
    got = ordered.exact_quantile(frame, ["k"], "v", 2 / 3).first()["quantile"]
    assert got == pytest.approx(np.quantile(values, 2 / 3), rel=1e-12)


def test_positions_and_running_sums_across_chunks(spark):
    rows = [(k, i, float(i * i % 7)) for k in ("a", "b") for i in range(57)]
    frame = spark.createDataFrame(rows, "k string, i int, v double")
    placed = ordered.with_position(frame, ["k"], ["i"], F.floor(F.col("i") / 10))
    summed = ordered.running_sums(placed, ["k"], "position", {"s": F.col("v")}, chunk=8)
    for r in summed.collect():
        assert r["position"] == r["i"]
        assert r["s"] == sum(j * j % 7 for j in range(r["i"]))
    over_all = ordered.with_global_position(frame, "k", ["i"], F.floor(F.col("i") / 10))
    whole = ordered.running_sums(over_all, [], "position", {"s": F.col("v")}, chunk=4).collect()
    assert {r["position"]: r["s"] for r in whole} == {
        n: sum(v for _, _, v in rows[:n]) for n in range(len(rows))}
    assert {(r["k"], r["i"]): r["position"] for r in whole} == {
        (k, i): n for n, (k, i, _) in enumerate(rows)}
    with pytest.raises(ValueError):
        ordered.with_lookback(placed, "position", 8, chunk=8)


# -- sampling


@pytest.mark.parametrize("limit", [None, 0, 1, 3, 7, 29, 30, 31])
def test_stride_sample_matches_its_indices(spark, limit):
    days = [dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(30)]
    frame = spark.createDataFrame([("A", d) for d in days], "ticker string, session_date date")
    got = sorted(r["session_date"] for r in sampling.stride_sample(frame, limit).collect())
    n = len(days)
    wanted = days if not limit or limit >= n else [
        days[min(n - 1, int(i * (n / limit)))] for i in range(limit)]
    assert got == wanted


def test_draw_covers_regimes_and_years_and_repeats(spark):
    rng = np.random.default_rng(5)
    prices = panel(spark, A=rng.uniform(1e-5, 1e-3, 900), B=rng.uniform(1e-5, 1e-3, 900))
    first = sampling.draw(prices, 105).toPandas()
    again = sampling.draw(prices.repartition(3), 105).toPandas()
    key = ["ticker", "session_date"]
    pd.testing.assert_frame_equal(first.sort_values(key).reset_index(drop=True),
                                  again.sort_values(key).reset_index(drop=True))
    sizes = first.groupby(["ticker", "stressed"]).size()
    assert (sizes == 52).all()          # round(52.5) is 52, half to even
    years = first.assign(y=pd.to_datetime(first.session_date).dt.year)
    per_year = years.groupby(["ticker", "stressed", "y"]).size()
    assert per_year.min() >= 1 and per_year.index.get_level_values("y").nunique() == 4
    row = sampling.fingerprint(sampling.draw(prices, 105)).first()
    import hashlib
    lines = sorted(f"{t}|{d}" for t, d in zip(first.ticker, first.session_date))
    assert row["sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    large = sampling.fingerprint(sampling.draw(prices, 105), max_lines=10).first()
    assert large["sha256"] is None and large["n"] == len(lines)


def test_tree_fingerprint_depends_on_the_rows_alone(spark):
    rows = [(f"T{i % 37}", f"20{10 + i % 9}-0{1 + i % 9}-1{i % 10}") for i in range(600)]

    def root(of, parts=2):
        frame = spark.createDataFrame(of, "ticker string, d string").repartition(parts).select(
            "ticker", F.to_date("d").alias("session_date"))
        return tuple(sampling.tree_fingerprint(frame).first())

    whole = root(rows)
    assert whole[1] == 600 and root(rows[::-1], 5) == whole
    assert len({whole, root(rows[1:]), root(rows + rows[:1]), root(rows + [("T1", None)]),
                root([("T0", "2010-01-11")] + rows[1:]), root(rows + [(None, "2010-01-10")])}) == 6
    assert root([], 1)[1] == 0


# -- regressions


def hand_fit(frame, columns, lags=5):
    """Dense regression with dummies and a loop over lags."""
    tickers = sorted(frame.ticker.unique())[1:]
    x = np.column_stack([np.ones(len(frame)), frame[columns].to_numpy(),
                         *[(frame.ticker == t).astype(float) for t in tickers]])
    y = frame["y"].to_numpy()
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    e = y - x @ beta
    g = x * e[:, None]
    s = g.T @ g
    for lag in range(1, lags + 1):
        part = g[lag:].T @ g[:-lag]
        s += (1 - lag / (lags + 1)) * (part + part.T)
    return beta, 1 - (e @ e) / ((y - y.mean()) ** 2).sum(), inverse @ s @ inverse, e


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    n = 260
    data = pd.DataFrame({
        "position": range(n), "ticker": ["A"] * 130 + ["B"] * 90 + ["C"] * 40,
        "session_date": [*pd.bdate_range("2021-01-04", periods=130).date,
                         *pd.bdate_range("2021-01-04", periods=90).date,
                         *pd.bdate_range("2021-01-04", periods=40).date],
        "stressed": (rng.random(n) < .4).astype(float)})
    for c in [*regress.HAR, *regress.TEXT]:
        data[c] = rng.normal(size=n)
    data["y"] = data["ln_rv_d"] * .5 + data["amplitude"] * .3 + rng.normal(size=n)
    return data, spark.createDataFrame(data).repartition(3).cache()


def test_slopes_and_newey_west_equal_the_dense_regression(frame):
    data, df = frame
    columns = regress.HAR + regress.TEXT
    beta, r2, covariance, _ = hand_fit(data, columns)
    model = regress.fit(df, columns)
    k = len(columns)
    np.testing.assert_allclose(model.slopes, beta[1:k + 1], rtol=1e-9)
    assert model.rsquared == pytest.approx(r2, rel=1e-9)
    np.testing.assert_allclose(regress.newey_west(model), covariance[1:k + 1, 1:k + 1],
                               rtol=1e-7, atol=1e-12)


def test_wald_block(frame):
    data, df = frame
    row = regress.nested_test(df, regress.HAR, regress.HAR + regress.TEXT, "x")
    beta, _, covariance, _ = hand_fit(data, regress.HAR + regress.TEXT)
    block = slice(4, 7)
    chi2 = beta[block] @ np.linalg.inv(covariance[block, block]) @ beta[block]
    assert row["wald_chi2"] == round(chi2, 3)
    assert row["p_hac"] == round(tails.chi2_tail(chi2, 3), 4)


def test_contributions_and_renumbering(frame):
    data, df = frame
    saved = regress.in_sample_contributions(df, ["amplitude"]).toPandas().sort_values("position")
    e0, e1 = hand_fit(data, regress.HAR)[3], hand_fit(data, regress.HAR + ["amplitude"])[3]
    np.testing.assert_allclose(saved["gain"], e0 ** 2 - e1 ** 2, atol=1e-9)
    gaps = regress.renumbered(df.where("position % 3 <> 1")).toPandas().sort_values("position")
    assert gaps["position"].tolist() == list(range(len(gaps)))


def test_forecasts_equal_refitting_every_row(frame):
    data, df = frame
    got = forecast.out_of_sample(df, 30).toPandas().sort_values(["ticker", "date"])
    expected = []
    for _, group in data.groupby("ticker"):
        for i in range(30, len(group)):
            row = {}
            for label, columns in (("har", regress.HAR), ("text", regress.HAR + ["amplitude"])):
                x = np.column_stack([np.ones(i), group[columns].to_numpy()[:i]])
                beta = np.linalg.lstsq(x, group["y"].to_numpy()[:i], rcond=None)[0]
                row[label] = np.r_[1.0, group[columns].to_numpy()[i]] @ beta
            expected.append((row["har"], row["text"]))
    np.testing.assert_allclose(got[["p_har", "p_text"]].to_numpy(), expected, rtol=1e-8)


def test_a_constant_block_leaves_the_forecast_alone(frame):
    data, df = frame
    got = forecast.out_of_sample(df.withColumn("amplitude", F.lit(0.0)), 30).toPandas()
    np.testing.assert_allclose(got["p_har"], got["p_text"], rtol=1e-8)


def test_clark_west_kish_and_drops(spark):
    rng = np.random.default_rng(2)
    data = pd.DataFrame({
        "date": pd.bdate_range("2021-01-04", periods=50).date, "ticker": "A",
        "position": range(50),
        "stressed": (np.arange(50) % 2).astype(float), "e2_har": rng.random(50) + .05,
        "e2_text": rng.random(50), "p_har": rng.random(50), "p_text": rng.random(50)})
    df = spark.createDataFrame(data)

    def by_hand(part):
        f = part.e2_har - part.e2_text + (part.p_har - part.p_text) ** 2
        return f.mean() / (f.std() / math.sqrt(len(f)))

    got = {r["sample"]: r for r in forecast.clark_west(df).collect()}
    for name, part in (("all", data), ("calm", data[data.stressed == 0]),
                       ("stressed", data[data.stressed == 1])):
        assert got[name]["statistic"] == pytest.approx(by_hand(part))
        assert got[name]["n"] == len(part)
        assert got[name]["p_one_sided"] == pytest.approx(tails.normal_tail(by_hand(part)))
    gain = data.e2_har - data.e2_text
    row = forecast.concentration(df.withColumn("gain", forecast.gain()), "gain",
                                 forecast.ROW).first()
    assert row["effective_n"] == pytest.approx(gain.sum() ** 2 / (gain ** 2).sum())
    assert row["top5_share"] == pytest.approx(gain.nlargest(5).sum() / gain.sum())
    assert row["worse"] == (gain < 0).sum()
    for r in forecast.retest_without_best(df).collect():
        rest = data.drop(gain.nlargest(r["dropped"]).index)
        assert r["statistic"] == pytest.approx(by_hand(rest)) and r["n"] == len(rest)


def test_sessions_that_overlapping_tags_repeat_are_rows_of_their_own(spark):
    gains = [5.0, 5.0, 5.0, 1.0, -2.0]
    data = pd.DataFrame({
        "date": [pd.Timestamp("2021-01-04").date()] * 3 + [pd.Timestamp("2021-01-05").date()] * 2,
        "ticker": "A", "position": range(5), "stressed": 0.0, "e2_har": [g + 3 for g in gains],
        "e2_text": 3.0, "p_har": [0.1, 0.2, 0.3, 0.4, 0.5], "p_text": 0.0})
    df = spark.createDataFrame(data)
    row = forecast.concentration(df.withColumn("gain", forecast.gain()), "gain", forecast.ROW,
                                 top=1).first()
    assert (row["n"], row["worse"]) == (5, 1)
    assert row["effective_n"] == pytest.approx(14 ** 2 / 80)
    assert row["top1_share"] == pytest.approx(5 / 14)
    left = forecast.retest_without_best(df, (1, 3)).collect()
    assert {r["dropped"]: r["n"] for r in left} == {1: 4, 3: 2}


def test_forecasts_with_repeated_sessions_follow_the_position(frame):
    data, df = frame
    twice = df.unionByName(df.withColumn("position", F.col("position") + len(data))
                           .withColumn("y", F.col("y") + 1.0))
    got = forecast.out_of_sample(twice.repartition(5), 60).toPandas().sort_values("position")
    again = forecast.out_of_sample(twice.repartition(2), 60).toPandas().sort_values("position")
    assert got["position"].is_unique and len(got) == 2 * len(data) - 3 * 60
    np.testing.assert_allclose(got["p_text"], again["p_text"], rtol=1e-9)


def test_kish_of_a_zero_total_is_zero(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,)], "v double")
    assert df.agg(forecast.effective_n(F.col("v"))).first()[0] == 0.0


def test_tails():
    assert tails.normal_tail(1.959963984540054) == pytest.approx(.025, rel=1e-9)
    assert tails.two_sided(-1.959963984540054) == pytest.approx(.05, rel=1e-9)
    # Upper 5 % points of the chi-square with 1 to 6 degrees of freedom.
    for df, x in enumerate((3.841458820694124, 5.991464547107979, 7.814727903251179,
                            9.487729036781154, 11.070497693516351, 12.591587243743977), 1):
        assert tails.chi2_tail(x, df) == pytest.approx(.05, rel=1e-9)
    assert tails.chi2_tail(0.0, 3) == 1.0


def test_report_commands_run_on_stored_tables(spark, tmp_path, monkeypatch):
    from tidelex.plans import cli
    rng = np.random.default_rng(4)
    n = 200
    days = pd.bdate_range("2021-01-04", periods=n).date
    prices = pd.concat([pd.DataFrame({
        "ticker": t, "session_date": days, "rv_gk": rng.uniform(1e-5, 1e-3, n),
        "tone": 9.0, **{c: rng.normal(size=n) for c in ["y", *regress.HAR]}}) for t in "AB"])
    read = pd.concat([pd.DataFrame({
        "ticker": t, "session": [str(d) for d in days],
        **{c: rng.normal(size=n) for c in regress.TEXT}}) for t in "AB"])
    spark.createDataFrame(prices).write.parquet(f"{tmp_path}/panel.parquet")
    for tag, part in (("late", read[n // 2:]), ("early", read[:n // 2])):
        spark.createDataFrame(part).write.parquet(f"{tmp_path}/signals_{tag}.parquet")
    monkeypatch.setenv("TIDELEX_DATA_DIR", str(tmp_path))
    monkeypatch.setenv("TIDELEX_RESULTS_DIR", str(tmp_path))
    tables = cli.main(["contrast", "--signals", "late", "early"], spark)
    cells = tables["cells"].collect()
    rows = sum(r["calm"] + r["stressed"] for r in cells)
    assert rows == 2 * (n - 21)
    assert [r["n"] for r in tables["contrasts"].collect()] == [rows] * 3
    assert tables["coefficients"].count() == 6
    inside = tables["within_regimes"].collect()
    assert sum(r["n"] for r in inside) == rows
    # Tags are read in the order named, a shadowed panel column does not replace the signal.
    both = spark.createDataFrame(read).withColumn("tag_order", F.lit(0))
    frame = regress.build_frame(both, spark.createDataFrame(prices)).toPandas()
    assert frame["tone"].abs().max() < 9 and (frame["tone_panel"] == 9).all()
    assert frame.sort_values("position")["ticker"].is_monotonic_increasing
    tables = cli.main(["oos", "--signals", "late", "early", "--min-train", "60"], spark)
    by_sample = {r["sample"]: r["n"] for r in tables["clark_west"].collect()}
    assert by_sample["all"] == by_sample["calm"] + by_sample["stressed"] == rows - 120
    assert {r["dropped"]: r["n"] for r in tables["without_best"].collect()} == {
        5: rows - 125, 10: rows - 130}
    assert tables["in_sample_without_best"].first()["n"] == rows - 10
