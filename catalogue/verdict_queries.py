"""The statistical queries and their relational twins."""

from __future__ import annotations

from catalogue import oracles as o
from catalogue.queries import _frame, query, rounded
from tidelex.operators import forecast, regress
from tidelex.operators.regress import HAR, TEXT
from tidelex.plans import verdict
from tidelex.session import checkpointed

_CROSSED = [f"{c}_x_stressed" for c in TEXT]
_LEVEL = [*HAR, "stressed"]


def _cut(spark, sf):
    return checkpointed(_frame(spark, sf))


def _ahead(spark, sf):
    return forecast.out_of_sample(_frame(spark, sf)).withColumn("gain", forecast.gain())


@query("oos_forecasts", f"WITH {o.forecasts()} SELECT date, ticker, stressed, "
       f"{o.rounded(['e2_har', 'e2_text', 'p_har', 'p_text'])} FROM ahead")
def oos_forecasts(spark, sf):
    return rounded(_ahead(spark, sf).drop("gain", "position"), ["e2_har", "e2_text", "p_har", "p_text"])


@query("clark_west", f"""WITH {o.forecasts()}, tests AS (
SELECT CASE WHEN grouping(stressed) = 1 THEN 'all' WHEN stressed = 1 THEN 'stressed'
            ELSE 'calm' END AS sample, count(*) AS n,
       avg(f) / (stddev_samp(f) / sqrt(count(*))) AS statistic
FROM gains GROUP BY ROLLUP (stressed))
SELECT sample, n, round(statistic, 6) AS statistic,
       round({o.tail('statistic')}, 6) AS p_one_sided FROM tests""")
def clark_west(spark, sf):
    return rounded(forecast.clark_west(_ahead(spark, sf)), ["statistic", "p_one_sided"])


@query("kish_concentration", f"""WITH {o.forecasts()}, best AS (
SELECT sum(gain) AS head FROM (SELECT gain FROM gains ORDER BY gain DESC, date, ticker LIMIT 5))
SELECT round(power(sum(gain), 2) / sum(gain * gain), 6) AS effective_n, count(*) AS n,
       round(any_value(head) / sum(gain), 6) AS top5_share, count_if(gain < 0) AS worse
FROM gains, best""")
def kish_concentration(spark, sf):
    ahead = checkpointed(_ahead(spark, sf))
    return rounded(forecast.concentration(ahead, "gain", forecast.ROW),
                   ["effective_n", "top5_share"])


@query("top_gains", f"WITH {o.forecasts()} SELECT date, ticker, round(gain, 6) AS gain "
       "FROM gains ORDER BY gains.gain DESC, date, ticker LIMIT 10")
def top_gains(spark, sf):
    best = forecast.best(_ahead(spark, sf), "gain", 10, forecast.ROW)
    return rounded(best.select("date", "ticker", "gain"), ["gain"])


def _retest(k: int) -> str:
    return f"""SELECT {k} AS dropped, count(*) AS n,
  avg(f) / (stddev_samp(f) / sqrt(count(*))) AS statistic FROM (
  SELECT f, row_number() OVER (ORDER BY gain DESC, date, ticker) AS r FROM gains) WHERE r > {k}"""


@query("retest_without_best", f"""WITH {o.forecasts()}, tests AS (
{_retest(5)} UNION ALL {_retest(10)}), judged AS (
SELECT *, {o.tail('statistic')} AS p FROM tests)
SELECT dropped, n, round(statistic, 6) AS statistic, round(p, 6) AS p_one_sided,
       p < 0.05 AS still_significant FROM judged""")
def retest_without_best(spark, sf):
    ahead = checkpointed(_ahead(spark, sf))
    return rounded(forecast.retest_without_best(ahead), ["statistic", "p_one_sided"])


@query("ols_r2", f"""WITH RECURSIVE {o.FRAME}, {o.ols('a', HAR)}, {o.ols('b', HAR + TEXT)}
SELECT 'har' AS model, n, round(r2, 6) AS r2 FROM a_r2 UNION ALL
SELECT 'har_text', n, round(r2, 6) FROM b_r2""")
def ols_r2(spark, sf):
    frame = _cut(spark, sf)
    rows = [(name, model.n, round(model.rsquared, 6)) for name, model in (
        ("har", regress.fit(frame, HAR)), ("har_text", regress.fit(frame, HAR + TEXT)))]
    return spark.createDataFrame(rows, "model string, n long, r2 double")


@query("wald_nested", f"""WITH RECURSIVE {o.FRAME}, {o.nested('p', HAR, HAR + TEXT)},
{o.nested('q', _LEVEL, _LEVEL + TEXT)}, {o.nested('r', _LEVEL + TEXT, _LEVEL + TEXT + _CROSSED)}
{o.nested_row('p', 'N1 - N0', 3)} UNION ALL {o.nested_row('q', 'N1 - N0 given regime', 3)}
UNION ALL {o.nested_row('r', 'N2 - N1', 3)}""")
def wald_nested(spark, sf):
    frame = _cut(spark, sf)
    return regress.as_rows(frame, regress.contrasts(frame), regress.CONTRAST_SCHEMA)


_FULL = [*_LEVEL, *TEXT, *_CROSSED]


@query("hac_coefficients", f"""WITH RECURSIVE {o.FRAME}, {o.ols('a', _FULL)}, {o.hac('a')},
shown AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {_FULL.index(c) + 2})"
                                           for c in TEXT + _CROSSED)}) u(term, j)),
tests AS (SELECT term, b, b / sqrt(v) AS t FROM shown JOIN a_b USING (j)
          JOIN a_v ON a_v.i = shown.j AND a_v.j = shown.j)
SELECT term, round(b, 4) AS coef, round(t, 2) AS t_hac,
       round(2 * {o.tail('abs(t)')}, 4) AS p FROM tests""")
def hac_coefficients(spark, sf):
    frame = regress.with_interactions(_cut(spark, sf))
    return regress.as_rows(frame, regress.coefficient_table(frame, _FULL, TEXT + _CROSSED),
                           regress.COEFFICIENT_SCHEMA)


@query("within_regimes", f"""WITH RECURSIVE {o.FRAME},
calm AS (SELECT * FROM frame WHERE stressed = 0), stress AS (SELECT * FROM frame WHERE stressed = 1),
{o.nested('p', HAR, HAR + TEXT, 'calm')}, {o.nested('q', HAR, HAR + TEXT, 'stress')}
{o.nested_row('p', 'calm', 3)} UNION ALL {o.nested_row('q', 'stressed', 3)}""")
def within_regimes(spark, sf):
    frame = _cut(spark, sf)
    return regress.as_rows(frame, regress.within_regimes(frame), regress.CONTRAST_SCHEMA)


_SAVED = f"""WITH RECURSIVE {o.FRAME}, {o.ols('a', HAR)}, {o.ols('b', HAR + ['amplitude'])},
saved AS (SELECT f.*, a_e.e * a_e.e - b_e.e * b_e.e AS gain
          FROM frame f JOIN a_e USING (position) JOIN b_e USING (position))"""


@query("in_sample_contributions", _SAVED
       + " SELECT ticker, session_date, round(gain, 6) + 0.0 AS gain FROM saved")
def in_sample_contributions(spark, sf):
    saved = regress.in_sample_contributions(_cut(spark, sf), forecast.BLOCK)
    return rounded(saved.select("ticker", "session_date", "gain"), ["gain"])


@query("in_sample_concentration", _SAVED + """, best AS (
SELECT sum(gain) AS head FROM (SELECT gain FROM saved ORDER BY gain DESC, position LIMIT 5))
SELECT round(power(sum(gain), 2) / sum(gain * gain), 6) AS effective_n, count(*) AS n,
       round(any_value(head) / sum(gain), 6) AS top5_share, count_if(gain < 0) AS worse
FROM saved, best""")
def in_sample_concentration(spark, sf):
    saved = checkpointed(regress.in_sample_contributions(_cut(spark, sf), forecast.BLOCK))
    return rounded(forecast.concentration(saved, "gain", ["position"]),
                   ["effective_n", "top5_share"])


@query("in_sample_without_best", _SAVED + f""", rest AS (
SELECT * EXCLUDE (r) FROM (
  SELECT *, row_number() OVER (ORDER BY gain DESC, position) AS r FROM saved) WHERE r > 10),
{o.nested('p', HAR, HAR + ['amplitude'], 'rest')} {o.nested_row('p', 'without 10', 1)}""")
def in_sample_without_best(spark, sf):
    frame = _cut(spark, sf)
    saved = checkpointed(regress.in_sample_contributions(frame, forecast.BLOCK))
    return regress.as_rows(frame, [verdict.in_sample_retest(frame, saved)],
                           regress.CONTRAST_SCHEMA)
