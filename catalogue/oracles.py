"""DuckDB statements of the catalogue, over the driver's tables.

Each states its own views, so a mistake in the Spark adapters shows as a mismatch.
"""

from __future__ import annotations

NEWS = r"""
news AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id,
         'T' || (doc_id % 3) || '-' || (doc_id // 1000) AS ticker,
         TIMESTAMP '2024-01-01' + to_seconds((doc_id * 7919) % 2592000) AS published_utc,
         substr(text, 1, 60) AS title, text AS body, source
  FROM documents),
sessions AS (
  SELECT ticker, CAST(d AS DATE) AS session_date
  FROM (SELECT DISTINCT ticker FROM news),
       (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31',
                                      INTERVAL 1 DAY)) AS d))"""


def eligible(hours: int = 24, minutes: int = 1050, seconds: int = 0,
             min_chars: int = 200) -> str:
    """Range join as stated: January, so Paris is UTC+1."""
    origin = f"(s.session_date + to_seconds({minutes * 60 + seconds - 3600}))"
    return NEWS + rf""",
eligible AS (
  SELECT s.ticker, s.session_date, n.doc_id, n.published_utc, n.title, n.source, n.body
  FROM sessions s JOIN news n ON n.ticker = s.ticker
   AND n.published_utc >= {origin} - INTERVAL {hours} HOUR AND n.published_utc < {origin}
  WHERE length(n.body) >= {min_chars})"""


def trigrams(text: str) -> str:
    """Distinct word trigrams of an expression, as a list."""
    words = f"list_filter(string_split_regex(lower({text}), '[\\s\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+'), lambda w: w <> '')"
    return (f"list_transform([{words}], lambda w: list_distinct(list_transform("
            "generate_series(1, len(w) - 2), "
            "lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))[1]")


def kept(source: str, unit: str, threshold: float = 0.85) -> str:
    """Greedy rule as a left fold over the ordered documents of a unit."""
    return rf"""
grams AS (
  SELECT {unit}, doc_id, published_utc, {trigrams('body')} AS g FROM {source}),
folded AS (
  SELECT {unit}, list_reduce(
    list(struct_pack(ids := [doc_id], sets := [g]) ORDER BY published_utc, doc_id),
    lambda acc, x: CASE WHEN len(list_filter(acc.sets, lambda k:
        len(list_intersect(k, x.sets[1])) / greatest(1, least(len(k), len(x.sets[1])))
        >= {threshold})) > 0 THEN acc
      ELSE struct_pack(ids := list_concat(acc.ids, x.ids),
                       sets := list_concat(acc.sets, x.sets)) END,
    struct_pack(ids := []::VARCHAR[], sets := []::VARCHAR[][])) AS f
  FROM grams WHERE len(g) > 0 GROUP BY ALL),
kept AS (
  SELECT {unit}, unnest(f.ids) AS doc_id, CAST(len(f.ids) AS BIGINT) AS n_documents FROM folded)"""


CELLS = r"""
days AS (
  SELECT 'S' || (l_suppkey // 20) AS ticker, CAST(l_shipdate AS DATE) AS day,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         count(*) AS n, sum(CAST(floor(l_discount * 100 + 0.5) AS BIGINT)) AS discounts,
         sum(CAST(floor(l_tax * 100 + 0.5) AS BIGINT)) AS taxes,
         sum(CAST(trunc(l_quantity) AS BIGINT)) AS quantities
  FROM lineitem GROUP BY ALL),
cells AS (
  SELECT ticker, CAST(date_trunc('week', day) AS DATE) AS session_date,
         arg_min(low, day) AS open, max(high) AS high, min(low) AS low,
         arg_max(high, day) AS close, CAST(sum(n) AS BIGINT) AS n,
         CAST(sum(discounts) AS BIGINT) AS discounts, CAST(sum(taxes) AS BIGINT) AS taxes,
         CAST(sum(quantities) AS BIGINT) AS quantities
  FROM days GROUP BY ALL)"""

PANEL = CELLS + r""",
variances AS (
  SELECT ticker, session_date,
         nullif(0.5 * power(ln(high / low), 2)
                - 0.3862943611198906 * power(ln(close / open), 2), 0.0) AS rv_gk FROM cells),
panel AS (
  SELECT ticker, session_date,
         lead(ln(rv_gk)) OVER w AS y, ln(rv_gk) AS ln_rv_d,
         ln(avg(rv_gk) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS ln_rv_w,
         ln(avg(rv_gk) OVER (w ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)) AS ln_rv_m, rv_gk
  FROM variances WINDOW w AS (PARTITION BY ticker ORDER BY session_date))"""

LABELLED = PANEL + r""",
measured AS (
  SELECT *, CASE WHEN count(rv_gk) OVER w = 21
                 THEN avg(sqrt(rv_gk)) OVER w * sqrt(252) END AS trailing_vol
  FROM panel
  WINDOW w AS (PARTITION BY ticker ORDER BY session_date ROWS BETWEEN 21 PRECEDING
               AND 1 PRECEDING)),
ordered_vols AS (
  SELECT ticker, trailing_vol,
         row_number() OVER (PARTITION BY ticker ORDER BY trailing_vol) - 1 AS k,
         (count(*) OVER (PARTITION BY ticker) - 1) * (2.0::DOUBLE / 3) AS qpos
  FROM measured WHERE trailing_vol IS NOT NULL),
cuts AS (
  SELECT ticker, max(CASE WHEN k = floor(qpos) THEN trailing_vol END) AS low,
         max(CASE WHEN k = ceil(qpos) THEN trailing_vol END) AS high, max(qpos - floor(qpos)) AS part
  FROM ordered_vols GROUP BY ticker),
labelled AS (
  SELECT m.*, CASE WHEN trailing_vol IS NULL THEN 'unknown'
                   WHEN trailing_vol >= low + (high - low) * part THEN 'stressed'
                   ELSE 'calm' END AS regime,
         CASE WHEN trailing_vol IS NULL THEN NULL
              WHEN trailing_vol >= low + (high - low) * part THEN 1.0::DOUBLE
              ELSE 0.0::DOUBLE END AS stressed
  FROM measured m LEFT JOIN cuts USING (ticker))"""

FRAME = LABELLED + r""",
signals AS (
  SELECT ticker, session_date, discounts::DOUBLE / n / 5.0 - 1.0 AS tone,
         taxes::DOUBLE / n / 8.0 AS ambiguity,
         (quantities::DOUBLE / n - 25.0) / 10.0 AS amplitude FROM cells),
frame AS (
  SELECT row_number() OVER (ORDER BY s.ticker, s.session_date) - 1 AS position, s.*,
         l.y, l.ln_rv_d, l.ln_rv_w, l.ln_rv_m, l.trailing_vol, l.stressed,
         s.tone * l.stressed AS tone_x_stressed, s.ambiguity * l.stressed AS ambiguity_x_stressed,
         s.amplitude * l.stressed AS amplitude_x_stressed
  FROM signals s JOIN labelled l USING (ticker, session_date)
  WHERE l.y IS NOT NULL AND l.ln_rv_d IS NOT NULL AND l.ln_rv_w IS NOT NULL
    AND l.ln_rv_m IS NOT NULL AND l.trailing_vol IS NOT NULL AND l.stressed IS NOT NULL)"""

UNIT_COLUMNS = r"""'K' || (doc_id % 20) || '-' || (doc_id // 40000) AS ticker,
         strftime(DATE '2015-01-01' + CAST((doc_id // 20) % 2000 AS INTEGER), '%Y-%m-%d')
           AS session"""


def _v(salt: int) -> str:
    return (f"(((doc_id * 31 + seat_no * 17 + replicate * 7 + {salt * 13} + n_chars) % 101)"
            "::DOUBLE / 100.0::DOUBLE)")


_LEVEL = f"(-1.6::DOUBLE + 4.6::DOUBLE * {_v(7)})"
READINGS = rf"""
readings AS (
  SELECT {UNIT_COLUMNS}, CAST(replicate AS INTEGER) AS replicate,
         CASE WHEN seat_no < 3 THEN 'analyst' WHEN seat_no < 5 THEN 'debate'
              WHEN seat_no = 5 THEN 'forecast' ELSE 'panel' END AS tier,
         ['analyst_fundamentals','analyst_exogeneity_v2','analyst_tone','supportive','adverse',
          'forecaster','extreme','central','conservative'][seat_no + 1] AS seat,
         CASE WHEN doc_id % 11 = 0 THEN 0.0::DOUBLE ELSE {_v(1)} END AS relevance,
         2.0::DOUBLE * {_v(2)} - 1.0::DOUBLE AS polarity, {_v(3)} AS intensity,
         {_v(4)} AS ambiguity, {_v(5)} >= 0.5 AS is_new_information,
         ['macro_policy','geopolitical','sector_wide','issuer_governance','issuer_results',
          'issuer_capital','none'][(doc_id + seat_no + replicate) % 7 + 1] AS shock_kind,
         {_v(6)} AS conviction, {_LEVEL} AS log_amplitude,
         greatest(-1.6::DOUBLE, {_LEVEL} - 0.3::DOUBLE * {_v(8)}) AS lower,
         least(3.0::DOUBLE, {_LEVEL} + 0.3::DOUBLE * {_v(9)}) AS upper
  FROM documents, range(3) r(replicate), range(9) s(seat_no)
  WHERE (doc_id + seat_no * 3 + replicate) % 37 <> 0)"""

_MISSING = " + ".join(f"CAST((doc_id + {seat * 3} + replicate) % 37 = 0 AS INTEGER)"
                      for seat in range(9))
UNITS = rf"""
units AS (
  SELECT {UNIT_COLUMNS}, CAST(replicate AS INTEGER) AS replicate, TRUE AS has_document,
         1 + doc_id % 4 AS n_documents, 9 - doc_id % 3 AS calls,
         n_chars::DOUBLE / 1e6::DOUBLE * 0.3::DOUBLE AS cost_usd,
         CAST({_MISSING} AS BIGINT) AS n_failures
  FROM documents, range(3) r(replicate)
  WHERE NOT (doc_id % 23 = 5 AND replicate = 2))"""

LEDGER = r"""
ledger AS (
  SELECT event_id, ts AS stamp, event_type, 'm' || (user_id % 50) AS mandate,
         CAST(round(value * 100) AS BIGINT) AS tokens,
         CASE WHEN event_type = 'error' THEN '' WHEN event_id % 97 = 0 THEN 'n/a'
              ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS cost_usd,
         CASE WHEN event_type = 'error'
              THEN CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS cout_usd
  FROM events)"""

ANALYSTS = r"""
analysts AS (
  SELECT ticker, session, replicate,
    CASE WHEN sum(relevance) > 0 THEN sum(polarity * intensity * relevance) / sum(relevance)
         ELSE avg(polarity * intensity) END AS tone,
    CASE WHEN sum(relevance) > 0 THEN sum(ambiguity * relevance) / sum(relevance)
         ELSE avg(ambiguity) END AS ambiguity,
    stddev_pop(polarity) AS analyst_spread,
    avg(CASE WHEN shock_kind IN ('macro_policy','geopolitical','sector_wide')
        THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS exogeneity,
    avg(CASE WHEN is_new_information THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS novelty,
    count(*)::DOUBLE AS n_analysts
  FROM readings WHERE tier = 'analyst' GROUP BY ALL)"""

DEBATES = r"""
sides AS (
  SELECT a.ticker, a.session, a.replicate, s.polarity AS sp, s.conviction AS sc,
         d.polarity AS ap, d.conviction AS ac
  FROM (SELECT DISTINCT ticker, session, replicate FROM readings WHERE tier = 'debate') a
  LEFT JOIN (SELECT * FROM readings WHERE seat = 'supportive') s USING (ticker, session, replicate)
  LEFT JOIN (SELECT * FROM readings WHERE seat = 'adverse') d USING (ticker, session, replicate)),
debates AS (
  SELECT ticker, session, replicate, coalesce(abs(sp - ap), 0) AS mandate_gap,
         coalesce(sp + ap, 0) AS signed_cancellation, coalesce(sc - ac, 0) AS conviction_gap,
         CASE WHEN sp IS NULL OR ap IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END
           AS debate_complete
  FROM sides)"""

PANELS = r"""
panels AS (
  SELECT ticker, session, replicate, median(log_amplitude) AS amplitude,
         stddev_pop(log_amplitude) AS panel_dispersion,
         1.0 - least(1.0, stddev_pop(log_amplitude) / 2.3) AS measured_confidence,
         avg(upper - lower) AS interval_width, count(*)::DOUBLE AS n_seats
  FROM readings WHERE tier = 'panel' GROUP BY ALL)"""

MEASURED = READINGS + "," + ANALYSTS + "," + DEBATES + "," + PANELS + r""",
forecasts AS (
  SELECT ticker, session, replicate, log_amplitude AS f FROM readings WHERE tier = 'forecast'),
measured AS (
  SELECT k.ticker, k.session, k.replicate, coalesce(tone, 0) AS tone,
         coalesce(ambiguity, 0) AS ambiguity, coalesce(analyst_spread, 0) AS analyst_spread,
         coalesce(exogeneity, 0) AS exogeneity, coalesce(novelty, 0) AS novelty,
         coalesce(n_analysts, 0) AS n_analysts, coalesce(mandate_gap, 0) AS mandate_gap,
         coalesce(signed_cancellation, 0) AS signed_cancellation,
         coalesce(conviction_gap, 0) AS conviction_gap,
         coalesce(debate_complete, 0) AS debate_complete, coalesce(amplitude, 0) AS amplitude,
         coalesce(panel_dispersion, 0) AS panel_dispersion,
         coalesce(measured_confidence, 0) AS measured_confidence,
         coalesce(interval_width, 0) AS interval_width, coalesce(n_seats, 0) AS n_seats,
         coalesce(f, 0) AS forecast_amplitude,
         CASE WHEN n_seats IS NOT NULL AND f IS NOT NULL THEN amplitude - f ELSE 0 END
           AS amplitude_shift, exp(coalesce(amplitude, 0)) AS amplitude_multiple
  FROM (SELECT DISTINCT ticker, session, replicate FROM readings) k
  LEFT JOIN analysts USING (ticker, session, replicate)
  LEFT JOIN debates USING (ticker, session, replicate)
  LEFT JOIN panels USING (ticker, session, replicate)
  LEFT JOIN forecasts USING (ticker, session, replicate))"""


def rounded(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}::DOUBLE, {digits}) + 0.0::DOUBLE AS {c}" for c in columns)


def forecasts(min_train: int = 80) -> str:
    """Expanding OLS: running sums of products, then Gaussian elimination one CTE per pivot."""
    terms = ["1.0::DOUBLE", "ln_rv_d", "ln_rv_w", "ln_rv_m", "amplitude", "y"]
    sums = ", ".join(f"sum({terms[i]} * {terms[j]}) OVER w AS a{i}_{j}"
                     for i in range(6) for j in range(i, 6))
    out = [FRAME, f"""
sums AS (
  SELECT position, ticker, session_date, stressed, y, ln_rv_d, ln_rv_w, ln_rv_m, amplitude,
         row_number() OVER (PARTITION BY ticker ORDER BY session_date) - 1 AS k, {sums}
  FROM frame WINDOW w AS (PARTITION BY ticker ORDER BY session_date
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ready AS (SELECT * FROM sums WHERE k >= {min_train})"""]
    for label, size in (("har", 4), ("text", 5)):
        rhs = 5
        cells = [(i, j) for i in range(size) for j in [*range(i, size), rhs]]
        out.append(f"{label}_0 AS (SELECT position, "
                   + ", ".join(f"a{i}_{j}" for i, j in cells) + " FROM ready)")
        for p in range(size - 1):
            changed = [f"a{i}_{j} - a{p}_{i} / a{p}_{p} * a{p}_{j} AS a{i}_{j}" if i > p
                       else f"a{i}_{j}" for i, j in cells]
            out.append(f"{label}_{p + 1} AS (SELECT position, " + ", ".join(changed)
                       + f" FROM {label}_{p})")
        last = f"{label}_{size - 1}"
        known: list[int] = []
        for p in range(size - 1, -1, -1):
            rest = "".join(f" - a{p}_{j} * x{j}" for j in known)
            name = f"{label}_x{p}"
            out.append(f"{name} AS (SELECT *, (a{p}_{rhs}{rest}) / a{p}_{p} AS x{p} FROM {last})")
            last, known = name, [*known, p]
        values = ["1.0", "ln_rv_d", "ln_rv_w", "ln_rv_m", "amplitude"][:size]
        dot = " + ".join(f"x{j} * {v}" for j, v in enumerate(values))
        out.append(f"p_{label} AS (SELECT position, {dot} AS p_{label} FROM {last} "
                   "JOIN ready USING (position))")
    out.append("""
ahead AS (
  SELECT session_date AS date, ticker, stressed, power(y - p_har, 2) AS e2_har,
         power(y - p_text, 2) AS e2_text, p_har, p_text
  FROM ready JOIN p_har USING (position) JOIN p_text USING (position)),
gains AS (SELECT *, e2_har - e2_text AS gain,
                 e2_har - e2_text + power(p_har - p_text, 2) AS f FROM ahead)""")
    return ",\n".join(out)


def tail(z: str) -> str:
    """P(Z > z) by Simpson's rule on 2 000 steps; the statements have no error function."""
    return (f"(SELECT 0.5 - ({z}) / 6000.0 * sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 "
            f"THEN 4 ELSE 2 END) * exp(-power(({z}) * i / 2000.0, 2) / 2)) / sqrt(2 * pi()) "
            "FROM range(2001) simpson(i))")


def chi2_tail(x: str, df: int) -> str:
    base = f"2 * {tail(f'sqrt({x})')}"
    return base if df == 1 else f"{base} + sqrt(2 * ({x}) / pi()) * exp(-({x}) / 2)"


def _inverse(name: str, source: str, size: str) -> str:
    """Gauss-Jordan on the relation (i, j, v) with i, j from 1: one recursion step per pivot."""
    return f"""
{name}_steps AS (
  SELECT 0 AS p, i, j, v FROM {source}
  UNION ALL SELECT 0, i, j + ({size}), CASE WHEN i = j THEN 1.0 ELSE 0.0 END FROM {source}
  UNION ALL
  SELECT p + 1, i, j, CASE WHEN i = p + 1 THEN v / piv ELSE v - below * beside / piv END
  FROM (SELECT p, i, j, v,
               max(v) FILTER (i = p + 1 AND j = p + 1) OVER () AS piv,
               max(v) FILTER (j = p + 1) OVER (PARTITION BY i) AS below,
               max(v) FILTER (i = p + 1) OVER (PARTITION BY j) AS beside FROM {name}_steps)
  WHERE p < ({size})),
{name} AS (SELECT i, j - ({size}) AS j, v FROM {name}_steps
           WHERE p = ({size}) AND j > ({size}))"""


def ols(tag: str, columns: list[str], source: str = "frame") -> str:
    """Least squares with a constant and one dummy per ticker but the first, all as relations."""
    k = len(columns)
    listed = ", ".join(f"({j + 2}, {c})" for j, c in enumerate(columns))
    return f"""
{tag}_f AS (SELECT *, row_number() OVER (ORDER BY position) AS t,
                   dense_rank() OVER (ORDER BY ticker) AS d FROM {source}),
{tag}_x AS (
  SELECT t, 1 AS j, 1.0::DOUBLE AS x FROM {tag}_f
  UNION ALL SELECT t, u.j, u.x FROM {tag}_f, LATERAL (VALUES {listed}) u(j, x)
  UNION ALL SELECT f.t, {k} + s.d, CASE WHEN f.d = s.d THEN 1.0 ELSE 0.0 END
  FROM {tag}_f f, (SELECT DISTINCT d FROM {tag}_f WHERE d > 1) s),
{tag}_gram AS (SELECT a.j AS i, b.j AS j, sum(a.x * b.x) AS v
               FROM {tag}_x a JOIN {tag}_x b USING (t) GROUP BY ALL),
{_inverse(f'{tag}_inv', f'{tag}_gram', f'SELECT max(i) FROM {tag}_gram')},
{tag}_xy AS (SELECT j, sum(x * y) AS v FROM {tag}_x JOIN {tag}_f USING (t) GROUP BY j),
{tag}_b AS (SELECT i AS j, sum(n.v * xy.v) AS b FROM {tag}_inv n JOIN {tag}_xy xy USING (j)
            GROUP BY i),
{tag}_e AS (
  SELECT t, any_value(position) AS position, any_value(y) - sum(x * b) AS e
  FROM {tag}_x JOIN {tag}_b USING (j) JOIN {tag}_f USING (t) GROUP BY t),
{tag}_r2 AS (
  SELECT 1 - (SELECT sum(e * e) FROM {tag}_e)
             / (SELECT var_pop(y) * count(*) FROM {tag}_f) AS r2,
         (SELECT count(*) FROM {tag}_f) AS n)"""


def hac(tag: str, lags: int = 5) -> str:
    """Newey-West covariance of the fit named `tag`, lag by lag."""
    return f"""
{tag}_g AS (SELECT t, j, x * e AS g FROM {tag}_x JOIN {tag}_e USING (t)),
{tag}_lagged AS (
  SELECT a.j AS i, b.j AS j, sum(a.g * b.g * (1 - l / {lags + 1}.0::DOUBLE)) AS v, l
  FROM range({lags + 1}) r(l), {tag}_g a JOIN {tag}_g b ON b.t = a.t - l GROUP BY ALL),
{tag}_s AS (
  SELECT i, j, sum(v) AS v FROM (
    SELECT i, j, v FROM {tag}_lagged UNION ALL
    SELECT j, i, v FROM {tag}_lagged WHERE l > 0) GROUP BY ALL),
{tag}_half AS (SELECT n.i, s.j, sum(n.v * s.v) AS v FROM {tag}_inv n JOIN {tag}_s s ON n.j = s.i
               GROUP BY ALL),
{tag}_v AS (SELECT h.i, n.j, sum(h.v * n.v) AS v FROM {tag}_half h JOIN {tag}_inv n ON h.j = n.i
            GROUP BY ALL)"""


def wald(tag: str, added: list[int]) -> str:
    """Chi-square that the slopes at the given design places are zero."""
    places = ", ".join(f"({n + 1}, {j})" for n, j in enumerate(added))
    return f"""
{tag}_pick AS (SELECT * FROM (VALUES {places}) u(n, j)),
{tag}_block AS (SELECT a.n AS i, b.n AS j, v FROM {tag}_v JOIN {tag}_pick a ON a.j = {tag}_v.i
                JOIN {tag}_pick b ON b.j = {tag}_v.j),
{_inverse(f'{tag}_binv', f'{tag}_block', str(len(added)))},
{tag}_chi2 AS (
  SELECT sum(x.b * m.v * z.b) AS chi2 FROM {tag}_binv m
  JOIN (SELECT n, b FROM {tag}_b JOIN {tag}_pick USING (j)) x ON x.n = m.i
  JOIN (SELECT n, b FROM {tag}_b JOIN {tag}_pick USING (j)) z ON z.n = m.j)"""


def nested(tag: str, base: list[str], full: list[str], source: str = "frame") -> str:
    added = [j + 2 for j, c in enumerate(full) if c not in base]
    return ",".join([ols(f"{tag}s", base, source), ols(f"{tag}b", full, source), hac(f"{tag}b"),
                     wald(f"{tag}b", added)])


def nested_row(tag: str, label: str, k: int) -> str:
    return f"""SELECT '{label}' AS contrast, {k} AS columns_added, round(s.r2, 4) AS r2_base,
  round(b.r2, 4) AS r2_full, round(b.r2 - s.r2, 4) AS r2_gain, round(chi2, 3) AS wald_chi2,
  round({chi2_tail('chi2', k)}, 4) AS p_hac, b.n AS n
FROM {tag}s_r2 s, {tag}b_r2 b, {tag}b_chi2"""
