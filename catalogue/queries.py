"""Each entry: a Spark query over the driver's tables and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogue import oracles as o, testbed as tb
from tidelex.functions import clock, fingerprint, text
from tidelex.operators import (
    align, digest, neardup, ordered, quota, regime, regress, rollup, sampling)
from tidelex.plans import committee
from tidelex.session import checkpointed, shared_folder
from tidelex.sources import answers, ledger as ledgers
from tidelex.streaming import ledger_totals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0)
                           for c in columns})


# -- documents to digests


@query("corpus_eligible", f"WITH {o.eligible()} SELECT ticker, session_date, doc_id, "
       "length(body) AS n_chars FROM eligible")
def corpus_eligible(spark, sf):
    docs = align.eligible_documents(tb.news(spark, sf), tb.sessions(spark, sf))
    return docs.select("ticker", "session_date", "doc_id",
                       F.length("body").cast("long").alias("n_chars"))


@query("corpus_overnight_lookback", f"WITH {o.eligible(72, 539, 59)} "
       "SELECT ticker, session_date, count(*) AS n_documents, "
       "CAST(sum(length(body)) AS BIGINT) AS n_chars FROM eligible GROUP BY ALL")
def corpus_overnight_lookback(spark, sf):
    """Three days back from the second before the opening."""
    docs = align.eligible_documents(tb.news(spark, sf), tb.sessions(spark, sf),
                                    origin=clock.OVERNIGHT_ORIGIN, lookback_days=3)
    return docs.groupBy("ticker", "session_date").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.sum(F.length("body")).cast("long").alias("n_chars"))


@query("corpus_min_length", f"WITH {o.NEWS} SELECT ticker, count(*) AS n_documents FROM news "
       "WHERE length(body) >= 200 GROUP BY ALL")
def corpus_min_length(spark, sf):
    return align.long_enough(tb.news(spark, sf)).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_documents"))


@query("trigram_counts", f"WITH grams AS (SELECT doc_id, {o.trigrams('text')} AS g "
       "FROM documents) SELECT doc_id, CAST(len(g) AS BIGINT) AS n_trigrams FROM grams")
def trigram_counts(spark, sf):
    return tb.table(spark, sf, "documents").select(
        "doc_id", F.size(text.trigrams(text.words(F.col("text")))).cast("long")
        .alias("n_trigrams"))


@query("overlap_with_next", f"""
WITH grams AS (SELECT doc_id, {o.trigrams('text')} AS g FROM documents)
SELECT a.doc_id, round(len(list_intersect(a.g, b.g))::DOUBLE
       / greatest(1, least(len(a.g), len(b.g))), 9) AS overlap
FROM grams a JOIN grams b ON b.doc_id = a.doc_id + 1""")
def overlap_with_next(spark, sf):
    """Overlap coefficient of each document with the next one."""
    grams = tb.table(spark, sf, "documents").select(
        "doc_id", text.trigrams(text.words(F.col("text"))).alias("g"))
    following = grams.select((F.col("doc_id") - 1).alias("doc_id"), F.col("g").alias("h"))
    return grams.join(following, "doc_id").select(
        "doc_id", F.round(text.overlap(F.col("g"), F.col("h")), 9).alias("overlap"))


@query("dedup_units", f"WITH {o.eligible()}, {o.kept('eligible', 'ticker, session_date')} "
       "SELECT ticker, session_date, doc_id, n_documents FROM kept")
def dedup_units(spark, sf):
    docs = align.eligible_documents(tb.news(spark, sf), tb.sessions(spark, sf))
    return neardup.keep_first(docs).select("ticker", "session_date", "doc_id", "n_documents")


_BY_SOURCE = (f"WITH {o.NEWS}, long AS (SELECT * FROM news WHERE length(body) >= 200), "
              f"{o.kept('long', 'source')} SELECT source, doc_id, n_documents FROM kept")


def _by_source(spark, sf, **settings):
    docs = align.long_enough(tb.news(spark, sf))
    return neardup.keep_first(docs, unit=["source"], **settings).select(
        "source", "doc_id", "n_documents")


@query("dedup_sources", _BY_SOURCE)
def dedup_sources(spark, sf):
    """Units that grow with the corpus: all documents of a source."""
    return _by_source(spark, sf)


@query("dedup_sources_across_tasks", _BY_SOURCE)
def dedup_sources_across_tasks(spark, sf):
    """The same with every unit resolved across tasks."""
    return _by_source(spark, sf, max_unit_chars=0)


def _digests(spark, sf):
    sessions = tb.sessions(spark, sf)
    kept = neardup.keep_first(align.eligible_documents(tb.news(spark, sf), sessions))
    return kept, sessions


_BLOCKS = f"""WITH {o.eligible()}, {o.kept('eligible', 'ticker, session_date')},
headed AS (
  SELECT e.*, k.n_documents,
         'Instrument: ' || ticker || chr(10) || 'Session: '
           || strftime(session_date, '%Y-%m-%d') || chr(10) AS header
  FROM eligible e JOIN kept k USING (ticker, session_date, doc_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY ticker, session_date
                               ORDER BY published_utc DESC, doc_id DESC) AS rank,
         11999 - length(header) AS budget FROM headed),
framed AS (
  SELECT *, '[DOCUMENT ' || rank || ']' || chr(10) || 'Source: ' || source || chr(10)
      || 'Published: ' || strftime(published_utc, '%Y-%m-%dT%H:%M:%S') || '+00:00' || chr(10)
      || 'Title: ' || title || chr(10) || chr(10) AS preamble FROM ranked),
roomed AS (
  SELECT *, greatest(0, budget - length(preamble) - 59) AS room,
         rank = 1 AND length(preamble) + length(body) + 1 > budget AS too_long FROM framed),
cut AS (
  SELECT *, substr(body, 1, room) AS head,
         length(substr(body, 1, room)) - instr(reverse(substr(body, 1, room)), chr(10) || chr(10))
           - 1 AS at_break,
         instr(reverse(substr(body, 1, room)), chr(10) || chr(10)) > 0 AS has_break FROM roomed),
blocks AS (
  SELECT *, CASE WHEN NOT too_long THEN preamble || body || chr(10)
    ELSE preamble || CASE WHEN has_break AND at_break > room * 0.6
           THEN substr(head, 1, at_break) ELSE head END
      || chr(10) || chr(10) || '[...] Document truncated: only the beginning is provided.'
    END AS block FROM cut),
used AS (
  SELECT *, sum(length(block)) OVER (PARTITION BY ticker, session_date ORDER BY rank
                                     ROWS UNBOUNDED PRECEDING) AS used FROM blocks),
chosen AS (SELECT * FROM used WHERE rank = 1 OR used <= budget),
texts AS (
  SELECT ticker, session_date, max(n_documents) AS n_documents,
         any_value(header) || chr(10) || string_agg(block, chr(10) ORDER BY rank DESC) AS digest
  FROM chosen GROUP BY ALL),
digests AS (
  SELECT s.ticker, s.session_date, coalesce(n_documents, 0) AS n_documents,
         coalesce(digest, 'Instrument: ' || s.ticker || chr(10) || 'Session: '
           || strftime(s.session_date, '%Y-%m-%d') || chr(10)) AS digest
  FROM sessions s LEFT JOIN texts t USING (ticker, session_date))"""


@query("digest_blocks", _BLOCKS + " SELECT ticker, session_date, doc_id, CAST(rank AS BIGINT) AS "
       "rank, CAST(length(block) AS BIGINT) AS size FROM chosen")
def digest_blocks(spark, sf):
    kept, _ = _digests(spark, sf)
    return digest.select_blocks(kept).select(
        "ticker", "session_date", "doc_id", F.col("rank").cast("long").alias("rank"),
        F.col("size").cast("long").alias("size"))


@query("digest_units", _BLOCKS + " SELECT ticker, session_date, n_documents, digest, "
       "sha256(digest) AS digest_sha256 FROM digests")
def digest_units(spark, sf):
    kept, sessions = _digests(spark, sf)
    return digest.build_digests(kept, sessions)


# -- sessions, regimes, sampling


@query("sessions_bounds", f"WITH {o.PANEL} SELECT DISTINCT ticker, session_date FROM panel "
       "WHERE session_date BETWEEN DATE '1994-03-01' AND DATE '1996-06-30'")
def sessions_bounds(spark, sf):
    return sampling.sessions_between(tb.panel(spark, sf), "1994-03-01", "1996-06-30")


@query("stride_sample", f"""WITH {o.PANEL},
numbered AS (SELECT ticker, session_date,
    row_number() OVER (PARTITION BY ticker ORDER BY session_date) - 1 AS k,
    count(*) OVER (PARTITION BY ticker) AS n FROM panel)
SELECT ticker, session_date FROM numbered
JOIN range(40) r(i) ON k = least(n - 1, CAST(floor(i * (n::DOUBLE / 40)) AS BIGINT))""")
def stride_sample(spark, sf):
    return sampling.stride_sample(sampling.sessions_between(tb.panel(spark, sf)), 40)


@query("regime_trailing_vol", f"WITH {o.LABELLED} SELECT ticker, session_date, "
       f"{o.rounded(['trailing_vol'])} FROM measured")
def regime_trailing_vol(spark, sf):
    vols = regime.trailing_volatility(tb.panel(spark, sf))
    return rounded(vols.select("ticker", "session_date", "trailing_vol"), ["trailing_vol"])


@query("regime_labels", f"WITH {o.LABELLED} SELECT ticker, session_date, regime, stressed "
       "FROM labelled")
def regime_labels(spark, sf):
    return regime.classify_panel(tb.panel(spark, sf)).select(
        "ticker", "session_date", "regime", "stressed")


@query("regime_crosstab", f"WITH {o.FRAME} SELECT ticker, count_if(stressed = 0) AS calm, "
       "count_if(stressed = 1) AS stressed FROM frame GROUP BY ALL")
def regime_crosstab(spark, sf):
    return regime.regime_crosstab(_frame(spark, sf))


@query("stress_quantile", f"WITH {o.LABELLED} SELECT ticker, "
       "round(quantile_cont(trailing_vol, 2.0::DOUBLE / 3), 6) AS stress_cut "
       "FROM measured GROUP BY ALL HAVING count(trailing_vol) > 0")
def stress_quantile(spark, sf):
    vols = regime.trailing_volatility(tb.panel(spark, sf))
    return rounded(ordered.exact_quantile(vols, ["ticker"], "trailing_vol",
                                          regime.STRESS_QUANTILE, "stress_cut"), ["stress_cut"])


_DRAWN = f"""WITH {o.LABELLED},
marked AS (
  SELECT ticker, session_date, trailing_vol, stressed, year(session_date) AS year,
         sha256('20260808|' || ticker || '|' || strftime(session_date, '%Y-%m-%d')) AS draw_key
  FROM labelled WHERE stressed IS NOT NULL),
years AS (SELECT ticker, count(DISTINCT year) AS n_years FROM marked GROUP BY ALL),
ranked AS (
  SELECT m.*, greatest(1, 50 // n_years) AS quota,
         row_number() OVER (PARTITION BY ticker, stressed, year ORDER BY draw_key) AS rank
  FROM marked m JOIN years USING (ticker)),
short AS (
  SELECT ticker, stressed, 50 - count_if(rank <= quota) AS short FROM ranked GROUP BY ALL),
spares AS (
  SELECT *, row_number() OVER (PARTITION BY ticker, stressed ORDER BY draw_key) AS spare
  FROM ranked WHERE rank > quota),
sample AS (
  SELECT ticker, session_date, trailing_vol, stressed FROM ranked WHERE rank <= quota
  UNION ALL
  SELECT ticker, session_date, trailing_vol, s.stressed FROM spares s
  JOIN short USING (ticker, stressed) WHERE spare <= short)"""


def _sample(spark, sf):
    return sampling.draw(tb.panel(spark, sf), 100)


@query("sample_draw", _DRAWN + f" SELECT ticker, session_date, stressed, "
       f"{o.rounded(['trailing_vol'])} FROM sample")
def sample_draw(spark, sf):
    return rounded(_sample(spark, sf), ["trailing_vol"])


@query("sample_table", _DRAWN + " SELECT ticker, year(session_date)::INTEGER AS year, "
       "count(*) AS sessions, CAST(sum(stressed) AS BIGINT) AS stressed FROM sample GROUP BY ALL")
def sample_table(spark, sf):
    return sampling.sample_table(_sample(spark, sf))


@query("frame_fingerprint", _DRAWN + " SELECT sha256(string_agg(ticker || '|' || "
       "strftime(session_date, '%Y-%m-%d'), chr(10) ORDER BY ticker || '|' || "
       "strftime(session_date, '%Y-%m-%d'))) AS sha256, count(*) AS n FROM sample")
def frame_fingerprint(spark, sf):
    return sampling.fingerprint(_sample(spark, sf))


def _tree(levels: int) -> str:
    steps, last = [], "nodes"
    for n in range(levels, 0, -1):
        steps.append(f"level{n} AS (SELECT substr(own, 1, {n}) AS own, sha256(string_agg(h, chr(10) "
                     f"ORDER BY own, h)) AS h, sum(n) AS n FROM {last} GROUP BY substr(own, 1, {n}))")
        last = f"level{n}"
    return ", ".join(steps) + (f" SELECT sha256(string_agg(h, chr(10) ORDER BY own, h)) AS sha256, "
                               f"CAST(sum(n) AS BIGINT) AS n FROM {last}")


@query("frame_tree_fingerprint", """WITH days AS (
  SELECT 'u' || user_id AS ticker, ts::DATE AS d, count(*) AS n FROM events GROUP BY ALL),
years AS (SELECT ticker, year(d) AS y, sum(n) AS n, sha256(string_agg(
  strftime(d, '%Y-%m-%d') || '|' || n, chr(10) ORDER BY d)) AS h FROM days GROUP BY ALL),
nodes AS (SELECT sha256(ticker) AS own, sha256(sha256(ticker) || '|' || sha256(string_agg(
  h, chr(10) ORDER BY y))) AS h, sum(n) AS n FROM years GROUP BY ticker), """ + _tree(4))
def frame_tree_fingerprint(spark, sf):
    """The name of a frame of any size: every user's event days, in a tree of bounded nodes."""
    frame = tb.table(spark, sf, "events").select(
        F.concat(F.lit("u"), "user_id").alias("ticker"), F.to_date("ts").alias("session_date"))
    return sampling.tree_fingerprint(frame)


# -- readings to signals


_KEY = "ticker, session, replicate, "


def _measures(spark, sf, function, fields):
    return rounded(function(tb.readings(spark, sf)), list(fields))


@query("agg_analysts", f"WITH {o.READINGS}, {o.ANALYSTS} SELECT {_KEY}"
       f"{o.rounded(list(rollup.ANALYST_FIELDS))} FROM analysts")
def agg_analysts(spark, sf):
    return _measures(spark, sf, rollup.aggregate_analysts, rollup.ANALYST_FIELDS)


@query("agg_debate", f"WITH {o.READINGS}, {o.DEBATES} SELECT {_KEY}"
       f"{o.rounded(list(rollup.DEBATE_FIELDS))} FROM debates")
def agg_debate(spark, sf):
    return _measures(spark, sf, rollup.aggregate_debate, rollup.DEBATE_FIELDS)


@query("agg_panel", f"WITH {o.READINGS}, {o.PANELS} SELECT {_KEY}"
       f"{o.rounded(list(rollup.PANEL_FIELDS))} FROM panels")
def agg_panel(spark, sf):
    return _measures(spark, sf, rollup.aggregate_panel, rollup.PANEL_FIELDS)


@query("agg_unit", f"WITH {o.MEASURED} SELECT {_KEY}{o.rounded(list(rollup.UNIT_FIELDS))} "
       "FROM measured")
def agg_unit(spark, sf):
    return _measures(spark, sf, rollup.aggregate_units, rollup.UNIT_FIELDS)


@query("agg_single", f"""WITH {o.READINGS}, controls AS (
SELECT ticker, session, replicate, polarity * intensity AS tone, ambiguity, 0 AS analyst_spread,
       shock_kind IN ('macro_policy','geopolitical','sector_wide') AS exogeneity,
       is_new_information AS novelty, 1 AS n_analysts, 0 AS mandate_gap,
       0 AS signed_cancellation, 0 AS conviction_gap, 0 AS debate_complete,
       log_amplitude AS amplitude, 0 AS panel_dispersion, 1 AS measured_confidence,
       0 AS interval_width, 0 AS n_seats, log_amplitude AS forecast_amplitude,
       0 AS amplitude_shift, exp(log_amplitude) AS amplitude_multiple
FROM readings WHERE seat = 'analyst_fundamentals')
SELECT {_KEY}{o.rounded(list(rollup.UNIT_FIELDS))} FROM controls""")
def agg_single(spark, sf):
    return rounded(rollup.aggregate_singles(tb.singles(spark, sf)), list(rollup.UNIT_FIELDS))


_EMPTY = ", ".join(
    "1.0::DOUBLE AS amplitude_multiple" if f == "amplitude_multiple" else f"0.0::DOUBLE AS {f}"
    for f in rollup.UNIT_FIELDS)


@query("empty_units", f"WITH {o.eligible(min_chars=6000)} SELECT s.ticker, s.session_date, {_EMPTY} "
       "FROM sessions s ANTI JOIN eligible e USING (ticker, session_date)")
def empty_units(spark, sf):
    """Sessions without a document of 6 000 characters, as the zero row they contribute."""
    sessions = tb.sessions(spark, sf)
    read = align.eligible_documents(tb.news(spark, sf), sessions, min_chars=6000)
    silent = sessions.join(read, align.UNIT, "left_anti")
    none = rollup.aggregate_units(tb.readings(spark, sf).where(F.lit(False)))
    return rollup.fill_empty_units(
        silent, none.withColumn("session_date", F.to_date("session"))
        .drop("session", "replicate"), align.UNIT)


@query("unit_replicates", f"WITH {o.NEWS} SELECT ticker, session_date, "
       "CAST(r AS INTEGER) AS replicate FROM sessions, range(3) t(r)")
def unit_replicates(spark, sf):
    return committee.with_replicates(tb.sessions(spark, sf), 3)


def _raw(spark, sf):
    return rollup.fill_empty_units(
        tb.units(spark, sf), rollup.aggregate_units(tb.readings(spark, sf)))


_RAW = (f"WITH {o.UNITS}, {o.MEASURED}, raw AS (SELECT u.*, "
        + ", ".join(f"coalesce(m.{f}, {1 if f == 'amplitude_multiple' else 0}) AS {f}"
                    for f in rollup.UNIT_FIELDS)
        + " FROM units u LEFT JOIN measured m USING (ticker, session, replicate))")


@query("combine_replicates", _RAW + f""", combined AS (
SELECT ticker, session, first(has_document) AS has_document,
       first(n_documents) AS n_documents, count(*) AS replicates_used,
       CAST(sum(calls) AS BIGINT) AS calls, sum(cost_usd) AS cost_usd,
       {', '.join(f'median({f}) AS {f}' for f in rollup.MEDIAN_FIELDS)}
FROM raw WHERE n_failures = 0 GROUP BY ticker, session HAVING count(*) = 3)
SELECT ticker, session, has_document, n_documents, replicates_used, calls,
       {o.rounded(['cost_usd'], 9)}, {o.rounded(list(rollup.MEDIAN_FIELDS))} FROM combined""")
def combine_replicates(spark, sf):
    combined = rounded(rollup.combine_replicates(_raw(spark, sf), 3), ["cost_usd"], 9)
    return rounded(combined, list(rollup.MEDIAN_FIELDS))


@query("dropped_units", f"""WITH {o.UNITS}
SELECT ticker, session, count(replicate) AS replicates,
       CAST(sum(n_failures) AS BIGINT) AS failures, first(n_documents) AS documents
FROM units GROUP BY ticker, session
HAVING count(replicate) <> 3 OR sum(n_failures) > 0""")
def dropped_units(spark, sf):
    return rollup.dropped_units(tb.units(spark, sf), 3)


# -- accounting


_KEYS = """keyed AS (
SELECT doc_id, CAST(r AS INTEGER) AS replicate,
       sha256('model-a|analyst_fundamentals|' || sha256(source) || '|' || r || '|0.0000|'
              || sha256(text)) AS cache_key FROM documents, range(3) t(r))"""


def _keyed(spark, sf):
    docs = committee.with_replicates(tb.table(spark, sf, "documents"), 3)
    return docs.select("doc_id", "replicate", fingerprint.cache_key(
        "model-a", F.lit("analyst_fundamentals"), F.sha2("source", 256), F.col("replicate"), 0.0,
        F.sha2("text", 256)).alias("cache_key"))


@query("cache_keys", f"WITH {_KEYS} SELECT doc_id, replicate, cache_key FROM keyed")
def cache_keys(spark, sf):
    return _keyed(spark, sf)


@query("cache_to_pay", f"""WITH {_KEYS},
cached AS (SELECT DISTINCT cache_key FROM keyed WHERE doc_id % 3 = 0)
SELECT k.doc_id, k.replicate FROM keyed k ANTI JOIN cached c USING (cache_key)""")
def cache_to_pay(spark, sf):
    """Requests whose key is not among the stored answers."""
    requests = _keyed(spark, sf)
    stored = requests.where("doc_id % 3 = 0").select("cache_key")
    return answers.to_pay(requests, stored).select("doc_id", "replicate")


_TOTALS = f"""WITH {o.LEDGER}
SELECT event_type, count(*) AS calls, CAST(sum(coalesce(
  TRY_CAST(CASE WHEN cost_usd <> '' THEN cost_usd ELSE cout_usd END AS DOUBLE), 0)) AS DOUBLE)
  AS cost_usd FROM ledger GROUP BY ALL"""


@query("ledger_total", _TOTALS)
def ledger_total(spark, sf):
    rows = tb.ledger(spark, sf)
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(ledgers.row_cost(rows)).alias("cost_usd"))


@query("ledger_stream_total", _TOTALS)
def ledger_stream_total(spark, sf):
    """The same totals kept by a streaming query that reads each file once."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"

    def publish(frame, _):
        frame.write.mode("overwrite").parquet(f"{folder}/totals")

    totals = ledger_totals.running_total(tb.ledger_stream(spark, sf), ["event_type"])
    ledger_totals.follow(totals, f"{folder}/progress", publish, once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/totals")


@query("rate_window", f"""WITH {o.LEDGER}, timed AS (
SELECT CAST(epoch_us(stamp) // 1000000 AS BIGINT) AS second, tokens FROM ledger),
seconds AS (SELECT second, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS requests
            FROM timed GROUP BY second)
SELECT second, tokens, requests, CAST(sum(tokens) OVER w AS BIGINT) AS tokens_in_window,
       CAST(sum(requests) OVER w AS BIGINT) AS requests_in_window FROM seconds
WINDOW w AS (ORDER BY second RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)""")
def rate_window(spark, sf):
    return quota.rate_window(tb.ledger(spark, sf), F.col("stamp"), F.col("tokens"))


@query("rate_audit", f"""WITH {o.LEDGER}, timed AS (
SELECT CAST(epoch_us(stamp) // 1000000 AS BIGINT) AS second, tokens FROM ledger),
seconds AS (SELECT second, sum(tokens) AS tokens, count(*) AS requests FROM timed
            GROUP BY second),
windowed AS (SELECT second, sum(tokens) OVER w AS t, sum(requests) OVER w AS r FROM seconds
WINDOW w AS (ORDER BY second RANGE BETWEEN 60 PRECEDING AND CURRENT ROW))
SELECT second, round(t / 4500.0::DOUBLE, 6) AS token_utilisation, t > 4500 OR r > 2.7 AS over
FROM windowed""")
def rate_audit(spark, sf):
    audit = quota.rate_audit(tb.ledger(spark, sf), F.col("stamp"), F.col("tokens"),
                             tokens_per_minute=5000, requests_per_minute=3)
    return rounded(audit.select("second", "token_utilisation", "over"), ["token_utilisation"])


@query("budget_prefix", f"""WITH {o.LEDGER}, priced AS (
SELECT event_id, mandate, tokens, CAST(sum(tokens) OVER (ORDER BY mandate, event_id
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS committed FROM ledger)
SELECT event_id, committed, committed + 100 <= 120 * 10000 AS admitted FROM priced""")
def budget_prefix(spark, sf):
    """Calls admitted, in order, under a cap of 120 (estimates here in ten-thousandths)."""
    calls = tb.ledger(spark, sf).withColumn("estimate", F.col("tokens") / F.lit(10000.0))
    admitted = quota.admit_within_budget(calls, "estimate", 0.01, 500.0, "mandate", ["event_id"],
                                         F.floor(F.col("event_id") / 4096))
    return admitted.select("event_id", F.round(F.col("committed") * 10000).cast("long")
                           .alias("committed"), "admitted")


@query("call_costs", """SELECT conv_id, turn,
round(length(text)::DOUBLE / 1e6 * 0.30 + 120::DOUBLE / 1e6 * 1.20, 9) AS cost_usd,
round((length(text) + 1500)::DOUBLE / 3.0 / 1e6 * 0.30 + 900::DOUBLE / 1e6 * 1.20, 9)
  AS cost_estimate,
round((length(text) + 1500)::DOUBLE / 3.0 + 900, 6) AS token_estimate FROM conversations""")
def call_costs(spark, sf):
    chars = F.length("text").cast("double")
    return tb.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.round(fingerprint.call_cost(chars, F.lit(120.0)), 9)
        .alias("cost_usd"),
        F.round(fingerprint.cost_estimate(chars, F.lit(1500.0)), 9).alias("cost_estimate"),
        F.round(fingerprint.token_estimate(chars, F.lit(1500.0)), 6).alias("token_estimate"))


# -- the verdict


def _frame(spark, sf):
    cells = checkpointed(tb.cells(spark, sf))
    return regress.build_frame(tb.signals_of(cells), tb.panel_of(cells))


@query("signals_panel_join", f"WITH {o.FRAME} SELECT CAST(position AS BIGINT) AS position, "
       "ticker, session_date, stressed, "
       f"{o.rounded(['tone', 'ambiguity', 'amplitude', 'y', 'ln_rv_d', 'ln_rv_w', 'ln_rv_m'])} "
       "FROM frame")
def signals_panel_join(spark, sf):
    columns = ["tone", "ambiguity", "amplitude", "y", *regress.HAR]
    return rounded(_frame(spark, sf).select("position", "ticker", "session_date", "stressed",
                                            *columns), columns)


@query("interactions", f"WITH {o.FRAME} SELECT ticker, session_date, "
       f"{o.rounded([c + '_x_stressed' for c in regress.TEXT])} FROM frame")
def interactions(spark, sf):
    crossed = [f"{c}_x_stressed" for c in regress.TEXT]
    return rounded(regress.with_interactions(_frame(spark, sf)).select(
        "ticker", "session_date", *crossed), crossed)


from catalogue import reading_queries, verdict_queries  # noqa: E402,F401  (they register more)
