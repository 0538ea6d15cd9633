"""Views that give the driver's tables the shape of news, sessions, prices and readings.

Everything is derived from whole tables by exact integer arithmetic, so DuckDB can state the same
views, and the number of tickers grows with the tables: units keep their size at any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidelex.session import checkpointed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as dated news: 3 tickers per 1 000 documents, 30 days."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.expr("concat('T', doc_id % 3, '-', doc_id div 1000)").alias("ticker"),
        F.expr("timestamp_seconds(1704067200 + (doc_id * 7919) % 2592000)")
        .alias("published_utc"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("body"),
        F.col("source"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """31 daily sessions for every ticker of `news`."""
    tickers = table(spark, sf_dir, "documents").select(
        F.expr("concat('T', doc_id % 3, '-', doc_id div 1000)").alias("ticker")).distinct()
    return tickers.select(
        "ticker", F.explode(F.expr("sequence(DATE'2024-01-01', DATE'2024-01-31')"))
        .alias("session_date"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem by supplier group and week: prices of a week, and the integer sums from which text
    columns are made.

    A week opens at the lowest unit price of its first day and closes at the highest of its last.
    Days come first, so that every aggregate is over numbers and combined before the shuffle.
    """
    price = F.col("l_extendedprice") / F.col("l_quantity")
    days = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.expr("l_suppkey div 20").alias("desk"),
                 F.col("l_shipdate").cast("date").alias("day"))
        .agg(F.max(price).alias("high"), F.min(price).alias("low"),
             F.count(F.lit(1)).alias("n"),
             F.sum(F.floor(F.col("l_discount") * 100 + 0.5)).alias("discounts"),
             F.sum(F.floor(F.col("l_tax") * 100 + 0.5)).alias("taxes"),
             F.sum(F.col("l_quantity").cast("long")).alias("quantities")))
    week = F.date_trunc("week", "day").cast("date").alias("session_date")
    return days.groupBy(F.concat(F.lit("S"), "desk").alias("ticker"), week).agg(
        F.min_by("low", "day").alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("high", "day").alias("close"),
        *[F.sum(c).alias(c) for c in ("n", "discounts", "taxes", "quantities")])


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_of(cells(spark, sf_dir))


def panel_of(weekly: DataFrame) -> DataFrame:
    """Garman-Klass variance per cell and its HAR components; 357 weeks per ticker."""
    high_low = F.log(F.col("high") / F.col("low"))
    close_open = F.log(F.col("close") / F.col("open"))
    rv = F.lit(0.5) * high_low * high_low - F.lit(0.3862943611198906) * close_open * close_open
    weeks = Window.partitionBy("ticker").orderBy("session_date")
    # The engine expects a stored price table: cut here, lineitem is scanned once per query.
    return checkpointed(
        weekly.select("ticker", "session_date", F.nullif(rv, F.lit(0.0)).alias("rv_gk"))
        .select("ticker", "session_date", F.lead(F.log("rv_gk")).over(weeks).alias("y"),
                F.log("rv_gk").alias("ln_rv_d"),
                F.log(F.avg("rv_gk").over(weeks.rowsBetween(-4, 0))).alias("ln_rv_w"),
                F.log(F.avg("rv_gk").over(weeks.rowsBetween(-21, 0))).alias("ln_rv_m"), "rv_gk"))


def signals_of(weekly: DataFrame) -> DataFrame:
    """Text columns per cell, from exact integer sums."""
    return weekly.select(
        "ticker", F.date_format("session_date", "yyyy-MM-dd").alias("session"),
        (F.col("discounts") / F.col("n") / 5.0 - 1.0).alias("tone"),
        (F.col("taxes") / F.col("n") / 8.0).alias("ambiguity"),
        ((F.col("quantities") / F.col("n") - 25.0) / 10.0).alias("amplitude"))


def _unit_columns() -> list:
    return [F.expr("concat('K', doc_id % 20, '-', doc_id div 40000)").alias("ticker"),
            F.expr("date_format(date_add(DATE'2015-01-01', cast((doc_id div 20) % 2000 as int)), "
                   "'yyyy-MM-dd')").alias("session")]


KINDS = ["macro_policy", "geopolitical", "sector_wide", "issuer_governance", "issuer_results",
         "issuer_capital", "none"]


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine typed readings per document and replicate, a few missing, from integer arithmetic."""
    def v(salt: int) -> str:
        return (f"((doc_id * 31 + seat_no * 17 + replicate * 7 + {salt * 13} + n_chars) % 101 "
                "/ 100.0D)")

    seats = ("array('analyst_fundamentals','analyst_exogeneity_v2','analyst_tone','supportive',"
             "'adverse','forecaster','extreme','central','conservative')")
    kinds = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    long = (
        table(spark, sf_dir, "documents")
        .select("doc_id", "n_chars", *_unit_columns(),
                F.explode(F.expr("sequence(0, 2)")).alias("replicate"))
        .select("*", F.explode(F.expr("sequence(0, 8)")).alias("seat_no"))
        .where("(doc_id + seat_no * 3 + replicate) % 37 <> 0"))
    level = f"(-1.6D + 4.6D * {v(7)})"
    return long.select(
        "ticker", "session", "replicate",
        F.expr("case when seat_no < 3 then 'analyst' when seat_no < 5 then 'debate' "
               "when seat_no = 5 then 'forecast' else 'panel' end").alias("tier"),
        F.expr(f"{seats}[seat_no]").alias("seat"),
        F.expr(f"case when doc_id % 11 = 0 then 0.0D else {v(1)} end").alias("relevance"),
        F.expr(f"2.0D * {v(2)} - 1.0D").alias("polarity"), F.expr(v(3)).alias("intensity"),
        F.expr(v(4)).alias("ambiguity"), F.expr(f"{v(5)} >= 0.5D").alias("is_new_information"),
        F.expr(f"{kinds}[cast((doc_id + seat_no + replicate) % 7 as int)]").alias("shock_kind"),
        F.expr(v(6)).alias("conviction"), F.expr(level).alias("log_amplitude"),
        F.expr(f"greatest(-1.6D, {level} - 0.3D * {v(8)})").alias("lower"),
        F.expr(f"least(3.0D, {level} + 0.3D * {v(9)})").alias("upper"))


def singles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control's reading of each unit: the first analyst's fields and a level."""
    return (readings(spark, sf_dir).where("seat = 'analyst_fundamentals'")
            .withColumn("tier", F.lit("single")).withColumn("seat", F.lit("single_reader")))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounting of each (ticker, session, replicate); some replicates are absent."""
    missing = " + ".join(
        f"cast((doc_id + {seat * 3} + replicate) % 37 = 0 as int)" for seat in range(9))
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "n_chars", *_unit_columns(),
                F.explode(F.expr("sequence(0, 2)")).alias("replicate"))
        .where("NOT (doc_id % 23 = 5 AND replicate = 2)")
        .select("ticker", "session", "replicate", F.lit(True).alias("has_document"),
                F.expr("1 + doc_id % 4").alias("n_documents"),
                F.expr("9 - doc_id % 3").alias("calls"),
                F.expr("n_chars / 1e6D * 0.3D").alias("cost_usd"),
                F.expr(missing).cast("long").alias("n_failures")))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ledger rows: text costs, a legacy cost column, and an unparsable cost."""
    return as_ledger(table(spark, sf_dir, "events"))


def ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return as_ledger(files.parquet(sf_dir))


def as_ledger(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.expr("cast(ts as timestamp)").alias("stamp"), "event_type",
        F.expr("concat('m', user_id % 50)").alias("mandate"),
        F.expr("cast(round(value * 100) as bigint)").alias("tokens"),
        F.expr("case when event_type = 'error' then '' when event_id % 97 = 0 then 'n/a' "
               "else cast(cast(round(value * 100) as bigint) as string) end").alias("cost_usd"),
        F.expr("case when event_type = 'error' then cast(cast(round(value * 100) as bigint) as "
               "string) end").alias("cout_usd"))
