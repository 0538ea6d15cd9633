"""The ledger of calls: CSV folders that are only added, summed over the current set and prior ones."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidelex.sources.tables import exists

# The ledger's columns in order, and the cost column of older ledgers.
LEDGER_COLUMNS = (
    "timestamp_utc", "event", "ticker", "session", "mandate", "replicate", "attempt",
    "model_requested", "model_returned", "mandate_sha256", "context_sha256", "cache_key",
    "structure_mode", "tokens_in", "tokens_in_cached", "tokens_out", "latency_ms", "cost_usd",
    "status", "parse_ok", "error",
)
LEGACY_COST_COLUMN = "cout_usd"
LEDGER_SCHEMA = ", ".join(f"{name} string" for name in LEDGER_COLUMNS)


def append_ledger(rows: DataFrame, path: str, name: str | None = None) -> None:
    """Add rows under the ledger's columns; absent ones stay empty, cost has eight decimals.

    Rows go to a folder of their own. The same name written again replaces it, so a commit may be
    repeated without counting a call twice.
    """
    cost = F.format_string("%.8f", F.col("cost_usd").cast("double"))
    columns = [
        (cost if name == "cost_usd" else F.col(name).cast("string")).alias(name)
        if name in rows.columns else F.lit("").alias(name) for name in LEDGER_COLUMNS]
    rows.select(*columns).write.mode("overwrite").csv(
        f"{path}/{name or uuid.uuid4().hex}", header=True, escape='"')


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, whatever the file's header holds."""
    return spark.read.csv(path, header=True, escape='"', multiLine=True,
                          recursiveFileLookup=True)


def row_cost(rows: DataFrame) -> Column:
    """Cost of a row: the current column, else the legacy one, else 0; unreadable is 0."""
    named = [F.when(F.col(c) != "", F.col(c)) for c in ("cost_usd", LEGACY_COST_COLUMN)
             if c in rows.columns]
    if not named:
        return F.lit(0.0)
    return F.coalesce(F.coalesce(*named).try_cast("double"), F.lit(0.0))


def total_cost(spark: SparkSession, current: str, prior: tuple[str, ...] = ()) -> float:
    """Everything ever billed; the current ledger is not counted again among the prior ones."""
    total = 0.0
    for path in dict.fromkeys([current, *prior]):
        if exists(spark, path):
            rows = read_ledger(spark, path)
            total += rows.agg(F.sum(row_cost(rows))).first()[0] or 0.0
    return total
