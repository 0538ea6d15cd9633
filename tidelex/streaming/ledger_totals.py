"""Spend so far, kept up to date as ledger files arrive.

Each micro-batch reads only files it has not seen; the checkpoint remembers them and the running
sum, which is what a re-read of the whole ledger before every call would recompute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelex.sources.ledger import LEDGER_SCHEMA, LEGACY_COST_COLUMN, row_cost


def ledger_stream(spark: SparkSession, folder: str, legacy: bool = False) -> DataFrame:
    schema = LEDGER_SCHEMA.replace("cost_usd", LEGACY_COST_COLUMN) if legacy else LEDGER_SCHEMA
    return (spark.readStream.schema(schema).option("header", True).option("escape", '"')
            .option("recursiveFileLookup", True).csv(folder))


def running_total(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(F.sum(row_cost(rows)).alias("cost_usd"),
                                         F.count(F.lit(1)).alias("calls"))


def follow(totals: DataFrame, checkpoint: str, publish, once: bool = False) -> StreamingQuery:
    """Hand the updated totals of every micro-batch to `publish(frame, batch_id)`."""
    writer = (totals.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
              .foreachBatch(publish))
    return (writer.trigger(availableNow=True) if once else writer).start()
