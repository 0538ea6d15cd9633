"""Result tables of a campaign: raw readings, signals and dropped units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidelex.operators.rollup import combine_replicates, dropped_units
from tidelex.sources.tables import union_existing


def load_signals(spark: SparkSession, folder: str, tags: list[str]) -> DataFrame:
    """The signals of several tags, with `tag_order` remembering the order they were named in."""
    found = union_existing(spark, [f"{folder}/signals_{tag}.parquet" for tag in tags], "signals")
    frames = [frame.withColumn("tag_order", F.lit(at)) for at, frame in found]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def save_results(rows: DataFrame, folder: str, tag: str, k_required: int) -> bool:
    """Write raw, signals and, if there are any, dropped units. Nothing is written when empty."""
    if rows.isEmpty():
        return False
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{folder}/raw_{tag}.parquet")
    stored = spark.read.parquet(f"{folder}/raw_{tag}.parquet")
    (combine_replicates(stored, k_required).orderBy("ticker", "session")
     .write.mode("overwrite").parquet(f"{folder}/signals_{tag}.parquet"))
    dropped = dropped_units(stored, k_required)
    if not dropped.isEmpty():
        dropped.write.mode("overwrite").csv(f"{folder}/dropped_{tag}.csv", header=True)
    return True


def order_report(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """One row on the order of a stored table: rows, files, rows that come before the one above them in
    their file, and files whose keys begin before those of the file above end. Without any, reading the
    files by their first keys gives the whole table in order.
    """
    key = F.struct(*keys)
    placed = spark.read.parquet(path).select(
        key.alias("key"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.row_index").alias("at"))
    steps = placed.withColumn("before", F.lag("key").over(
        Window.partitionBy("file").orderBy("at")))
    files = steps.groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("before") > F.col("key")).alias("turned"),
        F.min("key").alias("first"), F.max("key").alias("last"))
    # One row a file.
    ranges = files.withColumn("above", F.lag("last").over(Window.orderBy("first", "last")))
    return ranges.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
                      F.count(F.lit(1)).alias("files"),
                      F.coalesce(F.sum("turned"), F.lit(0)).alias("turned"),
                      F.count_if(F.col("above") > F.col("first")).alias("overlapping"))
