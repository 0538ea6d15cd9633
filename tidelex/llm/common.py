"""Small helpers that several operators of this folder share."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidelex.session import checkpointed, shared_folder, stored

__all__ = ["checkpointed", "components", "extended", "fresh_folder", "mixed", "partitions_for", "read",
           "row_key", "stored", "text_key", "text_or_empty"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder, for tables an operator writes."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def text_key(column: Column) -> Column:
    """128 bits that stand for one text: equal texts meet without their bytes being shuffled."""
    return F.unhex(F.md5(column))


def extended(df: DataFrame, ddl: str) -> StructType:
    """The schema of `df` with the columns of `ddl` after it."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def row_key(df: DataFrame, name: str) -> DataFrame:
    """Checkpoint `df`, then number its rows: the numbers stay the same on every later read."""
    return checkpointed(df).withColumn(name, F.monotonically_increasing_id())


def partitions_for(df: DataFrame) -> int:
    """Shuffle partitions of the session, for the few places that must name a number."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph given as (a, b) rows: (node, component), the
    smallest node of each component being its name. Self-loops keep single nodes.

    Large-star / small-star rounds: the number of rounds grows with the logarithm of the longest
    path, the rows of a round never exceed the edges. Minima are combined before each shuffle, and
    the joins are plain equi-joins whose hot keys Spark may split.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                         .distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = (both.join(lowest, "a").where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(edges.where("a = b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        turned = checkpointed(small.unionByName(low.withColumnRenamed("m", "b"))
                              .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                              .distinct())
        # Stars all the way: a node points at one node, and that one points no further.
        arcs = turned.where("a <> b")
        forked = arcs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        deeper = (arcs.select(F.col("b").alias("x")).distinct()
                  .join(arcs.select(F.col("a").alias("x")), "x", "left_semi"))
        done = forked.isEmpty() and deeper.isEmpty()
        edges = turned
        if done:
            break
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node")).distinct()
        .join(edges.select(F.col("a").alias("node")), "node", "left_anti")
        .withColumn("component", F.col("node")))
