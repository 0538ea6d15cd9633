"""Row order inside a key without gathering the key: positions, running sums, lag windows.

A plain window over a key sorts all its rows in one task. Here every key is cut into buckets that
follow the order; counts and sums are first reduced per bucket, the small bucket table is
accumulated, and rows only meet rows of their own bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelex.session import checkpointed

#: Rows per chunk of a numbered key.
CHUNK = 8192


def with_position(df: DataFrame, keys: list[str], order: list[str], bucket: Column,
                  name: str = "position") -> DataFrame:
    """Add the 0-based place of each row inside `keys`; `bucket` must grow with the order."""
    df = df.withColumn("_bucket", bucket)
    starts = running_totals(df, keys, "_bucket", {"_start": F.count(F.lit(1))})
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return (df.withColumn("_local", local)
            .join(starts, [*keys, "_bucket"])
            .withColumn(name, F.col("_start") + F.col("_local") - 1)
            .drop("_bucket", "_local", "_start"))


def with_global_position(df: DataFrame, key: str, order: list[str], bucket: Column,
                         name: str = "position") -> DataFrame:
    """Place of each row in the order (key, order) over the whole table."""
    inside = with_position(df, [key], order, bucket, "_inside")
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    # Keys are ordered by range partitions: sums inside each, and one total per partition before
    # it. The partition numbers are stored, since sampled bounds may differ when planned again.
    ranged = checkpointed(sizes.repartitionByRange(key)
                          .withColumn("_range", F.spark_partition_id()))
    starts = running_totals(ranged, [], "_range", {"_start": F.sum("_n")})
    before = (Window.partitionBy("_range").orderBy(key)
              .rowsBetween(Window.unboundedPreceding, -1))
    first = (ranged.withColumn("_local", F.coalesce(F.sum("_n").over(before), F.lit(0)))
             .join(starts, "_range")
             .select(key, (F.col("_start") + F.col("_local")).alias("_first")))
    return (inside.join(first, key).withColumn(name, F.col("_first") + F.col("_inside"))
            .drop("_first", "_inside"))


def running_totals(df: DataFrame, keys: list[str], bucket: str,
                   sums: dict[str, Column]) -> DataFrame:
    """Per bucket, each aggregate summed over the earlier buckets of its key (0 at the start)."""
    totals = df.groupBy(*keys, bucket).agg(*[c.alias(n) for n, c in sums.items()])
    before = (Window.partitionBy(*keys).orderBy(bucket)
              .rowsBetween(Window.unboundedPreceding, -1))
    return totals.select(*keys, bucket, *[
        F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])


def running_sums(df: DataFrame, keys: list[str], position: str, sums: dict[str, Column],
                 inclusive: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Add each expression summed over the rows before this one (or up to it)."""
    df = df.withColumn("_chunk", F.floor(F.col(position) / chunk))
    starts = _chunk_starts(df, keys, {f"_{n}": F.sum(c) for n, c in sums.items()}, chunk)
    upto = (Window.partitionBy(*keys, "_chunk").orderBy(position)
            .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    local = df.select("*", *[
        F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(n) for n, c in sums.items()])
    return (local.join(starts, [*keys, "_chunk"])
            .select(*[c for c in df.columns if c != "_chunk"],
                    *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums]))


def _chunk_starts(df: DataFrame, keys: list[str], sums: dict[str, Column],
                  chunk: int) -> DataFrame:
    """`running_totals` over chunks. Without keys, chunks are accumulated inside blocks of `chunk`
    chunks and only the blocks as a whole: one row for each chunk * chunk rows."""
    if keys:
        return running_totals(df, keys, "_chunk", sums)
    totals = df.groupBy("_chunk").agg(*[c.alias(n) for n, c in sums.items()]).withColumn(
        "_block", F.floor(F.col("_chunk") / chunk))
    blocks = running_totals(totals, [], "_block", {f"_b{n}": F.sum(n) for n in sums})
    before = (Window.partitionBy("_block").orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    inside = totals.select("_block", "_chunk", *[
        F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])
    return inside.join(blocks, "_block").select("_chunk", *[
        (F.col(n) + F.col(f"_b{n}")).alias(n) for n in sums])


def with_lookback(df: DataFrame, position: str, rows: int, chunk: int = CHUNK) -> DataFrame:
    """Copy the last `rows` rows of every chunk into the next one.

    Afterwards a window over (keys, `chunk_id`) ordered by `position` sees `rows` rows back for
    every row that is not `is_copy`.
    """
    if rows >= chunk:
        raise ValueError(f"a lookback of {rows} rows needs chunks longer than {chunk}")
    home = F.floor(F.col(position) / chunk)
    tail = F.col(position) % chunk >= chunk - rows
    places = F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))
    return (df.withColumn("chunk_id", F.explode(places))
            .withColumn("is_copy", F.col("chunk_id") != home))


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float,
                   name: str = "quantile") -> DataFrame:
    """Linear-interpolated quantile per key over non-null, non-negative values.

    Equal values are counted before anything moves, and distinct values are accumulated in
    logarithmic buckets, so no task holds a whole key.
    """
    counted = (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
               .agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_bucket", F.floor(F.log(F.greatest(F.col(value), F.lit(1e-300)))
                                              * 4096)))
    starts = running_totals(counted, keys, "_bucket", {"_before": F.sum("_n")})
    upto = (Window.partitionBy(*keys, "_bucket").orderBy(value)
            .rowsBetween(Window.unboundedPreceding, 0))
    placed = (counted.withColumn("_upto", F.sum("_n").over(upto)).join(starts, [*keys, "_bucket"])
              .withColumn("_last", F.col("_before") + F.col("_upto") - 1)
              .withColumn("_first", F.col("_last") - F.col("_n") + 1))
    size = counted.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    at = (F.col("_size") - 1) * F.lit(q)
    low, high = F.floor(at), F.ceil(at)

    def pick(place: Column) -> Column:
        return F.max(F.when((F.col("_first") <= place) & (place <= F.col("_last")),
                            F.col(value)))

    ends = placed.join(size, keys).groupBy(*keys).agg(
        pick(low).alias("_low"), pick(high).alias("_high"), F.first(at - low).alias("_part"))
    return ends.select(*keys, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part"))
                       .alias(name))
