"""The news corpus: named parquet streams with zoned timestamps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidelex.errors import AmbiguousZone
from tidelex.sources.tables import require_columns, union_existing

# Stream names.
ISSUER_STREAMS = ("news_boursorama", "news_amf")
MACRO_STREAMS = ("news_macro_bfm",)
DEFAULT_STREAMS = ISSUER_STREAMS + MACRO_STREAMS


def load_corpus(spark: SparkSession, folder: str,
                streams: tuple[str, ...] = DEFAULT_STREAMS) -> DataFrame:
    """The streams that exist, with a `stream` column. Naive timestamps are refused."""
    found = union_existing(spark, [f"{folder}/{name}.parquet" for name in streams], "news stream")
    frames = [checked(frame).withColumn("stream", F.lit(streams[at])) for at, frame in found]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def checked(frame: DataFrame) -> DataFrame:
    require_columns(frame, "doc_id", "ticker", "published_utc", "body")
    if isinstance(frame.schema["published_utc"].dataType, T.TimestampNTZType):
        raise AmbiguousZone("published_utc has no zone; record it, since guessing one moves "
                            "documents across the session boundary")
    return frame
