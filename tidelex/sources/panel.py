"""Price panel and sampling frame."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelex.errors import MissingInput
from tidelex.operators import regime, sampling
from tidelex.sources.tables import exists, require_columns

PERIMETER_SCHEMA = "ticker string, session_date date, trailing_vol double, stressed double"


def load_panel(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder}/panel.parquet"
    if not exists(spark, path):
        raise MissingInput(f"no price panel at {path}")
    panel = require_columns(spark.read.parquet(path), "ticker", "session_date")
    return panel.withColumn("session_date", F.to_date("session_date"))


def load_perimeter(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The frame and its recomputed fingerprint: that of its text, or of its tree beyond MAX_LINES."""
    if not exists(spark, path):
        raise MissingInput(f"no perimeter at {path}")
    frame = spark.read.schema(PERIMETER_SCHEMA).csv(path, header=True)
    return frame, (sampling.fingerprint(frame).first()["sha256"]
                   or sampling.tree_fingerprint(frame).first()["sha256"])


def save_perimeter(sample: DataFrame, path: str, per_ticker: int, balance: float,
                   seed: int = sampling.SEED) -> dict:
    """Write the frame as CSV and its manifest next to it; return the manifest."""
    spark = sample.sparkSession
    sample.orderBy("ticker", "session_date").write.mode("overwrite").csv(path, header=True)
    frame, sha = load_perimeter(spark, path)
    manifest = {"seed": seed, "per_ticker": per_ticker, "balance": balance,
                "lookback": regime.LOOKBACK, "stress_quantile": regime.STRESS_QUANTILE,
                "regime_estimator": "garman_klass", "n": frame.count(), "sha256": sha,
                "tree_sha256": sampling.tree_fingerprint(frame).first()["sha256"]}
    (spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1)
     .write.mode("overwrite").text(path.removesuffix(".csv") + ".json"))
    return manifest
