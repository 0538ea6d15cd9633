"""Mandate files: the instruction of each reader, hashed with newlines normalised."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelex.errors import MissingInput


@dataclass(frozen=True)
class Mandate:
    text: str
    sha: str


def scan_mandates(spark: SparkSession, folder: str) -> DataFrame:
    """mandate, text, sha of every .txt file in `folder`."""
    text = F.regexp_replace("value", "\r\n?", "\n")
    return (spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
            .select(F.regexp_replace("_metadata.file_name", r"\.txt$", "").alias("mandate"),
                    text.alias("text"))
            .withColumn("sha", F.sha2("text", 256)))


def load_mandates(spark: SparkSession, folder: str, names: list[str]) -> dict[str, Mandate]:
    """The named mandates, on the driver: one short text per seat. A missing one is an error."""
    rows = scan_mandates(spark, folder).where(F.col("mandate").isin(*names)).collect()
    found = {row["mandate"]: Mandate(row["text"], row["sha"]) for row in rows}
    missing = sorted(set(names) - set(found))
    if missing:
        raise MissingInput(f"no mandate file for {', '.join(missing)} in {folder}")
    return found
