"""Stored answers, keyed by content: what has been paid for is never asked again.

New answers arrive in small folders, one per micro-batch, named by it: writing one again replaces it.
Compaction merges them into the base, which is partitioned by the first characters of the key, each
key once. A lookup reads the partitions its keys are in, and the folders that are not merged yet.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelex.sources.tables import children, complete, drop

ANSWER_SCHEMA = ("cache_key string, raw string, model_returned string, structure_mode string, "
                 "cost_usd double")
# Fixed value: characters of the key that name its partition.
FAN_OUT = 2


def _recent(path: str) -> str:
    return f"{path}/recent"


def _generations(spark: SparkSession, path: str) -> list[str]:
    return [g for g in children(spark, f"{path}/base") if complete(spark, f"{path}/base/{g}")]


def _parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(base with k2, answers not merged yet)."""
    generations = _generations(spark, path)
    empty = spark.createDataFrame([], ANSWER_SCHEMA + ", k2 string")
    base = (spark.read.schema(ANSWER_SCHEMA + ", k2 string")
            .parquet(f"{path}/base/{generations[-1]}") if generations else empty)
    folders = children(spark, _recent(path))
    recent = (spark.read.schema(ANSWER_SCHEMA).option("recursiveFileLookup", "true")
              .parquet(_recent(path)) if folders else empty.drop("k2"))
    present = F.col("raw").isNotNull()
    return base.where(present), recent.where(present)


def load_answers(spark: SparkSession, path: str) -> DataFrame:
    """The store as it is now; an absent store is an empty one, a row without text a miss."""
    base, recent = _parts(spark, path)
    fresh = recent.dropDuplicates(["cache_key"]).join(base.select("cache_key"), "cache_key",
                                                      "left_anti")
    return base.drop("k2").unionByName(fresh)


def lookup(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """The stored answers of the keys in `asked`."""
    base, recent = _parts(spark, path)
    keys = asked.select("cache_key").distinct()
    # At most 16 to the power of FAN_OUT values, whatever is asked.
    held = [r[0] for r in keys.select(F.substring("cache_key", 1, FAN_OUT)).distinct().collect()]
    found = base.where(F.col("k2").isin(held)).drop("k2").unionByName(recent)
    return found.join(keys, "cache_key", "left_semi").dropDuplicates(["cache_key"])


@dataclass(frozen=True)
class StoredAnswers:
    """A store that stages look their own keys up in, as it is when they ask."""

    spark: SparkSession
    path: str

    def __call__(self, asked: DataFrame) -> DataFrame:
        return lookup(self.spark, self.path, asked)


def matching(answers: DataFrame | Callable[[DataFrame], DataFrame], asked: DataFrame) -> DataFrame:
    """A table of answers as it is, or what a store says to the keys asked."""
    return answers(asked) if callable(answers) else answers


def load_json_answers(spark: SparkSession, folder: str) -> DataFrame:
    """A store of one JSON file per key, as <folder>/<2 chars>/<key>.json. Corrupt files miss."""
    entry = F.from_json("value", "raw string, model_returned string, structure_mode string, "
                                 "cost_usd double")
    return (spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true")
            .text(folder, wholetext=True)
            .select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("cache_key"),
                    entry.alias("e")).select("cache_key", "e.*")
            .where(F.col("raw").isNotNull()))


def append_answers(answers: DataFrame, path: str, name: str | None = None) -> None:
    """Add a folder of answers. The same name written again replaces it, so a commit may be repeated."""
    answers.select("cache_key", "raw", "model_returned", "structure_mode", "cost_usd").write.mode(
        "overwrite").parquet(f"{_recent(path)}/{name or uuid.uuid4().hex}")


def compact(spark: SparkSession, path: str) -> int:
    """Merge what has arrived into a new generation of the base; returns the folders merged.

    The old generation and the merged folders go only after the new one is complete. Should the run
    end in between, keys are held twice, which lookups allow for.
    """
    folders = children(spark, _recent(path))
    if not folders:
        return 0
    generations = children(spark, f"{path}/base")
    number = int(generations[-1][1:]) + 1 if generations else 0
    merged = load_answers(spark, path).withColumn("k2", F.substring("cache_key", 1, FAN_OUT))
    (merged.repartition("k2", F.substring("cache_key", FAN_OUT + 1, 1))
     .write.mode("overwrite").partitionBy("k2").parquet(f"{path}/base/g{number:08d}"))
    for folder in folders:
        drop(spark, f"{_recent(path)}/{folder}")
    for old in generations:
        drop(spark, f"{path}/base/{old}")
    return len(folders)


def to_pay(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests whose key has no stored answer."""
    return requests.join(answers, "cache_key", "left_anti")


def in_cache(requests: DataFrame, answers: DataFrame) -> DataFrame:
    return requests.join(answers, "cache_key", "left_semi")
