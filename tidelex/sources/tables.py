"""Path checks and guarded reads shared by the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelex.errors import MissingColumn, MissingInput


def _located(spark: SparkSession, path: str):
    """The path and its filesystem, whatever filesystem it names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _located(spark, path)
    return files.exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder, in order; none if it does not exist."""
    target, files = _located(spark, path)
    if not files.exists(target):
        return []
    return sorted(entry.getPath().getName() for entry in files.listStatus(target))


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty file that others look for."""
    target, files = _located(spark, path)
    files.create(target, True).close()


def drop(spark: SparkSession, path: str) -> None:
    target, files = _located(spark, path)
    files.delete(target, True)


def complete(spark: SparkSession, folder: str) -> bool:
    """Whether the job that wrote a folder has committed."""
    return exists(spark, f"{folder}/_SUCCESS")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise MissingColumn(f"missing columns: {', '.join(missing)}")
    return df


def union_existing(spark: SparkSession, paths: list[str], what: str) -> list[tuple[int, DataFrame]]:
    """(ordinal, frame) of every existing parquet path; none at all is an error."""
    frames = [(at, spark.read.parquet(path)) for at, path in enumerate(paths)
              if exists(spark, path)]
    if not frames:
        raise MissingInput(f"no {what} at any of: {', '.join(paths)}")
    return frames
