"""A cleaning pipeline over `documents`: five stages, each made of one operator of `tidelex.llm`.

Toxic documents go; of near copies one stays, that of the smallest id; documents that hold a
benchmark window go; secrets are masked in the texts; what is left is packed into sequences. A stage
works on all rows its predecessor kept, and all but the last return the columns of `documents`.

Rows go to Python in Arrow batches of `BATCH_ROWS` at most. Spark's 10,000 whole documents would be
some 30 MB a copy, with several copies in each of an executor's JVM and Python workers.

Null texts and ids pass as each operator defines; an empty table gives no pieces; further columns of
`documents` are kept up to the last stage.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelex.llm import decontaminate, ngram_join, packing, secrets, toxicity
from tidelex.llm.common import fresh_folder, read
from tidelex.llm.queries import tokenizer_path

#: No SQL expresses the learned grammar, the joins' pruning or the packing.
ORACLE_SQL = None
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.withColumn("__whole", F.col("text")), model,
                            score_col="__score")
    return scored.where("__score < 0.5").withColumnRenamed("__whole", "text").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, tokenizer_path())


def _in_small_batches(stage):
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        # The session keeps it, as the caller runs what a stage returns; a smaller value is left.
        if not 0 < int(spark.conf.get(BATCH_CONF)) <= BATCH_ROWS:
            spark.conf.set(BATCH_CONF, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _in_small_batches(stage)) for name, stage in (
    ("toxicity", drop_toxic), ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated), ("secrets", mask_secrets), ("packing", pack))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = fresh_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
