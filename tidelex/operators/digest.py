"""One size-bounded text per unit, newest documents first in line, oldest shown first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidelex.functions.clock import iso_instant
from tidelex.functions.text import excerpt
from tidelex.operators.align import UNIT
from tidelex.session import require_utc

# Characters counted per token, and tokens in a digest.
CHARS_PER_TOKEN = 4
MAX_TOKENS = 3000

#: No block is shorter than this: the four preamble lines with empty source and title.
_SHORTEST_BLOCK = 60


def header_text():
    return F.concat(F.lit("Instrument: "), F.col("ticker"), F.lit("\nSession: "),
                    F.date_format("session_date", "yyyy-MM-dd"), F.lit("\n"))


def select_blocks(kept: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """The blocks that enter each digest, with their rank (1 = newest) and size.

    A digest holds few blocks whatever its unit holds, so ranking is limited to that many before
    the shuffle (Spark plans a partial group limit), and no text longer than the budget travels:
    what lies beyond can only be cut away.
    """
    limit = max_tokens * CHARS_PER_TOKEN
    newest = Window.partitionBy(*UNIT).orderBy(
        F.desc("published_utc"), F.desc("doc_id"), F.desc("text_key"))
    ranked = (
        kept.select(*UNIT, "n_documents", "published_utc", "doc_id", "text_key", "title",
                    "source", F.length("body").alias("n_chars"),
                    F.substring("body", 1, limit).alias("head"))
        .withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= limit // _SHORTEST_BLOCK + 2))
    preamble = F.concat(
        F.lit("[DOCUMENT "), F.col("rank").cast("string"), F.lit("]\nSource: "), F.col("source"),
        F.lit("\nPublished: "), iso_instant(F.col("published_utc")), F.lit("\nTitle: "),
        F.col("title"), F.lit("\n\n"))
    sized = (
        ranked.withColumn("preamble", preamble)
        .withColumn("budget", F.lit(limit - 1) - F.length(header_text()))
        .withColumn("whole", F.length("preamble") + F.col("n_chars") + 1)
        .withColumn("block", F.when(
            (F.col("rank") == 1) & (F.col("whole") > F.col("budget")),
            F.concat("preamble", excerpt(F.col("head"),
                                         F.col("budget") - F.length("preamble"))))
            .otherwise(F.concat(F.col("preamble"), F.col("head"), F.lit("\n"))))
        .withColumn("size", F.when(F.col("rank") == 1, F.length("block"))
                    .otherwise(F.col("whole"))))
    so_far = newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (sized.withColumn("used", F.sum("size").over(so_far))
            .where((F.col("rank") == 1) | (F.col("used") <= F.col("budget")))
            .select(*UNIT, "n_documents", "rank", "doc_id", "published_utc", "size", "used",
                    "block"))


def build_digests(kept: DataFrame, sessions: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row per session: n_documents, digest and its SHA-256. Silent sessions get the header."""
    require_utc(kept.sparkSession)
    oldest_first = F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("at"), "block")))
    texts = (select_blocks(kept, max_tokens).groupBy(*UNIT)
             .agg(F.max("n_documents").alias("n_documents"),
                  F.array_join(F.transform(oldest_first, lambda b: b["block"]), "\n")
                  .alias("blocks")))
    digest = F.when(F.col("blocks").isNull(), header_text()).otherwise(
        F.concat(header_text(), F.lit("\n"), F.col("blocks")))
    return (sessions.select(*UNIT).distinct().join(texts, UNIT, "left")
            .select(*UNIT, F.coalesce("n_documents", F.lit(0)).cast("long").alias("n_documents"),
                    digest.alias("digest"))
            .withColumn("digest_sha256", F.sha2("digest", 256)))
