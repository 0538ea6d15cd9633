"""Benchmark decontamination by winnowed fingerprints.

Both sides keep the smallest word 5-gram hash of each 10-word window. Document fingerprints pass a
fixed-size filter of the benchmark's, the windows around those that pass are the extended hits, and
an equality join of window texts with the benchmark's windows decides. Every shared window has a
shared fingerprint, so none is lost; the join compares whole texts, so none is invented. Items of
fewer words than a window have one window of their own length, found by its hash.

A passage that many documents share makes one row per document and window in the join; Spark may
split such a key, as nothing needs its rows together.

Defined results: a null or empty text has no words; an item without words has no windows; an item
whose id is null marks words as hit but is not listed; repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidelex.session import stored

from . import bloom
from .common import checkpointed, extended, row_key, text_key, text_or_empty
from .winnow import Rolling, anchors, word_symbols

WINDOW = 10
GRAM = 5
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))


_INSIDE = np.arange(256) != 32


def plain(text: bytes) -> bytes:
    """A-Z in lower case, spaces for all that no word holds: ASCII but letters and digits."""
    return text.translate(_LETTERS)


def words_of(text: bytes) -> list[bytes]:
    return plain(text).split()


def _items(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, window, size, fingerprint, short): every window of every item; fingerprint is that
    of a full window, and of the whole of a short one."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"),
                            F.encode(text_or_empty(F.col(text_col)), "UTF-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = plain(text)
                words = text.split()
                size = min(len(words), window)
                if not size:
                    continue
                rolling = Rolling(word_symbols(text, _INSIDE))
                if len(words) < window:
                    codes = rolling.of([0], [size])
                else:
                    place, first, last = anchors(rolling.grams(GRAM), window - GRAM + 1)
                    codes = np.repeat(rolling.grams(GRAM)[place], last - first + 1)
                for at, code in enumerate(codes.view(np.int64).tolist()):
                    out.append((item, b" ".join(words[at:at + size]), size, code,
                                len(words) < window))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (
                    pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.bool_()))],
                names=["item_id", "window", "size", "fingerprint", "short"])

    return rows.mapInArrow(run, "item_id long, window binary, size int, fingerprint long, "
                                "short boolean")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """`docs` without its text, one row per row: n_words, n_hit, spans (word ranges [start, stop)
    that are hit), items (sorted ids of the items found). Columns of these names are replaced; __text,
    __hits and __row are reserved."""
    items = checkpointed(_items(benchmark, window, item_col, item_text_col))
    long_filter = bloom.build(items.where("not short"), "fingerprint")
    short_filter = bloom.build(items.where("short"), "fingerprint")
    # At most window - 1 rows.
    short_sizes = [r[0] for r in items.where("short").select("size").distinct().collect()]
    context = docs.sparkSession.sparkContext
    filters = context.broadcast((long_filter, short_filter))
    made = ("n_words", "n_hit", "spans", "items")
    keep = [c for c in docs.columns if c not in (text_col, *made)]
    rows = docs.select(*keep, F.encode(text_or_empty(F.col(text_col)), "UTF-8").alias("__text"))
    found = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()),
                                ("window", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long_bits, short_bits = filters.value
        for batch in batches:
            counts, hits = [], []
            for text in batch.column("__text"):  # one at a time: a batch may hold many long ones
                text = plain(text.as_py())
                codes = word_symbols(text, _INSIDE)
                counts.append(len(codes))
                at: list[tuple[int, int]] = []
                if len(codes):
                    rolling = Rolling(codes)
                    grams = rolling.grams(GRAM)
                    place, first, last = anchors(grams, window - GRAM + 1)
                    for i in np.flatnonzero(bloom.passes(long_bits, grams[place])):
                        at += [(s, window) for s in range(first[i], last[i] + 1)]
                    for size in short_sizes:
                        starts = np.flatnonzero(bloom.passes(short_bits, rolling.grams(size)))
                        at += [(s, size) for s in starts.tolist()]
                words = text.split() if at else []
                hits.append([{"start": s, "size": n, "window": b" ".join(words[s:s + n])}
                             for s, n in at])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(counts, pa.int64()),
                 pa.array(hits, found)], names=[*keep, "n_words", "__hits"])

    schema = extended(rows.drop("__text"),
                      "n_words long, __hits array<struct<start:int,size:int,window:binary>>")
    marked = row_key(rows.mapInArrow(run, schema), "__row")
    joined = (marked.select("__row", F.explode("__hits").alias("h"))
              .select("__row", "h.start", "h.size", "h.window")
              .join(items.select("window", "item_id").distinct(), "window"))
    per_row = joined.groupBy("__row").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size"))
                                            .alias("stop")))).alias("ranges"),
        F.array_sort(F.collect_set("item_id")).alias("items"))
    # Overlapping ranges become one.
    spans = F.expr("""aggregate(ranges, cast(array() as array<struct<start:int,stop:int>>),
        (done, x) -> if(size(done) > 0 and element_at(done, -1).stop >= x.start,
            concat(slice(done, 1, size(done) - 1), array(named_struct(
                'start', element_at(done, -1).start,
                'stop', greatest(element_at(done, -1).stop, x.stop)))),
            concat(done, array(x))))""")
    merged = per_row.select("__row", spans.alias("spans"), "items")
    return (marked.drop("__hits").join(merged, "__row", "left").drop("__row")
            .withColumn("spans", F.coalesce("spans", F.expr(
                "cast(array() as array<struct<start:int,stop:int>>)")))
            .withColumn("items", F.coalesce("items", F.expr("cast(array() as array<bigint>)")))
            .withColumn("n_hit", F.expr(
                "aggregate(spans, 0L, (n, x) -> n + x.stop - x.start)")))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs.select("doc_id", "text"), benchmark)
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                         text_col: str = "text") -> DataFrame:
    """`docs` without the rows that hold a window of an item. Whether one does is a matter of its
    text alone, so only texts and their 128-bit keys are searched, and rows stay in the JVM, as one
    column, so that their columns may have any names. They move for the last join only where the
    keys found are too many to be sent to all."""
    key = text_key(text_or_empty(F.col(text_col))).alias("key")
    texts = docs.select(key, text_or_empty(F.col(text_col)).alias("text"))
    found = contamination(texts, benchmark, window, id_col="key").where("n_hit > 0")
    held = docs.select(F.struct(*docs.columns).alias("row"), key)
    return held.join(stored(found.select("key").distinct()), "key", "left_anti").select("row.*")
