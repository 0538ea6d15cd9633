"""A Bloom filter of fixed size, built with DataFrame aggregates and tested on numpy arrays.

Its size does not depend on the data, so it may be broadcast: 2 MB. A fuller filter lets more rows
pass; the join that follows decides exactly, so only its cost depends on the filter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import mixed

BITS = 24


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << BITS) - 1)
    return hashes & mask, mixed(hashes) & mask


def build(hashes: DataFrame, column: str) -> np.ndarray:
    """The filter of a column of longs. Bits are combined before the shuffle; at most 2^18 words
    come back, whatever the number of rows."""
    import pyarrow as pa

    def places(batches):
        for batch in batches:
            first, second = _places(batch.column(0).to_numpy().view(np.uint64))
            at = np.unique(np.concatenate([first, second])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    words = (hashes.select(column).where(F.col(column).isNotNull())
             .mapInArrow(places, "at long")
             .groupBy(F.shiftright("at", 6).alias("word"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"),
                                           F.col("at").bitwiseAND(F.lit(63)).cast("int")))
                  .alias("bits")))
    out = np.zeros(1 << (BITS - 6), np.uint64)
    for row in words.collect():
        out[row["word"]] = np.int64(row["bits"]).view(np.uint64)
    return out


def passes(filter_words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where a hash may have been put in."""
    ok = np.ones(len(hashes), bool)
    for at in _places(hashes):
        at = at.astype(np.int64)
        ok &= (filter_words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return ok
