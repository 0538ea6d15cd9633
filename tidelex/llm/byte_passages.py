"""Suffix-array deduplication over bytes, by threshold-bounded interval expansion.

A byte is removed when a string of `WINDOW` bytes over it also starts anywhere else. `passages`
folds equal contexts and deals the contexts at the edges of passages to shards. A shard sorts the
suffixes of its contexts, takes their Burrows-Wheeler transform, and extends backwards breadth
first: suffixes that start with different symbols have a common prefix of 0; prepending a symbol to
two suffixes whose common prefix is l, with none of that symbol between them, gives one of l + 1.
So common prefixes appear by increasing value, and the expansion stops at the least length that
counts: suffixes not reached by then are repeated.

The gram that contexts share is one symbol in a shard, so texts stay short and the least length is
WINDOW - GRAM + 1.

Defined results: null and empty texts have no bytes; a text that several rows hold is removed from
all of them (if it has `WINDOW` bytes), rows with equal ids included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, text_key, text_or_empty
from .passages import Rule, removed, repeated
from .winnow import BYTES

WINDOW = 400
GRAM = 272
LEAST = WINDOW - GRAM + 1
#: Stands for a null id inside this module.
NO_ID = -(1 << 63)


def _symbols(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTES[data], np.diff(edges)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the compared length until all are told apart. The last symbol
    must occur once."""
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    n, step = len(symbols), 1
    while True:
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        told = np.empty(n, np.int64)
        told[0] = 0
        np.cumsum(key[order][1:] != key[order][:-1], out=told[1:])
        rank = np.empty(n, np.int64)
        rank[order] = told
        if told[-1] == n - 1:
            return order
        step *= 2


def repeated_suffixes(symbols: np.ndarray, least: int) -> np.ndarray:
    """True for each suffix whose first `least` symbols also start another suffix."""
    order = suffix_array(symbols)
    n = len(order)
    transform = symbols[order - 1]
    # Row r of the sorted suffixes is the backward extension of row after[r].
    after = np.argsort(transform, kind="stable")
    before, here = after[:-1], after[1:]
    short = np.zeros(n + 1, bool)  # common prefix with the suffix before is under `least`
    reached = np.flatnonzero(transform[before] != transform[here]) + 1
    short[0] = short[n] = True
    short[reached] = True
    edge = np.zeros(n, bool)
    edge[0] = True
    edge[reached] = True
    open_rows = np.setdiff1d(np.arange(1, n), reached, assume_unique=True)
    for _ in range(1, least):
        upto = np.cumsum(edge)
        hit = upto[here[open_rows - 1]] > upto[before[open_rows - 1]]
        reached = open_rows[hit]
        if not len(reached):
            break
        short[reached] = True
        open_rows = open_rows[~hit]
        edge = np.zeros(n, bool)
        edge[reached] = True
    out = np.zeros(n, bool)
    out[order] = ~short[:-1] | ~short[1:]
    return out


def _shard(contexts: list[tuple]) -> Iterator[tuple[int, int, int]]:
    if not contexts:
        return
    cores = {core: 256 + i for i, core in enumerate(dict.fromkeys(c[0] for c in contexts))}
    parts, starts, at = [], [], 0
    for i, (core, _, first, _, place, _, payload) in enumerate(contexts):
        left = place - first
        body = np.frombuffer(payload, np.uint8).astype(np.int64)
        parts += [body[:left], [cores[core]], body[left:], [256 + len(cores) + i]]
        starts.append(at)
        at += len(body) + 2
    found = repeated_suffixes(np.concatenate(parts), LEAST)
    for i, (_, _, first, last, _, query, _) in enumerate(contexts):
        if not query:
            continue
        own = np.flatnonzero(found[starts[i]:starts[i] + last - first + 1])
        if len(own):
            for run in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                yield i, int(first + run[0]), int(first + run[-1] + WINDOW)


def _payload(text: bytes, first: int, last: int, place: int) -> bytes:
    return text[first:place] + text[place + GRAM:last + WINDOW]


def rule() -> Rule:
    origin = F.xxhash64("key", "first")
    return Rule(window=WINDOW, gram=GRAM, units=bytes, symbols=_symbols, origin=origin,
                rank=origin, repeats=lambda rank, low, high: low != high, payload=_payload, shard=_shard)


def deduplicate(docs: DataFrame, describe, whole, nothing, ddl: str, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row. `describe(bytes that stay)`,
    `whole` (a column of the text) and `nothing` (of an empty text) make `kept` alike."""
    text = text_or_empty(F.col(text_col))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
                        text_key(text).alias("key"), F.encode(text, "UTF-8").alias("text"))
    rows = checkpointed(texts.select("id", "key", F.octet_length("text").cast("long")
                                     .alias("n_bytes"), whole(F.col("text")).alias("whole")))
    groups = checkpointed(rows.groupBy("key").agg(F.min("id").alias("id"),
                                                  F.count(F.lit(1)).alias("copies")))

    def cut(body: bytes, spans: list[tuple[int, int]]) -> tuple:
        kept, at = [], 0
        for start, stop in spans:
            kept.append(body[at:start])
            at = stop
        kept.append(body[at:])
        left = b"".join(kept)
        return len(body) - len(left), len(spans), describe(left)

    found = removed(texts, repeated(texts, groups.select("key", "id"), rule()), cut,
                    f"n_cut long, n_spans long, cut {ddl}")
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= WINDOW)
    return (rows.join(groups.select("key", "copies"), "key").join(found, "key", "left").select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_cut", F.lit(0)))
        .cast("long").alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0)))
        .cast("long").alias("n_spans"),
        F.when(all_gone, F.lit(nothing)).otherwise(F.coalesce("cut", "whole")).alias("kept")))


def without_passages(docs: DataFrame) -> DataFrame:
    """`kept` as bytes: a cut may fall inside a character."""
    return deduplicate(docs, bytes, lambda text: text, b"", "binary")


def report(docs: DataFrame) -> DataFrame:
    return deduplicate(docs, lambda left: hashlib.sha256(left).hexdigest(),
                       lambda text: F.sha2(text, 256), hashlib.sha256(b"").hexdigest(),
                       "string").withColumnRenamed("kept", "kept_sha256")
