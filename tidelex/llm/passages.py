"""Passages that occur more than once, found over a whole corpus without pairing documents.

The common part of the two substring operators. A text is a sequence of symbols (words or bytes)
and a window is `t` of them. Every window belongs to one winnowed anchor, a k-gram (`winnow`); the
windows of one anchor are consecutive, and the text under them is the anchor's context.

1. Anchors whose gram occurs in one place only are dropped, with a fixed-size filter of the others.
2. Equal contexts are folded: all windows of a context that occurs again are repeated.
3. What is left is contexts that share their gram with a different context: the edges of passages.
   They go, by gram, to bounded shards, where the operator compares them symbol by symbol. A gram
   with more than `CROWD` contexts never meets in one shard: its windows are hashed one by one and
   counted instead, which is exact too and needs no group in one place.

Counts and minima are combined before every shuffle, joins are equi-joins that Spark may split, and
texts move twice, only those that hold shared passages, each to its own row, and packed. What is read
again is stored as a table: anchors of one text stand together there, so its key and id cost next to
nothing, where a checkpoint writes every row in full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from . import bloom
from .common import checkpointed, mixed, stored
from .winnow import Rolling, anchors

#: Contexts of one gram that may meet in a shard.
CROWD = 2048
#: Contexts of a shard, on average.
SHARD = 2048


@dataclass(frozen=True)
class Rule:
    """How texts become symbols, and what counts as repeated.

    `units(text)` cuts a text; `symbols(data, edges)` gives a 64-bit symbol for each unit of the texts
    that stand in `data`, text i from edges[i] to edges[i + 1], and the number of each text's units.
    `origin` and `rank` are columns of (key, id, first): `origin` tells occurrences apart, the
    smallest `rank` marks the first. `repeats(rank, low, high)` says whether an occurrence counts as repeated when
    its content has ranks from low to high. `payload(units, first, last, place)` is what a shard
    needs of a context, and `shard` yields (index, start, stop) of the repeated stretches of its
    contexts, given as (core, rank, first, last, place, query, payload); contexts that are not a
    query are only compared with.
    """

    window: int
    gram: int
    units: Callable[[bytes], Sequence]
    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    origin: Column
    rank: Column
    repeats: Callable[[Column, Column, Column], Column]
    payload: Callable[[object, int, int, int], bytes]
    shard: Callable[[list[tuple]], Iterator[tuple[int, int, int]]]


#: Rows of a batch, and bytes of their texts, that a task works on at once.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1024, 1 << 18


def _edges(column: pa.Array) -> np.ndarray:
    """Where the values of a column of binaries begin in its data, and where the last one ends."""
    wide = pa.types.is_large_binary(column.type)
    return np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[
        column.offset:column.offset + len(column) + 1].astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that what a task makes of one does not grow with the batch."""
    for batch in batches:
        at, edges = 0, _edges(batch.column("text")) if batch.num_rows else None
        while at < batch.num_rows:
            full = int(np.searchsorted(edges, edges[at] + BYTES_AT_ONCE, "right")) - 1
            stop = min(max(full, at + 1), at + ROWS_AT_ONCE, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


def _symbols(batch: pa.RecordBatch, rule_symbols: Callable) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a batch's texts, one text after the other, and where each text begins."""
    column = batch.column("text")
    edges, data = _edges(column), column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[edges[0]:edges[-1]] if data else np.empty(0, np.uint8)
    symbols, counts = rule_symbols(data, edges - edges[0])
    return symbols, np.concatenate([[0], np.cumsum(counts)])


def _contexts(symbols: np.ndarray, begins: np.ndarray, window: int, gram: int) -> tuple:
    """(text, place, first, last, core hash, context hash) of every anchor."""
    rolling = Rolling(symbols)
    grams = rolling.grams(gram)
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    # Windows lie inside one text.
    place, first, last = anchors(grams, window - gram + 1,
                                 text[:max(0, len(text) - window + 1)] == text[window - 1:])
    core = grams[place]
    shape = ((place - first) * 1024 + (last - first)).astype(np.uint64)
    whole = mixed(rolling.of(first, last + window) ^ mixed(shape + np.uint64(0x51ED)))
    text = text[first]
    return text, *[x - begins[text] for x in (place, first, last)], core, whole


def anchor_rows(texts: DataFrame, rule: Rule, known: np.ndarray | None = None) -> DataFrame:
    """(key, id, core, ctx, first, last, place) of every anchor, or of those `known` lets pass."""
    sent = None if known is None else texts.sparkSession.sparkContext.broadcast(known)
    symbols, window, gram = rule.symbols, rule.window, rule.gram  # tasks need no columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            found = _contexts(*_symbols(batch, symbols), window, gram)
            if sent is not None:
                ok = bloom.passes(sent.value, found[4])
                found = [x[ok] for x in found]
            text, place, first, last, core, ctx = found
            if not len(text):
                continue
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(at), batch.column("id").take(at),
                 pa.array(core.view(np.int64)), pa.array(ctx.view(np.int64)),
                 *[pa.array(x.astype(np.int32)) for x in (first, last, place)]],
                names=["key", "id", "core", "ctx", "first", "last", "place"])

    return texts.select("key", "id", "text").mapInArrow(
        run, "key long, id long, core long, ctx long, first int, last int, place int")


def _packed(column: pa.Array) -> pa.Array:
    """Each text packed by itself: the blocks Spark packs take half as much again."""
    pack = pa.Codec("zstd", compression_level=1)
    return pa.array([pack.compress(x.as_buffer(), asbytes=True) for x in column], pa.binary())


def _of_keys(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Texts that may be in `keys`, thinned by a fixed-size filter and packed before they are
    shuffled: `unpacked` gives the batches back."""
    short = F.xxhash64("key")
    words = texts.sparkSession.sparkContext.broadcast(
        bloom.build(keys.select(short.alias("k")), "k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = bloom.passes(words.value, batch.column("short").to_numpy().view(np.uint64))
            found = batch.select(["key", "id", "text"]).filter(pa.array(ok))
            size = pc.binary_length(found.column("text")).cast(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [found.column("key"), found.column("id"), _packed(found.column("text")), size],
                names=["key", "id", "packed", "size"])

    kind = texts.schema["key"].dataType.simpleString()
    return texts.select("key", "id", "text", short.alias("short")).mapInArrow(
        run, f"key {kind}, id long, packed binary, size int")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with `text` in place of `packed` and `size`, in slices."""
    pack = pa.Codec("zstd")
    for batch in batches:
        size = batch.column("size").to_numpy().astype(np.int64)
        at, ends = 0, np.cumsum(size)
        while at < batch.num_rows:
            full = int(np.searchsorted(ends, ends[at] - size[at] + BYTES_AT_ONCE, "right"))
            stop = min(max(full, at + 1), at + ROWS_AT_ONCE, batch.num_rows)
            part = batch.slice(at, stop - at)
            texts = [pack.decompress(text.as_buffer(), int(n), asbytes=True)
                     for text, n in zip(part.column("packed"), size[at:stop])]
            yield part.drop_columns(["packed", "size"]).append_column(
                "text", pa.array(texts, pa.binary()))
            at = stop


_WANTED = "array<struct<core:bigint,rank:bigint,first:int,last:int,place:int,query:boolean>>"


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.StructArray]:
    """The contexts of a batch, one after the other, and the row of each."""
    lists = batch.column("wanted")
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten()


def _shard_rows(texts: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """The contexts `wanted` names, cut from their texts."""
    joined = _of_keys(texts, wanted).join(wanted, ["key", "id"])
    units, payload = rule.units, rule.payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches):
            row, x = _flat(batch)
            texts, cut, at, out = batch.column("text"), None, -1, []
            for own, first, last, place in zip(row.tolist(), *[
                    x.field(c).to_pylist() for c in ("first", "last", "place")]):
                if own != at:
                    cut, at = units(texts[own].as_py()), own
                out.append(payload(cut, first, last, place))
            yield pa.RecordBatch.from_arrays(
                [x.field("core"), x.field("rank"),
                 *[batch.column(c).take(pa.array(row)) for c in ("key", "id")],
                 *[x.field(c) for c in ("first", "last", "place", "query")],
                 pa.array(out, pa.binary())],
                names=["core", "rank", "key", "id", "first", "last", "place", "query", "payload"])

    return joined.select("key", "id", "packed", "size", "wanted").mapInArrow(
        run, "core long, rank long, key long, id long, first int, last int, place int, "
             "query boolean, payload binary")


def _in_shards(rows: DataFrame, shards: int, rule: Rule) -> DataFrame:
    shard = rule.shard

    def run(table: pa.Table) -> pa.Table:
        found, starts, stops = [], [], []
        data = table.select(["core", "rank", "first", "last", "place", "query", "payload"])
        contexts = list(zip(*[c.to_pylist() for c in data.columns]))
        for at, start, stop in shard(contexts):
            found.append(at)
            starts.append(start)
            stops.append(stop)
        return table.select(["key", "id"]).take(pa.array(found, pa.int64())).append_column(
            "start", pa.array(starts, pa.int32())).append_column("stop", pa.array(stops, pa.int32()))

    return (rows.withColumn("shard", F.pmod(F.xxhash64("core"), F.lit(shards)))
            .groupBy("shard").applyInArrow(run, "key long, id long, start int, stop int"))


def _one_by_one(texts: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """Repeated windows of crowded grams, by counting the hashes of single windows."""
    joined = _of_keys(texts, wanted).join(wanted, ["key", "id"])
    symbols, window = rule.symbols, rule.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches):
            row, x = _flat(batch)
            first, last, place = [x.field(c).to_numpy().astype(np.int64)
                                  for c in ("first", "last", "place")]
            number = last - first + 1
            context = np.repeat(np.arange(len(row)), number)
            start = np.arange(len(context)) + (first - np.cumsum(number) + number)[context]
            text_of = row[context]
            codes, begins = _symbols(batch, symbols)
            own = start + begins[text_of]
            code = Rolling(codes).of(own, own + window).view(np.int64)
            of = pa.array(context)
            yield pa.RecordBatch.from_arrays(
                [x.field("core").take(of), pa.array(code),
                 pa.array((place[context] - start).astype(np.int32)), x.field("rank").take(of),
                 *[batch.column(c).take(pa.array(text_of)) for c in ("key", "id")],
                 pa.array(start.astype(np.int32)), x.field("query").take(of)],
                names=["core", "code", "shift", "rank", "key", "id", "start", "query"])

    windows = joined.select("key", "id", "packed", "size", "wanted").mapInArrow(
        run, "core long, code long, shift int, rank long, key long, id long, start int, query boolean")
    # The gram, the window's hash and the gram's place in it: 128 bits and more.
    same = ["core", "code", "shift"]
    counts = windows.groupBy(*same).agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    return (windows.join(counts, same)
            .where(F.col("query") & rule.repeats(F.col("rank"), F.col("low"), F.col("high")))
            .select("key", "id", "start", (F.col("start") + rule.window).alias("stop")))


def repeated(texts: DataFrame, first_ids: DataFrame, rule: Rule) -> DataFrame:
    """(key, id, spans): for each text with repeated windows, the stretches they cover, as an array
    of [start, stop) in symbols, unmerged.

    `texts` has (key, id, text as bytes); `first_ids` has (key, id), the smallest id of each text.
    A text counts once, however many rows hold it: its copies are the caller's.
    """
    # 64 bits stand for a text here: never without its id, so only texts of one id could be confused.
    texts, names = (df.withColumns({"full": F.col("key"), "key": F.xxhash64("key")})
                    for df in (texts, first_ids))
    first_ids = names.select("key", "id")
    seen = anchor_rows(texts, rule).select("core", rule.origin.alias("origin"))
    shared = (seen.groupBy("core").agg(F.min("origin").alias("a"), F.max("origin").alias("b"))
              .where("a <> b"))
    known = bloom.build(shared, "core")
    # Read more than once below, so made once.
    rows = stored(anchor_rows(texts, rule, known))
    folded = stored(rows.withColumn("rank", rule.rank).groupBy("core", "ctx").agg(
        F.min("rank").alias("low"), F.max("rank").alias("high")))
    crowds = folded.groupBy("core").agg(F.count(F.lit(1)).alias("n"))
    state = folded.join(crowds, "core").where("n > 1 OR low <> high")
    # Copies of a text stand for it only in the row of the smallest id.
    judged = stored(
        rows.join(state, ["core", "ctx"]).withColumn("rank", rule.rank)
        .select("key", "id", "core", "first", "last", "place", "n",
                rule.repeats(F.col("rank"), F.col("low"), F.col("high")).alias("covered"),
                (F.col("rank") == F.col("low")).alias("head"))
        .where("covered OR (head AND n > 1)").join(first_ids, ["key", "id"], "left_semi"))
    spans = judged.where("covered").select(
        "key", "id", F.col("first").alias("start"), (F.col("last") + rule.window).alias("stop"))
    edges = judged.where("head AND n > 1").withColumn("rank", rule.rank)

    def wanted(part: DataFrame) -> DataFrame:
        return checkpointed(part.groupBy("key", "id").agg(F.collect_set(F.struct(
            "core", "rank", "first", "last", "place", (~F.col("covered")).alias("query")))
            .cast(_WANTED).alias("wanted")))

    few = edges.where(F.col("n") <= CROWD)
    n_few = few.count()
    if n_few:
        cut = _shard_rows(texts, wanted(few), rule)
        spans = spans.unionByName(_in_shards(cut, max(8, n_few // SHARD), rule))
    crowded = edges.where(F.col("n") > CROWD)
    if not crowded.isEmpty():
        spans = spans.unionByName(_one_by_one(texts, wanted(crowded), rule))
    return (spans.groupBy("key", "id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
            .join(names, ["key", "id"]).select(F.col("full").alias("key"), "id", "spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap joined."""
    out: list[list[int]] = []
    for start, stop in sorted((x["start"], x["stop"]) for x in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def removed(texts: DataFrame, spans: DataFrame, describe: Callable[[bytes, list], tuple],
            ddl: str) -> DataFrame:
    """(key, *ddl): what `describe(text, merged spans)` says of each text that has spans."""
    spans = checkpointed(spans)
    joined = _of_keys(texts, spans).join(spans, ["key", "id"])
    names = [x.split()[0] for x in ddl.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches):
            out = [(key, *describe(text, merged(found))) for key, text, found in zip(
                *[batch.column(c).to_pylist() for c in ("key", "text", "spans")])]
            columns = list(zip(*out)) or [[]] * (len(names) + 1)
            kind = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.binary()),
                 *[pa.array(c, kind[x.split()[1]]) for c, x in zip(columns[1:], ddl.split(","))]],
                names=["key", *names])

    return joined.select("key", "packed", "size", "spans").mapInArrow(
        run, f"key binary, {ddl}").dropDuplicates(["key"])
