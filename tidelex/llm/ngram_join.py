"""Similarity join of documents on word five-grams, with Bayesian pruning of candidates.

Two documents are linked when the Jaccard similarity of their sets of word `GRAM`-grams is at least
`THRESHOLD`. Rows of equal sets fold into one set first, in a map-side aggregate.

1. Every set gets `BANDS * ROWS` MinHash values. Sets that agree on all values of a band share a
   bucket; a pair at the threshold is in no common bucket with a probability of 3e-6.
2. Inside buckets, MinHash values (8 bits of each) are compared `STEP` at a time. After each step a
   pair is dropped once the posterior probability that its similarity reaches the threshold, from a
   uniform prior, is below `TOLERANCE`. Survivors give spanning links only, never all pairs, and
   connected components of these are the clusters.
3. Inside a cluster every pair is pruned in the same way and the rest verified on the gram sets
   themselves. Only sums of links and spanning links leave the task.

Buckets and clusters are cut into blocks, and pairs of blocks are dealt to shards of bounded size,
so a group of any size meets block by block. Within a block pair the work is on numpy arrays.

Words are those of `decontaminate.words_of` (letters and digits, A-Z in lower case); grams are known
by 64-bit hashes. Defined results: a text of fewer words than a gram has one gram, all its words; a
null text is empty, and texts without words equal each other and nothing else; a null id sorts last,
and a class of null ids only has a null name; repeated rows are linked like copies; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import bloom
from .common import checkpointed, components, mixed, partitions_for, text_key, text_or_empty
from .decontaminate import words_of
from .winnow import Rolling, WordHashes

GRAM = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
STEP = 16
TOLERANCE = 1e-6
#: Sets of a block of a bucket, and of a cluster; grams of a block of a cluster, on average.
BUCKET_BLOCK, CLUSTER_BLOCK, GRAM_BLOCK = 1024, 256, 2_000_000
#: Rows of a shard of buckets, grams of a shard of clusters, on average.
SHARD_ROWS, SHARD_GRAMS = 20_000, 1_000_000
#: Stands for a null id, and sorts last.
NO_ID = (1 << 63) - 1

_seeds = mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS, _SHIFTS = _seeds[::2] | np.uint64(1), _seeds[1::2]


def grams_of(text: bytes, known: WordHashes, gram: int = GRAM) -> np.ndarray:
    """The sorted distinct gram hashes of a text."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(Rolling(known.array(words)).grams(min(gram, len(words))))


def minhash(grams: np.ndarray) -> np.ndarray:
    """One minimum per hash function."""
    out = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(grams), 2048):
        values = np.multiply.outer(_FACTORS, grams[at:at + 2048]) + _SHIFTS[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, matches needed) of every step: with fewer matches, the posterior
    probability of the threshold is below `tolerance`."""
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256  # eight bits also agree by chance
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        need = 0
        for m in range(n + 1):
            weight = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(weight - weight.max())
            if weight[s >= threshold].sum() / weight.sum() >= tolerance:
                break
            need = m + 1
        out.append((n, need))
    return out


def survivors(one: np.ndarray, other: np.ndarray, needs: list[tuple[int, int]]) -> np.ndarray:
    """Places of the pairs of rows of `one` and `other` that no step drops. `one` may be one row."""
    size = len(other)
    alive, matches, at = np.arange(size), np.zeros(size, np.int64), 0
    for n, need in needs:
        left = one[:, at:n] if len(one) == 1 else one[alive, at:n]
        matches = matches + (left == other[alive, at:n]).sum(axis=1)
        ok = matches >= need
        alive, matches, at = alive[ok], matches[ok], n
        if not len(alive):
            break
    return alive


class Forest:
    """Union-find over 0..n-1, the smallest number of each tree being its root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, text) of every row, the text as bytes."""
    text = text_or_empty(F.col(text_col))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
                       text_key(text).alias("text_key"), F.encode(text, "UTF-8").alias("text"))


def _key(grams: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(grams.tobytes())


def _signed(rows: DataFrame) -> DataFrame:
    """(id, text_key, key, n, sig, buckets): key stands for the gram set, n is its size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        band = mixed(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))
        for batch in batches:
            keys, sizes, sigs, buckets = [], [], [], []
            for text in batch.column("text").to_pylist():
                grams = grams_of(text, known)
                keys.append(_key(grams))
                sizes.append(len(grams))
                if not len(grams):
                    sigs.append(b"")
                    buckets.append([])
                    continue
                values = minhash(grams)
                sigs.append((mixed(values) & np.uint64(255)).astype(np.uint8).tobytes())
                code = band
                for row in values.reshape(BANDS, ROWS).T:
                    code = mixed(code ^ row) + row
                buckets.append(code.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_key"), pa.array(keys, pa.binary()),
                 pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()),
                 pa.array(buckets, pa.list_(pa.int64()))],
                names=["id", "text_key", "key", "n", "sig", "buckets"])

    return rows.mapInArrow(run, "id long, text_key binary, key binary, n long, sig binary, "
                                "buckets array<long>")


def _tiles(rows: DataFrame, group: str, blocks: Column, shards: int) -> DataFrame:
    """`rows`, copied to each pair of blocks of its group that it belongs to, with the pair (i, j),
    i <= j, the row's own block `own`, and the shard of the pair."""
    placed = rows.withColumn("__blocks", blocks.cast("long")).withColumn(
        "own", F.pmod(F.xxhash64("key"), F.col("__blocks")))
    return (placed.withColumn("__with", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
            .withColumn("i", F.least("own", "__with")).withColumn("j", F.greatest("own", "__with"))
            .withColumn("shard", F.pmod(F.xxhash64(group, "i", "j"), F.lit(shards)))
            .drop("__blocks", "__with"))


def _groups(columns: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Row numbers of each combination of values."""
    order = np.lexsort(columns[::-1])
    change = np.zeros(len(order), bool)
    for column in columns:
        column = column[order]
        change[1:] |= column[1:] != column[:-1]
    yield from np.split(order, np.flatnonzero(change))


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def _clusters(sets: DataFrame, needs: list[tuple[int, int]]) -> DataFrame:
    """(key, cluster) of the sets that survive with another one in some bucket."""
    buckets = sets.select("key", F.explode("buckets").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    narrow = checkpointed(buckets.join(shared, "bucket"))
    tiled = _tiles(narrow.join(sets.select("key", "sig"), "key"), "bucket",
                   F.ceil(F.col("m") / F.lit(BUCKET_BLOCK)),
                   max(partitions_for(sets), narrow.count() // SHARD_ROWS))

    def run(table: pa.Table) -> pa.Table:
        sig, keys = _signatures(table.column("sig")), table.column("key").to_pylist()
        forest = Forest(len(keys))
        for rows in _groups([table.column(c).to_numpy() for c in ("bucket", "i", "j")]):
            # A set that has been reached is compared with those not reached yet.
            left = rows
            while len(left) > 1:
                waiting, left = [left[0]], left[1:]
                while waiting and len(left):
                    x = waiting.pop()
                    found = survivors(sig[x:x + 1], sig[left], needs)
                    for y in left[found].tolist():
                        forest.join(int(x), y)
                        waiting.append(y)
                    left = np.delete(left, found)
        pairs = {(keys[x], keys[forest.root(x)]) for x in range(len(keys)) if forest.up[x] != x}
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.binary()),
                         "b": pa.array([b for _, b in pairs], pa.binary())})

    edges = tiled.select("bucket", "i", "j", "shard", "key", "sig").groupBy("shard").applyInArrow(
        run, "a binary, b binary")
    return components(edges).select(F.col("node").alias("key"),
                                    F.col("component").alias("cluster"))


def passing(rows: DataFrame, column: str, words: np.ndarray, wanted: bool = True) -> DataFrame:
    """Rows whose long `column` may be in a Bloom filter, or those that cannot be."""
    sent = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(column).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(bloom.passes(sent.value, hashes) == wanted))

    return rows.mapInArrow(run, rows.schema)


def _verified(rows: DataFrame, members: DataFrame, threshold: float,
              needs: list[tuple[int, int]]) -> DataFrame:
    """(key, linked, root): rows that the other sets linked to `key` stand for, by block pair, and
    a set of the same class."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("g"))
    blocks = F.greatest(F.ceil(F.col("c") / F.lit(CLUSTER_BLOCK)),
                        F.ceil(F.col("g") / F.lit(GRAM_BLOCK)))
    placed = members.join(sizes.withColumn("blocks", blocks), "cluster")
    total = placed.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    words = bloom.build(members.select(F.xxhash64("id", "text_key").alias("k")), "k")
    texts = passing(rows.withColumn("short", F.xxhash64("id", "text_key")), "short", words)
    whole = (texts.join(placed.drop("c", "g"), ["id", "text_key"]).dropDuplicates(["key"])
             .drop("short", "id", "text_key"))
    tiled = _tiles(whole, "cluster", F.col("blocks"),
                   max(partitions_for(rows), int(total) // SHARD_GRAMS))
    part = Fraction(str(threshold))

    def run(table: pa.Table) -> pa.Table:
        known = WordHashes()
        sig, keys = _signatures(table.column("sig")), table.column("key").to_pylist()
        texts, copies = table.column("text"), table.column("copies").to_numpy()
        own = table.column("own").to_numpy()
        first, second = table.column("i").to_numpy(), table.column("j").to_numpy()
        forest, linked = Forest(len(keys)), np.zeros(len(keys), np.int64)
        codes = {c: n for n, c in enumerate(set(table.column("cluster").to_pylist()))}
        cluster = np.asarray([codes[c] for c in table.column("cluster").to_pylist()])
        for members in _groups([cluster, first, second]):
            sets = [grams_of(texts[int(x)].as_py(), known) for x in members]
            lengths = np.asarray([len(s) for s in sets])
            ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
            split = np.split(ids, np.cumsum(lengths)[:-1])
            mark = np.zeros(len(ids), np.int64)
            diagonal = first[members[0]] == second[members[0]]
            left = own[members] == first[members]
            for x in range(len(members)):
                if not left[x]:
                    continue
                others = (np.arange(x + 1, len(members)) if diagonal
                          else np.flatnonzero(~left))
                others = others[survivors(sig[members[x]:members[x] + 1], sig[members[others]],
                                          needs)]
                if not len(others):
                    continue
                mark[split[x]] = 1
                starts = np.r_[0, np.cumsum(lengths[others])[:-1]]
                common = np.add.reduceat(mark[np.concatenate([split[y] for y in others])], starts)
                mark[split[x]] = 0
                union = lengths[x] + lengths[others] - common
                others = others[common * part.denominator >= union * part.numerator]
                linked[members[x]] += copies[members[others]].sum()
                linked[members[others]] += copies[members[x]]
                for y in members[others].tolist():
                    forest.join(int(members[x]), y)
        out = np.flatnonzero(linked)
        return pa.table({"key": pa.array([keys[x] for x in out], pa.binary()),
                         "linked": pa.array(linked[out]),
                         "root": pa.array([keys[forest.root(int(x))] for x in out], pa.binary())})

    return tiled.groupBy("shard").applyInArrow(run, "key binary, linked long, root binary")


def _classes(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, key, n, class, class_id, class_rows, n_links) of every row."""
    needs = least_matches(threshold)
    rows = _rows(docs, id_col, text_col)
    signed = checkpointed(_signed(rows))
    first = F.min(F.struct("id", "text_key"))
    sets = checkpointed(signed.groupBy("key").agg(
        first.alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"),
        F.max("sig").alias("sig"), F.first("buckets").alias("buckets"))
        .select("key", "first.id", "first.text_key", "copies", "n", "sig", "buckets"))
    clusters = _clusters(sets, needs)
    members = checkpointed(sets.drop("buckets").join(clusters, "key"))
    found = checkpointed(_verified(rows, members, threshold, needs))
    links = found.groupBy("key").agg(F.sum("linked").alias("linked"))
    named = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    judged = checkpointed(
        sets.select("key", "id", "copies")
        .join(named.select(F.col("node").alias("key"), "component"), "key", "left")
        .join(links, "key", "left")
        .select("key", "id", "copies", F.coalesce("component", "key").alias("class"),
                (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    names = judged.groupBy("class").agg(F.min("id").alias("class_id"),
                                        F.sum("copies").alias("class_rows"))
    return signed.select("id", "text_key", "key", "n").join(
        judged.select("key", "class", "n_links").join(names, "class"), "key")


def report(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, n_grams) of every row: class_id is the smallest id of the rows
    that links connect, n_links the number of other rows whose texts are similar enough."""
    return _classes(docs, threshold, id_col, text_col).select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"),
        F.nullif("class_id", F.lit(NO_ID)).alias("class_id"), "n_links",
        F.col("n").alias("n_grams"))


def without_near_copies(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """`docs` with one row of each class, that of the smallest id. Rows of no class are not moved."""
    grouped = checkpointed(_classes(docs, threshold, id_col, text_col).where("class_rows > 1")
                           .select("id", "text_key", "class"))
    kept = grouped.groupBy("class").agg(F.min(F.struct("id", "text_key")).alias("k")).select(
        "k.id", "k.text_key", F.lit(True).alias("keep"))
    states = (grouped.select("id", "text_key").distinct().join(kept, ["id", "text_key"], "left")
              .select(F.col("id").alias("__id"), F.col("text_key").alias("__key"),
                      F.coalesce("keep", F.lit(False)).alias("__keep")))
    words = bloom.build(grouped.select(F.xxhash64("id", "text_key").alias("k")), "k")
    text = text_or_empty(F.col(text_col))
    marked = (docs.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)))
              .withColumn("__key", text_key(text))
              .withColumn("__short", F.xxhash64("__id", "__key")))
    alone = passing(marked, "__short", words, wanted=False).select(*docs.columns)
    chosen = (passing(marked, "__short", words).join(states, ["__id", "__key"], "left")
              .where(F.coalesce("__keep", F.lit(True))).dropDuplicates(["__id", "__key"])
              .select(*docs.columns))
    return alone.unionByName(chosen)
