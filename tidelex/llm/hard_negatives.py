"""Hard negatives for contrastive training, with bounds along a spanning tree of the anchors.

Scores are inner products of integer vectors. For anchors a and b and any row c,
|<a, c> - <b, c>| <= |a - b| * |c|: a score at one anchor bounds the score at a near one. The anchors
of a block are joined by a minimum spanning tree, which makes those distances as short as they can be.
A block of rows walks the tree from its root. At each anchor a row has an interval, its parent's
interval widened by edge length times row norm, and only rows whose interval meets what the anchor
still looks for are scored; for them the interval shrinks to a point again.

The walk runs twice. First an anchor looks for rows of its own label at or above the worst positive
it holds. The positives fix one window of scores each; then it looks for rows of other labels inside
a window, at or above the worst negative it holds there. What a block returns is at most the wanted
number of rows per anchor (and positive), so merging is a small top-k.

The anchors are a stated query set against all rows, in blocks: each block of anchors meets each block
of rows in one group of bounded size, dealt by row number, so copies and labels make no hot group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import checkpointed, row_key

ANCHOR_BLOCK = 1024
ROW_BLOCK = 2048

_FOUND = "anchor long, place int, score long, id long, n long"


# -- inside one group of anchors and rows


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of a matrix; shorter ones end in zeros."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    if len(sizes) and sizes.min() == width:
        return values.reshape(len(sizes), width).astype(np.float64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, np.arange(len(values)) - starts] = values
    return out


def _width(*tables: pa.Table) -> int:
    return max(int(t["x"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
                   .max(initial=0)) for t in tables)


def spanning_tree(points: np.ndarray) -> list[tuple[int, int, float]]:
    """(point, parent, distance) of a minimum spanning tree, parents first; the root has parent -1."""
    if not len(points):
        return []
    squares = (points * points).sum(axis=1)
    apart = np.maximum(squares[:, None] + squares[None, :] - 2 * points @ points.T, 0)
    out, parent = [(0, -1, 0.0)], np.zeros(len(points), int)
    best = apart[0].copy()
    best[0] = np.inf
    for _ in range(len(points) - 1):
        at = int(np.argmin(best))
        out.append((at, int(parent[at]), float(np.linalg.norm(points[at] - points[parent[at]]))))
        closer = (apart[at] < best) & (best < np.inf)
        best[closer], parent[closer] = apart[at][closer], at
        best[at] = np.inf
    return out


def _exact(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrices in a type whose inner products are exact."""
    longest = max(((m * m).sum(axis=1).max(initial=0.0) for m in (points, rows)))
    if longest < 2.0 ** 52:
        return points, rows
    if longest < 2.0 ** 61:
        return points.astype(np.int64), rows.astype(np.int64)
    raise ValueError("a score of these vectors may not fit 64 bits")


def walk(points: np.ndarray, rows: np.ndarray,
         needed: Callable[[int, np.ndarray, np.ndarray], np.ndarray]
         ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (anchor, rows scored, their scores), in tree order.

    `needed(anchor, low, high)` marks the rows whose score, which lies in [low, high], matters; it is
    asked after the rows of the anchor before were handed out.
    """
    tree = spanning_tree(points)
    points, rows = _exact(points, rows)
    norms = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
    middle, slack = np.zeros((2, len(points), len(rows)))
    for anchor, parent, edge in tree:
        if parent < 0:
            low, high = np.full((2, len(rows)), -np.inf)
            high = -low
            chosen = np.arange(len(rows))  # the root's scores are what all bounds start from
        else:
            middle[anchor] = middle[parent]
            # Rounding of norms and distances stays far below the margin.
            slack[anchor] = slack[parent] + edge * norms * (1 + 1e-9) + 1e-3
            low, high = middle[anchor] - slack[anchor], middle[anchor] + slack[anchor]
            chosen = np.flatnonzero(needed(anchor, low, high))
        if 4 * len(chosen) > len(rows):
            scores = (rows @ points[anchor])[chosen]
        else:
            scores = rows[chosen] @ points[anchor]
        middle[anchor, chosen], slack[anchor, chosen] = scores, 0
        yield anchor, chosen, scores.astype(np.int64)


class _Best:
    """The first k rows by score, then by rank, for each of several places."""

    def __init__(self, places: int, k: int, ranks: np.ndarray):
        self.k, self.ranks = k, ranks
        self.rows = [np.empty(0, int)] * places
        self.scores = [np.empty(0, np.int64)] * places

    def least(self, place: int) -> float:
        return self.scores[place][-1] if len(self.scores[place]) == self.k else -np.inf

    def add(self, place: int, rows: np.ndarray, scores: np.ndarray) -> None:
        rows, scores = np.r_[self.rows[place], rows], np.r_[self.scores[place], scores]
        if len(rows) > self.k:
            keep = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            rows, scores = rows[keep], scores[keep]
        order = np.lexsort((self.ranks[rows], -scores))[:self.k]
        self.rows[place], self.scores[place] = rows[order], scores[order]


def _ranks(rows: pa.Table) -> np.ndarray:
    """Places of the rows in the order of ties: by id, nulls last, then by row number."""
    ids = rows["id"]
    order = np.lexsort((rows["n"].to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy()))
    out = np.empty(len(order), int)
    out[order] = np.arange(len(order))
    return out


def _found(anchors: pa.Table, rows: pa.Table, best: list[_Best]) -> pa.Table:
    n = anchors["n"].to_numpy()
    parts = [(n[a], p, b.rows[p], b.scores[p]) for a, b in enumerate(best)
             for p in range(len(b.rows)) if len(b.rows[p])]
    taken = np.concatenate([p[2] for p in parts]) if parts else np.empty(0, int)
    counts = [len(p[2]) for p in parts]
    return pa.table({
        "anchor": pa.array(np.repeat([p[0] for p in parts], counts).astype(np.int64)),
        "place": pa.array(np.repeat([p[1] for p in parts], counts).astype(np.int32)),
        "score": pa.array(np.concatenate([p[3] for p in parts]) if parts
                          else np.empty(0, np.int64)),
        "id": rows["id"].take(pa.array(taken)).combine_chunks(),
        "n": rows["n"].take(pa.array(taken)).combine_chunks()})


def _positives(k: int):
    def search(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        width = _width(anchors, rows)
        ranks = _ranks(rows)
        labels, numbers = rows["label"].to_numpy(), rows["n"].to_numpy()
        own, self_ = anchors["label"].to_numpy(), anchors["n"].to_numpy()
        best = [_Best(1, k, ranks) for _ in own]

        def wanted(anchor):
            return (labels == own[anchor]) & (numbers != self_[anchor])

        def needed(anchor, low, high):
            return wanted(anchor) & (high >= best[anchor].least(0))

        for anchor, chosen, scores in walk(_matrix(anchors["x"], width), _matrix(rows["x"], width),
                                           needed):
            fits = wanted(anchor)[chosen]
            best[anchor].add(0, chosen[fits], scores[fits])
        return _found(anchors, rows, best)

    return search


def _negatives(k: int, low_percent: int, high_percent: int):
    def search(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        width = _width(anchors, rows)
        ranks, labels = _ranks(rows), rows["label"].to_numpy()
        own = anchors["label"].to_numpy()
        # Windows in hundredths of a score, so that the comparison stays in whole numbers.
        windows = [[(low_percent * int(s), high_percent * int(s)) for s in scores]
                   for scores in anchors["positives"].to_pylist()]
        best = [_Best(len(w), k, ranks) for w in windows]

        def needed(anchor, low, high):
            some = np.zeros(len(labels), bool)
            for place, (bottom, top) in enumerate(windows[anchor]):
                some |= ((high >= max(bottom / 100, best[anchor].least(place)) - 1)
                         & (low <= top / 100 + 1))
            return some & (labels != own[anchor])

        for anchor, chosen, scores in walk(_matrix(anchors["x"], width), _matrix(rows["x"], width),
                                           needed):
            others = labels[chosen] != own[anchor]
            chosen, scores = chosen[others], scores[others]
            for place, (bottom, top) in enumerate(windows[anchor]):
                # -(-b // 100) is the smallest whole score at or above b hundredths.
                fits = (scores >= -(-bottom // 100)) & (scores <= top // 100)
                if fits.any():
                    best[anchor].add(place, chosen[fits], scores[fits])
        return _found(anchors, rows, best)

    return search


# -- over all blocks


def _meet(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, search) -> DataFrame:
    """`search` over every pair of an anchor block and a row block."""
    groups, shards = -(-n_anchors // ANCHOR_BLOCK), -(-n_rows // ROW_BLOCK)

    def block(count):
        return F.pmod(F.xxhash64("n"), F.lit(count)).cast("int")

    def each(count):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    # New names for the same columns: both sides come from one table.
    left = anchors.toDF(*anchors.columns).withColumn("g", block(groups)).withColumn("s", each(shards))
    right = rows.withColumn("s", block(shards)).withColumn("g", each(groups))
    return left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(search, _FOUND)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k rows of each place, numbered in `rank`."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "n")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, low_percent: int = 80,
         high_percent: int = 100) -> DataFrame:
    """Hard negatives of the rows of (id, label, x, anchor): x is a list of whole numbers of at most
    32 bits, anchor marks the anchors.

    A row's score at an anchor is the inner product of their x; the lists may differ in length, what
    is missing counts as 0. Higher scores come first, ties by id (nulls last). An anchor's positives
    are its first `positives` other rows of the same label. For each, the first `negatives` rows of
    other labels are returned whose score lies between `low_percent` and `high_percent` of the
    positive's; a positive with none has no row. Repeated rows each count, so a copy of an anchor is
    one of its other rows, and repeated anchors are answered each. An empty table, or one without
    anchors, gives no rows. Scores beyond 64 bits are an error.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = row_key(rows.select("id", F.col("label").cast("long").alias("label"), "x",
                               F.coalesce("anchor", F.lit(False)).alias("anchor")), "n")
    counted = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    n_rows, n_anchors = max(counted[0], 1), max(counted[1], 1)
    anchors = rows.where("anchor").select("n", "label", "x")
    pool = rows.select("n", "id", "label", "x")

    near = checkpointed(_first(_meet(anchors, pool, n_anchors, n_rows, _positives(positives)),
                               ["anchor"], positives))
    held = near.groupBy(F.col("anchor").alias("n")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"])
        .alias("positives"))
    far = _first(_meet(anchors.join(held, "n"), pool, n_anchors, n_rows,
                       _negatives(negatives, low_percent, high_percent)),
                 ["anchor", "place"], negatives)
    return (far.select("anchor", F.col("place") + 1, "rank", F.col("id").alias("negative_id"),
                       F.col("score").alias("negative_score"))
            .toDF("anchor", "at", "rank", "negative_id", "negative_score")
            .join(near.select("anchor", F.col("rank").alias("at"), F.col("id").alias("positive_id"),
                              F.col("score").alias("positive_score")), ["anchor", "at"])
            .join(rows.where("anchor").select(F.col("n").alias("anchor"),
                                              F.col("id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                    "negative_score"))


# -- the registered query


def report(embeddings: DataFrame) -> DataFrame:
    """The contract's rows of `embeddings` (vec_id, embedding, label).

    Rows with a null label, a null vector, or a null or non-finite component take no part. A null
    vec_id is no anchor. Components of 2^23 or more would not fit 32 bits and are an error.
    """
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v)
                      & (F.abs(v) < F.lit(float("inf"))))
    whole = lambda v: F.when(
        F.abs(v) < 2.0 ** 23, F.floor(v.cast("double") * 256).cast("int")).otherwise(
        F.raise_error(F.lit("a component does not fit 32 bits")).cast("int"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
                .select(F.col("vec_id").cast("long").alias("id"), label.alias("label"),
                        F.transform("embedding", whole).alias("x"),
                        (F.col("vec_id") % 100 == 0).alias("anchor")))


ORACLE_SQL = """
WITH clean AS (
  SELECT row_number() OVER () AS n, vec_id AS id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * v::DOUBLE) AS BIGINT) for v in embedding] AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([v for v in embedding if v IS NULL OR NOT isfinite(v)]) = 0),
scores AS (
  SELECT a.n AS anchor, a.id AS anchor_id, c.id, c.n, c.label = a.label AS same,
    CAST(coalesce(list_sum([a.x[i] * coalesce(c.x[i], 0) for i in range(1, len(a.x) + 1)]), 0)
         AS BIGINT) AS score
  FROM clean a JOIN clean c ON a.n <> c.n WHERE a.id % 100 = 0),
near AS (
  SELECT anchor, anchor_id, n AS positive, id AS positive_id, score AS positive_score FROM scores
  WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id, n) <= 5)
SELECT near.anchor_id, positive_id, CAST(row_number() OVER per AS INTEGER) AS rank,
       s.id AS negative_id, positive_score, s.score AS negative_score
FROM near JOIN scores s ON s.anchor = near.anchor AND NOT s.same
  AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW per AS (PARTITION BY near.anchor, positive ORDER BY s.score DESC, s.id, s.n)
QUALIFY row_number() OVER per <= 5"""
