"""Hard negatives against all pairs in plain Python, and the bounds against exact scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelex.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    out = []
    for n in range(500):
        centre = rng.choice(centres)
        out.append((n, [c + rng.gauss(0, 0.05) for c in centre], rng.randrange(4)))
    # Ties, copies of a vector under other ids, repeated rows, an anchor twice.
    out += [(1000 + n, out[7][1], n % 3) for n in range(40)] + [out[100], out[100], out[33], out[33]]
    out += [(2000, None, 1), (2001, [], 1), (2002, [0.5, None], 1), (2003, [math.nan] * 6, 1),
            (2004, [math.inf] * 6, 2), (2005, [0.5] * 6, None), (None, [0.25] * 6, 1),
            (None, [0.25] * 6, 2), (2100, [0.0] * 6, 1), (2200, [0.5], 2), (2300, [0.5] * 9, 3),
            (-100, [-0.1] * 6, 0)]
    return [(i, v and [None if x is None else float(np.float32(x)) for x in v], y)
            for i, v, y in out]


def plain(rows):
    clean = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        clean.append((i, label, [math.floor(256 * x) for x in v]))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for n, (i, label, v) in enumerate(clean):
        if i is None or i % 100:
            continue
        scores = [(sum(a * b for a, b in zip(v, w)), j, other)
                  for m, (j, other, w) in enumerate(clean) if m != n]
        for positive, j, _ in sorted((s for s in scores if s[2] == label), key=order)[:5]:
            far = [s for s in scores if s[2] != label
                   and 80 * positive <= 100 * s[0] <= 100 * positive]
            out += [(i, j, at + 1, k, positive, negative) for at, (negative, k, _) in
                    enumerate(sorted(far, key=order)[:5])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("blocks", [(1024, 2048), (2, 50)])
def test_against_all_pairs(spark, rows, monkeypatch, blocks):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", blocks[0])
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", blocks[1])
    table = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit("extra") for c in ("id", "n", "x", "anchor", "place", "score", "rank", "g", "s")})
    assert got(hard_negatives.report(table)) == plain(rows)


def test_nothing_and_no_anchor(spark, rows):
    assert got(hard_negatives.report(spark.createDataFrame([], SCHEMA))) == []
    none = [r for r in rows if r[0] is None or r[0] % 100]
    assert got(hard_negatives.report(spark.createDataFrame(none, SCHEMA))) == []


def test_components_out_of_range_are_an_error(spark):
    table = spark.createDataFrame([(100, [1e30], 1), (101, [1.0], 1)], SCHEMA)
    with pytest.raises(Exception, match="32 bits"):
        hard_negatives.report(table).collect()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 100, (4, 16))
    points = np.floor(np.repeat(centres, 30, axis=0) + rng.normal(0, 2, (120, 16)))
    rows = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(0, 20, (400, 16)))
    exact = rows @ points.T
    scored = 0

    def needed(anchor, low, high):
        assert (low <= exact[:, anchor]).all() and (exact[:, anchor] <= high).all()
        return high >= np.sort(exact[:, anchor])[-20]

    for anchor, chosen, scores in hard_negatives.walk(points, rows, needed):
        assert (scores == exact[chosen, anchor]).all()
        assert set(np.argsort(exact[:, anchor])[-20:]) <= set(chosen) or anchor == 0
        scored += len(chosen)
    assert scored < 0.5 * exact.size
    tree = hard_negatives.spanning_tree(points)
    assert sorted(a for a, _, _ in tree) == list(range(120))
    # Long edges only join the four clusters.
    assert sum(edge > 50 for _, _, edge in tree) == 3


def test_whole_numbers_beyond_floats():
    points = np.array([[2.0 ** 29 + 1, 3.0]])
    rows = np.array([[2.0 ** 29 + 3, 7.0]])
    (_, _, scores), = hard_negatives.walk(points, rows, None)
    assert scores.tolist() == [(2 ** 29 + 1) * (2 ** 29 + 3) + 21]
    with pytest.raises(ValueError):
        list(hard_negatives.walk(points * 4, rows * 4, None))
