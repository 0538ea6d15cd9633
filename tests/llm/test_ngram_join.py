"""The similarity join against all pairs, in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidelex.llm import ngram_join
from tidelex.llm.common import components
from tidelex.llm.decontaminate import words_of


def sets_of(text):
    words = words_of((text or "").encode())
    size = min(5, len(words))
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1) if size)


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * union:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    names = {}
    for a, (i, _) in enumerate(rows):
        names.setdefault(root(a), []).append(i)
    names = {r: min((i for i in ids if i is not None), default=None) for r, ids in names.items()}
    return [(i, names[root(a)], links[a], len(sets[a])) for a, (i, _) in enumerate(rows)]


def fixture():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    shared = [word() for _ in range(40)]
    texts = []
    for _ in range(60):
        texts.append([word() for _ in range(rng.randrange(6, 120))])
    for _ in range(30):  # a passage that many hold
        texts.append(shared + [word() for _ in range(rng.randrange(2, 60))])
    for base in list(texts[:40]):  # near copies at many distances
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    base = [word() for _ in range(200)]
    for _ in range(90):  # one large group, and a chain
        copy = list(base)
        copy[rng.randrange(200)] = word()
        texts.append(copy)
    for at in range(12):
        texts.append(base[at * 4:] + [word() for _ in range(at * 4)])
    rows = [(n * 3 + 1, " ".join(t)) for n, t in enumerate(texts)]
    rows += [(2, None), (5, ""), (8, "...  !"), (11, "One two"), (14, "one TWO"), (17, "one two three"),
             (None, "nothing but this line here is known"), (None, "nothing but this line here is known"),
             rows[0], rows[0], (20, " ".join(word() for _ in range(30_000)))]
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_join_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", block)
    monkeypatch.setattr(ngram_join, "CLUSTER_BLOCK", block)
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("extra"))
    got = sorted((tuple(r) for r in ngram_join.report(docs).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


def test_one_row_of_each_class_stays(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn(
        "key", F.lit(1)).withColumn("class", F.lit("x"))
    kept = ngram_join.without_near_copies(docs)
    assert kept.columns == docs.columns
    classes = {}
    for (i, t), (_, name, links, _) in zip(rows, brute(rows)):
        if links:
            classes.setdefault(name, set()).add((i, t))
    alone = [(i, t) for (i, t), x in zip(rows, brute(rows)) if not x[2]]
    out = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(out) == len(alone) + len(classes)
    assert set(alone) <= set(out)
    for name, held in classes.items():
        assert [x for x in out if x in held and x[0] == name]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.report(docs).collect() == []
    assert ngram_join.without_near_copies(docs).collect() == []


def test_components_of_paths_and_forks(spark):
    rng = random.Random(3)
    for n, m in ((60, 45), (200, 150), (40, 39)):
        edges = ([(i + 1, i) for i in range(39)] if m == 39 else
                 [(rng.randrange(n), rng.randrange(n)) for _ in range(m)])
        up = {x: x for e in edges for x in e}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            x, y = sorted((root(a), root(b)))
            up[y] = x
        got = components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in up)


def test_pruning_keeps_what_can_reach_the_threshold():
    needs = ngram_join.least_matches(0.8)
    assert needs[-1][0] == 96 and 40 < needs[-1][1] < 77
    assert all(a[1] <= b[1] for a, b in zip(needs, needs[1:]))
