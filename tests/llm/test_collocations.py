"""Phrases against plain Python, and compacted paths against the graph they stand for."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelex.llm import collocations


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    word = lambda: rng.choice(["a", "b", "Ab", "é", "É", "x\x85y", "c", "d", "\x00", "long" * 9])
    mark = lambda: rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", " . ", "!?"])
    passage = " ".join(f"p{n}" for n in range(60))
    out = []
    for n in range(150):
        text = "".join(word() + mark() for _ in range(rng.randrange(0, 60)))
        if n % 4 == 0:
            text += passage + rng.choice([".", " ", ""])
        if n % 5 == 0:
            text += " u v w" * rng.randrange(1, 20)  # a ring of edges
        if n % 6 == 0:
            text += ";" + "o " * rng.randrange(1, 30)  # an edge that follows itself
        out.append((rng.choice(["en", "fr", "und", None]), text))
    out += [("en", None), ("fr", ""), (None, None), ("xx", " \t.\n"), ("en", "a " * 30_000)]
    return out + out[:20]


def plain(rows, longest, least, percent, per_lang):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for at in range(len(words) - size + 1):
                    f[lang, tuple(words[at:at + size])] += 1
    f = {k: c for k, c in f.items() if c >= least}
    dropped = {(lang, p[i:j]) for (lang, p), c in f.items() for i in range(len(p))
               for j in range(i + 2, len(p) + 1)
               if j - i < len(p) and 100 * c >= percent * f[lang, p[i:j]]}
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and (lang, p) not in dropped:
            score, _, le, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k,
                                   f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), le, r))
    return sorted((lang, rank + 1, p.decode(), -a, le, r, n[lang], -score)
                  for lang, ps in found.items()
                  for rank, (score, a, p, le, r) in enumerate(sorted(ps)[:per_lang]))


@pytest.mark.parametrize("longest,least,percent,per_lang,chunk", [
    (4, 30, 80, 2000, 1 << 23), (4, 5, 80, 7, 50), (3, 4, 100, 2000, 1 << 23), (6, 9, 60, 40, 500)])
def test_phrases(spark, rows, monkeypatch, longest, least, percent, per_lang, chunk):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "STRETCH", 5 if chunk < 1000 else 4096)
    table = spark.createDataFrame(rows, "lang string, text string").withColumns(
        {c: F.lit("extra") for c in ("phrase", "f", "n", "size", "h", "c", "id", "score", "rank")})
    got = collocations.phrases(table.repartition(3), longest, least, percent, per_lang)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, longest, least, percent, per_lang)


def test_nothing(spark):
    for rows in ([], [("en", None)], [("en", "...")]):
        table = spark.createDataFrame(rows, "lang string, text string")
        assert collocations.report(table).collect() == []


def test_a_crowded_filter_changes_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "MAX_BITS", 64)
    table = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in collocations.report(table).collect()) == plain(
        rows, 4, 30, 80, 2000)


def test_paths_hold_every_edge_once(spark, rows):
    known, _ = collocations.counts(spark.createDataFrame(rows, "lang string, text string"), least=5)
    f = {(r.lang, r.phrase): r.f for r in known.collect()}
    made = collocations.paths(known).collect()
    edges, nodes = Counter(), set()
    for r in made:
        assert len(r.flows) == len(r.words) - 2 and len(r.weights) == len(r.flows) - 1
        for at, weight in enumerate(r.weights):
            edge = (r.lang, " ".join(r.words[at:at + 4]))
            edges[edge] += 1
            assert f[edge] == weight
        for at, flow in enumerate(r.flows):
            nodes.add((r.lang, " ".join(r.words[at:at + 3])))
            assert f[r.lang, " ".join(r.words[at:at + 3])] == flow
    assert edges == Counter({k: 1 for k in f if k[1].count(" ") == 3})
    assert nodes == {k for k in f if k[1].count(" ") == 2}
    assert max(len(r.words) for r in made) >= 60, "the passage is one path"
    assert any(sorted(set(r.words)) == ["u", "v", "w"] for r in made), "the ring is cut, not lost"
