"""Collocated phrases from a weighted de Bruijn graph of words.

A position of a piece is counted once, as the longest gram that starts there (four words, fewer where
the piece ends). Grams of full length are the edges of the graph, between nodes of one word less that
overlap; shorter ones are what ends at a piece's end. The count of a node is the weight of its edges
out plus the ends at it, and so on down to single words, so only the longest grams are counted in the
texts.

A frequent gram has frequent pairs only. Pairs are counted first, as 64-bit hashes; the filter of the
frequent ones cuts the windows, and so keeps the rare grams, nearly all of a corpus, out of the second
shuffle. Hashes and filter only let more through: what is counted is the text of the grams, exactly.

Unary paths of the frequent graph, the interiors of which have one edge in and one out, are compacted
to one row by pointer doubling. Such a row gives its shorter phrases the largest count among the
longer ones that hold them, with one row per phrase of the path instead of one per phrase and edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelex.session import stored

from .common import checkpointed, mixed, row_key, text_or_empty
from .url_filter import LOWER, UPPER, filter_of, passes

LONGEST = 4
LEAST = 30
INSIDE_PERCENT = 80
PER_LANG = 2000

#: Bytes of text whose words are held as objects at once.
CHUNK = 1 << 21
#: Bits of the broadcast filter of frequent words and pairs: 16 a piece, at most 16 MB. A fuller one
#: lets rare grams into the second shuffle, which stays below one row per word.
MAX_BITS = 1 << 27
#: Edges of a path that are held in one row; a longer path goes on in the next row.
STRETCH = 4096
#: Copies of each count that a cut phrase's parts are looked up in: a very common word is a part of
#: very many phrases.
SALTS = 16

_END = b"\xff"  # never a byte of UTF-8
_TABLE = bytes.maketrans(UPPER.encode() + b".,;:!?\n\x0b\x0c\r\t",
                         LOWER.encode() + _END * 10 + b" ")


# -- words of a batch


def _chunks(texts: pa.Array, order: np.ndarray) -> Iterator[bytes]:
    """Folded texts with `_END` between pieces, joined up to about CHUNK bytes; longer texts are cut
    between pieces. Few texts at once leave the Arrow batch."""
    held: list[bytes] = []
    size = 0
    for at in range(0, len(order), 64):
        for text in texts.take(pa.array(order[at:at + 64])).cast(pa.large_binary()).to_pylist():
            text = text.translate(_TABLE)
            start = 0
            while len(text) - start > CHUNK:
                cut = text.find(_END, start + CHUNK)
                if cut < 0:
                    break
                yield text[start:cut]
                start = cut + 1
            held.append(text[start:] if start else text)
            size += len(held[-1])
            if size > CHUNK:
                yield _END.join(held)
                held, size = [], 0
    if held:
        yield _END.join(held)


def _words(chunk: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Word numbers of a chunk, -1 between pieces, and the words."""
    tokens = chunk.replace(_END, b" \xff ").split(b" ")
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    words = coded.dictionary.to_pylist()
    renumbered = np.empty(len(words), np.int64)
    kept: list[bytes] = []
    for at, word in enumerate(words):
        if word == _END:
            renumbered[at] = -1
        elif word == b"":
            renumbered[at] = -2
        else:
            renumbered[at] = len(kept)
            kept.append(word)
    ids = renumbered[coded.indices.to_numpy()]
    return ids[ids > -2], kept


def _word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(0x9E3779B97F4A7C15) + mixed(second + np.uint64(1)))


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        for at, lang in enumerate(langs.dictionary.to_pylist()):
            chosen = np.flatnonzero(langs.indices.to_numpy() == at)
            for chunk in _chunks(batch.column("text"), chosen):
                ids, words = _words(chunk)
                if len(words):
                    yield lang, ids, words


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes and counts of the words and the pairs of words."""
    for lang, ids, words in _by_lang(batches):
        hashes = _word_hashes(words, lang)
        joined = (ids[:-1] >= 0) & (ids[1:] >= 0)
        pairs, counts = np.unique(ids[:-1][joined] * len(words) + ids[1:][joined],
                                  return_counts=True)
        h = np.r_[hashes, _pair_hashes(hashes[pairs // len(words)], hashes[pairs % len(words)])]
        c = np.r_[np.bincount(ids[ids >= 0], minlength=len(words)), counts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])


def _windows(bloom, longest: int):
    """(lang, phrase, size, c): the longest gram at each position that is cut nowhere by a rare pair,
    and all words of the language as size 0."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, words in _by_lang(batches):
            hashes = _word_hashes(words, lang)
            often = passes(0, bloom.value, hashes, hashes)
            spots = np.flatnonzero(ids >= 0)
            codes = ids[spots]
            total = len(spots)
            spots = spots[often[codes]]
            padded = np.r_[ids, np.full(longest, -1)]
            size = np.ones(len(spots), np.int64)
            code = padded[spots]  # numbers of the windows so far, dense within their size
            yield _rows(lang, [b""], np.array([total]), 0)
            names = words
            for n in range(1, longest + 1):
                counts = np.bincount(code, minlength=len(names))
                if n < longest:
                    last, following = padded[spots + n - 1], padded[spots + n]
                    goes_on = following >= 0
                    goes_on[goes_on] = often[following[goes_on]]
                    pair = _pair_hashes(hashes[last[goes_on]], hashes[following[goes_on]])
                    goes_on[goes_on] = passes(0, bloom.value, pair, pair)
                    counts = counts - np.bincount(code[goes_on], minlength=len(names))
                held = np.flatnonzero(counts)
                yield _rows(lang, [names[at] for at in held], counts[held], n)
                if n == longest or not goes_on.any():
                    break
                spots = spots[goes_on]
                grown, code = np.unique(code[goes_on] * len(words) + padded[spots + n],
                                        return_inverse=True)
                names = [names[g // len(words)] + b" " + words[g % len(words)]
                         for g in grown.tolist()]

    return windows


def _rows(lang: str, phrases: list[bytes], counts: np.ndarray, size: int) -> pa.RecordBatch:
    n = len(phrases)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * n, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()),
         pa.array(np.full(n, size, np.int32)), pa.array(counts.astype(np.int64))],
        names=["lang", "phrase", "size", "c"])


# -- counts


def _first_words(phrase: str, n: int) -> Column:
    return F.substring_index(phrase, " ", n)


def counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of up to `longest` words with f >= `least`, and
    (lang, n)."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                        text_or_empty(F.col("text")).alias("text"))
    often = checkpointed(texts.mapInArrow(_pairs, "h long, c long").groupBy("h")
                         .agg(F.sum("c").alias("c")).where(F.col("c") >= least)
                         .select(F.col("h").alias("h1"), F.col("h").alias("h2")))
    bits = min(MAX_BITS, 1 << max(10, (16 * often.count()).bit_length()))
    bloom = docs.sparkSession.sparkContext.broadcast(filter_of(often, 0, bits, 4))

    counted = checkpointed(
        texts.mapInArrow(_windows(bloom, longest), "lang string, phrase string, size int, c long")
        .groupBy("lang", "phrase", "size").agg(F.sum("c").alias("f")))
    level = counted.where(F.col("size") == longest)
    levels = [level]
    for n in range(longest - 1, 0, -1):
        # Flow out of the node, and what ends at it.
        level = checkpointed(
            level.select("lang", _first_words("phrase", n).alias("phrase"), "f")
            .unionByName(counted.where(F.col("size") == n).select("lang", "phrase", "f"))
            .groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
            .select("lang", "phrase", F.lit(n).alias("size"), "f"))
        levels.append(level)
    known = levels[0]
    for level in levels[1:]:
        known = known.unionByName(level)
    return (checkpointed(known.where(F.col("f") >= least)),
            counted.where("size = 0").select("lang", F.col("f").alias("n")))


# -- compaction


def _heads(edges: DataFrame) -> DataFrame:
    """(id, head, steps): the first edge of each edge's unary path and the distance to it.

    An edge points at the one before it where their common node has no other edge. Pointers double:
    after round r they reach 2^r edges back, so rounds grow with the logarithm of the longest path.
    A ring has no first edge; its smallest one is made that.
    """
    into = edges.groupBy("lang", F.col("to").alias("node")).agg(
        F.count(F.lit(1)).alias("n_in"), F.min("id").alias("before"))
    out = edges.groupBy("lang", F.col("from").alias("node")).agg(
        F.count(F.lit(1)).alias("n_out"), F.min("id").alias("id"))
    links = stored(into.where("n_in = 1").join(out.where("n_out = 1"), ["lang", "node"])
                         .where("before <> id").select("id", "before"))
    while True:
        start = edges.select("id").join(links, "id", "left").select(
            "id", F.coalesce("before", "id").alias("head"),
            F.col("before").isNotNull().cast("long").alias("steps"),
            F.least("id", F.coalesce("before", "id")).alias("low"),
            F.col("before").isNull().alias("done"))
        hops = stored(start)
        open_ = n_links = hops.where("NOT done").count()
        reach = 1
        while open_ and reach <= 2 * n_links:
            there = hops.select(F.col("id").alias("head"), F.col("head").alias("head2"),
                                F.col("steps").alias("steps2"), F.col("low").alias("low2"),
                                F.col("done").alias("done2"))
            # The ends of open pointers differ, so this is one row to one row.
            further = hops.where("NOT done").join(there, "head").select(
                "id", F.col("head2").alias("head"), (F.col("steps") + F.col("steps2")).alias("steps"),
                F.least("low", "low2").alias("low"), F.col("done2").alias("done"))
            hops = stored(hops.where("done").unionByName(further))
            open_, reach = hops.where("NOT done").count(), 2 * reach
        if not open_:
            return hops.select("id", "head", "steps")
        cut = hops.where("NOT done AND low = id").select("id")
        links = stored(links.join(cut, "id", "left_anti"))


def paths(known: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Compacted unary paths of the graph of `known` (as `counts` returns it): lang, words, flows (of
    its nodes), weights (of its edges, one less). Nodes without edges are paths of their own."""
    grams, nodes = (known.where(F.col("size") == n).select("lang", "phrase", "f")
                    for n in (longest, longest - 1))
    edges = row_key(grams.select(
        "lang", "phrase", F.col("f").alias("weight"),
        _first_words("phrase", longest - 1).alias("from"),
        F.substring_index("phrase", " ", 1 - longest).alias("to")), "id")
    flow = nodes.select("lang", F.col("phrase").alias("node"), F.col("f").alias("flow"))
    ends = edges.select("id", "lang", "phrase", "weight", "from", "to")
    for end in ("from", "to"):
        ends = ends.join(flow.toDF("lang", end, f"{end}_flow"), ["lang", end])
    row = F.col("steps")
    held = (ends.join(_heads(edges), "id")
            .groupBy("lang", "head", F.floor(row / STRETCH).alias("stretch"))
            .agg(F.array_sort(F.collect_list(F.struct(
                "steps", "phrase", "weight", "from_flow", "to_flow"))).alias("es")))
    first = F.col("es")[0]
    made = held.select(
        "lang",
        F.concat(F.split(first["phrase"], " "), F.transform(
            F.slice("es", 2, F.size("es")), lambda e: F.substring_index(e["phrase"], " ", -1)))
        .alias("words"),
        F.concat(F.array(first["from_flow"]), F.transform("es", lambda e: e["to_flow"]))
        .alias("flows"),
        F.transform("es", lambda e: e["weight"]).alias("weights"))
    touched = edges.select("lang", F.col("from").alias("phrase")).unionByName(
        edges.select("lang", F.col("to").alias("phrase")))
    alone = nodes.join(touched, ["lang", "phrase"], "left_anti").select(
        "lang", F.split("phrase", " ").alias("words"), F.array("f").alias("flows"),
        F.array().cast("array<bigint>").alias("weights"))
    return made.unionByName(alone)


def _around(paths: DataFrame, values: str, size: int) -> DataFrame:
    """(lang, phrase, longer): each phrase of `size` words of a path with the larger of the one or two
    `values` of the phrases one word longer around it."""
    value = F.col(values)
    made = F.transform(F.sequence(F.lit(1), F.size(value) + 1), lambda i: F.struct(
        F.array_join(F.slice("words", i, size), " ").alias("phrase"),
        F.greatest(F.get(value, i - 2), F.get(value, i - 1)).alias("longer")))
    return (paths.where(F.size(value) > 0).select("lang", F.explode(made).alias("p"))
            .select("lang", "p.*"))


def held_by_longer(known: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, longer): the largest count of the phrases one word longer that hold a phrase.
    Counts fall with length, so no longer phrase has a larger one."""
    compact = checkpointed(paths(known, longest))
    found = _around(compact, "weights", longest - 1).unionByName(
        _around(compact, "flows", longest - 2))
    for size in range(2, longest - 2):
        wide = known.where(F.col("size") == size + 1)
        found = found.unionByName(wide.select("lang", F.explode(F.array(
            _first_words("phrase", size), F.substring_index("phrase", " ", -size))).alias("phrase"),
            F.col("f").alias("longer")))
    return found.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))


# -- phrases


def _best_cuts(known: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of every phrase of two words or more, at its worst cut."""
    cuts = known.where("size >= 2").select(
        "lang", "phrase", F.col("f").alias("a"),
        F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"),
        F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt")).withColumn(
        "left", F.expr("substring_index(phrase, ' ', k)")).withColumn(
        "right", F.expr("substring(phrase, length(left) + 2)"))
    parts = known.select("lang", "phrase", "f", F.explode(F.sequence(
        F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    joined = (cuts.join(parts.toDF("lang", "left", "l", "salt"), ["lang", "left", "salt"])
              .join(parts.toDF("lang", "right", "r", "salt"), ["lang", "right", "salt"]))
    score = F.expr("(2000000BD * cast(a as decimal(20, 0))) div "
                   "(cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = joined.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST,
            inside_percent: int = INSIDE_PERCENT, per_lang: int = PER_LANG) -> DataFrame:
    """The `per_lang` best phrases of each language of `docs` (lang, text): lang, rank, phrase, a, l,
    r, n, score.

    Letters A-Z are folded; pieces end at `.,;:!?` and line ends, words at spaces and tabs. Phrases of
    2 to `longest` (at least 3) words that occur `least` times are scored by their worst cut; those
    that a longer one holds in `inside_percent` of their occurrences are dropped. Ranks go by score,
    occurrences, and the phrase's bytes.

    Null texts and empty ones have no words; a null language is `und`, together with rows that say so.
    Repeated rows count each. Tables without words give no rows. Other columns are not read.
    """
    known, words = counts(docs, longest, least)
    held = held_by_longer(known, longest)
    kept = (_best_cuts(known).join(held, ["lang", "phrase"], "left")
            .where(F.coalesce(F.lit(100).cast("decimal(20,0)") * F.col("longer")
                              < F.lit(inside_percent).cast("decimal(20,0)") * F.col("a"),
                              F.lit(True))))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (kept.withColumn("rank", F.row_number().over(order).cast("long"))
            .where(F.col("rank") <= per_lang).join(words, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def report(docs: DataFrame) -> DataFrame:
    return phrases(docs)


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\f\r]')) AS piece
  FROM documents),
words AS (SELECT lang, [w for w in string_split_regex(piece, '[ \t]+') if w <> ''] AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM words, range(1, 5) t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT lang, phrase, k, f AS a, c,
    array_to_string(string_split(phrase, ' ')[1:c], ' ') AS head,
    array_to_string(string_split(phrase, ' ')[c + 1:k], ' ') AS tail
  FROM f, range(1, 4) t(c) WHERE c < k),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.k, a, c, x.f AS l, y.f AS r,
    CAST((2000000::HUGEINT * a) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head
            JOIN f y ON y.lang = cuts.lang AND y.phrase = tail
  QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, c) = 1),
kept AS (
  SELECT * FROM scored s WHERE NOT EXISTS (
    SELECT 1 FROM f longer WHERE longer.lang = s.lang AND longer.k > s.k
      AND contains(' ' || longer.phrase || ' ', ' ' || s.phrase || ' ')
      AND 100::HUGEINT * longer.f >= 80::HUGEINT * s.a))
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC,
         encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals ON kept.lang = totals.lang QUALIFY rank <= 2000"""
