"""Toxicity from a weighted word list with a few clause rules.

Each word has one of five classes: insult (a learned weight), threat, target, negation and reported
speech. One loop with fixed factors (`clause_weights`) reads a clause from left to right, in place of
composed transducers; it remembers whether a negation or a report is in force and whether a target or
a threat has passed. An insult adds its weight also when it stands alone, more beside a target; a
threat counts only with a target. Negation and reports weaken what they govern. A document's features
are sums and maxima over its clauses, and a logistic curve turns them into a score.

Insults are learned as words and as word stems (first 4 to 6 letters) from labelled rows: their
document counts by label are summed in Spark, and those whose log odds stand out are kept. The model
is fitted on at most `SAMPLE` labelled rows, taken by a hash of their id, and has at most `LEXICON`
entries; both are bounds, whatever the size of the tables.

Defined results: null and empty texts get the score of a document without clauses; a null id is not
held out and is never trained on; of labels that disagree about an id, toxic wins; without labels of
both kinds every score is the base rate.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import extended, text_or_empty

SAMPLE = 20_000
LEXICON = 5_000
FOLDS = 5

#: Closed word classes of the grammar, in the four languages of the corpus.
THREATS = frozenset(
    "kill hurt destroy murder beat punch stab shoot burn töten schlagen vernichten verletzen tuer "
    "tuerai frapper détruire brûler matar matarte golpear destruir quemar".split())
TARGETS = frozenset(
    "you your yours u ur he she they him her them du dich dir ihr euch sie tu te toi vous ton ta "
    "tes usted ustedes vosotros ti".split())
NEGATIONS = frozenset(
    "not never no cannot dont don't isn't aren't wasn't nicht nie kein keine keinen ne pas jamais "
    "nunca jamás".split())
REPORTS = frozenset(
    "said says say wrote writes quoted called claims claimed reported sagte sagt schrieb schreibt "
    "dit disait écrit écrivait dijo dice escribió escribe".split())

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:,\n]")
STEMS = (4, 5, 6)
#: Words that a negation or a report governs.
SCOPE_NEGATION, SCOPE_REPORT = 3, 12
NEGATED, REPORTED, BESIDE_TARGET, THREAT = 0.5, 0.7, 1.3, 3.0
FEATURES = 6


@dataclass
class Lexicon:
    """Weights of insults by word and by stem; a word that has its own weight needs no stem."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


class Classes(dict):
    """(class, weight) of a word, remembered up to a bound; class 0 has no symbol."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > 300_000:
            self.clear()
        own = self.lexicon.words.get(word)
        if own is None:
            own = max((self.lexicon.stems.get(word[:n], 0.0) for n in STEMS if len(word) >= n),
                      default=0.0)
        if own > 0:
            value = (1, own)
        elif word in THREATS:
            value = (2, 0.0)
        elif word in TARGETS:
            value = (3, 0.0)
        elif word in NEGATIONS:
            value = (4, 0.0)
        elif word in REPORTS:
            value = (5, 0.0)
        elif word in ".!?;:\n":
            value = (6, 0.0)
        elif word == ",":
            value = (7, 0.0)
        else:
            value = (0, 0.0)
        self[word] = value
        return value


def clause_weights(words: list[str], classes: Classes) -> list[tuple[float, int]]:
    """(weight, insults) of each clause that matches a pattern."""
    out: list[tuple[float, int]] = []
    total, insults = 0.0, 0
    negated = reported = target = threat = -1  # last position at which the state holds
    for at, (kind, weight) in enumerate(map(classes.__getitem__, words)):
        if kind == 0:
            continue
        if kind >= 6:
            if total:
                out.append((total, insults))
            total, insults = 0.0, 0
            negated = target = threat = -1
            if kind == 6:
                reported = -1
            continue
        bent = (NEGATED if at <= negated else 1.0) * (REPORTED if at <= reported else 1.0)
        if kind == 1:
            total += bent * weight * (BESIDE_TARGET if 0 <= target and at - target <= 3 else 1.0)
            insults += 1
        elif kind == 2:
            threat = at
            if 0 <= target and at - target <= 4:
                total += bent * THREAT
        elif kind == 3:
            target = at
            if 0 <= threat and at - threat <= 2:
                total += bent * THREAT
        elif kind == 4:
            negated = at + SCOPE_NEGATION
        else:
            reported = at + SCOPE_REPORT
    if total:
        out.append((total, insults))
    return out


def features(text: str, classes: Classes) -> list[float]:
    words = WORD.findall(text.lower())
    found = clause_weights(words, classes)
    if not found:
        return [0.0] * FEATURES
    weights = [w for w, _ in found]
    total = sum(weights)
    return [1.0, math.log1p(total), max(weights), math.log1p(len(found)),
            math.log1p(sum(n for _, n in found)), 100.0 * total / (100.0 + len(words)) / 10.0]


def fold(id_column: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(F.encode(id_column.cast("string"), "UTF-8")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, id_col: str = "doc_id",
                    text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, label) of at most about `bound` training rows. The ids are at most that many, and so
    is what the join sends to every task."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
             .where("id IS NOT NULL AND label IS NOT NULL").where(fold(F.col("id")) != 0)
             .groupBy("id").agg(F.max("label").alias("label")))
    n = known.count()
    share = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 20))
    drawn = known.where(share < F.lit(int((1 << 20) * min(1.0, bound / max(n, 1)))))
    return (docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
            .join(F.broadcast(drawn), "id").select("id", "text", "label"))


def learn(sample: DataFrame, size: int = LEXICON) -> Lexicon:
    """The lexicon of a labelled sample: terms of clearly toxic use, the strongest `size`."""
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text, label in zip(batch.column("text").to_pylist(),
                                   batch.column("label").to_pylist()):
                words = {w for w in WORD.findall(text.lower()) if len(w) > 2}
                stems = {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
                counts.update((t, label) for t in words | stems)
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in counts], pa.string()),
                 pa.array([int(x) for _, x in counts], pa.int32()),
                 pa.array(list(counts.values()), pa.int64())], names=["term", "label", "n"])

    texts = sample.groupBy("text").agg(F.max("label").alias("label"))  # copies count once
    totals = {r["label"]: r["n"] for r in texts.groupBy("label").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Lexicon()
    both = (texts.mapInArrow(terms, "term string, label int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("label") == 1, 0).otherwise(F.col("n"))).alias("c")).where("t >= 3"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    # A term must be frequent enough that its odds are no chance: 3 standard errors above 0.
    doubt = F.sqrt(1.0 / (F.col("t") + 0.5) + 1.0 / (F.col("c") + 0.5))
    best = (both.select("term", "t", "c", odds.alias("w"), (odds - F.lit(1.0) * doubt)
                        .alias("sure"))
            .where((F.col("w") >= 2.0) & (F.col("sure") > 0.5)
                   & (F.col("t") >= 0.004 * toxic) & (F.col("t") > 2 * F.col("c")))
            .orderBy(F.desc("t"), "term").limit(size).collect())
    lexicon = Lexicon()
    for row in best:
        place = lexicon.stems if row["term"].endswith("*") else lexicon.words
        place[row["term"].rstrip("*")] = min(row["w"], 6.0)
    return lexicon


def _featured(docs: DataFrame, lexicon: Lexicon, text_col: str) -> DataFrame:
    """`docs` with `__x`, the features of its text, instead of the text."""
    keep = [c for c in docs.columns if c not in (text_col, "__x")]
    rows = docs.select(*keep, text_or_empty(F.col(text_col)).alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(sent.value)
        for batch in batches:
            # One text at a time: a batch may hold many long ones.
            found = [features(t.as_py(), classes) for t in batch.column("__text")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(found, pa.list_(pa.float64()))],
                names=[*keep, "__x"])

    return rows.mapInArrow(run, extended(rows.drop("__text"), "__x array<double>"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the first one is the intercept."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    damp = np.full(x.shape[1], ridge)
    damp[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - damp * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(damp), slope)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: list[float]


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> Model:
    sample = labelled_sample(docs, labels, bound, id_col, text_col, label_col)
    lexicon = learn(sample)
    rows = _featured(sample, lexicon, "text").select("__x", "label").collect()  # at most `bound`
    y = np.asarray([r["label"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        rate = min(max(rate, 0.01), 0.99)
        return Model(lexicon, [math.log(rate / (1 - rate)), *[0.0] * FEATURES])
    return Model(lexicon, logistic(np.asarray([r["__x"] for r in rows]), y).tolist())


def score(docs: DataFrame, model: Model, text_col: str = "text",
          score_col: str = "score") -> DataFrame:
    """`docs` without its text and with its score; nothing but the text goes into it."""
    found = _featured(docs.drop(score_col), model.lexicon, text_col)
    linear = F.lit(model.weights[0])
    for i, weight in enumerate(model.weights[1:]):
        linear = linear + F.lit(weight) * F.col("__x")[i]
    return found.withColumn(score_col, F.lit(1.0) / (F.lit(1.0) + F.exp(-linear))).drop("__x")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
