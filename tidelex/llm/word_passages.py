"""Substring deduplication over words, with suffix automata of reference shards.

A word is removed when a window of `WINDOW` consecutive words over it also starts in a document with
a smaller id. `passages` folds equal contexts and deals the contexts at the edges of passages to
shards. In a shard, contexts come in the order of their documents; each is streamed through the
suffix automaton of those before it, whose states know the first document they occur in, and the
matching statistics give its maximal spans of at least the window's length. Then it is added.

Shards are dealt by the gram that contexts share, so a document meets only the automata that can
match it. Sending every automaton to every document would cost the square of the corpus.

Defined results: null and empty texts have no words; a null id comes before all others; rows of one
id do not remove each other's words; of equal texts all but those with the smallest id lose every
word (unless they are shorter than a window).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, text_key, text_or_empty
from .passages import Rule, removed, repeated
from .winnow import words_of_texts

WINDOW = 13
GRAM = 5
#: Stands for a null id inside this module, and sorts first.
NO_ID = -(1 << 63)
#: Bytes of words: all but the six ASCII white space characters, at which `bytes.split` cuts too.
INSIDE = np.ones(256, bool)
INSIDE[[0x20, *range(0x09, 0x0E)]] = False


def _symbols(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return words_of_texts(data, edges, INSIDE)


class Automaton:
    """Suffix automaton of several sequences, added in order; every state knows the rank of the
    first sequence that holds its strings."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.rank = [-1], [0], [None]

    def _state(self, arcs: dict, link: int, length: int, rank) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        self.rank.append(rank)
        return len(self.next) - 1

    def _split(self, before: int, symbol, state: int) -> int:
        """The part of `state` that is one symbol longer than `before`."""
        copy = self._state(dict(self.next[state]), self.link[state], self.length[before] + 1,
                           self.rank[state])
        self.link[state] = copy
        while before != -1 and self.next[before].get(symbol) == state:
            self.next[before][symbol] = copy
            before = self.link[before]
        return copy

    def _after(self, before: int, symbol) -> int:
        state = self.next[before][symbol]
        if self.length[state] == self.length[before] + 1:
            return state
        return self._split(before, symbol, state)

    def add(self, sequence: list, rank) -> None:
        last = 0
        for symbol in sequence:
            if symbol in self.next[last]:
                last = self._after(last, symbol)
                continue
            new = self._state({}, 0, self.length[last] + 1, rank)
            at = last
            while at != -1 and symbol not in self.next[at]:
                self.next[at][symbol] = new
                at = self.link[at]
            if at != -1:
                self.link[new] = self._after(at, symbol)
            last = new

    def matches(self, sequence: list, least: int, rank) -> Iterator[int]:
        """Ends of the stretches of `least` symbols that a sequence of smaller rank holds."""
        state, matched = 0, 0
        for end, symbol in enumerate(sequence, 1):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol not in self.next[state]:
                continue
            state, matched = self.next[state][symbol], matched + 1
            if matched < least:
                continue
            at = state
            while self.length[self.link[at]] >= least:
                at = self.link[at]
            if self.rank[at] < rank:
                yield end


def _shard(contexts: list[tuple]) -> Iterator[tuple[int, int, int]]:
    groups: dict[int, list[int]] = defaultdict(list)
    for at, context in enumerate(contexts):
        groups[context[0]].append(at)
    for members in groups.values():
        automaton = Automaton()
        for at in sorted(members, key=lambda i: contexts[i][1]):
            _, rank, first, _, _, query, payload = contexts[at]
            words = payload.split(b" ")
            if query:
                for end in automaton.matches(words, WINDOW, rank):
                    yield at, first + end - WINDOW, first + end
            automaton.add(words, rank)


def rule() -> Rule:
    return Rule(
        window=WINDOW, gram=GRAM, units=bytes.split, symbols=_symbols,
        origin=F.col("key"), rank=F.col("id"),
        repeats=lambda rank, low, high: low < rank,
        payload=lambda words, first, last, place: b" ".join(words[first:last + WINDOW]),
        shard=_shard)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(F.col(text_col))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
                       text_key(text).alias("key"), F.encode(text, "UTF-8").alias("text"))


def kept_words(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, list[bytes]]:
    """(words removed, words kept)."""
    words, kept, at = text.split(), [], 0
    for start, stop in spans:
        kept += words[at:start]
        at = stop
    kept += words[at:]
    return len(words) - len(kept), kept


def deduplicate(docs: DataFrame, describe: Callable[[list[bytes]], str], id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row, `kept` being `describe(words that stay)`."""
    texts = _texts(docs, id_col, text_col)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, wholes = [], []
            # The words of one text at a time: those of a batch are hundreds of MB of objects.
            for text in batch.column("text"):
                words = text.as_py().split()
                counts.append(len(words))
                wholes.append(describe(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), pa.array(counts, pa.int64()),
                 pa.array(wholes, pa.string())], names=["id", "key", "n_words", "whole"])

    rows = checkpointed(texts.mapInArrow(whole, "id long, key binary, n_words long, whole string"))
    first_ids = checkpointed(rows.groupBy("key").agg(F.min("id").alias("id")))

    def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, str]:
        n, kept = kept_words(text, spans)
        return n, describe(kept)

    found = removed(texts, repeated(texts, first_ids, rule()), cut, "n_cut long, cut string")
    copy = (F.col("id") > F.col("first_id")) & (F.col("n_words") >= WINDOW)
    own = F.col("id") == F.col("first_id")
    return (rows.join(first_ids.withColumnRenamed("id", "first_id"), "key")
            .join(found, "key", "left")
            .select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_words",
                    F.when(copy, F.col("n_words")).when(own, F.coalesce("n_cut", F.lit(0)))
                    .otherwise(F.lit(0)).cast("long").alias("n_removed"),
                    F.when(copy, F.lit(describe([]))).when(own, F.coalesce("cut", "whole"))
                    .otherwise(F.col("whole")).alias("kept")))


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def without_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the text that stays, words joined by a space."""
    return deduplicate(docs, lambda words: b" ".join(words).decode())


def report(docs: DataFrame) -> DataFrame:
    return deduplicate(docs, _digest).withColumnRenamed("kept", "kept_sha256")
