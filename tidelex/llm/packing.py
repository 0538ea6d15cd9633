"""Best-fit packing of token pieces into sequences of a fixed size.

Documents are encoded and cut in one pass; a piece is then only (length, rank among the pieces of
that length), so documents sorted by length and gaps sorted by size are two histograms of at most
`capacity` classes. A superstep takes the largest length class: its pieces, in rank order, meet the
gaps by a successor sweep (smallest gap that is large enough first, each gap filled as far as it
goes), the r-th piece takes the r-th place, the gaps are updated, and the next class follows. That
is best-fit decreasing, done for whole classes at once.

The plan of the sweeps has a size that depends on `capacity` alone: a superstep adds at most three
runs of alike sequences. So it is made from the class counts and sent to the tasks, where each piece
finds its place by rank; pieces themselves are shuffled once, as narrow rows.

Defined results: a null text is empty and still yields its closing id; repeated rows are packed one
by one; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import checkpointed, text_or_empty

CAPACITY = 2048
#: Runs without white space, and words, whose ids a task remembers.
REMEMBERED = 500_000

# The text rules of the tokenizer file for which words can be encoded one by one.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: The same split for characters up to U+024F, where no character combines with another one.
LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\t-\r \x85\xa0]|_)+")
NOT_LATIN = re.compile(r"[^\x00-\x1b\x20-įı-ɏ]|<\|")


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, exactly as the tokenizer file gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        split = ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        stages = (rules.get("normalizer") or {}).get("normalizers") or []
        self.by_word = (split.get("pattern") == {"Regex": SPLIT}
                        and [x["type"] for x in stages] == NORMALIZERS)
        if self.by_word:
            rules["normalizer"] = None
            rules["pre_tokenizer"]["pretokenizers"] = rules["pre_tokenizer"]["pretokenizers"][1:]
            rules["added_tokens"] = []
            self.part = Tokenizer.from_str(json.dumps(rules))
        self.runs: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.asarray(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if not self.by_word or NOT_LATIN.search(text):
                yield self._packed(self.whole.encode(text, add_special_tokens=False).ids)
                continue
            runs = text.lower().split()
            try:
                yield b"".join(map(self.runs.__getitem__, runs))
            except KeyError:
                if len(self.runs) > REMEMBERED:
                    self.runs.clear()
                self._learn(set(runs).difference(self.runs))
                yield b"".join(map(self.runs.__getitem__, runs))

    def _learn(self, new: set[str]) -> None:
        """Remember the ids of runs without white space, made of those of their words."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        split = {run: LATIN.findall(run) for run in new}
        words = list({w for found in split.values() for w in found}.difference(self.words))
        for word, found in zip(words, self.part.encode_batch_fast(
                words, add_special_tokens=False)):
            self.words[word] = self._packed(found.ids)
        ids = self.words.__getitem__
        for run, found in split.items():
            self.runs[run] = b"".join(map(ids, found))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing_id: int = 0,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank): the pieces of every document. `rank`
    counts the pieces of one length inside one task, `part` is that task's partition.

    `tokenizer` is a path that every executor can read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       text_or_empty(F.col(text_col)).alias("text"))
    end = np.asarray([closing_id], "<u4").tobytes()
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder(tokenizer), defaultdict(int)
        part = TaskContext.get().partitionId()
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column("doc_id").to_pylist()
            for doc, blob in zip(ids, encoder.encode(batch.column("text").to_pylist())):
                blob += end
                for n, at in enumerate(range(0, len(blob), width)):
                    own = blob[at:at + width]
                    length = len(own) // 4
                    out.append((doc, n, at // 4, length, zlib.crc32(own), part, seen[length]))
                    seen[length] += 1
            columns = zip(*out) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (
                    pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(),
                    pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                "part int, rank long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, pieces, first sequence, offset);
    piece first rank + i goes to sequence first sequence + i."""
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # gap: [first sequence, sequences]
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def fill(first: int, number: int, gap: int, each: int) -> None:
            nonlocal rank, left
            for layer in range(each):
                out.append((length, rank, number, first, capacity - gap + layer * length))
                rank += number
            left -= each * number
            if gap - each * length:
                gaps[gap - each * length].append([first, number])

        for gap in sorted(g for g in gaps if g >= length):
            each, runs = gap // length, gaps.pop(gap)
            while runs and left:
                first, number = runs.pop()
                whole = min(number, left // each)
                if whole:
                    fill(first, whole, gap, each)
                if whole < number and 0 < left < each:
                    fill(first + whole, 1, gap, left)
                    whole += 1
                if whole < number:
                    runs.append([first + whole, number - whole])
            if runs:
                gaps[gap] = runs + gaps[gap]
            if not left:
                break
        each = capacity // length
        whole, rest = divmod(left, each)
        if whole:
            fill(opened, whole, capacity, each)
            opened += whole
        if rest:
            fill(opened, 1, capacity, rest)
            opened += 1
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to the rows of `pieces`."""
    cut = checkpointed(cut)
    per_part = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    base = per_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # At most `capacity` rows.
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    placed: dict[int, list] = defaultdict(list)
    for length, rank, number, sequence, offset in plan(counts, capacity):
        placed[length].append((rank, sequence, offset))
    tables = cut.sparkSession.sparkContext.broadcast(
        {k: np.asarray(v, np.int64).T for k, v in placed.items()})
    ranked = cut.join(base.drop("n"), ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("rank") + F.col("base")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                first, start, at = tables.value[int(length)]
                row = np.searchsorted(first, ranks[own], side="right") - 1
                sequence[own] = start[row] + ranks[own] - first[row]
                offset[own] = at[row]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, "
                                  "ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, tokenizer, capacity), capacity)
