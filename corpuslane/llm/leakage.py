"""Evaluation passages inside a training corpus, found by spaced-seed hashing.

Fixed masks over a window of consecutive words ignore some positions. The hashes of all masked windows of the test
passages are joined with those of every window of every document, and each hit is verified on its diagonal (document
position minus passage position): the longest run of equal words, and the best overlap that tolerates substitutions.

The test side is small by nature. It is sent to the executors in blocks of at most `block_words` words, each a full
pass over the corpus, so that what is broadcast stays bounded however many items there are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslane.llm.words import MULTIPLIERS, folded_words, mixed

SPAN = 13
#: Positions of a window that a mask ignores. Every single ignored word, and many pairs, are missed by some mask.
IGNORED = ((), (1, 4, 6, 10), (2, 5, 7, 11), (3, 6, 8, 9), (4, 7, 8, 10))
FILTER_BITS = 21


def _masked(values: np.ndarray, ignored: tuple[int, ...]) -> np.ndarray:
    h = np.zeros(max(len(values) - SPAN + 1, 0), np.uint64)
    for k in range(SPAN):
        if k not in ignored and len(h):
            h += values[k : k + len(h)] * MULTIPLIERS[k]
    return mixed(h)


def _longest_run(equal: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], equal.astype(np.int8), [0]))))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def _best_overlap(equal: np.ndarray, penalty: int = 2) -> tuple[int, int]:
    """The segment of highest score (match +1, substitution -penalty): its first and one past its last position."""
    total = np.concatenate(([0], np.cumsum(np.where(equal, 1, -penalty))))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    return int(np.flatnonzero(total[: end + 1] == low[end])[-1]), end


class Seeds:
    """The masked windows of a block of passages, and the search for them in texts."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.ids = [i for i, _ in items]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in items for w in ws}), 1)}
        self.values = mixed(np.arange(1, len(self.vocabulary) + 2, dtype=np.uint64))  # at 0: a word of no passage
        self.passages = [np.array([self.vocabulary[w] for w in ws], np.int32) for _, ws in items]
        self.tables = []
        for ignored in IGNORED:
            hs, of, at = [], [], []
            for n, p in enumerate(self.passages):
                h = _masked(self.values[p], ignored)
                hs.append(h)
                of.append(np.full(len(h), n, np.int32))
                at.append(np.arange(len(h), dtype=np.int32))
            h, of, at = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hs, np.uint64), (of, np.int32), (at, np.int32)))
            order = np.argsort(h, kind="stable")
            there = np.zeros(1 << FILTER_BITS, bool)
            there[h >> np.uint64(64 - FILTER_BITS)] = True
            self.tables.append((ignored, h[order], of[order], at[order], there))

    def ids_of(self, text: str) -> list[int]:
        get = self.vocabulary.get
        return [get(w, 0) for w in folded_words(text)]

    def hits(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each mask: positions in words, numbers of passages and positions in them."""
        values = self.values[words]
        for ignored, table, of, at, there in self.tables:
            h = _masked(values, ignored)
            p = np.flatnonzero(there[h >> np.uint64(64 - FILTER_BITS)])
            low, high = np.searchsorted(table, h[p], "left"), np.searchsorted(table, h[p], "right")
            n = high - low
            if n.sum():
                k = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                yield np.repeat(p, n), of[k], at[k]

    def verified(self, words: np.ndarray, found: set[tuple[int, int]]) -> Iterator[tuple]:
        """The best diagonal of each passage found in one text: item, exact run, matched, substituted, first word."""
        best: dict[int, tuple] = {}
        for n, d in found:
            p = self.passages[n]
            low, high = max(0, -d), min(len(p), len(words) - d)
            equal = words[low + d : high + d] == p[low:high]
            start, end = _best_overlap(equal)
            matched = int(equal[start:end].sum())
            x = (_longest_run(equal), matched, matched - (end - start), low + d + start)
            best[n] = max(best.get(n, x), x)
        for n, (run, matched, lost, first) in best.items():
            yield self.ids[n], run, matched, -lost, first


def _blocks(items: list[tuple[int, list[str]]], block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    block, size = [], 0
    for item in items:
        if block and size + len(item[1]) > block_words:
            yield block
            block, size = [], 0
        block.append(item)
        size += len(item[1])
    if block:
        yield block


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", block_words: int = 1_000_000) -> DataFrame:
    """One row per document and leaked item: longest exact run, words matched and substituted, and where.

    A row is returned where a masked window of 13 words hits and the diagonal verifies it. Null or empty texts and
    passages, and passages of fewer than 13 words, give no rows; equal passages of several items count for each of
    them, equal documents for each of theirs. Extra columns of either table are not read.
    """
    schema = "doc_id bigint, item_id bigint, exact_run int, matched int, substituted int, first_word int"
    rows = items.select(F.col(item_id).cast("bigint"), F.col(passage)).where(F.col(passage).isNotNull()).toLocalIterator()
    parts = []
    for block in _blocks([(i, w) for i, p in rows if i is not None and len(w := folded_words(p)) >= SPAN], block_words):
        seeds = Seeds(block)

        def search(batches: Iterator[pa.RecordBatch], seeds: Seeds = seeds) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                ids = [seeds.ids_of(t) if t else [] for t in batch.column(1).to_pylist()]
                lengths = np.fromiter(map(len, ids), np.int64, len(ids)) + SPAN  # a gap of unknown words between texts
                starts = np.cumsum(lengths) - lengths
                flat = np.zeros(int(lengths.sum()), np.int32)
                for s, x in zip(starts.tolist(), ids):
                    flat[s : s + len(x)] = x
                found = defaultdict(set)
                for p, of, at in seeds.hits(flat):
                    doc = np.searchsorted(starts, p, "right") - 1
                    for key in np.unique(np.stack((doc, of, p - starts[doc] - at), 1), axis=0).tolist():
                        found[key[0]].add((key[1], key[2]))
                keys = batch.column(0)
                for doc, diagonals in found.items():
                    out += [(keys[doc].as_py(), *x) for x in seeds.verified(np.array(ids[doc], np.int32), diagonals)]
                columns = list(zip(*out)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), *[pa.int32()] * 4))], ["doc_id", "item_id", "exact_run", "matched", "substituted", "first_word"])

        parts.append(documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text is not null and doc_id is not null").mapInArrow(search, schema))
    if not parts:
        return documents.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out
