"""Packing of texts, measured in tokens, into containers of fixed capacity by bounded-space online best fit.

Each partition keeps a fixed number of open containers per capacity: an item goes into the one where it leaves the
least room; when it fits nowhere, the fullest is closed and a new one opened. What is open at the end of a partition
is merged with the leftovers of others in the same way, in tasks of bounded size.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslane.session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split of texts before byte pairs are merged, as the vocabulary's makers publish it (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
OPEN = 64
LEFTOVERS_PER_TASK = 500_000
#: A longer text is measured in parts that end at white space, since the merging of pairs is not linear in a part.
PART = 100_000


@cache
def _encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines()) if a}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(encode, text: str) -> int:
    if len(text) <= PART:
        return len(encode(text))
    n, low = 0, 0
    while low < len(text):
        high = text.rfind(" ", low + 1, low + PART) if low + PART < len(text) else len(text)
        high = high if high > low else low + PART
        n += len(encode(text[low:high]))
        low = high
    return n


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of every row; null and empty texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_count(encode, t) if t else 0 for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "tokens"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, tokens bigint")


class OpenContainers:
    """At most `most` open containers of one capacity; numbers of containers are handed out by `new`."""

    def __init__(self, capacity: int, most: int, new):
        self.capacity, self.most, self.new = capacity, most, new
        self.free: list[tuple[int, int]] = []  # (room, container), ascending
        self.items: dict[int, int] = {}

    def place(self, size: int, items: int = 1) -> tuple[int, int, int]:
        """Container, first token and place in it for an item (or a bundle of items)."""
        k = bisect_left(self.free, (size, -1))
        if k < len(self.free):
            room, container = self.free.pop(k)
        else:
            if len(self.free) >= self.most:
                self.items.pop(self.free.pop(0)[1])  # the fullest is closed
            room, container = self.capacity, self.new()
        at = self.items.get(container, 0)
        self.items[container] = at + items
        insort(self.free, (room - size, container))
        return container, self.capacity - room, at


def pack(sizes: DataFrame, capacities: dict[int, int], doc_id: str = "doc_id", tokens: str = "tokens", partitions: int | None = None) -> DataFrame:
    """(budget_id, capacity, doc_id, piece, tokens, container, first_token, place): a row per item and capacity.

    An item larger than the capacity is cut into full pieces, each a container of its own, and a rest that is packed
    like any item; nothing else is cut. Items of 0 tokens (or null) are placed too and take no room. Containers are
    numbered without regard to order. The order of packing is that of doc_id in hash partitions, so that a task that
    is run again gives the same result; repeated doc_ids are items of their own.
    """
    spark = sizes.sparkSession
    kind = sizes.schema[doc_id].dataType.simpleString()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = f"budget_id int, capacity int, doc_id {kind}, piece int, tokens bigint, container bigint, first_token bigint, place int, open boolean"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, count = TaskContext.get().partitionId() << 36, 0

        def new() -> int:
            nonlocal count
            count += 1
            return base + count

        states = {b: OpenContainers(c, OPEN, new) for b, c in capacities.items()}
        kept: dict[int, list[tuple]] = {}  # rows of open containers, by container
        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            out: list[tuple] = []
            for key, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for b, state in states.items():
                    c, piece, rest = state.capacity, 0, size or 0
                    while rest > c:
                        out.append((b, c, key, piece, c, new(), 0, 0, False))
                        piece, rest = piece + 1, rest - c
                    full = state.free[0][1] if len(state.free) >= state.most else None
                    container, start, place = state.place(rest)
                    if full is not None and full not in state.items:
                        out += kept.pop(full)
                    kept.setdefault(container, []).append((b, c, key, piece, rest, container, start, place, False))
            yield _batch(out, key_type)
        if kept:
            yield _batch([(*r[:-1], True) for rows in kept.values() for r in rows], key_type)

    def _batch(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 9
        types = (pa.int32(), pa.int32(), key_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["budget_id", "capacity", "doc_id", "piece", "tokens", "container", "first_token", "place", "open"])

    placed = cut(sizes.select(F.col(doc_id).alias("doc_id"), F.col(tokens).cast("bigint").alias("tokens")).repartition(n, F.xxhash64("doc_id")).sortWithinPartitions("doc_id", "tokens").mapInArrow(first, schema))
    left = placed.where("open")
    bundles = left.groupBy("budget_id", "capacity", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").cast("int").alias("items"))
    tasks = max(1, -(-n * OPEN * len(capacities) // LEFTOVERS_PER_TASK))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, OpenContainers] = {}
        for batch in batches:
            out = []
            for b, c, container, size, items in zip(*(x.to_pylist() for x in batch.columns)):
                if b not in states:
                    states[b] = OpenContainers(c, 1_000_000, None)
                states[b].new = lambda container=container: container  # a new container takes its first bundle's number
                out.append((container, *states[b].place(size, items)))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["container", "into", "shift", "before"])

    merged = bundles.repartition(tasks, F.xxhash64("container")).sortWithinPartitions("budget_id", F.desc("tokens"), "container").mapInArrow(merge, "container bigint, into bigint, shift bigint, before int")
    moved = left.join(merged, "container").select("budget_id", "capacity", "doc_id", "piece", "tokens", F.col("into").alias("container"), (F.col("first_token") + F.col("shift")).alias("first_token"), (F.col("place") + F.col("before")).alias("place"))
    return placed.where("not open").select(moved.columns).unionByName(moved)
