"""Near-duplicate texts: universal hash minima with banding, exact verification, and connected components.

Texts are keyed by a digest of their word sequence, so that exact copies are one node throughout; a task emits the
bands of a digest once, whatever number of copies it reads. Signatures are written once to the shared folder; the bands
are exchanged from there in a few shares, one after the other, in packed blocks that carry a sketch of the text with
each band. Texts of few words share bands by chance, the more often the more texts there are (as their square), so pairs
are formed and held against their sketches where they meet, and only what may be similar leaves the task: the sketches
bound the similarity from above, so none is lost. Buckets of more than `HOT` texts are taken out as they are found, in the
block already if they are that frequent there, and only their members are passed on; those are candidates if they share
one of their rarest runs, which every similar pair does (prefix filter). All candidates are verified on whole shingle
sets. Row pairs are only formed by `pairs`, whose result they are.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.llm.components import components
from corpuslane.llm.words import MULTIPLIERS, WordValues, mixed, windows
from corpuslane.session import cut, shared_dir

#: 60 bands of 4 minima find a pair of similarity 0.5 with probability 0.979, 0.55 with 0.997 and 0.6 with 0.9998.
BANDS, ROWS = 60, 4
#: Texts of a bucket beyond which its pairs are looked for by their rarest runs: of all texts, and of a block (where it is
#: a fiftieth of the block as well, so that a task is not sent them).
HOT, HOT_IN_BLOCK = 20_000, 48
#: Bands that a task of the exchange meets on average, and texts that are packed together (both bound its memory).
BANDS_A_TASK, TEXTS_A_BLOCK = 1_000_000, 20_000
#: 64-bit words of a sketch; number of runs from which a text's sketch tells nothing.
WORDS, MANY = 4, 255
#: Bands are exchanged one share after the other, which bounds the disk: most shares, and texts for which there is one more.
PASSES, TEXTS_A_PASS = 10, 30_000
#: Rows (16 bytes each) up to which a list of row numbers is broadcast to pick their texts; beyond, the join shuffles.
MOST_BROADCAST = 500_000
_RANDOM = np.random.Generator(np.random.PCG64(7))
_A = _RANDOM.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RANDOM.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_BAND = mixed(np.arange(BANDS, dtype=np.uint64) + np.uint64(1))
_ASCII = {k: k if chr(k).isalnum() else 32 for k in range(128)}
_WORD = re.compile(r"[^\W_]+")


def _words(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    return low.translate(_ASCII).split() if low.isascii() else _WORD.findall(low)


def _digest(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words)) - 2**63


def minima(shingles: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The minima under all hash functions (rows) of the 32-bit values of each text (columns); runs are their numbers."""
    out = np.full((BANDS * ROWS, len(runs)), 2**32 - 1, np.uint32)
    some = np.flatnonzero(runs)
    starts = (np.cumsum(runs) - runs)[some]
    for k in range(0, len(shingles), 4096):
        values = shingles[None, k : k + 4096] * _A[:, None]
        values += _B[:, None]
        low, high = np.searchsorted(starts, k, "right") - 1, np.searchsorted(starts, k + values.shape[1])
        least = np.minimum.reduceat(values, np.maximum(starts[low:high] - k, 0), axis=1)
        out[:, some[low:high]] = np.minimum(out[:, some[low:high]], least)
    return out


def _pack(h: np.ndarray, digests: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted 32-bit values as planes of bytes of their differences, which compress; digests, runs and sketches beside them."""
    order = np.argsort(h)
    steps = np.diff(h[order], prepend=np.uint32(0)).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes() + b"".join(x[order].tobytes() for x in (digests, *more))


def _unpack(data: bytes, words: int = 0) -> list[np.ndarray]:
    n = len(data) // (13 + 8 * words if words else 12)
    steps = np.frombuffer(data, np.uint8, 4 * n).reshape(4, n).T.copy().view("<u4").ravel()
    out = [np.cumsum(steps, dtype=np.uint64), np.frombuffer(data, np.int64, n, 4 * n)]
    return [*out, np.frombuffer(data, np.uint8, n, 12 * n), np.frombuffer(data, np.uint64, n * words, 13 * n).reshape(n, words)] if words else out


_BAND_BLOCK, _HOT_BLOCK = 0, 1


def sketches(shingles: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Bit sets (rows of `WORDS` words) of the 64-bit values of each text; runs are their numbers.

    A bit that two of them do not share is that of a value that only one text has, and of no other bit. So texts differ
    in at least as many values, and a pair whose bits differ too much for its similarity is surely not similar.
    """
    bits = np.zeros((len(runs), 64 * WORDS), bool)
    bits[np.repeat(np.arange(len(runs)), runs), (shingles % np.uint64(64 * WORDS)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.uint64).reshape(-1, WORDS)


def _near(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether texts of these sketches (a word each row) and numbers of runs (or more) may have the similarity."""
    apart = np.zeros(a.shape[1], np.int32)
    for x, y in zip(a, b):
        apart += np.bitwise_count(x ^ y)
    return (apart <= (1 - threshold) / (1 + threshold) * (na.astype(np.int32) + nb) + 1e-6) | (na == MANY) | (nb == MANY)


def _signatures(rows: DataFrame, size: int, passes: int) -> DataFrame:
    """Blocks of texts: (ids, of) of all rows and their digests; digests, runs and sketches of each text and its bands by pass."""
    bands = [f"bands{k}" for k in range(passes)]
    names = ["ids", "of", "digests", "runs", "sketches", *bands]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, seen = WordValues(), set()
        flat, lengths, digests, all_digests, ids = [], [], [], [], []

        def flushed() -> pa.RecordBatch:
            shingles, runs = windows(np.array(flat, np.uint64), np.array(lengths, np.int64), size)
            signature = minima((shingles >> np.uint64(32)).astype(np.uint32), runs).astype(np.uint64).reshape(BANDS, ROWS, len(runs))
            keys = (mixed((signature * MULTIPLIERS[:ROWS, None]).sum(axis=1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
            parts = [np.array(ids, np.int64), np.array(all_digests, np.int64), np.array(digests, np.int64), np.minimum(runs, MANY).astype(np.uint8), sketches(shingles, runs), *np.array_split(keys, passes)]
            for x in (flat, lengths, digests, all_digests, ids):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names)

        for batch in batches:
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _words(text)
                if len(words) < size:
                    continue
                d = _digest(words)
                all_digests.append(d)
                ids.append(row_id)
                if d not in seen:
                    seen.add(d)
                    flat += value(words)
                    lengths.append(len(words))
                    digests.append(d)
                if len(ids) >= TEXTS_A_BLOCK or len(flat) >= 100 * TEXTS_A_BLOCK:
                    yield flushed()
        if ids:
            yield flushed()

    return rows.where("row_id is not null").select("row_id", "text").mapInArrow(run, ", ".join(f"{x} binary" for x in names))


def _members(signatures: DataFrame) -> DataFrame:
    """(digest, row_id) of all rows of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, of in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(of, np.int64)), pa.array(np.frombuffer(ids, np.int64))], ["digest", "row_id"])

    return signatures.select("ids", "of").mapInArrow(run, "digest bigint, row_id bigint")


def _blocks(signatures: DataFrame, k: int, passes: int, parts: int) -> DataFrame:
    """(part, kind, data): packed bands of pass k by partition, and buckets that are hot within a block."""
    own = np.array_split(_BAND, passes)[k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digests, runs, sketch, bands in zip(*(c.to_pylist() for c in batch.columns)):
                out, n = [], len(runs)
                keys = mixed(np.frombuffer(bands, np.uint32).reshape(len(own), n).astype(np.uint64) + own[:, None]).ravel()
                part = ((keys >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
                of = np.tile(np.arange(n), len(own))
                order = np.lexsort((keys, part))
                keys, of, part = keys[order], of[order], part[order]
                digests, runs, sketch = np.frombuffer(digests, np.int64), np.frombuffer(runs, np.uint8), np.frombuffer(sketch, np.uint64).reshape(n, -1)
                starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
                sizes = np.diff(starts, append=len(keys))
                hot = np.repeat(sizes > max(HOT_IN_BLOCK, n // 50), sizes)
                for kind, chosen in ((_BAND_BLOCK, ~hot), (_HOT_BLOCK, hot)):
                    h, t, p = keys[chosen].astype(np.uint32), of[chosen], part[chosen]
                    ends = (np.flatnonzero(np.diff(p, append=-1)) + 1).tolist()
                    for low, high in zip([0, *ends[:-1]], ends):
                        x = t[low:high]
                        out.append((int(p[low]), kind, _pack(h[low:high], digests[x], runs[x], sketch[x]) if kind == _BAND_BLOCK else _pack(h[low:high], digests[x])))
                c = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary())], ["part", "kind", "data"])

    return signatures.select("digests", "runs", "sketches", f"bands{k}").mapInArrow(run, "part int, kind int, data binary")


def _runs(keys: np.ndarray, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of bands without repetitions, and where their buckets start then and how many they hold."""
    order = np.lexsort((digests, keys))
    k, d = keys[order], digests[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    k = k[new]
    starts = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return order[new], starts, np.diff(starts, append=len(k))


def _within(starts: np.ndarray, sizes: np.ndarray, most: int = 2**19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of all pairs within buckets, about `most` pairs at once."""
    for n in np.unique(sizes[sizes > 1]).tolist():
        at = starts[sizes == n]
        if n * n <= most:
            i, j = np.triu_indices(n, 1)
            step = max(1, most // len(i))
            for k in range(0, len(at), step):
                yield (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
        else:
            step = max(1, most // n)
            for start in at.tolist():
                for k in range(0, n, step):
                    i, j = np.nonzero(np.arange(k, min(k + step, n))[:, None] < np.arange(n))
                    yield start + k + i, start + j


def _meet(blocks: DataFrame, most: int = 3 * BANDS_A_TASK, words: int = 0, threshold: float = 0.5) -> DataFrame:
    """(kind, a, b) of one partition's blocks: candidate pairs (0), members of hot buckets (1: a).

    With sketches of `words` words, pairs are candidates only if those allow the similarity, and buckets are hot later.
    Beyond `most` bands, buckets that are hot by then are emptied; a band that comes later for one goes on at once.
    """
    names, types = ["kind", "a", "b"], [pa.int32(), pa.int64(), pa.int64()]
    bound = HOT if words else HOT_IN_BLOCK

    def rows(kind: int, a: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(a if b is None else b)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, hot, limit = [], 0, np.zeros(0, np.uint64), most

        def emptied() -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """The bands that stay, with where their buckets start and sizes; hot keys; members of hot buckets."""
            columns = [np.concatenate(x) for x in zip(*held)]
            order, starts, sizes = _runs(columns[0], columns[1])
            columns = [x[order] for x in columns]
            full = (sizes > bound) | np.isin(columns[0][starts], hot)
            gone = np.repeat(full, sizes)
            some = sizes[~full]
            return [x[~gone] for x in columns], np.cumsum(some) - some, some, np.union1d(hot, columns[0][starts[full]]), np.unique(columns[1][gone])

        for batch in batches:
            for part, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                h, *columns = _unpack(data, words if kind == _BAND_BLOCK else 0)
                h = h | np.uint64(part << 32)
                if kind == _HOT_BLOCK:
                    hot = np.union1d(hot, h)
                    yield rows(1, np.unique(columns[0]))
                    continue
                if len(hot):
                    gone = np.isin(h, hot)
                    yield rows(1, np.unique(columns[0][gone]))
                    h, *columns = (x[~gone] for x in (h, *columns))
                held.append([h, *columns])
                count += len(h)
                if count > limit:
                    columns, _, _, hot, members = emptied()
                    yield rows(1, members)
                    held, count = [columns], len(columns[0])
                    limit = max(most, 2 * count)
        if not held:
            yield pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names)
            return
        (_, d, *sketch), starts, sizes, _, members = emptied()
        yield rows(1, members)
        found, waiting = np.zeros((2, 0), np.int64), []
        runs, planes = (sketch[0], sketch[1].T.copy()) if words else (None, None)
        for i, j in _within(starts, sizes):
            if words:
                near = _near(planes[:, i], planes[:, j], runs[i], runs[j], threshold)
                i, j = i[near], j[near]
            waiting.append(np.stack((d[i], d[j])))
            if sum(x.shape[1] for x in waiting) > 2**20:
                found, waiting = np.unique(np.concatenate((found, *waiting), axis=1), axis=1), []
                if found.shape[1] > 2**20:
                    yield rows(0, found[0], found[1])
                    found = found[:, :0]
        found = np.unique(np.concatenate((found, *waiting), axis=1), axis=1)
        yield rows(0, found[0], found[1])

    return blocks.mapInArrow(run, "kind int, a bigint, b bigint")


class _Sets:
    """Shingle sets by digest, as long as a bounded number of runs is held."""

    def __init__(self, size: int, most: int = 2_000_000):
        self.size, self.most, self.held, self.known = size, most, 0, {}

    def __call__(self, digest: int, text: str) -> frozenset:
        if digest not in self.known:
            words = _words(text)
            if self.held > self.most:
                self.known.clear()
                self.held = 0
            self.known[digest] = frozenset(zip(*(words[i:] for i in range(self.size))))
            self.held += len(words)
        return self.known[digest]


def _verified(pairs: DataFrame, size: int, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the pairs whose shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(size)
        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = sets(a, ta), sets(b, tb)
                shared = len(x & y)
                if shared >= threshold * (len(x) + len(y) - shared):
                    out.append((a, b, shared / (len(x) + len(y) - shared)))
            c = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.float64())], ["a", "b", "jaccard"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, jaccard double")


def _of_hot(texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """(a, b), a < b: all pairs of texts (digest, text) that share one of their rarest runs and are of fitting lengths.

    Runs are ordered by frequency; a pair of the similarity shares a run among the first (1 - threshold) of each.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = WordValues()
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _words(text)
                runs = np.unique(windows(np.array(value(words), np.uint64), np.array([len(words)]), size)[0]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(runs), digest, np.int64)), pa.array(np.full(len(runs), len(runs), np.int32)), pa.array(runs)], ["digest", "n", "run"])

    runs = texts.select("digest", "text").mapInArrow(explode, "digest bigint, n int, run bigint")
    often = runs.groupBy("run").agg(F.count("*").alias("c")).where("c > 1")
    known = runs.join(often, "run", "left").withColumn("c", F.coalesce("c", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("digest").orderBy("c", "run"))
    first = known.withColumn("r", place).where((F.col("r") <= F.floor((1 - threshold) * F.col("n")) + 1) & (F.col("c") > 1)).select("run", "digest", "n")
    a, b = (first.select("run", F.col("digest").alias(k), F.col("n").alias(f"n{k}")) for k in "ab")
    fitting = (F.col("a") < F.col("b")) & (F.col("na") >= threshold * F.col("nb")) & (F.col("nb") >= threshold * F.col("na"))
    return a.join(b, "run").where(fitting).select("a", "b").distinct()


def _cut(df: DataFrame) -> DataFrame:
    """cut(df), without the files of its shuffles, which otherwise stay until the driver collects its garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return cut(df.select("*"))  # a plan of its own, which takes the setting
    finally:
        conf.set(name, before)


def _links(rows: DataFrame, size: int, threshold: float, most_broadcast: int) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b, jaccard), a < b, and (digest, row_id) of all rows with as many words as a run has."""
    spark = rows.sparkSession
    n = rows.count()
    passes = min(PASSES, n // TEXTS_A_PASS + 1)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * BANDS // passes // BANDS_A_TASK))
    folder = f"{shared_dir(spark)}/signatures-{uuid.uuid4().hex}"
    try:
        _signatures(rows, size, passes).write.parquet(folder)
        signatures = spark.read.parquet(folder)
        members = _cut(_members(signatures))
        found = [_cut(_meet(_blocks(signatures, k, passes, parts).repartitionById(parts, F.col("part")), words=WORDS, threshold=threshold).distinct()) for k in range(passes)]
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    found = reduce(DataFrame.unionByName, found)
    first = members.groupBy("digest").agg(F.min("row_id").alias("row_id"))

    def texts(digests: DataFrame) -> DataFrame:
        some = first.join(digests, "digest", "left_semi")
        return rows.join(F.broadcast(some) if digests.count() <= most_broadcast else some, "row_id").select("digest", "text")

    candidates = found.where("kind = 0").select("a", "b").distinct()
    hot = found.where("kind = 1").select(F.col("a").alias("digest")).distinct()
    if not hot.isEmpty():
        candidates = candidates.unionByName(_of_hot(texts(_cut(hot)), size, threshold)).distinct()
    candidates = _cut(candidates)
    known = texts(candidates.select(F.explode(F.array("a", "b")).alias("digest")).distinct())
    a, b = (known.select(F.col("digest").alias(k), F.col("text").alias(f"t{k}")) for k in "ab")
    return _verified(candidates.join(a, "a").join(b, "b"), size, threshold), members


def _rows(table: DataFrame, row_id: str, text: str) -> DataFrame:
    return table.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(text).alias("text"))


def pairs(table: DataFrame, row_id: str = "row_id", text: str = "text", size: int = 3, threshold: float = 0.5, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(row_id_a, row_id_b), row_id_a < row_id_b: all pairs of rows whose shingle sets have the similarity or more.

    Null texts and texts of fewer than `size` words form no pair; exact copies do. Its size is that of the result asked
    for; `groups` describes the same groups with one row per row of the table.
    """
    links, members = _links(_rows(table, row_id, text), size, threshold, most_broadcast)
    links = _cut(links.select("a", "b"))
    copied = members.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    members = members.join(links.select(F.explode(F.array("a", "b")).alias("digest")).unionByName(copied).distinct(), "digest", "left_semi")
    a, b = (members.select(F.col("digest").alias(k), F.col("row_id").alias(f"r{k}")) for k in "ab")
    apart = links.join(a, "a").join(b, "b")
    copies = a.join(b, F.col("a") == F.col("b")).where("ra < rb")
    return apart.select("ra", "rb").unionByName(copies.select("ra", "rb")).where("ra <> rb").select(F.least("ra", "rb").alias("row_id_a"), F.greatest("ra", "rb").alias("row_id_b")).distinct()


def groups(table: DataFrame, row_id: str = "row_id", text: str = "text", size: int = 3, threshold: float = 0.5, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(row_id, class_id, links): each row with the least row_id of its connected class and the number of its partners.

    Rows with a null text or one of fewer than `size` words are classes of their own with 0 links.
    """
    rows = _rows(table, row_id, text)
    links, members = _links(rows, size, threshold, most_broadcast)
    links = _cut(links.select("a", "b"))
    copies = members.groupBy("digest").agg(F.count("*").alias("n"), F.min("row_id").alias("least"))
    size_of = copies.select("digest", "n")
    ends = links.select(F.col("a").alias("digest"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("digest"), F.col("a").alias("other")))
    partners = ends.join(size_of.select(F.col("digest").alias("other"), "n"), "other").groupBy("digest").agg(F.sum("n").alias("near"))
    found = components(links, "a", "b").select(F.col("node").alias("digest"), "component")
    known = _cut(copies.join(found, "digest", "left").join(partners, "digest", "left").select("digest", "least", F.coalesce("component", "digest").alias("component"), (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("links")))
    classes = known.join(known.groupBy("component").agg(F.min("least").alias("class_id")), "component").select("digest", "class_id", "links")
    of_rows = members.join(classes, "digest").select("row_id", "class_id", "links")  # all other rows are classes of their own
    return rows.select("row_id").join(of_rows, "row_id", "left").select("row_id", F.coalesce("class_id", "row_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
