"""Encoders and vector collections: texts become vectors, kept by key in versions of a table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslane.functions.text import tokens
from corpuslane.session import exists

Encoder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[str], list[str]], list[float]]


class HashingEncoder:
    """Signed counts of a text's tokens (parted by blanks) in `dim` slots, by their MD5; of length 1, or 0 without tokens."""

    def __init__(self, dim: int = 384, most: int = 200_000):
        self.dim, self.most, self.known = dim, most, {}

    def _slot(self, token: str) -> tuple[int, int]:
        if token not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            digest = hashlib.md5(token.encode("utf-8", "replace")).digest()
            self.known[token] = int.from_bytes(digest[:2]) % self.dim, 1 if digest[2] < 128 else -1
        return self.known[token]

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float64)
        for n, text in enumerate(texts):
            for token in text.split():
                slot, sign = self._slot(token)
                out[n, slot] += sign
        norms = np.sqrt((out * out).sum(axis=1))
        return out / np.where(norms == 0, 1, norms)[:, None]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", encoder: Encoder | None = None, at_once: int = 256) -> DataFrame:
    """(key, embedding): the vector of each text by an encoder, called with at most at_once texts; null texts as ''.

    The encoder gets the texts as their lower-cased tokens joined by blanks if none is given (HashingEncoder), else as
    they are.
    """
    kind = docs.schema[key].dataType.simpleString()
    given = encoder or HashingEncoder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for k in range(0, len(texts), at_once):
                part = np.asarray(given(texts[k : k + at_once]), np.float32)
                flat = pa.array(part.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + at_once], pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32()), flat)], [key, "embedding"])

    value = F.coalesce(F.col(text), F.lit("")) if encoder else F.array_join(tokens(F.col(text)), " ")
    return docs.select(key, value.alias("text")).mapInArrow(run, f"{key} {kind}, embedding array<float>")


def upsert(collection: DataFrame, rows: DataFrame, key: str = "vec_id") -> DataFrame:
    """The collection with rows put in place of those of the same key; of repeated keys in rows any one stays."""
    new = rows.select(*collection.columns).dropDuplicates([key])
    return collection.join(new.select(key), key, "left_anti").select(*collection.columns).unionByName(new)


def delete(collection: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    """The collection without the keys of ids."""
    return collection.join(ids.select(key).distinct(), key, "left_anti").select(*collection.columns)


def stats(collection: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: vectors (null ones too), and their number of dimensions (the greatest; 0 if there is none)."""
    return collection.agg(F.count("*").alias("vectors"), F.coalesce(F.max(F.size(vector)), F.lit(0)).cast("bigint").alias("dimensions"))


class Collection:
    """A table in versions below a path: a write makes the next version, and readers take the latest complete one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def version(self) -> int:
        """The latest complete version, 0 before the first; a reader that remembers it sees by it whether to reload."""
        n = 0
        while exists(self.spark, f"{self.path}/v{n + 1}/_SUCCESS"):
            n += 1
        return n

    def write(self, rows: DataFrame) -> int:
        n = self.version + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/v{n}")
        return n

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{version or self.version}")


def rerank(hits: DataFrame, docs: DataFrame, queries: DataFrame, scorer: Scorer, key: str = "doc_id", top_k: int | None = None) -> DataFrame:
    """(qid, key, score, rank): hits scored anew by a scorer of query and text pairs (a cross-encoder), best first.

    The scorer runs in batches on the executors; pairs whose text or query is null are scored as ''.
    """
    from corpuslane.operators.search import top

    kinds = dict(hits.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = scorer(batch.column(2).to_pylist(), batch.column(3).to_pylist()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.round(np.asarray(scores, np.float64), 6))], ["qid", key, "score"])

    pairs = hits.select("qid", key).join(docs.select(key, F.coalesce("text", F.lit("")).alias("text")), key).join(queries.select("qid", F.coalesce("query", F.lit("")).alias("query")), "qid")
    scored = pairs.select("qid", key, "query", "text").mapInArrow(run, f"qid {kinds['qid']}, {key} {kinds[key]}, score double")
    return top(scored, ["qid"], [F.desc("score"), F.asc(key)], top_k)


def overlap_scorer(queries: list[str], texts: list[str]) -> list[float]:
    """The share of a query's distinct words (parted by blanks, lower-cased) that its text contains as words."""
    out = []
    for query, text in zip(queries, texts):
        asked = set(query.lower().split())
        out.append(len(asked & set(text.lower().split())) / len(asked) if asked else 0.0)
    return out


def semantic_units(docs: DataFrame, encoder: Encoder | None = None, key: str = "doc_id", text: str = "text", most: int = 500, least: int = 50) -> DataFrame:
    """(key, unit, text, embedding): each text's sentences in packs of up to `most` characters, with their vectors."""
    from corpuslane.operators.chunkers import chunked

    units = chunked(docs, "sentences_kit", key, text, most=most, least=least).select(F.struct(key, F.col("chunk_id").alias("unit"), "text").alias("u"), "text")
    return encode(units, "u", "text", encoder).select(f"u.{key}", "u.unit", "u.text", "embedding")
