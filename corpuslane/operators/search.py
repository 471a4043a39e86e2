"""Ranked retrieval over a table of texts: BM25 (Okapi), vectors, and their fusion, for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.functions.text import tokens

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Vectors of queries that are sent to the executors at once.
QUERIES_AT_ONCE = 2048


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf, dl): how often each document holds each term, and its number of tokens."""
    split = docs.select(F.col(key), tokens(F.col(text)).alias("t")).select(key, F.size("t").alias("dl"), F.explode("t").alias("term"))
    return split.groupBy(key, "dl", "term").agg(F.count("*").alias("tf")).select(key, "term", "tf", "dl")


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: number of documents and mean number of tokens."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col(text)))).alias("avgdl"))


def term_stats(posted: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf): document frequency and Okapi weight; negative weights become a quarter of the mean weight."""
    raw = posted.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25_search(docs: DataFrame, queries: DataFrame, top_k: int = 10, key: str = "doc_id", text: str = "text", qid: str = "qid", query: str = "query") -> DataFrame:
    """(qid, key, score, rank): the best documents of each query, scores rounded to 6 places, ties by key.

    Repeated tokens of a query count again; documents must score above 0. A corpus of one document, and empty queries,
    have no hits. Null texts count as empty documents.
    """
    posted, stats = postings(docs, key, text), corpus_stats(docs, text)
    asked = queries.select(F.col(qid).alias("qid"), F.explode(tokens(F.col(query))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    weights = term_stats(posted, stats).join(asked.select("term").distinct(), "term", "left_semi")
    hits = posted.join(weights, "term").crossJoin(F.broadcast(stats)).select(key, "term", (F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).alias("part"))
    scored = hits.join(asked, "term").groupBy("qid", key).agg(F.round(F.sum(F.col("qtf") * F.col("part")), 6).alias("score")).where("score > 0")
    return top(scored, ["qid"], [F.desc("score"), F.asc(key)], top_k)


def top(scored: DataFrame, by: list[str], order: list[Column], k: int | None) -> DataFrame:
    """Ranks rows within groups; with k, only the first ones are kept (limited before the shuffle by the engine)."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked if not k else ranked.where(F.col("rank") <= k)


def vector_search(vectors: DataFrame, queries: DataFrame, top_k: int = 10, threshold: float | None = 0.5, key: str = "vec_id", vector: str = "embedding", qid: str = "qid") -> DataFrame:
    """(qid, key, score, rank): nearest vectors of each query by cosine, exact, scores rounded to 6 places.

    Queries go to the executors in blocks of bounded size; a task keeps its own best rows of each query, with all ties
    at the last place, and these are ranked. Null and zero vectors have no score.
    """
    kind = vectors.schema[key].dataType.simpleString()
    q_kind = queries.schema[qid].dataType
    parts, block = [], []

    def scan(ids: list, matrix: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(k, v) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if v is not None and len(v) == matrix.shape[1] and None not in v]
                if not rows:
                    continue
                m = np.array([v for _, v in rows], np.float64)
                norm = np.sqrt((m * m).sum(axis=1))
                score = np.round(matrix @ (m / np.where(norm == 0, np.nan, norm)[:, None]).T, 6)
                score = np.where(np.isnan(score), -np.inf, score)
                if threshold is not None:
                    score = np.where(score >= threshold, score, -np.inf)
                least = np.partition(score, -top_k, axis=1)[:, -top_k] if top_k and score.shape[1] > top_k else np.full(len(ids), -np.inf)
                q, d = np.nonzero((score >= least[:, None]) & np.isfinite(score))
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in q]), pa.array([rows[k][0] for k in d], batch.schema.field(0).type), pa.array(score[q, d])], ["qid", key, "score"])

        return vectors.select(key, vector).mapInArrow(run, f"qid {q_kind.simpleString()}, {key} {kind}, score double")

    for r in queries.select(qid, vector).where(F.col(vector).isNotNull()).toLocalIterator():
        norm = float(np.sqrt(np.square(np.array(r[1], np.float64)).sum()))
        if norm:
            block.append((r[0], np.array(r[1], np.float64) / norm))
        if len(block) == QUERIES_AT_ONCE:
            parts.append(scan([b[0] for b in block], np.array([b[1] for b in block])))
            block = []
    if block:
        parts.append(scan([b[0] for b in block], np.array([b[1] for b in block])))
    if not parts:
        return vectors.sparkSession.createDataFrame([], f"qid {q_kind.simpleString()}, {key} {kind}, score double, rank int")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return top(out, ["qid"], [F.desc("score"), F.asc(key)], top_k)


def minmax(scored: DataFrame, by: list[str], score: str = "score", flat: float | None = None) -> DataFrame:
    """Adds `norm`: the score between the least and the greatest of its group; a flat group's scores become 0 (or flat)."""
    w = Window.partitionBy(*by)
    low, span = F.min(score).over(w), F.max(score).over(w) - F.min(score).over(w)
    value = (F.col(score) - low) / F.when(span == 0, 1.0).otherwise(span)
    return scored.withColumn("norm", F.when(span == 0, F.lit(float(flat))).otherwise(value) if flat is not None else value)


def fuse(lexical: DataFrame, vector: DataFrame, key: str = "doc_id", top_k: int = 10, weight: float = 0.5) -> DataFrame:
    """(qid, key, score, rank): weighted sum of min-max normalised scores of two hit lists (qid, key, score, rank).

    A side that lacks a hit counts 0. A query without vector hits keeps its lexical scores as they are. Ties: lexical
    hits in their order first.
    """
    b = minmax(lexical, ["qid"]).select("qid", key, F.col("norm").alias("b"), F.col("score").alias("raw"), F.col("rank").alias("br"))
    v = minmax(vector, ["qid"]).groupBy("qid", key).agg(F.max_by("norm", "rank").alias("v"), F.min("rank").alias("vr"))
    some = vector.select("qid").distinct().withColumn("has", F.lit(True))
    both = b.join(v, ["qid", key], "full_outer").join(some, "qid", "left")
    mixed = weight * F.coalesce("b", F.lit(0.0)) + (1 - weight) * F.coalesce("v", F.lit(0.0))
    scored = both.withColumn("score", F.round(F.when(F.col("has"), mixed).otherwise(F.col("raw")), 6))
    return top(scored, ["qid"], [F.desc("score"), F.expr("br is null"), F.asc("br"), F.asc("vr"), F.asc(key)], top_k).select("qid", key, "score", "rank")


def ensemble(lists: list[tuple[DataFrame, float]], key: str = "doc_id", top_k: int | None = None) -> DataFrame:
    """(qid, key, score, rank): weighted mean of min-max normalised scores over several scorers' lists (qid, key, score).

    Weights are divided by their sum; a flat list's scores become 0; a list without the document adds 0.
    """
    total = sum(w for _, w in lists)
    parts = [minmax(d.select("qid", key, "score"), ["qid"]).select("qid", key, (F.col("norm") * (w / total)).alias("part")) for d, w in lists]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    scored = whole.groupBy("qid", key).agg(F.round(F.sum("part"), 6).alias("score"))
    return top(scored, ["qid"], [F.desc("score"), F.asc(key)], top_k)


def routed(requests: DataFrame, lexical: DataFrame, vector: DataFrame | None, key: str = "doc_id", top_k: int = 10) -> DataFrame:
    """(qid, method, key, score, rank): each request (qid, method) answered by its method: bm25, embedding or hybrid.

    lexical has twice top_k hits of each request for the fusion. Without vectors, hybrid requests fall back to bm25 and
    embedding requests have no hits; unknown and null methods are bm25.
    """
    asked = requests.select("qid", F.when(F.col("method").isin("embedding", "hybrid"), F.col("method")).otherwise("bm25").alias("method"))
    if vector is None:
        asked = asked.where("method <> 'embedding'").withColumn("method", F.lit("bm25"))
    sides = {"bm25": lexical.where(F.col("rank") <= top_k)}
    if vector is not None:
        sides |= {"embedding": vector.where(F.col("rank") <= top_k), "hybrid": fuse(lexical, vector.where(F.col("rank") <= top_k), key, top_k)}
    parts = [hits.select("qid", key, "score", "rank").join(asked.where(F.col("method") == m), "qid").select("qid", "method", key, "score", "rank") for m, hits in sides.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def invalid(requests: DataFrame, most_k: int = 100, most_length: int = 2000) -> DataFrame:
    """(qid, error): what is wrong with each request (qid, query, top_k, method), null for good ones.

    A query has 1 to most_length characters, top_k (null: the default) lies between 1 and most_k, and the method is bm25,
    embedding, hybrid or null.
    """
    size = F.coalesce(F.length("query"), F.lit(0))
    error = F.when((size < 1) | (size > most_length), "query").when(~F.coalesce(F.col("top_k"), F.lit(1)).between(1, most_k), "top_k").when(~F.coalesce(F.col("method"), F.lit("bm25")).isin("bm25", "embedding", "hybrid"), "method")
    return requests.select("qid", error.alias("error"))
