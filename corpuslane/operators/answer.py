"""Citations, contexts and extractive answers from hits, and the context of conversations."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.functions.text import basename, excerpt, highlight

#: Texts of answers and contexts (fixed values).
NOT_FOUND = "I couldn't find any relevant information in the indexed documents for your question."
HEADER, FOOTER = "Based on your indexed documents, here are the most relevant excerpts:", "---\n*This is an extractive answer based on BM25 retrieval.*"
RULE = "\n---\n"


def citations(hits: DataFrame, chunks: DataFrame, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """(qid, key, rank, score, path, chunk_id, text, highlight): hits with their rows and a marked passage.

    chunk_id is 0 where the rows have none.
    """
    number = F.col("chunk_id") if "chunk_id" in chunks.columns else F.lit(0)
    joined = hits.join(chunks.select(key, "path", number.alias("chunk_id"), "text"), key).join(queries.select("qid", "query"), "qid")
    return joined.select("qid", key, "rank", "score", "path", "chunk_id", "text", highlight(F.col("text"), F.col("query")).alias("highlight"))


def _ordered(cited: DataFrame, most: int) -> DataFrame:
    return cited.where(F.col("rank") <= most).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "chunk_id", "text", "score"))).alias("c"))


def format_context(cited: DataFrame, most: int = 10) -> DataFrame:
    """(qid, context): a header and the text of each citation, in order, parted by rules."""
    part = lambda x: F.concat(F.lit("[Source: "), basename(x["path"]), F.lit(", Chunk #"), x["chunk_id"].cast("string"), F.lit("]\n"), x["text"], F.lit("\n"))
    return _ordered(cited, most).select("qid", F.array_join(F.transform("c", part), RULE).alias("context"))


def extractive_answer(cited: DataFrame, queries: DataFrame, most: int = 3, length: int = 500) -> DataFrame:
    """(qid, answer): numbered excerpts of the best citations with their sources and scores, between a header and a footer.

    A fixed text where there are no citations.
    """
    part = lambda x, n: F.concat(F.lit("**["), (n + 1).cast("string"), F.lit("] From: "), basename(x["path"]), F.lit("** (relevance: "), F.round(x["score"], 2).cast("decimal(18,2)").cast("string"), F.lit(")\n> "), excerpt(x["text"], length))
    body = F.concat(F.lit(f"{HEADER}\n\n"), F.array_join(F.transform("c", part), "\n"), F.lit(f"\n\n{FOOTER}"))
    found = _ordered(cited, most).select("qid", body.alias("a"))
    return queries.select("qid").join(found, "qid", "left").select("qid", F.coalesce("a", F.lit(NOT_FOUND)).alias("answer"))


def routed_answer(cited: DataFrame, queries: DataFrame, writer: Callable[[list[str], list[str]], list[str | None]] | None = None) -> DataFrame:
    """(qid, answer, method): answers by a writer (a language model) of queries and contexts, else extractive ones.

    The writer runs in batches on the executors; a batch it fails on, and queries it gives null for, are answered
    extractively, and so are all without a writer.
    """
    plain = extractive_answer(cited, queries)
    if writer is None:
        return plain.withColumn("method", F.lit("extractive"))
    kind = dict(queries.dtypes)["qid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            try:
                written = writer(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            except Exception:  # noqa: BLE001 - what a model does not answer is answered extractively
                written = [None] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(written, pa.string())], ["qid", "written"])

    asked = queries.select("qid", "query").join(format_context(cited), "qid", "left").select("qid", "query", F.coalesce("context", F.lit("")).alias("context"))
    joined = plain.join(asked.mapInArrow(run, f"qid {kind}, written string"), "qid", "left")
    return joined.select("qid", F.coalesce("written", "answer").alias("answer"), F.when(F.col("written").isNotNull(), "llm").otherwise("extractive").alias("method"))


def chat_turn(turns: DataFrame, answers: DataFrame, keep: int = 20) -> DataFrame:
    """(conv_id, turn, role, text): the last `keep` turns of each conversation once its answer (conv_id, answer) is added.

    Conversations without an answer, as those without a message of a user, stay as they are.
    """
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    new = last.join(answers, "conv_id").select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    whole = turns.select("conv_id", "turn", "role", "text").unionByName(new)
    return whole.withColumn("p", place).where(F.col("p") <= keep).drop("p")


def last_user(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, text): the last message of a user in each conversation."""
    return turns.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def context_query(turns: DataFrame, last: int = 5) -> DataFrame:
    """(conv_id, query): the users' messages among the last turns, in order, joined by blanks."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    recent = turns.withColumn("p", place).where(F.col("p") <= last).where("role = 'user'")
    return recent.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("query"))


def prompt_context(cited: DataFrame, most: int = 5, length: int = 500) -> DataFrame:
    """(qid, context): the beginnings of the best citations, numbered."""
    part = lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), F.substring(x["text"], 1, length))
    return _ordered(cited, most).select("qid", F.array_join(F.transform("c", part), "\n").alias("context"))


def rate_limited(requests: DataFrame, most: int, seconds: int, client: str = "user_id", at: str = "ts", key: str = "event_id") -> DataFrame:
    """(key, client, at, allowed): a sliding log per client; rejected requests are not recorded.

    A request is allowed if fewer than `most` allowed ones lie within the seconds before it, ties in order of key. A
    task streams over its sorted rows and holds the times of one client's last allowed requests only, so that a client
    with very many requests costs no memory. Requests without client or time are left out.
    """
    t = dict(requests.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, log = None, deque()
        for batch in batches:
            allowed = []
            for c, micros in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if c != now:
                    now, log = c, deque()
                while log and log[0] <= micros - seconds * 1_000_000:
                    log.popleft()
                allowed.append(len(log) < most)
                if allowed[-1]:
                    log.append(micros)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(allowed, pa.bool_())], [key, client, at, "allowed"])

    rows = requests.where(F.col(client).isNotNull() & F.col(at).isNotNull()).select(key, client, at, F.unix_micros(F.col(at).cast("timestamp")).alias("micros"))
    return rows.repartition(F.col(client)).sortWithinPartitions(client, "micros", key).mapInArrow(run, f"{key} {t[key]}, {client} {t[client]}, {at} {t[at]}, allowed boolean")
