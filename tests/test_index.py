"""Stored index, vector collections, hooks, routing, and streams that begin without a table."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from corpuslane import session
from corpuslane.operators import answer, evaluate, index, search, vectors
from corpuslane.sources import files
from corpuslane.streaming import streams

DOCS = [(1, "the red cat sat on the mat"), (2, "a blue dog and the red ball"), (3, None), (4, ""), (5, "red red red"), (6, "green tree")]
QUERIES = [(1, "red cat"), (2, "the THE dog"), (3, ""), (4, "nothing known"), (5, None)]


def test_index_gives_what_the_search_of_texts_gives(spark, tmp_path):
    docs, queries = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(QUERIES, "qid long, query string")
    want = rows(search.bm25_search(docs, queries, 3).select("qid", "doc_id", "score", "rank"))
    made = index.ensure(docs, root=str(tmp_path))
    assert rows(made.search(queries, 3).select("qid", "doc_id", "score", "rank")) == want and want
    assert index.ensure(docs, root=str(tmp_path)).path == made.path  # reused
    assert index.ensure(docs.where("doc_id > 1"), root=str(tmp_path)).path != made.path  # another state, another index
    parts = index.Index(spark, str(tmp_path / "parts"))
    assert not parts.ready
    parts.append(docs.where("doc_id < 3")).append(docs.where("doc_id >= 3"))
    assert rows(parts.search(queries, 3).select("qid", "doc_id", "score", "rank")) == want
    assert tuple(made.stats().first())[:2] == (6, 13)
    assert index.ensure(docs.limit(0), root=str(tmp_path)).search(queries).count() == 0


def test_search_reads_no_text(spark, tmp_path):
    docs, queries = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(QUERIES, "qid long, query string")
    plan = index.ensure(docs, root=str(tmp_path)).search(queries)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 3 and "PythonUDF" not in plan and "PartitionFilters: [" in plan


def test_vectors(spark, tmp_path):
    docs = spark.createDataFrame([*DOCS, (7, "Red, CAT!")], "doc_id long, text string")
    got = {r.doc_id: np.array(r.embedding) for r in vectors.encode(docs, encoder=None).collect()}
    assert len(got) == 7 and all(len(v) == 384 for v in got.values()) and not got[3].any() and not got[4].any()
    assert abs(np.linalg.norm(got[1]) - 1) < 1e-6 and got[7] @ got[5] > 0.5
    old = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (None, [9.0])], "vec_id long, embedding array<float>")
    put = vectors.upsert(old, spark.createDataFrame([("x", 2, [5.0]), ("x", 3, None)], "more string, vec_id long, embedding array<float>"))
    assert sorted((r.vec_id or 0, r.embedding) for r in put.collect()) == [(0, [9.0]), (1, [1.0]), (2, [5.0]), (3, None)]
    assert vectors.delete(put, spark.createDataFrame([(2,), (2,), (8,)], "vec_id long")).count() == 3
    store = vectors.Collection(spark, str(tmp_path / "c"))
    assert store.version == 0
    store.write(old)
    store.write(vectors.upsert(store.read(), old.limit(1)))
    assert store.version == 2 and store.read().count() == store.read(1).count() == 3
    assert tuple(vectors.stats(old.limit(0)).first()) == (0, 0)


def test_hooks(spark):
    docs, queries = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("path", F.lit("d/f.txt")), spark.createDataFrame(QUERIES, "qid long, query string")
    hits = search.bm25_search(docs, queries, 3)
    best = vectors.rerank(hits, docs, queries, lambda q, t: [len(x) for x in t])
    assert [r.doc_id for r in best.where("qid = 2").orderBy("rank").collect()] == [2, 1]
    cited = answer.citations(hits, docs, queries)

    def writer(asked, contexts):
        return [f"{a}: {c.count('Source')}" if a == "red cat" else None for a, c in zip(asked, contexts)]

    got = {r.qid: (r.answer, r.method) for r in answer.routed_answer(cited, queries, writer).collect()}
    assert got[1] == ("red cat: 1", "llm") and got[2][1] == "extractive" and got[2][0].startswith(answer.HEADER) and got[4] == (answer.NOT_FOUND, "extractive")

    def broken(asked, contexts):
        raise ValueError

    assert {r.method for r in answer.routed_answer(cited, queries, broken).collect()} == {"extractive"}
    turns = spark.createDataFrame([("c", 1, "user", "red cat"), ("d", 1, "assistant", "x")], "conv_id string, turn long, role string, text string")
    said = answer.chat_turn(turns, spark.createDataFrame([("c", "A.")], "conv_id string, answer string"), 1)
    assert rows(said) == [("c", 2, "assistant", "A."), ("d", 1, "assistant", "x")]


def test_routes(spark):
    requests = spark.createDataFrame([(1, "bm25"), (2, "embedding"), (3, "hybrid"), (4, "odd"), (5, None)], "qid long, method string")
    lexical = spark.createDataFrame([(q, 10, 2.0, 1) for q in range(1, 6)], "qid long, doc_id long, score double, rank int")
    vector = spark.createDataFrame([(q, 20, 0.9, 1) for q in range(1, 6)], "qid long, doc_id long, score double, rank int")
    got = [r[:3] for r in rows(search.routed(requests, lexical, vector))]
    assert got == [(1, "bm25", 10), (2, "embedding", 20), (3, "hybrid", 10), (3, "hybrid", 20), (4, "bm25", 10), (5, "bm25", 10)]
    assert [r[:3] for r in rows(search.routed(requests, lexical, None))] == [(q, "bm25", 10) for q in (1, 3, 4, 5)]
    asked = spark.createDataFrame([(1, "x", 5, "bm25"), (2, "", 5, None), (3, "x", 0, None), (4, "x", None, "odd"), (5, None, 1, None), (6, "y" * 2001, 1, None)], "qid long, query string, top_k int, method string")
    assert [r[1] for r in rows(search.invalid(asked))] == [None, "query", "top_k", "method", "query", "query"]
    assert evaluate.summary(spark.createDataFrame([("mrr", 0, 0.5), ("recall", 1, 0.25), ("precision", 1, 1.0)], "metric string, k int, value double")).first()[0] == "MRR: 0.5000\nR@1: 0.2500 | P@1: 1.0000 | NDCG@1: 0.0000"


def test_encodings(spark):
    df = spark.createDataFrame([(bytearray("naïve\r\n".encode(e)),) for e in ("utf-8", "latin-1", "utf-16")] + [(None,)], "content binary")
    assert [tuple(r) for r in df.select(files.decoded(df.content), files.encoding(df.content)).collect()][:3] == [("naïve\n", "utf-8"), ("naïve\n", "latin-1"), ("naïve\n", "utf-16")]


def test_mail_box_without_a_file():
    box = b"From a@x Mon Jan  1 00:00:00 2024\nSubject: one\n\nbody\n>From here\n\nFrom b@x Mon Jan  1 00:00:00 2024\nSubject: two\n\nmore\n"
    assert [(m["subject"], m["body_text"].strip()) for m in files.messages(box, True)] == [("one", "body\nFrom here"), ("two", "more")]
    assert list(files.messages(b"", True)) == []


def test_clusters_need_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError):
        session.shared_dir(Session)
    assert session.exists(spark, session.shared_dir(spark)) and not session.exists(spark, "/nowhere/at/all")


def test_streams_of_conversations(spark, tmp_path):
    spark.createDataFrame([("c", k, "user", f"t{k}") for k in range(25)] + [("d", 1, "user", "x")], "conv_id string, turn long, role string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("conv_id string, turn long, role string, text string").parquet(str(tmp_path / "in"))
    run = streams.history_stream(stream, 20).writeStream.format("memory").queryName("turns_kept").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {r.conv_id: (r.turns, r.history[0]) for r in spark.table("turns_kept").collect()}
    assert got == {"c": (20, "user: t5"), "d": (1, "user: x")}
