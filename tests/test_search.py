import math
import random

import pytest
from conftest import rows

from corpuslane.operators import evaluate, search
from corpuslane.operators.answer import NOT_FOUND, citations, context_query, extractive_answer, last_user, rate_limited


def brute_bm25(docs, query, k1=1.5, b=0.75):
    toks = {d: t.lower().split() for d, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
    out = []
    for d, t in toks.items():
        s = sum(idf.get(w, 0) * t.count(w) * (k1 + 1) / (t.count(w) + k1 * (1 - b + b * len(t) / avg)) for w in query.lower().split())
        if round(s, 6) > 0:
            out.append((d, round(s, 6)))
    return sorted(out, key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("n", [1, 2, 3, 12])
def test_bm25(spark, n):
    random.seed(n)
    docs = [(k, " ".join(random.choices("red green blue cat dog tree sky".split(), k=random.randint(3, 9)))) for k in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "red cat"), (2, "cat cat unknown"), (3, ""), (4, None)], "qid long, query string")
    got = search.bm25_search(df, queries, 100).collect()
    for q, text in ((1, "red cat"), (2, "cat cat unknown")):
        mine = [(r.doc_id, r.score) for r in sorted((r for r in got if r.qid == q), key=lambda r: r["rank"])]
        want = brute_bm25(docs, text)
        assert [d for d, _ in mine] == [d for d, _ in want] and all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(mine, want))
    assert not any(r.qid in (3, 4) for r in got)


def test_bm25_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, "c d"), (5, "e f")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a")], "qid long, query string")
    assert [r.doc_id for r in search.bm25_search(df, queries).collect()] == [3]
    assert search.bm25_search(df.limit(0), queries).count() == 0


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, 0.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "qid long, embedding array<float>")
    assert [(r.vec_id, r["rank"]) for r in search.vector_search(v, q, 3).orderBy("rank").collect()] == [(1, 1), (6, 2), (2, 3)]
    assert search.vector_search(v, q.limit(0), 3).count() == 0


def test_fusion(spark):
    schema = "qid long, doc_id long, score double, rank int"
    lex = spark.createDataFrame([(1, 10, 5.0, 1), (1, 11, 3.0, 2), (2, 10, 4.0, 1)], schema)
    vec = spark.createDataFrame([(1, 11, 0.9, 1), (1, 12, 0.5, 2)], schema)
    assert rows(search.fuse(lex, vec)) == [(1, 10, 0.5, 1), (1, 11, 0.5, 2), (1, 12, 0.0, 3), (2, 10, 4.0, 1)]
    lone = spark.createDataFrame([(1, 12, 0.9, 1)], schema)
    assert [r.score for r in search.fuse(lex.where("qid = 1"), lone).orderBy("rank").collect()] == [0.5, 0.0, 0.0]
    e = search.ensemble([(lex.where("qid = 1"), 2.0), (vec, 1.0)])
    assert [r.doc_id for r in e.orderBy("rank").collect()] == [10, 11, 12]


def test_metrics(spark):
    runs = spark.createDataFrame([(1, ["A ", "b", "c"], ["a", "c", "c"]), (2, [], ["a"]), (3, ["a"], []), (4, None, None), (5, ["a", "a"], ["a"])], "qid long, retrieved array<string>, relevant array<string>")
    got = {(r.qid, r.metric, r.k): r.value for r in evaluate.eval_single(runs).collect()}
    assert got[1, "recall", 1] == 0.5 and got[1, "recall", 3] == 1.0 and got[1, "precision", 3] == round(2 / 3, 6) and got[1, "mrr", 0] == 1.0
    assert got[1, "ndcg", 3] == round((1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3)), 6)
    assert all(got[q, m, 5] == 0 for q in (2, 3, 4) for m in ("recall", "precision", "ndcg", "hit_rate"))
    assert got[5, "ndcg", 3] > 1 and got[5, "recall", 3] == 1.0
    batch = {(r.metric, r.k): r.value for r in evaluate.eval_batch(runs).collect()}
    assert batch["recall", 1] == round((0.5 + 0 + 0 + 0 + 1) / 5, 6)


def test_judge(spark):
    df = spark.createDataFrame([("0.7",), (" 2 ",), ("-1",), ("good",), (None,), ("NaN",)], "a string")
    assert [r[0] for r in df.select(evaluate.judge_score(df.a)).collect()] == [0.7, 1.0, 0.0, 0.5, 0.5, 0.5]


def test_answers(spark):
    docs = spark.createDataFrame([(1, "d/x.txt", "Cats sleep."), (2, "y.txt", "Dogs bark."), (3, "z.txt", "Fish swim.")], "doc_id long, path string, text string")
    queries = spark.createDataFrame([(1, "cats"), (2, "zebra")], "qid long, query string")
    cited = citations(search.bm25_search(docs, queries), docs, queries)
    got = dict((r.qid, r.answer) for r in extractive_answer(cited, queries).collect())
    assert "x.txt" in got[1] and "Cats sleep." in got[1] and got[2] == NOT_FOUND


def test_turns(spark):
    t = spark.createDataFrame([(1, k, "user" if k % 2 else "assistant", f"m{k}") for k in range(1, 9)] + [(2, 1, "assistant", "x")], "conv_id long, turn int, role string, text string")
    assert rows(last_user(t)) == [(1, 7, "m7")] and rows(context_query(t)) == [(1, "m5 m7")]


def test_rate_limit(spark):
    t = [(k, 1, f"2024-01-01 00:00:{s:02d}") for k, s in enumerate([0, 1, 2, 3, 10, 11, 12])] + [(9, None, "2024-01-01 00:00:00"), (10, 2, None)]
    df = spark.createDataFrame(t, "event_id long, user_id long, ts string").selectExpr("event_id", "user_id", "to_timestamp(ts) ts")
    got = [r.allowed for r in rate_limited(df, 2, 10).orderBy("event_id").collect()]
    assert got == [True, True, False, False, True, True, False]
