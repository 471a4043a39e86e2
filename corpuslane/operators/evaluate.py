"""Retrieval metrics over ranked lists (qid, retrieved, relevant), and the scores of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (1, 3, 5, 10, 20)


def clean_ids(ids: Column) -> Column:
    return F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))


def recall(got: Column, wanted: Column, k: int) -> Column:
    distinct = F.array_distinct(wanted)
    return F.when(F.size(distinct) == 0, 0.0).otherwise(F.size(F.array_intersect(F.slice(got, 1, k), distinct)) / F.size(distinct))


def precision(got: Column, wanted: Column, k: int) -> Column:
    """Hits, repeated ones too, by the number actually retrieved."""
    first = F.slice(got, 1, k)
    return F.when(F.size(first) == 0, 0.0).otherwise(F.size(F.filter(first, lambda x: F.array_contains(wanted, x))) / F.size(first))


def mrr(got: Column, wanted: Column) -> Column:
    at = F.array_position(F.transform(got, lambda x: F.array_contains(wanted, x)), True)
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def dcg(got: Column, wanted: Column, k: int) -> Column:
    gains = F.transform(F.slice(got, 1, k), lambda x, i: F.when(F.array_contains(wanted, x), 1.0 / F.log2(i + F.lit(2.0))).otherwise(0.0))
    return F.aggregate(gains, F.lit(0.0), lambda a, x: a + x)


def ndcg(got: Column, wanted: Column, k: int) -> Column:
    ideal = F.aggregate(F.transform(F.slice(F.array_distinct(wanted), 1, k), lambda x, i: 1.0 / F.log2(i + F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)
    return F.when(ideal == 0, 0.0).otherwise(dcg(got, wanted, k) / ideal)


def hit_rate(got: Column, wanted: Column, k: int) -> Column:
    return F.when(F.arrays_overlap(F.slice(got, 1, k), wanted), 1.0).otherwise(0.0)


AT_K = {"recall": recall, "precision": precision, "ndcg": ndcg, "dcg": dcg, "hit_rate": hit_rate}


def eval_single(runs: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(qid, metric, k, value): every metric of every query; mrr has k 0. Null lists count as empty."""
    r = runs.select("qid", clean_ids(F.col("retrieved")).alias("got"), clean_ids(F.col("relevant")).alias("wanted"))
    g, w = F.col("got"), F.col("wanted")
    values = [F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), F.round(f(g, w, k), 6).alias("value")) for m, f in AT_K.items() for k in ks]
    values.append(F.struct(F.lit("mrr").alias("metric"), F.lit(0).alias("k"), F.round(mrr(g, w), 6).alias("value")))
    return r.select("qid", F.inline(F.array(*values)))


def eval_batch(runs: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(metric, k, value): means over all queries; without queries there are no rows."""
    return eval_single(runs, ks).groupBy("metric", "k").agg(F.round(F.avg("value"), 6).alias("value"))


def judge_score(answer: Column) -> Column:
    """A judge's answer as a number between 0 and 1; 0.5 where it is none."""
    number = F.trim(answer).try_cast("double")
    return F.when(number.isNull() | F.isnan(number), 0.5).when(number < 0, 0.0).when(number > 1, 1.0).otherwise(number)


def answer_quality(faithfulness: Column, relevance: Column, coherence: float = 0.8, completeness: float = 0.8) -> Column:
    return (faithfulness + relevance + coherence + completeness) / 4


def summary(means: DataFrame) -> DataFrame:
    """(summary): one text of the means (metric, k, value): MRR, then recall, precision and NDCG at each k."""
    four = lambda c: F.format_string("%.4f", c)
    pick = lambda m: F.coalesce(F.max(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0))
    by_k = means.groupBy("k").agg(pick("mrr").alias("m"), pick("recall").alias("r"), pick("precision").alias("p"), pick("ndcg").alias("n"))
    line = F.when(F.col("k") == 0, F.concat(F.lit("MRR: "), four(F.col("m")))).otherwise(F.concat(F.lit("R@"), F.col("k").cast("string"), F.lit(": "), four(F.col("r")), F.lit(" | P@"), F.col("k").cast("string"), F.lit(": "), four(F.col("p")), F.lit(" | NDCG@"), F.col("k").cast("string"), F.lit(": "), four(F.col("n"))))
    return by_k.select("k", line.alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("summary"))
