"""A stored BM25 index: postings, terms and corpus figures as tables, built once for each state of the documents.

Postings are partitioned by a hash of their term, so that a search reads only the partitions of its terms; a term's
postings are spread over several files by a hash of the document, so that a very common term is no single task's work.
Documents are tokenised when they are indexed, never by a search.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslane.functions.text import tokens
from corpuslane.operators.search import B, EPSILON, K1, top
from corpuslane.session import exists, shared_dir

BUCKETS = 16
#: Documents whose postings of one bucket make a file.
DOCUMENTS_A_FILE = 1_000_000
#: Rows (a term of a query each) up to which the asked terms are broadcast.
MOST_BROADCAST = 200_000


def _bucket(term: str = "term"):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def counted_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dl, term, tf): the terms of each document, counted inside its row; documents without terms have one null."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, terms, counts = [], [], [], []
            for n, t in enumerate(batch.column(1).to_pylist()):
                found = Counter(t)
                of = max(1, len(found))
                keys += [n] * of
                sizes += [len(t)] * of
                terms += found or [None]
                counts += found.values() or [0]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int32())), pa.array(sizes, pa.int64()), pa.array(terms, pa.string()), pa.array(counts, pa.int64())], [key, "dl", "term", "tf"])

    return docs.select(key, tokens(F.col(text)).alias("t")).mapInArrow(run, f"{key} {kind}, dl bigint, term string, tf bigint")


class Index:
    """An index at a path: tables `postings` (one folder for each append), `terms` and `corpus`."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    @property
    def ready(self) -> bool:
        return exists(self.spark, f"{self.path}/corpus/_SUCCESS")

    def append(self, docs: DataFrame, text: str = "text") -> Index:
        """Adds documents, whose keys must be new, and makes the figures of all anew from the postings."""
        n = docs.count()
        if not exists(self.spark, f"{self.path}/keys/_SUCCESS"):
            docs.select(self.key).limit(0).write.mode("overwrite").parquet(f"{self.path}/keys")
        rows = counted_terms(docs, self.key, text).withColumn("bucket", _bucket())
        files = max(1, n // DOCUMENTS_A_FILE)
        spread = rows.repartition(BUCKETS * files, "bucket", F.pmod(F.xxhash64(self.key), F.lit(files)))
        spread.sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        return self.refresh()

    def refresh(self) -> Index:
        all_rows = self._table("postings")
        by_document = all_rows.groupBy(self.key).agg(F.first("dl").alias("dl"))
        corpus = by_document.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        raw = F.log(F.lit(corpus.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        terms = all_rows.where("term is not null").groupBy("bucket", "term").agg(F.count("*").alias("df")).withColumn("raw", raw)
        terms.write.mode("overwrite").parquet(f"{self.path}/terms")
        mean = self._table("terms").agg(F.avg("raw").alias("mean")).first().mean
        figures = self.spark.createDataFrame([(corpus.n, corpus.avgdl, mean)], "n bigint, avgdl double, mean double")
        figures.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/corpus")
        return self

    def _table(self, name: str) -> DataFrame:
        if name != "postings":
            return self.spark.read.parquet(f"{self.path}/{name}")
        kind = self._table("keys").schema[self.key].dataType.simpleString()  # no rows, no folders to tell the schema from
        return self.spark.read.schema(f"{self.key} {kind}, dl bigint, term string, tf bigint, bucket int").parquet(f"{self.path}/postings")

    def postings(self) -> DataFrame:
        """(key, term, tf, dl) of all documents."""
        return self._table("postings").where("term is not null").select(self.key, "term", "tf", "dl")

    def terms(self) -> DataFrame:
        """(bucket, term, df, idf): Okapi weights; negative ones become a quarter of the mean weight."""
        mean = self._table("corpus").first().mean
        weight = F.when(F.col("raw") < 0, EPSILON * F.lit(mean).cast("double")).otherwise(F.col("raw"))
        return self._table("terms").select(F.col("bucket").cast("int").alias("bucket"), "term", "df", weight.alias("idf"))

    def stats(self) -> DataFrame:
        """One row: documents, terms, mean length."""
        return self._table("corpus").crossJoin(self._table("terms").agg(F.count("*").alias("terms"))).select(F.col("n").alias("documents"), "terms", F.coalesce("avgdl", F.lit(0.0)).alias("avgdl"))

    def search(self, queries: DataFrame, top_k: int = 10, qid: str = "qid", query: str = "query") -> DataFrame:
        """(qid, key, score, rank): as search.bm25_search, without reading a document."""
        asked = queries.select(F.col(qid).alias("qid"), F.explode(tokens(F.col(query))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf")).withColumn("bucket", _bucket())
        weighted = asked.join(self.terms(), ["bucket", "term"]).select("qid", "bucket", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
        if queries.count() * 50 <= MOST_BROADCAST or asked.count() <= MOST_BROADCAST:
            weighted = F.broadcast(weighted)
        avgdl = self._table("corpus").first().avgdl
        part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
        buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS
        hits = self._table("postings").where(F.col("bucket").isin(buckets)).join(weighted, ["bucket", "term"])
        scored = hits.groupBy("qid", self.key).agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
        return top(scored, ["qid"], [F.desc("score"), F.asc(self.key)], top_k)


def version(docs: DataFrame, key: str, text: str) -> str:
    """A value of the state of a table: changes with any row."""
    r = docs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(key, text)).alias("x"), F.sum(F.hash(key, text).cast("bigint")).alias("s")).first()
    return f"{r.n:x}-{(r.x or 0) & (2**64 - 1):x}-{(r.s or 0) & (2**64 - 1):x}"


def ensure(docs: DataFrame, key: str = "doc_id", text: str = "text", root: str | None = None) -> Index:
    """The index of the documents as they are now under root (the shared folder): reused if it is there, else built."""
    spark = docs.sparkSession
    index = Index(spark, f"{root or shared_dir(spark)}/bm25/{key}-{text}-{version(docs, key, text)}", key)
    return index if index.ready else index.append(docs, text)
