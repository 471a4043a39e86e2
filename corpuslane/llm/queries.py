"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslane.llm import code_docs, emails, encoding, language, markup, near_duplicates, packing, page_content, scans
from corpuslane.llm.leakage import SPAN, leaks
from corpuslane.session import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return emails.new_line_numbers(read(spark, d, "parsed_emails"))


def p1_bodies(spark: SparkSession, d: str) -> DataFrame:
    table = read(spark, d, "parsed_emails")
    new = emails.new_lines(table).groupBy("email_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    return table.select("email_id", emails.bare_subject(F.col("subject")).alias("subject")).join(new, "email_id", "left").select("email_id", "subject", F.array_join("x.line", "\n").alias("new_text"))


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return code_docs.documented(read(spark, d, "code_files"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pairs(spark, d).where("source = 'own'").select("file_id", "line_start").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.pairs(read(spark, d, "chunks"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.groups(read(spark, d, "chunks"))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled(read(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_repaired(spark, d).select("row_id", "field")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise(read(spark, d, "pdf_pages"))


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.paragraphs(read(spark, d, "pdf_pages"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.marked(read(spark, d, "chunks"))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.cleaned(read(spark, d, "chunks")).select("row_id", F.array_join("markup", ",").alias("markup"), "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return page_content.main_lines(read(spark, d, "url_contents"))


def p7_main(spark: SparkSession, d: str) -> DataFrame:
    return page_content.main_text(read(spark, d, "url_contents"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    capacities = {r.budget_id: r.capacity for r in read(spark, d, "token_budgets").select("budget_id", "capacity").collect()}
    return packing.pack(packing.token_counts(read(spark, d, "documents")), capacities)


def p8_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per budget: documents placed, pieces placed twice, places in a container taken twice, overfull containers, tokens lost."""
    packed = p8_packed(spark, d)
    counted = packing.token_counts(read(spark, d, "documents")).agg(F.sum("tokens").alias("all"))
    pieces = packed.groupBy("budget_id", "doc_id").agg(F.count("*").alias("n"), F.count_distinct("piece").alias("m"), F.sum("tokens").alias("t"))
    items = pieces.groupBy("budget_id").agg(F.count("*").alias("documents"), F.sum(F.col("n") - F.col("m")).alias("repeated"), F.sum("t").alias("t"))
    held = packed.groupBy("budget_id", "capacity", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.count_distinct("place").alias("m"))
    boxes = held.groupBy("budget_id").agg(F.sum(F.col("n") - F.col("m")).alias("clashes"), F.count_if(F.col("t") > F.col("capacity")).alias("overfull"))
    return items.join(boxes, "budget_id").crossJoin(F.broadcast(counted)).select("budget_id", "documents", "repeated", "clashes", "overfull", (F.col("all") - F.col("t")).alias("lost"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).where(f"exact_run >= {SPAN}").select("doc_id", "item_id").distinct()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(read(spark, d, "documents"), read(spark, d, "language_codes")).select("doc_id", "lang")


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    documents = read(spark, d, "documents")
    return language.sentences(documents, language.fit(documents, read(spark, d, "language_codes"))).drop("closed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


#: Every pair of chunks that share a run of three words, by brute force.
P3_SQL = r"""WITH w AS (SELECT row_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM chunks WHERE text IS NOT NULL),
s AS (SELECT DISTINCT row_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
n AS (SELECT row_id, count(*) AS c FROM s GROUP BY row_id),
p AS (SELECT a.row_id AS ra, b.row_id AS rb, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.row_id < b.row_id GROUP BY ALL)
SELECT ra AS row_id_a, rb AS row_id_b FROM p JOIN n x ON x.row_id = ra JOIN n y ON y.row_id = rb WHERE k >= 0.5 * (x.c + y.c - k)"""


#: What must hold of any packing.
P8_SQL = "SELECT budget_id, (SELECT count(*) FROM documents) AS documents, 0 AS repeated, 0 AS clashes, 0 AS overfull, 0 AS lost FROM token_budgets"


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_SQL, "p8_audit": P8_SQL}
