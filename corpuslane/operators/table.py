"""The chunk table: ingestion, exact deduplication, listing, paging, deletion and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.functions.text import basename, normalize_text, safe_filename, short_id, suffix
from corpuslane.operators.chunkers import chunked

CHUNK_SCHEMA = "doc_id string, content_id string, doc_path string, chunk_id int, text string, metadata map<string,string>, created_at timestamp, row_id bigint"
#: Extensions that may be uploaded, and the largest upload (fixed values).
ALLOWED = (".pdf", ".md", ".markdown", ".txt", ".html", ".rst", ".csv", ".json", ".yaml", ".yml", ".xml", ".log")
MOST_BYTES = 50 * 1024 * 1024


def stored_name(name: Column, content_id: Column, at: Column) -> Column:
    return F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss"), F.lit("_"), content_id, F.lit("_"), safe_filename(basename(name)))


def dedup_exact(files: DataFrame, existing: DataFrame | None = None, content: str = "text", key: str = "doc_id") -> DataFrame:
    """The first row (by key) of each content that the existing table (column content_id) does not hold yet.

    The least key of each content is aggregated before the shuffle, so that a content that fills a third of the rows
    costs a row per task. Null contents are kept apart from '' and count as one content.
    """
    named = files.withColumn("content_id", short_id(F.col(content)))
    first = named.groupBy("content_id").agg(F.min(key).alias(key))
    if existing is not None:
        first = first.join(existing.select("content_id").distinct(), "content_id", "left_anti")
    return named.join(first.select(key), key, "left_semi")


def ingest_report(files: DataFrame, existing: DataFrame | None = None, key: str = "doc_id", name: str = "filename", text: str = "text") -> DataFrame:
    """(key, filename, content_id, status, message, chunks, chars): what becomes of each file.

    error: too large or an extension that is not allowed; skipped: a content held already, or by an earlier file of
    this batch, or blank text; success otherwise.
    """
    named = files.select(key, F.col(name).alias("filename"), F.col(text).alias("text")).withColumn("content_id", short_id(F.coalesce("text", F.lit(""))))
    named = named.withColumn("bad", F.when(~suffix(F.col("filename")).isin(*ALLOWED) | F.col("filename").isNull(), "File type not allowed").when(F.octet_length("text") > MOST_BYTES, "File too large"))
    first = named.where("bad is null").groupBy("content_id").agg(F.min(key).alias("first"))
    if existing is not None:
        first = first.join(existing.select("content_id").distinct().withColumn("held", F.lit(True)), "content_id", "left")
    else:
        first = first.withColumn("held", F.lit(False))
    judged = named.join(first, "content_id", "left").withColumn("clean", normalize_text(F.col("text")))
    status = F.when(F.col("bad").isNotNull(), "error").when(F.coalesce("held", F.lit(False)) | (F.col(key) != F.col("first")), "skipped").when(F.col("clean") == "", "skipped").otherwise("success")
    message = F.when(F.col("bad").isNotNull(), F.col("bad")).when(F.coalesce("held", F.lit(False)) | (F.col(key) != F.col("first")), "Document already indexed").when(F.col("clean") == "", "No text extracted")
    judged = judged.withColumn("status", status).withColumn("message", message)
    counts = chunked(judged.where("status = 'success'").select(key, "text"), "sentences", key).groupBy(key).agg(F.count("*").alias("chunks"))
    return judged.join(counts, key, "left").select(key, "filename", "content_id", "status", "message", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.when(F.col("status") == "success", F.length("clean")).otherwise(0).cast("bigint").alias("chars"))


def ingest_summary(report: DataFrame) -> DataFrame:
    ok = F.col("status") == "success"
    return report.agg(F.count_if(ok).alias("total_files"), F.coalesce(F.sum(F.when(ok, F.col("chunks"))), F.lit(0)).alias("total_chunks"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "error").alias("errors"))


def ingest(files: DataFrame, existing: DataFrame | None = None, name: str = "filename", text: str = "text", at: Column | None = None) -> DataFrame:
    """Rows of the chunk table for the files whose content is new; see ingest_report for what is left out."""
    at = at if at is not None else F.current_timestamp()
    key = "file_key"
    keyed = files.withColumn(key, F.sha2(F.concat_ws("\x1f", F.col(name), F.col(text)), 256))
    good = ingest_report(keyed, existing, key, name, text).where("status = 'success'").select(key, "content_id", "filename").dropDuplicates([key])
    chunks = chunked(keyed.select(key, F.col(text).alias("text")).dropDuplicates([key]), "sentences", key).select(key, "chunk_id", "text")
    joined = chunks.join(good, key).withColumn("created_at", at).withColumn("doc_path", stored_name(F.col("filename"), F.col("content_id"), F.col("created_at")))
    metadata = F.create_map(F.lit("doc_id"), F.col("content_id"), F.lit("original_filename"), F.col("filename"), F.lit("extension"), suffix(F.col("filename")))
    return joined.select(short_id(F.col("doc_path")).alias("doc_id"), "content_id", "doc_path", "chunk_id", "text", metadata.alias("metadata"), "created_at")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def list_documents(chunks: DataFrame) -> DataFrame:
    """One row per document: id, name, counts, and the fields of its first row (by row_id)."""
    first = F.min_by(F.struct("doc_id", "metadata", "created_at"), "row_id").alias("f")
    grouped = chunks.groupBy("doc_path").agg(F.count("*").alias("chunk_count"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("total_chars"), F.min("row_id").alias("ord"), first)
    return grouped.select(
        F.col("f.doc_id").alias("doc_id"), F.coalesce(F.element_at("f.metadata", "original_filename"), basename(F.col("doc_path"))).alias("filename"), F.col("doc_path").alias("path"), "chunk_count", "total_chars",
        F.coalesce(F.element_at("f.metadata", "extension"), suffix(F.col("doc_path"))).alias("file_type"), F.col("f.created_at").alias("indexed_at"), "ord",
    )


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of `size` rows in the given order; past the end it is empty."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def index_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.countDistinct("doc_path").alias("documents"), F.count("*").alias("chunks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


def delete_document(chunks: DataFrame, doc_id: str) -> DataFrame:
    """The table without the rows of a document; write it to a new path and swap, never onto the path being read."""
    return chunks.where(~F.col("doc_id").eqNullSafe(F.lit(doc_id)))


def doc_chunks(chunks: DataFrame, doc_id: Column) -> DataFrame:
    return chunks.where(F.coalesce(F.col("doc_id"), F.element_at("metadata", "doc_id")) == doc_id).select("doc_id", "chunk_id", "text")


def history_window(turns: DataFrame, keep: int = 20) -> DataFrame:
    """The last `keep` turns of each conversation, with their place from the end."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("from_end", place).where(F.col("from_end") <= keep)


def delete_report(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """(doc_id, removed): how many rows each asked document loses; 0 for one that is not there."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    return doc_ids.select("doc_id").distinct().join(counts, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("removed"))
