"""Files as sources: texts, HTML, Markdown, e-mail, mail boxes, PDF (with an optional library) and evaluation cases."""

from __future__ import annotations

import email
import email.policy
import hashlib
import re
from collections.abc import Iterator
from email.header import decode_header
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslane.functions.html import extract_html, html_title
from corpuslane.functions.text import basename, suffix
from corpuslane.operators.table import ALLOWED, MOST_BYTES

MOST_ATTACHMENT = 10 * 1024 * 1024


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, extension, content, size, content_hash): files below a path that may be uploaded."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = basename(F.col("path"))
    return raw.where((F.col("length") <= MOST_BYTES) & suffix(name).isin(*ALLOWED, ".eml", ".mbox", ".htm")).select("path", name.alias("filename"), suffix(name).alias("extension"), "content", F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"))


def encoding(content: Column) -> Column:
    """utf-16 where the bytes begin with its mark, utf-8 where they are valid as that, else latin-1."""
    mark = F.hex(F.substring(content, 1, 2))
    return F.when(mark.isin("FFFE", "FEFF"), "utf-16").when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise("latin-1")


def decoded(content: Column) -> Column:
    """Bytes as text by their encoding; one kind of line end."""
    name = encoding(content)
    text = F.when(name == "utf-16", F.decode(content, "UTF-16")).when(name == "utf-8", content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


def markdown_metadata(text: Column) -> Column:
    """Title (only if the first line is a first-level heading), number of headings and of fenced blocks."""
    title = F.regexp_extract(text, r"\A#\s+([^\n]+)", 1)
    return F.struct(F.when(title != "", F.trim(title)).alias("title"), F.regexp_count(text, F.lit(r"(?m)^#{1,6}\s+[^\n]+")).alias("sections"), F.regexp_count(text, F.lit(r"(?s)```.*?```")).alias("code_blocks"))


def extract(files: DataFrame, text: Column | None = None) -> DataFrame:
    """Adds format, text, title, lines and char_count, by the extension of the filename."""
    text = text if text is not None else decoded(F.col("content"))
    ext = suffix(F.col("filename"))
    kind = F.when(ext.isin(".md", ".markdown"), "markdown").when(ext.isin(".html", ".htm"), "html").when(ext == ".pdf", "pdf").when(ext.isin(".txt", ".rst", ".csv", ".json", ".yaml", ".yml", ".xml", ".log"), "text").otherwise("unknown")
    rows = files.withColumn("format", kind).withColumn("raw", text)
    out = F.when(F.col("format") == "html", extract_html(F.col("raw"))).otherwise(F.col("raw"))
    title = F.when(F.col("format") == "html", html_title(F.col("raw"))).when(F.col("format") == "markdown", markdown_metadata(F.col("raw"))["title"])
    return rows.withColumn("text", out).withColumn("title", title).withColumn("lines", F.when(F.col("format").isin("text", "unknown"), F.length("raw") - F.length(F.replace("raw", F.lit("\n"))) + 1)).withColumn("char_count", F.length("text")).drop("raw")


def header_text(value: str | None) -> str:
    """A header with its encoded words decoded, joined by blanks."""
    out = []
    for part, charset in decode_header(value or ""):
        if isinstance(part, bytes):
            try:
                part = part.decode(charset or "utf-8", "replace")
            except LookupError:
                part = part.decode("utf-8", "replace")
        out.append(part)
    return " ".join(out)


def addresses(value: str | None) -> list[str]:
    return sorted(set(re.findall(r"[\w.+-]+@[\w-]+\.[\w.-]+", header_text(value))))


def _payload(part) -> str:
    data = part.get_payload(decode=True) or b""
    try:
        return data.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def parse_message(raw: bytes) -> dict:
    """The parts of a message; an unreadable date is null, attachments over 10 MiB keep no content."""
    m = email.message_from_bytes(raw)
    parts = [p for p in m.walk() if not p.is_multipart()]
    inline = [p for p in parts if "attachment" not in str(p.get("Content-Disposition", "")).lower()]
    plain = next((_payload(p) for p in inline if p.get_content_type() == "text/plain"), None)
    html = next((_payload(p) for p in inline if p.get_content_type() == "text/html"), None)
    try:
        date = parsedate_to_datetime(m["Date"]) if m["Date"] else None
    except (TypeError, ValueError):
        date = None
    attached = [p for p in parts if p not in inline]
    sender = addresses(m["From"])
    return {
        "message_id": m.get("Message-ID", ""), "subject": header_text(m["Subject"]), "from_address": sender[0] if sender else None, "to_addresses": addresses(m["To"]), "cc_addresses": addresses(m["Cc"]), "date": date, "body_text": plain, "body_html": html,
        "attachments": [{"filename": header_text(p.get_filename()) or "attachment", "content_type": p.get_content_type(), "size": len(d := p.get_payload(decode=True) or b""), "content": d if len(d) <= MOST_ATTACHMENT else None} for p in attached],
        "headers": [(k, str(v)) for k, v in dict(m.items()).items()],
    }


EMAIL_SCHEMA = "path string, message_id string, subject string, from_address string, to_addresses array<string>, cc_addresses array<string>, date timestamp, body_text string, body_html string, attachments array<struct<filename:string,content_type:string,size:bigint,content:binary>>, headers map<string,string>, error string"


def messages(content: bytes, is_box: bool) -> Iterator[dict]:
    """The messages of a file; unreadable ones have only an error."""
    raws = [x for x in re.split(rb"(?m)^From .*\n", content) if x.strip()] if is_box else [content]
    if is_box:
        raws = [re.sub(rb"(?m)^>(>*From )", rb"\1", x) for x in raws]
    for raw in raws:
        try:
            yield parse_message(raw) | {"error": None}
        except Exception as e:  # noqa: BLE001 - a corrupt message is data, not a failure of the job
            yield dict.fromkeys(("message_id", "subject", "from_address", "to_addresses", "cc_addresses", "date", "body_text", "body_html", "attachments", "headers")) | {"error": str(e)}


def read_emails(files: DataFrame) -> DataFrame:
    """A row per message of .eml and .mbox files (path, content); HTML-only messages get their text from the HTML."""
    text = pa.string()
    attachment = pa.struct([("filename", text), ("content_type", text), ("size", pa.int64()), ("content", pa.binary())])
    kinds = (text, text, text, text, pa.list_(text), pa.list_(text), pa.timestamp("us", "UTC"), text, text, pa.list_(attachment), pa.map_(text, text), text)
    schema = pa.schema(list(zip([x.split(" ")[0] for x in re.split(r", (?=\w+ )", EMAIL_SCHEMA)], kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"path": p} | m for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in messages(c or b"", p.lower().endswith(".mbox"))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    from corpuslane.functions.html import email_html_to_text

    read = files.select("path", "content").mapInArrow(run, EMAIL_SCHEMA)
    return read.withColumn("body_text", F.coalesce("body_text", F.when(F.col("body_html").isNotNull(), email_html_to_text(F.col("body_html"))), F.lit("")))


def full_text(mail: DataFrame) -> DataFrame:
    """Adds full_text: the main headers and the body of a message."""
    head = F.concat_ws("\n", F.concat(F.lit("From: "), F.coalesce("from_address", F.lit(""))), F.concat(F.lit("To: "), F.array_join(F.coalesce("to_addresses", F.array().cast("array<string>")), ", ")), F.concat(F.lit("Date: "), F.coalesce(F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Unknown"))), F.concat(F.lit("Subject: "), F.coalesce("subject", F.lit(""))))
    return mail.withColumn("full_text", F.concat(head, F.lit("\n\n"), F.coalesce("body_text", F.lit(""))))


def read_pdfs(files: DataFrame) -> DataFrame:
    """(path, page_number, text, error): the pages of PDF files (path, content), if a PDF library is installed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            from pypdf import PdfReader
        except ImportError:
            PdfReader = None
        import io

        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if PdfReader is None:
                    out.append((path, None, "", "no PDF library is installed"))
                    continue
                try:
                    out += [(path, n, p.extract_text() or "", None) for n, p in enumerate(PdfReader(io.BytesIO(content or b"")).pages, 1)]
                except Exception as e:  # noqa: BLE001
                    out.append((path, None, "", str(e)))
            c = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, (pa.string(), pa.int32(), pa.string(), pa.string()))], ["path", "page_number", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, page_number int, text string, error string")


def pdf_documents(pages: DataFrame, doc: str = "doc_path", least_mean: int = 100) -> DataFrame:
    """(doc, pages, blank_pages, needs_ocr, full_text): pages joined, blank ones dropped; whether OCR should be tried.

    OCR is wanted where the pages have fewer than least_mean characters in the mean. No file's pages are collected
    beyond what its joined text holds.
    """
    filled = F.regexp_replace(F.coalesce("text", F.lit("")), r"\A\s+|\s+\z", "")
    rows = pages.select(doc, "page_number", filled.alias("t"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("page_number", "t")))), lambda x: F.concat(F.lit("[Page "), x["page_number"].cast("string"), F.lit("]\n"), x["t"])), "\n\n")
    return rows.groupBy(doc).agg(F.count("*").alias("pages"), F.count_if(F.col("t") == "").alias("blank_pages"), (F.sum("n") / F.count("*") < least_mean).alias("needs_ocr"), joined.alias("full_text"))


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from a JSON array."""
    return spark.read.schema("query string, relevant_docs array<string>, expected_answer string, metadata struct<category:string,difficulty:string>").option("multiLine", "true").json(path)


def read_chunk_log(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table from JSON lines; blank and malformed lines are left out."""
    return spark.read.schema("doc_id string, doc_path string, chunk_id int, text string, metadata map<string,string>, created_at string").option("mode", "DROPMALFORMED").json(path)


def file_hash(path: str) -> str:
    """SHA-256 of a local file, in hexadecimal."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
