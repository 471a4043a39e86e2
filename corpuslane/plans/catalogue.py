"""The registered queries of the core, each with the SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslane.functions import html as H
from corpuslane.functions import text as X
from corpuslane.operators import answer, chunkers, code_symbols, evaluate, index, search, table, vectors
from corpuslane.plans import oracle as O
from corpuslane.session import read, shared_dir
from corpuslane.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TOP_K = 10


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _documents(name: str, column, sql: str, table_name: str = "documents", key: str = "doc_id", source: str = "text", out: str = "value") -> None:
    """A query that applies one function to a column of a whole table."""
    QUERIES[name] = lambda s, d: read(s, d, table_name).select(key, column(F.col(source)).alias(out))
    SQL[name] = f"SELECT {key}, {sql} AS {out} FROM {table_name}"


# text
_documents("normalize_text", X.normalize_text, O.normalize("text"))
_documents("normalize_text_kit", X.normalize_text_kit, O.normalize_kit("text"))
_documents("extract_sentences", lambda c: F.array_join(X.sentences(X.normalize_text(c)), "|"), f"array_to_string({O.sentences(O.normalize('text'))}, '|')")
_documents("tokenize", lambda c: F.array_join(X.tokens(c), " "), f"array_to_string({O.tokens('text')}, ' ')")
_documents("word_count", lambda c: X.word_count(c).cast("bigint"), O.word_count("text"))
_documents("safe_filename", X.safe_filename, O.rx("filename", r"[^\pL\pN.\-_]", "_"), source="filename")
_documents("doc_ids", X.short_id, "substring(sha256(text), 1, 16)")
_documents("content_hash", lambda c: F.sha2(c, 256), "sha256(text)")
_documents("extractive_excerpt", X.excerpt, O.excerpt("text"))
_documents("path_suffix", X.suffix, "lower(regexp_extract(regexp_extract(filename, '[^/]*$', 0), '[^.](\\.[^.]+)$', 1))", source="filename")
_documents("url_domain", X.url_domain, O.authority("url"), "url_contents", "url_id", "url")


@query(f"""SELECT doc_id, regexp_extract(text, '\\A#\\s+([^\\n]+)', 1) AS title, len(regexp_extract_all(text, '(?m)^#{{1,6}}\\s+[^\\n]+'))::BIGINT AS sections,
    len(regexp_extract_all(text, '(?s)```.*?```'))::BIGINT AS code_blocks FROM documents""")
def extract_markdown(spark, d):
    m = files.markdown_metadata(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.when(F.col("text").isNotNull(), F.coalesce(m["title"], F.lit(""))).alias("title"), m["sections"].cast("bigint").alias("sections"), m["code_blocks"].cast("bigint").alias("code_blocks"))


@query(f"""WITH d AS (SELECT *, {O.rx('text', chr(13) + chr(10) + '?', chr(10))} AS t, lower(regexp_extract(filename, '[^.](\\.[^.]+)$', 1)) AS e FROM documents)
    SELECT doc_id, CASE WHEN e IN ('.md','.markdown') THEN 'markdown' WHEN e IN ('.html','.htm') THEN 'html' WHEN e = '.pdf' THEN 'pdf' WHEN e IN ('.txt','.rst','.csv','.json','.yaml','.yml','.xml','.log') THEN 'text' ELSE 'unknown' END AS format,
    length(CASE WHEN e IN ('.html','.htm') THEN {O.extract_html('t')} ELSE t END)::BIGINT AS char_count,
    CASE WHEN NOT coalesce(e, '') IN ('.md','.markdown','.html','.htm','.pdf') THEN length(t) - length(replace(t, chr(10), '')) + 1 END::BIGINT AS lines FROM d""")
def extract_dispatch(spark, d):
    rows = files.extract(read(spark, d, "documents").select("doc_id", "filename", F.regexp_replace("text", "\r\n?", "\n").alias("raw")), F.col("raw"))
    return rows.select("doc_id", "format", F.col("char_count").cast("bigint").alias("char_count"), F.col("lines").cast("bigint").alias("lines"))


@query(O.HIGHLIGHT)
def highlight(spark, d):
    first = read(spark, d, "eval_items").agg(F.min_by("query", "item_id").alias("query"))
    return read(spark, d, "documents").crossJoin(F.broadcast(first)).select("doc_id", X.highlight(F.col("text"), F.col("query")).alias("value"))


# HTML
for _name, _f, _sql in (("extract_html", H.extract_html, O.extract_html("html")), ("web_clean_html", H.web_clean_html, O.web_clean("html")), ("email_html_to_text", H.email_html_to_text, O.email_html("html")), ("html_title", H.html_title, O.html_title("html")), ("web_title", H.web_title, O.web_title("html"))):
    _documents(_name, _f, _sql, "url_contents", "url_id", "html")


@query(f"""WITH v(id, html) AS (SELECT url_id, html FROM url_contents UNION ALL VALUES {O.META_ROWS})
    SELECT id, {O.meta('description|og:description', 'name|property')} AS description, {O.meta('author')} AS author, {O.meta('keywords')} AS keywords, {O.meta('og:image', 'property')} AS image FROM v""")
def web_meta(spark, d):
    extra = spark.createDataFrame(O.meta_rows(), "id bigint, html string")
    h = F.col("html")
    rows = read(spark, d, "url_contents").select(F.col("url_id").alias("id"), "html").unionByName(extra)
    return rows.select("id", H.meta(h, "description|og:description", "name|property").alias("description"), H.meta(h, "author").alias("author"), H.meta(h, "keywords").alias("keywords"), H.meta(h, "og:image", "property").alias("image"))


@query(O.links("href", "a", r'''"''' + "'#", "^(?:javascript:|mailto:|tel:)"))
def web_links(spark, d):
    return read(spark, d, "url_contents").select("url_id", F.array_join(H.links(F.col("html"), F.col("url")), " ").alias("links"))


@query(O.links("src", "img", r'''"''' + "'", "^data:", "images"))
def web_images(spark, d):
    return read(spark, d, "url_contents").select("url_id", F.array_join(H.images(F.col("html"), F.col("url")), " ").alias("images"))


@query(f"SELECT url_id, {O.authority('url')} AS domain, {O.web_title('html')} AS title, length({O.web_clean('html')})::BIGINT AS chars, {O.word_count(O.web_clean('html'))} AS words FROM url_contents")
def web_page(spark, d):
    text = H.web_clean_html(F.col("html"))
    return read(spark, d, "url_contents").select("url_id", X.url_domain(F.col("url")).alias("domain"), H.web_title(F.col("html")).alias("title"), F.length(text).cast("bigint").alias("chars"), X.word_count(text).cast("bigint").alias("words"))


@query("SELECT email_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(body_text, ''), '[A-Za-z0-9_.+\\-]+@[A-Za-z0-9\\-]+\\.[A-Za-z0-9.\\-]+'))), ' ') AS addresses FROM parsed_emails")
def email_addresses(spark, d):
    found = F.regexp_extract_all(F.coalesce("body_text", F.lit("")), F.lit(r"[A-Za-z0-9_.+\-]+@[A-Za-z0-9\-]+\.[A-Za-z0-9.\-]+"), F.lit(0))
    return read(spark, d, "parsed_emails").select("email_id", F.array_join(F.array_sort(F.array_distinct(found)), " ").alias("addresses"))


@query("""SELECT email_id, 'From: ' || coalesce(from_address, '') || chr(10) || 'To: ' || coalesce(array_to_string(to_addresses, ', '), '') || chr(10) || 'Date: ' || coalesce(strftime(date AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S'), 'Unknown') || chr(10) || 'Subject: ' || coalesce(subject, '') || chr(10) || chr(10) || coalesce(body_text, '') AS full_text,
    coalesce(len(attachments), 0) > 0 AS has_attachments FROM parsed_emails""")
def email_full_text(spark, d):
    return files.full_text(read(spark, d, "parsed_emails")).select("email_id", "full_text", (F.coalesce(F.size("attachments"), F.lit(0)) > 0).alias("has_attachments"))


# chunkers
for _name, _method in (("chunk_sentences", "sentences"), ("chunk_sentence_kit", "sentences_kit"), ("chunk_char", "characters"), ("chunk_char_core", "breaks"), ("chunk_recursive", "recursive")):
    QUERIES[_name] = lambda s, d, m=_method: chunkers.chunked(read(s, d, "documents"), m)
SQL |= {"chunk_char": O.CHUNK_CHAR, "chunk_char_core": O.CHUNK_CORE, "chunk_sentences": O.CHUNK_SENTENCES, "chunk_sentence_kit": O.CHUNK_SENTENCE_KIT}


@query("""WITH p AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
    s AS (SELECT label, vec_id, round(list_dot_product(p, e) / (sqrt(list_dot_product(p, p)) * sqrt(list_dot_product(e, e))), 6) AS similarity FROM p)
    SELECT label, vec_id, similarity, coalesce(similarity < 0.5, true) AS boundary FROM s""")
def semantic_boundaries(spark, d):
    return chunkers.semantic_boundaries(read(spark, d, "embeddings"), "label", "vec_id")


@query()
def chunk_semantic(spark, d):
    """Documents cut where neighbouring packs of sentences have unlike vectors of the hashing encoder."""
    units = vectors.semantic_units(read(spark, d, "documents").select("doc_id", "text"), vectors.HashingEncoder())
    return chunkers.semantic_chunks(units, "doc_id", "unit")


# chunk table
_LISTED = """SELECT arg_min(doc_id, row_id) AS doc_id, coalesce(arg_min(metadata['original_filename'], row_id), regexp_extract(doc_path, '[^/]*$', 0)) AS filename, doc_path AS path, count(*) AS chunk_count,
    coalesce(sum(length(text)), 0)::BIGINT AS total_chars, coalesce(arg_min(metadata['extension'], row_id), lower(regexp_extract(doc_path, '[^.](\\.[^.]+)$', 1))) AS file_type, arg_min_null(created_at, row_id) AS indexed_at, min(row_id) AS ord FROM chunks GROUP BY doc_path"""


@query(_LISTED)
def list_documents(spark, d):
    return table.list_documents(read(spark, d, "chunks"))


@query(f"SELECT path, chunk_count, indexed_at FROM ({_LISTED}) ORDER BY indexed_at DESC NULLS LAST, ord LIMIT 50 OFFSET 50")
def list_documents_page(spark, d):
    return table.page(table.list_documents(read(spark, d, "chunks")), [F.desc_nulls_last("indexed_at"), F.asc("ord")], 2, 50).select("path", "chunk_count", "indexed_at")


@query(f"SELECT * FROM ({_LISTED}) WHERE doc_id = (SELECT min(doc_id) FROM chunks)")
def get_document(spark, d):
    chunks = read(spark, d, "chunks")
    wanted = chunks.agg(F.min("doc_id").alias("doc_id"))
    paths = chunks.join(F.broadcast(wanted), "doc_id", "left_semi").select("doc_path").distinct()
    return table.list_documents(chunks.join(F.broadcast(paths), "doc_path", "left_semi")).join(F.broadcast(wanted), "doc_id", "left_semi")


@query("SELECT doc_id, chunk_id, text FROM chunks WHERE coalesce(doc_id, metadata['doc_id']) = (SELECT min(doc_id) FROM chunks)")
def doc_chunks(spark, d):
    chunks = read(spark, d, "chunks")
    first = chunks.agg(F.min("doc_id").alias("wanted"))
    return table.doc_chunks(chunks.crossJoin(F.broadcast(first)), F.col("wanted"))


@query("SELECT row_id, chunk_id, text FROM chunks WHERE doc_id = (SELECT doc_id FROM chunks GROUP BY doc_id ORDER BY count(*) DESC, doc_id LIMIT 1) ORDER BY chunk_id, row_id LIMIT 20 OFFSET 20")
def doc_chunks_page(spark, d):
    """Page 2 of the document with the most chunks."""
    chunks = read(spark, d, "chunks")
    largest = chunks.groupBy("doc_id").count().agg(F.min_by("doc_id", F.struct(-F.col("count"), "doc_id")).alias("doc_id"))
    own = chunks.join(F.broadcast(largest), "doc_id", "left_semi")
    return table.page(own, [F.asc("chunk_id"), F.asc("row_id")], 2, 20).select("row_id", "chunk_id", "text")


@query("SELECT count(DISTINCT doc_path) AS documents, count(*) AS chunks, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM chunks")
def index_stats(spark, d):
    return table.index_stats(read(spark, d, "chunks"))


@query("SELECT doc_id, content_id FROM (SELECT doc_id, substring(sha256(text), 1, 16) AS content_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedup_exact(spark, d):
    return table.dedup_exact(read(spark, d, "documents")).select("doc_id", "content_id")


@query("SELECT row_id, doc_id, chunk_id FROM chunks WHERE doc_id IS DISTINCT FROM (SELECT min(doc_id) FROM chunks)")
def delete_document(spark, d):
    chunks = read(spark, d, "chunks")
    return table.delete_document(chunks, chunks.agg(F.min("doc_id")).first()[0]).select("row_id", "doc_id", "chunk_id")


@query("SELECT d.doc_id, (SELECT count(*) FROM chunks c WHERE c.doc_id = d.doc_id) AS removed FROM (SELECT DISTINCT doc_id FROM document_infos) d")
def delete_report(spark, d):
    return table.delete_report(read(spark, d, "chunks"), read(spark, d, "document_infos"))


@query(f"""WITH f AS (SELECT doc_id, filename, coalesce(lower(regexp_extract(regexp_extract(filename, '[^/]*$', 0), '[^.](\\.[^.]+)$', 1)), '') IN ({', '.join(O.q(x) for x in table.ALLOWED)}) AS good, coalesce(text, '') AS t FROM documents),
    g AS (SELECT *, min(doc_id) FILTER (WHERE good) OVER (PARTITION BY t) AS first, {O.normalize('t')} AS clean FROM f)
    SELECT doc_id, filename, substring(sha256(t), 1, 16) AS content_id, CASE WHEN NOT good THEN 'error' WHEN doc_id <> first OR clean = '' THEN 'skipped' ELSE 'success' END AS status, CASE WHEN good AND doc_id = first AND clean <> '' THEN length(clean) ELSE 0 END::BIGINT AS chars FROM g""")
def ingest_status(spark, d):
    """The ingestion report without messages and chunk counts."""
    return table.ingest_report(read(spark, d, "documents")).select("doc_id", "filename", "content_id", "status", "chars")


@query(O.INGEST_REPORT)
def ingest_report(spark, d):
    return table.ingest_report(read(spark, d, "documents"))


@query(O.INGEST_SUMMARY)
def ingest_summary(spark, d):
    return table.ingest_summary(table.ingest_report(read(spark, d, "documents")))


@query(f"""SELECT doc_path, count(*) AS pages, count(*) FILTER (WHERE {O.rx("coalesce(text, '')", '\\A[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+\\z', '')} = '') AS blank_pages, sum(coalesce(length(text), 0)) / count(*) < 100 AS needs_ocr FROM pdf_pages GROUP BY doc_path""")
def pdf_flags(spark, d):
    return files.pdf_documents(read(spark, d, "pdf_pages")).select("doc_path", "pages", "blank_pages", "needs_ocr")


# search
def _queries(spark, d):
    return read(spark, d, "eval_items").select(F.col("item_id").alias("qid"), "query")


def _asked_vectors(spark, d):
    return read(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def _index(spark, d):
    """The stored index of the documents as they are now, built by the first query that asks for it."""
    return index.ensure(read(spark, d, "documents"))


@query(f"WITH {O.BM25_BASE} SELECT doc_id, term, tf, dl FROM postings")
def postings(spark, d):
    return _index(spark, d).postings()


@query(f"WITH {O.BM25_BASE} SELECT term, df, round(idf, 6) AS idf FROM terms")
def term_stats(spark, d):
    return _index(spark, d).terms().select("term", "df", F.round("idf", 6).alias("idf"))


@query(O.INDEX_STATS)
def retriever_stats(spark, d):
    return _index(spark, d).stats().withColumn("avgdl", F.round("avgdl", 6))


@query(O.bm25("WHERE item_id = (SELECT min(item_id) FROM eval_items)", 5))
def bm25_search(spark, d):
    items = _queries(spark, d)
    first = items.join(F.broadcast(items.agg(F.min("qid").alias("qid"))), "qid", "left_semi")
    return _index(spark, d).search(first, 5)


@query(O.bm25("", TOP_K))
def bm25_batch(spark, d):
    return _index(spark, d).search(_queries(spark, d), TOP_K)


@query(O.bm25("", TOP_K))
def bm25_unindexed(spark, d):
    """The same search over texts that are not indexed."""
    return search.bm25_search(read(spark, d, "documents"), _queries(spark, d), TOP_K)


@query(O.bm25("", TOP_K))
def bm25_appended(spark, d):
    """The same search over an index made of two appends."""
    docs = read(spark, d, "documents")
    made = index.Index(spark, f"{shared_dir(spark)}/bm25/appended-{index.version(docs, 'doc_id', 'text')}")
    if not made.ready:
        made.append(docs.where("doc_id % 3 = 0")).append(docs.where("doc_id % 3 <> 0"))
    return made.search(_queries(spark, d), TOP_K)


@query(O.vector("q.vec_id = (SELECT min(vec_id) FROM embeddings)", 10, 0.5))
def vector_search(spark, d):
    v = read(spark, d, "embeddings")
    first = v.select(F.col("vec_id").alias("qid"), "embedding").join(F.broadcast(v.agg(F.min("vec_id").alias("qid"))), "qid", "left_semi")
    return search.vector_search(v, first, 10)


@query(O.vector("q.vec_id % 100 = 0", 10, None))
def vector_topk_batch(spark, d):
    return search.vector_search(read(spark, d, "embeddings"), _asked_vectors(spark, d), 10, None)


@query(f"SELECT qid, doc_id, round(CASE WHEN hi = lo THEN 0 ELSE (score - lo) / (hi - lo) END, 6) AS norm FROM (SELECT *, min(score) OVER (PARTITION BY qid) AS lo, max(score) OVER (PARTITION BY qid) AS hi FROM ({O.bm25('', TOP_K)}))")
def minmax_normalize(spark, d):
    return search.minmax(bm25_batch(spark, d), ["qid"]).select("qid", "doc_id", F.round("norm", 6).alias("norm"))


def _vector_side(spark, d, k):
    """Vector hits for the query texts: embeddings stand for the documents of the same number."""
    v = read(spark, d, "embeddings")
    asked = v.join(F.broadcast(_queries(spark, d).select(F.col("qid").alias("vec_id"))), "vec_id", "left_semi").select(F.col("vec_id").alias("qid"), "embedding")
    return search.vector_search(v, asked, k).withColumnRenamed("vec_id", "doc_id")


@query(O.HYBRID)
def hybrid_search(spark, d):
    return search.fuse(_index(spark, d).search(_queries(spark, d), 2 * TOP_K), _vector_side(spark, d, TOP_K), "doc_id", TOP_K)


@query(O.ENSEMBLE)
def ensemble_rerank(spark, d):
    hits = bm25_batch(spark, d)
    lengths = read(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("score"))
    by_length = hits.select("qid", "doc_id").join(lengths, "doc_id")
    return search.ensemble([(hits, 2.0), (by_length, 1.0)])


def _cited(spark, d, k=TOP_K):
    docs = read(spark, d, "documents").select("doc_id", F.col("filename").alias("path"), "text")
    return answer.citations(_index(spark, d).search(_queries(spark, d), k), docs, _queries(spark, d))


@query(O.CITATIONS)
def citations(spark, d):
    return _cited(spark, d).select("qid", "doc_id", "rank", "score", "path", "highlight")


@query(O.FORMAT_CONTEXT)
def format_context(spark, d):
    return answer.format_context(_cited(spark, d, 3), 3)


@query(O.PROMPT_CONTEXT)
def chat_prompt_context(spark, d):
    return answer.prompt_context(_cited(spark, d, 5), 5)


@query(O.EXTRACTIVE)
def extractive_answer(spark, d):
    return answer.extractive_answer(_cited(spark, d, 3), _queries(spark, d))


@query(O.ASK)
def ask(spark, d):
    """Answers by routing: without a writer at hand, extractive ones."""
    return answer.routed_answer(_cited(spark, d, 3), _queries(spark, d))


@query(O.ROUTED)
def search_routed(spark, d):
    names = F.element_at(F.array(F.lit("bm25"), F.lit("embedding"), F.lit("hybrid"), F.lit(None).cast("string")), (F.col("qid") % 4 + 1).cast("int"))
    return search.routed(_queries(spark, d).withColumn("method", names), _index(spark, d).search(_queries(spark, d), 2 * TOP_K), _vector_side(spark, d, TOP_K))


@query(O.INVALID)
def validate_requests(spark, d):
    """Expected answers stand for queries, some with a bad number of hits or method."""
    items = read(spark, d, "eval_items").select(F.col("item_id").alias("qid"), F.col("expected_answer").alias("query"), (F.col("item_id") % 150).alias("top_k"), F.when(F.col("item_id") % 7 == 0, "fuzzy").alias("method"))
    return search.invalid(items)


@query(O.RERANKED)
def rerank_scorer(spark, d):
    return vectors.rerank(bm25_batch(spark, d), read(spark, d, "documents"), _queries(spark, d), vectors.overlap_scorer)


@query(O.ENCODED)
def encode_hashing(spark, d):
    """Vectors of all documents by the hashing encoder, as their filled slots."""
    found = vectors.encode(read(spark, d, "documents").withColumn("text", F.array_join(X.tokens(F.col("text")), " ")), encoder=vectors.HashingEncoder(64))
    return found.select("doc_id", F.posexplode("embedding").alias("slot", "value")).where("value <> 0").withColumn("value", F.round(F.col("value").cast("double"), 4))


@query(O.UPSERTED)
def vector_maintain(spark, d):
    """A tenth of the vectors turned around in place and added again under new ids, then a seventh deleted."""
    rows = read(spark, d, "embeddings").select("vec_id", "embedding", "label")
    tenth = rows.where("vec_id % 10 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    put = vectors.upsert(rows, tenth.unionByName(tenth.withColumn("vec_id", F.col("vec_id") + 1_000_000)))
    kept = vectors.delete(put, put.where("vec_id % 7 = 3"))
    return kept.select("vec_id", F.col("embedding")[0].cast("double").alias("first"), "label")


@query("SELECT count(*) AS vectors, coalesce(max(len(embedding)), 0)::BIGINT AS dimensions FROM embeddings")
def vector_stats(spark, d):
    return vectors.stats(read(spark, d, "embeddings"))


# evaluation: a vector's own label tells what is relevant to it
def _runs(spark, d):
    v = read(spark, d, "embeddings")
    hits = search.vector_search(v, _asked_vectors(spark, d), 20, None).join(v.select("vec_id", "label"), "vec_id")
    got = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("h"))
    own = v.select(F.col("vec_id").alias("qid"), "label")
    same = own.join(F.broadcast(_asked_vectors(spark, d).select("qid")), "qid", "left_semi").join(v.select("label", F.col("vec_id").alias("other")), "label").groupBy("qid").agg(F.collect_list(F.col("other").cast("string")).alias("relevant"))
    return got.select("qid", F.transform("h", lambda x: x["vec_id"].cast("string")).alias("retrieved")).join(same, "qid")


for _m in ("recall", "precision", "dcg", "ndcg", "hit_rate"):
    QUERIES[f"{_m}_at_k"] = lambda s, d, m=_m: evaluate.eval_single(_runs(s, d)).where(F.col("metric") == m).select("qid", "k", "value")
    SQL[f"{_m}_at_k"] = O.metric(_m)


@query(O.metric("mrr"))
def mrr(spark, d):
    return evaluate.eval_single(_runs(spark, d)).where("metric = 'mrr'").select("qid", "k", "value")


@query(O.EVAL_SINGLE)
def eval_single(spark, d):
    return evaluate.eval_single(_runs(spark, d))


@query(f"SELECT metric, k, round(avg(value), 6) AS value FROM ({O.EVAL_SINGLE}) GROUP BY metric, k")
def eval_batch(spark, d):
    return evaluate.eval_batch(_runs(spark, d))


@query(O.EVAL_SUMMARY)
def eval_summary(spark, d):
    return evaluate.summary(evaluate.eval_batch(_runs(spark, d)))


@query(f"SELECT metric, k, round(avg(value), 6) AS value, count(DISTINCT qid) AS queries FROM ({O.EVAL_SINGLE}) WHERE k IN (0, 1, 3, 5, 10) AND metric IN ('recall', 'precision', 'ndcg', 'mrr') GROUP BY metric, k")
def eval_script_aggregate(spark, d):
    rows = evaluate.eval_single(_runs(spark, d), (1, 3, 5, 10)).where("metric in ('recall', 'precision', 'ndcg', 'mrr')")
    return rows.groupBy("metric", "k").agg(F.round(F.avg("value"), 6).alias("value"), F.countDistinct("qid").alias("queries"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 AND value IS NOT NULL THEN least(greatest(value, 0.0), 1.0) ELSE 0.5 END AS score FROM events")
def judge_score_parse(spark, d):
    raw = F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")).otherwise(F.col("event_type"))
    return read(spark, d, "events").select("event_id", evaluate.judge_score(raw).alias("score"))


@query("SELECT vec_id, round((least(greatest(embedding[1]::DOUBLE, 0.0), 1.0) + least(greatest(embedding[2]::DOUBLE, 0.0), 1.0) + 0.8 + 0.8) / 4, 6) AS overall FROM embeddings")
def answer_quality(spark, d):
    a, b = (F.least(F.greatest(F.col("embedding")[k].cast("double"), F.lit(0.0)), F.lit(1.0)) for k in (0, 1))
    return read(spark, d, "embeddings").select("vec_id", F.round(evaluate.answer_quality(a, b), 6).alias("overall"))


# conversations: the mails of a sender stand for one, users and assistants taking turns
def _turns(spark, d):
    mails = read(spark, d, "parsed_emails").where("from_address is not null")
    place = F.row_number().over(Window.partitionBy("from_address").orderBy("email_id"))
    return mails.select(F.col("from_address").alias("conv_id"), place.alias("turn"), "subject").select("conv_id", "turn", F.when(F.col("turn") % 2 == 1, "user").otherwise("assistant").alias("role"), F.coalesce("subject", F.lit("")).alias("text"))


@query(f"{O.TURNS} SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM turns WHERE role = 'user' GROUP BY conv_id")
def chat_last_user(spark, d):
    return answer.last_user(_turns(spark, d)).withColumn("turn", F.col("turn").cast("bigint"))


@query(f"{O.TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM turns) SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS query FROM r WHERE p <= 5 AND role = 'user' GROUP BY conv_id")
def chat_context_query(spark, d):
    return answer.context_query(_turns(spark, d))


@query(f"{O.TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end FROM turns) SELECT conv_id, turn, role, text, from_end FROM r WHERE from_end <= 20")
def chat_history_window(spark, d):
    return table.history_window(_turns(spark, d)).withColumn("turn", F.col("turn").cast("bigint")).withColumn("from_end", F.col("from_end").cast("bigint"))


@query(O.CHAT_RETRIEVE)
def chat_retrieve(spark, d):
    return _index(spark, d).search(answer.context_query(_turns(spark, d)).withColumnRenamed("conv_id", "qid"), 5)


@query(O.CHAT_TURN)
def chat_turn(spark, d):
    """Every conversation with its extractive answer added, the last 20 turns of it."""
    turns = _turns(spark, d).withColumn("turn", F.col("turn").cast("bigint"))
    asked = answer.last_user(turns).select(F.col("conv_id").alias("qid"), F.col("text").alias("query"))
    docs = read(spark, d, "documents").select("doc_id", F.col("filename").alias("path"), "text")
    cited = answer.citations(chat_retrieve(spark, d), docs, asked)
    return answer.chat_turn(turns, answer.extractive_answer(cited, asked).withColumnRenamed("qid", "conv_id"))


@query(f"{O.TURNS} SELECT * FROM turns WHERE conv_id <> (SELECT min(conv_id) FROM turns)")
def delete_conversation(spark, d):
    turns = _turns(spark, d).withColumn("turn", F.col("turn").cast("bigint"))
    return turns.join(F.broadcast(turns.agg(F.min("conv_id").alias("conv_id"))), "conv_id", "left_anti")


@query("SELECT email_id, subject FROM parsed_emails ORDER BY email_id DESC LIMIT 25")
def latest_mails(spark, d):
    return read(spark, d, "parsed_emails").orderBy(F.desc("email_id")).limit(25).select("email_id", "subject")


@query(f"{O.TURNS} SELECT * FROM turns WHERE conv_id = (SELECT min(conv_id) FROM turns)")
def get_conversation(spark, d):
    turns = _turns(spark, d).withColumn("turn", F.col("turn").cast("bigint"))
    return turns.join(F.broadcast(turns.agg(F.min("conv_id").alias("conv_id"))), "conv_id", "left_semi")


@query(O.RATE_LIMIT)
def rate_limit_log(spark, d):
    return answer.rate_limited(read(spark, d, "events"), 3, 86_400).select("event_id", "user_id", "allowed")


# code
@query(O.CODE_LANGUAGE)
def code_language(spark, d):
    return read(spark, d, "code_files").select("file_id", code_symbols.language(F.col("path")).alias("lang"))


@query(O.CODE_FILE)
def code_file(spark, d):
    return code_symbols.files_read(read(spark, d, "code_files"))


@query(O.IMPORTS)
def code_imports(spark, d):
    return code_symbols.imports(read(spark, d, "code_files")).withColumn("line_no", F.col("line_no").cast("bigint"))


@query(O.PYTHON)
def code_symbols_python(spark, d):
    found = code_symbols.python_symbols(read(spark, d, "code_files"))
    return found.select("file_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("line_end").cast("bigint").alias("line_end"), "name", "kind", "signature", "docstring", "parent")


def _symbols(spark, d, *langs):
    rows = read(spark, d, "code_files").where(code_symbols.language(F.col("path")).isin(*langs))
    return code_symbols.symbols(rows).withColumn("line_no", F.col("line_no").cast("bigint"))


for _name, _langs in (("js", ("javascript", "typescript")), ("go", ("go",)), ("rust", ("rust",)), ("java", ("java",))):
    QUERIES[f"code_symbols_{_name}"] = lambda s, d, langs=_langs: _symbols(s, d, *langs)
    SQL[f"code_symbols_{_name}"] = O.symbols(_langs[0])


@query(O.GENERIC)
def code_symbols_generic(spark, d):
    """The generic patterns over every file, as for a language without its own."""
    return code_symbols.symbols(read(spark, d, "code_files"), "generic").withColumn("line_no", F.col("line_no").cast("bigint"))


@query(O.SUMMARY)
def code_summary(spark, d):
    return code_symbols.summary(read(spark, d, "code_files"))


@query(O.SEARCHABLE)
def code_searchable(spark, d):
    return code_symbols.searchable(read(spark, d, "code_files"))


# request log
@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def request_counts(spark, d):
    return read(spark, d, "events").groupBy(F.window("ts", "1 hour")["start"].alias("start"), "event_type").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
