import json

from conftest import rows
from pyspark.sql import functions as F

from corpuslane.operators import code_symbols, table
from corpuslane.sources import files
from corpuslane.streaming import streams


def test_dedup_and_report(spark):
    df = spark.createDataFrame([(1, "a.txt", "One. Two."), (2, "b.txt", "One. Two."), (3, "c.exe", "x"), (4, "d.txt", "  "), (5, "e.md", None), (6, None, "y"), (7, "f.md", "New text.")], "doc_id long, filename string, text string")
    assert [r.doc_id for r in table.dedup_exact(df).orderBy("doc_id").collect()] == [1, 3, 4, 5, 6, 7]
    report = {r.doc_id: r.status for r in table.ingest_report(df).collect()}
    assert report == {1: "success", 2: "skipped", 3: "error", 4: "skipped", 5: "skipped", 6: "error", 7: "success"}
    assert table.ingest_summary(table.ingest_report(df)).first()[:4] == (2, 2, 3, 2)
    once = table.ingest(df)
    assert sorted(r.text for r in once.collect()) == ["New text.", "One. Two."]
    assert table.ingest(df, once).count() == 0


def test_listing(spark):
    c = spark.createDataFrame([(2, "d", "p/x.txt", 1, "bb", None, None), (1, "d", "p/x.txt", 0, "a", {"original_filename": "X", "extension": ".md"}, "t"), (3, "e", "y.html", 0, None, None, "u")], "row_id long, doc_id string, doc_path string, chunk_id int, text string, metadata map<string,string>, created_at string")
    got = {r.path: r for r in table.list_documents(c).collect()}
    assert got["p/x.txt"].filename == "X" and got["p/x.txt"].chunk_count == 2 and got["p/x.txt"].total_chars == 3 and got["y.html"].file_type == ".html"
    assert table.index_stats(c).first()[:] == (2, 3, 3) and table.delete_document(c, "d").count() == 1
    assert [r.path for r in table.page(table.list_documents(c), [F.asc("ord")], 2, 1).collect()] == ["y.html"] and table.page(c, [F.asc("row_id")], 9, 5).count() == 0
    assert table.list_documents(c.limit(0)).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\n## x\n```\n# in\n```\n")
    (tmp_path / "b.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "d.html").write_text("<title>T</title><p>x</p>")
    (tmp_path / "e.eml").write_text("From: A <a@x.example>\nTo: b@y.example\nSubject: =?utf-8?b?w6k=?=\nDate: nonsense\n\nhello")
    got = {r.filename: r for r in files.extract(files.read_files(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.md", "b.txt", "d.html", "e.eml"} and got["a.md"].title == "Title" and got["b.txt"].text == "é" and got["d.html"].title == "T" and got["b.txt"].lines == 1
    mail = files.full_text(files.read_emails(files.read_files(spark, str(tmp_path)).where("extension = '.eml'"))).first()
    assert mail.subject == "é" and mail.date is None and mail.to_addresses == ["b@y.example"] and mail.full_text.endswith("hello") and "Unknown" in mail.full_text
    assert files.file_hash(tmp_path / "c.exe") == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    (tmp_path / "cases.json").write_text(json.dumps([{"query": "q", "relevant_docs": ["a"], "metadata": {"category": "c", "difficulty": "d"}}]))
    assert files.read_eval_cases(spark, str(tmp_path / "cases.json")).first().relevant_docs == ["a"]


def test_message_parts():
    raw = b'Content-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/html\n\n<p>x</p>\n--b\nContent-Type: text/plain\nContent-Disposition: attachment; filename="n.txt"\n\ndata\n--b--\n'
    m = files.parse_message(raw)
    assert m["body_text"] is None and "<p>x</p>" in m["body_html"] and m["attachments"][0]["filename"] == "n.txt" and m["from_address"] is None


def test_symbols(spark):
    python = "import os\nclass A:\n    def m(self):\n        pass\nasync def no():\n    pass\ndef f(x): return x\n"
    go = 'import (\n\t"fmt"\n)\nfunc (s *T) Run(a int) error {\n}\ntype T struct {\n'
    df = spark.createDataFrame([(1, "a.py", python), (2, "b.go", go), (3, "c.unknown", "function z(a) {"), (4, "d.rs", None), (5, "e.js", "export const q = (a) => {\n")], "file_id long, path string, content string")
    assert [(r.name, r.kind, r.parent) for r in code_symbols.python_symbols(df).orderBy("line_no").collect()] == [("A", "class", None), ("m", "method", "A"), ("f", "function", None)]
    assert sorted((r.file_id, r.name, r.kind) for r in code_symbols.symbols(df).collect()) == [(2, "Run", "function"), (2, "T", "struct"), (3, "z", "symbol"), (5, "q", "function")]
    assert [(r[0], r[1], r[2].strip()) for r in rows(code_symbols.imports(df))] == [(1, 1, "import os"), (2, 2, "fmt")]
    assert "# b.go (go)" in {r.file_id: r.summary for r in code_symbols.summary(df).collect()}[2]


def test_stream_ingest(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    batch = spark.createDataFrame([("a.txt", "One. Two."), ("b.txt", "Three.")], "filename string, text string")
    batch.write.parquet(src)
    read = lambda: spark.readStream.schema("filename string, text string").parquet(src)
    streams.start_ingest(read(), out, str(tmp_path / "cp")).awaitTermination()
    batch.write.mode("append").parquet(src)
    streams.start_ingest(read(), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["One. Two.", "Three."]


def test_stream_limit_equals_batch(spark, tmp_path):
    from corpuslane.operators.answer import rate_limited

    df = spark.createDataFrame([(k, k % 2, f"2024-01-01 00:00:{k:02d}") for k in range(20)], "event_id long, user_id long, t string").selectExpr("event_id", "user_id", "to_timestamp(t) ts")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streams.rate_limited_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 2, 9).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("limited").select("event_id", "allowed")) == rows(rate_limited(df, 2, 9).select("event_id", "allowed"))
