import re

from conftest import rows
from pyspark.sql import functions as F

from corpuslane.functions import html, registry
from corpuslane.functions import text as X


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(f(*(F.col(f"c{k}") for k in range(len(values)))).alias("x")).first().x


def test_normalize(spark):
    assert one(spark, X.normalize_text, "a\r\nb\rc") == "a\nb\nc"
    assert one(spark, X.normalize_text, "a   b\n\n\n\nc\t\td\x00\x85") == "a b\n\nc d"
    assert one(spark, X.normalize_text, "") == "" and one(spark, X.normalize_text, None) == ""
    assert one(spark, X.normalize_text, "\u00a0 x \u2003") == "x"
    assert one(spark, X.normalize_text_kit, " a  b\n\n\n\nc ") == "a  b\n\n\n\nc"


def test_tokens_and_sentences(spark):
    assert one(spark, X.tokens, "Well-known x_1, ÉTÉ! a/b") == ["well-known", "x_1", "été", "a", "b"]
    assert one(spark, X.tokens, None) == []
    assert one(spark, X.sentences, "One. Two!  Three? \n Four") == ["One.", "Two!", "Three?", "Four"]
    assert one(spark, X.word_count, " a  b\u00a0c ") == 3 and one(spark, X.word_count, "") == 0 and one(spark, X.word_count, None) == 0


def test_names(spark):
    assert one(spark, X.safe_filename, "a b/ü.txt") == "a_b_ü.txt"
    assert one(spark, X.suffix, "dir.x/File.TXT") == ".txt" and one(spark, X.suffix, ".hidden") == ""
    assert one(spark, X.url_domain, "https://u@h.example:8/p?q") == "u@h.example:8" and one(spark, X.url_domain, "x") == ""


def brute_highlight(text, query, most=300, context=50):
    if not text:
        return ""
    if not query:
        return text[:most]
    low, words = text.lower(), list(dict.fromkeys(re.findall(r"[^\W]+(?:-[^\W]+)*|-", query.lower())))
    best, at = 0, 0
    for w in words:
        p = low.find(w)
        if p >= 0:
            window = low[max(0, p - 100) : p + 100]
            score = sum(v in window for v in words)
            if score > best:
                best, at = score, p
    start = max(0, at - context)
    end = min(len(text), start + most)
    begin, stop = start, end
    if start > 0 and (s := text.find(" ", start, start + 20)) >= 0:
        begin = s + 1
    if end < len(text) and (e := text.rfind(" ", end - 20, end)) >= 0:
        stop = e
    return ("..." if begin > 0 else "") + text[begin:stop].strip() + ("..." if stop < len(text) else "")


def test_highlight(spark):
    base = " ".join(f"word{k} filler" for k in range(200))
    for t, query in [("Short text about cats.", "cats"), (base, "word150 word151"), (base, "nothing here"), (base, "word0"), (base, "word199"), ("", "x"), (base, ""), (base.upper(), "word77 filler")]:
        assert one(spark, X.highlight, t, query) == brute_highlight(t, query), query
    assert one(spark, X.highlight, None, "x") == ""


def test_excerpt(spark):
    long = "a" * 300 + ". " + "b" * 400
    assert one(spark, X.excerpt, long) == "a" * 300 + "."
    assert one(spark, X.excerpt, "a" * 600) == "a" * 500 + "..."
    assert one(spark, X.excerpt, "short") == "short"


def test_html(spark):
    page = "<html><head><title>A <b>t</b></title><script>x</script></head><body><!-- c --><h1>H</h1><p>one &amp;lt; two</p><pre>z</pre><noscript>n</noscript></body>"
    assert one(spark, html.html_title, page) == "A t"
    assert "x" not in one(spark, html.extract_html, page).split() and "one < two" in one(spark, html.extract_html, page)
    assert one(spark, html.web_title, "<title></title><h1>H</h1>") == "" and one(spark, html.web_title, "<h1>H</h1>") == "H"
    assert one(spark, html.extract_html, None) == ""
    links = '<a href="/a">x</a><a href="b">x</a><a href="#c">x</a><a href="mailto:x@y.z">x</a><a href="//h/p">x</a><a href="https://o/p">x</a>'
    assert one(spark, html.links, links, "https://s.example/d/e.html") == ["https://h/p", "https://o/p", "https://s.example/a", "https://s.example/d/b"]
    assert one(spark, html.images, '<img src="data:x"><img src="i.png">', "https://s.example/d/") == ["https://s.example/d/i.png"]


def test_sql_functions(spark):
    registry.register(spark)
    got = spark.sql("SELECT tokenize_text('A b-c') AS t, chunk_text('One. Two.') AS c, normalize_document('a  b') AS n").first()
    assert got.t == ["a", "b-c"] and got.c == ["One. Two."] and got.n == "a b"
    assert rows(spark.sql("SELECT size(chunk_text(''))")) == [(0,)]
