
import random

from conftest import rows
from pyspark.sql import functions as F

from corpuslane.llm import emails, page_content, scans

MAIL = "email_id long, message_id string, subject string, from_address string, to_addresses array<string>, headers map<string,string>, body_text string"


# p5
def test_rare_words_and_lost_characters_are_candidates():
    words = {"the": 5000, "library": 600, "keeper": 10, "half-finished": 9, "walrus": 5, "grey": 90, "swims": 90}
    reader = scans.Reader(words, {("grey", "walrus"): 5, ("walrus", "swims"): 5})
    assert reader.misread("libary") == reader.misread("librarxy") == "library"
    assert reader.misread("kceper") == reader.misread("ke3per") == "keeper"
    assert reader.misread("h@lf-finished") == "half-finished"
    assert reader.misread("walrxs") is None and reader.misread("walrxs", "grey", "swims") == "walrus"
    assert reader.misread("Libary") is None and reader.misread("keeper") is None


def test_long_file_is_read_as_a_whole(spark):
    body = ["every careful reader compares the second printed volume before", "the archive closes for the winter and the keeper leaves again"]
    page = lambda n, first, last: "\n".join(["RUNNING TITLE HERE", *first, *body, *last, str(n + 7), "Running foot of all"])
    items = [(n, "a.pdf", n, page(n, ["pares nothing at all"] if n == 65 else [], ["and one more careful com-"] if n == 64 else [])) for n in range(1, 66)]
    table = spark.createDataFrame(items, "page_id long, doc_path string, page_number int, text string")
    assert rows(scans.noise(table).where("page_id = 65")) == [(65, 1, "header"), (65, 5, "pageno"), (65, 6, "header")]
    (text,) = [r.text for r in scans.paragraphs(table).collect()]
    assert "and one more careful compares nothing at all" in text


# p1
def test_large_thread_sees_all_earlier_mails(spark, monkeypatch):
    texts = [" ".join(random.choices([f"word{k}" for k in range(300)], k=25)) + "." for _ in range(61)]
    words = lambda k: f"Answer {k} is new here."
    bodies = [texts[0], *(f"{words(k)}\n\n{texts[k]}" for k in range(1, 60)), f"{words(60)}\n\n{texts[0]}\n{texts[20]}"]
    table = spark.createDataFrame([(k * k, f"m{k}", "Hot", f"a{k}@x.example", None, None, b) for k, b in enumerate([*bodies, bodies[30]])], MAIL).withColumn("date", F.expr("timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,cast(email_id as int))"))
    whole = rows(emails.new_lines(table).select("email_id", "line_no"))
    assert (3600, 1) in whole and not {(3600, 3), (3600, 4), (3721, 1)} & set(whole)
    monkeypatch.setattr(emails, "MOST_CHARS", 400)
    assert rows(emails.new_lines(table).select("email_id", "line_no")) == whole


# p7
def test_large_site_is_read_as_a_whole(spark, monkeypatch):
    def html(k):
        return f"<html><body><div class='t'>Teaser number {k}</div><div><h1>T{k}</h1><p>Sentence {k} of it.</p><p>Read all our other fine pages</p></div><div>Share this page</div></body></html>"

    items = [(k, f"https://www.s.example/{k}", f"T{k}", f"Teaser number {k}\nT{k}\nSentence {k} of it.\nRead all our other fine pages\nShare this page", html(k)) for k in range(30)]
    items += [(50, "https://www.s.example/5", *items[5][2:]), (90, "https://www.s.example/90", "T90", "\n".join(["T90", "Sentence 90 of it.", *(f"Teaser number {k}" for k in range(30))]), None)]
    table = spark.createDataFrame(items, "url_id long, url string, title string, text string, html string")
    whole = rows(page_content.main_lines(table))
    assert whole == sorted([(k, n) for k in [*range(30), 50] for n in (2, 3)] + [(90, 1), (90, 2)])
    monkeypatch.setattr(page_content, "MOST_CHARS", 300)
    assert rows(page_content.main_lines(table)) == whole
