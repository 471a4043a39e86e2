"""Each operator on a few rows: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from corpuslane.llm import code_docs, emails, encoding, language, leakage, markup, near_duplicates, packing, page_content, scans, words

random.seed(11)
VOCABULARY = [f"word{k}" for k in range(300)]
TEXT = [" ".join(random.choices(VOCABULARY, k=60)) for _ in range(30)]
EXTRA = {"h": 1, "digest": "x", "n": 2.0, "lang": "en", "block": 9, "tokens": "t"}


def crowded(df):
    """The table with further columns whose names the operators use inside."""
    return df.withColumns({k: F.lit(v) for k, v in EXTRA.items() if k not in df.columns})


# p1
MAIL = "email_id long, message_id string, subject string, from_address string, to_addresses array<string>, date timestamp, headers map<string,string>, body_text string"


def mail(spark, *items):
    table = [(k, m, s, f, ["b@x.example"], None, h, b) for k, m, s, f, h, b in items]
    return crowded(spark.createDataFrame(table, MAIL).withColumn("date", F.expr("timestamp'2024-01-01' + make_interval(0,0,0,cast(email_id as int))")))


def test_new_lines(spark):
    first = "Hello Ann,\n\nThe committee will look at the seven open proposals on Monday morning and then decide.\n\nBest regards,\nBob Stone\n\n-- \nBob Stone\nPhone: 1"
    reply = "Hi Bob,\nFine with me.\n\nThanks,\nAnn\n\nOn 1 Jan 2024 10:00, Bob Stone <bob.stone@x.example> wrote:\n> Hello Ann,\n>\n> The committee will look at the seven open proposals\n> on Monday morning and then decide."
    bare = "New words of the third mail.\n\nThe committee will look at the seven open\nproposals on Monday morning and then decide."
    table = mail(spark, (1, "a", "Plan", "Bob Stone <bob.stone@x.example>", None, first), (2, "b", "Re: Plan", "ann@x.example", {"In-Reply-To": "a"}, reply), (3, "b", "RE: Plan", "ann@x.example", {}, reply), (4, "c", "Fwd: plan", "c@x.example", None, bare), (5, "d", None, None, None, None), (6, None, "", "e@x.example", None, ""), (7, "f", "Plan", "g@x.example", None, "x " * 5000))
    got = {}
    for r in emails.new_lines(table).collect():
        got.setdefault(r.email_id, []).append(r.line_no)
    assert {k: sorted(v) for k, v in got.items()} == {1: [1, 3], 2: [1, 2], 3: [1, 2], 4: [1], 7: [1]}
    assert emails.new_lines(table.limit(0)).count() == 0
    assert [r.s for r in table.select(emails.bare_subject(F.col("subject")).alias("s"), "email_id").orderBy("email_id").collect()][:3] == ["Plan"] * 3


def test_suffix_automaton():
    for _ in range(200):
        texts = [random.choices("abc", k=random.randint(0, 12)) for _ in range(3)]
        asked = random.choices("abcd", k=12)
        a = emails.SuffixAutomaton()
        for t in texts:
            a.add(t)
        want = [False] * 12
        for i in range(12):
            for j in range(i + 3, 13):
                if any(asked[i:j] == t[k : k + j - i] for t in texts for k in range(len(t))):
                    want[i:j] = [True] * (j - i)
        assert a.covered(asked, 3) == want


# p2
def test_documented(spark):
    python = 'def shown(a):\n    """Sends the finished report to every reader.\n\n    :param a: x\n    """\n\ndef load_file(x):\n    """Load the file."""\n\n# def no():\ns = "def no(): x"\nclass A:\n    @x\n    async def b(\n        self,\n    ):\n        \'\'\'Counts the rows that nobody has read yet.\'\'\'\n'
    java = "interface I {\n    /** Counts the rows that nobody has read yet. */\n    int count(String a, int b);\n}\nclass B implements I {\n    public int count(String x, int y) {\n        return 1;\n    }\n    /** TODO: document this method some day */\n    void todo() {\n    }\n}\n"
    go = "// Run moves all finished jobs to the archive.\nfunc (s *T) Run(a int) error {\n}\n\n// Detached words that stand far above it.\n\nfunc Other() {\n}\n"
    rust = "/// Moves all finished jobs to the archive.\n#[inline]\npub fn run(a: &str) -> u32 {\n}\n"
    js = "/**\r\n * Moves all finished jobs to the archive.\r\n * @param a\r\n */\r\nexport const run = (a) => {\r\n}\r\n/* plain words that are no documentation */\nfunction q() {\n}\n"
    table = crowded(spark.createDataFrame([(1, "a.py", "python", python), (2, "b.java", None, java), (3, "c.go", "unknown", go), (4, "d.rs", "Rust", rust), (5, "e.js", "javascript", js), (6, "f.py", "python", None), (7, "g.txt", None, "def f(): pass"), (8, "v/a.py", "python", python), (9, None, None, "")], "file_id long, path string, language string, content string"))
    got = code_docs.documented(table)
    assert rows(got.where("source = 'own'").select("file_id", "line_start")) == [(1, 1), (1, 14), (2, 3), (3, 2), (4, 3), (5, 5), (8, 1), (8, 14)]
    assert rows(got.where("source = 'declared'").select("file_id", "line_start", "documentation")) == [(2, 6, "Counts the rows that nobody has read yet. ")]
    assert code_docs.documented(table.limit(0)).count() == 0


def test_python_stubs_are_declarations(spark):
    base = 'class Store(Protocol):\n    def load(self, path):\n        """Read all rows of the given table."""\n        ...\n\n    def save(self, path, rows):\n        """Write rows to the given table."""\n        raise NotImplementedError("save")\n\n    def size(self):\n        """Count rows of the whole table."""\n        return 1\n'
    own = "class Disk(Store):\n    def load(self, path):\n        return open(path)\n\n    def save(self, path):\n        return 0\n\n    def size(self):\n        return 2\n"
    files = spark.createDataFrame([(1, "a.py", None, base), (2, "b.py", "python", own)], "file_id long, path string, language string, content string")
    got = [(r.file_id, r.name, r.source) for r in code_docs.documented(files).orderBy("file_id", "line_start").collect()]
    assert got == [(1, "load", "own"), (1, "save", "own"), (1, "size", "own"), (2, "load", "declared")]  # save has another signature, size a body


@pytest.mark.parametrize("doc, name, want", [("Load the file.", "load_file", True), ("closes scores quickly now", "close_score", False), ("Method to parse the index queue.", "parseIndexQueue", True), ("Args:\n    a: the first of all the numbers", "f", True), ("", "f", True), ("...", "f", True), ("Documentation will follow in a later release.", "f", True), ("Fetch queue once the gateway answers again.", "fetch_queue", False)])
def test_trivial(doc, name, want):
    assert code_docs.trivial(doc, name) is want


# p3
def jaccard(a, b, n=3):
    x, y = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (words.WORD.findall(a.lower()), words.WORD.findall(b.lower())))
    return len(x & y) / len(x | y) if x and y else 0


def test_near_duplicates(spark):
    items = list(enumerate(TEXT[:12]))
    for k in range(40):
        w = random.choice(TEXT[:6]).split()
        for _ in range(random.randint(0, 9)):
            w[random.randrange(len(w))] = "new" + str(random.randrange(9))
        items.append((100 + k, " ".join(w)))
    items += [(500 + k, TEXT[0].upper() + " !") for k in range(25)] + [(900, None), (901, ""), (902, "a b"), (903, "a b"), (904, "long " + "x y z " * 30000)]
    table = crowded(spark.createDataFrame(items, "row_id long, text string").repartition(5))
    want = sorted((a, b) for a, s in items for b, t in items if a < b and s and t and jaccard(s, t) >= 0.5)
    found = rows(near_duplicates.pairs(table))
    text = dict(items)
    assert set(found) <= set(want) and len(found) == len(set(found)) >= 0.97 * len(want)
    assert {p for p in want if jaccard(text[p[0]], text[p[1]]) >= 0.6} <= set(found)
    want = found
    groups = {r.row_id: (r.class_id, r.links) for r in near_duplicates.groups(table).collect()}
    parent = {k: k for k, _ in items}
    for a, b in want * 9:
        parent[a] = parent[b] = min(parent[a], parent[b])
    degree = {k: sum(k in p for p in want) for k, _ in items}
    assert groups == {k: (parent[k], degree[k]) for k, _ in items}
    assert near_duplicates.pairs(table.limit(0)).count() == 0 and near_duplicates.groups(table.limit(0)).count() == 0


def test_bands_catch_the_threshold():
    x = np.random.default_rng(3).integers(0, 2**32, 200, dtype=np.uint32)
    near = near_duplicates.minima(np.concatenate((x[:150], x[50:])), np.array([150, 0, 150]))  # similarity 0.5
    assert abs((near[:, 0] == near[:, 2]).mean() - 0.5) < 0.12
    plain = (x[:150, None] * near_duplicates._A + near_duplicates._B).min(axis=0)
    assert (near[:, 0] == plain).all()


def test_minima_of_texts_longer_than_a_block():
    x = np.random.default_rng(4).integers(0, 2**32, 30_000, dtype=np.uint32)
    runs = np.array([0, 1, 9000, 0, 12_000, 8999, 0])
    got = near_duplicates.minima(x, runs)
    for k, (low, n) in enumerate(zip(np.cumsum(runs) - runs, runs)):
        assert n == 0 or (got[:, k] == (x[low : low + n, None] * near_duplicates._A + near_duplicates._B).min(axis=0)).all()


# p4
def test_encoding(spark):
    clean = [f"Die Größe der {w} Übersicht später geprüft" for w in VOCABULARY[:60]] + [f"la mémoire cachée — {w} “vérifiée”" for w in VOCABULARY[:60]] + ["Ñandoro"] * 9
    bad = ["Größe".encode().decode("cp1252"), "mémoire cachée".encode().decode("latin-1").encode().decode("latin-1"), "später".encode().decode("mac_roman"), "geprüft".encode("cp1252").decode("cp437"), "m�moire"]
    items = [(k, t, None) for k, t in enumerate(clean)] + [(1000 + k, f"vor {t} nach", {"title": "später"}) for k, t in enumerate(bad)] + [(2000, None, {"author": "Größe".encode().decode("cp437")}), (2001, "", {}), (2002, "plain ascii", {"title": None})]
    table = crowded(spark.createDataFrame(items, "row_id long, text string, metadata map<string,string>"))
    got = {(r.row_id, r.field): (r.restored, r.lossy) for r in encoding.garbled(table).collect()}
    assert set(got) == {(1000 + k, "text") for k in range(5)} | {(2000, "author")}
    assert got[1000, "text"][0] == "vor Größe nach" and got[1001, "text"][0] == "vor mémoire cachée nach" and got[1002, "text"][0] == "vor später nach" and got[1003, "text"][0] == "vor geprüft nach" and got[1004, "text"] == ("vor m�moire nach", True)
    assert encoding.garbled(table.limit(0)).count() == 0


# p5
def test_scans(spark):
    body = ["every careful reader compares the second printed volume before", "the archive closes for the winter and the keeper leaves again"]
    page = lambda n, extra: "\n".join(["RUNNING TITLE HERE", "", *body, *extra, "~ .", f"- {n} -"])
    items = [(k, "a.pdf", k, page(k, ["the well-known keeper reads one more com-", "pares nothing"] if k == 3 else ["evcry c0mpares reader"] if k == 4 else [])) for k in range(1, 31)] + [(90, "b.pdf", 1, None), (91, "b.pdf", 2, ""), (92, None, None, "one lone line"), (93, "a.pdf", 30, "again")]
    table = crowded(spark.createDataFrame(items, "page_id long, doc_path string, page_number int, text string"))
    got = rows(scans.noise(table).where("page_id in (3, 4)"))
    assert got == [(3, 1, "header"), (3, 5, "hyphen"), (3, 7, "ocr"), (3, 8, "pageno"), (4, 1, "header"), (4, 5, "ocr"), (4, 6, "ocr"), (4, 7, "pageno")]
    text = " ".join(r.text for r in scans.paragraphs(table).where("doc_path = 'a.pdf'").orderBy("block", "paragraph").collect())
    assert "one more compares nothing" in text and "RUNNING" not in text and "every compares reader" in text
    assert scans.noise(table.limit(0)).count() == 0 and scans.paragraphs(table.limit(0)).count() == 0


def test_trie_is_complete():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        return new

    known = {"".join(random.choices("abc", k=random.randint(1, 6))): 1 for _ in range(200)}
    trie = scans.Trie(known)
    for _ in range(50):
        w = "".join(random.choices("abcd", k=4))
        assert sorted(trie.within(w, 2)) == sorted((distance(w, v), v, 1) for v in known if distance(w, v) <= 2)
    counted = scans.Trie({w: k for k, w in enumerate(sorted(known))})
    asked = ["".join(random.choices("abcd", k=random.randint(1, 7))) for _ in range(80)]
    least = np.array([random.choice([0, 50, 150.5]) for _ in asked])
    for most in (1, 2, 3):
        for w, low, places in zip(asked, least, counted.within_all(asked, most, least)):
            assert sorted((counted.words[i], counted.counts[i]) for i in places) == sorted((v, n) for _, v, n in counted.within(w, most, low))
    assert scans.Trie({}).within("a") == [] and scans.Trie({}).within_all(["a"], 2, np.zeros(1)) == [[]]


def test_misread_words_come_from_the_trie(spark, monkeypatch):
    """Without the automaton's candidates no misread word is found."""
    lines = [f"the keeper of the library opens the window number {k} again" for k in range(40)] + ["the kceper of the librany opens the w1ndow again"]
    table = spark.createDataFrame([(k, "a.pdf", k, "\n".join([x, "and the same keeper closes the library window again every night."])) for k, x in enumerate(lines)], "page_id long, doc_path string, page_number int, text string")
    assert rows(scans.noise(table).where("noise = 'ocr'")) == [(40, 1, "ocr")]
    words = {"the": 90, "keeper": 80, "library": 80, "window": 80, "again": 80}
    reader = scans.Reader(words, {})
    assert [reader.misread(w) for w in ("kceper", "librany", "w1ndow")] == ["keeper", "library", "window"]
    monkeypatch.setattr(scans.Trie, "within", lambda *_: [])
    assert [scans.Reader(words, {}).misread(w) for w in ("kceper", "librany", "w1ndow")] == [None] * 3


# p6
@pytest.mark.parametrize("text, want", [("Keep it while a < 10 and b > 17. Costs $5 to $6, C:\\docs\\new_17 and file_67_v71, slot [20] or {23}, R&D, 18 * 4, ~4..5.", []), ("a <b>c</b> &amp; d", ["html"]), ("x\n```\n<p>y</p> [[z]]\n```\n", ["markdown"]), ("a **b** c", ["markdown"]), ("Title\n=====\ntext", ["markdown"]), ("== Head ==\n* item\n# other one.", ["wiki"]), ("see [[page|this]] and ''that''", ["wiki"]), ("\\section{A} and $x^2$ % y", ["latex"]), ("let $\\alpha \\leq 1$", ["latex"]), ("# Head\nplain", ["markdown"]), (None, []), ("", []), ("  print(1)\n<p>x</p>\n~~~\ntext.", ["markdown"])])
def test_kinds(text, want):
    assert markup.kinds(text) == want


def test_clean(spark):
    table = crowded(spark.createDataFrame([(1, "<h2>A</h2><ul><li>x &amp; y</li></ul><pre><code>a &lt; b</code></pre>"), (2, "== A ==\n[[p|q]] ''r''"), (3, "\\section{A}\n\\textbf{b} $x_1$\n\\begin{itemize}\n\\item c\n\\end{itemize}"), (4, None), (5, ""), (6, "plain"), (6, "plain"), (7, "**b** [t](u) `c`\n\n```py\nx = 1\n```")], "row_id long, text string"))
    got = {r.row_id: r.text for r in markup.cleaned(table).collect()}
    assert got[1].split("\n") == ["## A", "- x & y", "    a < b"] or ("## A" in got[1] and "- x & y" in got[1] and "    a < b" in got[1])
    assert got[2] == "# A\nq r" and "# A" in got[3] and "b $x_1$" in got[3] and "- c" in got[3] and got[4] is None and got[5] == "" and got[6] == "plain" and "b t c" in got[7] and "    x = 1" in got[7]
    assert markup.cleaned(table).count() == 8 and markup.marked(table.limit(0)).count() == 0 and rows(markup.marked(table).where("row_id < 4")) == [(1, "html"), (2, "wiki"), (3, "latex")]


# p7
def test_main_lines(spark):
    def page(k, body):
        return f"<html><head><title>T{k} - Site</title></head><body><nav><div><a href='/'>Home</a></div></nav><div class='x'><h1>T{k}</h1>{body}</div><div class='s'>Share this page</div><footer><div><a href='/i'>Imprint</a></div></footer></body></html>"

    def text(k, body):
        return "\n".join(["Home", f"T{k}", *body, "", "Share this page", "Imprint"])

    items = [(10 * s + k, f"https://www.s{s}.example/{k}", f"T{k} - Site", text(k, [f"Sentence {k} of site {s}."]), page(k, f"<p>Sentence {k} of site {s}.</p>")) for s in range(4) for k in range(4)]
    items += [(100, "https://www.s1.example/1", "T1 - Site", text(1, ["Sentence 1 of site 1."]), page(1, "<p>Sentence 1 of site 1.</p>")), (101, "https://www.s9.example/9", "T9 - Site", text(9, ["Sentence nine."]), None), (102, None, None, None, None), (103, "https://www.s8.example/", None, "Home\nShare this page", "<div>Home</div><div>Share this page</div>"), (104, "not a url", None, "", "")]
    table = crowded(spark.createDataFrame(items, "url_id long, url string, title string, text string, html string"))
    got = {}
    for r in page_content.main_lines(table).collect():
        got.setdefault(r.url_id, []).append(r.line_no)
    assert {k: sorted(v) for k, v in got.items()} == {k: [2, 3] for k in [*(10 * s + k for s in range(4) for k in range(4)), 100, 101]}
    assert {r.url_id: r.main_text for r in page_content.main_text(table).collect()}[101] == "T9\nSentence nine."
    assert page_content.main_lines(table.limit(0)).count() == 0


# p8
def test_packing(spark):
    sizes = [(k, random.randint(0, 40)) for k in range(300)] + [(300, 250), (301, 100), (302, None), (5, 7)]
    table = crowded(spark.createDataFrame(sizes, "doc_id long, size long"))
    got = packing.pack(table, {1: 100, 2: 33}, tokens="size").collect()
    for b, c in ((1, 100), (2, 33)):
        mine = [r for r in got if r.budget_id == b]
        whole = {}
        for r in mine:
            whole[r.doc_id] = whole.get(r.doc_id, 0) + r.tokens
            assert r.piece == 0 or dict(sizes)[r.doc_id] > c
        expected = {}
        for k, n in sizes:
            expected[k] = expected.get(k, 0) + (n or 0)
        assert whole == expected
        boxes = {}
        for r in mine:
            boxes.setdefault(r.container, []).append((r.place, r.first_token, r.tokens))
        for items in boxes.values():
            at = 0
            for n, (place, first, tokens) in enumerate(sorted(items)):
                assert place == n and first == at
                at += tokens
            assert at <= c
        total = sum(n or 0 for _, n in sizes)
        assert total / (len(boxes) * c) > (0.93 if c == 100 else 0.75)
    assert packing.pack(table.limit(0), {1: 10}, tokens="size").count() == 0


def test_token_counts(spark):
    import tiktoken  # noqa: F401

    table = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "word " * 60000), (6, "x" * 250_000)], "doc_id long, text string")
    got = dict((r.doc_id, r.tokens) for r in packing.token_counts(table).collect())
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and abs(got[5] - 60001) <= 3 and got[6] > 1000


# p9
def test_leaks(spark):
    p = TEXT[20].split()
    docs = [(1, " ".join(["pre"] * 9 + p[5:18] + ["post"] * 3)), (2, " ".join(p[5:17])), (3, ", ".join(p).upper()), (4, None), (5, ""), (6, " ".join(p[:6] + ["x"] + p[7:30])), (7, "ﬁ" + " ".join(p)), (3000, "­".join(" ".join(p))), (9, " ".join(TEXT[:20]) * 30)]
    table = crowded(spark.createDataFrame(docs, "doc_id long, text string"))
    items = spark.createDataFrame([(1, TEXT[20], "q"), (2, None, "q"), (3, "too short", "q"), (4, TEXT[20], "q")], "item_id long, passage string, doc_id string")
    got = rows(leakage.leaks(table, items).where("exact_run >= 13").select("doc_id", "item_id"))
    assert got == sorted((d, i) for d in (1, 3, 6, 7, 3000) for i in (1, 4))
    six = leakage.leaks(table, items).where("doc_id = 6 and item_id = 1").first()
    assert six.matched == 29 and six.substituted == 1 and six.first_word == 0
    assert rows(leakage.leaks(table, items, block_words=1).select("doc_id", "item_id")) == rows(leakage.leaks(table, items).select("doc_id", "item_id"))
    assert leakage.leaks(table.limit(0), items).count() == 0 and leakage.leaks(table, items.limit(0)).count() == 0


# p10
def test_languages(spark):
    parts = {"en": "The quick report describes the empty house before the winter. We moved every table into the kitchen.", "de": "Der schnelle Bericht beschreibt das leere Haus vor dem Winter. Wir haben jeden Tisch in die Küche gestellt.", "fr": "Le rapport rapide décrit la maison vide avant l'hiver. Nous avons mis chaque table dans la cuisine."}
    items = [(k, parts[x], x) for k, x in enumerate(["en", "de", "fr"] * 6)] + [(100, parts["de"], "en"), (101, parts["en"] + " " + parts["fr"], "EN-gb"), (102, parts["en"] + " “Der schnelle Bericht beschreibt das Haus.” " + parts["en"], " English "), (103, None, "en"), (104, " \n", None), (105, parts["fr"].upper(), "xx"), (106, "2024-01-01 ERROR a=1", "de"), (107, "Der leere Tisch beschreibt das Haus.", None)]
    table = crowded(spark.createDataFrame(items, "doc_id long, text string, lang string"))
    names = spark.createDataFrame([("en", "eng", "English"), ("de", "deu", "German"), ("fr", "fra", "French")], "lang string, alpha3 string, name_en string")
    got = language.mislabelled(table, names)
    assert rows(got.select("doc_id", "lang")) == [(100, "de"), (101, "en"), (101, "fr"), (105, "fr"), (107, "de")]
    assert all(0 <= r.confidence <= 1 for r in got.collect()) and language.mislabelled(table.limit(0), names).count() == 0
    segments = language.sentences(table, language.fit(table, names)).where("doc_id = 101").orderBy("segment").collect()
    assert [s.lang for s in segments] == ["en", "fr"] and segments[0].end == segments[1].start and segments[1].end == len(parts["en"]) + len(parts["fr"]) + 1


def test_hot_thread_is_split(spark, monkeypatch):
    monkeypatch.setattr(emails, "MOST_CHARS", 400)
    text = [f"Body {' '.join(random.choices(VOCABULARY, k=20))} ends here." for _ in range(60)]
    items = [(k, f"m{k}", "Hot", f"a{k % 5}@x.example", {"In-Reply-To": f"m{k - 1}"} if k % 2 else None, f"Reply number {k} is new.\n\n{text[k - 1]}" if k % 2 else text[k]) for k in range(60)]
    assert rows(emails.new_lines(mail(spark, *items)).select("email_id", "line_no")) == [(k, 1) for k in range(60)]


def test_hot_copies_are_one_node(spark):
    d = spark.range(3000).selectExpr("id row_id", "case when id % 3 = 0 then 'the same text in a third of all rows' else concat('row ', id, ' has its own text ', id * 7, ' of words') end text")
    got = near_duplicates.groups(d).groupBy("class_id").agg(F.count("*").alias("n"), F.max("links").alias("links"))
    assert rows(got.where("n > 1").select("class_id", "n", "links")) == [(0, 1000, 999)]


def test_hot_buckets_lose_nothing(spark, monkeypatch):
    """5,000 texts that share nearly half of their runs, hence bands: no pair but the planted ones is similar."""
    rng = random.Random(11)
    shared = " ".join(f"common{k}" for k in range(30))
    items = [(k, f"{shared} " + " ".join(f"w{rng.randrange(10**7)}" for _ in range(36))) for k in range(5000)]
    for k in range(60):
        w = items[k * 80][1].split()
        w[rng.randrange(30, 66)] = "changed"
        items.append((10_000 + k, " ".join(w)))
    table = spark.createDataFrame(items, "row_id long, text string").repartition(6)
    want = sorted((k * 80, 10_000 + k) for k in range(60))
    assert rows(near_duplicates.pairs(table)) == want
    monkeypatch.setattr(near_duplicates, "TEXTS_A_BLOCK", 300)  # hot only where blocks meet
    assert rows(near_duplicates.pairs(table, most_broadcast=0)) == want  # texts picked by a shuffled join
    classes = near_duplicates.groups(table).where("links > 0")
    assert rows(classes.select("row_id", "class_id")) == sorted([(a, a) for a, _ in want] + [(b, a) for a, b in want])


def test_a_task_empties_hot_buckets(spark):
    """As many bands as a task may hold: members go on before the end, and none is lost."""
    rng = np.random.default_rng(5)
    h = np.concatenate((np.full(4000, 7), np.full(30, 9), rng.integers(100, 2**31, 3000))).astype(np.uint32)
    d = np.arange(len(h), dtype=np.int64)
    blocks = [(0, 0, bytearray(near_duplicates._pack(h[k::7], d[k::7]))) for k in range(7)]
    table = spark.createDataFrame(blocks, "part int, kind int, data binary").coalesce(1)
    for most in (500, 10**9):
        got = near_duplicates._meet(table, most).distinct()
        assert {r.a for r in got.where("kind = 1").collect()} == set(range(4000))
        pairs = {(r.a, r.b) for r in got.where("kind = 0").collect()}
        assert {(a, b) for a in range(4000, 4030) for b in range(a + 1, 4030)} <= pairs
