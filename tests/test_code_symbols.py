"""Literal cases of the line scan: names, kinds, signatures, imports, docstrings and summaries."""

from conftest import rows

from corpuslane.operators import code_symbols as C

FILES = [
    (1, "a/x.js", "export default async function load(a, b) {\nconst f = async (x) => x\n  run: function(y) { class Inner extends Base\nlet g = (z) => z\nrequire('fs')\nimport a from 'b'"),
    (2, "y.go", 'package y\nimport (\n\t"fmt"\n\n\tx "os"\n)\nimport "io"\ntype T struct {\ntype I interface {\nfunc (t *T) Run(a int) error {\nvar f = func(x int) {'),
    (3, "z.RS", "use std::io;\npub struct P;\n    pub async fn go<T>(a: T) -> u8 {"),
    (4, "Q.java", "import java.util.List;\npublic final class Q {\n  public static List<String> all(int n) {\n  int x = compute(n);"),
    (5, "p.py", "import os\n    from a import b\nclass A(Base):\n    '''One line.'''\n\n    def f(self, x) -> int:\n        \"\"\"First\n        second\"\"\"\nx = 1\ndef g():\n    pass\nasync def h(): pass\n    def k(): pass\n\"\"\"\"\"\""),
    (6, "run.sh", "function go {\n  def x and class y\n"),
    (7, "none", None),
    (8, "big.py", "#" * (1024 * 1024 + 1)),
]


def table(spark):
    return spark.createDataFrame([(*f, 3) for f in FILES], "file_id long, path string, content string, n int")


def test_languages(spark):
    got = {r.path: r.language for r in C.files_read(table(spark)).collect()}
    assert got == {"a/x.js": "javascript", "y.go": "go", "z.RS": "rust", "Q.java": "java", "p.py": "python", "run.sh": "shell", "none": "unknown", "big.py": "python"}
    paths = spark.createDataFrame([("a.pyi",), ("b.cc",), ("c.cxx",), ("d.zsh",), ("e.mjs",), ("f.less",), (None,)], "p string")
    assert [r[0] for r in paths.select(C.language(paths.p)).collect()] == ["python", "cpp", "cpp", "shell", "unknown", "unknown", "unknown"]
    big = C.files_read(table(spark)).where("file_id = 8").first()
    assert big.lines is None and big.error == "File too large: 1048577 bytes"


def test_symbols(spark):
    found = [r[:2] + r[3:] for r in rows(C.symbols(table(spark)))]
    assert found == [
        (1, 1, "load", "function", "load(a, b)"),
        (1, 2, "f", "function", "f(x)"),
        (1, 3, "run", "function", "run(y)"),
        (1, 3, "Inner", "class", "class Inner"),
        (2, 8, "T", "struct", "type T struct"),
        (2, 9, "I", "interface", "type I interface"),
        (2, 10, "Run", "function", "func Run(a int)"),
        (3, 2, "P", "struct", "struct P"),
        (3, 3, "go", "function", "fn go(a: T)"),
        (4, 2, "Q", "class", "class Q"),
        (4, 3, "all", "method", "all(int n)"),
        (6, 1, "go", "symbol", "function go {"),
        (6, 2, "x", "symbol", "def x and class y"),
    ]


def test_python(spark):
    got = [(r.line_no, r.line_end, r.name, r.kind, r.signature, r.docstring, r.parent) for r in C.python_symbols(table(spark)).orderBy("line_no").collect()]
    assert got == [(3, 8, "A", "class", "class A", "One line.", None), (6, 6, "f", "method", "def f(self, x)", "First\n        second", "A"), (10, 10, "g", "function", "def g()", None, None), (13, 13, "k", "method", "def k()", '"""', "A")]


def test_imports(spark):
    got = [(a, c) for a, _, c in rows(C.imports(table(spark)))]
    assert got == [(1, "require('fs')"), (1, "import a from 'b'"), (2, "fmt"), (2, 'x "os'), (2, "io"), (3, "use std::io;"), (4, "java.util.List"), (5, "import os"), (5, "from a import b")]


def test_summary(spark):
    got = {r.file_id: r.summary for r in C.summary(table(spark), 1, 1).collect()}
    assert got[5] == "# p.py (python)\n\n## Imports\n- import os\n... and 1 more\n\n## Classes\n- `A`: One line....\n\n## Functions\n- `def g()`"
    assert got[1].endswith("## Classes\n- `Inner`\n\n## Functions\n- `load(a, b)`\n... and 2 more") and got[7] == "# none (unknown)" and 8 not in got
    text = {r.file_id: r.searchable_text for r in C.searchable(table(spark)).collect()}
    assert text[7] == "File: none\nLanguage: unknown\n\n\n" and text[5].startswith("File: p.py\nLanguage: python\n\nclass: class A\n  One line.\nmethod: def f(self, x)\n  First\n        second\nfunction: def g()\nmethod: def k()\n")
    assert C.summary(table(spark).limit(0)).count() == 0 and C.searchable(table(spark).limit(0)).count() == 0
