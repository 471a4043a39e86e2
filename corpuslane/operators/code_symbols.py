"""Symbols, imports and documentation of source files by a scan of their lines, as SQL expressions.

A file's lines are exploded once; rules are regular expressions on single lines, and what needs other lines (docstrings,
ends of classes, import blocks) is a window over the file's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.functions.text import basename, strip, suffix

#: Language by extension (fixed values).
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cxx": "cpp",
    ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".r": "r", ".sql": "sql", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".md": "markdown", ".html": "html", ".css": "css", ".scss": "scss",
}
#: Per language, lists of (pattern, kind, signature); of each list the first match on a line is a symbol. In signatures,
#: {1} and {2} are the pattern's groups; group 1 is the name (patterns and forms are fixed values).
RULES: dict[str, list[list[tuple[str, str, str]]]] = {
    "javascript": [
        [(r"function\s+(\w+)\s*\(([^)]*)\)", "function", "{1}({2})"), (r"const\s+(\w+)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*=>", "function", "{1}({2})"), (r"(\w+)\s*:\s*(?:async\s*)?function\s*\(([^)]*)\)", "function", "{1}({2})")],
        [(r"class\s+(\w+)", "class", "class {1}")],
    ],
    "go": [[(r"func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(([^)]*)\)", "function", "func {1}({2})")], [(r"type\s+(\w+)\s+struct", "struct", "type {1} struct"), (r"type\s+(\w+)\s+interface", "interface", "type {1} interface")]],
    "rust": [[(r"fn\s+(\w+)(?:<[^>]+>)?\s*\(([^)]*)\)", "function", "fn {1}({2})")], [(r"struct\s+(\w+)", "struct", "struct {1}")]],
    "java": [[(r"class\s+(\w+)", "class", "class {1}")], [(r"(?:public|private|protected)?\s*(?:static\s+)?(?:\w+(?:<[^>]+>)?)\s+(\w+)\s*\(([^)]*)\)", "method", "{1}({2})")]],
    "generic": [[(r"(?:function|func|def|fn)\s+(\w+)", "symbol", ""), (r"class\s+(\w+)", "symbol", "")]],
}
RULES["typescript"] = RULES["javascript"]
PYTHON_CLASS, PYTHON_DEF = r"^class\s+(\w+)(?:\([^)]*\))?\s*:", r"^(\s*)def\s+(\w+)\s*\(([^)]*)\)(?:\s*->\s*[^:]+)?\s*:"
#: How import lines begin, and what is taken off them (fixed values).
IMPORTS = {"python": ("import ", "from "), "javascript": ("import ", "require("), "typescript": ("import ", "require("), "rust": ("use ",), "java": ("import ",)}
MOST_BYTES = 1024 * 1024
DOC_LINES = 20


def language(path: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[suffix(path)], F.lit("unknown"))


def _unix(content: Column) -> Column:
    return F.regexp_replace(F.coalesce(content, F.lit("")), "\r\n?", "\n")


def files_read(files: DataFrame) -> DataFrame:
    """(file_id, path, language, lines, size_bytes, error): of each file what was read; error where it is too large."""
    size = F.octet_length(_unix(F.col("content")))
    large = size > MOST_BYTES
    return files.select(
        "file_id", "path", language(F.col("path")).alias("language"),
        F.when(~large, F.size(F.split(_unix(F.col("content")), "\n"))).cast("bigint").alias("lines"), size.cast("bigint").alias("size_bytes"), F.when(large, F.concat(F.lit("File too large: "), size.cast("string"), F.lit(" bytes"))).alias("error"),
    )


def lines(files: DataFrame) -> DataFrame:
    """(file_id, lang, line_no, line) of files that are not too large; line_no counts from 1."""
    kept = files.withColumn("content", _unix(F.col("content"))).where(F.octet_length("content") <= MOST_BYTES)
    return kept.select("file_id", language(F.col("path")).alias("lang"), F.posexplode(F.split("content", "\n")).alias("n", "line")).select("file_id", "lang", (F.col("n") + 1).alias("line_no"), "line")


def imports(files: DataFrame) -> DataFrame:
    """(file_id, line_no, import): the import lines of a file, stripped; of Go also the lines of import blocks."""
    rows = lines(files).withColumn("line", strip(F.col("line")))
    begins = lambda words: F.lit(False) if not words else F.coalesce(*[F.when(F.col("line").startswith(w), True) for w in words], F.lit(False))
    is_import = F.lit(False)
    for name, words in IMPORTS.items():
        is_import = is_import | ((F.col("lang") == name) & begins(words))
    java = F.regexp_replace(F.replace("line", F.lit("import "), F.lit("")), ";+$", "")
    plain = rows.where(is_import).select("file_id", "line_no", F.when(F.col("lang") == "java", java).otherwise(F.col("line")).alias("import"))
    before = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    opening, closing = F.col("line").startswith("import ("), F.col("line") == ")"
    inside = F.coalesce(F.last(F.when(opening, True).when(closing, False), ignorenulls=True).over(before), F.lit(False))
    go = rows.where("lang = 'go'").withColumn("inside", inside).where(~opening)
    listed = go.where((F.col("inside") & ~closing & (F.col("line") != "")) | (~F.col("inside") & F.col("line").startswith("import ")))
    named = F.regexp_replace(F.when(F.col("inside"), F.col("line")).otherwise(F.replace("line", F.lit("import "), F.lit(""))), '^"+|"+$', "")
    return plain.unionByName(listed.select("file_id", "line_no", named.alias("import")))


def matches(rules: list[list[tuple[str, str, str]]], line: Column) -> Column:
    """The symbols of a line as an array of (place, name, kind, signature)."""

    def symbol(place: int, pattern: str, kind: str, form: str) -> Column:
        group = lambda k: F.regexp_extract(line, pattern, k)
        parts = [group(int(x)) if x in "12" else F.lit(x) for x in form.replace("}", "{").split("{") if x]
        signature = F.concat(*parts) if parts else F.substring(strip(line), 1, 80)
        return F.when(line.rlike(pattern), F.struct(F.lit(place).alias("place"), group(1).alias("name"), F.lit(kind).alias("kind"), signature.alias("signature")))

    return F.filter(F.array(*[F.coalesce(*[symbol(n, *rule) for rule in of]) for n, of in enumerate(rules)]), lambda x: x.isNotNull())


def symbols(files: DataFrame, rules: str | None = None) -> DataFrame:
    """(file_id, line_no, place, name, kind, signature) of files in languages but Python, or of all by one set of rules."""
    rows = lines(files)
    if rules:
        found = matches(RULES[rules], F.col("line"))
    else:
        rows = rows.where("lang <> 'python'")
        found = F.when(F.lit(False), F.array().cast("array<struct<place:int,name:string,kind:string,signature:string>>"))
        for name in (x for x in RULES if x != "generic"):
            found = found.when(F.col("lang") == name, matches(RULES[name], F.col("line")))
        found = found.otherwise(matches(RULES["generic"], F.col("line")))
    return rows.select("file_id", "line_no", F.inline(found))


def _docstring(following: Column) -> Column:
    """The docstring that the lines after a declaration begin with; null where there is none."""
    head = strip(F.get(following, F.lit(0)))
    mark, rest = F.substring(head, 1, 3), F.slice(following, 2, DOC_LINES - 1)
    at = F.array_position(F.transform(rest, lambda x: F.contains(x, mark)), True)
    inner = F.when(at > 0, F.concat(F.slice(rest, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), F.array(F.substring_index(F.get(rest, (at - 1).cast("int")), "\"\"\"", 1)))).otherwise(rest)
    single = F.when(at > 0, F.concat(F.slice(rest, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), F.array(F.substring_index(F.get(rest, (at - 1).cast("int")), "'''", 1)))).otherwise(rest)
    whole = F.array_join(F.concat(F.array(F.substring(head, F.lit(4), F.length(head))), F.when(mark == "'''", single).otherwise(inner)), "\n")
    short = F.endswith(head, mark) & (F.length(head) > 6)
    return F.when(mark.isin("'''", '"""'), strip(F.when(short, F.substring(head, F.lit(4), F.length(head) - 6)).otherwise(whole)))


def python_symbols(files: DataFrame) -> DataFrame:
    """(file_id, line_no, line_end, place, name, kind, signature, docstring, parent) of Python files.

    Classes begin in the first column and end before the next line that does; a def ends on its line. Indented defs are
    methods of the class above them, however far above (null where there is none). Docstrings of more than DOC_LINES
    lines are cut, as the line after the declaration and the 19 after that are read.
    """
    rows = lines(files).where("lang = 'python'")
    by_line = Window.partitionBy("file_id").orderBy("line_no")
    line = F.col("line")
    cls, name = F.regexp_extract(line, PYTHON_CLASS, 1), F.regexp_extract(line, PYTHON_DEF, 2)
    outer = F.when(line.rlike(r"^\S"), F.col("line_no"))
    rows = rows.select(
        "file_id", "line_no", cls.alias("c"), name.alias("f"), F.regexp_extract(line, PYTHON_DEF, 3).alias("args"), (F.regexp_extract(line, PYTHON_DEF, 1) != "").alias("indented"),
        F.last(F.when(cls != "", cls), ignorenulls=True).over(by_line).alias("above"), F.collect_list("line").over(by_line.rowsBetween(1, DOC_LINES)).alias("following"),
        F.coalesce(F.first(outer, ignorenulls=True).over(by_line.rowsBetween(1, Window.unboundedFollowing)) - 1, F.max("line_no").over(Window.partitionBy("file_id"))).alias("block_end"),
    ).where("c <> '' or f <> ''")
    is_class = F.col("c") != ""
    kind = F.when(is_class, "class").when(F.col("indented"), "method").otherwise("function")
    signature = F.when(is_class, F.concat(F.lit("class "), "c")).otherwise(F.concat(F.lit("def "), "f", F.lit("("), "args", F.lit(")")))
    return rows.select(
        "file_id", "line_no", F.when(is_class, F.col("block_end")).otherwise(F.col("line_no")).alias("line_end"), F.lit(0).alias("place"), F.when(is_class, F.col("c")).otherwise(F.col("f")).alias("name"),
        kind.alias("kind"), signature.alias("signature"), _docstring(F.col("following")).alias("docstring"), F.when(kind == "method", F.col("above")).alias("parent"),
    )


def all_symbols(files: DataFrame) -> DataFrame:
    """(file_id, line_no, place, name, kind, signature, docstring) of files in any language."""
    own = python_symbols(files).select("file_id", "line_no", "place", "name", "kind", "signature", "docstring")
    return own.unionByName(symbols(files).withColumn("docstring", F.lit(None).cast("string")))


def _listed(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("line_no", *columns))).alias("x"))


def summary(files: DataFrame, most_imports: int = 10, most_functions: int = 20) -> DataFrame:
    """(file_id, summary): name, language, first imports, all classes with their documentation, first functions.

    Lists that are cut end in their number of further entries; files that are too large have no row.
    """
    found = all_symbols(files)
    more = lambda x, most: F.when(F.size(x) > most, F.concat(F.lit("\n... and "), (F.size(x) - most).cast("string"), F.lit(" more"))).otherwise("")
    shown = lambda x, form, most: F.array_join(F.transform(F.slice(x, 1, most), form), "\n")
    doc = lambda y: F.when(F.length(y["docstring"]) > 0, F.concat(F.lit(": "), F.substring(y["docstring"], 1, 100), F.lit("..."))).otherwise("")
    imported = _listed(imports(files), "import").select("file_id", F.concat(F.lit("\n\n## Imports\n"), shown(F.col("x"), lambda y: F.concat(F.lit("- "), y["import"]), most_imports), more(F.col("x"), most_imports)).alias("i"))
    classes = _listed(found.where("kind = 'class'"), "place", "name", "docstring").select("file_id", F.concat(F.lit("\n\n## Classes\n"), shown(F.col("x"), lambda y: F.concat(F.lit("- `"), y["name"], F.lit("`"), doc(y)), 2**30)).alias("c"))
    functions = _listed(found.where("kind = 'function'"), "place", "signature").select("file_id", F.concat(F.lit("\n\n## Functions\n"), shown(F.col("x"), lambda y: F.concat(F.lit("- `"), y["signature"], F.lit("`")), most_functions), more(F.col("x"), most_functions)).alias("f"))
    joined = files_read(files).where("error is null").select("file_id", "path", "language")
    for part in (imported, classes, functions):
        joined = joined.join(part, "file_id", "left")
    head = F.concat(F.lit("# "), basename(F.col("path")), F.lit(" ("), "language", F.lit(")"))
    return joined.select("file_id", F.concat(head, *[F.coalesce(x, F.lit("")) for x in "icf"]).alias("summary"))


def searchable(files: DataFrame) -> DataFrame:
    """(file_id, searchable_text): path, language, symbols with their documentation, and the content."""
    form = lambda y: F.concat(y["kind"], F.lit(": "), y["signature"], F.when(F.length(y["docstring"]) > 0, F.concat(F.lit("\n  "), y["docstring"])).otherwise(""), F.lit("\n"))
    named = _listed(all_symbols(files), "place", "kind", "signature", "docstring").select("file_id", F.array_join(F.transform("x", form), "").alias("s"))
    rows = files.withColumn("content", _unix(F.col("content"))).where(F.octet_length("content") <= MOST_BYTES).join(named, "file_id", "left")
    return rows.select("file_id", F.concat(F.lit("File: "), "path", F.lit("\nLanguage: "), language(F.col("path")), F.lit("\n\n"), F.coalesce("s", F.lit("")), F.lit("\n"), "content").alias("searchable_text"))
