"""Functions and methods of source files, paired with their documentation.

Each file is lexed into code, comments and strings; declarations are read from the code alone and form a symbol table
of qualified names and normalised signatures over all files. A definition's own documentation comes first; one without
any takes that of a documented declaration (of an interface, a trait, an abstract class) with the same name and
signature in a type that its own type names as parent, wherever it is. Trivial documentation is then dropped.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTENSIONS = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "java": "java", "go": "go", "rs": "rust"}
_LINE, _BLOCK, _DOUBLE, _SINGLE = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)", r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?"
#: What is not code, per language; comments are those that begin with # (Python) or /.
LEXERS = {
    k: re.compile("|".join(v), re.S)
    for k, v in {
        "python": [r"#[^\n]*", r'"""(?:\\.|[^\\])*?(?:"""|\Z)', r"'''(?:\\.|[^\\])*?(?:'''|\Z)", _DOUBLE, _SINGLE],
        "javascript": [_LINE, _BLOCK, _DOUBLE, _SINGLE, r"`(?:\\.|[^`\\])*`?"],
        "java": [_LINE, _BLOCK, r'"""(?:\\.|[^\\])*?(?:"""|\Z)', _DOUBLE, _SINGLE],
        "go": [_LINE, _BLOCK, _DOUBLE, r"`[^`]*`?", r"'(?:\\.|[^'\\\n])+'"],
        "rust": [_LINE, _BLOCK, r'b?r(#*)".*?(?:"\1|\Z)', _DOUBLE, r"'(?:\\[^\n]{1,9}?|[^'\\\n])'"],
    }.items()
}
_NOT_NAMES = frozenset("if for while switch catch return new else throw do try with function typeof await yield delete void in of case super assert synchronized instanceof class interface enum record package import".split())
_PARENS = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
DECLARATIONS = {
    "python": [re.compile(r"^[ \t]*(?P<decl>(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*(?:\[[^\]]*\])?[ \t]*(?P<args>" + _PARENS + r")[^:\n]*(?:\[[^\]]*\][^:\n]*)*(?P<end>:))", re.M)],
    "go": [re.compile(r"^[ \t]*(?P<decl>func[ \t]*(?P<of>\([^()]*\))?[ \t]*(?P<name>\w+)[ \t]*(?:\[[^\]]*\])?(?P<args>" + _PARENS + r")[^{;\n]*(?P<end>\{)?)", re.M)],
    "rust": [re.compile(r"^[ \t]*(?P<decl>(?:(?:pub(?:\s*\([^)]*\))?|default|const|async|unsafe|extern(?:\s+\"[^\"]*\"|\s+ *)?)\s+)*fn\s+(?P<name>\w+)\s*(?:<[^({]*>)?\s*(?P<args>" + _PARENS + r")[^{;]*(?P<end>[{;]))", re.M)],
    "java": [re.compile(r"^[ \t]*(?:@[\w.]+(?:\([^()]*\))?[ \t]+)*(?P<decl>(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*(?:<[^>(]+>\s*)?(?P<type>[\w.]+(?:\s*<[^(){};=]*>)?(?:\s*\[\s*\])*\s+)?(?P<name>\w+)\s*(?P<args>" + _PARENS + r")\s*(?:throws\s+[\w., \n]+)?(?P<end>[{;]))", re.M)],
    "javascript": [
        re.compile(r"^[ \t]*(?P<decl>(?:export[ \t]+(?:default[ \t]+)?)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<name>[\w$]+)[ \t]*(?P<args>" + _PARENS + r")\s*(?P<end>\{))", re.M),
        re.compile(r"^[ \t]*(?P<decl>(?:export[ \t]+)?(?:(?:const|let|var|static|readonly)[ \t]+)*(?P<name>[\w$.#]+)\s*=\s*(?:async\s*)?(?:function\s*\*?\s*\w*\s*(?P<args>" + _PARENS + r")|(?P<args2>" + _PARENS + r"|\w+)\s*(?P<end>=>)))", re.M),
        re.compile(r"^[ \t]*(?P<decl>(?:(?:static|async|get|set)[ \t]+)*(?:\*[ \t]*)?(?P<name>#?[\w$]+)[ \t]*(?P<args>" + _PARENS + r")\s*(?P<end>\{))", re.M),
        re.compile(r"^[ \t]*(?P<decl>[\w$.]*(?P<name>[\w$]+)\s*:\s*(?:async\s*)?(?:function\s*\*?\s*\w*\s*(?P<args>" + _PARENS + r")|(?P<args2>" + _PARENS + r")\s*(?P<end>=>)))", re.M),
    ],
}
TYPES = {
    "python": re.compile(r"^([ \t]*)class[ \t]+(\w+)[ \t]*(?:\(([^()]*)\))?", re.M),
    "java": re.compile(r"^([ \t]*)(?:[\w]+\s+)*?(?:class|interface|enum|record)\s+(\w+)[^{;]*?(?:(?:extends|implements)\s+([^{]*))?\{", re.M),
    "javascript": re.compile(r"^([ \t]*)(?:export\s+(?:default\s+)?)?class\s+(\w+)\s*(?:extends\s+([\w.]+))?", re.M),
    "rust": re.compile(r"^([ \t]*)(?:pub\s+)?(?:unsafe\s+)?(?:impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?|trait\s+)(\w+)()", re.M),
    "go": re.compile(r"^([ \t]*)(?!)(\w)(\w)"),
}
_IMPL = re.compile(r"impl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s+(\w+)")
_BETWEEN = re.compile(r"(?:[ \t]*\n)?(?:[ \t]*(?:@[\w.]+(?:[ \t]*\((?:[^()]|\([^()]*\))*\))?|#!?\[[^\n]*\])[ \t]*\n?)*[ \t]*\Z")
TAG = re.compile(r"^\s*(?:[@\\]\w+|:\w+[^:]*:)")
SECTION = re.compile(r"^\s*(?:#+\s*)?(?:args|arguments|parameters|params|returns?|yields?|raises|throws|errors?|panics|examples?|safety|note|notes|see also|attributes)\s*:?\s*$|^\s*(?:args|arguments|parameters|returns?|raises|yields?)\s*:", re.I)
FILLER = frozenset("a an the this that these to for of in on and or is are be it its does do will can function functions method methods routine procedure helper helpers func def fn code implementation implements performs perform handles handle with from by which who used use uses call calls called here just".split())
PLACEHOLDER = re.compile(r"^\W*(?:todo|fixme|tbd|tba|xxx|wip)\b|\b(?:auto-?\s?generated|fill in the documentation|(?:missing|no|add|write|insert|needs?|without|lacks?) (?:a |an |some |the )?(?:proper |real )?(?:doc|docs|documentation|docstring|description|comment)\b|(?:documentation|description|docstring|comment)s? (?:goes|go) here|to be (?:documented|written|done|added|described)|(?:documentation|description) (?:is )?(?:missing|pending|to follow)|(?:documentation|description|docs) (?:will|is to|should|shall|must) (?:follow|be (?:added|written|provided))|placeholder (?:text|comment|documentation|docstring|for)|lorem ipsum|undocumented)", re.I)


def mask(source: str, language: str) -> tuple[str, list[tuple[int, int]]]:
    """source with comments and strings blanked out (line ends stay), and where these are."""
    out, spans, at = [], [], 0
    for m in LEXERS[language].finditer(source):
        if m.end() > m.start():
            out.append(source[at : m.start()])
            out.append(re.sub(r"[^\n]", " ", m[0]))
            spans.append(m.span())
            at = m.end()
    return "".join(out) + source[at:], spans


def _split_name(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-zß-ÿ]+|\d+|[^\W\d_]+", name)]


def _same(word: str, name_word: str) -> bool:
    return word == name_word or len(name_word) > 2 and word.startswith(name_word[:-1]) and len(word) - len(name_word) <= 3 and word[len(name_word) - 1 :] in {name_word[-1] + x for x in ("", "s", "es", "d", "ed", "r", "er", "ing")} | {"ies", "ing", "ied", "ed"} | {name_word[-1] * 2 + x for x in ("ed", "ing", "er")}


def description(documentation: str) -> str:
    """Documentation without tags, sections of parameters and results, examples and code marks."""
    out, inside, indent = [], False, 0
    for line in documentation.replace("\r", "").split("\n"):
        text = line.strip()
        if TAG.match(line):
            inside, indent = True, len(line) - len(line.lstrip())
            continue
        if SECTION.match(line):
            inside, indent = True, len(line) - len(line.lstrip())
            continue
        if not text:
            inside = False
            continue
        if inside and (len(line) - len(line.lstrip()) > indent or text[0] in "*-•"):
            continue
        if text.startswith((">>>", "...")) and len(text) > 3:
            inside = True
            continue
        if inside and out:
            continue
        inside = False
        out.append(text)
    return "\n".join(out)


def trivial(documentation: str, name: str) -> bool:
    """Whether documentation has fewer than four words, says only its function's name, or is a placeholder."""
    text = description(documentation)
    words = re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", text)
    if len(words) < 4 or PLACEHOLDER.search(text):
        return True
    named = _split_name(name)
    parts = [p for w in re.findall(r"\w+", text) for p in ([w.lower()] if w.lower() in FILLER else _split_name(w))]
    return all(p in FILLER or any(_same(p, n) for n in named) for p in parts)


def _uncomment(comment: str) -> str:
    body = re.sub(r"^/\*\*+|\*+/$", "", comment)
    return "\n".join(re.sub(r"^[ \t]*\*? ?", "", x) for x in body.split("\n"))


def _docstring(source: str, spans: list[tuple[int, int]], end: int) -> str | None:
    for low, high in spans[bisect_right(spans, (end, -1)) :]:
        between = source[end:low]
        if between.strip(" \t\r\n"):
            m = re.fullmatch(r"\s*([rRuU]{1,2})", between)
            if not m:
                return None
        if source[low] == "#":
            end = high
            continue
        try:
            return str(ast.literal_eval(source[low:high]))
        except (SyntaxError, ValueError):
            return source[low:high].strip("\"'")
    return None


def _comment_above(source: str, spans: list[tuple[int, int]], at: int, language: str) -> str | None:
    k = bisect_right(spans, (at, -1)) - 1
    lines: list[str] = []
    while k >= 0:
        low, high = spans[k]
        own_line = not source[source.rfind("\n", 0, low) + 1 : low].strip()
        ok = (_BETWEEN.match(source[high:at]) if not lines else source[high:at].count("\n") == 1 and not source[high:at].strip()) and own_line
        text = source[low:high]
        if not ok:
            break
        if language in ("java", "javascript"):
            return _uncomment(text) if text.startswith("/**") and len(text) > 4 else None
        if language == "rust" and text.startswith("///") and not text.startswith("////") or language == "go" and text.startswith("//") and not text.startswith("//go:"):
            lines.append(text.lstrip("/").removeprefix(" ").rstrip("\r"))
            at, k = low, k - 1
            continue
        break
    return "\n".join(reversed(lines)) if lines else None


def _signature(args: str, language: str) -> str:
    """Parameter types (or their number, where types are not written) without names and blanks."""
    inner, depth, parts = args.strip()[1:-1] if args.startswith("(") else args, 0, [""]
    for c in inner:
        depth += c in "([{<"
        depth -= c in ")]}>"
        if c == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    parts = [" ".join(p.split()) for p in parts if p.strip()]
    if language == "java":
        return ",".join(re.sub(r"\s+|final ", "", p.rpartition(" ")[0]) for p in parts)
    if language == "rust":
        return ",".join(p.partition(":")[2].replace(" ", "") or p.replace(" ", "") for p in parts)
    return str(len([p for p in parts if p not in ("self", "cls", "*", "/")]))


def _is_stub(code: str, at: int, indent: int) -> bool:
    """Whether a Python body from `at` on (comments and strings blanked) says no more than that it is to be written."""
    low, first = at, True
    said = []
    while low <= len(code) and len(said) < 2:
        high = code.find("\n", low)
        high = len(code) if high < 0 else high
        line = code[low:high]
        if line.strip():
            if not first and len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip()) <= indent:
                break
            said.append(line.strip())
        low, first = high + 1, False
    return not said or len(said) == 1 and (said[0] in ("...", "pass") or said[0].startswith("raise NotImplementedError"))


def functions(source: str, language: str) -> Iterator[tuple]:
    """(name, parent, parents, signature, line_start, has_body, declaration, documentation) of each function."""
    source = source.replace("\r\n", "\n")  # lines keep their numbers
    code, spans = mask(source, language)
    line_starts = [0, *(m.end() for m in re.finditer("\n", source))]
    types = [(m.start(), len(m[1].expandtabs(4)), m[2], m[0], m[3] or "") for m in TYPES[language].finditer(code)]
    seen = set()
    for pattern in DECLARATIONS[language]:
        for m in pattern.finditer(code):
            name, at = m["name"], m.start("decl")
            if name in _NOT_NAMES or at in seen or language == "java" and ((m["type"] or "").split(" ")[0].strip() in _NOT_NAMES | {""} and not re.match(r"(?:public|private|protected)\b", m["decl"]) or m["end"] == ";" and not m["type"]):
                continue
            seen.add(at)
            indent = len(code[code.rfind("\n", 0, at) + 1 : at].expandtabs(4))
            around = [t for t in types if t[0] < at and t[1] < indent]
            parent, parents = (around[-1][2], [x.strip() for x in re.split(r"[,<>]|\bimplements\b", around[-1][4]) if x.strip()]) if around else ("", [])
            if around and (x := _IMPL.search(around[-1][3])):
                parent, parents = x[2], [x[1]]
            if language == "go" and m["of"]:
                parent = re.sub(r"[^\w ]", "", m["of"]).split(" ")[-1]
            args = m["args"] or m.groupdict().get("args2") or ""
            documentation = _docstring(source, spans, m.end("end")) if language == "python" else _comment_above(source, spans, at, language)
            yield name, parent, parents, _signature(args, language), bisect_right(line_starts, at), not _is_stub(code, m.end("end"), indent) if language == "python" else m["end"] != ";", " ".join(source[at : m.end("decl")].rstrip("{;:").split()), documentation


def symbols(files: DataFrame) -> DataFrame:
    """The symbol table: a row per function or method of files (file_id, path, language, content).

    A null or unknown language is told by the path's extension; files of other languages, and null contents, give no
    rows. Vendored copies and repeated rows count each.
    """
    names = ["file_id", "language", "name", "parent", "parents", "signature", "line_start", "has_body", "declaration", "documentation", "trivial"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file_id, path, language, content in zip(*(c.to_pylist() for c in batch.columns)):
                language = (language or "").strip().lower()
                language = language if language in LEXERS else EXTENSIONS.get((path or "").rpartition(".")[2].lower())
                if content and language:
                    out += [(file_id, language, *f, None if f[-1] is None else trivial(f[-1], f[0])) for f in functions(content, language)]
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    schema = "file_id bigint, language string, name string, parent string, parents array<string>, signature string, line_start int, has_body boolean, declaration string, documentation string, trivial boolean"
    return files.select(F.col("file_id").cast("bigint"), "path", "language", "content").mapInArrow(run, schema)


def documented(files: DataFrame) -> DataFrame:
    """(file_id, line_start, language, name, parent, declaration, documentation, source): pairs of code and description.

    source is `own` for documentation at the function itself and `declared` where it comes from a declaration of the
    same name and signature in a type that the function's type names as parent. Missing and trivial ones are dropped.
    """
    table = symbols(files)
    kept = ["file_id", "line_start", "language", "name", "parent", "declaration"]
    own = table.where("not trivial").select(*kept, "documentation", F.lit("own").alias("source"))
    declared = table.where("not has_body and not trivial").groupBy("language", F.col("parent").alias("above"), "name", "signature").agg(F.min_by("documentation", F.struct("file_id", "line_start")).alias("documentation"))
    bare = table.where("has_body and documentation is null").select(*kept, "signature", F.explode("parents").alias("above"))
    taken = bare.join(declared, ["language", "above", "name", "signature"]).groupBy(*kept).agg(F.min("documentation").alias("documentation"))
    return own.unionByName(taken.select(*kept, "documentation", F.lit("declared").alias("source")))
