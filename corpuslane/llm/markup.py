"""Markup residue in texts: which of HTML, Markdown, wiki and LaTeX a text holds, and its clean form.

Chunks have no host and no page whose tree could be aligned with theirs, so the trees of a site cannot be induced
here; each text is parsed by the grammars of the four notations instead. Code blocks are set aside first: what they
show is kept as it is and counts for nothing.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("html", "markdown", "wiki", "latex")
#: Names of HTML elements (fixed values).
ELEMENTS = frozenset("""
a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center cite
code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset
h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noframes noscript
object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong
style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr
""".split())
_ATTRIBUTE = r"""\s+[\w:@.-]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?"""
TAG = re.compile(rf"<(/?)([A-Za-z][A-Za-z0-9]*)((?:{_ATTRIBUTE})*)\s*/?>")
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!(?:DOCTYPE|doctype)[^>]*>", re.S)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
INLINE_CODE = re.compile(r"(?<![`\w])`[^`\n]+`(?![`\w])")
FENCE = re.compile(r"^ {0,3}(?:```+|~~~+)[ \t]*([\w+#.-]*)[^\n`]*$", re.M)
#: Commands of LaTeX that stand without braces (fixed values).
_BARE = "item|it|bf|em|tt|sc|rm|sf|sl|itshape|bfseries|par|noindent|newline|newpage|clearpage|maketitle|tableofcontents|hline|centering|ldots|dots|cdot|cdots|times|leq|geq|neq|le|ge|approx|pm|infty|alpha|beta|gamma|delta|epsilon|theta|lambda|mu|pi|sigma|omega|sum|int|prod|lim|log|ln|exp|sin|cos|rightarrow|to|in|quad|qquad|left|right|partial|nabla|LaTeX|TeX"
LATEX = re.compile(rf"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{{|(?<![\w:\\/])\\(?:{_BARE})\b|(?<!\\)\\[\[\]()](?=[\s\S])|\$\$|\$(?=[^\s$])[^$\n]*(?:\\[a-zA-Z]+|[\^_=])[^$\n]*(?<=[^\s$])\$|\\(?:begin|end)\b")


def _any_of(*rules: tuple[str, str]):
    """A test for any of several patterns, each tried only on texts that hold one of its signs (parted by blanks)."""
    compiled = [(signs.split(" "), re.compile(pattern, re.M)) for signs, pattern in rules]

    def holds(text: str) -> bool:
        return any(any(s in text for s in signs) and pattern.search(text) for signs, pattern in compiled)

    return holds


is_markdown = _any_of(
    ("``` ~~~", r"^ {0,3}(?:```+|~~~+)"),
    ("**", r"\*\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*\*"),
    ("__", r"(?<![\w_])__(?=[^\s_])[^\n]+?(?<=[^\s_])__(?![\w_])"),
    ("~~", r"~~(?=[^\s~])[^~\n]+~~"),
    ("](", r"!?\[[^\]\[\n]+\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)"),
    ("][", r"(?<!\[)\[[^\]\[\n]+\]\[[^\]\[\n]*\](?!\])"),
    ("[^", r"\[\^[\w-]+\]"),
    ("]:", r"^\[[^\]\n]+\]: +\S"),
    ("---", r"^ *\|?(?: *:?-{3,}:? *\|)+ *(?::?-{3,}:?)? *$"),
    ("|", r"^\|.*[^|\s].*\|[ \t]*$"),
    ("[", r"^ *[-*+] \[[ xX]\] "),
    ("===", r"^[^\n=|*#>-][^\n]*\n={3,}[ \t]*$"),
    ("`", r"(?<![`\w])`[^`\n]+`(?![`\w])"),
    ("#", r"^#{1,6} [^\n]*[\w)][ \t]*$"),
    (">", r"^(?:> ?)+\S"),
    ("- +", r"^ *[-+] \S"),
    ("*", r"(?<![\w*])\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?![\w*])"),
    ("_", r"(?<![\w_])_(?=[^\s_])[^_\n]+(?<=[^\s_])_(?![\w_])"),
)
#: Lists that Markdown and wikis share; they count as Markdown where nothing else of a wiki is there.
is_shared_list = _any_of(("* #", r"^ *\* \S|^#{1,6} \S"), ("0 1 2 3 4 5 6 7 8 9", r"^ *\d+\. \S"))
is_wiki = _any_of(
    ("[[", r"\[\[[^\[\]\n]+\]\](?!\()"),
    ("{{", r"\{\{[^{}\n]+\}\}"),
    ("''", r"'{2,5}(?=[^\s'])[^\n]*?(?<=[^\s'])'{2,5}"),
    ("==", r"^(={2,6})[^=\n](?:[^\n]*[^=\n])?\1[ \t]*$"),
    ("{| |} |-", r"^\{\|.*$|^\|\}[ \t]*$|^\|-+[ \t]*$"),
    (";", r"^; ?\S[^\n]* : \S"),
    ("!! ||", r"^!.*!!|^\|[^\n]*[^|\n]\|\|[^|\n]"),
    ("** ##", r"^\*{2,} \S|^#{2,}[^# \n]"),
    ("<ref <nowiki <gallery TOC__", r"<(?:ref|nowiki|gallery)\b|__(?:NO)?TOC__"),
)
SPECIAL = r"[<>\\$*#\[\]{}`|~_&=!]|''|(?m)^ *(?:[-+]|\d+\.) |(?m)^; "


def code_blocks(text: str) -> list[tuple[int, int, int, int]]:
    """Code blocks as (start, inner start, inner end, end), also those of which the text holds only one end."""
    blocks = []
    fences = list(FENCE.finditer(text)) if "```" in text or "~~~" in text else []
    closing_first = False
    if fences:
        inside = False
        for f in fences:
            if inside and f[1]:
                closing_first = True
                break
            inside = not inside
        before = text[: fences[0].start()]
        if len(fences) % 2 and not fences[0][1] and before.strip() and not re.search(r"[^\W\d_][.!?…”\"]\s*$", before, re.M) and not is_markdown(before):
            closing_first = True
    k = 0
    if closing_first:
        blocks.append((0, 0, fences[0].start(), fences[0].end()))
        k = 1
    while k < len(fences):
        close = fences[k + 1] if k + 1 < len(fences) else None
        blocks.append((fences[k].start(), fences[k].end(), close.start() if close else len(text), close.end() if close else len(text)))
        k += 2
    for sign, opening, ending in (("pre", r"<pre\b[^>]*>(?:\s*<code\b[^>]*>)?", r"(?:</code>\s*)?</pre>"), ("\\", r"\\begin\{(?:verbatim|lstlisting|minted)\*?\}(?:\[[^\]\n]*\])?", r"\\end\{(?:verbatim|lstlisting|minted)\*?\}"), ("<", r"<(?:syntaxhighlight|source|nowiki)\b[^>]*>", r"</(?:syntaxhighlight|source|nowiki)>")):
        if sign not in text:
            continue
        marks = [m for m in re.finditer(f"(?P<o>{opening})|(?P<c>{ending})", text, re.I) if not any(b[1] <= m.start() < b[2] for b in blocks)]
        start = None
        for m in marks:
            if m["o"]:
                start = start or m
            elif start:
                blocks.append((start.start(), start.end(), m.start(), m.end()))
                start = None
            elif m is marks[0]:
                blocks.append((0, 0, m.start(), m.end()))
        if start:
            blocks.append((start.start(), start.end(), len(text), len(text)))
    return sorted(blocks)


def _blanked(text: str, blocks: list[tuple[int, int, int, int]]) -> str:
    """text with the insides of code blocks blanked out."""
    out, at = [], 0
    for _, low, high, _ in blocks:
        if low >= at:
            out += [text[at:low], re.sub(r"[^\n]", " ", text[low:high])]
            at = high
    return "".join(out) + text[at:]


def _is_html(text: str) -> bool:
    return "<!--" in text or "-->" in text and bool(re.search(r"\w -->", text)) or any(m[2].lower() in ELEMENTS for m in TAG.finditer(text)) or any(_known(m[0]) for m in ENTITY.finditer(text))


def _known(entity: str) -> bool:
    return entity[1] == "#" or entity[1:] in html5


def kinds(text: str | None) -> list[str]:
    """The kinds of markup that a text holds outside code blocks."""
    if not text:
        return []
    blocks = code_blocks(text)
    bare = _blanked(text, blocks) if blocks else text
    plain = INLINE_CODE.sub(" ", bare) if "`" in bare else bare
    wiki = is_wiki(plain)
    found = {
        "html": ("<" in plain or "&" in plain or "-->" in plain) and _is_html(plain),
        "markdown": is_markdown(bare) or not wiki and is_shared_list(bare),
        "wiki": wiki,
        "latex": ("\\" in plain or "$" in plain) and bool(LATEX.search(plain)),
    }
    return [k for k in KINDS if found[k]]


_HEADINGS = ("part", "chapter", "section", "subsection", "subsubsection", "paragraph")


def _latex_to_text(t: str) -> str:
    t = re.sub(r"(?<!\\)%[^\n]*", "", t)
    t = re.sub(rf"\\({'|'.join(_HEADINGS)})\*?\{{([^{{}}\n]*)\}}", lambda m: f"\n{'#' * max(1, _HEADINGS.index(m[1]) - 1)} {m[2]}\n", t)
    t = re.sub(r"\\item\s*(?:\[([^\]\n]*)\])?\s*", lambda m: f"- {m[1]} : " if m[1] else "- ", t)
    t = re.sub(r"\\\[\s*(.*?)\s*\\\]|\$\$\s*(.*?)\s*\$\$", lambda m: f"\n$$ {m[1] or m[2]} $$\n", t, flags=re.S)
    formulas: list[str] = []

    def keep(m: re.Match[str]) -> str:
        formulas.append(m[0])
        return f"\x02{len(formulas) - 1}\x03"

    t = re.sub(r"\$\$ .*? \$\$|\$(?=\S)[^$\n]*(?:\\[a-zA-Z]+|[\^_=])[^$\n]*\$|\\\(.*?\\\)", keep, t, flags=re.S)
    t = re.sub(r"\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?", "", t)
    t = re.sub(r"~?\\(?:cite|ref|label|pageref|eqref|footnote|index|bibliography|usepackage|documentclass)\w*\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}", "", t)
    for _ in range(3):
        t = re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"\{\\[a-zA-Z]+\s+([^{}]*)\}", r"\1", t)
    t = re.sub(rf"(?<![\w:\\/])\\(?:{_BARE})\b\s?", "", t)
    return re.sub("\x02(\\d+)\x03", lambda m: formulas[int(m[1])], t)


def _html_to_text(t: str) -> str:
    t = COMMENT.sub("", t)
    t = re.sub(r"<(script|style)\b[^>]*>.*?</\1>", "", t, flags=re.S | re.I)

    def tag(m: re.Match[str]) -> str:
        name, closing = m[2].lower(), bool(m[1])
        if name not in ELEMENTS:
            return m[0]
        if re.fullmatch(r"h[1-6]", name):
            return "\n" if closing else f"\n{'#' * int(name[1])} "
        if name == "li":
            return "" if closing else "\n- "
        if name in ("td", "th"):
            return "" if closing else "\t"
        return "\n" if name in ("p", "div", "br", "tr", "ul", "ol", "table", "blockquote", "section", "article", "dd", "dt", "pre", "hr") else ""

    return html.unescape(TAG.sub(tag, t))


def _wiki_to_text(t: str) -> str:
    t = re.sub(r"\[\[(?:Category|Kategorie|Catégorie|Categoría|File|Image|Datei|Fichier|Archivo):[^\[\]\n]*\]\]\n?", "", t, flags=re.I)
    t = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]", r"\1", t)
    t = re.sub(r"\{\{[^{}\n]*\}\}", "", t)
    t = re.sub(r"'{2,5}", "", t)
    t = re.sub(r"<ref\b[^>]*?(?:/>|>.*?</ref>)", "", t, flags=re.S)
    t = re.sub(r"^[*#:]+ ?(?=\S)", "- ", t, flags=re.M)
    t = re.sub(r"^(={2,6})\s*([^=\n](?:[^\n]*?[^=\s])?)\s*\1[ \t]*$", lambda m: f"{'#' * (len(m[1]) - 1)} {m[2]}", t, flags=re.M)
    t = re.sub(r"^(?:\{\|.*|\|\}|\|-+)[ \t]*\n?", "", t, flags=re.M)
    t = re.sub(r"^[|!] ?(.*)$", lambda m: re.sub(r"\s*(?:\|\||!!)\s*", "\t", m[1]), t, flags=re.M)
    return re.sub(r"^; ?([^\n]*?) : ", r"- \1: ", t, flags=re.M)


def _markdown_to_text(t: str) -> str:
    t = re.sub(r"^([^\n]+)\n={3,}[ \t]*$", r"# \1", t, flags=re.M)
    t = re.sub(r"!\[([^\]\n]*)\]\([^)\n]*\)", r"\1", t)
    t = re.sub(r"(?<!\[)\[([^\]\[\n]+)\](?:\([^()\s]+(?:\s+\"[^\"\n]*\")?\)|\[[^\]\[\n]*\])", r"\1", t)
    t = re.sub(r"^\[[^\]\n]+\]: .*\n?|\[\^[\w-]+\](?:: .*)?", "", t, flags=re.M)
    t = re.sub(r"^ *\|?(?: *:?-{3,}:? *\|)+ *(?::?-{3,}:?)? *\n?", "", t, flags=re.M)
    t = re.sub(r"^\|(.*)\|[ \t]*$", lambda m: "\t".join(x.strip() for x in m[1].split("|")), t, flags=re.M)
    t = re.sub(r"^( *)[-*+] (?:\[[ xX]\] )?", r"\1- ", t, flags=re.M)
    t = re.sub(r"^(?:> ?)+", "", t, flags=re.M)
    t = re.sub(r"\*\*(?=\S)([^*\n]+)\*\*|(?<![\w_])__(?=\S)([^_\n]+)__(?![\w_])|~~(?=\S)([^~\n]+)~~|`([^`\n]+)`", lambda m: m[1] or m[2] or m[3] or m[4], t)
    return re.sub(r"(?<![\w*])\*(?=[^\s*])([^*\n]+)(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])([^_\n]+)(?<=[^\s_])_(?![\w_])", lambda m: m[1] or m[2], t)


_CLEANERS = (("latex", _latex_to_text), ("wiki", _wiki_to_text), ("markdown", _markdown_to_text), ("html", _html_to_text))


def clean(text: str) -> str:
    """Clean text: headings as `#` lines, lists as `-` lines, code indented by four blanks, formulas between dollars."""
    found, blocks = set(kinds(text)), code_blocks(text)
    if not found and not blocks:
        return text
    out, at = [], 0
    for start, low, high, end in [*blocks, (len(text),) * 4]:
        if start < at:
            continue
        part = text[at:start]
        for kind, convert in _CLEANERS:
            if kind in found:
                part = convert(part)
        out.append(part)
        if end > start:
            code = html.unescape(text[low:high]) if text[start:low].startswith("<") else text[low:high]
            out.append("\n" + "\n".join("    " + x if x.strip() else "" for x in code.strip("\n").split("\n")) + "\n")
        at = end
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(out))).strip("\n")


def cleaned(table: DataFrame, row_id: str = "row_id", text: str = "text") -> DataFrame:
    """(row_id, markup, text): of every row the kinds of markup it holds (an array) and its clean text.

    Null texts stay null, with no kinds; texts without any special sign are passed by. Equal rows count each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, special = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [kinds(t) if s else [] for t, s in zip(texts, special)]
            fixed = [clean(t) if s and t else t for t, s in zip(texts, special)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string())), pa.array(fixed, pa.string())], ["row_id", "markup", "text"])

    kind = table.schema[row_id].dataType.simpleString()
    rows = table.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(SPECIAL), F.lit(False)).alias("special"))
    return rows.mapInArrow(run, f"row_id {kind}, markup array<string>, text string")


def marked(table: DataFrame, row_id: str = "row_id", text: str = "text") -> DataFrame:
    """(row_id, markup): a row per text and kind of markup that it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([kinds(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["row_id", "markup"])

    kind = table.schema[row_id].dataType.simpleString()
    rows = table.select(F.col(row_id).alias("row_id"), F.col(text).alias("text")).where(F.col("text").rlike(SPECIAL))
    return rows.mapInArrow(run, f"row_id {kind}, markup array<string>").select("row_id", F.explode("markup").alias("markup"))
