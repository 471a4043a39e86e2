"""SQL of the core's results in DuckDB's dialect, built from small pieces.

Regular expressions there know no look-behind and no Java classes; every piece says the same as the Spark expression
of the same name by other means.
"""

from __future__ import annotations

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
_TAGS = {"core": "p|div|br|h[1-6]|li|tr", "web": "p|div|br|h[1-6]|li|tr|section|article"}
_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(value: str, pattern: str, new: str) -> str:
    return f"regexp_replace({value}, {q(pattern)}, {q(new)}, 'g')"


def strip(value: str) -> str:
    return rx(value, rf"^{SPACE}+|{SPACE}+\z", "")


def _line_ends(value: str) -> str:
    return rx(rx(f"coalesce({value}, '')", r"\r\n?", "\n"), r"[\x00-\x08\x0b-\x1f\x7f-\x{9f}]", "")


def normalize(value: str) -> str:
    return strip(rx(rx(f"replace({_line_ends(value)}, chr(9), '    ')", " +", " "), r"\n{3,}", "\n\n"))


def normalize_kit(value: str) -> str:
    return strip(_line_ends(value))


def sentences(value: str) -> str:
    parts = f"string_split({rx(value, r'([.!?])[ \t\n\x0b\f\r]+', r'\1' + chr(1))}, chr(1))"
    return f"list_filter(list_transform({parts}, lambda x: {strip('x')}), lambda x: x <> '')"


def tokens(value: str) -> str:
    return f"regexp_extract_all(lower(coalesce({value}, '')), {q(r'[\pL\pN_\-]+')})"


def word_count(value: str) -> str:
    t = strip(f"coalesce({value}, '')")
    return f"(CASE WHEN {t} = '' THEN 0 ELSE len(regexp_extract_all({t}, {q('[^' + SPACE[1:-1] + ']+')})) END)::BIGINT"


def authority(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '')"


def excerpt(value: str, n: int = 500) -> str:
    head = f"substring({value}, 1, {n})"
    stop = f"(length({head}) - strpos(reverse({head}), '.') + 1)"
    return f"CASE WHEN length({value}) <= {n} THEN {value} WHEN strpos({head}, '.') > 0 AND {stop} - 1 > {n // 2} THEN substring({head}, 1, {stop}) ELSE {head} || '...' END"


HIGHLIGHT = f"""
WITH query AS (SELECT arg_min(query, item_id) AS query FROM eval_items),
w AS (SELECT term, min(n) AS n FROM (SELECT unnest({tokens('query')}) AS term, generate_subscripts({tokens('query')}, 1) AS n FROM query) GROUP BY term),
scored AS (SELECT doc_id, n, pos, (SELECT count(*) FROM w AS v WHERE contains(win, v.term)) AS score FROM
    (SELECT doc_id, n, pos, substring(low, greatest(pos - 101, 0) + 1, pos + 99 - greatest(pos - 101, 0)) AS win FROM (SELECT doc_id, n, lower(text) AS low, strpos(lower(text), term) AS pos FROM documents, w) WHERE pos > 0)),
best AS (SELECT doc_id, pos - 1 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n) AS r FROM scored WHERE score > 0) WHERE r = 1),
p AS (SELECT doc_id, text, greatest(coalesce(pos, 0) - 50, 0) AS s FROM documents LEFT JOIN best USING (doc_id)),
e AS (SELECT *, least(length(text), s + 300) AS e, strpos(substring(text, s + 1, 20), ' ') AS ahead FROM p),
b AS (SELECT *, CASE WHEN s > 0 AND ahead > 0 THEN s + ahead ELSE s END AS b, strpos(reverse(substring(text, e - 19, 20)), ' ') AS back FROM e),
z AS (SELECT *, CASE WHEN e < length(text) AND back > 0 THEN e - back ELSE e END AS z FROM b)
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '' ELSE (CASE WHEN b > 0 THEN '...' ELSE '' END) || {strip('substring(text, b + 1, greatest(z - b, 0))')} || (CASE WHEN z < length(text) THEN '...' ELSE '' END) END AS value FROM z
"""


def _to_text(html: str, dropped: str, comments: bool, breaks: str, entities: list[tuple[str, str]]) -> str:
    t = f"coalesce({html}, '')"
    for tag in dropped.split():
        t = rx(t, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    if comments:
        t = rx(t, r"(?s)<!--.*?-->", "")
    t = rx(rx(t, rf"(?i)<(?:{_TAGS[breaks]})[^>]*>", "\n"), r"<[^>]+>", " ")
    for old, new in entities:
        t = f"replace({t}, {q(old)}, {q(new)})"
    return rx(t, " +", " ")


def extract_html(html: str) -> str:
    return strip(rx(_to_text(html, "script style", True, "core", _ENTITIES), r"\n[\s\x0b]*\n", "\n\n"))


def email_html(html: str) -> str:
    return strip(rx(_to_text(html, "script style", False, "core", _ENTITIES), r"\n[\s\x0b]*\n", "\n\n"))


def web_clean(html: str) -> str:
    return strip(rx(rx(_to_text(html, "script style noscript", True, "web", [*_ENTITIES, ("&#39;", "'"), ("&apos;", "'")]), r"\n[\s\x0b]*\n", "\n\n"), r"\n{3,}", "\n\n"))


def html_title(html: str) -> str:
    return strip(rx(f"regexp_extract(coalesce({html}, ''), '(?is)<title[^>]*>(.*?)</title>', 1)", r"<[^>]+>", ""))


def web_title(html: str) -> str:
    h = f"coalesce({html}, '')"
    title, h1 = "(?is)<title[^>]*>(.*?)</title>", "(?is)<h1[^>]*>(.*?)</h1>"
    return web_clean(f"CASE WHEN regexp_matches({h}, '{title}') THEN regexp_extract({h}, '{title}', 1) ELSE regexp_extract({h}, '{h1}', 1) END")


def meta(name: str, attribute: str = "name") -> str:
    pattern = rf"""(?i)<meta\s+[^>]*(?:{attribute})=["'](?:{name})["'][^>]*content=["']([^"']*)["']"""
    return f"nullif(trim(regexp_extract(coalesce(html, ''), {q(pattern)}, 1), ' ' || chr(9) || chr(10) || chr(13)), '')"


def meta_rows() -> list[tuple[int, str]]:
    """Pages with metadata that the test tables lack."""
    return [
        (-1, '<meta name="description" content="A page"><meta name="author" content="An author">'),
        (-2, '<META property="og:description" content="Shared"><meta property="og:image" content="/i.png">'),
        (-3, '<meta content="first" name="description"><meta name="keywords" content="">'),
        (-4, '<meta property="author" content="No author"><meta name="og:image" content="no.png"><meta property="keywords" content="none">'),
        (-5, '<meta property="description" content=" Blanks around "><meta name="og:description" content="second">'),
    ]


META_ROWS = ", ".join(f"({k}, {q(h)})" for k, h in meta_rows())


def links(attribute: str, element: str, ends: str, bad: str, out: str = "links") -> str:
    opening = r"""["']"""
    pattern = rf"(?i)<{element}\s+[^>]*{attribute}={opening}([^{ends}]+){opening}"
    root = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1)"
    folder = "regexp_extract(regexp_extract(url, '^[^?#]*', 0), '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/]*/(?:.*/)?)', 1)"
    absolute = f"CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN x WHEN starts_with(x, '//') THEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*:', 0) || x WHEN starts_with(x, '/') THEN {root} || x ELSE coalesce(nullif({folder}, ''), {root} || '/') || x END"
    return f"SELECT url_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(coalesce(html, ''), {q(pattern)}, 1), lambda x: NOT regexp_matches(x, {q(bad)})), lambda x: {absolute}))), ' ') AS {out} FROM url_contents"


BM25_BASE = f"""tok AS (SELECT doc_id, {tokens('text')} AS t FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(t) AS term, len(t)::BIGINT AS dl FROM tok) GROUP BY doc_id, term),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM postings, corpus GROUP BY term),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def bm25(where: str, k: int, source: str = "(SELECT item_id AS qid, item_id, query FROM eval_items)", before: str = "") -> str:
    return f"""WITH {before}{BM25_BASE},
asked AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({tokens('query')}) AS term FROM {source} {where}) GROUP BY qid, term),
s AS (SELECT qid, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN terms USING (term) JOIN postings USING (term), corpus GROUP BY qid, doc_id)
SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {k}"""


def vector(where: str, k: int, threshold: float | None) -> str:
    score = "round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)"
    limit = f"WHERE score >= {threshold}" if threshold is not None else ""
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS qid, v.vec_id, {score} AS score FROM embeddings q, embeddings v WHERE {where}) {limit}) WHERE rank <= {k}"


_NORM = "(SELECT qid, doc_id, score, rank, CASE WHEN max(score) OVER (PARTITION BY qid) = min(score) OVER (PARTITION BY qid) THEN 0 ELSE (score - min(score) OVER (PARTITION BY qid)) / (max(score) OVER (PARTITION BY qid) - min(score) OVER (PARTITION BY qid)) END AS norm FROM {0})"
HYBRID = f"""WITH lex AS ({bm25('', 20)}),
vec AS (SELECT qid, vec_id AS doc_id, score, rank FROM ({vector('q.vec_id IN (SELECT item_id FROM eval_items)', 10, 0.5)})),
b AS {_NORM.format('lex')}, v AS {_NORM.format('vec')},
m AS (SELECT coalesce(b.qid, v.qid) AS qid, coalesce(b.doc_id, v.doc_id) AS doc_id, b.norm AS b, v.norm AS v, b.score AS raw, b.rank AS br, v.rank AS vr FROM b FULL JOIN v ON b.qid = v.qid AND b.doc_id = v.doc_id),
s AS (SELECT *, round(CASE WHEN qid IN (SELECT qid FROM vec) THEN 0.5 * coalesce(b, 0) + 0.5 * coalesce(v, 0) ELSE raw END, 6) AS score FROM m)
SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, br IS NULL, br NULLS FIRST, vr NULLS FIRST, doc_id) AS rank FROM s) WHERE rank <= 10"""
ENSEMBLE = f"""WITH lex AS ({bm25('', 10)}), len AS (SELECT qid, doc_id, coalesce(length(text), 0)::DOUBLE AS score, rank FROM lex JOIN documents USING (doc_id)),
b AS {_NORM.format('lex')}, l AS {_NORM.format('len')},
s AS (SELECT qid, doc_id, round(sum(part), 6) AS score FROM (SELECT qid, doc_id, norm * 2.0 / 3.0 AS part FROM b UNION ALL SELECT qid, doc_id, norm / 3.0 FROM l) GROUP BY qid, doc_id)
SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s"""

_NONE = "I couldn''t find any relevant information in the indexed documents for your question."
_CITED = "WITH hits AS ({0}), cited AS (SELECT qid, doc_id, rank, score, filename AS path, text FROM hits JOIN documents USING (doc_id))"
_BASE = "regexp_extract(path, '[^/]*$', 0)"
CITATIONS = f"""WITH hits AS ({bm25('', 10)}),
c AS (SELECT qid, doc_id, rank, score, filename AS path, text, query FROM hits JOIN documents USING (doc_id) JOIN eval_items ON qid = item_id),
w AS (SELECT qid, term, min(n) AS n FROM (SELECT item_id AS qid, unnest({tokens('query')}) AS term, generate_subscripts({tokens('query')}, 1) AS n FROM eval_items) GROUP BY qid, term),
a AS (SELECT qid, doc_id, n, strpos(lower(text), term) AS pos, lower(text) AS low FROM c JOIN w USING (qid)),
win AS (SELECT qid, doc_id, n, pos, substring(low, greatest(pos - 101, 0) + 1, pos + 99 - greatest(pos - 101, 0)) AS win FROM a WHERE pos > 0),
scored AS (SELECT win.qid, doc_id, win.n, pos, count(*) FILTER (WHERE contains(win, w.term)) AS score FROM win JOIN w ON w.qid = win.qid GROUP BY ALL),
best AS (SELECT qid, doc_id, pos - 1 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, n) AS r FROM scored WHERE score > 0) WHERE r = 1),
p AS (SELECT c.*, greatest(coalesce(pos, 0) - 50, 0) AS s FROM c LEFT JOIN best USING (qid, doc_id)),
e AS (SELECT *, least(length(text), s + 300) AS e, strpos(substring(text, s + 1, 20), ' ') AS ahead FROM p),
b AS (SELECT *, CASE WHEN s > 0 AND ahead > 0 THEN s + ahead ELSE s END AS b, strpos(reverse(substring(text, e - 19, 20)), ' ') AS back FROM e),
z AS (SELECT *, CASE WHEN e < length(text) AND back > 0 THEN e - back ELSE e END AS z FROM b)
SELECT qid, doc_id, rank, score, path, (CASE WHEN b > 0 THEN '...' ELSE '' END) || {strip('substring(text, b + 1, greatest(z - b, 0))')} || (CASE WHEN z < length(text) THEN '...' ELSE '' END) AS highlight FROM z"""
FORMAT_CONTEXT = _CITED.format(bm25("", 3)) + f" SELECT qid, string_agg('[Source: ' || {_BASE} || ', Chunk #0]' || chr(10) || text || chr(10), chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM cited GROUP BY qid"
PROMPT_CONTEXT = _CITED.format(bm25("", 5)) + " SELECT qid, string_agg('[' || rank || '] ' || substring(text, 1, 500), chr(10) ORDER BY rank) AS context FROM cited GROUP BY qid"
_ANSWER = f"""string_agg('**[' || rank || '] From: ' || {_BASE} || '** (relevance: ' || round(score, 2)::DECIMAL(18, 2)::VARCHAR || ')' || chr(10) || '> ' || {excerpt('text')}, chr(10) ORDER BY rank)"""
_AROUND = "'Based on your indexed documents, here are the most relevant excerpts:' || chr(10) || chr(10) || {0} || chr(10) || chr(10) || '---' || chr(10) || '*This is an extractive answer based on BM25 retrieval.*'"
EXTRACTIVE = _CITED.format(bm25("", 3)) + f", a AS (SELECT qid, {_AROUND.format(_ANSWER)} AS a FROM cited GROUP BY qid) SELECT item_id AS qid, coalesce(a, '{_NONE}') AS answer FROM eval_items LEFT JOIN a ON qid = item_id"
ASK = f"SELECT qid, answer, 'extractive' AS method FROM ({EXTRACTIVE})"

_RUNS = f"""hits AS ({vector('q.vec_id % 100 = 0', 20, None)}),
flags AS (SELECT hits.qid, rank, (v.label = o.label)::INT AS hit, (SELECT count(*) FROM embeddings x WHERE x.label = o.label) AS total FROM hits JOIN embeddings v ON v.vec_id = hits.vec_id JOIN embeddings o ON o.vec_id = hits.qid),
ks AS (SELECT unnest([1, 3, 5, 10, 20]) AS k)"""
_METRICS = {
    "recall": "sum(hit)::DOUBLE / any_value(total)",
    "precision": "sum(hit)::DOUBLE / count(*)",
    "dcg": "sum(hit / log2(rank + 1))",
    "ndcg": "sum(hit / log2(rank + 1)) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(any_value(total), k) + 1) t(i))",
    "hit_rate": "max(hit)::DOUBLE",
}


def metric(name: str) -> str:
    if name == "mrr":
        return f"WITH {_RUNS} SELECT qid, 0 AS k, round(coalesce(max(hit::DOUBLE / rank), 0), 6) AS value FROM flags GROUP BY qid"
    return f"WITH {_RUNS} SELECT qid, k, round({_METRICS[name]}, 6) AS value FROM flags, ks WHERE rank <= k GROUP BY qid, k"


EVAL_SINGLE = f"WITH {_RUNS} " + " UNION ALL ".join([f"SELECT qid, '{m}' AS metric, k, round({e}, 6) AS value FROM flags, ks WHERE rank <= k GROUP BY qid, k" for m, e in _METRICS.items()] + ["SELECT qid, 'mrr' AS metric, 0 AS k, round(coalesce(max(hit::DOUBLE / rank), 0), 6) AS value FROM flags GROUP BY qid"])

TURNS = "WITH turns AS (SELECT from_address AS conv_id, row_number() OVER (PARTITION BY from_address ORDER BY email_id) AS turn, CASE WHEN row_number() OVER (PARTITION BY from_address ORDER BY email_id) % 2 = 1 THEN 'user' ELSE 'assistant' END AS role, coalesce(subject, '') AS text FROM parsed_emails WHERE from_address IS NOT NULL)"


# Source files. Nothing here is taken from the operators: languages, patterns and forms are written out again.
_BY_EXTENSION = """('py','python'),('pyi','python'),('js','javascript'),('jsx','javascript'),('ts','typescript'),('tsx','typescript'),('go','go'),('rs','rust'),('java','java'),('c','c'),('h','c'),('cpp','cpp'),('hpp','cpp'),('cc','cpp'),('cxx','cpp'),
('rb','ruby'),('php','php'),('swift','swift'),('kt','kotlin'),('scala','scala'),('r','r'),('sql','sql'),('sh','shell'),('bash','shell'),('zsh','shell'),('yaml','yaml'),('yml','yaml'),('json','json'),('md','markdown'),('html','html'),('css','css'),('scss','scss')"""
CODE = f"""langs(e, l) AS (VALUES {_BY_EXTENSION}),
code AS (SELECT file_id, path, coalesce(l, 'unknown') AS lang, {rx("coalesce(content, '')", chr(13) + chr(10) + '?', chr(10))} AS content FROM code_files LEFT JOIN langs ON e = lower(regexp_extract(path, '[^./]\\.([^./]+)$', 1))),
lists AS (SELECT file_id, path, lang, string_split(content, chr(10)) AS l, content FROM code WHERE strlen(content) <= 1048576),
lines AS (SELECT file_id, lang, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM lists)"""
CODE_LANGUAGE = f"WITH {CODE} SELECT file_id, lang FROM code"
CODE_FILE = f"WITH {CODE} SELECT file_id, path, lang AS language, CASE WHEN strlen(content) <= 1048576 THEN length(content) - length(replace(content, chr(10), '')) + 1 END::BIGINT AS lines, strlen(content)::BIGINT AS size_bytes, CASE WHEN strlen(content) > 1048576 THEN 'File too large: ' || strlen(content) || ' bytes' END AS error FROM code"
_IMPORTS = """st AS (SELECT file_id, lang, line_no, trim(line, ' ' || chr(9)) AS t FROM lines),
g AS (SELECT *, coalesce((SELECT arg_max(o.t <> ')', o.line_no) FROM st o WHERE o.file_id = st.file_id AND o.line_no < st.line_no AND (o.t = ')' OR starts_with(o.t, 'import ('))), false) AS inside FROM st WHERE lang = 'go'),
imported AS (SELECT file_id, line_no, CASE lang WHEN 'java' THEN rtrim(replace(t, 'import ', ''), ';') ELSE t END AS import FROM st
    WHERE (lang = 'python' AND (starts_with(t, 'import ') OR starts_with(t, 'from '))) OR (lang IN ('javascript', 'typescript') AND (starts_with(t, 'import ') OR starts_with(t, 'require('))) OR (lang = 'rust' AND starts_with(t, 'use ')) OR (lang = 'java' AND starts_with(t, 'import '))
    UNION ALL SELECT file_id, line_no, trim(CASE WHEN inside THEN t ELSE replace(t, 'import ', '') END, '"') FROM g WHERE NOT starts_with(t, 'import (') AND CASE WHEN inside THEN t NOT IN (')', '') ELSE starts_with(t, 'import ') END)"""
IMPORTS = f"WITH {CODE}, {_IMPORTS} SELECT file_id, line_no, import FROM imported"


def _first(*patterns: str) -> str:
    """Name and arguments by the first pattern that a line matches, as a list; null if none does."""
    return "CASE " + " ".join(f"WHEN regexp_matches(line, {q(p)}) THEN [regexp_extract(line, {q(p)}, 1), {'regexp_extract(line, ' + q(p) + ', 2)' if p.count('(') - p.count('(?') - 2 * p.count('[(') - p.count(chr(92) + '(') > 1 else chr(39) * 2}]" for p in patterns) + " END"


_FUNCTIONS = {
    "javascript": _first(r"function\s+(\w+)\s*\(([^)]*)\)", r"const\s+(\w+)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*=>", r"(\w+)\s*:\s*(?:async\s*)?function\s*\(([^)]*)\)"),
    "go": _first(r"func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(([^)]*)\)"),
    "rust": _first(r"fn\s+(\w+)(?:<[^>]+>)?\s*\(([^)]*)\)"),
    "java": _first(r"(?:public|private|protected)?\s*(?:static\s+)?(?:\w+(?:<[^>]+>)?)\s+(\w+)\s*\(([^)]*)\)"),
}
_TYPE = "regexp_extract(line, '{0}\\s+(\\w+)', 1)"
_PLAIN_SYMBOLS = {
    "javascript": f"SELECT file_id, line_no, 0 AS place, f[1] AS name, 'function' AS kind, f[1] || '(' || f[2] || ')' AS signature FROM (SELECT *, {_FUNCTIONS['javascript']} AS f FROM lines WHERE lang IN ('javascript', 'typescript')) WHERE f IS NOT NULL UNION ALL SELECT file_id, line_no, 1, c, 'class', 'class ' || c FROM (SELECT *, {_TYPE.format('class')} AS c FROM lines WHERE lang IN ('javascript', 'typescript')) WHERE c <> ''",
    "go": f"SELECT file_id, line_no, 0 AS place, f[1] AS name, 'function' AS kind, 'func ' || f[1] || '(' || f[2] || ')' AS signature FROM (SELECT *, {_FUNCTIONS['go']} AS f FROM lines WHERE lang = 'go') WHERE f IS NOT NULL UNION ALL SELECT file_id, line_no, 1, t, k, 'type ' || t || ' ' || k FROM (SELECT *, regexp_extract(line, 'type\\s+(\\w+)\\s+(?:struct|interface)', 1) AS t, regexp_extract(line, 'type\\s+\\w+\\s+(struct|interface)', 1) AS k FROM lines WHERE lang = 'go') WHERE t <> ''",
    "rust": f"SELECT file_id, line_no, 0 AS place, f[1] AS name, 'function' AS kind, 'fn ' || f[1] || '(' || f[2] || ')' AS signature FROM (SELECT *, {_FUNCTIONS['rust']} AS f FROM lines WHERE lang = 'rust') WHERE f IS NOT NULL UNION ALL SELECT file_id, line_no, 1, c, 'struct', 'struct ' || c FROM (SELECT *, {_TYPE.format('struct')} AS c FROM lines WHERE lang = 'rust') WHERE c <> ''",
    "java": f"SELECT file_id, line_no, 0 AS place, c AS name, 'class' AS kind, 'class ' || c AS signature FROM (SELECT *, {_TYPE.format('class')} AS c FROM lines WHERE lang = 'java') WHERE c <> '' UNION ALL SELECT file_id, line_no, 1, f[1], 'method', f[1] || '(' || f[2] || ')' FROM (SELECT *, {_FUNCTIONS['java']} AS f FROM lines WHERE lang = 'java') WHERE f IS NOT NULL",
}


def symbols(lang: str) -> str:
    return f"WITH {CODE} {_PLAIN_SYMBOLS[lang]}"


def generic(where: str = "true") -> str:
    name = "coalesce(nullif(regexp_extract(line, '(?:function|func|def|fn)\\s+(\\w+)', 1), ''), nullif(regexp_extract(line, 'class\\s+(\\w+)', 1), ''))"
    return f"SELECT file_id, line_no, 0 AS place, n AS name, 'symbol' AS kind, substring(trim(line, ' ' || chr(9)), 1, 80) AS signature FROM (SELECT *, {name} AS n FROM lines WHERE {where}) WHERE n IS NOT NULL"


GENERIC = f"WITH {CODE} {generic()}"
_PYTHON = """py AS (SELECT lists.file_id, n AS line_no, l[n] AS line, l FROM lists, unnest(range(1, len(l) + 1)) AS t(n) WHERE lang = 'python' AND regexp_matches(l[n], '^(?:class|\\s*def)\\s')),
pn AS (SELECT *, regexp_extract(line, '^class\\s+(\\w+)(?:\\([^)]*\\))?\\s*:', 1) AS c, regexp_extract(line, '^\\s*def\\s+(\\w+)\\s*\\([^)]*\\)(?:\\s*->\\s*[^:]+)?\\s*:', 1) AS f, regexp_extract(line, '^\\s*def\\s+\\w+\\s*\\(([^)]*)\\)', 1) AS args FROM py),
ps AS (SELECT *, trim(coalesce(l[line_no + 1], ''), ' ' || chr(9)) AS head, list_transform(range(line_no + 2, least(line_no + 20, len(l)) + 1), lambda i: l[i]) AS rest FROM pn WHERE c <> '' OR f <> ''),
pd AS (SELECT *, substring(head, 1, 3) AS mark, coalesce(list_position(list_transform(rest, lambda x: contains(x, substring(head, 1, 3))), true), 0) AS stop FROM ps),
pt AS (SELECT *, CASE WHEN mark NOT IN ('\"\"\"', repeat(chr(39), 3)) THEN NULL WHEN length(head) > 6 AND ends_with(head, mark) THEN substring(head, 4, length(head) - 6)
    ELSE array_to_string([substring(head, 4)] || CASE WHEN stop = 0 THEN rest ELSE rest[1:stop - 1] || [string_split(rest[stop], mark)[1]] END, chr(10)) END AS doc FROM pd),
python AS (SELECT file_id, line_no, coalesce(CASE WHEN c <> '' THEN coalesce((SELECT min(i) - 1 FROM unnest(range(line_no + 1, len(l) + 1)) AS u(i) WHERE regexp_matches(l[i], '^\\S')), len(l)) END, line_no)::BIGINT AS line_end, 0 AS place,
    CASE WHEN c <> '' THEN c ELSE f END AS name, CASE WHEN c <> '' THEN 'class' WHEN starts_with(line, ' ') OR starts_with(line, chr(9)) THEN 'method' ELSE 'function' END AS kind,
    CASE WHEN c <> '' THEN 'class ' || c ELSE 'def ' || f || '(' || args || ')' END AS signature, regexp_replace(doc, '^\\s+|\\s+$', '', 'g') AS docstring,
    CASE WHEN c = '' AND regexp_matches(line, '^\\s') THEN (SELECT arg_max(o.c, o.line_no) FROM pn o WHERE o.file_id = pt.file_id AND o.line_no < pt.line_no AND o.c <> '') END AS parent FROM pt)"""
PYTHON = f"WITH {CODE}, {_PYTHON} SELECT file_id, line_no, line_end, name, kind, signature, docstring, parent FROM python"
_EVERY = f"""every AS (SELECT file_id, line_no, place, name, kind, signature, docstring FROM python UNION ALL SELECT *, NULL FROM ({" UNION ALL ".join(f"({x})" for x in _PLAIN_SYMBOLS.values())} UNION ALL ({generic("lang NOT IN ('python', 'javascript', 'typescript', 'go', 'rust', 'java')")})))"""
SUMMARY = f"""WITH {CODE}, {_IMPORTS}, {_PYTHON}, {_EVERY},
ri AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no, import) AS r, count(*) OVER (PARTITION BY file_id) AS n FROM imported),
rf AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no, place) AS r, count(*) OVER (PARTITION BY file_id) AS n FROM every WHERE kind = 'function'),
i AS (SELECT file_id, string_agg('- ' || import, chr(10) ORDER BY r) FILTER (WHERE r <= 10) || CASE WHEN max(n) > 10 THEN chr(10) || '... and ' || (max(n) - 10) || ' more' ELSE '' END AS v FROM ri GROUP BY file_id),
c AS (SELECT file_id, string_agg('- `' || name || '`' || CASE WHEN docstring <> '' THEN ': ' || substring(docstring, 1, 100) || '...' ELSE '' END, chr(10) ORDER BY line_no, place) AS v FROM every WHERE kind = 'class' GROUP BY file_id),
f AS (SELECT file_id, string_agg('- `' || signature || '`', chr(10) ORDER BY r) FILTER (WHERE r <= 20) || CASE WHEN max(n) > 20 THEN chr(10) || '... and ' || (max(n) - 20) || ' more' ELSE '' END AS v FROM rf GROUP BY file_id)
SELECT file_id, '# ' || regexp_extract(path, '[^/]*$', 0) || ' (' || lang || ')' || coalesce(chr(10) || chr(10) || '## Imports' || chr(10) || i.v, '') || coalesce(chr(10) || chr(10) || '## Classes' || chr(10) || c.v, '') || coalesce(chr(10) || chr(10) || '## Functions' || chr(10) || f.v, '') AS summary
FROM lists LEFT JOIN i USING (file_id) LEFT JOIN c USING (file_id) LEFT JOIN f USING (file_id)"""
SEARCHABLE = f"""WITH {CODE}, {_PYTHON}, {_EVERY},
s AS (SELECT file_id, string_agg(kind || ': ' || signature || CASE WHEN docstring <> '' THEN chr(10) || '  ' || docstring ELSE '' END || chr(10), '' ORDER BY line_no, place) AS v FROM every GROUP BY file_id)
SELECT file_id, 'File: ' || path || chr(10) || 'Language: ' || lang || chr(10) || chr(10) || coalesce(v, '') || chr(10) || content AS searchable_text FROM lists LEFT JOIN s USING (file_id)"""


def windows(text: str, size: int, overlap: int, ends: str, source: str = "documents") -> str:
    """Chunks by windows; `ends` gives the end of a window w that begins at s and does not reach the text's end.

    reverse() keeps CR LF together, hence the stand-in for CR.
    """
    step = f"least(s + {size}, n)"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {text} AS t FROM {source} WHERE text <> ''),
c AS (SELECT doc_id, s, e, n FROM (SELECT doc_id, s, n, CASE WHEN {step} < n THEN {ends} ELSE {step} END AS e FROM (SELECT doc_id, 0::BIGINT AS s, length(t) AS n, replace(substring(t, 1, {size}), chr(13), 'x') AS w FROM d WHERE length(t) > 0))
    UNION ALL SELECT doc_id, s, CASE WHEN {step} < n THEN {ends} ELSE {step} END AS e, n FROM (SELECT doc_id, s, n, replace(substring(t, s + 1, {size}), chr(13), 'x') AS w FROM (SELECT doc_id, CASE WHEN e - {overlap} > s THEN e - {overlap} ELSE e END AS s, n FROM c WHERE e < n) JOIN d USING (doc_id))),
p AS (SELECT doc_id, s, e, {strip("substring(t, s + 1, e - s)")} AS text FROM c JOIN d USING (doc_id))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS chunk_id, text, s::INT AS start_char, e::INT AS end_char FROM p WHERE text <> ''"""


_DOT = "greatest(CASE WHEN contains(w, '. ') THEN length(w) - strpos(reverse(w), ' .') - 1 ELSE -1 END, CASE WHEN contains(w, chr(10)) THEN length(w) - strpos(reverse(w), chr(10)) ELSE -1 END)"
_BLANK = "(CASE WHEN contains(w, ' ') THEN length(w) - strpos(reverse(w), ' ') ELSE -1 END)"
CHUNK_CORE = windows("text", 1000, 150, f"CASE WHEN {_DOT} > 500 THEN s + {_DOT} + 1 WHEN {_BLANK} > 500 THEN s + {_BLANK} ELSE s + 1000 END")
CHUNK_CHAR = windows(normalize_kit("text"), 1000, 100, f"CASE WHEN {_BLANK} >= 500 THEN s + {_BLANK} + 1 ELSE s + 1000 END")
RATE_LIMIT = """WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
f AS (SELECT event_id, user_id, rn, true AS allowed, [ts] AS log FROM o WHERE rn = 1
    UNION ALL SELECT event_id, user_id, rn, len(live) < 3, CASE WHEN len(live) < 3 THEN list_append(live, ts) ELSE live END FROM (SELECT o.event_id, o.user_id, o.rn, o.ts, list_filter(f.log, lambda x: x > o.ts - INTERVAL 1 DAY) AS live FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1))
SELECT event_id, user_id, allowed FROM f"""
CHAT_RETRIEVE = bm25("", 5, "(SELECT conv_id AS qid, string_agg(text, ' ' ORDER BY turn) AS query FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM turns) WHERE p <= 5 AND role = 'user' GROUP BY conv_id)", TURNS.removeprefix("WITH ") + ", ")


def _packed(text: str, pieces: str) -> str:
    """Chunks of sentences (most 1000, least 100, overlap 1) by a recursion over chunks on running totals of lengths.

    q holds a stretch's totals of length + 1; a chunk that begins at place b ends at the last place whose total is within
    1000 of the one at b, 1001 after the first chunk. {pieces} splits the longer sentences.
    """
    return f"""norm AS (SELECT doc_id, {text} AS t FROM documents),
sent AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS k, len(l) AS of FROM (SELECT doc_id, {sentences('t')} AS l FROM norm)),
mark AS (SELECT *, length(s) > 1000 AS long FROM sent),
island AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, long ORDER BY k) AS g FROM mark),
stretch AS (SELECT doc_id, g, min(k) AS k0, max(k) AS k1, any_value(of) AS of, list(s ORDER BY k) AS l, list(length(s) + 1 ORDER BY k) AS n FROM island WHERE NOT long GROUP BY doc_id, g),
totals AS (SELECT *, list_transform(range(0, len(n) + 1), lambda i: coalesce(list_sum(n[1:i]), 0)::BIGINT) AS q FROM stretch),
chunk AS (SELECT doc_id, g, 0::BIGINT AS b, greatest(1, len(list_filter(q, lambda x: x <= 1000)) - 1)::BIGINT AS e FROM totals
    UNION ALL SELECT doc_id, g, b, greatest(e0 + 1, len(list_filter(q, lambda x: x <= q[b + 1] + 1001)) - 1)::BIGINT FROM (SELECT doc_id, g, greatest(c.b, c.e - 1) AS b, c.e AS e0, q FROM chunk c JOIN totals USING (doc_id, g) WHERE c.e < len(n))),
parts AS (SELECT doc_id, k0 + e - 1 AS k, 0 AS sub, array_to_string(l[b + 1:e], ' ') AS text, k1 = of AND e = len(n) AS tail FROM chunk JOIN totals USING (doc_id, g)
    UNION ALL SELECT doc_id // 1000000, doc_id % 1000000, chunk_id, text, false FROM ({pieces})),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, sub) AS r FROM parts),
joined AS (SELECT doc_id, r, CASE WHEN lead(tail AND length(text) < 100) OVER w THEN text || ' ' || lead(text) OVER w ELSE text END AS text, tail AND length(text) < 100 AND r > 1 AS gone FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY r))"""


_LONG = "(SELECT doc_id * 1000000 + k AS doc_id, s AS text FROM mark WHERE long)"
_CORE_LONG = windows("text", 1000, 50, f"CASE WHEN {_DOT} > 500 THEN s + {_DOT} + 1 WHEN {_BLANK} > 500 THEN s + {_BLANK} ELSE s + 1000 END", _LONG)
_KIT_LONG = windows("text", 1000, 50, f"CASE WHEN {_BLANK} >= 500 THEN s + {_BLANK} + 1 ELSE s + 1000 END", _LONG)
_CHUNKS = "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1)::INT AS chunk_id, text, 0 AS start_char, 0 AS end_char FROM joined WHERE NOT gone"
CHUNK_SENTENCES = f"WITH RECURSIVE {_packed(normalize('text'), _CORE_LONG)} {_CHUNKS}"
CHUNK_SENTENCE_KIT = f"WITH RECURSIVE {_packed(normalize_kit('text'), _KIT_LONG)} {_CHUNKS}"
_ALLOWED = "'.pdf', '.md', '.markdown', '.txt', '.html', '.rst', '.csv', '.json', '.yaml', '.yml', '.xml', '.log'"
INGEST = f"""WITH RECURSIVE {_packed(normalize('text'), _CORE_LONG)},
counts AS (SELECT doc_id, count(*) AS chunks FROM joined WHERE NOT gone GROUP BY doc_id),
f AS (SELECT doc_id, filename, coalesce('.' || lower(regexp_extract(filename, '[^./]\\.([^./]+)$', 1)) IN ({_ALLOWED}), false) AS good, coalesce(text, '') AS t FROM documents),
g AS (SELECT *, min(doc_id) FILTER (WHERE good) OVER (PARTITION BY t) AS first, {normalize('t')} AS clean FROM f),
report AS (SELECT doc_id, filename, substring(sha256(t), 1, 16) AS content_id, CASE WHEN NOT good THEN 'error' WHEN doc_id <> first OR clean = '' THEN 'skipped' ELSE 'success' END AS status,
    CASE WHEN NOT good THEN 'File type not allowed' WHEN doc_id <> first THEN 'Document already indexed' WHEN clean = '' THEN 'No text extracted' END AS message, CASE WHEN good AND doc_id = first AND clean <> '' THEN coalesce(chunks, 0) ELSE 0 END::BIGINT AS chunks,
    CASE WHEN good AND doc_id = first AND clean <> '' THEN length(clean) ELSE 0 END::BIGINT AS chars FROM g LEFT JOIN counts USING (doc_id))"""
INGEST_REPORT = f"{INGEST} SELECT * FROM report"
INGEST_SUMMARY = f"{INGEST} SELECT count(*) FILTER (WHERE status = 'success') AS total_files, coalesce(sum(chunks), 0)::BIGINT AS total_chunks, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'error') AS errors FROM report"
_REQUESTS = "requests AS (SELECT item_id AS qid, CASE item_id % 4 WHEN 0 THEN 'bm25' WHEN 1 THEN 'embedding' WHEN 2 THEN 'hybrid' END AS method FROM eval_items)"
ROUTED = f"""WITH {_REQUESTS}, lx AS ({bm25('', 10)}), vx AS (SELECT qid, vec_id AS doc_id, score, rank FROM ({vector('q.vec_id IN (SELECT item_id FROM eval_items)', 10, 0.5)})), hx AS ({HYBRID})
SELECT qid, 'bm25' AS method, doc_id, score, rank FROM lx JOIN requests USING (qid) WHERE coalesce(method, 'bm25') = 'bm25' UNION ALL SELECT qid, method, doc_id, score, rank FROM vx JOIN requests USING (qid) WHERE method = 'embedding' UNION ALL SELECT qid, method, doc_id, score, rank FROM hx JOIN requests USING (qid) WHERE method = 'hybrid'"""
INVALID = "SELECT item_id AS qid, CASE WHEN length(coalesce(expected_answer, '')) NOT BETWEEN 1 AND 2000 THEN 'query' WHEN item_id % 150 NOT BETWEEN 1 AND 100 THEN 'top_k' WHEN item_id % 7 = 0 THEN 'method' END AS error FROM eval_items"
INDEX_STATS = f"WITH {BM25_BASE} SELECT (SELECT n FROM corpus) AS documents, (SELECT count(*) FROM terms) AS terms, round((SELECT avgdl FROM corpus), 6) AS avgdl"
_DIM = 64


def _encoded(text: str, source: str) -> str:
    """Vectors (key, e) of texts (key, text): signed counts of tokens in slots by their MD5, divided by their length."""
    four = " + ".join(f"(strpos('0123456789abcdef', substring(h, {k + 1}, 1)) - 1) * {16 ** (3 - k)}" for k in range(4))
    return f"""hashed AS (SELECT key, ({four}) % {_DIM} AS slot, CASE WHEN substring(h, 5, 1) < '8' THEN 1 ELSE -1 END AS sign FROM (SELECT key, md5(unnest({tokens(text)})) AS h FROM {source})),
slots AS (SELECT key, slot, sum(sign)::DOUBLE AS v FROM hashed GROUP BY key, slot),
norms AS (SELECT key, sqrt(sum(v * v)) AS n FROM slots GROUP BY key)"""


ENCODED = f"WITH {_encoded('text', '(SELECT doc_id AS key, text FROM documents)')} SELECT key AS doc_id, slot::INT AS slot, round((v / n)::FLOAT::DOUBLE, 4) AS value FROM slots JOIN norms USING (key) WHERE v <> 0"
RERANKED = f"""WITH hits AS ({bm25('', 10)}),
w AS (SELECT item_id AS qid, list_distinct(list_filter(string_split_regex(lower(query), '\\s+'), lambda x: x <> '')) AS w FROM eval_items),
s AS (SELECT qid, doc_id, round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_intersect(w, string_split_regex(lower(coalesce(text, '')), '\\s+')))::DOUBLE / len(w) END, 6) AS score FROM hits JOIN documents USING (doc_id) JOIN w USING (qid))
SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s"""
UPSERTED = "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN -embedding[1] ELSE embedding[1] END::DOUBLE AS first, label FROM embeddings WHERE vec_id % 7 <> 3 UNION ALL SELECT vec_id + 1000000, -embedding[1]::DOUBLE, label FROM embeddings WHERE vec_id % 10 = 0 AND (vec_id + 1000000) % 7 <> 3"
CHAT_TURN = f"""{TURNS}, hits AS ({CHAT_RETRIEVE.replace('WITH ' + TURNS.removeprefix('WITH ') + ', ', 'WITH ')}),
cited AS (SELECT qid, doc_id, rank, score, filename AS path, text FROM hits JOIN documents USING (doc_id) WHERE rank <= 3), a AS (SELECT qid, {_AROUND.format(_ANSWER)} AS a FROM cited GROUP BY qid),
every AS (SELECT conv_id, turn, role, text FROM turns UNION ALL SELECT u.conv_id, m + 1, 'assistant', coalesce(a, '{_NONE}') FROM (SELECT conv_id, max(turn) AS m FROM turns GROUP BY conv_id) u JOIN (SELECT DISTINCT conv_id FROM turns WHERE role = 'user') USING (conv_id) LEFT JOIN a ON a.qid = u.conv_id)
SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM every) WHERE p <= 20"""
EVAL_SUMMARY = f"""WITH m AS (SELECT metric, k, round(avg(value), 6) AS value FROM ({EVAL_SINGLE}) GROUP BY metric, k),
l AS (SELECT k, CASE WHEN k = 0 THEN 'MRR: ' || printf('%.4f', max(value)) ELSE 'R@' || k || ': ' || printf('%.4f', max(value) FILTER (WHERE metric = 'recall')) || ' | P@' || k || ': ' || printf('%.4f', max(value) FILTER (WHERE metric = 'precision')) || ' | NDCG@' || k || ': ' || printf('%.4f', max(value) FILTER (WHERE metric = 'ndcg')) END AS line FROM m GROUP BY k)
SELECT string_agg(line, chr(10) ORDER BY k) AS summary FROM l"""
