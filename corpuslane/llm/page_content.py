"""The main body of web pages, by the equivalence classes of each site's tokens.

A page is a sequence of tokens: tags and words, qualified by the path of elements they are in. Tokens with the same
occurrence vector over the pages of a site form an equivalence class. A class is valid as far as its tokens keep their
order on every page (those that do not are taken out) and its instances nest in those of other classes. Valid classes
are the site's template, and what lies between two of their tokens is a slot. A line whose words are all tokens of
valid classes is template; other lines fill the slot of the innermost class around them. Slots in boxes of
links, and those filled with the same few lines again and again, are furniture. Of the others on a page, those of the box
(element that holds blocks) that has the most words over the whole site, and of large boxes inside it, are main body.

Names of elements only decide where there are no vectors: on sites of less than LEAST_PAGES pages. Pages without their
HTML are read by lines: against the furniture of their own site, and against lines that recur as furniture on several.

Sites of over MOST_CHARS characters are not held by a task: vectors, orders, slots and boxes are aggregated over all
pages of the site by shuffles and joined back to the pages, with the same results.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslane.session import cut

#: Characters of HTML and text of a site that one task may hold.
MOST_CHARS = 64_000_000
#: Elements that hold running text, that are furniture with all they hold, and that don't break lines (fixed values).
TEXT_BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li pre blockquote dt dd td th figcaption caption".split())
FURNITURE = frozenset("nav aside footer header form button select menu dialog".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i img kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset("script style title noscript template".split())
#: Elements that group blocks without being a box of their own (fixed values).
_GROUPS = frozenset("ul ol dl tr tbody thead table blockquote li dd".split())
#: A class needs so many pages, and so large a share of the site's (more for words, as texts repeat them), and so many tokens.
LEAST_PAGES, LEAST_SHARE, LEAST_SHARE_WORDS, LEAST_TOKENS = 3, 0.05, 0.3, 2
#: A box is furniture if so many of its lines are links, a slot if so few of its lines differ.
MOST_LINKED, LEAST_VARIED = 0.5, 0.3
#: Shares of words that a box needs: of all words in slots of the site, and of those of the box that it is in.
LEAST_BOX, LEAST_INSIDE = 0.03, 0.1
SEPARATORS = re.compile(r"\s+[·|/»>›•]\s+")
WORD = re.compile(r"\S+")
_PIECE = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<""", re.S)
_NAMED = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


class Line(NamedTuple):
    """A visible line: the elements around it, its text, the share of it in links, whether it is the first of its box, the number of the box around its block, the box's path, and where its words stand among the page's tokens."""

    path: tuple[str, ...]
    text: str
    linked: float
    first: bool
    home: int
    box: str
    low: int
    high: int


class Page:
    """The visible lines of a page and its tokens, as values of 63 bits: even ones of tags, odd ones of words.

    tokens=False leaves the tokens out.
    """

    def __init__(self, html: str, tokens: bool = True):
        self._hashed = tokens
        self.lines: list[Line] = []
        self.tokens: list[int] = []
        self._tags: list[str] = []
        self._paths: list[str] = []
        self._ids: list[int] = []
        self._begun: set[int] = set()
        self._text, self._linked, opened, links, at = [], 0, 0, 0, 0
        while m := _PIECE.match(html, at):
            at = m.end()
            tag = m[2] and m[2].lower()
            if tag is None:
                x = m[0]
                if (x[0] != "<" or x == "<") and (self._text or not x.isspace()):
                    x = entities.unescape(x) if "&" in x else x
                    self._text.append(x)
                    self._linked += len(x.strip()) if links else 0
                continue
            if tag in _HIDDEN and not m[1]:
                close = re.compile(rf"</{tag}\b[^>]*>|\Z", re.I).search(html, at)
                at = close.end()
                continue
            links = links + 1 if tag == "a" and not m[1] else max(0, links - (tag == "a"))
            if tag in INLINE:
                continue
            self._end_line()
            if not m[1]:
                if tag not in _VOID and not m[3].endswith("/"):
                    named = _NAMED.search(m[3]) if m[3] else None
                    own = f"{tag}.{named[1] or named[2] or named[3]}" if named else tag
                    opened += 1
                    self._tags.append(tag)
                    self._paths.append(f"{self._paths[-1]}/{own}" if self._paths else own)
                    self._ids.append(opened)
                    self._add("<", self._paths[-1])
            elif tag in self._tags:
                while True:
                    self._add(">", self._paths.pop())
                    self._ids.pop()
                    if self._tags.pop() == tag:
                        break
        self._end_line()

    def _add(self, what: str, path: str) -> None:
        if not self._hashed:
            return
        self.tokens.append(xxhash.xxh3_64_intdigest(f"{path}\0{what}") >> 2 << 1)

    def _end_line(self) -> None:
        if not self._text:
            return
        whole = "".join(self._text)
        for piece in whole.split("\n") if "pre" in self._tags else [" ".join(whole.split())]:
            if not piece.strip():
                continue
            linked = self._linked / max(1, len(whole.strip()))
            first = (self._ids[-2:-1] if linked >= 0.8 else self._ids[-1:]) or [0]
            home = next((i for t, i in zip(reversed(self._tags), reversed(self._ids)) if t not in TEXT_BLOCKS | _GROUPS), 0)
            n = len(self._tags)
            if n and self._tags[-1] in TEXT_BLOCKS:
                n -= 1
                while n and self._tags[n - 1] in _GROUPS:
                    n -= 1
            path, low = self._paths[-1] if self._paths else "", len(self.tokens)
            if self._hashed:
                self.tokens += [xxhash.xxh3_64_intdigest(f"{path}\0 {w}") >> 2 << 1 | 1 for w in WORD.findall(piece)]
            self.lines.append(Line(tuple(self._tags), piece, linked, first[0] not in self._begun, home, self._paths[n - 1] if n else "", low, len(self.tokens)))
            self._begun.add(first[0])
        self._text, self._linked = [], 0


def _is_text(path: tuple[str, ...], linked: float) -> bool:
    """Whether a line stands in a block of text; links alone make none (see text_lines for lists of links)."""
    return bool(path) and any(p in TEXT_BLOCKS for p in path) and not any(p in FURNITURE for p in path) and path[-1] not in ("div", "section", "body", "article", "main") and linked < 0.8


def text_lines(lines: list[Line]) -> list[bool]:
    """For each line, whether it is in a block of text, or in a list of links in a box that has other such blocks."""
    plain = [_is_text(path, linked) for path, _, linked, *_ in lines]
    homes = {home for (_, _, _, _, home, *_), x in zip(lines, plain) if x}
    return [x or home in homes and _is_text(path, 0) for (path, _, _, _, home, *_), x in zip(lines, plain)]


def _site_name(host: str) -> str:
    return (host.split(":")[0].split(".")[-2:-1] or [""])[0]


def _key(line: str, host: str) -> str:
    """A line without what names its site and without numbers, to be compared between sites."""
    line = line.strip().lower().replace(host.lower(), "@")
    name = _site_name(host).lower()
    return re.sub(r"\d+", "0", line.replace(name, "@") if name else line)


Template = dict[int, tuple[int, int, int]]  # token -> its class, its place in it, the size of the class


def vectors(pages: Iterable[tuple[int, Page]]) -> pd.DataFrame:
    """(token, page, n, at): how often and where first the pages, numbered, have each token."""
    parts = []
    for number, page in pages:
        tokens, at, n = np.unique(np.array(page.tokens, np.int64), return_index=True, return_counts=True)
        parts.append((tokens, np.full(len(tokens), number, np.int64), n, at))
    columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4
    return pd.DataFrame(dict(zip(("token", "page", "n", "at"), columns)))


def _classes(often: list[tuple[int, int, int, int]]) -> Template:
    """The classes of tokens given as (token, class, first place, occurrences on a page), in order of first places."""
    of: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for token, vector, at, _ in often:
        of[vector].append((at, token))
    return {t: (c, k, len(ts)) for c, ts in of.items() if len(ts) >= LEAST_TOKENS for k, (_, t) in enumerate(sorted(ts))}


def out_of_order(page: Page, template: Template) -> set[int]:
    """Tokens that must leave their class for the others to stand in one order on this page."""
    places: dict[int, list[int]] = defaultdict(list)
    for t in page.tokens:
        if t in template:
            places[template[t][0]].append(t)
    bad: set[int] = set()
    for seq in places.values():
        size = template[seq[0]][2]
        if all(template[t][1] == k % size for k, t in enumerate(seq)):
            continue
        if len(seq) > size:  # a class with repeated instances that are not alike
            half = [t for k, t in enumerate(seq) if template[t][1] != k % size]
            bad.update(half)
            continue
        best: list[int] = []  # the longest run of places in order: patience sorting
        tails, back = [], {}
        for t in seq:
            r = template[t][1]
            k = bisect_left(best, r)
            back[t] = tails[k - 1] if k else None
            if k == len(best):
                best.append(r)
                tails.append(t)
            else:
                best[k], tails[k] = r, t
        keep, t = set(), tails[-1]
        while t is not None:
            keep.add(t)
            t = back[t]
        bad.update(t for t in seq if t not in keep)
    return bad


def walk(page: Page, template: Template) -> tuple[list[tuple[int, int] | None], set[int]]:
    """Of each line its slot (innermost open class, last token passed), None for template; classes that do not nest."""
    slots: list[tuple[int, int] | None] = []
    crossed: set[int] = set()
    stack: list[list[int]] = []
    hits = [(at, *template[t]) for at, t in enumerate(page.tokens) if t in template]
    n = 0
    for line in [*page.lines, None]:
        end = line.low if line else len(page.tokens)
        while n < len(hits) and hits[n][0] < end:
            _, c, k, size = hits[n]
            n += 1
            if k == 0:
                stack.append([c, 0])
            elif stack and stack[-1][0] == c and stack[-1][1] == k - 1:
                stack[-1][1] = k
            else:
                below = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == c and stack[i][1] == k - 1), None)
                if below is None:
                    crossed.add(c)
                    continue
                crossed.update(x[0] for x in stack[below + 1 :])
                del stack[below + 1 :]
                stack[-1][1] = k
            if k == size - 1:
                stack.pop()
        if line:
            full = n + line.high - line.low <= len(hits) and hits[n + line.high - line.low - 1][0] == line.high - 1
            slots.append(None if full else (stack[-1][0], stack[-1][1]) if stack else (0, 0))
    return slots, crossed


def _without(template: Template, tokens: set[int], classes: set[int]) -> Template:
    return _classes([(t, c, k, 0) for t, (c, k, _) in template.items() if t not in tokens and c not in classes])


Boxes = dict[int, tuple[int, str]]  # slot -> words of its box on the site, the box


class Slots:
    """What fills the slots of a site, and the words of its boxes; kept by slot, path and line."""

    def __init__(self):
        self.lines: Counter = Counter()  # (slot, path, box, hash of the line): occurrences
        self.linked: Counter = Counter()
        self.words: Counter = Counter()

    def add(self, page: Page, keys: list[int | None]) -> None:
        for line, key in zip(page.lines, keys):
            if key is not None:
                self.lines[key, line.box, xxhash.xxh3_64_intdigest(line.text) >> 1] += 1
                self.linked[key] += line.linked >= 0.8
                self.words[key] += line.high - line.low

    def rows(self) -> list[tuple]:
        """(slot, box, lines, distinct lines, lines that are links, words)."""
        n, distinct, boxes = Counter(), Counter(), {}
        for (key, box, _), k in self.lines.items():
            n[key] += k
            distinct[key] += 1
            boxes[key] = box
        return [(key, boxes[key], n[key], distinct[key], self.linked[key], self.words[key]) for key in n]


def slot_keys(page: Page, template: Template) -> list[int | None]:
    """Of each line a value of its slot, its path and its box; None for template."""
    slots, _ = walk(page, template)
    return [None if s is None else xxhash.xxh3_64_intdigest(f"{s}\0{'/'.join(line.path)}\0{line.box}") >> 1 for s, line in zip(slots, page.lines)]


def main_slots(rows: list[tuple]) -> Boxes:
    """Slots that may be main body and their boxes, of rows as Slots gives them for a whole site."""
    lines, links = Counter(), Counter()
    for _, box, n, _, linked, _ in rows:
        lines[box] += n
        links[box] += linked
    good = [(key, box, words) for key, box, n, distinct, _, words in rows if links[box] < MOST_LINKED * lines[box] and (n < LEAST_PAGES or distinct >= LEAST_VARIED * n)]
    words: Counter = Counter()
    for _, box, k in good:
        words[box] += k
    least = LEAST_BOX * sum(words.values())
    return {key: (words[box], box) for key, box, _ in good if words[box] >= least}


def site_template(pages: dict[str, Page]) -> Template:
    """The valid equivalence classes of a site's pages, one for each URL."""
    if len(pages) < LEAST_PAGES:
        return {}
    urls = sorted(pages)
    v = vectors((k, pages[u]) for k, u in enumerate(urls))
    mark = np.array([xxhash.xxh3_64_intdigest(u) for u in urls], np.uint64)
    v["mark"] = _marks(mark[v["page"].to_numpy()], v["n"].to_numpy())
    t = v.groupby("token").agg(pages=("page", "size"), vector=("mark", "sum"), at=("at", "min"))
    share = np.where(t.index.to_numpy() % 2 == 1, LEAST_SHARE_WORDS, LEAST_SHARE)
    t = t[t["pages"] >= np.maximum(LEAST_PAGES, share * len(pages))]
    template = _classes([(a, b, c, 0) for a, b, c in zip(t.index.tolist(), t["vector"].tolist(), t["at"].tolist())])
    template = _without(template, set().union(*(out_of_order(p, template) for p in pages.values())), set())
    return _without(template, set(), set().union(*(walk(p, template)[1] for p in pages.values())))


def _marks(urls: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A value of each entry of a vector; a vector's value is their sum."""
    x = (urls ^ (n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(20)).astype(np.int64)  # 44 bits: sums of 500,000 pages stay exact


def is_main(page: Page, keys: list[int | None], slots: Boxes | None) -> list[bool]:
    """For each line whether it is of the main body: in the box that has most words on the site of those on the page.

    slots is None where the site has too few pages for vectors.
    """
    if slots is None:
        return text_lines(page.lines)
    found = [slots.get(key) if key is not None else None for key in keys]
    if not any(found):
        return [False] * len(found)
    most, top = min((x for x in found if x), key=lambda x: (-x[0], x[1]))
    inside = {b for n, b in {x for x in found if x} if b == top or b.startswith(top + "/") and n >= LEAST_INSIDE * most}
    return [x is not None and x[1] in inside for x in found]


def _aligned(text: str, lines: list[Line]) -> tuple[list[tuple[int, int]], int]:
    """(line number, place in lines) of the text's lines that are lines of the page, in order; and how many are not."""
    places: dict[str, list[int]] = defaultdict(list)
    for k, line in enumerate(lines):
        places[" ".join(line.text.split())].append(k)
    out, at, lost = [], 0, 0
    for k, x in enumerate(text.split("\n"), 1):
        x = " ".join(x.split())
        if not x:
            continue
        found = places.get(x, ())
        n = bisect_left(found, at)
        if n < len(found):
            out.append((k, found[n]))
            at = found[n] + 1
        else:
            lost += 1
    return out, lost


def _by_lines(text: str, title: str | None, furniture: set[str], recurring: set[int], leads: set[int]) -> list[int]:
    """Main lines of a page of which only the text is known; leads are the lines that begin lists of links elsewhere."""
    lines = [x.strip() for x in text.split("\n")]
    rest = [k for k, x in enumerate(lines) if x]

    def known(k: int) -> bool:
        return k + 1 in recurring or lines[k] in furniture

    names = [t for t in (title, re.sub(r"\s+[-–|·]\s+[^-–|·]*$", "", title or "")) if t]
    first = next((k for k in rest if lines[k] in names), None)
    if first is None:
        ended = [k for k in rest if not known(k) and not SEPARATORS.search(lines[k]) and re.search(r"[.!?…]$", lines[k])]
        if not title and not ended:
            return []
        head = max((k for k in rest if known(k) and k < (ended[-1] if ended else 0)), default=-1)
        first = next((k for k in rest if not known(k) and not SEPARATORS.search(lines[k]) and (k > 0)), None) if head < 0 or ended and head > ended[0] else next((k for k in rest if k > head and not SEPARATORS.search(lines[k])), None)
        if first is None:
            return []
    out, teasers = [], False
    for n, k in enumerate(rest):
        if k < first:
            continue
        x = lines[k]
        if re.match(r"(?:©|\(c\)|copyright\b)", x, re.I):
            break
        following = rest[n + 1] if n + 1 < len(rest) else None
        if known(k):
            teasers = k + 1 in leads and not SEPARATORS.search(x)
            continue
        if teasers and not re.search(r"[.!?…:;{}()=]$", x) and lines[k - 1]:
            continue
        teasers = False
        if following is not None and following == k + 1 and known(following) and len(lines[following].split()) <= 3 and re.search(r"[.!?…]$", x) and out and following + 1 < len(lines) and (not lines[following + 1] or not known(following + 1)):
            later = [j for j in rest if j > following and not known(j)]
            if later and re.search(r"[.!?…]$", lines[later[0]]):
                continue  # an insert: a sentence with a button
        out.append(k + 1)
    return out


def _main(r, page: Page | None, main: list[bool] | None, furniture: set[str]) -> list[tuple[int, int]]:
    """(url_id, line number) of a page's main body, given which lines of its HTML are, and its site's furniture.

    A text that hardly is that of its HTML (more lines lost than found) is read by its lines.
    """
    matched, lost = _aligned(r.text or "", page.lines) if page else ([], 1)
    if page and lost <= len(matched):
        return [(r.url_id, k) for k, at in matched if main[at]]
    return [(r.url_id, k) for k in _by_lines(r.text or "", r.title, furniture, *(set(x) if x is not None else set() for x in (r.recurring, r.leads)))]


def _analyse(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("url_id", ascending=False, kind="stable")  # of pages read twice, the first counts
    parsed = {i: Page(h) for i, h in zip(group["url_id"], group["html"]) if h}
    one_each = {u: parsed[i] for i, u in zip(group["url_id"], group["url"]) if i in parsed}
    template = site_template(one_each)
    keys = {i: slot_keys(page, template) for i, page in parsed.items()}
    slots = None
    if len(one_each) >= LEAST_PAGES:
        filled = Slots()
        for i in {u: i for i, u in zip(group["url_id"], group["url"]) if i in parsed}.values():
            filled.add(parsed[i], keys[i])
        slots = main_slots(filled.rows())
    main = {i: is_main(page, keys[i], slots) for i, page in parsed.items()}
    furniture = {line.text.strip() for i, page in parsed.items() for line, x in zip(page.lines, main[i]) if not x}
    return pd.DataFrame([x for r in group.itertuples() for x in _main(r, parsed.get(r.url_id), main.get(r.url_id), furniture)], columns=["url_id", "line_no"])


def _as_template(x) -> Template:
    """A template from its rows as Arrow gives them."""
    return _classes([(r["token"], r["vector"], r["at"], 0) for r in x]) if x is not None else {}


def _analyse_large(rows: DataFrame) -> DataFrame:
    """As _analyse for each host, over pages of sites of any size."""
    coded = rows.where("html is not null and html <> ''")
    ones = coded.groupBy("host", "url").agg(F.min("url_id").alias("url_id")).select("url_id", F.lit(True).alias("one"))
    coded = cut(coded.join(ones, "url_id", "left").select("host", "url", "url_id", "html", F.coalesce("one", F.lit(False)).alias("one")))
    once = coded.where("one").drop("one")
    sites = once.groupBy("host").agg(F.count("*").alias("urls")).where(f"urls >= {LEAST_PAGES}")

    def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = vectors((k, Page(h)) for k, h in enumerate(batch["html"]))
            mark = np.array([xxhash.xxh3_64_intdigest(u) for u in batch["url"]], np.uint64)
            page = v["page"].to_numpy()
            yield pd.DataFrame({"host": batch["host"].to_numpy()[page], "token": v["token"], "mark": _marks(mark[page], v["n"].to_numpy()), "at": v["at"]})

    found = once.mapInPandas(facts, "host string, token bigint, mark bigint, at bigint")
    often = found.groupBy("host", "token").agg(F.count("*").alias("pages"), F.sum("mark").alias("vector"), F.min("at").alias("at")).join(sites, "host")
    often = cut(often.where(F.col("pages") >= F.greatest(F.lit(float(LEAST_PAGES)), F.when(F.col("token") % 2 == 1, LEAST_SHARE_WORDS).otherwise(LEAST_SHARE) * F.col("urls"))).select("host", "token", "vector", "at"))

    def with_template(pages: DataFrame, tokens: DataFrame) -> DataFrame:
        """A site's template has at most a page's tokens / LEAST_SHARE."""
        return pages.join(tokens.groupBy("host").agg(F.collect_list(F.struct("token", "vector", "at")).alias("template")), "host", "left")

    def taken_out(by_page, what: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = {(h, x) for h, page, t in zip(batch["host"], batch["html"], batch["template"]) for x in by_page(Page(page), _as_template(t))}
                yield pd.DataFrame(sorted(out), columns=["host", what])

        return run

    bad = with_template(once, often).mapInPandas(taken_out(out_of_order, "token"), "host string, token bigint").distinct()
    often = cut(often.join(bad, ["host", "token"], "left_anti"))
    bad = with_template(once, often).mapInPandas(taken_out(lambda p, t: walk(p, t)[1], "vector"), "host string, vector bigint").distinct()
    often = cut(often.join(bad, ["host", "vector"], "left_anti"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for host, html, t in zip(batch["host"], batch["html"], batch["template"]):
                page = Page(html)
                out += [(host, key, line.box, xxhash.xxh3_64_intdigest(line.text) >> 1, int(line.linked >= 0.8), line.high - line.low) for line, key in zip(page.lines, slot_keys(page, _as_template(t))) if key is not None]
            yield pd.DataFrame(out, columns=["host", "slot", "box", "line", "linked", "words"])

    filled = with_template(once.join(sites, "host", "left_semi"), often).mapInPandas(fill, "host string, slot bigint, box string, line bigint, linked bigint, words bigint")
    by_line = filled.groupBy("host", "slot", "box", "line").agg(F.count("*").alias("n"), F.sum("linked").alias("linked"), F.sum("words").alias("words"))
    by_slot = by_line.groupBy("host", "slot", "box").agg(F.sum("n").alias("n"), F.count("*").alias("distinct"), F.sum("linked").alias("linked"), F.sum("words").alias("words"))
    by_slot = cut(by_slot)
    open_boxes = by_slot.groupBy("host", "box").agg(F.sum("linked").alias("x"), F.sum("n").alias("y")).where(F.col("x") < MOST_LINKED * F.col("y")).select("host", "box")
    good = by_slot.where((F.col("n") < LEAST_PAGES) | (F.col("distinct") >= LEAST_VARIED * F.col("n"))).join(open_boxes, ["host", "box"], "left_semi")
    boxes = good.groupBy("host", "box").agg(F.sum("words").alias("words"))
    whole = boxes.groupBy("host").agg(F.sum("words").alias("whole"))
    kept = boxes.join(whole, "host").where(F.col("words") >= LEAST_BOX * F.col("whole")).select("host", "box", F.col("words").alias("most"))
    slots = good.join(kept, ["host", "box"]).groupBy("host").agg(F.collect_list(F.struct("slot", "most", "box")).alias("slots"))
    known = sites.select("host", F.lit(True).alias("large")).join(slots, "host", "left")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, host, html, t, x, large in zip(batch["url_id"], batch["host"], batch["html"], batch["template"], batch["slots"], batch["large"]):
                page = Page(html)
                main = is_main(page, slot_keys(page, _as_template(t)), {y["slot"]: (y["most"], y["box"]) for y in (x if x is not None else ())} if large is True else None)
                out.append((i, host, main, sorted({line.text.strip() for line, m in zip(page.lines, main) if not m})))
            yield pd.DataFrame(out, columns=["url_id", "host", "main", "furniture"])

    judged = cut(with_template(coded, often).join(known, "host", "left").mapInPandas(judge, "url_id bigint, host string, main array<boolean>, furniture array<string>"))
    furniture = judged.select("host", F.explode("furniture").alias("x")).distinct()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(i, h, x) for i, h, t in zip(batch["url_id"], batch["host"], batch["text"]) for x in {x.strip() for x in t.split("\n")} if x], columns=["url_id", "host", "x"])

    hits = rows.where("text is not null").select("url_id", "host", "text").mapInPandas(split, "url_id bigint, host string, x string").join(furniture, ["host", "x"]).groupBy("url_id").agg(F.collect_set("x").alias("furniture"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                out += _main(r, Page(r.html) if r.html else None, r.main, set(r.furniture) if r.furniture is not None else set())
            yield pd.DataFrame(out, columns=["url_id", "line_no"])

    return rows.join(judged.select("url_id", "main"), "url_id", "left").join(hits, "url_id", "left").mapInPandas(run, "url_id bigint, line_no int")


def main_lines(pages: DataFrame, least_hosts: int = 3) -> DataFrame:
    """(url_id, line_no): the non-blank lines of text that belong to the main body; line_no counts from 1.

    Reads url_id, url, title, text and html; other columns are ignored. Null or empty texts, and pages with no main
    body, give no rows. Pages read twice count under both url_ids, but once for their site's template. A null url
    makes a site of its own; a null html is made up for by what other pages of the site, and other sites, repeat.
    """
    rows = pages.where("url_id is not null").select(F.col("url_id").cast("bigint").alias("url_id"), F.coalesce("url", F.concat(F.lit("null:"), F.col("url_id").cast("string"))).alias("url"), "title", "text", "html")
    rows = rows.withColumn("host", F.lower(F.coalesce(F.expr("try_parse_url(url, 'AUTHORITY')"), F.col("url"))))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages_lines = [(h, Page(html, False).lines) for h, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            found = {(_key(x.text, h), h, x.linked >= 0.8) for h, lines in pages_lines for x, text in zip(lines, text_lines(lines)) if not text and (x.first or x.linked < 0.8 or {*x.path} & {"nav", "footer", "header"})}
            columns = list(zip(*sorted(found))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_()))], ["key", "host", "linked"])

    furniture = rows.where("html is not null and html <> ''").select("host", "html").mapInArrow(keys, "key string, host string, linked boolean").groupBy("key", "host").agg(F.max("linked").alias("linked"))
    often = furniture.groupBy("key").agg(F.count("*").alias("n"), F.avg(F.col("linked").cast("int")).alias("linked")).where(f"n >= {least_hosts}").select("key", (F.col("linked") >= 0.5).alias("lead"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, h, t in zip(*(c.to_pylist() for c in batch.columns)):
                for k, x in enumerate(t.split("\n"), 1):
                    parts = SEPARATORS.split(x.strip()) if x.strip() else []
                    out += [(i, k, len(parts), _key(p, h)) for p in parts] + ([(i, k, 1, _key(x, h))] if len(parts) > 1 else [])
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["url_id", "line_no", "parts", "key"])

    bare = rows.where("(html is null or html = '') and text is not null").select("url_id", "host", "text").mapInArrow(lines, "url_id bigint, line_no int, parts int, key string")
    hits = bare.join(often, "key").groupBy("url_id", "line_no", "parts").agg(F.count("*").alias("n"), F.min("lead").alias("lead")).where("n >= parts")
    recurring = hits.groupBy("url_id").agg(F.collect_set("line_no").alias("recurring"), F.collect_set(F.when(F.col("lead"), F.col("line_no"))).alias("leads"))
    size = F.coalesce(F.length("html"), F.lit(0)) + F.coalesce(F.length("text"), F.lit(0))
    large = cut(rows.groupBy("host").agg(F.sum(size).alias("n")).where(f"n > {MOST_CHARS}").select("host", F.lit(True).alias("large")))
    joined = rows.join(large, "host", "left").join(recurring, "url_id", "left").select("large", "host", "url_id", "url", "title", "text", "html", "recurring", "leads")
    small = joined.where("large is null").drop("large").groupBy("host").applyInPandas(_analyse, "url_id bigint, line_no int")
    return small if large.isEmpty() else small.unionByName(_analyse_large(joined.where("large").drop("large")))


def main_text(pages: DataFrame) -> DataFrame:
    """(url_id, main_text): the main body of every page, its lines joined by line ends; empty where there is none."""
    found = cut(main_lines(pages)).groupBy("url_id").agg(F.array_sort(F.collect_list("line_no")).alias("n"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return pages.select("url_id", "text").join(found, "url_id", "left").select("url_id", F.coalesce(F.array_join(F.transform("n", lambda k: F.element_at(lines, k)), "\n"), F.lit("")).alias("main_text"))
