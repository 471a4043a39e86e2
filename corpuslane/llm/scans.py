"""Text of scanned pages: noise found, and repaired into continuous paragraphs.

Misread words are looked up in a trie of the vocabulary of all pages by intersecting it with a Levenshtein automaton,
which retrieves every candidate (for all unknown words of many files at once: they descend the trie together);
candidates are ranked by the likelihood of their confusions, their frequency and that next to their neighbours. Running headers
and page numbers are told by their recurrence and their order within a file; what remains is joined and reflowed.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslane.session import cut

#: Words (and pairs of words) rarer than this share of all words are no vocabulary; so it has at most 1 / SHARE entries.
SHARE, LEAST_COUNT = 2e-6, 3
#: How often a word is read as a given other, by one confusion of the tables below, by a sign for some letter, and by
#: any other single edit (fixed values); edits multiply.
BY_CONFUSION, BY_SIGN, BY_EDIT = 1 / 25, 1 / 50, 1 / 200
#: The same for words of the vocabulary, which were read so repeatedly, and for capitalised ones, as names are alike.
BY_EDIT_AGAIN = 1 / 20_000
#: Readings, as a count, by which a word outside the vocabulary counts as well read, and if it is capitalised or short.
UNKNOWN, UNKNOWN_NAME = 0.12, 1.0
#: Characters of files that are read together.
BATCH = 8_000_000
#: Edits that the automaton allows.
MOST_EDITS = 2
WORD = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*")
TOKEN = re.compile(r"[^\s,;:!?\"“”„»«()\[\].…]+(?:[.,:][^\s,;:!?\"“”„»«()\[\].…]+)*")
PAGE_NUMBER = re.compile(r"^\W*(?:page|seite|pagina|página|pág|p|s)?\W*(\d{1,5})\s*(?:(?:/|of|von|de|sur|di)\s*\d{1,5})?\W*$", re.I)
#: Groups of characters that scanners take for others (fixed values: read, meant).
GROUPS = (("rn", "m"), ("vv", "w"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("nn", "m"), ("lc", "k"), ("m", "rn"), ("w", "vv"), ("n", "ri"), ("d", "cl"), ("h", "li"))
#: Single characters that scanners confuse, either way (fixed values).
CONFUSED = defaultdict(str)
for _pair in "ec il 1l 1i 0o 5s |l |i @a tf hb vy gq li j1 6b 9g 8b 2z $s !l !i €e ij".split():
    CONFUSED[_pair[0]] += _pair[1]
    CONFUSED[_pair[1]] += _pair[0]
_SIGNS = set("0123456789|@$!€£§{}<>\\/+*^~_#&%")


class Trie:
    """A trie of words with their counts in flat arrays: the children of node k are nodes first[k] up to first[k + 1]."""

    def __init__(self, counts: dict[str, int]):
        words = sorted(counts)
        signs, first, ends, best = [""], [], [], [max(counts.values(), default=0)]
        level, depth = [(0, len(words))], 0
        self.words, self.counts = words, [counts[w] for w in words]
        while level:
            below = []
            for low, high in level:
                first.append(len(signs))
                ends.append(-1)
                if low < high and len(words[low]) == depth:
                    ends[-1] = low
                    low += 1
                while low < high:
                    c, k = words[low][depth], low + 1
                    while k < high and words[k][depth] == c:
                        k += 1
                    signs.append(c)
                    best.append(max(self.counts[low:k]))
                    below.append((low, k))
                    low = k
            level, depth = below, depth + 1
        first.append(len(signs))
        self.signs, self.first, self.ends, self.best = "".join([" ", *signs[1:]]), array("i", first), array("i", ends), array("q", best)

    def within(self, word: str, most: int = 1, least: float = 0) -> list[tuple[int, str, int]]:
        """(distance, word, count) of all words within an edit distance that are counted `least` times or more.

        The automaton's states are sets of bits for each number of edits; bit k is set where k characters are read.
        """
        masks: dict[str, int] = {}
        for k, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 2 << k
        signs, first, ends, best = self.signs, self.first, self.ends, self.best
        end, whole = 1 << len(word), (2 << len(word)) - 1
        found, stack = [], [(0, tuple(((2 << d) - 1) & whole for d in range(most + 1)))]
        while stack:
            node, states = stack.pop()
            if ends[node] >= 0 and states[-1] & end and self.counts[ends[node]] >= least:
                found.append((next(d for d, bits in enumerate(states) if bits & end), self.words[ends[node]], self.counts[ends[node]]))
            for child in range(first[node], first[node + 1]):
                if best[child] < least:
                    continue
                mask = masks.get(signs[child], 0)
                before = states[0]
                bits = before << 1 & mask
                new = [bits]
                for state in states[1:]:
                    bits = (state << 1 & mask | before << 1 | bits << 1 | before) & whole
                    new.append(bits)
                    before = state
                if bits:
                    stack.append((child, new))
        return found

    def within_all(self, words: list[str], most: int, least: np.ndarray) -> list[list[int]]:
        """For each of many words of at most 62 characters, the places of what `within` finds: all descend together."""
        masks: dict[str, np.ndarray] = {}
        for q, word in enumerate(words):
            for k, c in enumerate(word):
                if c not in masks:
                    masks[c] = np.zeros(len(words), np.uint64)
                masks[c][q] |= np.uint64(2 << k)
        lengths = np.array([len(w) for w in words], np.uint64)
        one = np.uint64(1)
        ends, whole = one << lengths, (np.uint64(2) << lengths) - one
        found: list[list[int]] = [[] for _ in words]
        none = np.zeros(len(words), np.uint64)
        signs, first, places, best = self.signs, self.first, self.ends, self.best
        stack = [(0, np.arange(len(words)), [np.full(len(words), (2 << d) - 1, np.uint64) & whole for d in range(most + 1)])]
        while stack:
            node, active, states = stack.pop()
            if places[node] >= 0:
                for q in active[(states[-1] & ends[active] != 0) & (self.counts[places[node]] >= least[active])].tolist():
                    found[q].append(places[node])
            for child in range(first[node], first[node + 1]):
                mask, limit = masks.get(signs[child], none)[active], whole[active]
                before = states[0]
                bits = before << one & mask
                new = [bits]
                for state in states[1:]:
                    bits = (state << one & mask | before << one | bits << one | before) & limit
                    new.append(bits)
                    before = state
                keep = np.flatnonzero((bits != 0) & (least[active] <= best[child]))
                if len(keep):
                    stack.append((child, active[keep], [x[keep] for x in new]))
        return found


def _confusion(read: str, meant: str, by_edit: float) -> float:
    """How often meant is read as read, by the likeliest way of confusions, signs and other edits."""
    low, high = 0, min(len(read), len(meant))
    while low < high and read[low] == meant[low]:
        low += 1
    end = 0
    while end < high - low and read[-1 - end] == meant[-1 - end]:
        end += 1
    read, meant = read[low : len(read) - end], meant[low : len(meant) - end]
    if not read or not meant:
        return by_edit ** (len(read) + len(meant))
    if len(read) == len(meant) == 1:
        return BY_CONFUSION if meant in CONFUSED.get(read, "") else BY_SIGN if read in _SIGNS else by_edit
    groups = [x for x in GROUPS if x[0] in read and x[1] in meant]
    best = [[0.0] * (len(meant) + 1) for _ in range(len(read) + 1)]
    best[0][0] = 1.0
    for i in range(len(read) + 1):
        for j in range(len(meant) + 1):
            x = best[i][j]
            if i and j:
                a, b = read[i - 1], meant[j - 1]
                x = max(x, best[i - 1][j - 1] * (1 if a == b else BY_CONFUSION if b in CONFUSED.get(a, "") else BY_SIGN if a in _SIGNS else by_edit))
            if i:
                x = max(x, best[i - 1][j] * by_edit)
            if j:
                x = max(x, best[i][j - 1] * by_edit)
            for old, new in groups:
                if len(old) <= i and len(new) <= j and read.endswith(old, 0, i) and meant.endswith(new, 0, j):
                    x = max(x, best[i - len(old)][j - len(new)] * BY_CONFUSION)
            best[i][j] = x
    return best[-1][-1]


class Reader:
    """Judges and repairs words under a vocabulary of words and pairs of neighbours."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int]):
        self.words, self.pairs, self.trie = words, pairs, Trie(words)
        self.top = max(words.values(), default=0)
        self.known: dict[tuple[str, bool], list[tuple[float, str]]] = {}
        self.fine: set[str] = set()  # tokens without a candidate, whatever is around them

    def candidates(self, word: str, name: bool = False) -> list[tuple[float, str]]:
        """(expected readings as this word, candidate) of all words that it may be a misreading of, likeliest first.

        The automaton retrieves all words within as many edits as the most frequent word could be read so often by; it
        passes by what is too rare to be read as a known word that often.
        """
        if (word, name) not in self.known:
            asked = self._question(word, name)
            self._learn(word, name, [(w, n) for _, w, n in self.trie.within(word, *asked)] if asked else [])
        return self.known[word, name]

    def _question(self, word: str, name: bool) -> tuple[int, float] | None:
        """The number of edits to look within, and the least count of what can be meant; None if nothing can."""
        own, signs = self.words.get(word, 0), sum(c in _SIGNS for c in word)
        if len(word) < 3 and not signs or own > self.top * BY_CONFUSION:
            return None
        by_edit = BY_EDIT_AGAIN if own or name else BY_EDIT
        most = max(MOST_EDITS if 2 * signs < len(word) or len(word) < 4 else 1, min(signs, 4)) if len(word) >= 3 else 1
        if own and max(BY_CONFUSION * by_edit, by_edit) * self.top < own:
            most = min(most, 2)  # a confused group is two edits
        return most, own / BY_CONFUSION

    def _learn(self, word: str, name: bool, near: list[tuple[str, int]]) -> None:
        own = self.words.get(word, 0)
        by_edit = BY_EDIT_AGAIN if own or name else BY_EDIT
        found = sorted(((n * _confusion(word, w, by_edit), w) for w, n in near if w != word), reverse=True)
        self.known[word, name] = [x for x in found if x[0] >= (own or UNKNOWN) / 1000]

    def prepare(self, lines: Iterable[str]) -> None:
        """Asks the automaton at once for all words of the lines that are not known yet."""
        if len(self.known) > 1_000_000:
            self.known.clear()
        asked: dict[int, dict[tuple[str, bool], float]] = defaultdict(dict)
        for token in {t for x in lines for t in TOKEN.findall(x)} - self.fine:
            low = token.lower()
            key = low, not token[0].islower() and not any(c in _SIGNS for c in low)
            if key not in self.known and (question := self._question(*key)) and len(low) <= 62 and sum(map(str.isalpha, low)) >= 2:
                asked[question[0]][key] = question[1]
        for most, keys in asked.items():
            for k in range(0, len(keys), 20_000):
                part = list(keys)[k : k + 20_000]
                for key, places in zip(part, self.trie.within_all([w for w, _ in part], most, np.array([keys[x] for x in part]))):
                    self._learn(*key, [(self.trie.words[i], self.trie.counts[i]) for i in places])

    def misread(self, token: str, before: str = "", after: str = "") -> str | None:
        """The candidate that fits a token that is not well read best, between its neighbours; None for good ones."""
        low = token.lower()
        letters = sum(c.isalpha() for c in low)
        if letters < 2 and not (letters and len(low) <= 4 and re.search(r"[a-z|]", low)):
            return None
        if letters < len(low) and re.fullmatch(r"[\w.+-]*\d[\w.+-]*", low) and letters <= sum(c.isdigit() for c in low):
            return None
        parts = re.split(r"([-’'])", low)
        if len(parts) > 1 and low not in self.words:
            if whole := self._fitting(token, before, after):
                return whole
            fixed = [self.misread(p) if k % 2 == 0 and len(p) > 2 else None for k, p in enumerate(parts)]
            return "".join(f or p for f, p in zip(fixed, parts)) if any(fixed) else None
        return self._fitting(token, before, after)

    def _fitting(self, token: str, before: str, after: str) -> str | None:
        low = token.lower()
        own, signs = self.words.get(low, 0), any(c in _SIGNS for c in low)
        found = self.candidates(low, not token[0].islower() and not signs)
        if not found or own and found[0][0] < own:
            if len(self.fine) > 1_000_000:
                self.fine.clear()
            if low in self.words or not re.search(r"[-’']", low):
                self.fine.add(token)
            return None
        fits = [((1 + self.pairs.get((before, w), 0)) * (1 + self.pairs.get((w, after), 0)), n, w) for n, w in found]
        if own:
            fits = [x for x in fits if x[1] >= own]
        else:
            least = UNKNOWN if signs or token[0].islower() and len(low) >= 4 else UNKNOWN_NAME
            fits = [x for x in fits if x[0] * x[1] >= least]
        return max(fits, key=lambda x: (x[0] * x[1], x[2]))[2] if fits else None


def _is_title(line: str, width: float) -> bool:
    x = line.strip()
    return bool(x) and len(x) <= max(30, 0.8 * width) and len(re.findall(r"[^\W\d_]{2,}", x)) <= 8 and not re.search(r"[.!?:;,¬-]$|[.!?] [A-ZÀ-Þ]", x) and bool(re.match(r"[\"“(]?(?:\d+\s+|\W*)[^\W\d_a-zß-ÿ]", x)) and not re.match(r"\d+\.\d", x) and any(c.isalpha() for c in x)


_OTHER = re.compile(r"[\W\d_]+")
_DIGITS = str.maketrans("OoQIl|iSsBZz", "000111155822")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def page_number(line: str) -> tuple[int, bool] | None:
    """The number that a line shows and nothing else, and whether it is decorated; misread digits are understood."""
    x = line.strip()
    if m := PAGE_NUMBER.match(x):
        return int(m[1]), not x.isdigit()
    if m := re.fullmatch(r"\W*([ivxlc]{1,7})\W*", x):
        v = [_ROMAN[c] for c in m[1]]
        return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0])), x != m[1]
    if len(x) <= 16 and any(c.isdigit() for c in x) and re.fullmatch(r"(?:[Pp](?:age|\.)\s*)?[\W\dOoQIl|iSsBZz]+(?: of [\dOoQIl|iSsBZz]+)?", x):
        body = re.sub(r"^[Pp](?:age|\.)", "", x).replace(" of ", " / ").translate(_DIGITS)
        if m := PAGE_NUMBER.match(body):
            return int(m[1]), True
    return None


def _letters(line: str) -> str:
    return _OTHER.sub("", line.lower())


def furniture(pages: list[tuple[int | None, list[str]]]) -> list[dict[int, str]]:
    """Of each page of a file (its number, its lines): line index -> header or pageno, by recurrence and position."""
    zones, numbers = [], []
    for number, lines in pages:
        filled = [k for k, x in enumerate(lines) if x.strip()]
        top, bottom = filled[:3], [k for k in filled[-3:][::-1] if k not in filled[:3]]
        zones.append((top, bottom))
        for k in [*filled[:4], *filled[-3:]]:
            if (m := page_number(lines[k])) and number is not None:
                numbers.append(m[0] - number)
    offset, most = (Counter(numbers).most_common(1) or [(None, 0)])[0]
    filled_pages = sum(any(x.strip() for x in lines) for _, lines in pages)
    steady = most >= 2 and most >= 0.3 * filled_pages
    keys: list[Counter] = [Counter(), Counter()]
    for (_, lines), zone in zip(pages, zones):
        for side in (0, 1):
            for key in {key for k in zone[side] if len(key := _letters(lines[k])) >= 4 and not page_number(lines[k])}:
                keys[side][key] += 1
    repeated = [[k for k, n in keys[side].items() if n >= 2] for side in (0, 1)]
    similar: dict[tuple[int, str], bool] = {}

    def recurs(side: int, key: str) -> bool:
        if (side, key) not in similar:
            similar[side, key] = keys[side][key] >= 2 or any(abs(len(r) - len(key)) <= 3 and SequenceMatcher(None, key, r).ratio() >= 0.85 for r in repeated[side])
        return similar[side, key]

    out = []
    for (number, lines), zone in zip(pages, zones):
        found: dict[int, str] = {}
        filled = [k for k, x in enumerate(lines) if x.strip()]
        body = sorted(len(x.strip()) for x in lines if len(x.strip()) > 20)
        width = body[len(body) * 3 // 4] if body else 60
        for side in (0, 1):
            for place, k in enumerate(zone[side]):
                x, key = lines[k].strip(), _letters(lines[k])
                m = page_number(x)
                if m and (steady and number is not None and m[0] - number == offset or place == 0 and (m[1] and any(c.isdigit() for c in x) or not steady and len(pages) < 3 and x.isdigit())):
                    found[k] = "pageno"
                    continue
                same = len(key) >= 4 and recurs(side, key)
                if (same or _is_title(x, width)) and len(filled) > 1 and not re.search(r"[.!?]$", x) and not re.match(r"\d+\.\d+\s", x) and not re.match(r"[a-zß-ÿ]", x):
                    found[k] = "header"
                    continue
                if re.search(r"\w", x):
                    break
        out.append(found)
    return out


def _counts(pages: DataFrame) -> tuple[dict[str, int], dict[tuple[str, str], int]]:
    """The vocabulary and the frequent pairs of neighbours, each of at most 1 / SHARE entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for line in text.split("\n"):
                    words = WORD.findall(line.lower())
                    if words and line.rstrip().endswith(("-", "¬", "\u00ad", "‐")):
                        words.pop()
                    total.update(words)
                    total.update(f"{a} {b}" for a, b in zip(words, words[1:]))
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], ["w", "n"])

    counted = cut(pages.where("text is not null").select("text").mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")))
    whole = counted.where("instr(w, ' ') = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    kept = counted.where(F.col("n") >= max(LEAST_COUNT, SHARE * whole)).collect()
    words = {r.w: r.n for r in kept if " " not in r.w}
    return words, {tuple(r.w.split(" ")): r.n for r in kept if " " in r.w}


class _Page:
    def __init__(self, page_id: int, number: int | None, text: str | None):
        self.id, self.number = page_id, number
        self.lines = [x[:-1] if x.endswith("\r") else x for x in (text or "").split("\n")]
        self.noise: dict[int, set[str]] = defaultdict(set)


def _is_stray(line: str) -> bool:
    return bool(line.strip()) and not any(c.isalnum() for c in line)


def analyse(pages: list[_Page], reader: Reader) -> list[tuple[int, int]]:
    """Fills in the noise of all pages of a file; returns (page, line) of the body lines in reading order."""
    for page, found in zip(pages, furniture([(p.number, p.lines) for p in pages])):
        for k, kind in found.items():
            page.noise[k].add(kind)
        for k, x in enumerate(page.lines):
            if _is_stray(x) and k not in found:
                page.noise[k].add("ocr")
    body = [(n, k) for n, p in enumerate(pages) for k, x in enumerate(p.lines) if x.strip() and not p.noise.get(k)]
    joined: dict[tuple[int, int], str] = {}  # lines whose first token ends the word that the line before begins
    for at, (n, k) in enumerate(body):
        line = pages[n].lines[k]
        tokens = TOKEN.findall(line)
        if not tokens:
            continue
        first, last = (1 if (n, k) in joined else 0), len(tokens)
        if re.search(r"[^\W\d_][-¬\u00ad‐]\s*$", line):
            follow = next(((m, j) for m, j in islice(body, at + 1, None) if not re.search(r"\d\s*$", pages[m].lines[j]) or len(pages[m].lines[j]) > 50), None)
            right = TOKEN.match(pages[follow[0]].lines[follow[1]].lstrip()) if follow else None
            if right or not _SIGNS & set(tokens[-1]):
                last -= 1  # what is cut can't be looked up
            if right:
                left, r = tokens[-1].rstrip("-¬\u00ad‐"), right[0]
                whole, spelled = (left + r).lower(), f"{left}-{r}".lower()
                head = left.rsplit("-", 1)[-1].lower() + r.split("-")[0].lower()
                joined[follow] = left
                own, hyphened = max(reader.words.get(whole, 0), reader.words.get(head, 0)), reader.words.get(spelled, 0)
                if not r[0].isupper() and own >= hyphened and not (hyphened == own == 0 and reader.words.get(left.lower(), 0) and reader.words.get(r.lower(), 0) and reader.misread(whole) is None):
                    pages[n].noise[k].add("hyphen")
                    if not own and (guess := reader.misread(whole)):
                        if not guess.startswith(left.lower()):
                            pages[n].noise[k].add("ocr")
                        if not guess.endswith(r.lower()):
                            pages[follow[0]].noise[follow[1]].add("ocr")
        around = ["", *(t.lower() for t in tokens), ""]
        if any(tokens[i] not in reader.fine and reader.misread(tokens[i], around[i], around[i + 2]) for i in range(first, last)):
            pages[n].noise[k].add("ocr")
    return body


def _files(pages: DataFrame) -> DataFrame:
    return pages.where("page_id is not null").select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("doc_path", F.concat(F.lit("page:"), F.col("page_id").cast("string"))).alias("doc_path"), F.col("page_number").cast("int").alias("page_number"), "text")


def _by_file(pages: DataFrame, read: Callable[[str, list[_Page], Reader], list[tuple]], schema: str) -> DataFrame:
    """read() of the pages of every file, in order of page_id; files are taken together up to BATCH characters."""
    counts = _counts(pages)
    shared = pages.sparkSession.sparkContext.broadcast(counts)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files: list[tuple[str, list[_Page]]] = []
        held = 0

        def done() -> pd.DataFrame:
            reader = _reader(shared.value)
            reader.prepare(x for _, f in files for p in f for x in p.lines)
            return pd.DataFrame([x for path, f in files for x in read(path, f, reader)], columns=names)

        for batch in batches:
            for i, path, number, text in zip(batch["page_id"], batch["doc_path"], batch["page_number"], batch["text"]):
                if not files or files[-1][0] != path:
                    if held >= BATCH:
                        yield done()
                        files, held = [], 0
                    files.append((path, []))
                files[-1][1].append(_Page(int(i), None if pd.isna(number) else int(number), text))
                held += len(text or "")
        if files:
            yield done()

    return _files(pages).repartition("doc_path").sortWithinPartitions("doc_path", "page_id").mapInPandas(run, schema)


def noise(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, noise): each line per kind of noise: header, pageno, hyphen, ocr; line_no counts from 1.

    Reads page_id, doc_path, page_number and text; other columns, metadata too, are not trusted. Blank and null texts
    give no rows. A null doc_path makes a file of its own; pages of a file are ordered by page_id.
    """

    def read(_: str, file: list[_Page], reader: Reader) -> list[tuple]:
        analyse(file, reader)
        return [(p.id, k + 1, kind) for p in file for k, kinds in sorted(p.noise.items()) for kind in sorted(kinds)]

    return _by_file(pages, read, "page_id bigint, line_no int, noise string")


_readers: dict[int, tuple] = {}


def _reader(counts: tuple) -> Reader:
    """One reader for each vocabulary in a worker."""
    if id(counts) not in _readers or _readers[id(counts)][0] is not counts:
        _readers.clear()
        _readers[id(counts)] = (counts, Reader(*counts))
    return _readers[id(counts)][1]


def _repaired(line: str, reader: Reader) -> str:
    tokens = list(TOKEN.finditer(line))
    out, at = [], 0
    for k, m in enumerate(tokens):
        new = reader.misread(m[0], tokens[k - 1][0].lower() if k else "", tokens[k + 1][0].lower() if k + 1 < len(tokens) else "")
        out += [line[at : m.start()], m[0] if new is None else new.capitalize() if m[0][0].isupper() else new]
        at = m.end()
    return "".join(out) + line[at:]


def paragraphs(pages: DataFrame) -> DataFrame:
    """(doc_path, block, paragraph, first_page_id, text): continuous paragraphs of each file, across page ends.

    Cut words are joined, misread words replaced, headers, page numbers and stray marks left out. A paragraph ends at
    a blank line within a page; at a page's end it goes on unless a sentence ended there. Null and blank pages are
    passed by. A file is read as a whole, so its block is always 0.
    """
    def read(path: str, all_pages: list[_Page], reader: Reader) -> list[tuple]:
        body = analyse(all_pages, reader)
        out: list[list] = []
        previous: tuple[int, int] | None = None
        for n, k in body:
            page = all_pages[n]
            if page.noise.get(k, set()) & {"header", "pageno"}:
                continue
            line = page.lines[k].strip()
            new = previous is None or (previous[0] == n and any(not x.strip() for x in page.lines[previous[1] + 1 : k])) or previous[0] != n and re.search(r"[.!?…”]$", out[-1][1])
            if new:
                out.append([page.id, line])
            elif "hyphen" in all_pages[previous[0]].noise.get(previous[1], ()):
                out[-1][1] = out[-1][1][:-1] + line
            else:
                out[-1][1] += ("" if out[-1][1].endswith("-") else " ") + line
            previous = n, k
        return [(path, 0, i, p, _repaired(t, reader)) for i, (p, t) in enumerate(out)]

    return _by_file(pages, read, "doc_path string, block bigint, paragraph int, first_page_id bigint, text string")
