"""Text functions as Column -> Column expressions that stay in the JVM.

Character classes are written out, since engines differ in what they count as white space and as letters of a word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space of Unicode, with the separators among the control characters.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
TOKEN = r"[\p{L}\p{N}_\-]+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def _line_ends(text: Column) -> Column:
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    return F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", "")


def normalize_text(text: Column) -> Column:
    """One kind of line end, no control characters, single blanks, at most one blank line, stripped; null gives ''."""
    text = F.regexp_replace(F.regexp_replace(_line_ends(text), "\t", "    "), " +", " ")
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def normalize_text_kit(text: Column) -> Column:
    """Line ends, control characters and outer white space only."""
    return strip(_line_ends(text))


def sentences(text: Column) -> Column:
    """Sentences by the end marks . ! ? before white space, stripped, without blank ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda x: x != "")


def tokens(text: Column) -> Column:
    """Lower-cased maximal runs of letters, digits, underscores and hyphens; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}.\-_]", "_")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """The lower-cased extension of a path, with its dot; '' where there is none."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))


def word_count(text: Column) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, f"{SPACE}+")))


def url_domain(url: Column) -> Column:
    """Host of a URL with its port and user; '' where there is none."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))


def short_id(content: Column) -> Column:
    """First 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def excerpt(text: Column, length: int = 500) -> Column:
    """The first characters of a text, up to the last full stop in their second half, else with dots."""
    head = F.substring(text, 1, length)
    stop = F.length(head) - F.locate(".", F.reverse(head)) + 1
    cut = F.when((F.locate(".", head) > 0) & (stop - 1 > length // 2), F.substring(head, F.lit(1), stop)).otherwise(F.concat(head, F.lit("...")))
    return F.when(F.length(text) <= length, text).otherwise(cut)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def highlight(text: Column, query: Column, max_length: int = 300, context: int = 50) -> Column:
    """The passage of a text around the densest matches of a query's tokens.

    For each distinct token, in the query's order, the window of 100 characters before and after its first occurrence
    is scored by the number of distinct tokens in it; the first best one wins. The passage begins `context` characters
    before it and is cut at blanks where these are near. Null or '' texts give ''; without tokens, the text's beginning.
    """

    def passage(at: Column) -> Column:
        start = F.greatest(at - context, F.lit(0))
        return _let(F.struct(start.alias("start"), F.least(F.length(text), start + max_length).alias("end")), moved)

    def moved(x: Column) -> Column:
        """Both ends move to a blank that is at most 20 characters away."""
        start, end = x["start"], x["end"]
        ahead = F.instr(F.substring(text, start + 1, F.lit(20)), " ")
        back = F.instr(F.reverse(F.substring(text, end - 19, F.lit(20))), " ")
        begin = F.when((start > 0) & (ahead > 0), start + ahead).otherwise(start)
        stop = F.when((end < F.length(text)) & (back > 0), end - back).otherwise(end)
        return _let(F.struct(begin.alias("begin"), stop.alias("stop")), cut)

    def cut(x: Column) -> Column:
        begin, stop = x["begin"], x["stop"]
        inner = strip(F.substring(text, begin + 1, F.greatest(stop - begin, F.lit(0))))
        return F.concat(F.when(begin > 0, "...").otherwise(""), inner, F.when(stop < F.length(text), "...").otherwise(""))

    def best(x: Column) -> Column:
        low, words = x["low"], x["words"]

        def scored(w: Column) -> Column:
            return _let(F.call_function("instr", low, w), lambda at: F.struct(_let(F.substring(low, F.greatest(at - 101, F.lit(0)) + 1, at + 99 - F.greatest(at - 101, F.lit(0))), lambda win: F.size(F.filter(words, lambda v: F.contains(win, v)))).alias("score"), (at - 1).alias("at")))

        zero = F.struct(F.lit(0).alias("score"), F.lit(0).alias("at"))
        return F.aggregate(F.transform(words, scored), zero, lambda a, y: F.when((y["at"] >= 0) & (y["score"] > a["score"]), y).otherwise(a))["at"]

    marked = _let(_let(F.struct(F.lower(text).alias("low"), F.array_distinct(tokens(query)).alias("words")), best), passage)
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(F.coalesce(query, F.lit("")) == "", F.substring(text, 1, max_length)).otherwise(marked)
