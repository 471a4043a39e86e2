"""HTML to text and the parts of a page, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslane.functions.text import strip

#: Elements that begin a line (fixed values).
_CORE_BREAKS, _WEB_BREAKS = "p|div|br|h[1-6]|li|tr", "p|div|br|h[1-6]|li|tr|section|article"
#: Entities, decoded in this order (fixed values).
_CORE_ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))
_WEB_ENTITIES = (*_CORE_ENTITIES, ("&#39;", "'"), ("&apos;", "'"))

#: Patterns of page parts (fixed values).
BLANK_LINES = r"\n\s*\n"
TITLE, HEADING = r"(?is)<title[^>]*>(.*?)</title>", r"(?is)<h1[^>]*>(.*?)</h1>"
META = r"""(?i)<meta\s+[^>]*(?:{attribute})=["'](?:{name})["'][^>]*content=["']([^"']*)["']"""
LINK, NO_LINK = r"""(?i)<a\s+[^>]*href=["']([^"'#]+)["']""", r"^(?:javascript:|mailto:|tel:)"
IMAGE, NO_IMAGE = r"""(?i)<img\s+[^>]*src=["']([^"']+)["']""", r"^data:"


def _to_text(html: Column, dropped: str, comments: bool, breaks: str, entities: tuple) -> Column:
    t = F.coalesce(html, F.lit(""))
    for tag in dropped.split():
        t = F.regexp_replace(t, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    if comments:
        t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, rf"(?i)<(?:{breaks})[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for old, new in entities:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.regexp_replace(t, " +", " ")


def extract_html(html: Column) -> Column:
    """Text of a page; blank lines are run together. Null gives ''."""
    return strip(F.regexp_replace(_to_text(html, "script style", True, _CORE_BREAKS, _CORE_ENTITIES), BLANK_LINES, "\n\n"))


def web_clean_html(html: Column) -> Column:
    """Text of a scraped page: more elements dropped and broken at, more entities; blank lines are run together."""
    return strip(F.regexp_replace(F.regexp_replace(_to_text(html, "script style noscript", True, _WEB_BREAKS, _WEB_ENTITIES), BLANK_LINES, "\n\n"), r"\n{3,}", "\n\n"))


def email_html_to_text(html: Column) -> Column:
    return strip(F.regexp_replace(_to_text(html, "script style", False, _CORE_BREAKS, _CORE_ENTITIES), BLANK_LINES, "\n\n"))


def html_title(html: Column) -> Column:
    """Text of the first title element, without tags inside it; '' where there is none."""
    return strip(F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), TITLE, 1), r"<[^>]+>", ""))


def web_title(html: Column) -> Column:
    """The title element, else the first h1 element; an empty title still counts."""
    h = F.coalesce(html, F.lit(""))
    return web_clean_html(F.when(h.rlike(TITLE), F.regexp_extract(h, TITLE, 1)).otherwise(F.regexp_extract(h, HEADING, 1)))


def meta(html: Column, name: str, attribute: str = "name") -> Column:
    """Content of a meta element whose attribute (a pattern: name, property or both) comes before its content, stripped.

    Null where there is none, or an empty one.
    """
    found = strip(F.regexp_extract(F.coalesce(html, F.lit("")), META.format(attribute=attribute, name=name), 1))
    return F.when(found == "", None).otherwise(found)


def _absolute(url: Column, base: Column) -> Column:
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_extract(base, r"^[^?#]*", 0), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/]*/(?:.*/)?)", 1)
    folder = F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder)
    return (
        F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), url)
        .when(url.startswith("//"), F.concat(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*:", 0), url))
        .when(url.startswith("/"), F.concat(root, url))
        .otherwise(F.concat(folder, url))
    )


def _values(html: Column, pattern: str, bad: str, base: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda x: ~x.rlike(bad)), lambda x: _absolute(x, base))))


def links(html: Column, base: Column) -> Column:
    """Sorted distinct targets of links, made absolute; without fragments, scripts, mail and telephone links."""
    return _values(html, LINK, NO_LINK, base)


def images(html: Column, base: Column) -> Column:
    return _values(html, IMAGE, NO_IMAGE, base)
