"""Template deduction over the pages of a site."""

import random

from conftest import rows

from corpuslane.llm import page_content
from corpuslane.llm.page_content import Page, is_main, main_slots, out_of_order, site_template, slot_keys, walk

SCHEMA = "url_id long, url string, title string, text string, html string"


def html(k, teasers, words):
    links = "".join(f"<div><a href='/{n}'>Other story number {n}</a></div>" for n in range(teasers))
    return (
        f"<html><body><div class='top'>The Site<br>Fine words daily.</div><section class='m'><h1>Head {k}</h1><p>{words[0]}</p><div class='ad'><div><a href='/'>Read also</a></div>{links}</div>"
        f"<p>{words[1]}</p><p>Subscribe to our letter now</p><ul><li><a href='/x{k}'>{words[2]}</a></li></ul></section><div class='note'><p>{random.choice(['We use cookies.', 'Accept our cookies.'])}</p></div></body></html>"
    )


def sentences(k):
    return [" ".join(random.choices([f"word{n}" for n in range(500)], k=9)) + "." for _ in range(3)]


def site(n):
    random.seed(n)
    return {f"https://a.example/{k:04}": html(k, k % 4, sentences(k)) for k in range(n)}


def text(page):
    return "\n".join(line.text for line in page.lines)


def test_lines_of_a_page():
    page = Page("<html><head><title>T</title><style>p{}</style></head><body><!-- <p>no</p> --><td id=c><p>a &amp; <b>b</b></p>x<br>y<pre>k = 1\n  z</pre></td><script>if (a<b) {}</script></p></body></html>")
    assert [line.text for line in page.lines] == ["a & b", "x", "y", "k = 1", "  z"]
    assert [line.box for line in page.lines] == ["html/body/td.c"] + ["html/body"] * 2 + ["html/body/td.c"] * 2
    assert not Page("").lines and not Page("<").lines[1:] and [x.text for x in Page("a < b").lines] == ["a < b"]


def test_classes_are_ordered_and_nested():
    pages = {u: Page(h) for u, h in site(12).items()}
    template = site_template(pages)
    assert template and not any(out_of_order(p, template) or walk(p, template)[1] for p in pages.values())
    sizes = {c: size for c, _, size in template.values()}
    assert len(sizes) >= 2 and max(sizes.values()) >= 20  # what every page has, and what repeats
    swapped = {u: Page(h if k % 2 else h.replace("The Site", "Site The")) for k, (u, h) in enumerate(site(12).items())}
    assert not any(out_of_order(p, site_template(swapped)) for p in swapped.values())


def test_slots_tell_the_main_body():
    pages = {u: Page(h) for u, h in site(12).items()}
    template = site_template(pages)
    filled = page_content.Slots()
    for p in pages.values():
        filled.add(p, slot_keys(p, template))
    slots = main_slots(filled.rows())
    for p in pages.values():
        main = [line.text for line, x in zip(p.lines, is_main(p, slot_keys(p, template), slots)) if x]
        assert len(main) == 4 and main[0].startswith("Head") and all(x.startswith("word") for x in main[1:])
    # without the template nothing is left to tell lines that every page has from content
    plain = page_content.Slots()
    for p in pages.values():
        plain.add(p, slot_keys(p, {}))
    assert any("Subscribe" in line.text for p in pages.values() for line, x in zip(p.lines, is_main(p, slot_keys(p, {}), main_slots(plain.rows()))) if x)


def test_site_of_600_pages_split_and_whole(spark, monkeypatch):
    items = [(k, u, f"Head {k}", text(Page(h)), h) for k, (u, h) in enumerate(site(600).items())]
    items += [(1000, items[7][1], *items[7][2:]), (1001, "https://a.example/z", None, items[3][3], None)]
    table = spark.createDataFrame(items, SCHEMA).repartition(4)
    whole = rows(page_content.main_lines(table))
    assert len([x for x in whole if x[0] == 7]) == 4 and [x[1] for x in whole if x[0] == 1000] == [x[1] for x in whole if x[0] == 7]
    monkeypatch.setattr(page_content, "MOST_CHARS", 10)
    assert rows(page_content.main_lines(table)) == whole
