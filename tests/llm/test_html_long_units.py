"""Repeated units of any length, and pages that are long, deep or both."""

import time

import pandas as pd
import pytest

from tessera.llm.common import Scratch
from tessera.llm.html_extract import Page, extract_pages, fold, stream

WORDS = "amber birch cedar delta ember fjord grove heath islet jetty knoll lagoon meadow north ocean pine quarry ridge shore tarn".split()


def unit(page, n, nodes):
    """A comment of `nodes` nodes about: a name, a text, and marks in between."""
    marks = "".join(f"<i class=m{k}></i>" for k in range(max(0, (nodes - 8) // 2)))
    return f"<div class=entry-{'x'}><b class=who>{WORDS[page]}{n}</b>{marks}<p>remark {WORDS[n]} of {WORDS[page]} {n * page}</p></div>"


def page(i, nodes, kind, units=3):
    story = f"<p>Story {WORDS[i]} begins here and tells of {WORDS[i + 4]} at some length, for the sake of it.</p><p>It ends with {WORDS[i + 8]}, as all of them do.</p>"
    thread = "<div class=talk>" + "".join(unit(i, n, nodes) for n in range(1, units + 1)) + "</div>"
    body = {"bare": f"<div class=story>{story}</div>{thread}", "article": f"<article>{story}{thread}</article>", "main": f"<main>{story}{thread}</main>"}[kind]
    return f"<html><body><nav><a href=/>Home</a></nav>{body}<footer>f</footer></body></html>"


@pytest.mark.parametrize("kind", ["bare", "article", "main"])
def test_comments_of_any_length_go(spark, kind):
    rows = [(1000 * nodes + i, f"http://h{nodes}.example/{i}", page(i, nodes, kind, 2 + i)) for nodes in (8, 14, 40, 200) for i in range(1, 5)]
    pages = spark.createDataFrame(pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    got = {r["page_id"]: r["text"] for r in extract_pages(spark, pages, Scratch(spark, "t")).collect()}
    for at, _, html in rows:
        assert "remark" not in got[at] and got[at].startswith("Story") and got[at].endswith("as all of them do."), (at, got[at])


@pytest.mark.parametrize("size", [8, 14, 40, 200])
def test_units_are_folded(size):
    nodes = [("tag", "open ul", ("ul", 1, False))]
    one = [("tag", "open li", ("li", 1, False)), *[("tag", f"open i m{k}", ("i", 1, False)) for k in range(size - 2)], ("tag", "close li", ("ul", 1, False))]
    found = fold(nodes + one * 5 + [("tag", "close ul", ("#root", 0, False))])
    assert [x[0] for x in found] == ["tag", "rep", "tag"] and found[1][1] == one
    outer = fold(nodes + (one * 2 + [("tag", "open hr", ("ul", 1, False))] + one * 3 + [("tag", "open br", ("ul", 1, False))]) * 4)
    assert [x[0] for x in outer] == ["tag", "rep"] and [x[0] for x in outer[1][1]] == ["rep", "tag", "rep", "tag"]


def plain_parts(page):
    texts = {}
    for c, t, link in page.pieces:
        while t.strip() and c > 0:
            if page.kind[c] not in ("article", "main", "body", "head"):
                x = texts.setdefault(page.key[c], [[], 0, 0, page.within[c]])
                x[0].append(" ".join(t.split()))
                x[1] += len(x[0][-1])
                x[2] += len(x[0][-1]) if link else 0
            c = page.parent[c]
    return {key: (tuple(x[0]), *x[1:]) for key, x in texts.items()}


def test_parts_tell_texts_apart_as_whole_texts_do():
    html = "".join(f"<div class=a><ul><li>{a}</ul><p>{b} <a href=x>{a}</a></p></div><section><div>{b}</div><div>{a}{b}</div></section>" for a in "xyx" for b in "uvu")
    numbers, texts = {}, {}
    for i in range(6):
        page = Page(html[i * 40 :])
        for key, text, *rest in page.parts():
            assert tuple(rest) == plain_parts(page)[key][1:]
            assert numbers.setdefault(plain_parts(page)[key][0], text) == text and texts.setdefault(text, plain_parts(page)[key][0]) == plain_parts(page)[key][0]


@pytest.mark.parametrize("html", ["<div>w" * 100_000, "<div>w" * 50_000 + "</p>" * 50_000, "<article>w" * 50_000, "<header>w" * 50_000 + "</div>" * 50_000])
def test_deep_pages_take_time_by_their_length(html):
    began = time.process_time()
    page = Page(html)
    page.parts()
    assert time.process_time() - began < 3
    page.text({k: t for k, t, *_ in page.parts()[:50]})
    stream(html[: 1 << 17])
    assert time.process_time() - began < 20
