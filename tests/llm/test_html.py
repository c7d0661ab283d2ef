"""The site style tree against an independent one built with an XML parser, and what it keeps and removes."""

import math
import xml.etree.ElementTree as ET
from collections import Counter, defaultdict

import pytest

from halocline.llm import html_extract


def site(n=14):
    """Pages without any telling names: a menu, a side box that varies a little, a notice inside the story, a repeated
    subheading, and stories of different shapes."""
    pages = []
    for i in range(n):
        story = "".join(f"<p>Paragraph {j} of story {i} says {i * 31 + j * 7} things at some length.</p>" for j in range(2 + i % 5))
        pages.append(
            "<html><body><div class='a'><p>Front page</p><p>World</p><p>Sports and more</p></div>"
            f"<div class='b'><h1>Story number {i}</h1>{story}<p>Sign up for our letter today.</p><h2>Summary</h2><p>In short: {i * 13}.</p></div>"
            f"<div class='c'><p>Most read of the week</p><p>Offer {i % 2}</p><h3>Follow us</h3></div></body></html>"
        )
    return pages


def want(i):
    paragraphs = [f"Paragraph {j} of story {i} says {i * 31 + j * 7} things at some length." for j in range(2 + i % 5)]
    return "\n".join([f"Story number {i}", *paragraphs, "Summary", f"In short: {i * 13}."])


def rows(pages, host="http://a.org/"):
    return [(i, f"{host}{i}", p) for i, p in enumerate(pages)]


@pytest.mark.parametrize("broadcast", [1 << 20, -1])
def test_the_tree_alone_removes_what_pages_share(spark, monkeypatch, broadcast):
    monkeypatch.setattr(html_extract, "LOW_BROADCAST", broadcast)
    data = rows(site()) + [(None, "http://a.org/0?copy", site()[0]), (3, "http://a.org/3", site()[3])]
    got = html_extract.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"] is None, r["page_id"] or 0, r["text"]) for r in got) == sorted((i is None, i or 0, want(i or 0)) for i, _, _ in data)
    # Without the tree nothing of it goes: no name tells.
    for p in site():
        assert "Sign up for our letter today." in html_extract.article_blocks(p) and "Most read of the week" in html_extract.article_blocks(p)


def brute(pages):
    """Node -> composite and (node, text) -> importance, by the definitions in the module's docstring."""
    texts, styles = defaultdict(set), defaultdict(lambda: defaultdict(set))
    for page in pages:
        root = ET.fromstring(page)
        all_blocks = []

        def walk(e, way, all_blocks=all_blocks):
            label = (e.tag, *sorted(e.get("class", "").split()))
            way = (*way, label)
            all_blocks.append((way, (e.text or "").strip(), tuple((c.tag, *sorted(c.get("class", "").split())) for c in e)))
            for c in e:
                walk(c, way)

        walk(root, ())
        key, size = (), sum(len(t) for _, t, _ in all_blocks)
        for t in sorted((t for _, t, _ in all_blocks), key=len, reverse=True):
            if sum(map(len, key)) >= 0.8 * size:
                break
            key += (t,)
        for way, text, style in all_blocks:
            styles[way][style].add(key)
            if text:
                texts[way, text].add(key)
    pages_of = {w: sum(len(k) for k in s.values()) for w, s in styles.items()}
    sure = lambda n: math.log(max(1, n * n / (n + html_extract.EVIDENCE)))
    importance = {k: 1 - sure(len(v)) / math.log(pages_of[k[0]]) if pages_of[k[0]] > 1 else 1.0 for k, v in texts.items()}
    composite = {}
    for w, s in styles.items():
        own = [(len(texts[k]) * len(k[1]), importance[k]) for k in texts if k[0][: len(w)] == w]
        if not own:
            continue
        content = sum(a * b for a, b in own) / sum(a for a, _ in own)
        m = pages_of[w]
        entropy = -sum(len(k) / m * math.log(len(k) / m) for k in s.values()) / math.log(m) if m > 1 else 1.0
        composite[w] = (1 - html_extract.DAMPING ** len(s)) * entropy + html_extract.DAMPING ** len(s) * content
    return composite, importance


def test_importances_equal_an_independent_tree(spark):
    pages = [*site(), site()[2]]
    composite, importance = brute(pages)
    html_extract.whole_text_batches(spark)
    df = spark.createDataFrame(rows(pages), "page_id long, url string, html string")
    parsed = df.mapInArrow(html_extract._parse, f"id long, url string, {html_extract.PARSED}")
    nodes, texts = html_extract.importances(parsed)
    # The root above <html> is the module's own.
    extra = Counter(round(r["composite"], 9) for r in nodes.collect()) - Counter(round(x, 9) for x in composite.values())
    assert sum(extra.values()) == 1 and nodes.count() == len(composite) + 1
    shared = [v for k, v in importance.items()]
    assert not Counter(round(r["importance"], 9) for r in texts.collect()) - Counter(round(x, 9) for x in shared)


def test_long_deep_and_broken_pages(spark):
    deep = "<div>" * 3000 + "core" + "</div>" * 3000
    long = "<article>" + "".join(f"<p>{i} words of a very long page</p>" for i in range(20000)) + "</article>"
    data = [(0, None, deep), (1, "http://b.org/", long), (2, "http://b.org/", None), (3, "x", "<p>a<nav>menu</p>b"), (4, "http://b.org/", long)]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(data, "page_id int, url string, html string")).collect()}
    assert got[0]["text"] == "core" and got[2]["text"] == "" and got[3]["text"] == "a"
    assert got[1]["text"] == got[4]["text"] == "\n".join(f"{i} words of a very long page" for i in range(20000))
    assert got[1]["n_chars"] == len(got[1]["text"])


def test_few_pages_prove_nothing(spark):
    """A paragraph of two stories of a small site stays."""
    pages = [f"<body><div><p>Story {i} has its own words here.</p><p>The same quote in both.</p></div></body>" for i in range(2)]
    got = html_extract.extract(spark.createDataFrame(rows(pages), "page_id long, url string, html string")).collect()
    assert all(r["text"].endswith("The same quote in both.") for r in got)
