import html as H
import itertools
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from assayer.llm import html_tree as X, queries

from ..conftest import SMALL


@pytest.fixture(scope="module")
def model():
    return X.train(X.labelled_pages())


def test_held_out_accuracy(model):
    right = total = pages = whole = 0
    for page in X.labelled_pages(200, seed=99):
        parsed = X.Page.of(page)
        content = model.marginals(parsed)
        hits = [(content[k] >= 0.5) == (parsed.nodes[k].label == X.CONTENT) for k, _ in parsed.texts]
        right, total = right + sum(hits), total + len(hits)
        pages, whole = pages + 1, whole + all(hits)
    assert right / total > 0.985 and whole / pages > 0.85


def test_marginals_match_enumeration(model):
    html = ('<body><nav><a href="/">a b</a></nav><div class="post"><h1>Title</h1><p>Some '
            'text here.<div class="ad">buy</div></div>end')
    page = X.Page.of(html)
    n = len(page.nodes)
    sums = [0.0] * n
    total = 0.0
    for labels in itertools.product(range(3), repeat=n):
        p = model.first[labels[0]]
        for k, node in enumerate(page.nodes):
            p *= math.exp(sum(model.seen[e][labels[k]] for e in X.evidence(node)
                              if e in model.seen))
            if k:
                p *= model.below[labels[node.parent]][labels[k]]
        total += p
        for k in range(n):
            sums[k] += p * (labels[k] == X.CONTENT)
    assert model.marginals(page) == pytest.approx([s / total for s in sums], abs=1e-9)


def test_layouts(model):
    article = ("<h1>A title</h1><p>First &amp; <b>bold</b>\n text&nbsp;here.<p>Second <a "
               "href=x>link</a> one.</p><ul><li>one item here.</li><li>two</ul>")
    want = "A title\nFirst & bold text here.\nSecond link one.\none item here.\ntwo"
    around = ("<nav><ul><li><a href=/>Home</a></ul></nav><div class=cookie-notice>We use "
              "cookies.</div>",
              "<aside class=sidebar><ul><li><a href=/z>Other</a></ul></aside><section "
              "class=comments><div class=comment>Nice text, I like it.</div></section><form "
              "class=login><label>Name</label><input></form><footer>&copy; me</footer>")
    for tag in ("article", 'div class="post-content"', "main"):
        end = tag.split()[0]
        page = (f"<html><head><title>t</title><style>p{{}}</style></head><body>{around[0]}"
                f"<script>var t='</p>';</script><{tag}>{article}</{end}>{around[1]}")
        assert model.text(page) == want, tag


def test_odd_pages(model):
    for page in ("", None, "<", "<p", "<!-- x", "<script>a", "</p></div>", "<![CDATA[x]]>",
                 "<html><head><title>x", "<?php x ?>"):
        assert isinstance(model.text(page), str)
    deep = "<div>" * 5000 + "<p>some words in here.</p>"
    assert isinstance(model.text(deep), str)
    assert model.text("<article><p>" + "word " * 100_000 + "</article>").count("word") == 100_000


def test_fragments_never_fail(model):
    pick = random.Random(7)
    pieces = ("<", ">", "</", "<!", "<![", "]]>", "<!--", "-->", "<?", "<p>", "</p>", "<div class=",
              "'", '"', "a", " ", "&", "&amp", "&#", "x;", "<li>", "<table>", "<td>", "</table>",
              "<script>", "</script>", "<![CDATA[", "<![if !IE]>", "<![endif]>", "<!doctype",
              "</head>", "<head>", "<title>", "\n", "é", "words in here.", "<a href=", "/", "[")
    for _ in range(10_000):
        page = "".join(pick.choices(pieces, k=pick.randrange(1, 25)))
        assert isinstance(model.text(page), str), page
    page = X.Page.of("<p>before it. <![foo[ y ]]> after it.</p>")
    assert [t for _, t in page.texts] == ["before it. after it."]


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "<p>some words in here.</p>", "<div>some</span></em></p>" * 20_000,
    "<div>" * 100_000 + "</p></section>" * 100_000, "<p><li>" * 50_000, "<td>" * 100_000,
    "<div>" * 50_000 + "</div>" * 50_000])
def test_deep_pages_take_linear_time(page):
    start = time.process_time()
    html_page = X.Page.of(page)
    assert time.process_time() - start < 6 and html_page.nodes


def plain(page):
    """The article of the test pages, by their known layout."""
    inner = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    blocks = re.split(r"</?(?:h1|p)>", inner)
    texts = [" ".join(H.unescape(re.sub(r"<(?:/?b|br)>", " ", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_query_against_known_layout(spark):
    rows = {r.page_id: r for r in queries.queries()["op5_html_tree"](spark, SMALL).collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for r in pages:
        assert rows[r.page_id].text == plain(r.html), r.page_id
        assert rows[r.page_id].n_chars == len(rows[r.page_id].text)


def test_columns(spark, model):
    df = spark.createDataFrame([(1, None), (2, "<p>Some words.</p>"), (2, "")],
                               "page_id long, html string").withColumn("text", F.lit("clash"))
    rows = sorted((r.page_id, r.n_chars, r.text) for r in X.extract(df, model=model).collect())
    assert rows == [(1, 0, ""), (2, 0, ""), (2, 11, "Some words.")]
    assert X.extract(df.limit(0), model=model).count() == 0
