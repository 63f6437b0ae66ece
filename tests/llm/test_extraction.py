import html
import re

import numpy as np
import pytest

from shipwatch.llm import boosting
from shipwatch.llm import extraction as X
from tests.conftest import SF_SMALL

SCHEMA = "page_id long, url string, html string"


def article(source):
    """What the test pages mark as their article, by a plain pattern."""
    m = re.search(r"<article>(.*?)</article>", source or "", re.S)
    parts = re.split(r"</?(?:p|h1)[^>]*>", m.group(1)) if m else []
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]
    return "\n".join(p for p in parts if p)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF_SMALL}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return X.learned(pages)


def test_all_pages_of_the_table(pages, model):
    rows = {r.page_id: r.html for r in pages.collect()}
    for r in X.extracted(pages, model).collect():
        assert r.text == article(rows[r.page_id]) and r.n_chars == len(r.text)


SENTENCES = "Long sentences of plain prose, with commas and stops, carry the text of the page. " * 4
OTHER = f"""<!doctype html><HTML><head><title>No</title><body class=home>
<div id="topMenu"><a href=1>Home</a> <a href=2>News</a> <a href=3>More</a></div>
<div class="cookie-notice">We use cookies, as everyone does. <button>OK</button></div>
<div class=story><h2>A &amp; B&nbsp;C</h2><p>{SENTENCES}<p>{SENTENCES}<b>bold</b>face<br>next
<script>if (a < b) document.write("<p>no</p>")</script><!-- <p>hidden</p> -->
<p>{SENTENCES} 1 < 2 <form><label>Name</label><select><option>x</select></form></div>
<div class="comments"><p>Great text! I agree with it, and so on.</p></div>
<div class="footer-links"><a>Legal</a> <a>About</a></div></body></html>"""


def test_pages_without_article_marks(model):
    page = X.Page(OTHER)
    text = page.text(X.decoded(page.parent, model.probability(page.features())))
    assert "plain prose" in text and "boldface next" in text and "1 < 2" in text
    for word in ("Home", "cookies", "OK", "no</p>", "document", "hidden", "agree", "Legal", "Name", "No\n"):
        assert word not in text, word


@pytest.mark.parametrize("source", ["", "plain", "<", "<<<>>>", "</p></div>", "<p", "<p class='x", "<!-- open", "<script>var a", "<a " * 500,
                                    "<div>" * 3000, "&lt;&#x41;&bogus;&#0;", "<p>" + "x " * 200000, "<table><tr><td>a<td>b<tr><td>c</table>"])
def test_odd_markup(source, model):
    page = X.Page(source)
    x = page.features()
    assert x.shape == (len(page.parent), len(X.FEATURES)) and np.isfinite(x).all()
    page.text(X.decoded(page.parent, model.probability(x)))


def test_blocks_and_references():
    page = X.Page("<p>a<b>b</b> &eacute;&#8364;\n\t c<br>d</p>tail<div>x<p>y</div><ul><li>1<li>2</ul>")
    assert page.text(np.ones(len(page.parent), bool)) == "ab é€ c d\ntail\nx\ny\n1\n2"


def test_decoding_is_the_best_consistent_labelling():
    rng = np.random.default_rng(1)
    for _ in range(40):
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, 9)]
        p = rng.uniform(0.05, 0.95, 9)

        def value(keep):
            return sum(np.log(p[i] if k else 1 - p[i]) for i, k in enumerate(keep))
        fits = [k for k in ([bool(n >> i & 1) for i in range(9)] for n in range(512)) if all(not k[i] or k[parent[i]] for i in range(1, 9))]
        assert abs(value(X.decoded(parent, p)) - max(map(value, fits))) < 1e-9


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = boosting.fit(x[:2000], y[:2000])
    assert ((trees.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert boosting.fit(x[:50], np.ones(50)).probability(x).min() > 0.9


def test_edges(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>x"), (4, "u", "<article><p>y"), (4, "u", "<article><p>y")]
    table = spark.createDataFrame([(*r, "t", 1) for r in rows], SCHEMA + ", text string, n_chars int")
    got = [tuple(r) for r in X.main_text(table).collect()]
    assert sorted(got, key=str) == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "u", "x", 1), (4, "u", "y", 1), (4, "u", "y", 1)], key=str)
    assert X.main_text(spark.createDataFrame([], SCHEMA)).collect() == []
    rule = X.extracted(spark.createDataFrame([(1, "u", "<p>text</p><div class=ad>no</div>")], SCHEMA), None).collect()
    assert rule[0].text == "text"


@pytest.mark.parametrize("part", ['<div class="panel hidden md:block">', '<section title="The hidden costs of X">', '<div data-note="a hidden gem">',
                                  "<section hidden>", '<div aria-hidden="true">', "<div style='color:red; display: none'>", "<div title='class=ad'>"])
def test_article_parts_that_mention_hidden_stay(part, model):
    end = part[1:].split()[0].rstrip(">")
    page = X.Page(f"<article><p>{SENTENCES}</p>{part}<p>{SENTENCES}Inner.</p></{end}><p>Let <math><mi>x</mi>=<mn>2</mn></math> be "
                  f"<video src=a>no film</video>shown.</p></article><nav>Home</nav>")
    text = page.text(X.decoded(page.parent, model.probability(page.features())))
    assert text.split("\n") == [SENTENCES.strip(), SENTENCES + "Inner.", "Let x=2 be no filmshown."]


def test_attributes_are_read_by_name():
    got = X.attributes_of(""" a=1 HIDDEN class='x "y"' title="id=z hidden" class=w data-a = "b" /""")
    assert got == {"a": "1", "hidden": "", "class": 'x "y"', "title": "id=z hidden", "data-a": "b"}
    assert len(X.attributes_of("a='" * 50_000 + "b=\"" * 50_001)) > 0


def test_few_marked_pages_are_all_sampled(spark):
    rows = [(k, "u", f"<div class=story><p>{SENTENCES}</p></div><div class=menu>Menu {k}</div>") for k in range(2000)]
    rows += [(5000 + k, "u", f"<nav>Menu</nav><article><p>{SENTENCES}</p><p>More, {k}.</p></article><footer>Foot</footer>") for k in range(4)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert X.learned(table, 20) is not None
