"""The block labeller on markup without ``article``: F1 of blocks, fallbacks, odd and long pages."""

import html
import re
import time

import pytest

from weekcast.llm import html_blocks as hb

SF = "/root/testdata/sf0.01"


def want(page):
    """The blocks of the given pages' article, by its literal markup."""
    inner = page.split("<article>")[1].split("</article>")[0]
    parts = [" ".join(html.unescape(re.sub("</?b>", "", x).replace("<br>", " ")).split())
             for x in re.split("</?(?:p|h1)>", inner)]
    return {x for x in parts if x}


def f1(texts, wanted):
    got = [set(t.split("\n\n")) - {""} for t in texts]
    both = sum(len(a & b) for a, b in zip(got, wanted))
    return 2 * both / (sum(map(len, got)) + sum(map(len, wanted)))


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()]


def trained(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    return hb.train(df, "html", "page_id")


@pytest.mark.parametrize("opened,closed", [
    ('<div class="content">', "</div>"), ('<div id="x">', "</div>"), ("<div>", "</div>"),
    ("<table><tr><td>", "</td></tr></table>"), ("", "")])
def test_pages_that_name_no_article(spark, pages, opened, closed):
    other = [p.replace("<article>", opened).replace("</article>", closed) for p in pages]
    weights = trained(spark, other[:120])  # not one article or main in the sample
    score = f1(hb.extract_batch(other[120:], weights), [want(p) for p in pages[120:]])
    print(opened or "plain", round(score, 4))
    assert score > 0.95


def test_weights_of_article_pages_read_other_markup(spark, pages):
    weights = trained(spark, pages[:120])
    rest, wanted = pages[120:], [want(p) for p in pages[120:]]
    assert f1(hb.extract_batch(rest, weights), wanted) == 1
    for opened, closed in (('<div class="post-body">', "</div>"), ('<div id="x">', "</div>"), ("<section>", "</section>")):
        other = [p.replace("<article>", opened).replace("</article>", closed) for p in rest]
        assert f1(hb.extract_batch(other, weights), wanted) > 0.98


def test_plain_pages_without_menus(spark):
    text = "This is a plain sentence with number {} and enough words to be read as prose."
    plain = ["<html><body>" + "".join(f"<p>{text.format(10 * k + i)}</p>" for i in range(6)) + "</body></html>"
             for k in range(40)]
    weights = trained(spark, plain)
    assert weights is not None
    assert [t.count("\n\n") for t in hb.extract_batch(plain, weights)] == [5] * 40


def test_nothing_counts_as_main(spark):
    """Without a positive label nothing is fitted: all but boilerplate is text."""
    few = [f"<html><body><nav><ul><li>Home</li></ul></nav><div>short {i}</div></body></html>" for i in range(20)]
    weights = trained(spark, few)
    assert weights is None
    assert hb.extract_batch(few[:1], weights) == ["short 0"]
    assert hb.extract_batch([None, ""], weights) == ["", ""]


def test_formulas_stay_in_their_block(spark, pages):
    weights = trained(spark, pages[:120])
    page = pages[0].replace("<p>", "<p>The sum <math><mi>a</mi><mo>+</mo><msup><mi>b</mi><mn>2</mn></msup></math> is known. ", 1)
    assert "The sum a+b2 is known." in hb.extract_batch([page], weights)[0]
    page = pages[0].replace("<p>", "<p><object data='x'>An object's words are text.</object> ", 1)
    assert "An object's words are text." in hb.extract_batch([page], weights)[0]


def test_labels():
    root = hb.Node()

    def label(markup):
        blocks = hb.blocks_of(markup, root)
        return dict(zip([t for _, t, _ in blocks], hb.page_labels(blocks, {"Often seen"})))

    long = "a sentence of more than ten words that stands in the page."
    assert label(f"<nav>menu</nav><div><h1>Title</h1><p>{long}</p><p>Short</p></div><div>Often seen</div>") == {
        "menu": 0, "Title": 1, long: 1, "Short": 1, "Often seen": 0}
    assert label(f"<article><p>in</p><aside>no</aside></article><div><p>{long}</p></div>") == {"in": 1, "no": 0, long: -1}
    assert label(f"<div><p><a href='x'>{long}</a></p></div>") == {long: 0}
    assert label("<header><h1>a</h1></header><main><header>b</header><p>c</p></main>") == {"a": 0, "b": 1, "c": 1}
    assert label("<div>a</div>") == {"a": -1} and label("") == {}


def test_deep_and_long_pages():
    def seconds(page):
        start = time.perf_counter()
        blocks = hb.blocks_of(page)
        hb.vectors(blocks)
        return time.perf_counter() - start, len(blocks)

    for make in (lambda n: "<div>x" * n, lambda n: "<foo>x" * n + "</bar>" * n, lambda n: "<p>x<li>" * n,
                 lambda n: "<div class='a b'>" * n + "x" + "</div>" * n):
        small, large = seconds(make(5_000)), seconds(make(50_000))
        assert large[0] < 30 * max(small[0], 0.05), (small, large)
    assert seconds("<div>x" * 50_000)[1] == 50_000


def test_a_batch_of_long_pages_is_read_in_parts(monkeypatch):
    seen = []
    monkeypatch.setattr(hb, "_labelled", lambda blocks, w: seen.append(sum(map(len, blocks))) or [""] * len(blocks))
    assert len(hb.extract_batch(["<p>a" * 10_000] * 8, None)) == 8
    assert sum(seen) == 80_000 and max(seen) <= 2 * hb.CELLS
    rng = __import__("numpy").random.default_rng(0)
    weights = hb._new_weights(rng)
    alone = hb.main_scores(weights, [hb.vectors(hb.blocks_of("<p>a" * 300))])
    many = hb.main_scores(weights, [hb.vectors(hb.blocks_of("<p>a" * n)) for n in (300, 20_000, 3)])
    assert abs(alone[0] - many[0]).max() < 1e-5 and [len(x) for x in many] == [300, 20_000, 3]
