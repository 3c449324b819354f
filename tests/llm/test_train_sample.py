"""The labeller's training sample does not depend on ids or on how many pages have html."""

import pytest

from weekcast.llm import html_blocks

PAGE = "<html><body><nav><ul><li>Home</li></ul></nav><article><p>Some words of page {} here.</p></article></body></html>"


@pytest.mark.parametrize("rows, pages", [
    ([(None, PAGE.format(i)) for i in range(200)], 5),
    ([(7, PAGE.format(i)) for i in range(200)], 5),
    ([(i, PAGE.format(i) if i in (50, 150) else None) for i in range(200)], 2),
    ([(i, PAGE.format(i) if i in (50, 150) else "<html></html>") for i in range(200)], 2),
    ([(1, PAGE.format(1))] * 200, 1)])
def test_sample_is_full(spark, monkeypatch, rows, pages):
    seen = []
    monkeypatch.setattr(html_blocks, "fit", lambda x, y: seen.append(len(x)))
    docs = spark.createDataFrame(rows, "page_id long, html string")
    html_blocks.train(docs, "html", "page_id", train_pages=5)
    assert seen == [(1 + html_blocks.COPIES) * pages]  # each page and its augmented copies
