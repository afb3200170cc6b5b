"""Extraction with trees from the given pages, on articles in markup that these pages don't have."""

from __future__ import annotations

import html
import os
import random
import re
import time

import pytest

from kerbside.llm import html_extract as H

PAGES = "/root/testdata/sf0.1/pages.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(PAGES), reason="needs the given tables")
ARTICLE = re.compile(r"<article>(.*)</article>", re.S)
NOT = "zznot"


@pytest.fixture(scope="module")
def given():
    import pyarrow.parquet as pq

    rows = sorted(pq.read_table(PAGES, columns=["html"])["html"].to_pylist())
    random.Random(5).shuffle(rows)
    return H.train([x[: H.LONGEST] for x in rows[: H.SAMPLE]]), rows[H.SAMPLE : H.SAMPLE + 40]


def parts(body: str) -> list[str]:
    return re.split(r"<p>", re.sub(r"</p>|</?b>|<br>", "", body))


COMMENTS = f"<p>{NOT} I liked this a lot, thanks for writing it.</p><p>{NOT} No, I did not like it.</p>"
MARKUPS = {
    "as given": lambda b: f"<article>{b}</article>",
    "heading before a story": lambda b: parts(b)[0] + "<div class=story>" + "".join(f"<p>{x}</p>" for x in parts(b)[1:]) + "</div>",
    "content": lambda b: f'<div class="content">{b}</div>',
    "divs": lambda b: "<div>" + "".join(f"<div>{x}</div>" for x in parts(b)) + "</div>",
    "line breaks": lambda b: "<div>" + "<br><br>".join(parts(b)) + "</div>",
    "nested": lambda b: f"<main><div id=x1><div>{b}</div></div></main>",
    "aside": lambda b: f"<article>{b}<aside><p>{NOT} See this as well.</p></aside></article>",
    "comments within": lambda b: f'<article>{b}<div class="comments">{COMMENTS}</div></article>',
    "hidden parts": lambda b: f"<article>{b}<template><p>{NOT}</p></template><noscript>{NOT}</noscript></article>",
    "form": lambda b: f"<article>{b}<form><label>{NOT} Mail</label><input name=q><button>{NOT} Go</button></form></article>",
    "replies after": lambda b: f"<article>{b}</article><section class=replies>{COMMENTS}</section>",
    "share list": lambda b: f'<article>{b}<ul class="share"><li><a href=x>{NOT} Share</a></li><li><a href=y>{NOT} Mail</a></li></ul></article>',
}


@pytest.mark.parametrize("name", MARKUPS)
def test_markups(given, name):
    model, pages = given
    texts = H.extract(model, [ARTICLE.sub(lambda m: MARKUPS[name](m[1]), page) for page in pages])
    wanted = found = 0
    for page, text in zip(pages, texts, strict=True):
        own, flat = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in parts(ARTICLE.search(page)[1])[1:]], " ".join(text.split())
        wanted += len(own)
        found += sum(x in flat for x in own)
        assert NOT not in text
    assert wanted > 50 and found >= 0.95 * wanted


STORY = "The river rose in the night, and by morning the lower fields were under water. Nobody had seen that before, though the old ones spoke of it."


@pytest.mark.parametrize("article", ["<article>{}</article>", '<div class="content">{}</div>', "<div class=story>{}</div>", '<article>{}</article><div class="comments"><p>zznot I liked it.</p></div>', "<article>{}<aside>zznot</aside></article>"])
def test_small_pages(given, article):
    page = f'<html><body><nav><a href="/">Home</a></nav>{article.format(f"<p>{STORY}</p>" * 6)}<footer>Site</footer></body></html>'
    assert H.extract(given[0], [page]) == ["\n".join([STORY] * 6)]


@pytest.mark.parametrize("tag", ["div", "b", "p", "li", "svg", "template", "table", "td"])
def test_open_tags_take_linear_time(tag):
    """Twice as many open elements take about twice as long; with the square of the depth it would be four times."""

    def seconds(n: int) -> float:
        began = time.process_time()
        assert len(H.Page(f"<{tag}>" * n + "x" + f"</{tag}>" * (n // 2)).tags) > n // 2
        return time.process_time() - began

    seconds(1000)
    few, many = (min(seconds(n) for _ in range(3)) for n in (25_000, 100_000))
    assert many < 10 * few
