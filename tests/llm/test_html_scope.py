"""Where a page's text lies: articles, main parts and neither; texts without blanks; quotes that never close. And every
page of the test tables against an independent reading of its article."""

import glob
import re
import time
from html.parser import HTMLParser

import pytest

from hopframe.llm import html_extract

LONG = "This is the text of the page and it is long enough to be of use to all of those who read it. " * 5
TEASER = "<article class=card><p>A teaser of the next story that is not of the text.</p></article>"
CHINESE = "这是一个没有空格的长段落它应该完整地保留下来因为它是这个页面的正文" * 12
FINNISH = "Tämä sivu kertoo suomalaisista metsistä joissa kasvaa mäntyjä kuusia koivuja sekä monia muita kasveja. " * 6


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<main><h1>Title here</h1><p>{LONG}</p>{TEASER}</main>", f"Title here {LONG.strip()}"),
        (f"<main><p>{LONG}</p></main>{TEASER}", LONG.strip()),
        (f"<main><h1>Outside</h1><article><p>{LONG}</p></article></main>", LONG.strip()),
        (f"<article><h1>First</h1><p>{LONG}</p></article><article><h2>Second</h2><p>A related story of a line or so.</p></article>", f"First {LONG.strip()}"),
        (f"<article><p>{LONG}</p></article><article><p>{LONG[:-95]}</p></article>", f"{LONG.strip()} {LONG[:-95].strip()}"),
        (f"<div><p>{LONG * 3}</p></div>{TEASER}", (LONG * 3).strip()),
        (f"<div>{CHINESE}</div>", CHINESE),
        (f"<nav><ul><li><a href=x>菜单</a></li></ul></nav><div>{CHINESE}</div><footer>版权所有</footer>", CHINESE),
        (f"<div>{FINNISH}</div><div>{FINNISH}</div>", f"{FINNISH.strip()} {FINNISH.strip()}"),
        (f"<article><p>{LONG}</p><div class='related-stories'><p>{LONG}</p></div></article>", LONG.strip()),
        (f"<article><p>{LONG}</p><h2>References</h2><ul><li><a href=x>A paper with a title that is long enough to be one</a></li></ul></article>", f"{LONG.strip()} References A paper with a title that is long enough to be one"),
        (f"<article><p>{LONG}</p><h2>Tags</h2><ul><li><a href=x>news</a></li><li><a href=y>more</a></li></ul></article>", LONG.strip()),
        (f"<article><p title='x>{LONG}</p><div class=\"cookie-banner\"><p>We use cookies on all of the pages.</p></div></article>", LONG.strip()),
        ("<article>" + "<b>" * 100 + "deep" + "</b>" * 100 + "<p>after</p></article>", "deep after"),
        ("<article>" + "<i>" * 100 + "a</b></i>b" + "<p>c</p></article>", "ab c"),
    ],
)
def test_scope(page, text):
    assert html_extract.main_text(page) == text


def test_unclosed_quotes_are_looked_for_once():
    for unit in ("<p a='x>", '<p a="x><p b=\'y>', "<a b=' ", "<b><i>"):
        start = time.time()
        html_extract.main_text(unit * 100_000)
        assert time.time() - start < 30


class Article(HTMLParser):
    """The text of the article, cut at every element that is no phrase."""

    PHRASE = {"b", "i", "em", "strong", "a", "br", "span", "u", "code", "sub", "sup", "small", "img"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.skip, self.out = 0, 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skip += tag in ("script", "style")
        if tag not in self.PHRASE:
            self.out.append("\0")

    def handle_endtag(self, tag):
        if tag not in self.PHRASE:
            self.out.append("\0")
        self.depth -= tag == "article"
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.out.append(data)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.1", "/root/testdata/sf0.01"])
@pytest.mark.skipif(not glob.glob("/root/testdata/sf0.1"), reason="needs the test tables")
def test_every_page_equals_its_article(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    rows = pages.select("page_id", "html").collect()
    assert len(got) == len(rows)
    for r in rows:
        parser = Article()
        parser.feed(r.html or "")
        parser.close()
        blocks = [re.sub(r"\s+", " ", b).strip() for b in "".join(parser.out).split("\0")]
        assert got[r.page_id] == " ".join(b for b in blocks if b), r.page_id
