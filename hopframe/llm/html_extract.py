"""HTML extraction by two-pass block rules.

A forward scanner cuts a page into blocks. The first pass decides each by its place (menus, headers, footers, forms,
notices, adverts, comments and the like are out), its link density, its stop-word density and its length. Short or
middling blocks stay undecided. The second pass gives each undecided block the label of its nearest decided neighbours.

Articles and the main part narrow a page to what holds its text: the articles, less those of under half the largest
one's text; or the main part, where what it holds outside articles is more than they do, with its articles under the
same rule; or neither, where the rest of the page holds over twice as much (articles of under half of it then still go). In them what stays undecided is text, and
lists of short links decide nothing but themselves and the heading above them. On a page without either and without any
block that the first pass takes, paragraphs and blocks with stop words are taken, and where there are none, all
undecided blocks. Stop words count only where they can be expected: not in a text without blanks between its words, and
not on a page in none of the languages that have a list.

Null and empty pages give an empty text. Pages are whole and independent, so repeated rows repeat their result. A page
of any length is one task's work, linear in its length whatever its markup: a tag with a quote that never closes ends at
its next `>`, and a tag without any later `>` is text. An empty table gives no rows. Other columns are not carried.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections import defaultdict
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.llm.common import table
from hopframe.llm.quality_rules import STOP_WORDS

_STOP = frozenset(w for line in STOP_WORDS for w in line.split())
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)?(\s*=\s*)?")
_VALUE = re.compile(r"[^\s>]*")
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Elements that hold no markup and no text of the page; the others' content is markup, but out of the text.
RAW = {"script", "style", "textarea", "iframe", "title", "xmp", "noembed", "noframes"}
OUT = set("nav footer aside form button select option menu dialog fieldset label input noscript template svg math object canvas audio video head datalist".split())
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: An element, what its start closes, and what stops the search for that.
_TABLE = ("table",)
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("td", "th", "tr"), _TABLE), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot"), _TABLE), "tfoot": (("thead", "tbody", "tfoot"), _TABLE), "body": (("head",), ("html",)),
}
_AROUND_P = ("table", "td", "th", "caption", "button", "object", "template")
#: Words of class, id and role that name a part outside the main text; words that may stand beside them in such a name.
HINTS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar menu nav navbar navigation"
    " breadcrumb breadcrumbs masthead footer comment comments commentlist reply replies disqus share sharing social related recommended newsletter subscribe subscription signup login popup"
    " modal overlay toolbar widget pagination pager contentinfo complementary search skip tags copyright legal disclaimer menubar dialog alertdialog form".split()
)
BESIDE = set(
    "area bar block bottom box button buttons container content form global group icons inner item items left link links list main message outer page panel post posts primary reader readers"
    " region right row secondary section sections site slot stories story articles news reads text thread top unit us user users wrap wrapper".split()
)
GOOD, BAD, OPEN = 1, 0, -1
LINKS, SHORT, LONG, DENSE, SPARSE = 0.5, 70, 200, 0.2, 0.08
#: Characters a word beyond which a text has no blanks between words; characters of a link that is no mere label.
UNBROKEN, TITLE = 20, 30


class Found(NamedTuple):
    """A block with text: characters in links, whether its place is out, its outermost article (0: none), whether it is
    in the main part, its kind."""

    text: str
    linked: int
    out: bool
    article: int
    main: bool
    heading: bool
    listed: bool
    paragraph: bool


def _named_out(value: str, hints: set[str]) -> bool:
    """Whether one of the names in a class, id or role is made of words that name an outer part."""
    for name in value.split():
        parts = [p.lower() for p in _PART.findall(name)]
        if any(p in hints for p in parts) and all(p in hints or p in BESIDE or p.isdigit() for p in parts):
            return True
    return False


def _placed_out(attributes: dict[str, str], in_article: bool) -> bool:
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _NO_DISPLAY.search(attributes.get("style", "")):
        return True
    hints = HINTS if in_article else HINTS | {"header"}
    return any(_named_out(attributes[k], hints) for k in ("class", "id", "role") if k in attributes)


class Scanner:
    """Reads a page once from left to right: pieces of text, start tags and end tags."""

    def __init__(self, page: str):
        self.page, self.unclosed = page, set()

    def _attributes(self, at: int) -> tuple[dict[str, str], int]:
        """The attributes of a tag and the place after its `>`, or -1 if it doesn't close."""
        page, n, out = self.page, len(self.page), {}
        while True:
            m = _ATTRIBUTE.match(page, at)
            at = m.end()
            if m[2] is not None:
                quote = page[at : at + 1]
                if quote in ("'", '"') and quote:
                    # a quote that was not found is not looked for again, so all tags together read the page once
                    end = -1 if quote in self.unclosed else page.find(quote, at + 1)
                    if end < 0:
                        self.unclosed.add(quote)
                        return out, -1
                    value, at = page[at + 1 : end], end + 1
                else:
                    v = _VALUE.match(page, at)
                    value, at = v[0], v.end()
            else:
                value = ""
            if m[1]:
                out.setdefault(m[1].lower(), _html.unescape(value) if "&" in value else value)
            if at >= n:
                return out, -1
            if page[at] == ">":
                return out, at + 1

    def tokens(self):
        """("text", text), ("start", name, attributes, closed) and ("end", name)."""
        page, n, at, since = self.page, len(self.page), 0, 0
        while True:
            lt = page.find("<", at)
            if lt < 0 or lt + 1 >= n:
                break
            c = page[lt + 1]
            if c == "!" or c == "?" or (c == "/" and not page[lt + 2 : lt + 3].isalpha()):
                if lt > since:
                    yield "text", page[since:lt]
                if page.startswith("<!--", lt):
                    # <!--> and <!---> are whole
                    end = lt + 5 if page.startswith("<!-->", lt) else page.find("-->", lt + 4) + 3
                    at = n if end < lt + 5 else end
                else:
                    end = page.find(">", lt + 2)
                    at = n if end < 0 else end + 1
                since = at
                continue
            m = _NAME.match(page, lt + 2 if c == "/" else lt + 1)
            if m is None or not m[0][0].isascii():
                at = lt + 1
                continue
            attributes, end = self._attributes(m.end())
            if end < 0:  # this tag ends at the next >
                end = page.find(">", m.end()) + 1
                if not end:
                    break
            if lt > since:
                yield "text", page[since:lt]
            name = m[0].lower()
            at = since = end
            if c == "/":
                yield "end", name
                continue
            closed = page[end - 2] == "/"
            yield "start", name, attributes, closed
            if name in RAW and not closed:
                # the content ends at the first end tag of the same name
                stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = since = stop.end() if stop else n
        if since < n:
            yield "text", page[since:]


def blocks(page: str) -> list[Found]:
    """The blocks of a page that have text."""
    out: list[Found] = []
    text: list[str] = []
    linked = 0
    # open elements: name, whether out, scope, whether a link, whether still open; and the places of each name
    stack: list[list] = []
    places: dict[str, list[int]] = defaultdict(list)
    blocks_at: list[int] = []  # places of the open elements that are not inline
    n_out = n_article = n_main = n_link = articles = 0
    kind = ""

    def flush() -> None:
        nonlocal linked
        if text:
            body = _SPACE.sub(" ", "".join(text)).strip()
            if body:
                heading = len(kind) == 2 and kind[0] == "h" and kind[1] in "123456"
                out.append(Found(body, linked, n_out > 0, articles if n_article else 0, n_main > 0, heading, bool(places["li"]), kind == "p"))
            text.clear()
        linked = 0

    def close(element: list) -> None:
        nonlocal n_out, n_article, n_main, n_link
        if element[2]:
            n_out -= element[1]
            n_article -= element[0] == "article"
            n_main -= element[0] == "main"
            n_link -= element[0] == "a"
            element[2] = False

    def pop_to(k: int) -> None:
        while len(stack) > k:
            element = stack.pop()
            places[element[0]].pop()
            if element[0] not in INLINE:
                blocks_at.pop()
            close(element)

    def last(names) -> int:
        return max((places[x][-1] for x in names if places[x]), default=-1)

    for token in Scanner(page).tokens():
        if token[0] == "text":
            s = token[1]
            s = _html.unescape(s) if "&" in s else s
            text.append(s)
            if n_link:
                linked += len(s)
            continue
        name = token[1]
        block = name not in INLINE and name not in RAW
        if block:
            flush()
        if token[0] == "end":
            if places[name]:
                k = places[name][-1]
                if block:
                    pop_to(k)
                elif not blocks_at or blocks_at[-1] < k:
                    pop_to(k)
                else:  # an inline element ends while a block in it stays open
                    close(stack[k])
            if block:
                kind = stack[-1][0] if stack else ""
            continue
        attributes, closed = token[2], token[3]
        if name in RAW or name in VOID:
            if name == "hr":
                pop_to(last(("p",)) if last(("p",)) > last(_AROUND_P) else len(stack))
            continue
        if name in IMPLIED:
            own, around = IMPLIED[name]
            k = min((places[x][-1] for x in own if places[x] and places[x][-1] > last(around)), default=-1)
            if k >= 0:
                pop_to(k)
        if block and (k := last(("p",))) > last(_AROUND_P):
            pop_to(k)
        if name == "a" and n_link:  # links don't nest
            close(stack[places["a"][-1]])
        main = name in ("html", "body", "article", "main")
        is_out = (main and "hidden" in attributes) or (name == "article" and _placed_out(attributes, True)) or (not main and (name in OUT or (name == "header" and not n_article) or _placed_out(attributes, n_article > 0)))
        if closed and name in ("svg", "math"):
            continue
        places[name].append(len(stack))
        if name not in INLINE:
            blocks_at.append(len(stack))
        stack.append([name, is_out, True])
        articles += name == "article" and not n_article
        n_out += is_out
        n_article += name == "article"
        n_main += name == "main"
        n_link += name == "a"
        if block:
            kind = name
    flush()
    return out


def _stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?") in _STOP for w in words) / len(words)


def _scope(found: list[Found]) -> tuple[bool, list[bool]]:
    """Whether articles or a main part narrow the page, and for each block whether it lies where the text is."""
    own = defaultdict(int)
    main = rest = 0
    for b in found:
        n = 0 if b.out else len(b.text) - min(b.linked, len(b.text))
        if b.article:
            own[b.article] += n
        elif b.main:
            main += n
        else:
            rest += n
    most = max(own.values(), default=0)
    kept = {k for k, n in own.items() if n and 2 * n >= most}
    held = sum(own[k] for k in kept)
    if main > held:
        kept, held = {k for k in kept if 2 * own[k] >= main}, main
        inside = [b.article in kept if b.article else b.main for b in found]
    else:
        inside = [b.article in kept for b in found]
    if not held or rest > 2 * held:
        return False, [not b.article or 2 * own[b.article] >= rest for b in found]
    return True, inside


def _languages(found: list[Found]) -> bool:
    """Whether the page's running text is in a language that has a list of stop words."""
    stop = n = 0
    for b in found:
        if not b.out and b.linked <= LINKS * len(b.text) and len(b.text) >= SHORT and not _unbroken(b.text):
            words = len(b.text.split())
            stop, n = stop + _stop_density(b.text) * words, n + words
    return not n or stop >= SPARSE * n


def _unbroken(text: str) -> bool:
    return len(text) > UNBROKEN * len(text.split())


def _first_pass(block: Found, scoped: bool, inside: bool, listed: bool) -> int:
    """listed: stop words can be expected."""
    if block.out or not inside:
        return BAD
    n = len(block.text)
    if block.linked > LINKS * n:
        return BAD if not scoped or (block.listed and block.linked < TITLE) else OPEN
    if n < SHORT:
        return OPEN
    stop = _stop_density(block.text) if listed and not _unbroken(block.text) else DENSE
    if stop >= DENSE:
        return GOOD if n > LONG or scoped else OPEN
    if scoped:
        return GOOD if stop >= SPARSE else OPEN
    return OPEN if stop >= SPARSE else BAD


def main_text(page: str | None) -> str:
    """The main text of a page; empty for null, and where no block is main text."""
    found = blocks(page or "")
    (scoped, inside), listed = _scope(found), _languages(found)
    label = [_first_pass(b, scoped, i, listed) for b, i in zip(found, inside, strict=True)]
    if not scoped and GOOD not in label:
        open_ = [i for i, x in enumerate(label) if x == OPEN]
        likely = [i for i in open_ if found[i].paragraph or _stop_density(found[i].text) >= DENSE]
        for i in likely or open_:
            label[i] = GOOD
    # in an article neither what is out of it nor a list of links says anything about the rest
    decided = [i for i, x in enumerate(label) if x == GOOD or (x == BAD and not scoped)]
    final = label[:]
    for i, x in enumerate(label):
        if x != OPEN:
            continue
        k = bisect_left(decided, i)
        before, after = decided[k - 1] if k else None, decided[k] if k < len(decided) else None
        if before is None and after is None:
            final[i] = GOOD if scoped else BAD
        elif before is None or after is None:
            final[i] = label[before if after is None else after]
        elif label[before] == label[after]:
            final[i] = label[before]
        elif found[i].heading:  # a heading belongs to what follows
            final[i] = label[after]
        else:
            final[i] = label[before] if i - before < after - i else label[after] if after - i < i - before else BAD
    if scoped:  # the heading of a list of links that goes, goes with it
        for i in range(len(found) - 1):
            after = found[i + 1]
            if found[i].heading and inside[i + 1] and final[i + 1] == BAD and not after.out and after.listed:
                final[i] = BAD
    return " ".join(b.text for b, x in zip(found, final, strict=True) if x == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page (page_id, url, html)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
