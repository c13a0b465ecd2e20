"""Main text of web pages by tree scoring: paragraphs pass points to their ancestors, and the best container is kept."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, elements whose content is no markup, and elements that break a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_PARAGRAPH = BLOCK - {"br", "body", "html", "head", "caption", "option", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"}
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("table ul ol dl body html article section main".split())

#: Never part of an article: by element, by role, and by a word of the class or id.
DROPPED = frozenset("head nav header footer aside button select input label legend dialog menu object svg canvas audio video map".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices "
    "notification pagination pager paywall popup promo promoted promotion reactions recommended related replies respond responses share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription tags talkback teaser toc toolbar widget widgets".split()
)
#: Words of a class or id that speak for an article, and the elements that do.
STORY = frozenset("article body content entry main page post story text wrapper".split())
HOLDS_ARTICLE = frozenset(("article", "main", "h1"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element of a doubtful class or id stays if it has this share of the page's points: one that merely has a word for furniture in its name, and one whose name ends in such a word or that is a form.
INSIDE, AT_END = 0.75, 0.9
#: The container around the best takes its place if it is worth this share of it; half of it comes from the best itself.
WIDER = 0.75
#: Lists of so many links that are hardly anything else are menus, wherever they stand.
MENU_LINKS, MENU_DENSITY = 3, 0.9
MENUS = frozenset("div section table ul ol".split())

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_COMMENT_END = re.compile(r"--!?>")
_SPECIAL = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")


#: Whose points are their parent's, in full.
PARAGRAPHS = frozenset("p pre li td blockquote dd h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent", "gone", "needs", "holds", "headed", "inside", "masthead", "links", "lines", "chars", "linked", "inline", "inline_linked", "commas", "points", "mass", "score")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.kids, self.parent, self.gone, self.needs = tag, attrs, [], parent, False, 0.0

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [k for k in reversed(node.kids) if isinstance(k, Node)]

    def elements(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node) and not k.gone]


class TagEnds:
    """Where tags end. Each place is looked at a bounded number of times, whatever quotes and brackets are left open."""

    def __init__(self, page: str):
        self.page, self.bracket, self.first, self.dead = page, 0, (0, 0), set()

    def after_bracket(self, at: int) -> int:
        """The place after the next ``>``, or -1; ``at`` never goes back."""
        if 0 <= self.bracket <= at:
            self.bracket = self.page.find(">", at) + 1 or -1
        return self.bracket

    def after_tag(self, at: int) -> int:
        """The same for a tag whose name ends at ``at``, past brackets in quotes; if a quote stays open, quotes count for nothing."""
        low, place = self.first
        if not low <= at <= place:
            found = _SPECIAL.search(self.page, at)
            place = found.start() if found else len(self.page)
            self.first = at, place
        passed = []
        while place < len(self.page) and place not in self.dead:
            if self.page[place] == ">":
                return place + 1
            passed.append(place)
            close = self.page.find(self.page[place], place + 1)
            found = _SPECIAL.search(self.page, close + 1) if close >= 0 else None
            place = found.start() if found else len(self.page)
        self.dead.update(passed)  # whoever comes by these quotes finds no end either
        return self.after_bracket(at)


def parse(page: str) -> Node:
    """A tree of elements and raw text; open paragraphs, list items and cells end where HTML ends them, stray end tags are ignored."""
    root = node = Node("html", "", None)
    at, still_open, ends = 0, Counter(("html",)), TagEnds(page)  # open elements by tag: no search for one that is not there

    def leave(to: Node | None) -> None:
        nonlocal node
        while to and node is not to:
            still_open[node.tag] -= 1
            node = node.parent

    while found := _OPEN.search(page, at):
        if found.start() > at:
            node.kids.append(page[at : found.start()])
        comment, other, end, tag = found.groups()
        if comment:
            stop = _COMMENT_END.search(page, found.end())
            at = stop.end() if stop else len(page)
            continue
        after = ends.after_bracket(found.end()) if other else ends.after_tag(found.end())
        if after < 0:  # no tag can end any more
            rest = page.find("<!--", found.start())
            node.kids.append(page[found.start() : rest if rest >= 0 else len(page)])
            at = len(page)
            break
        at = after
        if other:
            continue
        tag, attrs = tag.lower(), page[found.end() : after - 1]
        if end:
            if still_open[tag]:
                leave(_around(node, (tag,), BLOCK if tag not in BLOCK else frozenset()))
            continue
        if tag in CLOSES_PARAGRAPH and still_open["p"]:
            leave(_around(node, ("p",), SCOPE))
        if tag in SAME_CLOSES and any(still_open[x] for x in SAME_CLOSES[tag]):
            leave(_around(node, SAME_CLOSES[tag], SCOPE - {"body", "html"}))
        child = Node(tag, attrs, node)
        node.kids.append(child)
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = ends.after_bracket(stop.end()) if stop else -1
            at = at if at >= 0 else len(page)
        elif tag not in VOID and not (attrs.endswith("/") and tag not in BLOCK):
            node = child
            still_open[tag] += 1
    if at < len(page):
        node.kids.append(page[at:])
    return root


def _around(node: Node, tags: tuple[str, ...], scope: frozenset[str]) -> Node | None:
    """The parent of the nearest open element of ``tags``, unless there is none or an element of ``scope`` is in between."""
    while node.parent:
        if node.tag in tags:
            return node.parent
        if node.tag in scope:
            return None
        node = node.parent
    return None


def _attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(node.attrs)}


def _judge(node: Node) -> None:
    """Mark furniture as gone, and say what share of the page's points a doubtful element needs to stay.

    A class or id made of words for furniture alone says so, unless another speaks for an article. One that
    ends in such a word, and a form, need nearly all points; one that only begins with it or has it
    inside needs most, as any does of an article. What holds an article is not judged by names. Of the
    header of an article, headings stay.
    """
    if node.masthead:
        node.gone = node.tag not in HEADINGS and not node.headed
    elif node.tag in DROPPED:
        node.gone = not (node.tag == "header" and node.inside and node.headed)
    elif node.tag in ("form", "fieldset"):
        node.needs = AT_END
    if node.gone or not node.attrs or node.tag in ("html", "body", "main"):
        return
    attrs = _attributes(node)
    if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        node.gone = True
    elif attrs.get("role", "").lower() == "form":
        node.needs = AT_END
    if node.gone or any(isinstance(k, Node) and k.holds for k in node.kids):
        return
    names = [x for x in ([w.lower() for w in _SPLIT.split(x) if w] for x in f"{attrs.get('class', '')} {attrs.get('id', '')}".split()) if x]
    if node.tag != "article" and any(WORDS.issuperset(x) for x in names) and not any(w in STORY for x in names for w in x):
        node.gone = True
    elif node.tag != "article" and any(x[-1] in WORDS for x in names):
        node.needs = AT_END
    elif any(w in WORDS for x in names for w in x):
        node.needs = max(node.needs, INSIDE)


def blocks(node: Node, out: list[str] | None = None) -> list[str]:
    """The texts of a tree's blocks in page order: references decoded, white space to one space, no empty ones."""
    out, run, stack = [], [], [node]

    def flush() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                out.append(text)
            run.clear()

    while stack:
        x = stack.pop()
        if isinstance(x, str):
            run.append(x)
        elif x is None:
            flush()
        elif not x.gone:
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack += reversed(x.kids)
    flush()
    return out


def _weigh(order: list[Node]) -> None:
    """Lengths, link lengths and points of all elements that are not gone, children first.

    A block's own line of text gives points for its length and its commas, less its share of link text.
    Paragraphs give them to their parent, other blocks keep them; half of what an element has goes on to
    its parent, and so on to the root.
    """
    for x in reversed(order):
        own = [html.unescape(k) for k in x.kids if isinstance(k, str)]
        kids = x.elements()
        length = sum(len(" ".join(t.split())) for t in own)
        x.chars = length + sum(k.chars for k in kids)
        x.linked = x.chars if x.tag == "a" else sum(k.linked for k in kids)
        within = [k for k in kids if k.tag not in BLOCK]
        x.inline = length + sum(k.inline for k in within)
        x.inline_linked = x.inline if x.tag == "a" else sum(k.inline_linked for k in within)
        x.links = (x.tag == "a") + sum(k.links for k in kids)
        x.lines = x.tag in PARAGRAPHS and x.chars > 0 or any(k.lines for k in kids)
        x.commas = sum(t.count(",") for t in own) + sum(k.commas for k in within)
        x.points = 0.0
        if x.tag in BLOCK and x.inline:
            x.points = 1 + x.commas + min(x.inline / 100, 3) if x.inline >= 25 else x.inline / 100
            x.points *= 1 - x.inline_linked / x.inline
        x.mass = x.points + sum(k.mass for k in kids)
        x.score = (0.0 if x.tag in PARAGRAPHS else x.points) + sum(k.score / 2 + (k.points if k.tag in PARAGRAPHS else 0.0) for k in kids)


def _link_density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _scored(root: Node) -> list[Node]:
    """The elements in page order that are not gone, weighed; a doubtful one goes unless it has the share of the page's points that it needs."""
    everything = list(root.walk())
    for x in reversed(everything):
        within = [k for k in x.kids if isinstance(k, Node)]
        x.holds = x.tag in HOLDS_ARTICLE or any(k.holds for k in within)
        x.headed = x.tag in HEADINGS or any(k.headed for k in within)
    root.inside = root.masthead = False
    for x in everything[1:]:
        up = x.parent
        x.inside = up.inside or up.tag in ("article", "main")
        x.masthead = up.tag == "header" and up.inside or up.masthead and up.tag not in HEADINGS

    def left() -> list[Node]:
        found, stack = [], [root]
        while stack:
            x = stack.pop()
            found.append(x)
            stack += reversed(x.elements())
        return found

    for x in everything[1:]:
        _judge(x)
    order = left()
    _weigh(order)
    unfit = [x for x in order if x.needs and x.mass < x.needs * root.mass]
    if unfit:
        for x in unfit:
            x.gone = True
        order = left()
        _weigh(order)
    return order


def main_text(page: str | None) -> str:
    """The main text of one page, empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    worth = lambda x: x.score * (1 - _link_density(x))
    order = _scored(root)
    best = max(order, key=worth)
    if best.score <= 0:
        return ""
    while best.parent and worth(best.parent) >= WIDER * worth(best):
        best = best.parent
    for x in order:  # menus, wherever they stand
        x.gone = x.tag in MENUS and x.links >= MENU_LINKS and _link_density(x) >= MENU_DENSITY
    at = best
    while at and at.tag not in ("article", "main"):
        at = at.parent
    if at or best.tag in ("html", "body") or not best.parent:
        return " ".join(blocks(at or best))
    bar = max(best.score * 0.2, 0.1)
    texts = []
    for x in best.parent.elements():
        if x is best or _link_density(x) < 0.3 and (x.score >= bar or x.lines):
            texts += blocks(x)
    return " ".join(texts)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, from the whole of its HTML.

    Page furniture goes first: by element, by role, and by a class or id that is nothing but words for it;
    a form, and an element whose class or id ends in such a word or has one in it, goes unless it has nine
    tenths, or three quarters, of the page's points; and a list that is nothing but links goes. Paragraphs pass points for
    length and commas, less their share of link text, to their ancestors, half as many with each step up;
    the best container is kept, widened to what is around it and worth nearly as much, to the article or
    main element around it, or else with those of its siblings that hold paragraphs or score a fifth of it. The
    work grows with the page's length, however deep it is nested. A null or empty page has an empty text; ids and urls may be null or
    repeated; no rows give none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [id_col, url_col, "text", "n_chars"])

    schema = f"{id_col} long, {url_col} string, text string, n_chars long"
    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col)).mapInArrow(run, schema)
