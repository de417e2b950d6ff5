"""Main text of web pages by tree scoring.

A page becomes a tree of block elements. Every block of text passes points, one and more for its
commas and its length, to the elements around it, fewer the farther up, and an element's points are
discounted by the share of its text that is inside links. The best element is the main container; it is widened to the
article around it, if there is one, and siblings with a fair share of its points are kept. Menus,
page headers and footers, sidebars, notices, adverts, forms and reader comments are no text to begin
with, told by element, role, or words of class and id. Names may mislead, so what only a name (or a
form) tells is judged when the whole tree is known: an element that holds an article, the main part,
a title or most of the page's text stays, with fewer points unless it is around all of that.

The parser takes one pass and never fails: it closes what is left open and passes over what was
never opened. Work is in proportion to the page.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kegler.llm.vocabulary import text_slices

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

# Element names by what they do.
_RAW = frozenset("script style noscript iframe textarea title template xmp noembed noframes".split())
_DROP = frozenset("nav footer aside button select option dialog menu svg math canvas object audio video head fieldset".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul head select option button svg math canvas object audio video".split())
_VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
_CLOSES_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "option"}
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Words of a class or an id that tell page furniture.
_FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsbygoogle banner breadcrumb breadcrumbs byline-share comment comments commentlist "
    "consent cookie cookies disqus discussion footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice "
    "notices notification overlay pager pagination popup promo promoted promotion related recommended replies respond rss search share sharing "
    "sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription toolbar tooltip topbar widget widgets".split()
)
# Words of those that also name a section of an article; those of comments; words that say what a page has beside.
_AMBIGUOUS = frozenset("banner discussion header login menu menus notice notices notification notifications overlay promotion recommended related rss search share sharing social sponsor sponsors subscription".split())
_COMMENTS = frozenset("comment comments commentlist disqus discussion replies reply respond".split())
_BESIDE = frozenset("has have no not with without hide hides show shows".split())
_NO, _HARD, _NAMED, _MAYBE, _COMMENT, _FORM = range(6)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of its points that text keeps in an element whose name speaks against it.
_LOWERED = 0.25
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class _Node:
    __slots__ = ("tag", "parent", "depth", "kind", "dropped", "points", "chars", "linked", "in_article", "above", "part", "text", "links", "parts", "inner", "title", "prose", "first", "factor", "barrier", "within")

    def __init__(self, tag: str, parent: "_Node | None", kind: int):
        self.tag, self.parent, self.kind = tag, parent, kind
        self.dropped = kind == _HARD or parent is not None and parent.dropped
        self.depth = parent.depth + 1 if parent else 0
        self.points = 0.0
        self.chars = self.linked = 0
        self.in_article = parent is not None and (parent.in_article or parent.tag == "article")
        self.within = parent is not None and (parent.within or parent.tag in ("article", "main"))
        # Articles and main parts around it, and the nearest; then what is in it: characters outside links
        # and inside, articles and main parts, elements that are articles, titles, paragraphs, the first block.
        self.above = parent.above + parent.is_part() if parent else 0
        self.part: _Node | None = parent and (parent if parent.is_part() else parent.part)
        self.text = self.links = self.parts = self.inner = self.title = self.prose = 0
        self.first = ""
        self.factor, self.barrier = 1.0, False

    def is_part(self) -> bool:
        return self.tag in ("article", "main") and not self.in_article and self.kind == _NO


def _furniture(tag: str, attributes: str, parent: _Node) -> int:
    """What element, role and names say: no furniture, furniture whatever it holds, or a kind that is judged later."""
    if tag in _DROP:
        return _HARD
    if tag == "header":
        return _NO if parent.within or parent.tag in ("article", "main") else _HARD
    if not attributes:
        return _FORM if tag == "form" else _NO
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    words = set()
    for name in (found.get("class", "") + " " + found.get("id", "")).split():
        own = [w for part in re.split(r"[_-]+", name) for w in [part, *_WORDS.findall(part)]]
        lower = [w.lower() for w in own]
        # "no-sidebar", "layout-with-menu": what comes after is beside it.
        words.update(lower[: next((k for k, w in enumerate(lower) if w in _BESIDE), len(lower))])
    if tag in ("html", "body", "main"):
        return _NO
    if tag == "article":
        return _COMMENT if words & {"comment", "comments", "reply", "replies"} else _NO
    if found.get("role", "").lower() in _ROLES or found.get("aria-hidden", "").lower() == "true" or re.search(r"\bhidden\b", re.sub(r"=\s*(\"[^\"]*\"|'[^']*'|\S+)", "", attributes)):
        return _HARD
    named = words & _FURNITURE
    if named and named <= _AMBIGUOUS:
        return _MAYBE
    if named & _COMMENTS:
        return _COMMENT
    return _NAMED if named else _FORM if tag == "form" else _NO


class _Page:
    """Blocks of text with the elements that hold them, in page order."""

    def __init__(self, source: str):
        self.root = _Node("#page", None, _NO)
        self.stack = [self.root]
        self.nodes = [self.root]
        self.open = {"#page": 1}
        self.blocks: list[tuple[_Node, str, int]] = []
        self.text: list[str] = []
        self.linked = 0
        self.in_link = False
        self._parse(source)

    def _add(self, raw: str) -> None:
        if raw:
            t = html.unescape(raw)
            self.text.append(t)
            if self.in_link:
                self.linked += len("".join(t.split()))

    def _flush(self) -> None:
        if self.text:
            t = " ".join("".join(self.text).split())
            if t and not self.stack[-1].dropped:
                self.blocks.append((self.stack[-1], t, self.linked))
            self.text, self.linked = [], 0

    def _pop(self) -> None:
        self.open[self.stack.pop().tag] -= 1

    def _close(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        """Close the nearest of ``tags`` that is open within the nearest of ``scope``."""
        if not any(self.open.get(t) for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                while len(self.stack) > k:
                    self._pop()
                return
            if self.stack[k].tag in scope:
                return

    def _parse(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                self._add(source[at:])
                break
            self._add(source[at:lt])
            m = _TOKEN.match(source, lt)
            if not m:
                self._add("<")
                at = lt + 1
                continue
            at = m.end()
            if m[1] is None:
                continue
            tag, ending = m[1].lower(), source[lt + 1] == "/"
            if tag in _RAW:
                if not ending:
                    end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                    at = end.end() if end else n
                continue
            if tag == "a":
                self.in_link = not ending
            elif tag == "br":
                self.text.append(" ")
            if tag not in _BLOCK:
                continue
            self._flush()
            self.in_link = False if tag != "a" and ending else self.in_link
            if ending:
                if self.open.get(tag):
                    self._close((tag,), ())
            else:
                if tag in _CLOSES_P:
                    self._close(("p",), ("div", "td", "th", "li", "article", "section", "main", "blockquote", "body"))
                if tag in _SAME:
                    self._close(_SAME[tag], _SCOPE[tag])
                if tag not in _VOID:
                    parent = self.stack[-1]
                    self.stack.append(_Node(tag, parent, _NO if parent.dropped else _furniture(tag, m[2], parent)))
                    self.nodes.append(self.stack[-1])
                    self.open[tag] = self.open.get(tag, 0) + 1
        self._flush()


def _judge(page: _Page) -> None:
    """Drop the elements that a name tells and nothing in them speaks against, and lower the points of others."""
    for node, text, linked in page.blocks:
        node.text += max(0, len("".join(text.split())) - linked)
        node.links += linked
        node.title += node.tag == "h1"
        node.prose += node.tag == "p"
        node.first = node.first or node.tag
    if any(v.kind > _HARD for v in page.nodes):
        for v in reversed(page.nodes):
            if v.parent is not None:
                up = v.parent
                up.text, up.links, up.title, up.prose = up.text + v.text, up.links + v.links, up.title + v.title, up.prose + v.prose
                up.inner += v.inner + (v.tag == "article")
                up.parts += v.parts + (v.is_part() and not v.dropped and v.text > 0)
                # Children come in reverse, so the first with text is the last to write.
                up.first = v.first or up.first
        whole, parts = page.root.text, page.root.parts
        for v in page.nodes:
            if v.parent is None or v.dropped:
                continue
            up = v.parent
            v.factor = up.factor
            if up.dropped:
                v.dropped = True
            elif v.kind != _NO:
                elsewhere = parts - v.parts - v.above > 0
                most = 2 * v.text > whole and not elsewhere and not (v.kind == _COMMENT and v.part is not None and v.part.text > v.text)
                holds = v.parts > 0 and not v.in_article
                titled = v.title > 0 and (v.kind in (_NAMED, _MAYBE) or v.tag == "article")
                section = v.kind == _MAYBE and v.above > 0 and v.first in _HEADINGS and v.prose > 0 and not v.inner and 4 * v.links <= v.text and (v.tag == "section" or v.text >= 200)
                if most or section:
                    continue
                if not holds and not titled:
                    v.dropped = True
                else:
                    v.factor, v.barrier = _LOWERED, not titled
    page.blocks = [b for b in page.blocks if not b[0].dropped]


#: Share of its points that an element passes on to the one around it.
_PASSED = 0.5
# Elements that are no containers of their own.
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 pre li dt dd td th figcaption blockquote".split())


def _score(page: _Page) -> list[_Node]:
    """Points, characters and linked characters of the elements around blocks: each block's go to its
    container, and from the inside out a share of them to whatever is around that, however deep."""
    for node, text, linked in page.blocks:
        points = 1.0 + text.count(",") + text.count("،") + text.count("、") + min(len(text) / 100.0, 3.0)
        points *= (1.0 - min(1.0, linked / len(text))) * node.factor
        # A paragraph is no container: its points go to what holds it.
        up = node.parent if node.tag in _LEAVES and node.parent else node
        up.points += points
        up.chars += len(text)
        up.linked += linked
    for v in reversed(page.nodes):
        if v.parent is not None and v.chars:
            v.parent.points += _PASSED * v.points
            v.parent.chars += v.chars
            v.parent.linked += v.linked
    return [v for v in page.nodes if v.chars]


def main_text(source: str | None) -> str:
    """The blocks of the article, one a line; white space inside a block is one blank."""
    if not source:
        return ""
    page = _Page(source)
    _judge(page)
    whole = page.blocks
    menus = _menus(whole)
    page.blocks = [b for b in whole if id(b[0]) not in menus]
    if not page.blocks:
        return ""
    worth = {id(v): (v.points * (1.0 - v.linked / v.chars), v) for v in _score(page)}
    best, top = max((w for w in worth.values()), key=lambda w: w[0])[1], 0.0
    top = worth[id(best)][0]
    up: _Node | None = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
            if up.tag == "article":
                break
        up = up.parent
    kept = {id(best)}
    if best.tag not in ("body", "html", "#page"):
        # Siblings of the container, and headings or paragraphs beside it.
        part = best.tag in ("article", "main")
        for k, (w, v) in worth.items():
            if v.parent is best.parent and w >= max(0.0 if part and v.tag in ("article", "section", "main") else 10.0, 0.2 * top):
                kept.add(k)
        for node, text, linked in page.blocks:
            if node.parent is best.parent and (node.tag == "h1" or node.tag == "h2" and not part or node.tag == "p" and len(text) > 80 and linked < 0.25 * len(text)):
                kept.add(id(node))
        # Lists of links in the container are part of it; elsewhere, and where all is one container, they are menus.
        page.blocks = whole
    inside: dict[int, bool] = {}

    def is_inside(node: _Node | None) -> bool:
        path = []
        while node is not None and id(node) not in inside:
            if id(node) in kept:
                inside[id(node)] = True
                break
            path.append(id(node))
            if node.barrier:
                node = None
                break
            node = node.parent
        verdict = node is not None and inside[id(node)]
        for k in path:
            inside[k] = verdict
        return verdict

    return "\n".join(text for node, text, _ in page.blocks if is_inside(node))


def _menus(blocks: list[tuple[_Node, str, int]]) -> set[int]:
    """Entries of lists that are all links: menus that no name tells."""
    lists: dict[int, list[tuple[_Node, int, int]]] = {}
    for node, text, linked in blocks:
        if node.tag == "li" and node.parent is not None:
            lists.setdefault(id(node.parent), []).append((node, len("".join(text.split())), linked))
    return {id(node) for rows in lists.values() if len(rows) > 1 and sum(x for _, _, x in rows) >= 0.9 * sum(x for _, x, _ in rows) for node, _, _ in rows}


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """key, url, text, n_chars (code points) of every page. A null or empty page has an empty text;
    rows repeat as they come, other columns are ignored, and no row leaves its partition."""
    def run(batches):
        for batch in batches:
            for a, b in text_slices(batch.column(2)):
                texts = [main_text(s) for s in batch.column(2).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_pydict({key: batch.column(0).slice(a, b - a), url: batch.column(1).slice(a, b - a), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key), F.col(url), F.col(source)).mapInArrow(run, f"`{key}` {kind}, `{url}` string, text string, n_chars long")
