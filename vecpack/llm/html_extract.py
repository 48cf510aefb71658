"""Main text of web pages by scores that paragraphs pass up the tree."""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vecpack.llm.common import with_python_columns

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "annotation", "annotation-xml", "object", "canvas", "audio", "video", "select", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that never hold the article's own text.
BOILER = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "fieldset", "button"}
#: Words of class, id and role that mark such parts; text of their own can overrule them.
BOILER_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "banner", "sponsor", "sponsored", "promo", "promotion", "outbrain", "taboola", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "alertbar", "disclaimer",
    "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "crumbs", "sidebar", "aside", "complementary", "rail", "footer", "contentinfo", "copyright", "comment", "comments", "commentlist", "disqus", "replies", "respond", "discussion",
    "share", "sharing", "social", "related", "recommended", "recommendations", "newsletter", "subscribe", "subscription", "signup", "login", "warning", "announcement", "notification", "popup", "modal", "overlay", "widget", "widgets", "pagination", "pager", "toolbar", "search", "form", "tags", "hidden",
}
#: The same as a part of a longer word.
_BOILER_PART = re.compile(r"^(?:nav|menu|footer|sidebar|advert|adsense|adslot|adunit|sponsor|cookie|promo|breadcrumb|newsletter)|(?:nav|menu|footer|sidebar|banner|widget)$")
_READER_PART = re.compile(r"^comments?(?!ary)|comments$")
#: Those that mark what readers wrote: only a page that is nothing else can overrule them.
READER_WORDS = {"comment", "comments", "commentlist", "disqus", "replies", "respond", "discussion"}
HEADER_WORDS = {"header", "masthead", "topbar", "siteheader", "pageheader"}
GOOD_WORDS = {"article", "content", "main", "post", "entry", "story", "body", "text", "page"}
#: Whole names of an article's container, beside which parts of other names say what the article is about.
CONTAINERS = {"article", "story", "post", "hentry", "entry", "h-entry", "entry-content", "post-content", "post-body", "article-body", "article-content", "story-body", "content", "main", "main-content", "page-content"}
#: The first part of a name whose rest is a subject.
SUBJECTS = {"category", "cat", "tag", "topic", "tax", "term", "label", "keyword"}
#: Shares of the page's unlinked text beyond which a marked part is kept, and the most link density that it may have.
OVERRULES, READERS_OVERRULE, MOST_LINKED = 0.5, 0.9, 0.33
#: An open paragraph ends where one of these begins.
ENDS_P = BLOCK - {"caption", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary", "figcaption"}
#: Elements whose like ends the one that is still open, up to the container.
ENDS_OWN = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
CONTAINERS_OF = set().union(*ENDS_OWN.values())
FRAME = {"article", "main", "section", "div", "td", "table", "body"}
#: Where an element ends whose content isn't read.
_END = {tag: re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "parent", "items", "boiler", "marked", "inside", "paragraph", "own", "weight", "score", "near", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent = tag, parent
        self.items: list = []  # Nodes and (text, linked) in page order
        #: Whether an article or main element is around it; the open paragraph; the open items that one of their kind would end.
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.paragraph: Node | None = self if tag == "p" else None if tag in FRAME or parent is None else parent.paragraph
        self.own: dict[str, Node] = {} if parent is None else parent.own
        if tag in ENDS_OWN or tag in CONTAINERS_OF:
            self.own = {k: v for k, v in self.own.items() if tag not in ENDS_OWN[k]}
            if tag in ENDS_OWN:
                self.own[tag] = self
        self.boiler = tag in BOILER or tag == "header" and not self.inside
        self.weight, self.score, self.near = 0.0, 0.0, 0.0
        self.chars = self.linked = 0
        #: The share of the page's text that keeps it, if names mark it; else 0.
        self.marked = 0.0
        if attrs:
            self._look(attrs)
        if tag in ("article", "main"):
            self.weight += 25

    def _look(self, attrs: str) -> None:
        names, words = set(), set()
        for _, a, b, c in _NAMES.findall(attrs):
            for name in (a or b or c).lower().split():
                parts = re.split(r"[-_:]+", name)
                names.add(name)
                if parts[0] not in ("has", "with", "no", "is") and not (parts[0] in SUBJECTS and len(parts) > 1):
                    words.update(parts)
        if words & GOOD_WORDS:
            self.weight += 5
        if self.tag in ("html", "body", "article", "main"):
            return
        if _HIDDEN.search(attrs):
            self.boiler = True
        of_article = bool(names & CONTAINERS)
        told = names if of_article else words
        if told & READER_WORDS or not of_article and any(map(_READER_PART.search, words)):
            self.marked = READERS_OVERRULE
        elif told & BOILER_WORDS or not of_article and any(map(_BOILER_PART.search, words)) or told & HEADER_WORDS and not self.inside:
            self.marked = OVERRULES


def parse(html: str) -> Node:
    """The tree of block elements; inline elements only tell which text is linked.

    What an end tag or an implied end refers to is at hand, so the time is linear in the page, however deep
    it is and however many tags have no counterpart.
    """
    root = at = Node("html", None)
    opened: dict[str, list[Node]] = {}
    links, last = 0, 0
    end = len(html)

    def up_from(node: Node) -> Node:
        """Close ``node`` and all that is open in it."""
        here = at
        while here is not node.parent:
            opened[here.tag].pop()
            here = here.parent
        return here

    while last < end:
        m = _TAG.search(html, last)
        if (start := m.start() if m else end) > last:
            at.items.append((unescape(html[last:start]), links > 0))
        if m is None:
            break
        last = m.end()
        tag = (m[2] or m[5] or "").lower()
        closing = bool(m[1] or m[4])
        if not tag:
            continue
        if not closing and tag in RAW:
            shut = _END[tag].search(html, last)
            last = shut.end() if shut else end
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in ("br", "hr"):
            at.items.append((" ", links > 0))
        elif tag not in BLOCK and tag != "button" or tag in VOID:
            continue
        elif closing:
            node = at.paragraph if tag == "p" else opened[tag][-1] if opened.get(tag) else None
            if node is not None:
                at, links = up_from(node), 0
        else:
            links = 0
            if tag in ENDS_P and at.paragraph is not None:
                at = up_from(at.paragraph)
            if tag in ENDS_OWN and tag in at.own:
                at = up_from(at.own[tag])
            if tag == "body" or tag == "html":
                continue
            node = Node(tag, at, m[3] if m[3] is not None else m[6] or "")
            opened.setdefault(tag, []).append(node)
            at.items.append(node)
            at = node
    return root


def _nodes(root: Node, prune: bool) -> list[Node]:
    """All nodes outside dropped parts, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [x for x in node.items if isinstance(x, Node) and not (prune and x.boiler)]
    return out


def _score(nodes: list[Node]) -> None:
    """Points of each paragraph go to its parent whole, half to the next, and two thirds of that on at each step further up."""
    for n in nodes:
        n.score, n.near, n.chars, n.linked = 0.0, 0.0, 0, 0
    for n in reversed(nodes):  # near: points of the children's own text; score, until it is done: of all further down
        own = " ".join("".join(x[0] for x in n.items if not isinstance(x, Node)).split())
        size = len(own)
        n.chars += size
        n.linked += min(size, sum(len(x[0].strip()) for x in n.items if not isinstance(x, Node) and x[1]))
        points = 1 + own.count(",") + own.count("、") + min(size / 100, 3) if size else 0.0
        up = n.parent
        if up is not None:
            up.chars += n.chars
            up.linked += n.linked
            up.near += points
            up.score += n.near / 2 + n.score * 2 / 3
        n.score += n.weight + n.near + (points if up is None else 0.0)


def _weigh_marks(root: Node) -> None:
    """Parts that names mark go, but for one with text of its own that makes up most of the page's."""
    nodes = _nodes(root, True)
    _score(nodes)
    total = root.chars - root.linked
    for n in nodes:
        if n.marked:
            n.boiler = _density(n) > MOST_LINKED or n.chars - n.linked <= n.marked * total
            n.weight -= 5


def _density(n: Node) -> float:
    return n.linked / n.chars if n.chars else 0.0


def _blocks(node: Node, prune: bool) -> list[str]:
    """Text of a subtree: a block ends wherever a block element begins or ends."""
    out: list[str] = []
    buffer: list[str] = []

    def flush():
        if text := " ".join("".join(buffer).split()):
            out.append(text)
        buffer.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, Node):
            flush()
            if not (prune and x.boiler and x is not node):
                todo += [None, *reversed(x.items)]
        else:
            buffer.append(x[0])
    flush()
    return out


def extract(html: str | None) -> str:
    """The article's blocks, joined by newlines; empty for null, empty or textless pages."""
    if not html:
        return ""
    root = parse(html)
    _weigh_marks(root)
    for prune in (True, False):
        nodes = _nodes(root, prune)
        _score(nodes)
        best = max(nodes, key=lambda n: n.score * (1 - _density(n)))
        if best.chars == 0:
            continue
        while best.parent is not None and best.tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "tbody", "tr", "td", "blockquote", "pre", "figure"):
            best = best.parent
        top = best.score * (1 - _density(best))
        parts = [best]
        if best.parent is not None:
            parts, before = [], True
            for x in best.parent.items:
                if not isinstance(x, Node) or prune and x.boiler:
                    continue
                good = x.score * (1 - _density(x))
                paragraph = x.tag in ("p", "blockquote", "pre") and x.chars > 80 and _density(x) < 0.25
                before &= x is not best
                headline = before and x.tag in ("h1", "h2") and _density(x) < 0.25
                if x is best or headline or x.tag != "header" and (good >= max(10, 0.2 * top) and x.tag not in ("ul", "ol") and best.tag not in ("article", "main") or x.tag == best.tag == "article" and x.chars or paragraph and best.tag not in ("article", "main")):
                    parts.append(x)
        if text := "\n".join(b for x in parts for b in _blocks(x, prune)):
            return text
    return ""


def extract_pages(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` without its ``html``, with the main ``text`` of each page and ``n_chars``, its code points.

    Null, empty and textless pages give an empty text. Whole pages are read; pages are independent, so
    there is no shuffle and memory is one Arrow batch. Columns of ``df`` named like a result are replaced.
    """

    def compute(pages):
        texts = [extract(p) for p in pages]
        return [texts, [len(t) for t in texts]]

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return with_python_columns(df, [html], compute, fields, drop=(html,))
