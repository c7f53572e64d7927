"""Per-page HTML helpers that run inside Spark tasks (Arrow batches).

The tree follows the tolerant rules of Python's ``html.parser`` as used by
the portal: no implied end tags (an unclosed ``<p>`` holds what follows),
an end tag closes up to the nearest open element of that name and is
ignored when there is none, void elements close at once, and whatever is
still open at the end closes there.  Text of ``script``/``style``/
``template`` and comments is not text.

A page is read once.  Its text is one string, an element is a range of it,
so nothing recurses and a page of any depth takes time in proportion to its
length.  A block that holds other blocks repeats their text, as in the portal;
blocks are made one at a time, so a page with many unclosed paragraphs gives
long output but never stands in memory more than once.  ``implied_ends`` (off,
the portal had no such rule) ends an open paragraph where the next block
starts, and with it the repeats.
"""

from __future__ import annotations

import html as _html
from html.parser import HTMLParser

# --- fixed values: element classes of the block job ---
BLOCK_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6")
LIST_TAGS = ("ol", "ul")
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
VOID_TAGS = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link",
    "menuitem", "meta", "param", "source", "track", "wbr", "basefont", "bgsound",
    "command", "frame", "image", "isindex", "nextid", "spacer"))
NON_TEXT_TAGS = frozenset(("script", "style", "template"))
# The scrape walk reads a cleaned page: there a block closes an open p, and
# these hold no text.
CLOSES_P = frozenset(("p", "div", "ul", "ol", "dl", "table", "pre", "form", "hr", "address", "blockquote",
                      "fieldset", "article", "section", "aside", "header", "footer", "nav", *BLOCK_TAGS))
CLEANED_TAGS = frozenset(("textarea", "select", "button", "option", "iframe", "embed", "object", "applet", "noscript"))
# --- end of fixed values ---


class Node:
    """An element: the range of its text and of the nodes inside it."""

    __slots__ = ("name", "id", "start", "end", "last", "items")

    def __init__(self, name: str, id_: str | None, start: int):
        self.name, self.id, self.start, self.end, self.last = name, id_, start, start, 0
        #: Of lists: what stands directly inside, nodes and ranges of text.
        self.items: list | None = [] if name in LIST_TAGS else None


class Page(HTMLParser):
    """``nodes`` in document order and the page's ``text``."""

    def __init__(self, markup: str | None, remove_chars: str = "", cleaned: bool = False, implied_ends: bool = False):
        super().__init__(convert_charrefs=True)
        self.closes_p = CLOSES_P if cleaned or implied_ends else frozenset()
        self.muted_tags = NON_TEXT_TAGS | CLEANED_TAGS if cleaned else NON_TEXT_TAGS
        self.table = str.maketrans("", "", remove_chars)
        self.nodes: list[Node] = []
        self.stack: list[Node] = []
        self.open: dict[str, int] = {}
        self.muted = self.size = 0
        pieces: list[str] = []
        self.keep = pieces.append
        self.feed(markup or "")
        self.close()
        while self.stack:
            self._pop()
        self.text = "".join(pieces)

    def _add(self, tag: str, attrs: list) -> Node:
        node = Node(tag, dict(attrs).get("id"), self.size)
        self.nodes.append(node)
        node.last = len(self.nodes)
        if self.stack and self.stack[-1].items is not None:
            self.stack[-1].items.append(node)
        return node

    def _pop(self) -> str:
        node = self.stack.pop()
        node.end, node.last = self.size, len(self.nodes)
        self.open[node.name] -= 1
        self.muted -= node.name in self.muted_tags
        return node.name

    def handle_starttag(self, tag, attrs):
        if tag in self.closes_p:
            self.handle_endtag("p")
        node = self._add(tag, attrs)
        if tag not in VOID_TAGS:
            self.stack.append(node)
            self.open[tag] = self.open.get(tag, 0) + 1
            self.muted += tag in self.muted_tags

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs)

    def handle_endtag(self, tag):
        # The count of open names spares the search for a stray end tag.
        if self.open.get(tag):
            while self._pop() != tag:
                pass

    def handle_data(self, data):
        data = "" if self.muted else data.translate(self.table)
        if data:
            if self.stack and self.stack[-1].items is not None:
                self.stack[-1].items.append((self.size, self.size + len(data)))
            self.keep(data)
            self.size += len(data)

    def inside(self, node: Node | None):
        """The node and all in it, in document order; None: all."""
        if node is None:
            return iter(self.nodes)
        first = self.nodes.index(node)
        return (self.nodes[i] for i in range(first, node.last))

    def first(self, pred) -> Node | None:
        return next(filter(pred, self.nodes), None)


def _esc(s: str) -> str:
    return _html.escape(s, quote=False)


def tidy_blocks(markup: str | None, remove_chars: str = "\xa0", implied_ends: bool = False):
    """Flattened blocks of a page body as ``(tag, text, html)`` in document
    order (O-19, O-18): every non-empty ``p``/``h1``-``h6`` with its
    stripped text, and every ``ol``/``ul`` as one block of its direct,
    non-empty children (bare text children read as ``li``).  Nested blocks
    are emitted again on their own, as the portal's walk did."""
    page = Page(markup, remove_chars, implied_ends=implied_ends)
    for n in page.inside(page.first(lambda n: n.name == "body")):
        if n.name in BLOCK_TAGS:
            t = page.text[n.start:n.end].strip()
            if t:
                yield n.name, t, f"<{n.name}>{_esc(t)}</{n.name}>"
        elif n.name in LIST_TAGS:
            items = [("li", page.text[c[0]:c[1]].strip()) if isinstance(c, tuple)
                     else (c.name, page.text[c.start:c.end].strip()) for c in n.items]
            items = [(t, x) for t, x in items if x]
            inner = "".join(f"<{t}>{_esc(x)}</{t}>" for t, x in items)
            yield n.name, "".join(x for _, x in items), f"<{n.name}>{inner}</{n.name}>"


def scrape_blocks(markup: str | None, html_ids: list[str], prefix: str = "(U) ",
                  min_length: int = 2):
    """Blocks of the element whose id is listed (the last listed id found
    wins), scripts, styles and comments dropped (O-26): each heading as a
    level-3 heading and each ``p``, with text of at least ``min_length``
    characters, prefixed.  An open ``p`` ends where the next block starts.  No
    de-duplication."""
    page = Page(markup, cleaned=True)
    found = [t for i in html_ids if (t := page.first(lambda n, i=i: n.id == i)) is not None]
    for n in page.inside(found[-1]) if found else ():
        t = page.text[n.start:n.end] if n.name in BLOCK_TAGS else ""
        if len(t) >= min_length:
            tag = "h3" if n.name in HEADING_TAGS else "p"
            text = prefix + t
            yield tag, text, f"<{tag}>{_esc(text)}</{tag}>"


def unescape_description(s: str | None) -> str | None:
    """Unescape entities, then cut from the first ``<div`` (O-27)."""
    if s is None:
        return None
    u = _html.unescape(s)
    i = u.find("<div")
    return u if i < 0 else u[:i]
