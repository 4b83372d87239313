"""HTML to text: a tolerant tree builder and a renderer that keeps the layout.

``build`` turns markup into a tree of ``Node``s.  Missing end tags are implied (a ``<p>`` ends an open ``<p>``, an
``<li>`` an open ``<li>`` of the same list, a ``<td>`` an open cell, and so on), stray end tags are ignored and void
elements never stay open, so any byte soup gives a tree.  ``render`` emits the visible text only: invisible elements
(scripts, styles, ``hidden``, ``display:none``) vanish, block elements are set apart by line breaks, list items get
their bullet or number, and the cells of a table are padded to common column widths.  Nothing recurses on the tree, so
markup of any depth is fine.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INVISIBLE = frozenset("script style noscript template head title object svg iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
#: start tag -> open elements that it ends, looking no further than the scope elements
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"[ \t\r\n\f\xa0]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self):
        """The node and all below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        return _SPACE.sub(" ", "".join(strings(self))).strip()


def strings(node: Node):
    """The strings below a node, with a space on both sides of what is set apart."""
    stack = list(reversed(node.children))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            yield item
            continue
        apart = item.tag in BLOCK or item.tag == "br"
        if apart:
            yield " "
            stack.append(" ")
        stack.extend(reversed(item.children))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.stack = [self.root]
        self.open = Counter()  # tags on the stack, so that a stray end tag needs no search

    def _end(self, depth: int) -> None:
        self.open.subtract(n.tag for n in self.stack[depth:])
        del self.stack[depth:]

    def handle_starttag(self, tag, attrs):
        ends, scope = IMPLIED.get(tag, (frozenset(), frozenset()))
        if tag in BLOCK and tag not in IMPLIED:
            ends, scope = {"p"}, {"td", "th", "li", "div", "article", "section", "main", "body"}
        for depth in range(len(self.stack) - 1, 0, -1) if any(self.open[t] > 0 for t in ends) else ():
            if self.stack[depth].tag in ends:
                self._end(depth)
                break
            if self.stack[depth].tag in scope:
                break
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] += 1

    def handle_endtag(self, tag):
        for depth in range(len(self.stack) - 1, 0, -1) if self.open[tag] > 0 else ():
            if self.stack[depth].tag == tag:
                self._end(depth)
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def build(markup: str) -> Node:
    builder = _Builder()
    try:
        builder.feed(markup)
        builder.close()
    except (AssertionError, ValueError):  # malformed declarations; what was read so far stays
        pass
    return builder.root


def visible(node: Node) -> bool:
    a = node.attrs
    return not (
        node.tag in INVISIBLE
        or "hidden" in a
        or a.get("aria-hidden") == "true"
        or (node.tag == "input" and a.get("type") == "hidden")
        or _HIDDEN_STYLE.search(a.get("style", ""))
    )


def _aligned(table: Node, skip: frozenset) -> list[str]:
    """The rows of a table, its cells padded to common widths; a table inside a cell is running text there."""
    rows, stack = [], list(reversed(table.children))
    while stack:
        node = stack.pop()
        if isinstance(node, str) or node.tag == "table":
            continue
        if node.tag == "tr":
            rows.append([" ".join(render(c, skip, tables=False)) for c in node.children if isinstance(c, Node) and c.tag in ("td", "th")])
        else:
            stack.extend(reversed(node.children))
    widths = [max((len(r[i]) for r in rows if len(r) > i), default=0) for i in range(max(map(len, rows), default=0))]
    return [" | ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows if any(r)]


def render(node: Node, skip: frozenset = frozenset(), tables: bool = True, code: bool = False) -> list[str]:
    """The visible lines below ``node``; elements named in ``skip`` are left out whole.

    With ``code`` preformatted blocks keep their lines between fences, and code in a line stands between backticks.
    """
    lines, buf = [], []

    def flush():
        line = _SPACE.sub(" ", "".join(buf)).strip()
        buf.clear()
        if line:
            lines.append(line)

    stack: list = [(node, "- ")]
    while stack:
        item, mark = stack.pop()
        if item is None:  # the end of a block
            flush()
            continue
        if isinstance(item, str):
            buf.append(item)
            continue
        if item.tag in skip or not visible(item):
            continue
        if item.tag == "br":
            flush()
            continue
        if item.tag == "table" and tables:
            flush()
            lines.extend(_aligned(item, skip))
            continue
        if item.tag == "pre" and code:
            flush()
            lines += ["```", *"".join(strings(item)).strip("\n").split("\n"), "```"]
            continue
        if item.tag in BLOCK:
            flush()
            stack.append((None, ""))
        elif item.tag == "code" and code:
            buf.append("`")
            stack.append(("`", ""))
        if item.tag == "li":
            buf.append(mark)
        inner, number = [], 0
        for c in item.children:
            if not isinstance(c, str) and c.tag == "li":
                number += 1
            inner.append((c, f"{number}. " if item.tag == "ol" else "- "))
        stack.extend(reversed(inner))
    flush()
    return lines
