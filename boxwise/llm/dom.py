"""A page as a small tree of elements, and simple tree matching."""

from __future__ import annotations

import html
import re

# possessive, and no "<" outside quotes: the time is linear whatever the page holds
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|([^<]++|<)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/]+)")

# Fixed values of HTML: void elements, elements with raw text, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg math object canvas video audio select".split())
UNENDING = frozenset("script style textarea iframe".split())  # without an end tag, to the end of the page
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section
summary table tbody td tfoot th thead title tr ul""".split())
# an opening tag of the key ends an open element of the values
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"),
        "tfoot": ("tbody", "tr", "td", "th")}
NESTED = 500  # open elements; what is nested deeper counts to the last of them
SCOPES = frozenset("table ul ol dl div section article main body aside nav header footer form".split())


class Node:
    __slots__ = ("tag", "marks", "children", "hidden")

    def __init__(self, tag: str, marks: str = "", hidden: bool = False):
        self.tag, self.marks, self.hidden = tag, marks, hidden
        self.children: list[Node | str] = []

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.marks}" if self.marks else self.tag


def attributes(raw: str) -> dict[str, str]:
    out = {}
    for name, a, b, c, bare in ATTRIBUTE.findall(raw):
        out.setdefault((name or bare).lower(), html.unescape(a or b or c))
    return out


def parse(page: str) -> Node:
    """The tree of a page. Wrong nesting never fails: an end tag without its
    start is left out, and a block ends an open paragraph."""
    root = Node("#")
    stack = [root]
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        if m is None:
            at += 1
            continue
        at = m.end()
        if m[4] is not None:
            stack[-1].children.append(m[4])
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("table", "article", "main", "body") and tag not in BLOCK:
                    break
            continue
        if tag in RAW:
            close = None if m[3].endswith("/") else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if close:
                at = close.end()
            elif tag in UNENDING:
                at = end
            continue
        if tag == "br":
            stack[-1].children.append(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
            for i in range(len(stack) - 1 if tag in ENDS else 0, 0, -1):
                if stack[i].tag in ENDS[tag]:
                    del stack[i:]
                    continue
                if stack[i].tag in SCOPES:
                    break
        raw = m[3]
        marks, hidden = "", False
        if raw and not raw.isspace():
            own = attributes(raw)
            hidden = "hidden" in own or own.get("aria-hidden", "").lower() == "true" or bool(
                re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""), re.I))
            marks = " ".join(x for x in (own.get("id"), own.get("class"), own.get("role")) if x)
        node = Node(tag, marks, hidden)
        stack[-1].children.append(node)
        if tag != "hr" and len(stack) < NESTED:
            stack.append(node)
    return root


class Branch:
    """An element of the reduced tree: blocks only, its own text in one string,
    and runs of alike siblings without blocks of their own as one branch."""
    __slots__ = ("label", "texts", "children", "node", "pages")

    def __init__(self, label: str):
        self.label = label
        self.texts: list[str] = []
        self.children: list[Branch] = []
        self.pages = 1

    def size(self) -> int:
        return sum(map(len, self.texts)) + sum(c.size() for c in self.children)


DENSE = 250_000  # pairs of children beyond which they are matched first come, first served


def in_order(a: Branch, b: Branch) -> tuple[int, list[tuple[Branch, Branch]]]:
    """Children matched with the next unused child of their label."""
    found, total = [(a, b)], 1
    waiting: dict[str, list[Branch]] = {}
    for c in reversed(b.children):
        waiting.setdefault(c.label, []).append(c)
    for c in a.children:
        if waiting.get(c.label):
            weight, inner = tree_matching(c, waiting[c.label].pop())
            total, found = total + weight, found + inner
    return total, found


def tree_matching(a: Branch, b: Branch) -> tuple[int, list[tuple[Branch, Branch]]]:
    """The largest order-preserving top-down matching of two trees: equal labels
    match, children by dynamic programming (simple tree matching)."""
    if a.label != b.label:
        return 0, []
    n, m = len(a.children), len(b.children)
    if n * m > DENSE:
        return in_order(a, b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    pairs: dict[tuple[int, int], tuple[int, list]] = {}
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            weight, inner = tree_matching(a.children[i - 1], b.children[j - 1])
            if weight:
                pairs[i, j] = weight, inner
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + weight)
    found = [(a, b)]
    i, j = n, m
    while i and j:
        if (i, j) in pairs and best[i][j] == best[i - 1][j - 1] + pairs[i, j][0]:
            found += pairs[i, j][1]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[n][m] + 1, found
