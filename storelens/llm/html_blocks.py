"""Leaf blocks of a page: an iterative reading of tags, no recursion, so depth is unbounded."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas audio video".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An opening tag that ends an open element of the listed kinds, up to the nearest of the barriers.
IMPLIED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
           "option": ("option", "select"), "tbody": ("thead tbody tr td th", "table"), "thead": ("thead tbody tr td th", "table"), "tfoot": ("thead tbody tr td th", "table")}
SPACE = re.compile(r"\s+")

TAG = re.compile(r"<(?:!--(?:.*?-->|.*\Z)|(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[!?/][^>]*>)", re.S)
OPENS, NAME_END, SIGN = re.compile(r"<[a-zA-Z]"), re.compile(r"[\s/>]"), re.compile("[>\"']")
ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
NAME_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    """Text between two block borders, with its ancestors' tags, their class, id and role words, and how much of it are links."""

    text: str
    tags: tuple[str, ...]
    marks: tuple[str, ...]
    linked: int


def _marks(attrs: str) -> tuple[str, ...]:
    if "=" not in attrs:
        return ()
    found = []
    for key, a, b, c in ATTR.findall(attrs):
        if key.lower() in ("class", "id", "role", "itemprop", "aria-label"):
            found += NAME_PART.findall(html.unescape(a or b or c).lower())
    return tuple(found)


class _Tags:
    """Finds the next tag, comment or declaration of a page; a ``<`` that starts none is text.

    Every such ``<`` could be read up to the page's end in vain. After a few of them one pass from the end finds
    where tags can end: outside quotes a tag runs on to the next sign (``>`` or a quote), a quote to its like, so
    whether the end is reached from one sign follows from a later one. A name may hold quotes, read as its own
    or as those of values, so any sign from the name on may be the first.
    """

    def __init__(self, page: str):
        self.page, self.last, self.failed, self.signs = page, page.rfind(">"), 0, None

    def search(self, at: int) -> re.Match | None:
        while (at := self.page.find("<", at)) >= 0:
            named = OPENS.match(self.page, at)
            if self.page.startswith("<!--", at) or at < self.last and (not named or self.signs is None or self._ends(named.end() - 1)):
                if m := TAG.match(self.page, at):
                    return m
                self.failed += named is not None
                if self.failed == 8 and self.signs is None:
                    self._prepare()
            at += 1
        return None

    def _prepare(self) -> None:
        self.signs, self.name_end = [m.start() for m in SIGN.finditer(self.page)], 0
        ends, after = [False] * (len(self.signs) + 1), {}
        for k in range(len(self.signs) - 1, -1, -1):
            sign = self.page[self.signs[k]]
            ends[k] = sign == ">" or sign in after and ends[after[sign] + 1]
            after[sign] = k
        self.count = [0, *accumulate(map(int, ends))]

    def _ends(self, name: int) -> bool:
        """Whether the tag whose name starts at ``name`` can end."""
        if self.name_end <= name:
            m = NAME_END.search(self.page, name)
            self.name_end = m.start() if m else len(self.page)
        a, z = bisect_left(self.signs, name), bisect_left(self.signs, self.name_end)
        return self.count[z + 1] > self.count[a]


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order. Broken markup is read as far as it goes; an unclosed comment or script hides the rest."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    depth: dict[str, int] = {}  # open elements by tag
    marked: dict[str, int] = {}  # and by word of their class, id or role
    hidden = links = linked = 0
    parts: list[str] = []

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, tuple(k for k, v in depth.items() if v), tuple(k for k, v in marked.items() if v), min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop_to(size: int) -> None:
        nonlocal hidden, links
        while len(stack) > size:
            name, words = stack.pop()
            depth[name] -= 1
            for w in words:
                marked[w] -= 1
            hidden -= name in UNSEEN
            links -= name == "a"

    def push(name: str, attrs: str) -> None:
        nonlocal hidden, links
        words = _marks(attrs)
        stack.append((name, words))
        depth[name] = depth.get(name, 0) + 1
        for w in words:
            marked[w] = marked.get(w, 0) + 1
        hidden += name in UNSEEN
        links += name == "a"

    def last_of(names: set[str], barriers: set[str]) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in barriers:
                return -1
        return -1

    at, n, tags = 0, len(page), _Tags(page)
    while at < n:
        m = tags.search(at)
        text = page[at : m.start() if m else n]
        if text and not hidden:
            parts.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        block = name not in INLINE
        if m["close"]:
            if depth.get(name):
                if block:
                    end_block()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        pop_to(i)
                        break
            elif block:
                end_block()
            continue
        if block:
            end_block()
            if name in CLOSES_P and depth.get("p"):
                if (i := last_of({"p"}, {"button", "table"})) >= 0:
                    pop_to(i)
            if name in IMPLIED:
                kinds, barriers = IMPLIED[name]
                if any(depth.get(k) for k in kinds.split()):
                    while (i := last_of(set(kinds.split()), set(barriers.split()))) >= 0:
                        pop_to(i)
            if name == "body" and hidden:
                pop_to(0)
        elif name == "br":
            parts.append(" ")
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            if name == "textarea" and not hidden:
                inner = page[at : close.start() if close else n]
                push(name, m["attrs"])
                parts.append(inner)
                end_block()
                pop_to(len(stack) - 1)
            at = page.find(">", close.end() - 1) + 1 if close else n
            if close and at == 0:
                break
            continue
        if m["attrs"].rstrip().endswith("/") and name not in CLOSES_P and block and name not in IMPLIED:
            continue
        push(name, m["attrs"])
    end_block()
    return out
