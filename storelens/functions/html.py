"""HTML columns: parsing runs in Arrow batches with the standard-library parser."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

SKIPPED = {"script", "style", "noscript"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in SKIPPED

    def handle_endtag(self, tag):
        if tag in SKIPPED and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def html_text(value: str) -> str:
    """Visible text of one document, white space collapsed."""
    if "<" not in value and "&" not in value:
        return re.sub(r"\s+", " ", value).strip()
    p = _Text()
    p.feed(value)
    p.close()
    return re.sub(r"\s+", " ", "".join(p.parts)).strip()


@pandas_udf(StringType())
def _clean(values: pd.Series) -> pd.Series:
    return values.map(html_text, na_action="ignore")


def clean(x: Column) -> Column:
    """Text of an HTML fragment; null becomes the empty string."""
    return F.coalesce(_clean(x), F.lit(""))


# Elements that never have content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    """One element: tag, attributes, parent, children and its own text pieces in order."""

    __slots__ = ("tag", "attrs", "parent", "parts")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [p for p in reversed(n.parts) if isinstance(p, Node)]

    def text(self, skip=frozenset(SKIPPED)) -> str:
        out, stack = [], [*reversed(self.parts)]
        while stack:
            p = stack.pop()
            if isinstance(p, str):
                out.append(p)
            elif p.tag not in skip:
                stack += reversed(p.parts)
        return " ".join("".join(out).split())

    def up(self):
        n = self
        while n is not None:
            yield n
            n = n.parent

    @property
    def classes(self):
        return (self.attrs.get("class") or "").split()


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("li", "tr", "td", "th", "dt", "dd", "p", "option") and self.here.tag == tag:
            self.here = self.here.parent
        n = Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.parts.append(n)
        if tag not in VOID:
            self.here = n

    def handle_startendtag(self, tag, attrs):
        self.here.parts.append(Node(tag, {k: v or "" for k, v in attrs}, self.here))

    def handle_endtag(self, tag):
        for n in self.here.up():
            if n.tag == tag:
                self.here = n.parent or self.root
                return

    def handle_data(self, data):
        self.here.parts.append(data)


# Plain markup: text, quoted or simple attributes, end tags, comments and doctypes as most pages write them.
_W = "[\\t\\n\\r\\f ]"
_VALUE = "\"[^\"&]*\"|'[^'&]*'"
_MARKUP = re.compile(f"""(?P<text>[^<]+)
    |</(?P<end>[a-zA-Z][a-zA-Z0-9]*){_W}*>
    |<(?P<tag>[a-zA-Z][a-zA-Z0-9]*)(?P<attrs>(?:{_W}+[a-zA-Z_][a-zA-Z0-9_:.-]*(?:=(?:{_VALUE}|[a-zA-Z0-9_.-]+(?={_W}*[a-zA-Z>]|{_W}+/)))?)*){_W}*(?P<close>/?)>
    |(?P<skip><!--(?![->])(?:(?!--|<!).)*-->|<![dD][oO][cC][tT][yY][pP][eE][^>\\[]*>)""".replace("\n    ", ""), re.S)
_ATTR = re.compile(f"([a-zA-Z_][a-zA-Z0-9_:.-]*)(?:=({_VALUE}|[a-zA-Z0-9_.-]+))?")
# Elements whose content is no markup, up to their plain end tag.
_RAW = {t: re.compile(f"((?:(?!</{t}|<!--).)*)(?=</{t}>)", re.S | re.I) for t in ("script", "style")}
_RAW |= {t: re.compile(f"([^<]*)(?=</{t}>)", re.I) for t in ("title", "textarea")}
_ODD = {"xmp", "iframe", "noembed", "noframes", "plaintext", "svg", "math"}


def _parse_plain(html: str) -> Node | None:
    """The element tree of a page of plain markup, as the library parser reads it; None for any other page."""
    t, at, n = _Tree(), 0, len(html)
    token = _MARKUP.match
    while at < n:
        m = token(html, at)
        if not m:
            return None
        at, kind = m.end(), m.lastgroup
        if kind == "text":
            x = m["text"]
            t.here.parts.append(unescape(x) if "&" in x else x)
        elif kind == "end":
            t.handle_endtag(m["end"].lower())
        elif kind == "close":
            tag = m["tag"].lower()
            if tag in _ODD:
                return None
            found = m["attrs"]
            attrs = [(k.lower(), v[1:-1] if v[:1] in ('"', "'") else v) for k, v in _ATTR.findall(found)] if found else []
            if m["close"]:
                if tag in _RAW:
                    return None
                t.handle_startendtag(tag, attrs)
                continue
            t.handle_starttag(tag, attrs)
            if tag in _RAW:
                raw = _RAW[tag].match(html, at)
                if not raw:
                    return None
                if raw[1]:
                    t.here.parts.append(unescape(raw[1]) if tag in ("title", "textarea") else raw[1])
                at = raw.end()
    return t.root


def parse(html: str) -> Node:
    """The element tree of a page; unclosed elements end with their parent."""
    root = _parse_plain(html)
    if root is not None:
        return root
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


@lru_cache(maxsize=1000)
def _compound(selector: str):
    """A compound selector as (tag, tests), read once; None where it cannot match."""
    m = re.fullmatch(r"([a-z0-9]*)((?:\.[\w-]+|#[\w-]+|\[[^\]]+\])*)", selector.strip(), re.I)
    if not m:
        return None
    tests = []
    for part in re.findall(r"\.[\w-]+|#[\w-]+|\[[^\]]+\]", m[2]):
        if part[0] == "[":
            name, op, value = re.fullmatch(r"\[([\w:-]+)(?:(\*?=)\"?([^\"\]]*)\"?)?\]", part).groups()
            tests.append((op or "[]", name, value))
        else:
            tests.append((part[0], part[1:], None))
    return m[1].lower(), tests


def _fits(n: Node, compound) -> bool:
    if not compound or (compound[0] and n.tag != compound[0]) or n.tag == "#root":
        return False
    for op, name, value in compound[1]:
        if op == ".":
            if name not in n.classes:
                return False
        elif op == "#":
            if n.attrs.get("id") != name:
                return False
        else:
            got = n.attrs.get(name)
            if got is None or (op == "=" and got != value) or (op == "*=" and value not in got):
                return False
    return True


def matches(n: Node, selector: str) -> bool:
    """A compound selector: tag, ``.class``, ``#id``, ``[attr]``, ``[attr=value]``, ``[attr*=value]``."""
    return _fits(n, _compound(selector))


def select(root: Node, selectors: str) -> list[Node]:
    """All elements matching one of the comma-separated compound selectors, in document order."""
    each = [_compound(s) for s in selectors.split(",")]
    return [n for n in root.walk() if any(_fits(n, s) for s in each)]
