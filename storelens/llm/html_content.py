"""Main text of pages: a linear-chain conditional random field over the leaf blocks.

Features of a block are the tags of its ancestors, the words of their class, id and role, and
shape features of its text; none depends on the language. The field is trained on labelled
pages and decoded with Viterbi per page. Spark runs it in Arrow batches; the weights (a few
hundred numbers) travel in the closure.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from storelens.llm.common import over_batches
from storelens.llm.html_blocks import Block, blocks

BOILERPLATE, CONTENT = 0, 1
Model = tuple[dict[str, tuple[float, float]], np.ndarray, np.ndarray]


def features(b: Block, place: int, count: int) -> list[str]:
    """Names of the block's features; ``place`` is its number on a page of ``count`` blocks."""
    t, n = b.text, len(b.text)
    words = t.count(" ") + 1
    share = 4 * b.linked // n
    marks = sum(map(t.count, ".,;:!?"))
    out = ["bias", f"words:{min(words.bit_length(), 7)}", f"linked:{share}", f"points:{min(marks, 3)}", f"end:{'point' if t[-1] in '.!?:”\"' else 'letter' if t[-1].isalnum() else 'other'}",
           f"place:{4 * place // count}"]
    out += [f"tag:{x}" for x in b.tags] + [f"mark:{x}" for x in b.marks]
    if "©" in t or "|" in t or "»" in t:
        out.append("sign")
    if not b.marks:
        out.append("unmarked")
    return out


def _scores(model: Model, rows: list[list[str]]) -> list[tuple[float, float]]:
    weights, out = model[0], []
    for row in rows:
        a = b = 0.0
        for f in row:
            if (w := weights.get(f)) is not None:
                a += w[0]
                b += w[1]
        out.append((a, b))
    return out


def viterbi(scores: list[tuple[float, float]], start: np.ndarray, step: np.ndarray) -> list[int]:
    """The most likely labels; ties go to boilerplate."""
    if not scores:
        return []
    (s00, s01), (s10, s11) = step.tolist()
    a, b = scores[0][0] + float(start[0]), scores[0][1] + float(start[1])
    back = []
    for u, v in scores[1:]:
        from_a, from_b = a + s00 >= b + s10, a + s01 >= b + s11
        a, b = u + (a + s00 if from_a else b + s10), v + (a + s01 if from_b else b + s11)
        back.append((0 if from_a else 1, 0 if from_b else 1))
    at = 0 if a >= b else 1
    out = [at]
    for choice in reversed(back):
        at = choice[at]
        out.append(at)
    return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 150, rate: float = 0.1, ridge: float = 0.02) -> Model:
    """Weights that maximise the conditional likelihood of the labels (forward-backward gradients, Adam, L2)."""
    names = {f: i for i, f in enumerate(sorted({f for rows, _ in pages for row in rows for f in row}))}
    n, longest, width = len(pages), max(len(r) for r, _ in pages), len(names)
    x = np.zeros((n, longest, width), dtype=np.float32)
    y, mask = np.zeros((n, longest), dtype=np.int64), np.zeros((n, longest), dtype=bool)
    for i, (rows, labels) in enumerate(pages):
        for j, row in enumerate(rows):
            x[i, j, [names[f] for f in row]] = 1
        y[i, : len(labels)], mask[i, : len(labels)] = labels, True
    flat, gold = x.reshape(-1, width), np.eye(2)[y] * mask[..., None]
    both = mask[:, 1:] & mask[:, :-1]
    gold_step = np.einsum("nta,ntb,nt->ab", gold[:, :-1], gold[:, 1:], both)
    sizes = [2 * width, 2, 4]
    p, m, v = np.zeros(sum(sizes)), np.zeros(sum(sizes)), np.zeros(sum(sizes))
    for k in range(1, rounds + 1):
        w, start, step = p[: 2 * width].reshape(width, 2), p[2 * width : 2 * width + 2], p[-4:].reshape(2, 2)
        u = (flat @ w.astype(np.float32)).reshape(n, longest, 2).astype(np.float64)
        fore, aft = np.zeros_like(u), np.zeros_like(u)
        fore[:, 0] = u[:, 0] + start
        for t in range(1, longest):
            nxt = np.logaddexp.reduce(fore[:, t - 1, :, None] + step, axis=1) + u[:, t]
            fore[:, t] = np.where(mask[:, t, None], nxt, fore[:, t - 1])
        for t in range(longest - 2, -1, -1):
            prev = np.logaddexp.reduce(step + (u[:, t + 1] + aft[:, t + 1])[:, None, :], axis=2)
            aft[:, t] = np.where(mask[:, t + 1, None], prev, 0.0)
        total = np.logaddexp.reduce(fore[:, -1], axis=1)
        node = np.exp(fore + aft - total[:, None, None]) * mask[..., None]
        edge = np.exp(fore[:, :-1, :, None] + step + (u + aft)[:, 1:, None, :] - total[:, None, None, None]) * both[..., None, None]
        grad = np.concatenate([(flat.T @ (gold - node).reshape(-1, 2).astype(np.float32)).ravel(), (gold[:, 0] - node[:, 0]).sum(axis=0), (gold_step - edge.sum(axis=(0, 1))).ravel()]) / n - ridge * p / n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        p = p + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    w = p[: 2 * width].reshape(width, 2)
    return {f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items()}, p[2 * width : 2 * width + 2].copy(), p[-4:].reshape(2, 2).copy()


# --- labelled pages: layouts with a known article, written by a seeded generator ---------------------

_SHELLS = ["article", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry-content"', 'div class="article-body"', 'div itemprop="articleBody"', 'section class="story"',
           'div class="text"', 'div role="main"', 'div class="post-body entry"', 'section', 'div', 'div class="blog-post"', 'div id="main"', 'div class="page-content"', 'div class="news-text article"']
_ASIDES = ["aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"', 'div class="related"', 'div class="side-bar right"', 'aside class="sidebar"', 'section class="recommended related-posts"', 'div role="complementary"', 'div class="sidebar widget-area"', 'aside class="related"']
_NOTICES = ['div class="cookie-notice"', 'div id="cookie-banner"', 'div class="consent"', 'div class="notice"', 'div class="notice alert"', 'div role="alert"', 'section class="gdpr consent"', 'div class="cookies"', 'div class="popup modal"', 'div role="dialog"', 'div class="privacy notice"', 'div class="banner"', 'div class="paywall subscribe"']
_ADS = ['div class="ad"', 'div class="ads"', 'div id="ad"', 'div class="advert"', 'div class="advertisement"', 'aside class="ad"', 'div class="sponsored"', 'div class="promo"', 'section class="sponsor"', 'div class="ad-banner"', 'div class="adbox"', 'ins class="adsbygoogle"', 'p class="ad"', 'div class="promotion"']
_COMMENTS = ['section id="comments"', 'div class="comments"', 'div id="comments"', 'ol class="comment-list"', 'section class="comments-area"', 'div class="discussion"', 'div class="reader-comments"', 'div class="replies"', 'aside class="comments"', 'div id="disqus"', 'section class="responses"', 'div class="user-comments feedback"']
_COMMENT = ['div class="comment"', 'article class="comment"', 'li class="comment"', 'div class="reply"', "div", "p", 'blockquote class="comment"', 'div class="comment-body"', "li"]
_NAVS = ["nav", 'div class="nav"', 'div id="menu"', 'ul class="menu"', 'div class="navbar"', 'div class="breadcrumb"', 'nav class="navigation"', 'div role="navigation"', 'div class="topbar"', 'nav class="breadcrumbs"', 'div class="tabs"', 'div class="pagination pager"']
_HEADS = ["header", 'div class="header"', 'div id="header"', 'header class="site-header"', 'div class="masthead"', 'div role="banner"', 'div class="top-header logo"']
_FOOTS = ["footer", 'div class="footer"', 'div id="footer"', 'footer class="site-footer"', 'div class="copyright"', 'div role="contentinfo"', 'div class="legal"', 'section class="footer bottom"']
_FORMS = ["form", 'form class="search"', 'div class="newsletter"', 'form class="subscribe"', 'div class="login"', 'form id="contact"', 'div class="signup form"', 'form class="comment-form"']
_SOCIAL = ['div class="share"', 'ul class="social"', 'div class="social-share"', 'div class="tags"', 'div class="byline meta"', 'div class="author-bio"', 'div class="toolbar"']


def _words(r: random.Random, a: int, z: int) -> str:
    return " ".join("".join(r.choice("aeioulnrstdmkpéü") for _ in range(r.randint(2, 9))) for _ in range(r.randint(a, z)))


def _prose(r: random.Random, a: int, z: int) -> str:
    """Sentences; sometimes without a point at the end, like a cut text."""
    out = ". ".join(_words(r, 3, 14).capitalize().replace(" ", r.choice([" ", " ", ", "]), 1) for _ in range(r.randint(a, z)))
    return out + r.choice([".", ".", ".", ".", "!", ""])


def labelled_page(r: random.Random) -> list[tuple[str, int]]:
    """(html, label) pieces of one page; markup pieces have label -1 and every text piece is one block."""
    out: list[tuple[str, int]] = []

    def put(tag: str, text: str, label: int) -> None:
        out.extend([(f"<{tag}>", -1), (text, label), (f"</{tag.split()[0]}>", -1)])

    def inside(tag: str, fill) -> None:
        out.append((f"<{tag}>", -1))
        fill()
        out.append((f"</{tag.split()[0]}>", -1))

    def links(label: int = 0) -> None:
        def item(): return [put("li", f'<a href="/x">{_words(r, 1, 3)}</a>', label) for _ in range(r.randint(2, 7))]
        inside("ul", item) if r.random() < 0.7 else [put("div", f'<a href="/x">{_words(r, 1, 3)}</a>', label) for _ in range(r.randint(1, 5))]

    def prose(kinds: list[str], wrap: bool = True, label: int = 0, a: int = 1, z: int = 4) -> None:
        def fill(): return [put(r.choice(["p", "p", "div", "h3"]), _prose(r, a, z), label) for _ in range(r.randint(1, 3))] if wrap and r.random() < 0.5 else out.append((_prose(r, a, z), label))
        inside(r.choice(kinds), fill)

    def form() -> None:
        def fill():
            put("label", _words(r, 1, 4), 0)
            out.append(('<br><input type="text"><div></div>', -1))
            if r.random() < 0.4:
                put("p", _prose(r, 1, 2), 0)
            if r.random() < 0.3:
                inside("select", lambda: [put("option", _words(r, 1, 2), 0) for _ in range(3)])
            put("button", _words(r, 1, 2), 0)
        inside(r.choice(_FORMS), fill)

    def comments() -> None:
        def fill():
            if r.random() < 0.6:
                put(r.choice(["h2", "h3"]), _words(r, 1, 3), 0)
            for _ in range(r.randint(1, 5)):
                prose(_COMMENT, a=1, z=5)
        inside(r.choice(_COMMENTS), fill)

    def extra() -> None:
        r.choice([lambda: prose(_ADS), lambda: prose(_ADS), lambda: prose(_NOTICES), lambda: inside(r.choice(_ASIDES), links), lambda: prose(_ASIDES), form, lambda: inside(r.choice(_SOCIAL), links), comments])()

    def article() -> None:
        if r.random() < 0.8:
            put(r.choice(["h1", "h1", "h2"]), _words(r, 1, 12), 1)
        for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14])):
            k = r.random()
            if k < 0.62:
                put(r.choice(["p", "p", "p", "p", "div"]), _prose(r, 1, 8), 1)
            elif k < 0.70:
                put(r.choice(["h2", "h3"]), _words(r, 1, 6), 1)
            elif k < 0.77:
                inside(r.choice(["ul", "ol"]), lambda: [put("li", _words(r, 1, 12), 1) for _ in range(r.randint(2, 5))])
            elif k < 0.82:
                inside("blockquote", lambda: put("p", _prose(r, 1, 3), 1))
            elif k < 0.86:
                put("pre", _words(r, 3, 20), 1)
            elif k < 0.89:
                inside("table", lambda: [inside("tr", lambda: [put(r.choice(["td", "th"]), _words(r, 1, 4), 1) for _ in range(2)]) for _ in range(3)])
            elif k < 0.92:
                inside("figure", lambda: put("figcaption", _prose(r, 1, 2), 1))
            elif k < 0.94:
                put("p", _words(r, 1, 3) + f' <a href="/y">{_words(r, 1, 6)}</a>', 1)
            else:
                extra()

    for _ in range(r.randint(0, 2)):
        r.choice([lambda: prose(_NOTICES), lambda: prose(_ADS), lambda: inside(r.choice(_HEADS), lambda: put(r.choice(["h1", "p", "div"]), _words(r, 1, 5), 0))])()
    inside(r.choice(_NAVS), links)
    for _ in range(r.randint(0, 2)):
        extra()
    shell = r.choice(_SHELLS + ["article"] * 6 + ["main"] * 3)
    if r.random() < 0.25:
        inside("main", lambda: inside(shell, article))
    else:
        inside(shell, article)
    for _ in range(r.randint(0, 3)):
        extra()
    if r.random() < 0.3:
        comments()
    prose(_FOOTS, a=1, z=2) if r.random() < 0.6 else inside(r.choice(_FOOTS), lambda: out.append((f"&copy; {_words(r, 1, 3)} &middot; {_prose(r, 1, 1)}", 0)))
    return out


def labelled_pages(count: int = 500, seed: int = 7) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of generated pages, read by the same block reader as any page."""
    r, out = random.Random(seed), []
    for _ in range(count):
        pieces = labelled_page(r)
        got, want = blocks("<html><body>" + "".join(h for h, _ in pieces) + "</body></html>"), [k for _, k in pieces if k >= 0]
        if len(got) == len(want):
            out.append(([features(b, i, len(got)) for i, b in enumerate(got)], want))
    return out


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def main_text(page: str, model: Model) -> str:
    """The content blocks of a page, one line each."""
    got = blocks(page)
    labels = viterbi(_scores(model, [features(b, i, len(got)) for i, b in enumerate(got)]), model[1], model[2])
    return "\n".join(b.text for b, k in zip(got, labels) if k == CONTENT)


def extract_pages(pages: DataFrame, model: Model | None = None, html: str = "html") -> DataFrame:
    """Every column but ``html``, and ``text`` and ``n_chars``. A null page is an empty one; a page without content gives an empty text.

    An older ``text`` or ``n_chars`` column is replaced. Repeated rows each give a row.
    """
    model = model or default_model()
    rest = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    slim = pages.select(*rest, html)
    schema = "".join(f"`{n}` {t}, " for n, t in slim.dtypes if n != html) + "text string, n_chars long"

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            texts = [main_text(p or "", model) for p in batch.column(batch.num_columns - 1).to_pylist()]
            return {f: batch.column(i) for i, f in enumerate(rest)} | {"text": texts, "n_chars": [len(t) for t in texts]}

        return step

    return over_batches(slim, make, schema)
