"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

1. A tolerant tag scan builds the element tree of a page (implied end tags, raw
   text elements, void elements). A text run right under body or html is an
   element of its own, of the kind of a paragraph. A head ends where something
   begins that may not stand in it.
2. Every element gets features: kind of tag, depth, place among its siblings and
   how many are alike, size and density of its subtree (text, link text, tags,
   paragraphs, sentence marks), tokens of class, id and role, and what its
   ancestors are.
3. Gradient-boosted trees give the log odds that an element belongs to the
   article. They are trained on the driver on `MADE_PAGES` made pages of many
   layouts, whose truth is known, and on `SAMPLE_PAGES` pages of the table that
   have one <article> or <main>; both bounds are independent of the table's size.
4. Decoding picks the set of elements with the largest sum of odds such that an
   element is kept only with its parent: a maximum closure, found bottom up.
5. Text of kept elements is cut into blocks at block elements; character
   references are decoded, white space becomes one space, blocks join with a line
   feed.

Scripts, styles, templates, form controls and what stands in for media that a
browser shows (iframe, audio, video, canvas) hold no text and have no odds; the
text of math, svg and object is text.

Defined cases: a null html is an empty page with empty text; a page without kept
text gives an empty text; an empty table gives an empty one. Repeated rows are
read one by one; extra columns stay, but for one named like the output. The scan
takes time in proportion to the page whatever it holds: open elements are found
by their names, and after `OPEN_QUOTES` tags with a quote that never ends quotes
no longer hide a ">". The sample follows the hashes of `key`, so it does not
depend on how the table lies in files; rows without a key are not sampled.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subventa.llm.store import free_name, sample_by_hash

MADE_PAGES = 500
# Further made pages whose article stands right in the body.
MADE_BARE = 120
SAMPLE_PAGES = 60
TREES, DEPTH, BINS = 40, 4, 32
# Tags with an endless quote after which quotes are signs like others.
OPEN_QUOTES = 16

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S
)
_TAG_UNQUOTED = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>()()()", re.S)
_ATTR = re.compile(r"(?<![^\s=\"'<>/])([^\s=\"'<>/]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_LONG_NUMBER = re.compile(r"&#([0-9]{8,})")
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption legend option select xmp".split()
)
_SILENT = set("script style noscript template title head iframe textarea canvas audio video select option datalist button input".split())
_ENDS_P = _BLOCK - {"html", "body", "option", "select", "caption", "legend", "td", "th", "tr", "tbody", "thead", "tfoot"}
# End tags of these names reach no further than the innermost of those.
_INLINE_ENDS = {"p", "b", "i", "a", "span", "em", "strong", "li"}
_BARRIERS = ("article", "main", "table", "td", "th")
# Start tag -> open elements it ends, and where the search stops.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}

_BAD = set(
    "ad ads advert adverts advertisement adsbygoogle adslot banner sponsor sponsored promo promotion sidebar aside side menu nav navbar navigation navi "
    "footer foot header masthead topbar comment comments respond replies disqus cookie cookies consent gdpr notice alert popup modal overlay newsletter "
    "subscribe signup login share sharing social related recommended more breadcrumb breadcrumbs pagination pager widget form search tags meta toolbar skip "
    "copyright legal disclaimer warning notification hint".split()
)
_GOOD = set("article content main post entry story body text hentry page copy articlebody postbody".split())
_KINDS = {
    k: i
    for i, names in enumerate(
        ("", "html body", "article main", "section", "div span", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "a", "nav", "header", "footer", "aside",
         "form fieldset label legend input button", "table tbody thead tr td th", "blockquote pre xmp code figure figcaption", "b i em strong u small sub sup mark math svg object")
    )
    for k in names.split()
}
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
_STOPS = re.compile(r"[.!?,;]")
N_FEATURES = 24
# A text run under body or html, with the inline elements that follow in it.
RUN = "#run"
_KINDS[RUN] = _KINDS["p"]
_IN_HEAD = set("head base basefont bgsound link meta title style script noscript noframes template".split())


@dataclass
class Page:
    tags: list[str]
    parents: list[int]
    depths: list[int]
    attrs: list[str]
    # In page order: (element, text) for text, (element, None) where a block element begins or ends.
    events: list[tuple[int, str | None]]


def parse(source: str) -> Page:
    page = Page(["html"], [-1], [0], [""], [])
    stack = [0]
    at, n = 0, len(source)
    tags, parents, depths, attrs, events = page.tags, page.parents, page.depths, page.attrs, page.events
    # Places in the stack: of the open elements of each name, and of the open block elements.
    opened: dict[str, list[int]] = {}
    blocks: list[int] = []

    def push(own: int) -> None:
        opened.setdefault(tags[own], []).append(len(stack))
        if tags[own] in _BLOCK:
            blocks.append(len(stack))
        stack.append(own)

    def close_to(k: int) -> None:
        while len(stack) > k:
            gone = stack.pop()
            opened[tags[gone]].pop()
            if tags[gone] in _BLOCK:
                blocks.pop()
                events.append((gone, None))

    def innermost(names: Iterable[str]) -> int:
        """Place in the stack of the innermost open element of these names, 0 if there is none."""
        return max((opened[x][-1] for x in names if opened.get(x)), default=0)

    def text_at(t: str) -> None:
        if t.strip():
            if tags[stack[-1]] == "head":
                close_to(len(stack) - 1)
            if tags[stack[-1]] in ("html", "body"):
                tags.append(RUN)
                parents.append(stack[-1])
                depths.append(depths[stack[-1]] + 1)
                attrs.append("")
                push(len(tags) - 1)
        events.append((stack[-1], t))

    # Behind the last ">" there is no tag, only a comment that is left open.
    last = source.rfind(">") + 1
    pattern, open_quotes = _TAG, 0
    while at < n:
        m = pattern.search(source, at, last) if at < last else None
        if m is None:
            comment = source.find("<!--", at)
            if comment != at:
                text_at(source[at : comment if comment >= 0 else n])
            break
        if m.start() > at:
            text_at(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<!--") and (len(m[0]) < 7 or not m[0].endswith("-->")):
                break
            continue
        if m[5]:
            open_quotes += 1
            if open_quotes >= OPEN_QUOTES:
                pattern = _TAG_UNQUOTED
        name = name.lower()
        if m[1] or m[4]:
            k = innermost((name,))
            if k and not (name in _INLINE_ENDS and innermost(_BARRIERS) > k):
                close_to(k)
            continue
        if name == "html":
            continue
        if name in _ENDS_P and blocks and tags[stack[blocks[-1]]] == "p":
            close_to(blocks[-1])
        if name in _ENDS:
            ended, stop = _ENDS[name]
            while (k := innermost(ended)) > innermost(stop):
                close_to(k)
        if tags[stack[-1]] == "head" and name not in _IN_HEAD or tags[stack[-1]] == RUN and name in _BLOCK:
            close_to(len(stack) - 1)
        if name == "br":
            events.append((stack[-1], " "))
        own = len(tags)
        tags.append(name)
        parents.append(stack[-1])
        depths.append(depths[stack[-1]] + 1)
        attrs.append(m[3] or m[6] or "")
        if name in _BLOCK:
            events.append((own, None))
        if name in _VOID:
            continue
        if name in _RAW:
            end = _RAW[name].search(source, at, last)
            if name == "xmp":
                events.append((own, source[at : end.start() if end else n].replace("&", "&amp;")))
                events.append((own, None))
            at = end.end() if end else n
            continue
        if not attrs[own].endswith("/") or name not in ("svg", "math", "path"):
            push(own)
    close_to(1)
    return page


def features(page: Page) -> np.ndarray:
    """(elements, N_FEATURES), small counts and shares."""
    n = len(page.tags)
    parents = page.parents
    text, link, marks = [0] * n, [0] * n, [0] * n
    own = [0] * n
    for i, t in page.events:
        if t is not None:
            size = len(t) - t.count(" ")
            own[i] += size
            marks[i] += len(_STOPS.findall(t))
    below, paragraphs, links, forms = [1] * n, [0] * n, [0] * n, [0] * n
    children, place, alike = [0] * n, [0] * n, [0] * n
    same: dict[tuple[int, str], int] = {}
    bad, good, under = [0] * n, [0] * n, [0] * n
    for i, tag in enumerate(page.tags):
        p = parents[i]
        text[i] += own[i]
        if tag == "a":
            link[i] = own[i]
            links[i] = 1
        if tag in ("p", RUN):
            paragraphs[i] = 1
        if tag in ("input", "button", "select", "textarea", "label"):
            forms[i] = 1
        if p >= 0:
            place[i] = children[p]
            children[p] += 1
            key = (p, tag)
            same[key] = same.get(key, 0) + 1
        raw = page.attrs[i]
        if raw:
            for name, a, b, c in _ATTR.findall(raw):
                lowered = name.lower()
                if lowered in ("class", "id", "role", "itemprop", "aria-label"):
                    for w in _WORD.findall(a or b or c):
                        w = w.lower()
                        bad[i] += w in _BAD or w in ("contentinfo", "complementary", "dialog")
                        good[i] += w in _GOOD
        flags = under[p] if p >= 0 else 0
        if tag in ("article", "main"):
            flags |= 1
        if tag in ("nav", "aside", "footer", "form", "menu", "dialog"):
            flags |= 2
        if bad[i]:
            flags |= 4
        if good[i]:
            flags |= 8
        if tag == "header":
            flags |= 16
        under[i] = flags
    for i in range(n - 1, 0, -1):
        p = parents[i]
        text[p] += text[i]
        link[p] += text[i] if page.tags[i] == "a" else link[i]
        marks[p] += marks[i]
        below[p] += below[i]
        paragraphs[p] += paragraphs[i]
        links[p] += links[i]
        forms[p] += forms[i]
    for i in range(1, n):
        alike[i] = same[(parents[i], page.tags[i])]
    whole = max(text[0], 1)
    out = np.zeros((n, N_FEATURES), np.float32)
    up = np.maximum(np.array(parents), 0)
    t, li = np.array(text, np.float32), np.array(link, np.float32)
    flags = np.array(under)
    out[:, 0] = [_KINDS.get(k, 0) for k in page.tags]
    out[:, 1] = page.depths
    out[:, 2] = children
    out[:, 3] = place
    out[:, 4] = np.array(children)[up] - out[:, 3]
    out[:, 5] = alike
    out[:, 6] = t
    out[:, 7] = t / whole
    out[:, 8] = li / np.maximum(t, 1)
    out[:, 9] = t / np.array(below)
    out[:, 10] = paragraphs
    out[:, 11] = np.array(marks) / np.maximum(t, 1)
    out[:, 12] = links
    out[:, 13] = forms
    out[:, 14] = bad
    out[:, 15] = good
    for k in range(5):
        out[:, 16 + k] = (flags >> k) & 1
    out[:, 21] = out[up, 8]
    out[:, 22] = out[up, 0]
    out[:, 23] = own
    return out


@dataclass
class Trees:
    """Boosted trees of equal depth over binned features."""

    edges: np.ndarray  # (features, BINS - 1)
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, leaves)
    start: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[f], x[:, f], "left") for f in range(x.shape[1])], axis=1).astype(np.int8)

    def odds(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        rows = np.arange(len(x))
        out = np.full(len(x), self.start)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Logistic loss, second-order gains on histograms; ties go to the first feature and cut."""
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.stack([np.quantile(x[:, f], quantiles, method="lower") for f in range(x.shape[1])]).astype(np.float32)
    inner = 2**DEPTH - 1
    share = float((y * weight).sum() / weight.sum())
    start = float(np.log(share / (1 - share)))
    model = Trees(edges, np.zeros((TREES, inner), np.int64), np.full((TREES, inner), BINS, np.int8), np.zeros((TREES, 2**DEPTH)), start)
    b = model.binned(x)
    score = np.full(len(x), start)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-score))
        slope, curve = (y - p) * weight, p * (1 - p) * weight
        at = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            local = at - first
            for f in range(x.shape[1]):
                code = local * BINS + b[:, f]
                g = np.bincount(code, slope, width * BINS).reshape(width, BINS).cumsum(axis=1)
                h = np.bincount(code, curve, width * BINS).reshape(width, BINS).cumsum(axis=1)
                total_g, total_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
                k = gain[:, :-1].argmax(axis=1)
                top = gain[np.arange(width), k]
                better = top > best
                best = np.where(better, top, best)
                model.feature[t, first : first + width] = np.where(better, f, model.feature[t, first : first + width])
                model.cut[t, first : first + width] = np.where(better, k, model.cut[t, first : first + width])
            at = 2 * at + 1 + (b[np.arange(len(x)), model.feature[t][at]] > model.cut[t][at])
        leaf = at - inner
        g, h = np.bincount(leaf, slope, 2**DEPTH), np.bincount(leaf, curve, 2**DEPTH)
        model.leaf[t] = rate * g / (h + ridge)
        score += model.leaf[t][leaf]
    return model


def chosen(page: Page, odds: np.ndarray) -> list[bool]:
    """Elements of the best choice that keeps no element without its parent."""
    n = len(page.tags)
    sizes = [0] * n
    for i, t in page.events:
        if t is not None:
            sizes[i] += len(t)
    best = [0.0] * n
    keep = [False] * n
    for i in range(n - 1, -1, -1):
        if page.tags[i] in _SILENT:
            best[i] = -1.0
            continue
        best[i] += float(odds[i]) * (1.0 + sizes[i]) ** 0.5 if page.tags[i] not in ("html", "body") else 0.0
        if i and best[i] > 0:
            best[page.parents[i]] += best[i]
    keep[0] = True
    for i in range(1, n):
        keep[i] = keep[page.parents[i]] and page.tags[i] not in _SILENT and (best[i] > 0 or page.tags[i] == "body")
    return keep


def _decoded(block: str) -> str:
    """`block` without character references; numbers beyond any code point are U+FFFD, however long."""
    if "&" not in block:
        return block
    return html.unescape(_LONG_NUMBER.sub(lambda m: "&#" + (m[1].lstrip("0") or "0")[:8], block))


def text_of(page: Page, keep: list[bool]) -> str:
    blocks, held = [], []
    for i, t in page.events:
        if t is None:
            if held:
                blocks.append("".join(held))
                held = []
        elif keep[i] and page.tags[i] not in ("html", "body"):
            held.append(t)
    if held:
        blocks.append("".join(held))
    cleaned = (" ".join(_decoded(b).split()) for b in blocks)
    return "\n".join(b for b in cleaned if b)


# --- training pages -------------------------------------------------------


def _truth(page: Page) -> np.ndarray:
    """1 for elements marked data-k (with all below that are not marked data-x) and those above them."""
    n = len(page.tags)
    inside = [False] * n
    y = np.zeros(n)
    for i in range(n):
        p = page.parents[i]
        inside[i] = (p >= 0 and inside[p] or "data-k" in page.attrs[i]) and "data-x" not in page.attrs[i]
        y[i] = inside[i]
    return y


def made_page(rng: random.Random, words: list[str], bare_body: bool = False) -> str:
    """A page of a random layout; data-k marks the article, data-x what does not belong to it. `bare_body` leaves out the element around the article."""
    w = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randint(a, b)))
    sentence = lambda: (lambda s: s[:1].upper() + s[1:] + rng.choice([".", ".", "!", "?", ","]))(w(4, 16))
    prose = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))
    links = lambda a, b: "".join(f"<li><a href='/{i}'>{w(1, 3)}</a></li>" for i in range(rng.randint(a, b)))
    named = lambda *names: rng.choice([f" class='{rng.choice(names)}'", f" id='{rng.choice(names)}'", f" class='x {rng.choice(names)} y'"])
    bare = lambda attr: attr if rng.random() < 0.85 else ""

    def menu() -> str:
        tag = rng.choice(["nav", "nav", "div", "ul"])
        body = links(3, 9) if tag == "ul" else f"<ul>{links(3, 9)}</ul>"
        return f"<{tag}{bare(named('menu', 'nav', 'navbar', 'navigation', 'breadcrumb')) if tag != 'nav' else ''} data-x>{body}</{tag}>"

    def advert() -> str:
        return f"<{(t := rng.choice(['div', 'div', 'aside', 'section', 'p']))}{named('ad', 'ads', 'advert', 'sponsored', 'banner', 'promo')} data-x>{rng.choice([sentence(), prose(1, 3), f'<a href=x>{sentence()}</a>', f'<p>{sentence()}</p>'])}</{t}>"

    def sidebar() -> str:
        tag = rng.choice(["aside", "div", "section"])
        return f"<{tag}{'' if tag == 'aside' and rng.random() < 0.5 else named('sidebar', 'side', 'widget', 'related')} data-x><h3>{w(1, 3)}</h3>{rng.choice([f'<ul>{links(2, 6)}</ul>', f'<p>{prose(1, 4)}</p>', f'<p>{prose(1, 2)}</p><ul>{links(2, 4)}</ul>'])}</{tag}>"

    def notice() -> str:
        return f"<{(t := rng.choice(['div', 'section', 'p', 'aside']))}{named('cookie', 'cookie-notice', 'consent', 'notice', 'alert', 'newsletter', 'popup')} data-x>{rng.choice([prose(1, 3), f'<p>{prose(1, 3)}</p><button>ok</button>', f'<span>{sentence()}</span> <a href=x>{w(1, 2)}</a>'])}</{t}>"

    def form() -> str:
        return f"<form{rng.choice(['', named('search', 'login', 'subscribe')])} data-x><label>{w(1, 3)}</label><input name=q><p>{w(1, 6)}</p><button>{w(1, 1)}</button></form>"

    def share() -> str:
        return f"<div{named('share', 'social', 'tags', 'meta')} data-x>{rng.choice([f'<ul>{links(2, 5)}</ul>', f'<a href=x>{w(1, 1)}</a> <a href=y>{w(1, 1)}</a>'])}</div>"

    def comments() -> str:
        one = lambda: rng.choice([f"<div class=comment><b>{w(1, 2)}</b><p>{prose(1, 4)}</p></div>", f"<li class='comment'><p>{prose(1, 4)}</p></li>", f"<article class='comment'><p>{prose(1, 4)}</p></article>", f"<p>{prose(1, 3)}</p>"])
        return f"<{(t := rng.choice(['section', 'div', 'ol', 'ul']))}{named('comments', 'comment-list', 'respond', 'replies', 'comments-area')} data-x>{'' if t in ('ol', 'ul') else f'<h2>{w(1, 3)}</h2>'}{''.join(one() for _ in range(rng.randint(1, 6)))}</{t}>"

    def footer() -> str:
        tag = rng.choice(["footer", "footer", "div"])
        return f"<{tag}{'' if tag == 'footer' else named('footer', 'copyright', 'legal')} data-x>{rng.choice([w(2, 8), f'<p>{prose(1, 2)}</p>', f'<ul>{links(2, 6)}</ul><p>{w(2, 6)}</p>', f'<p>{w(1, 4)} <a href=x>{w(1, 2)}</a></p>'])}</{tag}>"

    def header() -> str:
        tag = rng.choice(["header", "header", "div"])
        return f"<{tag}{'' if tag == 'header' else named('header', 'masthead', 'topbar')} data-x>{rng.choice([f'<h1>{w(1, 4)}</h1>', f'<p>{w(1, 6)}</p>', f'<a href=/>{w(1, 3)}</a>', f'<div>{w(2, 5)}</div>'])}{rng.choice(['', menu()])}</{tag}>"

    def paragraph() -> str:
        body = prose(1, 6)
        if rng.random() < 0.25:
            body += f" <{(t := rng.choice(['b', 'i', 'em', 'a href=z', 'span', 'strong']))}>{w(1, 5)}</{t.split()[0]}> {sentence()}"
        if rng.random() < 0.1:
            return f"<p><b>{body}<br>"
        return rng.choice([f"<p>{body}</p>"] * 8 + [f"<p>{body}", f"<div>{body}</div>", f"<p>{w(1, 3)}</p>"])

    def extra() -> str:
        return rng.choice([
            lambda: f"<h2>{w(1, 6)}</h2>", lambda: f"<h3>{w(1, 5)}</h3>", lambda: f"<ul>{''.join(f'<li>{sentence()}</li>' for _ in range(rng.randint(2, 6)))}</ul>",
            lambda: f"<ol>{''.join(f'<li>{w(2, 9)}</li>' for _ in range(rng.randint(2, 5)))}</ol>", lambda: f"<blockquote><p>{prose(1, 3)}</p></blockquote>",
            lambda: f"<table><tr><th>{w(1, 2)}</th><th>{w(1, 2)}</th></tr><tr><td>{w(1, 3)}</td><td>{w(1, 3)}</td></tr></table>", lambda: f"<pre>{w(3, 12)}</pre>",
            lambda: f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>",
        ])()

    inside = [rng.choice([f"<h1>{w(1, 8)}</h1>", f"<h1>{sentence()}</h1>", f"<header><h1>{w(1, 8)}</h1></header>", ""])]
    for _ in range(rng.choice([1, 2, 3, 5, 9, 14])):
        inside.append(paragraph())
        if rng.random() < 0.15:
            inside.append(extra())
        if rng.random() < 0.08:
            inside.append(rng.choice([advert, advert, share, notice, sidebar, form])())
    if rng.random() < 0.15:
        inside.append(comments())
    if rng.random() < 0.15:
        inside.append(share())
    tag, attr = rng.choice([("article", ""), ("article", ""), ("article", " class='post'"), ("main", ""), ("div", named("content", "main", "post", "entry", "story", "articlebody")), ("section", named("content", "main", "article")), ("div", "")])
    body = f"<{tag}{attr} data-k>{''.join(inside)}</{tag}>"
    if rng.random() < 0.3:
        outer = rng.choice(["div", "div class=wrapper", "main", "div id=page", "section"])
        body = f"<{outer}>{rng.choice(['', advert(), sidebar()])}{body}{rng.choice(['', sidebar(), comments(), advert()])}</{outer.split()[0]}>"
    before = [f() for f in (notice, header, menu, form, advert) if rng.random() < 0.45]
    after = [f() for f in (comments, sidebar, form, share, advert, notice, footer) if rng.random() < 0.35]
    rng.shuffle(before)
    if bare_body:
        body = "".join(inside)
        if rng.random() < 0.7:
            body = re.sub(r"</?p>", rng.choice(["<br>", "<br><br>", " "]), body)
        return f"<html><body data-k>{''.join(before) if rng.random() < 0.5 else ''}{body}{''.join(after) if rng.random() < 0.5 else ''}</body></html>"
    return f"<!DOCTYPE html><html><head><title>{w(1, 5)}</title><style>p{{}}</style></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"


def _sampled_truth(page: Page) -> np.ndarray | None:
    """Truth of a page with one <article> or <main>: what lies in it, but for the parts that say what they are."""
    roots = [i for i, t in enumerate(page.tags) if t == "article"] or [i for i, t in enumerate(page.tags) if t == "main"]
    if len(roots) != 1:
        return None
    x = features(page)
    inside = [False] * len(page.tags)
    for i in range(len(page.tags)):
        p = page.parents[i]
        inside[i] = i == roots[0] or p >= 0 and inside[p] and page.tags[i] not in ("nav", "aside", "footer", "form") and not x[i, 14]
    return np.array(inside, float)


def fitted(sources: list[str]) -> Trees:
    """Trees from made pages with words of the sources, and from the sources with one article."""
    rng = random.Random(11)
    words = sorted({w for s in sources for w in re.findall(r"[^\W\d_]{2,12}", s)})[:5000] or ["word"]
    words += ["the", "of", "and", "to", "in"] * 20
    xs, ys, ws = [], [], []
    pages = [parse(made_page(rng, words)) for _ in range(MADE_PAGES)]
    own = random.Random(12)
    pages += [parse(made_page(own, words, bare_body=True)) for _ in range(MADE_BARE)]
    labelled = [(p, _truth(p)) for p in pages] + [(p, y) for p in map(parse, sources) if (y := _sampled_truth(p)) is not None]
    for page, y in labelled:
        use = np.array([t not in _SILENT and t not in ("html", "body") for t in page.tags])
        # An element around the article that is no part of it is neither.
        holds = np.zeros(len(y), bool)
        for i in range(len(y) - 1, 0, -1):
            if y[i] or holds[i]:
                holds[page.parents[i]] = True
        use &= ~(holds & (y == 0)) | (y > 0)
        x = features(page)
        extra = x[holds & (y == 0) & np.array([t not in ("html", "body", "head") for t in page.tags])]
        xs += [x[use], extra]
        ys += [y[use], np.ones(len(extra))]
        ws += [np.sqrt(1 + np.minimum(x[use, 23], 400)), np.full(len(extra), 3.0)]
    return boost(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


def extracted(source: str, trees: Trees) -> str:
    page = parse(source)
    return text_of(page, chosen(page, trees.odds(features(page))))


def _text_batches(trees: Trees, column: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            values = batch.column(batch.schema.get_field_index(column)).to_pylist()
            for first in range(0, len(values), 64):
                pages = [parse(v or "") for v in values[first : first + 64]]
                tables = [features(p) for p in pages]
                odds = trees.odds(np.concatenate(tables))
                ends = np.cumsum([len(t) for t in tables])
                texts += [text_of(p, chosen(p, odds[e - len(t) : e])) for p, t, e in zip(pages, tables, ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return run


def trained(pages: DataFrame, column: str = "html", key: str | None = None) -> Trees:
    """Trees for `pages`; the sample goes by the hashes of `key`, or of the pages themselves."""
    return fitted([r[0] or "" for r in sample_by_hash(pages, column, SAMPLE_PAGES, key)])


def main_texts(pages: DataFrame, column: str = "html", out: str = "text", trees: Trees | None = None, key: str | None = None) -> DataFrame:
    """`pages` with the main text of each in column `out`, which replaces one of that name."""
    trees = trees or trained(pages, column, key)
    if out == column:
        raise ValueError("the text needs a column of its own")
    left = pages.select([F.col(c) for c in pages.columns if c.lower() != out.lower()])
    name = free_name(left, out)
    schema = T.StructType([*left.schema.fields, T.StructField(name, T.StringType())])
    return left.mapInArrow(_text_batches(trees, column, name), schema)
