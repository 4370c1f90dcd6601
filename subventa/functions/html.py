"""Small tag walk over one page, used inside the extraction job's Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Elements whose text is code, never prose.
CODE = frozenset(("script", "style", "template"))
# Starting one of these ends an open paragraph.
ENDS_PARAGRAPH = frozenset(
    "address blockquote center dd dir div dl dt fieldset form h1 h2 h3 h4 h5 h6 hr li menu ol p pre table ul".split()
)
PARAGRAPH_BARRIER = frozenset("table caption td th button object body html".split())
ENDS_SIBLING = frozenset("li option tr td th dt dd".split())


class _Element:
    """An element with what it inherits; texts and elements below it are ranges of the page's lists."""

    __slots__ = ("tag", "classes", "order", "end", "first_text", "end_text", "code", "head", "in_main", "n_blocked")

    def __init__(self, tag, classes, parent, order, first_text, blocked):
        self.tag, self.classes, self.order, self.first_text = tag, classes, order, first_text
        self.end = self.end_text = None
        self.code = tag in CODE or (parent is not None and parent.code)
        self.head = tag in ("head", "title") or (parent is not None and parent.head)
        self.in_main = parent is not None and (parent.in_main or parent.tag == "main")
        self.n_blocked = (tag in blocked) + (parent.n_blocked if parent is not None else 0)

    def within(self, other) -> bool:
        return other.order <= self.order < other.end


class _Walk(HTMLParser):
    def __init__(self, blocked: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.blocked = blocked
        self.root = _Element("", (), None, -1, 0, blocked)
        self.open = [self.root]
        self.open_tags: dict[str, int] = {}
        self.elements: list[_Element] = []
        self.texts: list[tuple[_Element, str]] = []
        self.meta: str | None = None
        self._buffer: list[str] = []

    def _flush(self):
        if self._buffer:
            self.texts.append((self.open[-1], "".join(self._buffer)))
            self._buffer = []

    def _pop(self):
        gone = self.open.pop()
        gone.end, gone.end_text = len(self.elements), len(self.texts)
        self.open_tags[gone.tag] = self.open_tags.get(gone.tag, 0) - 1

    def _close_to(self, tag: str, barrier: frozenset[str]):
        if not self.open_tags.get(tag):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                while len(self.open) > depth:
                    self._pop()
                return
            if self.open[depth].tag in barrier:
                return

    def handle_starttag(self, tag, attrs):
        self._flush()
        values = dict(attrs)
        if tag == "meta":
            if self.meta is None and values.get("name") == "description":
                self.meta = values.get("content") or ""
            return
        if tag in VOID:
            if tag in ENDS_PARAGRAPH:
                self._close_to("p", PARAGRAPH_BARRIER)
            return
        if tag in ENDS_PARAGRAPH:
            self._close_to("p", PARAGRAPH_BARRIER)
        if tag in ENDS_SIBLING and self.open[-1].tag == tag:
            self._pop()
        if tag == "body":
            self._close_to("head", frozenset())
        element = _Element(tag, tuple((values.get("class") or "").split()), self.open[-1], len(self.elements), len(self.texts), self.blocked)
        self.elements.append(element)
        self.open.append(element)
        self.open_tags[tag] = self.open_tags.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        self._close_to(tag, frozenset())

    def handle_data(self, data):
        self._buffer.append(data)

    def handle_comment(self, data):
        self._flush()

    def close(self):
        super().close()
        self._flush()
        while self.open:
            self._pop()


def page_parts(html: str, blocked: frozenset[str], article_scope: bool) -> dict:
    """Title, headings, paragraphs, body text and scan text of one page.

    `blocked` elements are dropped inside the content scope only, so the scan
    text keeps navigation that lies outside it.
    """
    walk = _Walk(blocked)
    walk.feed(html)
    walk.close()

    def first(tag):
        return next((e for e in walk.elements if e.tag == tag), None)

    def prose(e):
        return [text for owner, text in walk.texts[e.first_text : e.end_text] if not owner.code]

    main, body = first("main"), first("body")
    scope = main or (first("article") if article_scope else None) or body or walk.root
    title = first("title")
    body_nodes, scan_nodes = [], []
    for at, (owner, text) in enumerate(walk.texts):
        in_scope = scope.first_text <= at < scope.end_text
        if owner.code or (in_scope and owner.n_blocked > scope.n_blocked):
            continue
        scan_nodes.append(text)
        if in_scope and not (scope is walk.root and owner.head):
            body_nodes.append(text)
    title_pieces = [] if title is None else prose(title)

    paragraph_root = main or walk.root
    return {
        "page_title": title_pieces[0] if len(title_pieces) == 1 else None,
        "headings": [
            {
                "tag": e.tag,
                "classes": list(e.classes),
                "in_main": e.in_main,
                "text": "".join(prose(e)),
            }
            for e in walk.elements
            if e.tag == "h1" or "title-headline" in e.classes
        ],
        "paragraphs": [
            "".join(prose(e)) for e in walk.elements if e.tag == "p" and e.within(paragraph_root)
        ],
        "meta_description": walk.meta,
        "body_text": "\n".join(body_nodes),
        "scan_text": " ".join(scan_nodes),
    }
