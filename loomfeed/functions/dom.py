"""A small HTML tree on the standard parser, and content extraction over it.

Unclosed paragraphs, list items, rows and cells are closed where HTML closes
them, so blocks never nest by accident.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

# What holds an article, in order of preference: (ancestor or None, attribute, value) or a tag name.
CANDIDATES = [
    (None, "itemprop", "articleBody"), ("article", "data-component", "text-block"), ("article", "class", "article-content"), ("article", "class", "article-body"),
    ("article", "class", "post-content"), ("article", "class", "entry-content"), (None, "class", "article-content"), (None, "class", "article-body"),
    (None, "class", "post-content"), (None, "class", "entry-content"), (None, "class", "story-body"), (None, "class", "content-body"), "article", "main",
]
# Tags that are dropped with their content, tags that stay, and tags that make a block of text.
DROPPED = frozenset("script style noscript template svg canvas iframe form button input select textarea nav footer aside".split())
ALLOWED = frozenset("h2 h3 h4 h5 h6 p br ul ol li blockquote pre code strong b em i a hr table thead tbody tfoot tr th td caption figure figcaption sup sub kbd samp var".split())
BLOCKS = frozenset("h2 h3 h4 h5 h6 p li blockquote pre figcaption caption tr".split())
# Name parts that mark a container as noise.
NOISE = (
    "ad ads advert advertisement banner breadcrumb cookie comment comments footer header-nav newsletter paywall popup promo recommend "
    "related share sharing sidebar social sponsor subscribe subscription toc toolbar"
)
_NOISE = re.compile("(?:^|[-_])(?:" + "|".join(NOISE.split()) + ")(?:$|[-_])", re.I)
_EMPTY = frozenset("p li blockquote figcaption caption h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = re.compile("[ \t\f\v]+")
_IMPLIED = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_ENDS_P = frozenset("div ul ol table section article aside nav footer header main pre h1 h2 h3 h4 h5 h6 blockquote form li tr td th figure p".split())
#: Nesting beyond this is flattened, so no page exhausts the stack.
DEEPEST = 200
_WALL = frozenset("table ul ol dl div article section main body".split())


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    parent: Node | None = None

    def walk(self) -> Iterator[Node]:
        """Descendant elements in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self) -> Iterator[str]:
        todo: list[Node | str] = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            else:
                todo.extend(reversed(x.children))

    def text(self, joint: str = " ") -> str:
        return joint.join(s for x in self.strings() if (s := x.strip()))

    def inline(self) -> str:
        return _INLINE.sub(" ", self.text()).strip()

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def find(self, *tags: str) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag in tags)


class _Builder(HTMLParser):
    def __init__(self, drop: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[root]")
        self.depth = 0
        self.flat: dict[str, int] = {}
        self.drop = drop
        self.dropping: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.dropping or tag in self.drop:
            if tag not in _VOID:
                self.dropping.append(tag)
            return
        self._close_implied(tag)
        if tag not in _VOID and self.depth >= DEEPEST + 50 * (tag in BLOCKS):
            self.flat[tag] = self.flat.get(tag, 0) + 1
            return
        node = Node(tag, {k: v or "" for k, v in attrs}, parent=self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node
            self.depth += 1

    def _rise(self, to: Node) -> None:
        while self.at is not to:
            self.at = self.at.parent
            self.depth -= 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if not self.dropping and tag not in self.drop:
            self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, parent=self.at))

    def _close_implied(self, tag: str) -> None:
        closes = _IMPLIED.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
        node, last = self.at, None
        while node.parent is not None and closes:
            if node.tag in closes:
                last = node
            elif node.tag in _WALL:
                break
            node = node.parent
        if last is not None:
            self._rise(last.parent)

    def handle_endtag(self, tag: str) -> None:
        if self.dropping:
            if tag in self.dropping:
                while self.dropping.pop() != tag:
                    pass
            return
        if self.flat.get(tag):
            self.flat[tag] -= 1
            return
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self._rise(node.parent)
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        if not self.dropping:
            self.at.children.append(data)


def parse(html: str | bytes, drop: frozenset[str] = frozenset({"script", "style", "template"})) -> Node:
    """The tree of a document, without comments and the tags in ``drop``; broken markup is read as far as it goes."""
    builder = _Builder(drop)
    try:
        builder.feed(html.decode("utf-8", "replace") if isinstance(html, bytes) else html)
        builder.close()
    except (AssertionError, ValueError):
        pass
    return builder.root


def is_noise(node: Node) -> bool:
    """Whether id, class, role or label of a container name noise; all values are one text, and a space delimits nothing."""
    return bool(_NOISE.search(" ".join(v for k in ("id", "class", "role", "aria-label") if (v := node.attrs.get(k)))))


def _matches(node: Node, rule: tuple[str | None, str, str] | str) -> bool:
    if isinstance(rule, str):
        return node.tag == rule
    above, key, value = rule
    have = node.attrs.get(key, "")
    if value not in (have.split() if key == "class" else [have]):
        return False
    return above is None or any(a.tag == above for a in node.above())


# What an element adds to a candidate's score, and what a character of link text takes.
TAG_SCORES = {"p": 120, "h2": 40, "h3": 40, "h4": 40, "h5": 40, "h6": 40, "li": 20, "pre": 100, "tr": 15}
LINK_COST = 0.8


def candidate_score(node: Node) -> float:
    """Text and structure for, share of link text against."""
    size = len(node.inline())
    if not size:
        return float("-inf")
    structure = links = 0
    for n in node.walk():
        structure += TAG_SCORES.get(n.tag, 0)
        if n.tag == "a":
            links += len(n.inline())
    return size + structure - LINK_COST * links


def choose(root: Node, least: int) -> tuple[Node | None, str | None]:
    """The best candidate of the first rule that has one with enough text, else the best of all, else the body."""
    seen: set[int] = set()
    every: list[tuple[float, int, Node, str]] = []
    for k, rule in enumerate(CANDIDATES):
        name = rule if isinstance(rule, str) else " ".join(x for x in (rule[0], f"{rule[1]}={rule[2]}") if x)
        enough: list[tuple[float, int, Node, str]] = []
        for node in root.walk():
            if id(node) in seen or not _matches(node, rule):
                continue
            seen.add(id(node))
            entry = (candidate_score(node), -k, node, name)
            every.append(entry)
            if len(node.inline()) >= least:
                enough.append(entry)
        if enough:
            best = max(enough, key=lambda e: e[0])
            return best[2], best[3]
    if every:
        best = max(every, key=lambda e: e[:2])
        return best[2], best[3]
    body = next(root.find("body"), None)
    return (body, "body") if body is not None else (None, None)


def _kept_attributes(node: Node, base_url: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if node.tag == "a":
        if "href" in node.attrs:
            target = urljoin(base_url, node.attrs["href"].strip())
            parts = urlsplit(target)
            if parts.scheme in ("http", "https") and parts.netloc:
                out["href"] = target
        if node.attrs.get("title", "").strip():
            out["title"] = _INLINE.sub(" ", node.attrs["title"]).strip()
    elif node.tag in ("td", "th"):
        out = {k: v for k in ("colspan", "rowspan") if (v := node.attrs.get(k, "")).isdigit()}
    return out


def sanitise(node: Node, base_url: str) -> Node:
    """A copy of a fragment with allowed tags and attributes only; noise inside it, images and h1 dropped, other tags unwrapped, empty blocks removed."""

    def copy(source: Node, into: Node) -> None:
        for child in source.children:
            if isinstance(child, str):
                into.children.append(child)
            elif child.tag in DROPPED or child.tag in ("h1", "img") or is_noise(child):
                continue
            elif child.tag in ALLOWED:
                made = Node(child.tag, _kept_attributes(child, base_url), parent=into)
                copy(child, made)
                if not (made.tag in _EMPTY and not made.inline() and next(made.find("code", "br"), None) is None):
                    into.children.append(made)
            else:
                copy(child, into)

    out = Node("[fragment]")
    copy(node, out)
    return out


def plain_text(fragment: Node) -> str:
    """Outermost blocks, blank-line separated; rows as cells between bars, preformatted lines kept."""
    parts: list[str] = []

    def visit(node: Node) -> None:
        for child in node.children:
            if isinstance(child, str):
                continue
            if child.tag not in BLOCKS:
                visit(child)
            elif child.tag == "pre":
                parts.append(child.text("\n"))
            elif child.tag == "tr":
                cells = [c.inline() for c in child.children if isinstance(c, Node) and c.tag in ("td", "th")]
                parts.append(" | ".join(c for c in cells if c))
            else:
                parts.append(child.inline())

    visit(fragment)
    joined = "\n\n".join(p for p in parts if p) or fragment.inline()
    return re.sub("\n{3,}", "\n\n", _INLINE.sub(" ", joined).replace(" \n", "\n")).strip()


def to_html(node: Node) -> str:
    """Markup of a fragment's children."""
    out: list[str] = []

    def write(x: Node | str) -> None:
        if isinstance(x, str):
            out.append(escape(x, quote=False))
            return
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in x.attrs.items())
        if x.tag in _VOID:
            out.append(f"<{x.tag}{attrs}/>")
            return
        out.append(f"<{x.tag}{attrs}>")
        for c in x.children:
            write(c)
        out.append(f"</{x.tag}>")

    for c in node.children:
        write(c)
    return "".join(out).strip()


def extract(html: str | bytes | None, base_url: str | None, *, minimum: int = 400, maximum: int = 120_000) -> dict[str, object]:
    """Readable content of a page: ``content_html, content_text, status, selector, word_count``.

    The text is capped, then its length decides between extracted and
    too_short; the markup isn't cut. Null, blank and unreadable pages are
    empty; a base URL that isn't http(s) is invalid_base_url.
    """
    nothing = {"content_html": "", "content_text": "", "status": "empty", "selector": None, "word_count": 0}
    if base_url is not None and urlsplit(base_url).scheme not in ("http", "https"):
        return nothing | {"status": "invalid_base_url"}
    if not html or not html.strip():
        return nothing
    root = parse(html, DROPPED)
    node, selector = choose(root, minimum)
    if node is None:
        node, selector = root, "document"
    fragment = sanitise(node, base_url or "")
    text = plain_text(fragment)[:maximum].rstrip()
    status = "extracted" if len(text) >= minimum else "too_short"
    return {"content_html": to_html(fragment), "content_text": text, "status": status, "selector": selector, "word_count": len(text.split())}


def visible_text(html: str | None) -> str | None:
    """Text of markup, white space collapsed; null for null."""
    return None if html is None else re.sub(r"\s+", " ", parse(html).text()).strip()
