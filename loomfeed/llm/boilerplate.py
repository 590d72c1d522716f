"""Separate the main body of a page from its frame by minimum cuts.

Each non-blank line of a page's text is a node. A linear classifier over the
line and its place in the page's DOM gives log-odds, which become the
capacities to the two terminals (frame and body). Neighbouring lines are tied
by smoothness edges, and so are lines near each other in the DOM: each line to
a node of its innermost container, and each container to the one around it.
The maximum flow separates the two; what stays with the frame terminal is
frame.

The classifier is fitted in each run (``fit_weights``): on a bounded sample of
pages, lines whose text and place in the DOM agree on what they are serve as
labelled rows, and logistic regression moves the weights from their prior
values as far as these rows support it.

One feature needs the corpus: whether the line recurs within its source. Those
lines are counted first, over all texts (see ``site_lines``). The rest is one
narrow pass over the pages.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..operators.timestamps import source_key
from ..runtime import spread
from .site_lines import line_keys, recurring_lines, with_listed

_LABEL = re.compile(
    r"^\W*(?:tagged|tags?|topics|filed under|categor(?:y|ies)|related(?: \w+)?|read (?:also|more|next|this next)|see also|more (?:from|on|about)|up next|next|previous(?:ly)?|you may also like|trending|most read|advertisement|sponsored"
    r"|schlagw(?:ort|örter)|themen|lesen sie auch|siehe auch|mehr zum thema|weiterlesen|anzeige|étiquettes|mots[- ]clés|sujets|(?:à )?lire aussi|voir aussi|publicité|à suivre"
    r"|etiquetas|temas|relacionado|lea también|ver también|publicidad|a continuación)\s*:", re.I)  # fmt: skip
_NOTICE = re.compile(r"\ball rights reserved\b|©|\bcookies?\b|\bprivacy\b|\bwrote \S+ \w+ ago\b|^\W*reply to\b|\bback to top\b|\bskip to\b|\bsubscribe\b|\bnewsletter\b", re.I)
_SEPARATOR = re.compile(r"\s[|·>•/]\s")
_SENTENCE = re.compile(r"[.!?…][\"'”’»)]?\s*$")
_KEEP = re.compile(r"[^\w]+|_")

#: Prior weights of the classifier: log-odds of frame against body.
PRIOR = {
    "bias": -0.3, "outside": 3.0, "inside": -1.2, "link": 2.0, "structure": -3.5, "classed": 3.6, "loose": 2.9, "recurs": 4.0,
    "label": 5.0, "notice": 2.5, "site": 1.5, "separators": 1.5, "prose": -2.2, "short": 0.4, "headline": -6.0,
}
#: Capacity of the edges between neighbouring lines, and from a line to the hub of its container.
NEIGHBOUR, CONTAINER = 0.35, 0.15
SCALE = 100
#: Pages of the sample on which the classifier is fitted, at most, and how many lines' worth of evidence the prior has.
SAMPLE, STRENGTH = 2000, 200.0

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}
_HIDDEN = {"script", "style", "title", "noscript", "template", "head"}
_STRUCTURE = {"h1", "h2", "h3", "h4", "h5", "h6", "pre", "code", "li", "dt", "dd", "td", "th", "blockquote", "figcaption"}
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}}
_CLOSES |= {t: {"p"} for t in ("div", "ul", "ol", "table", "section", "article", "aside", "nav", "footer", "header", "main", "pre", "h1", "h2", "h3", "h4", "h5", "h6")}
_SCOPE = {"table", "ul", "ol", "div", "article", "section", "td"}


def plain(text: str) -> str:
    """A line reduced to letters and digits, for matching lines with the page."""
    return _KEEP.sub("", text.casefold())


class _Page(HTMLParser):
    """Pieces of visible text: (text, tag, classed, containers, linked, table row)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []
        self.pieces: list[tuple[str, str, bool, tuple[int, ...], bool, int]] = []
        self.serial = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _VOID:
            return
        closes = _CLOSES.get(tag)
        if closes:
            for i in range(len(self.stack) - 1, -1, -1):
                name = self.stack[i][0]
                if name in closes:
                    del self.stack[i:]
                    if tag not in ("tr", "td", "th"):
                        break
                elif name in _SCOPE and not (tag in ("tr",) and name == "td"):
                    break
        self.serial += 1
        self.stack.append((tag, any(k in ("class", "id") and v for k, v in attrs), self.serial))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        if not data.strip() or any(t in _HIDDEN for t, _, _ in self.stack):
            return
        frame = [x for x in self.stack if x[0] not in ("html", "body")]
        tag, classed, _ = frame[-1] if frame else ("", False, 0)
        linked = any(t == "a" for t, _, _ in frame)
        # The path of containers above the piece; the leaf itself is no container.
        path = tuple(n for t, _, n in frame[:-1] if t in ("div", "article", "section", "main", "nav", "aside", "footer", "header", "td", "table"))
        own = tuple(n for t, _, n in frame if t in ("nav", "aside", "footer", "header"))
        row = next((n for t, _, n in reversed(frame) if t == "tr"), 0)
        self.pieces.append((data, tag, classed, path or own, linked, row))


def page_pieces(html: str) -> list[tuple[str, str, bool, tuple[int, ...], bool, int]]:
    page = _Page()
    try:
        page.feed(html)
        page.close()
    except (AssertionError, ValueError):  # broken declarations: what was read so far counts
        pass
    return page.pieces


def _regions(pieces: list) -> tuple[list[int], int | None]:
    """Region of each piece, and the main region: the one with most evidence of an article.

    Regions are the children of the first container level at which the page divides.
    """
    level = 0
    deepest = max((len(p[3]) for p in pieces), default=0)
    while level < deepest:
        heads = {p[3][level] if len(p[3]) > level else 0 for p in pieces}
        if len(heads) > 1:
            break
        level += 1
    region = [p[3][level] if len(p[3]) > level else -1 for p in pieces]
    score: dict[int, float] = defaultdict(float)
    for (text, tag, _, _, linked, _), r in zip(pieces, region, strict=True):
        if tag == "h1":
            score[r] += 4
        elif tag in ("h2", "h3", "pre", "li", "td") and not linked:
            score[r] += 0.5
        elif not linked and len(text) > 80 and _SENTENCE.search(text):
            score[r] += len(text) / 150
    best = max(score, key=lambda r: score[r]) if score else None
    return region, best


def line_features(lines: list[str], html: str, title: str | None, site: str | None, recurs: list[bool]) -> tuple[list[dict[str, float]], list[tuple[int, ...]]]:
    """Features of each line, and the DOM containers around each, from the outermost (none known: empty)."""
    pieces = page_pieces(html)
    region, main = _regions(pieces)
    where: dict[str, list[int]] = defaultdict(list)
    cells: dict[int, list[str]] = defaultdict(list)
    begins: dict[int, int] = {}
    for i, p in enumerate(pieces):
        key = plain(p[0])
        where[key].append(i)
        if p[5]:
            begins.setdefault(p[5], i)
            cells[p[5]].append(key)
    rows: dict[tuple[str, ...], int] = {}
    for serial, row in cells.items():
        rows.setdefault(tuple(row), begins[serial])
    name, headline = plain(site or ""), plain(title or "")
    used: dict[str, int] = defaultdict(int)
    features, containers = [], []
    for line, again in zip(lines, recurs, strict=True):
        key = plain(line)
        f: dict[str, float] = {"bias": 1}
        at = None
        if key in where:
            spots = where[key]
            at = spots[min(used[key], len(spots) - 1)]
            used[key] += 1
        elif " | " in line:  # a table row: its cells are pieces of their own
            at = rows.get(tuple(plain(c) for c in line.split(" | ")))
        path: tuple[int, ...] = ()
        if at is not None:
            _, tag, classed, _, linked, _ = pieces[at]
            path = pieces[at][3]
            inside = region[at] == main
            f["inside" if inside else "outside"] = 1
            if linked:
                f["link"] = 1
            if inside and not linked:
                if tag in _STRUCTURE:
                    f["structure"] = 1
                elif classed:
                    f["classed"] = 1
                elif tag in ("div", "span", "section", "article", "small", "td"):
                    f["loose"] = 1
        if again:
            f["recurs"] = 1
        if _LABEL.search(line):
            f["label"] = 1
        if _NOTICE.search(line):
            f["notice"] = 1
        if len(name) > 3 and name in key and key != headline:
            f["site"] = 1
        if "structure" not in f and len(_SEPARATOR.findall(line)) >= 2:
            f["separators"] = 1
        words = len(line.split())
        if words >= 8 and _SENTENCE.search(line) and not again:
            f["prose"] = 1
        elif words <= 3:
            f["short"] = 1
        if headline and key == headline and (at is None or pieces[at][1] == "h1"):
            f["headline"] = 1
        features.append(f)
        containers.append(path)
    return features, containers


def minimum_cut(n: int, terminal: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node stays with the source side of a minimum cut.

    ``terminal[i] > 0`` ties node i to the source, ``< 0`` to the sink.
    ``edges`` are symmetric (u, v, capacity). Dinic's algorithm.
    """
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[int] = []
    adjacent: list[list[int]] = [[] for _ in range(n + 2)]

    def add(u: int, v: int, c: int, back: int) -> None:
        adjacent[u].append(len(to))
        to.append(v)
        cap.append(c)
        adjacent[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i, t in enumerate(terminal):
        if t > 0:
            add(source, i, t, 0)
        elif t < 0:
            add(i, sink, -t, 0)
    for u, v, c in edges:
        add(u, v, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in adjacent[u]:
                if cap[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        place = [0] * (n + 2)
        while True:  # blocking flow, by explicit paths
            path: list[int] = []
            u = source
            while u != sink:
                moved = False
                while place[u] < len(adjacent[u]):
                    e = adjacent[u][place[u]]
                    if cap[e] > 0 and level[to[e]] == level[u] + 1:
                        path.append(e)
                        u = to[e]
                        moved = True
                        break
                    place[u] += 1
                if not moved:
                    if not path:
                        break
                    u = to[path.pop() ^ 1]
                    place[u] += 1
            if u != sink:
                break
            push = min(cap[e] for e in path)
            for e in path:
                cap[e] -= push
                cap[e ^ 1] += push


def dom_edges(containers: list[tuple[int, ...]]) -> tuple[int, list[tuple[int, int, int]]]:
    """Edges that tie each line to its innermost container and each container to the one around it; and how many containers there are."""
    n = len(containers)
    node: dict[int, int] = {}
    edges = []
    for i, path in enumerate(containers):
        for depth, c in enumerate(path):
            if c not in node:
                node[c] = n + len(node)
                if depth:
                    edges.append((node[path[depth - 1]], node[c], round(CONTAINER * SCALE)))
        if path:
            edges.append((i, node[path[-1]], round(CONTAINER * SCALE)))
    return len(node), edges


def frame_lines(text: str | None, html: str | None, title: str | None = None, site: str | None = None, recurs: list[bool] | None = None, weights: dict[str, float] = PRIOR) -> list[int]:
    """Numbers (from 1) of the non-blank lines of ``text`` that belong to the frame; none where text or page is blank."""
    numbers, lines, flags = _lines(text, html, recurs)
    if not numbers:
        return []
    features, containers = line_features(lines, html, title, site, flags)
    odds = [sum(weights[k] * v for k, v in f.items()) for f in features]
    hubs, edges = dom_edges(containers)
    edges += [(i, i + 1, round(NEIGHBOUR * SCALE)) for i in range(len(numbers) - 1)]
    side = minimum_cut(len(numbers) + hubs, [round(o * SCALE) for o in odds] + [0] * hubs, edges)
    return [i + 1 for i, s in zip(numbers, side, strict=False) if s]


def _lines(text: str | None, html: str | None, recurs: list[bool] | None) -> tuple[list[int], list[str], list[bool]]:
    """Places, texts and flags of the non-blank lines; none where text or page is blank."""
    if not text or not html or not html.strip():
        return [], [], []
    rows = text.split("\n")
    numbers = [i for i, x in enumerate(rows) if x.strip()]
    return numbers, [rows[i].strip() for i in numbers], [bool(recurs[i]) if recurs is not None and i < len(recurs) else False for i in numbers]


def agreed_label(names: frozenset[str]) -> float | None:
    """1 for frame, 0 for body, where a line's text and its place in the DOM agree; None where they don't, or say nothing."""
    if "headline" in names or {"inside", "structure"} <= names and "recurs" not in names:
        return 0.0
    outer = "outside" in names or bool(names & {"classed", "loose"})
    if outer and ("recurs" in names or "link" in names):
        return 1.0
    inner = "inside" in names and not names & {"classed", "loose", "link"}
    telling = names & {"recurs", "label", "notice", "site", "separators"}
    return 0.0 if inner and "prose" in names and not telling else None


def fitted(counts: dict[frozenset[str], int], strength: float = STRENGTH) -> dict[str, float]:
    """Weights by logistic regression on counted sets of features with agreed labels, drawn to the prior weights as by ``strength`` lines (Newton's method)."""
    sets = [(x, n, y) for x, n in counts.items() if (y := agreed_label(x)) is not None]
    prior = np.array(list(PRIOR.values()))
    if not sets:
        return dict(PRIOR)
    at = np.array([[k in x for k in PRIOR] for x, _, _ in sets], float)
    n, y = np.array([s[1] for s in sets], float), np.array([s[2] for s in sets])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-at @ w))
        slope = at.T @ (n * (p - y)) + strength * (w - prior)
        bend = (at * (n * p * (1 - p))[:, None]).T @ at + strength * np.eye(w.size)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip(PRIOR, w.tolist(), strict=True))


def fit_weights(flagged: DataFrame, rows: int, *, sample: int = SAMPLE, strength: float = STRENGTH) -> dict[str, float]:
    """Weights fitted on at most ``sample`` of the pages of ``recurring_flags``, chosen by a hash of their id; ``rows`` is about how many there are.

    The tasks count the sets of features of the lines; only these counts (of
    a few hundred sets) reach the driver.
    """
    kept = min(1.0, sample / max(rows, 1))
    chosen = flagged.where(F.pmod(F.xxhash64("article_id"), F.lit(1 << 20)) < int(kept * (1 << 20))).limit(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for b in batches:
            for _, site, title, html, text, flags in b.itertuples(index=False):
                _, lines, known = _lines(text, html, flags)
                if lines:
                    counts.update(" ".join(f) for f in line_features(lines, html, title, site, known)[0])
        yield pd.DataFrame({"names": list(counts.keys()), "n": list(counts.values())}).astype({"names": "object", "n": "int64"})

    totals = chosen.mapInPandas(run, "names string, n long").groupBy("names").agg(F.sum("n").alias("n")).collect()
    found: Counter[frozenset[str]] = Counter()
    for r in totals:
        found[frozenset(r.names.split())] += r.n
    return fitted(found, strength)


def recurring_flags(articles: DataFrame, *, least: int, share: float) -> DataFrame:
    """``article_id, source_name, title, content_html, content_text, flags`` of the rows with a page and text.

    ``flags`` tells of each line whether it recurs within its source.
    """
    lines = recurring_lines(articles, least=least, share=share)
    pages = articles.where(~is_blank(F.col("content_html")) & ~is_blank(F.col("content_text"))).select(
        "article_id", "source_name", "title", "content_html", "content_text", F.coalesce(source_key(F.col("source_id")), F.lit("")).alias("_source")
    )
    flags = F.transform(line_keys(F.col("content_text")), lambda k: F.coalesce(F.array_contains("_lines", k), F.lit(False)))
    return with_listed(pages, lines).select("article_id", "source_name", "title", "content_html", "content_text", flags.alias("flags"))


def page_frames(articles: DataFrame, *, least: int = 3, share: float = 0.03, weights: dict[str, float] | None = None) -> DataFrame:
    """``article_id, line_no INT`` of each line of a page's text that isn't part of the article's main body.

    Without ``weights`` the classifier is fitted first, on a bounded sample of the pages (``fit_weights``).

    Null and blank pages or texts give no rows; null sources, names and titles
    only take their evidence away; rows repeated under one id are judged
    each; broken markup is read as far as it goes; an empty table gives an
    empty result. Other columns are not read.
    """
    narrow = articles.select("article_id", "source_id", "source_name", "title", "published_at", "content_html", "content_text")
    flagged = recurring_flags(narrow, least=least, share=share)
    weights = fit_weights(flagged, articles.select("article_id").count()) if weights is None else weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, numbers = [], []
            for i, site, title, html, text, flags in b.itertuples(index=False):
                found = frame_lines(text, html, title, site, flags, weights)
                ids += [i] * len(found)
                numbers += found
            yield pd.DataFrame({"article_id": pd.Series(ids, dtype=b["article_id"].dtype), "line_no": pd.Series(numbers, dtype="int32")})

    return spread(flagged).mapInPandas(run, "article_id long, line_no int")
