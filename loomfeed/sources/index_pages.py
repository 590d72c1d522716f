"""Index pages: cards of a site's overview as records."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

from .. import schemas
from ..functions import dom
from .feeds import clean

_MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
_DATE = re.compile(rf"\b({_MONTHS})\s+(\d{{1,2}}),\s+(\d{{4}})\b", re.I)
_NUMBER = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
_BY = re.compile(r"\bby\s+(.+)$", re.I)


@dataclass(frozen=True)
class IndexLayout:
    """How an index page shows its cards.

    A card is the nearest block around a heading, at most ``climb`` steps up
    and not beyond ``main``, that shows a date and one of the labels. It is
    wanted if the ``wanted`` label comes before the ``other``. Headings in
    ``ignored`` are no cards.
    """

    wanted: str
    other: str
    ignored: frozenset[str] = frozenset()
    headings: tuple[str, ...] = ("h2", "h3")
    climb: int = 8


# The layouts that are known, by source id. A source without one can't be read.
LAYOUTS: dict[str, IndexLayout] = {"all_about_circuits_technical": IndexLayout("Technical Articles", "Projects", frozenset({"Latest Technical Articles"}))}


def register(source_id: str, layout: IndexLayout) -> None:
    """Make the index page of a source readable."""
    LAYOUTS[source_id] = layout


def card_date(text: str) -> str | None:
    """The first month-name date of a text as an instant; null if it names no real day."""
    m = _DATE.search(text)
    try:
        return f"{date(int(m[3]), _NUMBER[m[1][:3].lower()], int(m[2])):%Y-%m-%d}T00:00:00Z" if m else None
    except ValueError:
        return None


def card_author(text: str) -> str | None:
    """The name after "by", up to a date or the end."""
    m = _BY.search(text)
    return (_DATE.split(m[1])[0].strip(" ,|·–—-") or None) if m else None


def is_wanted(text: str, layout: IndexLayout) -> bool:
    """The wanted label comes before the other one."""
    at, other = text.find(layout.wanted), text.find(layout.other)
    return at >= 0 and (other < 0 or at < other)


def _card_of(heading: dom.Node, layout: IndexLayout) -> dom.Node | None:
    for _, node in zip(range(layout.climb), heading.above(), strict=False):
        text = clean(node.text()) or ""
        if _DATE.search(text) and (layout.wanted in text or layout.other in text):
            return node
        if node.tag == "main":
            break
    return None


def read_index(html: bytes | str, base_url: str, layout: IndexLayout, max_summary: int = 2000) -> list[dict]:
    """Cards of an index page, one per URL, in order."""
    root = dom.parse(html)
    top = next(root.find("main"), root)
    out: dict[str, dict] = {}
    for heading in top.find(*layout.headings):
        title = clean(heading.text())
        if not title or title in layout.ignored:
            continue
        link = next((a for a in heading.find("a") if "href" in a.attrs), None) or next((a for a in heading.above() if a.tag == "a" and "href" in a.attrs), None)
        href = clean(link.attrs["href"]) if link is not None else None
        card = _card_of(heading, layout) if href else None
        text = (clean(card.text()) or "") if card is not None else ""
        if not is_wanted(text, layout):
            continue
        url = urljoin(base_url, href)
        if url in out:
            continue
        texts = [t for p in card.find("p") if (t := clean(p.text())) and t != title]
        summary = max(texts, key=len, default="")
        if 0 < max_summary < len(summary):
            summary = summary[: max_summary - 1].rstrip() + "…"
        out[url] = {"title": title, "url": url, "external_id": url, "published_at": card_date(text), "summary": summary, "author": card_author(text)}
    return list(out.values())


def index_articles(payloads: DataFrame, fetched_at: str, *, max_summary: int = 2000, layouts: dict[str, IndexLayout] | None = None) -> DataFrame:
    """Articles of staged index pages, with ``error``: a page of a source without a layout gives one row with an error."""
    schema = f"{schemas.ORDINAL}, {schemas.ARTICLE}, error string"
    arrow = schemas.arrow_schema(schema)
    known = dict(LAYOUTS) if layouts is None else layouts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                common = {"source_id": row["id"], "source_name": row["name"], "category": row["category"], "source_priority": row["priority"], "source_tags": list(row["tags"]) if row["tags"] is not None else [], "source_pos": row["source_pos"]}
                if row["id"] not in known:
                    out.append(common | {"error": f"no layout is known for the index page of {row['id']}"})
                    continue
                for i, card in enumerate(read_index(bytes(row["body"] or b""), row["url"], known[row["id"]], max_summary)):
                    out.append(common | card | {"fetched_at": fetched_at, "content_html": "", "content_text": "", "content_status": "not_requested", "entry_pos": i})
            yield from schemas.batches(out, arrow)

    return payloads.mapInArrow(run, schema)
