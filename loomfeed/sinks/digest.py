"""Digests of an edition: Markdown, HTML and EPUB.

An edition is bounded by its maximum of articles, so it is rendered on the
driver from rows that ``files.rows_of`` has checked.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from datetime import datetime, timezone
from html import escape
from zoneinfo import ZoneInfo

from ..functions import dom
from .files import grouped

# Labels of the digests.
GENERATED, SOURCE, PUBLISHED, SCORE, INTERESTS = "Generated at", "Source:", "Published:", "Score:", "Matched interests:"
READ, ORIGINAL, NOTHING = "Read the original article", "Original source", "No articles were selected for this edition."

_MARK = re.compile(r"([\\\[\]*_`#])")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _at(value: str | None) -> datetime | None:
    try:
        at = datetime.fromisoformat((value or "").strip().replace("Z", "+00:00").replace("z", "+00:00"))
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def local_label(value: str | None, zone: str) -> str | None:
    at = _at(value)
    return None if at is None else f"{at.astimezone(ZoneInfo(zone)):%Y-%m-%d %H:%M} {zone}"


def day_label(value: str, zone: str) -> str:
    at = _at(value)
    if at is None:
        raise ValueError("generated_at must be an ISO date-time")
    at = at.astimezone(ZoneInfo(zone))
    return f"{at:%B} {at.day}, {at.year}"


def _summary(a: dict) -> str:
    return " ".join((a.get("summary") or "").split())


def _md(text: str) -> str:
    return _MARK.sub(r"\\\1", text)


def markdown(articles: list[dict], categories: list[dict], *, generated_at: str, project: str, zone: str, scores: bool = True) -> str:
    lines = [f"# {_md(project.strip())} — {day_label(generated_at, zone)}", "", f"> {GENERATED} {local_label(generated_at, zone)}", ""]
    if not articles:
        return "\n".join([*lines, NOTHING, ""])
    for label, group in grouped(articles, categories):
        lines += [f"## {_md(label)}", ""]
        for a in group:
            facts = [f"**{SOURCE}** {_md(a['source_name'])}"]
            if when := local_label(a.get("published_at") or a.get("updated_at"), zone):
                facts.append(f"**{PUBLISHED}** {when}")
            if scores and a.get("score") is not None:
                facts.append(f"**{SCORE}** {a['score']}")
            lines += [f"### [{_md(a['title'].strip())}](<{a['url'].strip()}>)", "", " · ".join(facts), ""]
            lines += [_summary(a), ""] if _summary(a) else []
            if hits := a.get("matched_high_priority_keywords"):
                lines += [f"**{INTERESTS}** " + ", ".join(f"`{k}`" for k in hits), ""]
            lines += [f"[{READ}](<{a['url'].strip()}>)", ""]
    return "\n".join(lines).rstrip() + "\n"


def anchors(labels: list[str], *, ascii_only: bool = False) -> list[str]:
    """One slug per label; repeated ones get -2, -3 and so on."""
    seen: dict[str, int] = {}
    out = []
    for label in labels:
        base = re.sub("[^a-z0-9]+" if ascii_only else r"[\W_]+", "-", label.lower()).strip("-") or "section"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}-{seen[base]}")
    return out


def html(articles: list[dict], categories: list[dict], *, generated_at: str, project: str, zone: str, scores: bool = True, epub_href: str | None = None) -> str:
    groups = grouped(articles, categories)
    ids = anchors([g[0] for g in groups])
    nav = "".join(f'<li><a href="#{i}">{escape(label)}</a> ({len(rows)})</li>' for i, (label, rows) in zip(ids, groups, strict=True))
    body = []
    for i, (label, rows) in zip(ids, groups, strict=True):
        body.append(f'<section id="{i}"><h2>{escape(label)}</h2>')
        for a in rows:
            facts = [escape(a["source_name"])] + [x for x in [local_label(a.get("published_at") or a.get("updated_at"), zone)] if x]
            if scores and a.get("score") is not None:
                facts.append(f"Score {a['score']}")
            hits = "".join(f"<li>{escape(k)}</li>" for k in a.get("matched_high_priority_keywords") or [])
            text = f"<p>{escape(_summary(a))}</p>" if _summary(a) else ""
            body.append(f'<article><h3><a href="{escape(a["url"].strip())}">{escape(a["title"].strip())}</a></h3><p class="meta">{" · ".join(facts)}</p>{text}{f"<ul>{hits}</ul>" if hits else ""}</article>')
        body.append("</section>")
    count = f"{len(articles)} article{'' if len(articles) == 1 else 's'}"
    book = f'<p><a href="{escape(epub_href)}">EPUB</a></p>' if epub_href else ""
    inner = "".join(body) or f"<p>{NOTHING}</p>"
    title = f"{escape(project.strip())} — {day_label(generated_at, zone)}"
    return f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"/><meta name="viewport" content="width=device-width, initial-scale=1"/><title>{title}</title></head><body><header><h1>{title}</h1><p>{count}, generated at {escape(local_label(generated_at, zone) or "")}</p>{book}</header><nav><ul>{nav}</ul></nav><main>{inner}</main></body></html>\n'


def _xml(text: str) -> str:
    return escape(_CONTROL.sub("", text))


# Each article on pages of its own, long ones over as many as they need.
STYLE = """article + article { break-before: page; page-break-before: always; }
article { break-inside: auto; page-break-inside: auto; }
"""


def _body(a: dict) -> str:
    """Content as markup, else text in paragraphs, else the summary, else nothing."""
    full = ""
    if (a.get("content_html") or "").strip():
        full = dom.to_html(dom.sanitise(dom.parse(_CONTROL.sub("", a["content_html"])), a["url"]))
    elif (a.get("content_text") or "").strip():
        parts = re.split(r"\n[ \t]*\n", a["content_text"].replace("\r\n", "\n"))
        full = "".join(f"<p>{_xml(' '.join(p.split()))}</p>" for p in parts if p.strip())
    if full:
        return f'<div class="article-content full-content">{full}</div>'
    return f'<div class="article-content"><p>{_xml(_summary(a))}</p></div>' if _summary(a) else ""


def epub(articles: list[dict], categories: list[dict], *, generated_at: str, project: str, zone: str) -> bytes:
    """EPUB 3: the same bytes for the same input (mimetype first and stored, fixed times)."""
    groups = grouped(articles, categories)
    names = anchors([g[0] for g in groups], ascii_only=True)
    title = f"{project.strip()} — {day_label(generated_at, zone)}"
    book_id = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{project.strip()}|{generated_at}')}"
    head = '<?xml version="1.0" encoding="utf-8"?>\n'
    page = lambda t, b: f'{head}<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="en"><head><title>{_xml(t)}</title><link rel="stylesheet" type="text/css" href="style.css"/></head><body>{b}</body></html>'
    files: dict[str, str] = {
        "META-INF/container.xml": f'{head}<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>',
        "OEBPS/style.css": STYLE,
    }
    toc, ncx, order = [], [], 0
    for name, (label, rows) in zip(names, groups, strict=True):
        order += 1
        chapter, points, links = [f"<h1>{_xml(label)}</h1>"], [], []
        first = order
        for k, a in enumerate(rows, 1):
            order += 1
            facts = " · ".join(x for x in [_xml(a["source_name"]), local_label(a.get("published_at") or a.get("updated_at"), zone)] if x)
            chapter.append(f'<article id="article-{k}"><h2>{_xml(a["title"].strip())}</h2><p>{facts}</p>{_body(a)}<p><a href="{_xml(a["url"].strip())}">{ORIGINAL}</a></p></article>')
            links.append(f'<li><a href="{name}.xhtml#article-{k}">{_xml(a["title"].strip())}</a></li>')
            points.append(f'<navPoint id="n{order}" playOrder="{order}"><navLabel><text>{_xml(a["title"].strip())}</text></navLabel><content src="{name}.xhtml#article-{k}"/></navPoint>')
        files[f"OEBPS/{name}.xhtml"] = page(label, "".join(chapter))
        toc.append(f'<li><a href="{name}.xhtml">{_xml(label)}</a><ol>{"".join(links)}</ol></li>')
        ncx.append(f'<navPoint id="n{first}" playOrder="{first}"><navLabel><text>{_xml(label)}</text></navLabel><content src="{name}.xhtml"/>{"".join(points)}</navPoint>')
    empty = "" if toc else "<li><span>No articles</span></li>"
    files["OEBPS/nav.xhtml"] = page(title, f'<nav epub:type="toc"><h1>{_xml(title)}</h1><ol>{"".join(toc)}{empty}</ol></nav>')
    files["OEBPS/toc.ncx"] = f'{head}<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="{book_id}"/></head><docTitle><text>{_xml(title)}</text></docTitle><navMap>{"".join(ncx)}</navMap></ncx>'
    items = "".join(f'<item id="{n}" href="{n}.xhtml" media-type="application/xhtml+xml"/>' for n in names)
    spine = "".join(f'<itemref idref="{n}"/>' for n in names)
    at = _at(generated_at)
    files["OEBPS/package.opf"] = f'{head}<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{book_id}</dc:identifier><dc:title>{_xml(title)}</dc:title><dc:language>en</dc:language><meta property="dcterms:modified">{at.astimezone(timezone.utc):%Y-%m-%dT%H:%M:%SZ}</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="css" href="style.css" media-type="text/css"/>{items}</manifest><spine toc="ncx"><itemref idref="nav"/>{spine}</spine></package>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for path, text in {"mimetype": "application/epub+zip", **files}.items():
            info = zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if path == "mimetype" else zipfile.ZIP_DEFLATED
            info.external_attr = 0o644 << 16
            z.writestr(info, text)
    return out.getvalue()
