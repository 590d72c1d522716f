"""Static site of editions with an archive and an OPDS catalog."""

from __future__ import annotations

import json
import re
import shutil
from datetime import datetime, timezone
from html import escape
from pathlib import Path, PurePosixPath
from zoneinfo import ZoneInfo

from .files import write_json, write_text

_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
REQUIRED = ["digest.html", "digest.md", "digest.epub", "ranked_articles.json"]
#: Published if they are there: the book with full contents (for the catalog), and the source report.
OPTIONAL = ["digest-full.epub", "source_report.json"]
BOOKS = "books"


def check_entry(raw: object) -> dict:
    """A manifest entry, or ValueError."""
    if not isinstance(raw, dict):
        raise ValueError("an edition must be a mapping")
    text = {k: raw.get(k) for k in ("date", "generated_at", "path", "title")}
    if any(not isinstance(v, str) or not v.strip() for v in text.values()):
        raise ValueError("an edition needs a date, a time, a path and a title")
    if not _DATE.fullmatch(text["date"]):
        raise ValueError("an edition's date must be YYYY-MM-DD")
    if datetime.fromisoformat(text["generated_at"].replace("Z", "+00:00")).tzinfo is None:
        raise ValueError("an edition's time needs a zone")
    count = raw.get("article_count")
    if isinstance(count, bool) or not isinstance(count, int) or count < 0:
        raise ValueError("an edition's article count must be 0 or more")
    path = PurePosixPath(text["path"])
    if path.is_absolute() or ".." in path.parts:
        raise ValueError("an edition's path must stay inside the archive")
    return text | {"article_count": count}


def load_manifest(path: Path, *, strict: bool) -> list[dict]:
    """Editions of a manifest: invalid ones are an error if ``strict``, else left out; a missing file is empty."""
    if not path.exists():
        return []
    try:
        data = json.loads(path.read_text("utf-8"))
        raw = data["editions"] if isinstance(data.get("editions"), list) else None
    except (ValueError, AttributeError, KeyError):
        raw = None
    if raw is None:
        if strict:
            raise ValueError(f"{path} is no manifest")
        return []
    out = []
    for r in raw:
        try:
            out.append(check_entry(r))
        except ValueError:
            if strict:
                raise
    return out


def upsert_edition(entries: list[dict], new: dict) -> list[dict]:
    """Newest first; an entry of the same date is replaced."""
    return sorted([e for e in entries if e["date"] != new["date"]] + [new], key=lambda e: (e["date"], e["generated_at"]), reverse=True)


def archive_html(entries: list[dict], title: str) -> str:
    rows = "".join(f'<li><a href="{escape(e["path"])}">{escape(e["title"])}</a> ({e["article_count"]} article{"" if e["article_count"] == 1 else "s"})</li>' for e in entries)
    return f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"/><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><ul>{rows}</ul></body></html>\n'


def _book_of(site: Path, entry: dict) -> Path | None:
    """The book of an edition: with full contents if there is one."""
    folder = site / "archive" / entry["path"].strip("/")
    return next((folder / n for n in ("digest-full.epub", "digest.epub") if (folder / n).is_file()), None)


def write_catalog(site: Path, entries: list[dict], title: str) -> list[str] | None:
    """Catalog and books below ``opds``, and the dates left out; without any book the folder is removed, and null given."""
    place = site / "opds"
    shutil.rmtree(place, ignore_errors=True)
    try:
        catalog, skipped = opds(site, entries, title)
    except ValueError:
        return None
    for e in entries:
        if book := _book_of(site, e):
            (place / BOOKS).mkdir(parents=True, exist_ok=True)
            shutil.copyfile(book, place / BOOKS / f"{e['date']}.epub")
    write_text(place / "catalog.xml", catalog)
    return skipped


def opds(site: Path, entries: list[dict], title: str, language: str = "en") -> tuple[str, list[str]]:
    """Atom catalog of the editions whose EPUB exists, newest first, and the dates left out."""
    have = [e for e in sorted(entries, key=lambda e: e["generated_at"], reverse=True) if _book_of(site, e) is not None]
    skipped = [e["date"] for e in entries if e not in have]
    if not have:
        raise ValueError("no edition has an EPUB")
    book = lambda e: f'<entry><title>{escape(e["title"])}</title><id>urn:edition:{e["date"]}</id><updated>{escape(e["generated_at"])}</updated><dc:language>{language}</dc:language><link rel="http://opds-spec.org/acquisition" type="application/epub+zip" href="{BOOKS}/{e["date"]}.epub"/></entry>'
    kind = "application/atom+xml;profile=opds-catalog;kind=acquisition"
    return f'<?xml version="1.0" encoding="utf-8"?>\n<feed xmlns="http://www.w3.org/2005/Atom" xmlns:dc="http://purl.org/dc/terms/"><id>urn:catalog</id><title>{escape(title)}</title><updated>{escape(have[0]["generated_at"])}</updated><link rel="self" type="{kind}" href="catalog.xml"/>{"".join(map(book, have))}</feed>\n', skipped


def publish(output: str | Path, site: str | Path, *, zone: str, title: str) -> dict:
    """Copy an edition to the root, to latest and to its dated place in the archive (replaced), and renew manifest and catalog.

    FileNotFoundError where a required file is missing: nothing is copied then.
    """
    output, site = Path(output), Path(site)
    if missing := [n for n in REQUIRED if not (output / n).is_file()]:
        raise FileNotFoundError(f"{output} lacks {', '.join(missing)}")
    payload = json.loads((output / "ranked_articles.json").read_text("utf-8"))
    at = datetime.fromisoformat(payload["generated_at"].replace("Z", "+00:00"))
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    date = at.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d")
    place = site / "archive" / date.replace("-", "/")
    shutil.rmtree(place, ignore_errors=True)
    for target in (site, site / "latest", place):
        target.mkdir(parents=True, exist_ok=True)
        for name in [*REQUIRED, *(n for n in OPTIONAL if (output / n).is_file())]:
            shutil.copyfile(output / name, target / name)
        shutil.copyfile(output / "digest.html", target / "index.html")
    manifest = site / "archive" / "index.json"
    new = {"date": date, "generated_at": payload["generated_at"], "article_count": payload["article_count"], "path": date.replace("-", "/"), "title": f"{title} — {date}"}
    entries = upsert_edition(load_manifest(manifest, strict=False), new)
    write_json(manifest, {"schema_version": 1, "timezone": zone, "latest_date": entries[0]["date"], "edition_count": len(entries), "editions": entries})
    write_text(site / "archive" / "index.html", archive_html(entries, title))
    skipped = write_catalog(site, entries, title)
    return {"date": date, "editions": len(entries), "catalog": skipped is not None, "skipped": [e["date"] for e in entries] if skipped is None else skipped}
