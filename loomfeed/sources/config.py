"""Configuration files, checked as a whole: every fault is named at once.

A file's rules are a table of (path, test, what must hold). A path leads
through mappings by name; ``*`` stands for each entry of a mapping or list.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import urlsplit
from zoneinfo import ZoneInfo

from .documents import read_yaml

Test = Callable[[object], bool]
#: A path, the test of what is there, what must hold, and whether it may be absent.
Rule = tuple[str, Test, str, bool]


class ConfigError(ValueError):
    """One or more faults of a configuration; ``faults`` names them."""

    def __init__(self, faults: list[str]) -> None:
        super().__init__("; ".join(faults))
        self.faults = faults


def is_text(x: object) -> bool:
    return isinstance(x, str) and bool(x.strip())


def is_flag(x: object) -> bool:
    return isinstance(x, bool)


def is_number(x: object, least: float, most: float = float("inf"), *, whole: bool = True) -> bool:
    return isinstance(x, int if whole else int | float) and not isinstance(x, bool) and least <= x <= most


def is_web_url(x: object) -> bool:
    return is_text(x) and urlsplit(x.strip()).scheme in ("http", "https") and bool(urlsplit(x.strip()).netloc)


def is_slug(x: object) -> bool:
    return is_text(x) and x == x.lower() and x.replace("_", "").isalnum()


def is_distinct_texts(x: object) -> bool:
    return isinstance(x, list) and bool(x) and all(map(is_text, x)) and len({v.strip() for v in x}) == len(x)


def is_zone(x: object) -> bool:
    try:
        return is_text(x) and ZoneInfo(x) is not None
    except (ValueError, OSError, LookupError):
        return False


def one_of(*values: object) -> Test:
    return lambda x: x in values


_MAPPING = lambda x: isinstance(x, dict)
_FULL_MAPPING = lambda x: isinstance(x, dict) and bool(x)
_FULL_LIST = lambda x: isinstance(x, list) and bool(x)
_FLAG = (is_flag, "be true or false")
_TEXT = (is_text, "be a text that isn't blank")
_POSITIVE = (lambda x: isinstance(x, int | float) and not isinstance(x, bool) and x > 0, "be greater than zero")
_COUNT = (lambda x: is_number(x, 1), "be a positive whole number")

# What a source, a lesson and the settings may say.
PROVIDER_FORMATS = {("feed", "rss"), ("feed", "atom"), ("html_index", "html")}
DIFFICULTIES = ("beginner", "intermediate", "advanced")
ROTATIONS = ("sequential",)
FEATURES = ("ranking", "render_markdown", "render_html", "render_epub", "full_content_epub", "build_site", "ai_editor")

SOURCE_RULES: list[Rule] = [
    ("sources", _FULL_LIST, "be a list that isn't empty", False),
    ("sources.*", _MAPPING, "be a mapping", False),
    *((f"sources.*.{k}", *_TEXT, False) for k in ("name", "category", "cadence")),
    ("sources.*.id", is_slug, "be lower-case letters, digits and underscores", False),
    ("sources.*.url", is_web_url, "be an http or https URL", False),
    ("sources.*.priority", lambda x: is_number(x, 1, 10), "be a whole number from 1 to 10", False),
    ("sources.*.enabled", *_FLAG, False),
    ("sources.*.official", *_FLAG, False),
    ("sources.*.tags", lambda x: isinstance(x, list) and all(map(is_text, x)), "be a list of texts", True),
]
PROFILE_RULES: list[Rule] = [
    ("profile", _MAPPING, "be a mapping", False),
    ("categories", _FULL_MAPPING, "be a mapping that isn't empty", False),
    ("categories.*", _MAPPING, "be a mapping", False),
    ("categories.*.weight", lambda x: is_number(x, 1, 10), "be a whole number from 1 to 10", False),
    ("categories.*.daily_quota", lambda x: is_number(x, 0), "be a whole number of 0 or more", False),
]
SETTINGS_RULES: list[Rule] = [
    *((k, _MAPPING, "be a mapping", False) for k in ("project", "runtime", "features")),
    *((f"project.{k}", *_TEXT, False) for k in ("name", "version")),
    *((f"runtime.{k}", *_POSITIVE, False) for k in ("lookback_hours", "request_timeout_seconds")),
    ("runtime.content_timeout_seconds", *_POSITIVE, True),
    ("runtime.content_max_download_bytes", *_COUNT, True),
    *((f"runtime.{k}", *_COUNT, False) for k in ("max_articles", "max_summary_chars")),
    *((f"runtime.{k}", *_TEXT, False) for k in ("output_dir", "user_agent")),
    ("runtime.site_dir", *_TEXT, True),
    ("runtime.fail_on_source_error", *_FLAG, False),
    ("features.fetch_feeds", *_FLAG, False),
    *((f"features.{k}", *_FLAG, True) for k in FEATURES),
]
LIBRARY_RULES: list[Rule] = [
    ("schema_version", one_of(1), "be 1", False),
    ("selection", _MAPPING, "be a mapping", False),
    ("selection.enabled", *_FLAG, False),
    ("selection.daily_count", lambda x: is_number(x, 0), "be a whole number of 0 or more", False),
    ("selection.rotation", one_of(*ROTATIONS), f"be one of {', '.join(ROTATIONS)}", False),
    ("selection.include_in_max_articles", *_FLAG, False),
    ("selection.history_source", *_TEXT, False),
    ("selection.timezone", is_zone, "be a time zone", False),
    ("lessons", _FULL_LIST, "be a list that isn't empty", False),
    ("lessons.*", _MAPPING, "be a mapping", False),
    ("lessons.*.id", is_slug, "be lower-case letters, digits and underscores", False),
    ("lessons.*.order", lambda x: is_number(x, 0), "be a whole number of 0 or more", False),
    *((f"lessons.*.{k}", *_TEXT, False) for k in ("title", "source_name", "track", "summary", "why_it_matters")),
    ("lessons.*.url", is_web_url, "be an http or https URL", False),
    ("lessons.*.topics", is_distinct_texts, "be a list of distinct texts", False),
    ("lessons.*.difficulty", one_of(*DIFFICULTIES), f"be one of {', '.join(DIFFICULTIES)}", False),
    ("lessons.*.estimated_minutes", lambda x: is_number(x, 1), "be a positive whole number", False),
    ("lessons.*.enabled", *_FLAG, False),
    ("lessons.*.content_html", lambda x: isinstance(x, str), "be a text", True),
]

_ABSENT = object()


def _places(data: object, path: list[str], name: str = "") -> Iterator[tuple[str, object]]:
    """What stands at a path, with its full name; nothing below what isn't there or is of another kind."""
    if not path:
        yield name, data
        return
    head, *rest = path
    if head == "*":
        entries = data.items() if isinstance(data, dict) else enumerate(data) if isinstance(data, list) else ()
        for k, v in entries:
            yield from _places(v, rest, f"{name}[{k}]" if isinstance(data, list) else f"{name}.{k}")
    elif isinstance(data, dict):
        yield from _places(data.get(head, _ABSENT), rest, f"{name}.{head}" if name else head)


def faults(data: dict, rules: list[Rule]) -> list[str]:
    """What breaks the rules, in their order."""
    out = []
    for path, test, must, optional in rules:
        for name, value in _places(data, path.split(".")):
            if value is _ABSENT:
                out += [] if optional else [f"{name} is missing"]
            elif not test(value):
                out.append(f"{name} must {must}")
    return out


def _repeated(ids: list) -> list[str]:
    return sorted(str(i) for i, n in Counter(ids).items() if n > 1)


def _read(path: Path) -> dict:
    try:
        return read_yaml(str(path))
    except FileNotFoundError:
        raise ConfigError([f"{path} not found"]) from None
    except RuntimeError:
        raise
    except Exception as e:  # of the YAML reader, or no mapping
        raise ConfigError([f"{path}: {e}"]) from e


@dataclass(frozen=True)
class Project:
    """Sources, profile and settings of a project."""

    sources: list[dict]
    profile: dict
    settings: dict


def read_project(folder: str | Path) -> Project:
    """``sources.yml``, ``profile.yml`` and ``settings.yml`` of a folder; ConfigError names all faults."""
    folder = Path(folder)
    sources, profile, settings = (_read(folder / f"{n}.yml") for n in ("sources", "profile", "settings"))
    found = faults(sources, SOURCE_RULES) + faults(profile, PROFILE_RULES) + faults(settings, SETTINGS_RULES)
    if not found:
        listed, known = sources["sources"], profile["categories"]
        found += [f"sources[{i}].provider and format must be one of {sorted(PROVIDER_FORMATS)}" for i, s in enumerate(listed) if (s.get("provider", "feed"), s.get("format")) not in PROVIDER_FORMATS]
        if again := _repeated([s["id"] for s in listed]):
            found.append(f"repeated source ids: {', '.join(again)}")
        if unknown := sorted({s["category"] for s in listed} - set(known)):
            found.append(f"categories of sources that the profile lacks: {', '.join(unknown)}")
    if found:
        raise ConfigError(found)
    return Project(sources["sources"], profile, settings)


@dataclass(frozen=True)
class Library:
    """A curriculum: how lessons are selected, and the lessons by (order, id)."""

    selection: dict
    lessons: list[dict]


def read_library(path: str | Path) -> Library:
    """A curriculum's YAML file; ConfigError names all faults."""
    data = _read(Path(path))
    found = faults(data, LIBRARY_RULES)
    if not found:
        selection, lessons = data["selection"], data["lessons"]
        enabled = sum(x["enabled"] for x in lessons)
        if again := _repeated([x["id"] for x in lessons]):
            found.append(f"repeated lesson ids: {', '.join(again)}")
        if selection["enabled"] and selection["daily_count"] < 1:
            found.append("selection.daily_count must be at least 1 where the selection is enabled")
        if selection["enabled"] and not enabled:
            found.append("the selection is enabled, but no lesson is")
    if found:
        raise ConfigError(found)
    clean = lambda x: {k: v.strip() if isinstance(v, str) else v for k, v in x.items()}
    return Library(data["selection"], sorted(map(clean, data["lessons"]), key=lambda x: (x["order"], x["id"])))


def summary_of(project: Project) -> dict:
    """What ``validate-only`` shows: counts, and the enabled sources of each category by priority, then name."""
    enabled = [s for s in project.sources if s["enabled"]]
    groups: dict[str, list[dict]] = {}
    for s in sorted(enabled, key=lambda s: (s["category"], -s["priority"], s["name"])):
        groups.setdefault(s["category"], []).append({k: s[k] for k in ("id", "name", "priority", "cadence", "format")})
    return {"project": project.settings["project"], "total_sources": len(project.sources), "enabled_sources": len(enabled), "categories": groups}
