"""``python -m loomfeed COMMAND``: editions and their reports.

========================  ===================================================  ==========
command                   what                                                 exit codes
========================  ===================================================  ==========
run                       collect the sources of a configuration, build, publish  0, 1, 2
edition                   build an edition from parquet tables                 0, 1, 2
content-report            contents of an edition                               0, 1
coverage-report           curated lessons of a curriculum                      0, 1
verify                    checks of an edition and its site                    0, 1
check-sources             collect some sources and report on them              0, 1, 2
release                   tests, run, verify, reports                          0, 1
========================  ===================================================  ==========

2 stands for faulty arguments or configuration, 1 for a failed outcome.
"""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregates, ranking, verification
from .operators.quality import file_digests
from .plans import pipeline
from .runtime import checkpoint
from .sinks import files, reports
from .sources import config, documents, web


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomfeed")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str) -> argparse.ArgumentParser:
        return commands.add_parser(name, help=about)

    run = command("run", "collect, build and publish an edition")
    run.add_argument("--config-dir", type=Path, default=Path("config"))
    run.add_argument("--output-dir", type=Path)
    run.add_argument("--source", action="append", default=[])
    run.add_argument("--validate-only", action="store_true")
    run.add_argument("--json", action="store_true")
    run.add_argument("--now")
    one = command("edition", "build an edition from parquet tables")
    for name in ("articles", "categories", "output"):
        one.add_argument(name)
    one.add_argument("--now", required=True)
    one.add_argument("--site")
    one.add_argument("--source", action="append", default=[])
    one.add_argument("--ordinal", default="article_id")
    one.add_argument("--lookback-hours", type=float, default=48)
    one.add_argument("--max-articles", type=int, default=20)
    one.add_argument("--zone", default="UTC")
    for name, about, flag, default in (("content-report", "contents of an edition", "--problems-only", "output/ranked_articles.json"), ("coverage-report", "curated lessons", "--uncurated-only", "config/learning_library.yml")):
        report = command(name, about)
        report.add_argument("--input", type=Path, default=Path(default))
        report.add_argument(flag, action="store_true", dest="part")
        shape = report.add_mutually_exclusive_group()
        shape.add_argument("--json", action="store_true")
        shape.add_argument("--markdown", action="store_true")
    verify = command("verify", "check an edition and its site")
    verify.add_argument("--output-dir", type=Path, default=Path("output"))
    verify.add_argument("--site-dir", type=Path, default=Path("site"))
    verify.add_argument("--expected-total", type=int, default=20)
    verify.add_argument("--expected-learning", type=int, default=1)
    verify.add_argument("--json", action="store_true")
    check = command("check-sources", "collect sources and report on them")
    check.add_argument("--config-dir", type=Path, default=Path("config"))
    check.add_argument("--source", action="append", default=[])
    check.add_argument("--json", action="store_true")
    check.add_argument("--output", type=Path)
    release = command("release", "tests, run, verification and reports")
    release.add_argument("--config-dir", type=Path, default=Path("config"))
    release.add_argument("--skip-tests", action="store_true")
    release.add_argument("--skip-generate", action="store_true")
    return p


def session() -> SparkSession:
    return SparkSession.builder.appName("loomfeed").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _show(value: dict, text: str, as_json: bool) -> None:
    print(json.dumps(value, ensure_ascii=False, indent=2, default=str) if as_json else text)


def _config_text(summary: dict) -> str:
    lines = [f"{summary['project']['name']} v{summary['project']['version']}", f"Configured sources: {summary['total_sources']}", f"Enabled sources:    {summary['enabled_sources']}"]
    for category, sources in summary["categories"].items():
        lines += ["", f"{category}:", *(f"  - {s['name']} (priority={s['priority']}, cadence={s['cadence']}, format={s['format']})" for s in sources)]
    return "\n".join(lines)


def _sources(spark: SparkSession, project: config.Project, ids: list[str]) -> DataFrame:
    table = documents.source_table(spark, [{"provider": "feed", "tags": [], **s} for s in project.sources])
    return documents.chosen_sources(table, ids) if ids else table.where("enabled")


def _scoring(profile: dict) -> ranking.Scoring:
    words = profile.get("keywords") or {}
    return ranking.Scoring(high_keywords=ranking.keyword_list(words.get("high_priority") or []), low_keywords=ranking.keyword_list(words.get("low_priority") or []))


def run(a: argparse.Namespace, transport: web.Transport) -> int:
    """Collect, build, write and publish; contents and lessons if the configuration has them."""
    project = config.read_project(a.config_dir)
    features, runtime = project.settings["features"], project.settings["runtime"]
    spark = session()
    sources = _sources(spark, project, a.source)
    if a.validate_only:
        summary = config.summary_of(project)
        _show(summary, _config_text(summary), a.json)
        return 0
    if not features["fetch_feeds"]:
        raise ValueError("features.fetch_feeds is disabled")
    if features.get("build_site") and not features.get("ranking"):
        raise ValueError("features.build_site needs features.ranking")
    now = a.now or f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ}"
    output, place = a.output_dir or Path(runtime["output_dir"]), Path(runtime.get("site_dir", "site"))
    articles, collected = web.collect(sources, now, seconds=float(runtime["request_timeout_seconds"]), max_summary=int(runtime["max_summary_chars"]), transport=transport)
    collected = checkpoint(collected)
    files.write_articles(articles, str(output / "raw_articles.json"))
    report = files.write_source_report(collected, output / "source_report.json", project.settings["project"])
    result: dict = {"sources": report["summary"]}
    if features.get("ranking"):
        profile = project.profile
        settings = pipeline.EditionSettings(
            project=project.settings["project"]["name"], zone=profile["profile"].get("timezone", "UTC"), lookback_hours=float(runtime["lookback_hours"]), max_articles=int(runtime["max_articles"]), scoring=_scoring(profile),
        )
        categories = documents.category_table(spark, profile["categories"])
        learning, path = None, a.config_dir / "learning_library.yml"
        if path.is_file() and not a.source:
            library = config.read_library(path)
            archive = place / "archive"
            empty = spark.createDataFrame([], "date string, path string, lesson_ids array<string>")
            history = documents.edition_history(documents.archived_payloads(spark, str(archive))) if any(archive.rglob("ranked_articles.json")) else empty
            tracks = {x["track"]: "technical_learning" for x in library.lessons}
            learning = pipeline.prepare_lessons(library, history, categories, now, settings, tracks)
        ordered = articles.withColumn("input_ordinal", F.col("source_pos").cast("long") * (1 << 32) + F.col("entry_pos")).drop("source_pos", "entry_pos")
        frames = pipeline.edition(ordered, categories, now, settings, lessons=learning.lessons if learning else None, capacity=learning.capacity if learning else None)
        full = records = None
        if features.get("full_content_epub"):
            full, records = pipeline.with_contents(frames["combined"], seconds=float(runtime.get("content_timeout_seconds", 15)), most_bytes=int(runtime.get("content_max_download_bytes", 5_000_000)), transport=transport)
        site_dir = str(place) if features.get("build_site") else None
        result |= pipeline.write_edition(frames, categories, now, str(output), settings, site_dir=site_dir, learning=learning, full=full, records=records)
    failed = [f"- {r['source_id']}: {r['error']}" for r in report["sources"] if r["status"] == "failed"]
    text = "\n".join([f"{k}: {v}" for k, v in result["sources"].items()] + ([f"articles of the edition: {result['article_count']}"] if "article_count" in result else []) + (["", "Failed sources:", *failed] if failed else []))
    _show(result, text, a.json)
    return aggregates.exit_code(collected, runtime["fail_on_source_error"])


def edition(a: argparse.Namespace, _: web.Transport) -> int:
    spark = session()
    articles, categories = spark.read.parquet(a.articles), spark.read.parquet(a.categories)
    if a.source:
        articles = articles.where(articles.source_id.isin(a.source))
    settings = pipeline.EditionSettings(zone=a.zone, lookback_hours=a.lookback_hours, max_articles=a.max_articles)
    frames = pipeline.edition(articles, categories, a.now, settings, ordinal=a.ordinal)
    result = pipeline.write_edition(frames, categories, a.now, a.output, settings, site_dir=a.site)
    print(json.dumps(result, default=str))
    return 0 if result["article_count"] else 1


RECORD = "source_id string, title string, url string, status string, http_status int, content_type string, selector string, word_count int, duration_seconds double, error string, content_origin string, record_id int"


def content_report(a: argparse.Namespace, _: web.Transport) -> int:
    """The report of a payload's contents; counters that don't agree with the records are an error."""
    log = pipeline.content_log(pipeline.read_edition(a.input))
    if not isinstance(log.get("records"), list):
        raise ValueError(f"{a.input} has no log of contents")
    spark = session()
    names = [c.split(" ")[0] for c in RECORD.split(", ")]
    records = spark.createDataFrame([tuple({**r, "record_id": i}.get(n) for n in names) for i, r in enumerate(log["records"])], RECORD)
    stated = spark.createDataFrame([tuple(log.get(k) for k in verification.LOGGED)], ", ".join(f"{k} int" for k in verification.STATED))
    wrong = [r.check_name for r in verification.counter_checks(stated, records).where("NOT passed AND check_name NOT LIKE 'origin%'").collect()]
    if wrong:
        raise ValueError(f"{a.input}: {', '.join(wrong)} failed")
    report = reports.content_report(records, problems_only=a.part)
    _show(report, reports.content_markdown(report) if a.markdown else reports.content_text(report), a.json)
    return 0


def coverage_report(a: argparse.Namespace, _: web.Transport) -> int:
    library = config.read_library(a.input)
    report = reports.coverage_report(documents.lesson_table(session(), library.lessons), uncurated_only=a.part)
    _show(report, reports.coverage_markdown(report) if a.markdown else reports.coverage_text(report), a.json)
    return 0


def verify(a: argparse.Namespace, _: web.Transport) -> int:
    checks = pipeline.verify_edition(session(), str(a.output_dir), str(a.site_dir), expected_total=a.expected_total, expected_lessons=a.expected_learning).collect()  # a few dozen
    failed = [r for r in checks if not r.passed]
    value = {"checks": len(checks), "failed": [{"check_name": r.check_name, "failing": r.failing} for r in failed]}
    _show(value, "\n".join([*(f"FAILED {r.check_name} ({r.failing})" for r in failed), f"{len(checks) - len(failed)} of {len(checks)} checks passed"]), a.json)
    return 1 if failed else 0


def check_sources(a: argparse.Namespace, transport: web.Transport) -> int:
    project = config.read_project(a.config_dir)
    spark = session()
    runtime = project.settings["runtime"]
    now = f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ}"
    collected = checkpoint(web.collect(_sources(spark, project, a.source), now, seconds=float(runtime["request_timeout_seconds"]), transport=transport)[1])
    report = reports.source_report(collected)
    if a.output:
        files.write_json(a.output, report)
    _show(report, reports.source_text(report), a.json)
    return 1 if report["summary"]["failed_count"] else 0


def release(a: argparse.Namespace, transport: web.Transport) -> int:
    """The gate: each step must end with 0, and the published books must be the built ones."""
    project = config.read_project(a.config_dir)
    runtime = project.settings["runtime"]
    output, place = Path(runtime["output_dir"]), Path(runtime.get("site_dir", "site"))
    library = a.config_dir / "learning_library.yml"
    steps: list[tuple[str, Callable[[], int]]] = []
    if not a.skip_tests:
        steps.append(("tests", lambda: subprocess.run([sys.executable, "-m", "pytest", "-q"], check=False).returncode))
    if not a.skip_generate:
        steps.append(("run", lambda: main(["run", "--config-dir", str(a.config_dir)], transport)))
    lessons = config.read_library(library).selection["daily_count"] if library.is_file() else 0
    steps.append(("verify", lambda: main(["verify", "--output-dir", str(output), "--site-dir", str(place), "--expected-total", str(runtime["max_articles"]), "--expected-learning", str(lessons)])))
    if project.settings["features"].get("full_content_epub"):
        steps.append(("content-report", lambda: main(["content-report", "--input", str(output / "ranked_articles.json"), "--problems-only"])))
    if library.is_file():
        steps.append(("coverage-report", lambda: main(["coverage-report", "--input", str(library)])))
    for name, step in steps:
        print(f"\n>>> {name}")
        if code := step():
            print(f"{name} ended with {code}", file=sys.stderr)
            return 1
    books = file_digests(session(), str(output)).unionByName(file_digests(session(), str(place))).where(F.col("path").endswith(".epub"))
    print(f"\nthe gate is passed; {books.select('digest').distinct().count()} differing books")
    return 0


COMMANDS = {"run": run, "edition": edition, "content-report": content_report, "coverage-report": coverage_report, "verify": verify, "check-sources": check_sources, "release": release}
#: Exit code of faulty arguments, configuration or data, where it isn't 2.
FAULT = {"content-report": 1, "coverage-report": 1, "verify": 1, "release": 1}


def main(argv: list[str] | None = None, transport: web.Transport = web.over_http) -> int:
    a = _parser().parse_args(argv)
    try:
        return COMMANDS[a.command](a, transport)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return FAULT.get(a.command, 2)


if __name__ == "__main__":
    sys.exit(main())
