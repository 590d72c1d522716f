"""Configuration, curriculum, verification and commands, end to end."""

import json
import shutil

import pytest
import yaml

from loomfeed import __main__ as commands
from loomfeed import schemas
from loomfeed.operators import curriculum, verification
from loomfeed.plans import pipeline
from loomfeed.sinks import reports
from loomfeed.sources import config, documents, web

SELECTION = {"enabled": True, "daily_count": 1, "rotation": "sequential", "include_in_max_articles": True, "history_source": "site_archive", "timezone": "UTC"}


def lesson(i, **x):
    base = {"id": f"l{i}", "order": i, "title": f"Lesson & {i}", "source_name": "School", "url": f"https://l.example/{i}", "track": "base", "topics": ["a"], "difficulty": "beginner", "estimated_minutes": 10 + i, "summary": "S.", "why_it_matters": "W.", "enabled": True}
    return base | x


def source(i, **x):
    return {"id": i, "name": i.title(), "provider": "feed", "format": "rss", "url": f"https://{i}.example/feed", "category": "ai", "priority": 5, "cadence": "daily", "enabled": True, "official": False, "tags": ["t"]} | x


@pytest.fixture
def folder(tmp_path):
    made = tmp_path / "config"
    made.mkdir()
    put = lambda name, value: (made / f"{name}.yml").write_text(yaml.safe_dump(value))
    put("sources", {"sources": [source("a"), source("b", priority=7), source("off", enabled=False)]})
    put("profile", {"profile": {"timezone": "UTC"}, "categories": {"ai": {"label": "AI", "weight": 9, "daily_quota": 5}, "technical_learning": {"label": "Technical Learning", "weight": 5, "daily_quota": 0}}, "keywords": {"high_priority": ["One"]}})
    put("settings", {
        "project": {"name": "Digest", "version": "1"},
        "runtime": {"lookback_hours": 48, "request_timeout_seconds": 5, "max_articles": 3, "max_summary_chars": 100, "output_dir": str(tmp_path / "out"), "site_dir": str(tmp_path / "site"), "user_agent": "x", "fail_on_source_error": False},
        "features": {"fetch_feeds": True, "ranking": True, "full_content_epub": True, "build_site": True},
    })
    put("learning_library", {"schema_version": 1, "selection": SELECTION, "lessons": [lesson(2), lesson(1, content_html="<p>Curated</p>"), lesson(3, enabled=False)]})
    return made


def rss(*items):
    return ("<rss version='2.0'><channel><title>F</title>" + "".join(f"<item><title>{t}</title><link>{u}</link><pubDate>Fri, 09 Jan 2026 10:00:00 GMT</pubDate><description>About {t}</description></item>" for t, u in items) + "</channel></rss>").encode()


def offline():
    """A transport that is shipped with the tasks as it stands."""
    feed = rss(("One", "https://n.example/1"), ("Two", "https://n.example/2"), ("Three", "https://n.example/3"))
    answer = web.Answer

    def transport(url, seconds, headers, most):
        if url == "https://a.example/feed":
            return answer(200, "text/xml", feed, url)
        if url == "https://n.example/1":
            return answer(200, "text/html", ("<main>" + "<p>" + "word " * 300 + "</p></main>").encode(), url)
        return answer(404)

    return transport


def test_faults_are_named_at_once(folder):
    assert config.summary_of(config.read_project(folder)) == {
        "project": {"name": "Digest", "version": "1"}, "total_sources": 3, "enabled_sources": 2,
        "categories": {"ai": [{"id": "b", "name": "B", "priority": 7, "cadence": "daily", "format": "rss"}, {"id": "a", "name": "A", "priority": 5, "cadence": "daily", "format": "rss"}]},
    }
    (folder / "sources.yml").write_text(yaml.safe_dump({"sources": [source("a", priority=11), source("B b", url="ftp://x"), {**source("c"), "enabled": "yes"}, 5]}))
    (folder / "profile.yml").write_text(yaml.safe_dump({"categories": {"ai": {"weight": 0, "daily_quota": True}}}))
    with pytest.raises(config.ConfigError) as e:
        config.read_project(folder)
    assert e.value.faults == [
        "sources[3] must be a mapping", "sources[1].id must be lower-case letters, digits and underscores", "sources[1].url must be an http or https URL", "sources[0].priority must be a whole number from 1 to 10",
        "sources[2].enabled must be true or false", "profile is missing", "categories.ai.weight must be a whole number from 1 to 10", "categories.ai.daily_quota must be a whole number of 0 or more",
    ]
    (folder / "profile.yml").write_text(yaml.safe_dump({"profile": {}, "categories": {"ml": {"weight": 1, "daily_quota": 1}}}))
    (folder / "sources.yml").write_text(yaml.safe_dump({"sources": [source("a"), source("a", format="html")]}))
    with pytest.raises(config.ConfigError, match="provider and format.*repeated source ids: a; categories of sources that the profile lacks: ai"):
        config.read_project(folder)
    for text in ("[1", "- 1"):
        (folder / "sources.yml").write_text(text)
        with pytest.raises(config.ConfigError):
            config.read_project(folder)


@pytest.mark.parametrize("change, said", [
    ({"schema_version": 2}, "schema_version must be 1"), ({"selection": {**SELECTION, "timezone": "Mars/Base"}}, "selection.timezone must be a time zone"), ({"selection": {**SELECTION, "daily_count": 0}}, "daily_count must be at least 1"),
    ({"selection": {**SELECTION, "rotation": "random"}}, "one of sequential"), ({"lessons": []}, "lessons must be a list that isn't empty"), ({"lessons": [lesson(1, enabled=False)]}, "no lesson is"), ({"lessons": [lesson(1), lesson(1)]}, "repeated lesson ids: l1"),
    ({"lessons": [lesson(1, topics=["a", "a "])]}, "distinct"), ({"lessons": [lesson(1, estimated_minutes=True)]}, "positive whole"), ({"lessons": [{k: v for k, v in lesson(1).items() if k != "url"}]}, "url is missing"), ({"lessons": [lesson(1, difficulty="odd")]}, "one of beginner"),
])
def test_faults_of_a_curriculum(tmp_path, change, said):
    path = tmp_path / "l.yml"
    good = {"schema_version": 1, "selection": SELECTION, "lessons": [lesson(2), lesson(1, title=" T ")]}
    path.write_text(yaml.safe_dump(good))
    assert [(x["id"], x["title"]) for x in config.read_library(path).lessons] == [("l1", "T"), ("l2", "Lesson & 2")]
    path.write_text(yaml.safe_dump(good | change))
    with pytest.raises(config.ConfigError, match=said):
        config.read_library(path)
    with pytest.raises(config.ConfigError, match="not found"):
        config.read_library(tmp_path / "none.yml")


def test_choice_of_lessons(spark):
    lessons = documents.lesson_table(spark, [lesson(i, enabled=i != 4) for i in (1, 2, 3, 4)])
    history = spark.createDataFrame([("2026-01-01", "p1", ["l1", "l2"]), ("2026-01-02", "p2", ["l3", "l4", "gone"]), ("2026-01-05", "p5", ["l2", "x", "l1"]), ("2026-01-05", "p4", ["l3"])], "date string, path string, lesson_ids array<string>")

    def chosen(date, count):
        rows = curriculum.choose_lessons(lessons, history, date, count).orderBy("pick").collect()
        return [r.id for r in rows], rows[0].previous, rows[0].reused, rows[0].cycle_reset

    assert chosen("2025-12-31", 2) == (["l1", "l2"], None, False, False)
    assert chosen("2026-01-02", 1) == (["l3"], "l2", True, False)  # the same date again
    assert chosen("2026-01-02", 2) == (["l3", "l1"], "l2", False, True)  # too few of that date are known
    assert chosen("2026-01-03", 2) == (["l1", "l2"], "l3", False, True)  # the disabled one doesn't count
    assert chosen("2026-01-05", 2) == (["l2", "l1"], "l3", True, False)  # the last entry of the date, in its order
    assert chosen("2026-01-06", 1) == (["l2"], "l1", False, False)
    for bad in (lambda: curriculum.check_curriculum(lessons, 4), lambda: curriculum.check_curriculum(lessons.where("id = 'l4'"), 1), lambda: curriculum.check_curriculum(lessons, 1, "elsewhere")):
        with pytest.raises(ValueError):
            bad()


def test_archives_by_manifest_first(spark, tmp_path):
    for day in ("01", "02", "03"):
        place = tmp_path / "2026/01" / day
        place.mkdir(parents=True)
        (place / "ranked_articles.json").write_text(json.dumps({"generated_at": f"2026-01-{day}T00:00:00Z", "lesson_ids": [f"l{day}"]}))
    assert len(documents.edition_history(documents.archived_payloads(spark, str(tmp_path))).collect()) == 3
    assert documents.latest_payload(documents.read_payloads(spark, str(tmp_path))).first().lesson_ids == ["l03"]
    (tmp_path / "index.json").write_text(json.dumps(indent=1, obj={"editions": [{"date": "2026-02-02", "path": "2026/01/02"}, {"date": "2026-02-03", "path": "/2026/01/02/"}, {"date": " ", "path": "2026/01/01"}, {"path": "2020/01/01"}]}))
    h = documents.edition_history(documents.archived_payloads(spark, str(tmp_path))).orderBy("date").collect()
    assert [(r.date, r.lesson_ids) for r in h] == [("2026-01-01", ["l01"]), ("2026-02-02", ["l02"])]
    (tmp_path / "index.json").write_text("{nope")
    assert len(documents.archived_payloads(spark, str(tmp_path)).collect()) == 3


def test_checks_find_what_is_wrong(spark):
    failing = lambda df: {r.check_name: r.failing for r in df.collect() if not r.passed}
    stated = lambda *n: spark.createDataFrame([n], "requested int, extracted int, summary_fallback int, fetch_failed int")
    records = spark.createDataFrame([("extracted", 200, "web", "A", "s"), ("summary_fallback", None, "summary", "B", "s"), ("fetch_failed", None, "none", "C", "s")], "status string, http_status int, content_origin string, title string, source_id string")
    assert failing(verification.counter_checks(stated(3, 1, 1, 1), records)) == {}
    assert failing(verification.counter_checks(stated(4, 2, 1, 1), records)) == {"requested_as_stated": 1, "extracted_as_stated": 1}
    assert failing(verification.counter_checks(stated(3, 1, 1, None), records)) == {"fetch_failed_as_stated": 2} or "counters_add_up" in failing(verification.counter_checks(stated(3, 1, 1, None), records))
    odd = spark.createDataFrame([("extracted", 200, "none", "A"), ("odd", None, "what", "B")], "status string, http_status int, content_origin string, title string")
    assert set(failing(verification.counter_checks(stated(2, 1, 0, 1), odd))) == {"fetch_failed_as_stated", "status_known", "origin_known", "origin_allowed"}
    ids = lambda *x: spark.createDataFrame(list(enumerate(x)), "pos int, lesson_id string")
    own = lambda *x: spark.createDataFrame([(i, v, "technical_learning") for i, v in enumerate(x)], "pos int, lesson_id string, category string")
    assert failing(verification.lesson_id_checks(ids("a", "b"), own("a", "b"), expected=2)) == {}
    assert failing(verification.lesson_id_checks(ids("b", "a"), own("a", "b"))) == {"ids_as_stated": 2}
    assert failing(verification.lesson_id_checks(ids("a"), own("a", "a"), expected=1)) == {"ids_as_stated": 1, "ids_unique": 1, "lessons_expected": 1}
    tagged = spark.createDataFrame([("A", ["learning_content:curated"]), ("C", None), ("D", [])], "title string, source_tags array<string>")
    assert failing(verification.lesson_content_checks(records, tagged)) == {"curated_origin": 1, "others_not_failed": 1, "records_have_articles": 1, "articles_have_records": 1}
    assert sorted(map(tuple, verification.one_sided(records.select("title"), tagged, "title").collect())) == [("B", "left"), ("D", "right")]
    one, two = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string"), spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert sorted(r.k for r in verification.same_values(one, two, "k").collect()) == [2, 3]
    digests = spark.createDataFrame([("/out/d.epub", "1"), ("/site/d.epub", "1"), ("/site/latest/d.epub", "2")], "path string, digest string")
    assert failing(verification.copy_checks(digests, "out/d.epub", ["site/d.epub", "site/latest/d.epub"])) == {"copies_equal": 1}
    assert failing(verification.copy_checks(digests, "out/d.epub", ["nowhere"])) == {"copy_found": 1}
    pages = spark.createDataFrame([("x/c.xhtml", "<a>Original source</a><h2>T &amp; U</h2>Read the original article", None), ("x/s.css", "break-before: page;", None), (None, None, "broken")], "member string, text string, error string")
    assert failing(verification.epub_checks(pages, articles=2, full_content=1, chapter="c", titles=["T & U", "V"])) == {"sound": 1, "links_to_originals": 1, "full_texts": 1, "no_leftover_link": 1, "page_breaks": 4, "titles_in_chapter": 1}
    catalog = spark.createDataFrame([("<feed><title>t</title><link rel='self' href='c'/><entry><id>i</id><link rel='http://opds-spec.org/acquisition' href='b' type='application/epub+zip'/></entry></feed>",)], "value string")
    assert failing(verification.catalog_checks(catalog, "b", "i")) == {"type_of_self_link": 1}
    assert set(failing(verification.catalog_checks(catalog, "other", "i"))) == {"type_of_self_link", "one_entry", "type_of_book", "id_of_edition"}


def test_commands_end_to_end(spark, folder, tmp_path, capsys, monkeypatch):
    def call(*argv):
        capsys.readouterr()
        return commands.main([str(x) for x in argv], offline()), capsys.readouterr()

    code, said = call("run", "--config-dir", folder, "--validate-only")
    assert code == 0 and "Enabled sources:    2" in said.out
    assert call("run", "--config-dir", tmp_path)[0] == 2 and call("run", "--config-dir", folder, "--source", "off")[0] == 2
    code, said = call("run", "--config-dir", folder, "--now", "2026-01-10T12:00:00Z", "--json")
    result = json.loads(said.out)
    assert code == 0 and result["sources"]["failed_count"] == 1 and result["article_count"] == 3 and result["summary"]["learning"]["selected_lesson_ids"] == ["l1"]
    payload = json.loads((tmp_path / "out/ranked_articles.json").read_text())
    assert [a["title"] for a in payload["articles"]] == ["One", "Three", "Lesson & 1"] and payload["learning"]["lesson_ids"] == ["l1"]
    log = payload["summary"]["content_enrichment"]
    assert (log["requested_articles"], log["extracted_articles"], log["summary_fallback_articles"], log["content_origins"]["curated"], log["content_origins"]["web"]) == (3, 2, 1, 1, 1)
    code, said = call("verify", "--output-dir", tmp_path / "out", "--site-dir", tmp_path / "site", "--expected-total", 3)
    assert code == 0, said.out
    assert call("run", "--config-dir", folder, "--now", "2026-01-10T15:00:00Z")[0] == 0  # the same day: the same lesson
    assert json.loads((tmp_path / "out/ranked_articles.json").read_text())["learning"]["lesson_ids"] == ["l1"]
    assert call("run", "--config-dir", folder, "--now", "2026-01-11T09:00:00Z")[0] == 0  # the next day: the next one
    assert json.loads((tmp_path / "out/ranked_articles.json").read_text())["learning"]["lesson_ids"] == ["l2"]
    assert call("release", "--config-dir", folder, "--skip-tests", "--skip-generate")[0] == 0
    code, said = call("content-report", "--input", tmp_path / "out/ranked_articles.json", "--problems-only", "--markdown")
    assert code == 0 and "### Articles using fallback" in said.out and "| Extraction rate | 33.3% |" in said.out
    code, said = call("coverage-report", "--input", folder / "learning_library.yml", "--uncurated-only")
    assert code == 0 and "Next lesson to curate:" in said.out and "id:         l2" in said.out and "l3" not in said.out
    code, said = call("check-sources", "--config-dir", folder, "--output", tmp_path / "s.json")
    assert code == 1 and "Summary: 1 success, 0 warning, 1 failed, 3 articles" in said.out and json.loads((tmp_path / "s.json").read_text())["summary"]["source_count"] == 2
    shutil.copyfile(tmp_path / "out/digest.epub", tmp_path / "site/digest-full.epub")
    code, said = call("verify", "--output-dir", tmp_path / "out", "--site-dir", tmp_path / "site", "--json")
    assert code == 1 and [x["check_name"] for x in json.loads(said.out)["failed"]] == ["full book: copies_equal"]
    payload = json.loads((tmp_path / "out/ranked_articles.json").read_text())
    payload["summary"]["content_enrichment"]["extracted_articles"] = 9
    (tmp_path / "out/ranked_articles.json").write_text(json.dumps(payload))
    assert call("content-report", "--input", tmp_path / "out/ranked_articles.json")[0] == 1
    (tmp_path / "out/digest.md").unlink()
    with pytest.raises(FileNotFoundError):
        pipeline.site.publish(tmp_path / "out", tmp_path / "site", zone="UTC", title="x")


def test_reports_of_nothing(spark):
    records = spark.createDataFrame([], commands.RECORD)
    report = reports.content_report(records)
    assert report["requested_count"] == 0 and report["extraction_rate"] == 0 and "No article records." in reports.content_text(report) and "No article records." in reports.content_markdown(report)
    empty = reports.coverage_report(spark.createDataFrame([], schemas.LESSON))
    assert empty["next_uncurated"] is None and "No matching lessons." in reports.coverage_text(empty) and "`none`" in reports.coverage_markdown(empty)
