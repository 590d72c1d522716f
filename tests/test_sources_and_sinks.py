import io
import json
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from loomfeed import schemas
from loomfeed.plans.pipeline import EditionSettings, edition, write_edition
from loomfeed.sinks import digest, files, site
from loomfeed.sources import documents, feeds, index_pages, web
from loomfeed.streaming import editions as stream

RSS = b"""<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>F</title>
<item><title>A &amp;amp; B</title><link>https://x.example/1</link><guid>g1</guid><pubDate>Mon, 06 Oct 2025 10:00:00 +0200</pubDate><dc:creator>Ann</dc:creator><description><![CDATA[<p>Hi <b>you</b></p>]]></description></item>
<item><link>https://x.example/2</link><description/><content:encoded><![CDATA[<p>Full</p>]]></content:encoded><pubDate>soon</pubDate></item></channel></rss>"""
ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>E</title><link rel="self" href="https://x.example/s"/><link href="https://x.example/e"/><id>i</id>
<updated>2025-10-06T10:00:00Z</updated><author><name>Bo</name></author><summary type="html">&lt;p&gt;S&lt;/p&gt;</summary></entry></feed>"""
RDF = b"""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"><item><title>R</title><link>https://x.example/r</link></item></rdf:RDF>"""


def sources(spark, *rows):
    full = [(i, i, p, f, f"https://{i}.example/", "ai", 5, "daily", True, False, ["t"], k) for k, (i, p, f) in enumerate(rows)]
    return spark.createDataFrame(full, f"{schemas.SOURCE}, source_pos int")


def test_feeds(spark):
    src = sources(spark, ("a", "feed", "rss"), ("b", "feed", "atom"), ("c", "feed", "rss"), ("d", "feed", "rss"))
    bodies = spark.createDataFrame([("a", bytearray(RSS)), ("b", bytearray(ATOM)), ("c", bytearray(RDF)), ("d", bytearray(b"<nope/>"))], "id string, body binary")
    rows = feeds.feed_articles(src.join(bodies, "id"), "2026-01-01T00:00:00Z").orderBy("source_pos", "entry_pos").collect()
    a1, a2, b, c, d = rows
    assert (a1.title, a1.summary, a1.author, a1.published_at, a1.external_id) == ("A & B", "Hi you", "Ann", "2025-10-06T08:00:00Z", "g1")
    assert (a2.title, a2.summary, a2.published_at, a2.external_id) == ("Untitled", "Full", "soon", "https://x.example/2")
    assert (b.url, b.author, b.summary, b.updated_at, c.title, d.error) == ("https://x.example/e", "Bo", "S", "2025-10-06T10:00:00Z", "R", "unknown feed format: nope")
    with pytest.raises(ValueError):
        feeds.read_feed(b"<rss/>")


def test_collect_with_retries(spark):
    src = sources(spark, ("a", "feed", "rss"), ("b", "feed", "rss"), ("i", "html_index", "html"))
    index = b'<main><div><b>Technical Articles</b><h3><a href="/p">Card</a></h3><p>by Jo Doe October 5, 2025</p><p>A summary that is longer.</p></div><div><b>Projects</b><h3><a href="/q">No</a></h3><p>May 1, 2025</p></div></main>'

    def transport(url, seconds, headers, most):
        if url.startswith("https://a"):
            return web.Answer(403) if headers["User-Agent"] == web.AGENT else web.Answer(200, "text/xml", RSS, url)
        return web.Answer(200, "text/html", index, url) if url.startswith("https://i") else web.Answer(timed_out=True, error="timed out")

    layouts = {"i": index_pages.IndexLayout("Technical Articles", "Projects")}
    articles, reports = web.collect(src, "2026-01-01T00:00:00Z", transport=transport, layouts=layouts)
    assert sorted(r.url for r in articles.collect()) == ["https://i.example/p", "https://x.example/1", "https://x.example/2"]
    assert {r.source_id: (r.status, r.retry_count, r.article_count) for r in reports.collect()} == {"a": ("success", 1, 2), "b": ("failed", 1, 0), "i": ("success", 0, 1)}
    assert all(r.duration_seconds >= 0 and r.started_at <= r.completed_at for r in reports.collect())
    none = web.collect(src.where("id = 'i'"), "2026-01-01T00:00:00Z", transport=transport)[1].first()
    assert none.status == "failed" and "no layout" in none.error
    with pytest.raises(ValueError, match="gopher of g"):
        web.collect(sources(spark, ("g", "gopher", "x")), "2026-01-01T00:00:00Z", transport=transport)
    assert web.longer_timeout(20) == 40 and web.longer_timeout(5) == 15 and web.longer_timeout(50) == 60


def test_index_cards():
    layout = index_pages.IndexLayout("Technical Articles", "Projects")
    assert [index_pages.card_author(t) for t in ("Technical Articles Jan 5, 2026 by Ann Lee", "by Bo May 2, 2025 and more", "no one", "by ")] == ["Ann Lee", "Bo", None, None]
    assert [index_pages.card_date(t) for t in ("Feb 31, 2026", "Feb 28, 2026", "sep 3, 2025 or May 1, 2020", "5 May 2020")] == [None, "2026-02-28T00:00:00Z", "2025-09-03T00:00:00Z", None]
    cards = index_pages.read_index('<main><div><i>Technical Articles</i><h2><a href="x">One</a></h2><p>by A May 2, 2025</p></div><div><i>Technical Articles</i><h2><a href="x">Two</a></h2><p>May 2, 2025</p></div></main>', "https://s.example/", layout)
    assert [(c["title"], c["author"], c["published_at"]) for c in cards] == [("One", "A", "2025-05-02T00:00:00Z")]


def test_page_source_registers(spark):
    spark.dataSource.register(web.WebPages)
    assert spark.read.format("web_pages").option("urls", "").load().count() == 0


def test_documents(spark, tmp_path):
    day = tmp_path / "archive/2026/01/02"
    day.mkdir(parents=True)
    (day / "ranked_articles.json").write_text(json.dumps({"generated_at": "x", "learning": {"lessons": [{"lesson_id": "b"}]}, "articles": [{"learning_lesson_id": "c"}], "lesson_ids": ["a"]}))
    (tmp_path / "archive/broken.json").write_text("{nope")
    h = documents.edition_history(documents.read_payloads(spark, str(tmp_path / "archive")))
    assert [(r.date, r.lesson_ids) for r in h.collect()] == [("2026-01-02", ["a", "b", "c"])]
    with pytest.raises(Exception):
        documents.read_payloads(spark, str(tmp_path / "archive"), strict=True).collect()
    yml = tmp_path / "s.yml"
    yml.write_text("sources:\n  - {id: a, enabled: true}\n  - {id: b, enabled: false}\n")
    t = documents.source_table(spark, documents.read_yaml(str(yml))["sources"])
    assert [r.id for r in documents.chosen_sources(t, ["a", "a"]).collect()] == ["a"]
    with pytest.raises(ValueError, match="b, z"):
        documents.chosen_sources(t, ["z", "b"])


def test_edition_end_to_end(spark, articles, tmp_path):
    cats = spark.createDataFrame([("ai", "AI", 10, 1, 0), ("py", "Python", 5, 1, 1), ("zero", "Zero", 5, 0, 2)], schemas.CATEGORY)
    at = "2026-01-10T10:00:00Z"
    df = articles(
        {"url": "https://a.example/1", "title": "One & only <x>", "published_at": at, "content_html": "<p>Body <script>x</script></p>"}, {"url": "https://a.example/1?utm_x=1", "published_at": at, "summary": "longer summary", "source_priority": 1},
        {"url": "https://a.example/2", "published_at": at, "category": "py"}, {"url": "https://a.example/3", "published_at": at, "category": "py"}, {"url": "https://a.example/4", "published_at": at, "category": "zero"},
        {"url": "bad", "published_at": at}, {"url": "https://a.example/6", "published_at": "2025-01-01"}, {"url": "https://a.example/7"},
    )
    s = EditionSettings(project="D", max_articles=3, zone="Europe/Berlin")
    frames = edition(df, cats, "2026-01-10T12:00:00+00:00", s, ordinal="article_id")
    result = write_edition(frames, cats, "2026-01-10T12:00:00+00:00", str(tmp_path / "out"), s, site_dir=str(tmp_path / "site"))
    assert result["summary"]["time_filter"]["kept"] == 6 and result["summary"]["deduplication"]["unique_count"] == 4
    payload = json.loads((tmp_path / "out/ranked_articles.json").read_text())
    assert [a["article_id"] for a in payload["articles"]] == [2, 3, 4] or len(payload["articles"]) == 3
    assert all(not a["content_html"] and not a["content_text"] for a in payload["articles"])
    assert 2 in [a["article_id"] for a in payload["articles"]]  # the longer summary wins over the priority
    md = (tmp_path / "out/digest.md").read_text()
    assert md.startswith("# D — January 10, 2026") and "## AI" in md and "Zero" not in md
    book = (tmp_path / "out/digest.epub").read_bytes()
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        for n in z.namelist():
            if n.endswith(("xhtml", "opf", "ncx", "xml")):
                ElementTree.fromstring(z.read(n))
    members = documents.zip_members(spark, str(tmp_path / "out/digest.epub")).where(F.col("member") == "mimetype").first()
    assert members.text == "application/epub+zip"
    again = site.publish(tmp_path / "out", tmp_path / "site", zone="Europe/Berlin", title="D")
    assert again == {"date": "2026-01-10", "editions": 1, "catalog": True, "skipped": []}
    ElementTree.fromstring((tmp_path / "site/opds/catalog.xml").read_text())


def test_digest_is_deterministic_and_escaped():
    a = {"title": "A <b> & *c*", "url": "https://x.example/?a=1&b=2", "source_name": "S|", "category": "new_kind", "summary": " x  y ", "published_at": "bad", "updated_at": None, "content_html": "", "content_text": "p1\n\np2", "score": 3}
    common = {"generated_at": "2026-01-01T00:00:00Z", "project": "P", "zone": "UTC"}
    assert digest.epub([a], [], **common) == digest.epub([a], [], **common)
    assert "A &lt;b&gt; &amp; *c*" in digest.html([a], [], **common) and "New Kind" in digest.html([a], [], **common)
    assert "A <b> & \\*c\\*" in digest.markdown([a], [], **common)
    assert digest.anchors(["A b", "a-b", "!"]) == ["a-b", "a-b-2", "section"]
    assert "No articles were selected" in digest.markdown([], [], **common)


def test_manifest_policies(tmp_path):
    good = {"date": "2026-01-01", "generated_at": "2026-01-01T00:00:00Z", "article_count": 1, "path": "2026/01/01", "title": "t"}
    path = tmp_path / "index.json"
    path.write_text(json.dumps({"editions": [good, {**good, "path": "../x"}, {**good, "generated_at": "2026-01-01T00:00:00"}]}))
    assert site.load_manifest(path, strict=False) == [good]
    with pytest.raises(ValueError):
        site.load_manifest(path, strict=True)
    assert [e["date"] for e in site.upsert_edition([good], {**good, "date": "2026-01-02"})] == ["2026-01-02", "2026-01-01"]


def test_atomic_write_leaves_nothing(tmp_path):
    files.write_text(tmp_path / "a/b.txt", "x")
    files.write_text(tmp_path / "a/b.txt", "y")
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["b.txt"] and (tmp_path / "a/b.txt").read_text() == "y"


def test_stream_keeps_first_arrivals(spark, articles, tmp_path):
    rows = [{"url": "https://a.example/1", "published_at": "2026-01-01T00:00:00Z"}, {"url": "https://A.example/1/", "published_at": "2026-01-01T01:00:00Z"}, {"url": "https://a.example/2", "published_at": "2026-01-01T02:00:00Z"}]
    articles(*rows).drop("article_id", "batch_no").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    q = stream.run_editions(stream.first_arrivals(stream.arriving(spark, str(tmp_path / "in"))), lambda df, _: seen.extend(r.canonical_url for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(seen) == ["https://a.example/1", "https://a.example/2"]


def test_cards_and_expressions_agree(spark):
    """The author and the date of a card, as read on the executors and as expressions."""
    from loomfeed.functions import text, times

    cards = ["Technical Articles Jan 5, 2026 by Ann Lee", "by Bo May 2, 2025 and more", "no one", "By  J. R.  Doe | March 31, 2024", "Feb 31, 2026 by X", "sep 3, 2025", "May 5, 2020 May 6, 2021 by A B", "Standby mode by Cy", "by December 1, 2020", "Abby Nov 9, 2019"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cards)], "i int, t string")
    rows = df.select("t", text.author_of(F.col("t")).alias("a"), times.month_name_date(F.col("t")).alias("d")).orderBy("i").collect()
    for r in rows:
        assert (r.a, f"{r.d}T00:00:00Z" if r.d else None) == (index_pages.card_author(" ".join(r.t.split())), index_pages.card_date(r.t)), r
