import random

import pytest
from pyspark.sql import functions as F

from loomfeed.functions import dom, text, times, urls


def one(spark, value, *exprs, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return tuple(df.select(*(e.alias(f"c{i}") for i, e in enumerate(exprs))).first())


def test_canonical_urls(spark):
    cases = {
        "HTTPS://Example.COM:443/a/b//?b=2&a=1&utm_source=x#top": "https://example.com/a/b?a=1&b=2",
        "http://user:pw@example.com:80": "http://example.com/",
        "http://example.com:8080/x/": "http://example.com:8080/x",
        " https://example.com./?gclid=1&UTM_x=2 ": "https://example.com/",
        "https://example.com/?a=&a=2": "https://example.com/?a=&a=2",
        "ftp://example.com/x": None, "/relative": None, "https://example.com:9x9/": None, "https://example.com:70000/": None, "": None, "   ": None, None: None,
    }
    df = spark.createDataFrame([(u, w) for u, w in cases.items()], "u string, want string")
    for r in df.withColumn("got", urls.canonical_url(F.col("u"))).withColumn("again", urls.canonical_url(F.col("got"))).collect():
        assert r.got == r.want, r.u
        assert r.again == r.got


def test_iso_grammar(spark):
    good = {
        "2026-07-30": "2026-07-30T00:00:00Z", "20260730": "2026-07-30T00:00:00Z", "2026-W31-4": "2026-07-30T00:00:00Z", "2026W314T10": "2026-07-30T10:00:00Z", "2026-W31": "2026-07-27T00:00:00Z",
        "2026-07-30T010203Z": "2026-07-30T01:02:03Z", "2026-07-30 01:02:03,5+02:00": "2026-07-29T23:02:03Z", "2026-07-30_01:02": "2026-07-30T01:02:00Z", " 2026-07-30T01:02z ": "2026-07-30T01:02:00Z",
    }
    bad = ["2026-07", "2026", "2026-7-3", "T12:00", "2026-07-30 America/New_York", "2026-W54-1", "2025-W53-1", "2026-02-30", "2026-07-30T24:00", "not-a-date", "", None]
    df = spark.createDataFrame([(v, w) for v, w in [*good.items(), *((b, None) for b in bad)]], "v string, want string")
    for r in df.withColumn("got", times.to_iso_z(times.iso_instant(F.col("v")))).collect():
        assert r.got == r.want, r.v


def test_text_functions(spark):
    v = F.col("v")
    assert one(spark, "a  b\tc ", text.collapse(v), text.word_count(v), text.truncate(v, 4)) == ("a b c", 3, "a…")
    assert one(spark, None, text.word_count(v), text.is_blank(v), text.truncate(v, 4), text.optional(v)) == (0, True, None, None)
    assert one(spark, "a  \tb\nc", text.inline_spaces(v)) == ("a b\nc",)
    assert one(spark, "Straße ΣΑΣ", text.fold(v), text.letters(v)) == ("strasse σασ", "strasseσασ")
    assert one(spark, "ai coding agents, c++ and äeda", text.contains_term(v, "ai coding"), text.contains_term(v, "eda"), text.contains_term(v, "coding agent"), text.contains_term(v, "c++")) == (True, False, False, True)
    assert one(spark, "a*b [c] \\ #", text.escape_markdown(v)) == ("a\\*b \\[c\\] \\\\ \\#",)
    assert one(spark, "a|b\nc", text.escape_markdown_cell(v)) == ("a\\|b c",)
    assert one(spark, "machine_learning", text.humanise(v), text.slug(v, ascii_only=True)) == ("Machine Learning", "machine-learning")
    assert one(spark, " ", text.humanise(v), text.slug(v)) == ("Other", "section")
    assert one(spark, "Text/HTML; charset=x", text.media_type(v)) == ("text/html",)
    assert one(spark, "a\n\n \nb\n\nc", text.paragraphs(v)) == (["a", "b", "c"],)
    assert one(spark, "Notes by Ann Lee October 5, 2025", text.author_of(v), times.month_name_date(v).cast("string")) == ("Ann Lee", "2025-10-05")
    assert one(spark, "abc_1", text.is_slug_id(v)) == (True,) and one(spark, "Abc", text.is_slug_id(v)) == (False,)
    assert one(spark, 1, text.pluralise(v, "article"), kind="int") == ("1 article",) and one(spark, 3, text.pluralise(v, "article"), kind="int") == ("3 articles",)
    assert one(spark, "/x/2025/10/05/ranked_articles.json", times.path_date(v).cast("string")) == ("2025-10-05",)


def test_freshness_rounding(spark):
    rng = random.Random(5)
    values = [27.0, 0.0, *(float(rng.randrange(172_800)) for _ in range(500))]
    df = spark.createDataFrame([(x,) for x in values], "s double").withColumn("h", times.freshness_hours(F.col("s")))
    assert all(r.h == round(r.s / 3600, 3) for r in df.collect())


PAGE = """<html><head><title>x</title></head><body><nav>menu</nav><article class="foo-sidebar"><h1>Title</h1>
<div class="post-content"><h2>Head &amp; more</h2><p>One <a href="/a" onclick="x" title=" t  t">link</a><p>Two <span>three</span>
<ul><li>i1<li>i2</ul><pre>a
 b</pre><table><tr><th>k<th>v</tr><tr><td>1</td><td colspan="2" class="z">2</td></tr></table><div class="ad-box">buy</div><p> </p><script>bad()</script></div></article></body></html>"""


def test_extraction():
    r = dom.extract(PAGE, "https://x.example/p", minimum=10)
    assert r["status"] == "extracted" and r["selector"] == "article class=post-content"
    assert r["content_text"] == "Head & more\n\nOne link\n\nTwo three\n\ni1\n\ni2\n\na\n b\n\nk | v\n\n1 | 2"
    assert '<a href="https://x.example/a" title="t t">link</a>' in r["content_html"] and 'colspan="2"' in r["content_html"]
    assert "buy" not in r["content_html"] and "bad" not in r["content_html"] and "class" not in r["content_html"]
    assert dom.extract(PAGE, "https://x.example/p", minimum=10_000)["status"] == "too_short"
    assert dom.extract("", "https://x.example")["status"] == dom.extract(None, None)["status"] == "empty"
    assert dom.extract(PAGE, "ftp://x")["status"] == "invalid_base_url"
    assert dom.extract(b"<p>\xff broken <![if", None, minimum=1)["content_text"].startswith("� broken")
    assert len(dom.extract(f"<main><p>{'word ' * 50_000}</p></main>", None, maximum=1000)["content_text"]) <= 1000


@pytest.mark.parametrize("name, noise", [("ad-box", True), ("ad", True), ("big ad", False), ("side-bar", False), ("my_sidebar", True), ("shared", False)])
def test_noise_names(name, noise):
    assert dom.is_noise(dom.Node("div", {"class": name})) is noise


def test_deep_pages_are_flattened():
    r = dom.extract("<main>" + "<div>" * 5000 + "<p>deep</p>" + "</div>" * 5000 + "<p>after</p></main>", None, minimum=1)
    assert r["status"] == "extracted" and "deep" in r["content_text"] and "after" in r["content_text"]
