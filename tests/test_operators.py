import random

import pytest
from pyspark.sql import functions as F

from loomfeed.operators import aggregates, content, dedup, editions, history, lessons, quality, ranking, selection, timewindow

NOW = "2026-01-10 12:00:00"


def test_window_bounds(articles):
    df = articles(
        {"published_at": "2026-01-08T12:00:00Z"}, {"published_at": "2026-01-08T11:59:59Z"}, {"published_at": "2026-01-10T12:15:00"}, {"published_at": "2026-01-10T12:15:01"},
        {"published_at": "bad", "updated_at": "2026-01-10T10:00:00+02:00"}, {"published_at": "bad"}, {"published_at": "  ", "updated_at": None},
    )
    got = [r.time_status for r in timewindow.classify_by_time(df, 48, now=NOW).orderBy("article_id").collect()]
    assert got == ["kept", "too_old", "kept", "future", "kept", "invalid", "missing"]
    assert timewindow.status_counts(timewindow.classify_by_time(df.limit(0), 48, now=NOW)).first().total == 0
    for bad in (0, -1, True):
        with pytest.raises(ValueError):
            timewindow.check_window(bad, 15)


def test_dedup_keeps_the_first_of_the_best(articles):
    df = articles(
        {"url": "https://a.example/x/?utm_source=1", "summary": "short"}, {"url": "HTTPS://A.example/x", "summary": "much longer"}, {"url": "https://a.example/x#y", "summary": "much longer"},
        {"url": "nope"}, {"url": None}, {"url": "https://a.example/z"},
    )
    d = dedup.deduplicate(df, "article_id")
    assert {r.article_id: r.dedup_status for r in d.collect()} == {1: "duplicate", 2: "kept", 3: "duplicate", 4: "invalid_url", 5: "invalid_url", 6: "kept"}
    assert [tuple(r) for r in dedup.duplicate_groups(d, "article_id").orderBy("duplicate_ordinal").collect()] == [("https://a.example/x", 1, 2, 1), ("https://a.example/x", 1, 2, 3)]
    assert tuple(dedup.dedup_summary(d).first()) == (6, 2, 2, 2, 1)
    assert sorted(r.article_id for r in dedup.keep_best_windowed(df, "article_id").collect()) == [2, 6]
    assert tuple(dedup.dedup_summary(dedup.deduplicate(df.limit(0), "article_id")).first()) == (0, 0, 0, 0, 0)


def test_scores_and_caps(spark, articles):
    cats = spark.createDataFrame([("ai", 7)], "category_id string, weight int")
    df = articles(
        {"title": "GPU kernel and compiler", "summary": "agents", "published_at": "2026-01-10T06:00:00Z", "source_tags": ["tooling"]},
        {"title": "plain", "summary": "kernels only", "published_at": "2026-01-10T05:59:59Z", "source_priority": None},
        {"title": "roundup weekly digest", "source_priority": 1},
    )
    s = ranking.Scoring(high_keywords=("gpu", "kernel", "compiler", "agents"), low_keywords=("roundup", "weekly", "digest"))
    rows = ranking.score(ranking.with_weights(df, cats), NOW, s).orderBy("article_id").collect()
    assert [r.score for r in rows] == [10 + 14 + 10 + 24, 14 + 8, 2 + 14 - 12]
    assert rows[0].matched_high_priority_keywords == ["gpu", "kernel", "compiler", "agents"]
    assert rows[0].score_reasons[-1] == "High-priority keyword bonus capped: 28 -> 24"
    assert rows[2].score_reasons[-1] == "Low-priority keyword penalty capped: 18 -> 12"
    with pytest.raises(Exception, match="no category"):
        ranking.with_weights(articles({"category": "zz"}), cats).collect()


def test_rank_order_and_ties(spark):
    rows = [(i, s, t, p, ti, "u") for i, (s, t, p, ti) in enumerate([(5, None, 1, "b"), (5, "2026-01-01 00:00:00", 1, "b"), (9, None, 1, "z"), (5, "2026-01-01 00:00:00", 1, "A"), (5, "2026-01-01 00:00:00", 3, "q"), (5, None, 1, "b")])]
    df = spark.createDataFrame(rows, "id int, score int, t string, source_priority int, title string, url string").withColumn("event_ts", F.col("t").cast("timestamp_ntz"))
    assert [r.id for r in ranking.ranked(df, "id").orderBy("rank_index").collect()] == [2, 4, 3, 1, 0, 5]
    assert [r.id for r in ranking.top_ranked(df, "id", 3).orderBy("rank_index").collect()] == [2, 4, 3]


def simulate(rows, quota, most, fill):
    taken, used, rest = [], {}, []
    for rank, cat in rows:
        if quota.get(cat, 0) <= 0:
            continue
        if len(taken) < most and used.get(cat, 0) < quota[cat]:
            taken.append(rank)
            used[cat] = used.get(cat, 0) + 1
        else:
            rest.append(rank)
    return sorted(taken + (rest[: most - len(taken)] if fill else []))


def test_quotas_against_a_simulation(spark):
    rng = random.Random(7)
    cases = []
    for case in range(60):
        quota = {c: rng.randrange(4) for c in "abcd"}
        rows = [(k, rng.choice("abcd")) for k in range(rng.randrange(25))]
        cases.append((case, quota, rows, rng.randrange(1, 12), rng.random() < 0.5))
    for _case, quota, rows, most, fill in cases[:12]:
        ranked = spark.createDataFrame(rows, "rank_index int, category string")
        dim = spark.createDataFrame([*quota.items()], "category_id string, daily_quota int")
        got = sorted(r.rank_index for r in selection.select_by_quota(ranked, dim, max_articles=most, fill_unused_slots=fill).collect())
        assert got == simulate(rows, quota, most, fill)
    assert selection.select_by_quota(ranked, dim, max_articles=0).count() == 0
    counts = selection.category_counts(ranked.limit(0), dim)
    assert sorted(map(tuple, counts.collect())) == [(c, 0) for c in "abcd"]


def test_reports(spark):
    r = spark.createDataFrame([("success", 3), (" Failed", 0), ("warning", None)], "status string, article_count int")
    assert tuple(aggregates.report_status_counts(r).first()) == (3, 2, 1, 1, 1, 3)
    assert aggregates.exit_code(r, True) == 1 and aggregates.exit_code(r, False) == 0 and aggregates.exit_code(r.limit(0), False) == 1
    e = spark.createDataFrame([("extracted", 200, None, 5), ("extracted", None, None, 5), ("summary_fallback", None, "odd", 1), (None, None, None, -1)], "status string, http_status int, content_origin string, word_count int")
    assert {r.origin: r.n for r in aggregates.origin_counts(e).collect()} == {"feed": 1, "web": 1, "curated": 0, "summary": 0, "none": 0, "unknown": 2}
    assert aggregates.enrichment_counts(e.limit(0)).first().extraction_rate == 0.0
    assert {r.check_name: r.failing for r in quality.enrichment_checks(e).collect()} == {"status_known": 1, "origin_allowed": 1, "word_count_not_negative": 1}
    assert aggregates.problems(e).count() == 2


def test_sources_are_checked(spark):
    good = ("abc_1", "A", "feed", "rss", "https://a.example/f", "ai", 3, "daily", True, False, ["x"])
    bad = ("A b", " ", "feed", "html", "ftp://a", None, 11, "", None, False, None)
    from loomfeed import schemas

    df = spark.createDataFrame([good, bad], schemas.SOURCE)
    assert sorted(r.violation for r in quality.source_violations(df).collect()) == sorted(["id", "name", "provider_format", "url", "category", "priority", "cadence", "flags"])


def test_history_and_rotation(spark):
    h = spark.createDataFrame([("2026-01-01", "a", ["x", "gone"]), ("2026-01-02", "b", ["gone"]), ("2026-01-03", "c", ["z"])], "date string, path string, lesson_ids array<string>")
    les = spark.createDataFrame([("x", 1, True), ("y", 2, True), ("z", 3, True), ("off", 0, False)], "id string, order int, enabled boolean")
    assert history.previous_lesson(h, les, "2026-01-03").first().lesson_id == "x"
    assert history.previous_lesson(h, les, "2026-01-01").first() is None
    assert history.same_date_entry(h, "2026-01-02").first().path == "b"
    pick = lambda prev, k: [(r.id, r.cycle_reset) for r in history.rotate(les, prev, k).orderBy("pick").collect()]
    assert pick(None, 1) == [("x", False)]
    assert pick("x", 1) == [("y", False)]
    assert pick("z", 1) == [("x", True)]
    assert pick("y", 2) == [("z", True), ("x", True)]
    assert pick("gone", 5) == [("x", False), ("y", False), ("z", False)]
    ids = spark.createDataFrame([(["a", " "], ["b"], None, ["a", "c"])], "a array<string>, b array<string>, c array<string>, d array<string>")
    assert ids.select(history.payload_ids(*(F.col(c) for c in "abcd"))).first()[0] == ["a", "b", "c"]


def test_asof_is_strict(spark):
    left = spark.createDataFrame([(1, "u", "2026-01-01 00:00:02"), (2, "u", "2026-01-01 00:00:01"), (3, "v", "2026-01-01 00:00:09"), (4, None, "2026-01-01 00:00:09")], "id int, k string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    right = spark.createDataFrame([(7, "u", "2026-01-01 00:00:01"), (8, "u", "2026-01-01 00:00:02")], "val int, k string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert {r.id: r.prev for r in history.asof_previous(left, right, "k", "t", "val", "prev").collect()} == {1: 7, 2: None, 3: None, 4: None}


def test_editions(spark, articles):
    old = spark.createDataFrame([("d1", 1), ("d2", 1)], "date string, n int")
    new = spark.createDataFrame([("d2", 2), ("d3", 2)], "date string, n int")
    assert sorted(map(tuple, editions.upsert(old, new, "date").collect())) == [("d1", 1), ("d2", 2), ("d3", 2)]
    r = editions.redact(articles({"content_html": "<p>x", "content_text": "x", "content_status": "extracted"})).first()
    assert (r.content_html, r.content_text, r.content_status) == ("", "", "not_requested")
    assert {x.check_name: x.failing for x in quality.public_checks(articles({"content_text": "x", "url": "u"}, {"url": "u"}), 1).collect()} == {"article_count_within_limit": 1, "no_content": 1, "status_reset": 0, "urls_unique": 1}
    kept, gone = editions.existing_only(spark.createDataFrame([("a",), ("b",)], "path string"), spark.createDataFrame([("a",)], "path string"))
    assert [r.path for r in kept.collect()] == ["a"] and [r.path for r in gone.collect()] == ["b"]


def test_enrichment_decisions(spark, articles):
    long = "<main>" + "<p>" + "word " * 200 + "</p></main>"
    df = articles(
        {"url": "https://a.example/1"}, {"url": "https://a.example/2", "summary": "s"}, {"url": "https://a.example/3"}, {"url": "https://a.example/4"}, {"url": "bad"},
        {"url": "https://a.example/6", "content_text": "own", "source_tags": ["learning_content:curated"]}, {"url": "https://a.example/7"},
    )
    pages = spark.createDataFrame(
        [("https://a.example/1", bytearray(long.encode()), "text/html; x", None), ("https://a.example/2", None, None, "timeout"), ("https://a.example/3", None, None, "timeout"), ("https://a.example/4", bytearray(b"%PDF"), "application/pdf", None), ("https://a.example/7", bytearray(b"<p>short"), None, None)],
        "url string, body binary, content_type string, error string",
    )
    got = {r.article_id: (r.content_status, r.content_origin) for r in content.enrich(df, pages).collect()}
    assert got == {1: ("extracted", "web"), 2: ("summary_fallback", "summary"), 3: ("fetch_failed", "none"), 4: ("summary_fallback", "summary"), 5: ("summary_fallback", "summary"), 6: ("extracted", "curated"), 7: ("summary_fallback", "summary")}


def test_lessons(spark):
    from loomfeed import schemas

    row = ("l1", "T", "S", "https://l.example/1", "track_a", 1, ["x", "technical_learning"], "easy", 10, "Sum.", "Because.", True, "<p>Body</p>")
    df = spark.createDataFrame([row], schemas.LESSON)
    a = lessons.lessons_to_articles(df, "2026-01-01T00:00:00Z", {"track_a": "ai"}).first()
    assert a.summary == "Sum. Why it matters: Because. Estimated reading time: 10 minutes. Difficulty: easy."
    assert a.source_tags == ["technical_learning", "learning_lesson_id:l1", "learning_track:track_a", "difficulty:easy", "estimated_minutes:10", "learning_content:curated", "x"]
    assert (a.category, a.content_text, a.published_at) == ("ai", "Body", None)
    ids = spark.createDataFrame([("learning:l1", ["learning_lesson_id:l1"]), (None, ["learning_lesson_id: l2 "]), ("x", None), ("learning:" + "i" * 20_000, None)], "e string, t array<string>")
    assert [r[0] for r in ids.select(lessons.lesson_id(F.col("e"), F.col("t"))).collect()] == ["l1", "l2", None, "i" * 20_000]
    assert lessons.news_capacity(3, 3, True) == 0


def test_one_url_with_half_of_all_rows(spark, articles, monkeypatch):
    from loomfeed import runtime

    monkeypatch.setattr(runtime, "LEAST_HOT", 20)
    rows = [{"article_id": i, "url": "https://hot.example/" if i % 2 else None if i % 4 == 0 else f"https://a.example/{i % 30}", "summary": "s" * (i % 17)} for i in range(400)]
    df = dedup.deduplicate(articles(*rows), "article_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    got = {r.article_id: (r.dedup_status, r.group_ordinal) for r in df.collect()}
    assert len(got) == 400 and sum(s == "invalid_url" for s, _ in got.values()) == 100
    groups = {}
    for r in rows:
        if r["url"]:
            groups.setdefault(r["url"], []).append(r)
    for g in groups.values():
        best = max(g, key=lambda r: (len(r["summary"]) > 0, len(r["summary"]), -r["article_id"]))["article_id"]
        first = min(r["article_id"] for r in g)
        assert {r["article_id"]: got[r["article_id"]] for r in g} == {r["article_id"]: ("kept" if r["article_id"] == best else "duplicate", first) for r in g}


def test_asof_over_spans_of_a_hot_key(spark):
    import bisect
    import random

    rng = random.Random(3)
    right = sorted(rng.sample(range(0, 3_000_000), 300))
    left = [rng.randrange(0, 3_000_000) for _ in range(500)]
    make = lambda ts, c: spark.createDataFrame([("hot", t, i) for i, t in enumerate(ts)], f"k string, s long, {c} long").withColumn("t", F.timestamp_seconds("s")).drop("s")
    got = {r.id: r.prev for r in history.asof_previous(make(left, "id"), make(right, "val"), "k", "t", "val", "prev", days=2).collect()}
    assert got == {i: (bisect.bisect_left(right, t) - 1 if bisect.bisect_left(right, t) else None) for i, t in enumerate(left)}
