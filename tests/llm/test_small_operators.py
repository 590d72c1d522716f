import random
from collections import Counter, defaultdict

import pytest

pytest.importorskip("loomfeed.llm")
from loomfeed.llm import boilerplate, capping, history, residue, site_lines, stuffing, survivor  # noqa: E402


def ids(df, c="article_id"):
    return sorted(r[0] for r in df.select(c).collect())


# --- capping

def brute_excess(rows, parts):
    out, sizes = [], Counter(r["batch_no"] for r in rows)
    groups = defaultdict(list)
    for r in rows:
        groups[r["batch_no"], None if r["source_id"] is None else r["source_id"].strip().lower()].append(r)
    for (b, _), g in groups.items():
        g.sort(key=lambda r: (-(r["source_priority"] or 0), -len((r["summary"] or "").strip()), r["article_id"]))
        out += [r["article_id"] for r in g[-(-sizes[b] // parts) :]]
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 13, 4])
def test_capping_against_brute_force(spark, articles, monkeypatch, block):
    monkeypatch.setattr(capping, "ID_BLOCK", block)
    rng = random.Random(3)
    rows = [
        {"article_id": i, "batch_no": rng.choice([0, 1, None]), "source_id": rng.choice(["hot", " HOT ", "hot", "b", None]), "source_priority": rng.choice([None, 1, 1, 2]), "summary": rng.choice([None, "", " ab ", "ab", "abc"])}
        for i in range(400)
    ]
    assert ids(capping.excess_articles(articles(*rows))) == brute_excess(rows, 20)
    assert ids(capping.excess_articles(articles(*rows), parts=1)) == []
    assert capping.excess_articles(articles(*rows[:1]).limit(0)).count() == 0


def test_weighted_sample(spark, articles):
    rows = [{"article_id": i, "source_priority": 9 if i % 2 else 0} for i in range(2000)]
    over = set(ids(capping.excess_articles(articles(*rows), parts=4, sharpness=1.0)))
    assert len(over) == 1500 and over == set(ids(capping.excess_articles(articles(*rows), parts=4, sharpness=1.0)))
    kept = [i for i in range(2000) if i not in over]
    assert sum(i % 2 for i in kept) > 380  # heavier records are likelier to stay


@pytest.mark.parametrize("sharpness", [0.5, 8.0, 40.0])
def test_levels_of_random_keys_stay_small(spark, sharpness):
    """However large the weights, no level holds more than a small part of one contributor."""
    from pyspark.sql import functions as F

    keyed = spark.range(50_000).withColumn("_key", capping.reservoir_key(F.lit(11), F.col("id"), sharpness)).withColumn("g", F.lit("hot")).withColumn("_id", F.col("id"))
    room = spark.createDataFrame([("hot", 20_000)], "g string, _room long")
    got = capping.cap_contributors(keyed, ["g"], "_id", "_key", room, random=True).where("_kept").select("id", "_key")
    want = keyed.orderBy(F.col("_key").desc(), "_id").limit(20_000)
    assert got.count() == 20_000 and got.agg(F.min("_key")).first() == want.agg(F.min("_key")).first()
    size = F.greatest(-F.col("_key"), F.lit(1e-300))
    power = F.floor(F.log2(size))
    level = power * capping.COARSE + F.floor((size / F.pow(F.lit(2.0), power) - 1) * capping.COARSE)
    assert keyed.groupBy(level.alias("l")).count().agg(F.max("count")).first()[0] < 300


# --- site lines

def test_site_lines_against_brute_force(spark, articles):
    rng = random.Random(4)
    pool = ["All rights reserved.", "ALL RIGHTS  reserved!", "Straße groß", "STRASSE GROSS", "", "12 34", "— —", *(f"line {chr(97 + k)}{chr(97 + k // 3)}" for k in range(20))]
    texts = [rng.choice(["\n", "\r\n"]).join(rng.choice(pool) for _ in range(6)) for _ in range(60)] + [None, "", " \n "]
    rows = [{"content_text": t, "source_id": rng.choice(["a", "A ", "b", None])} for t in texts]
    key = lambda x: "".join(c for c in x.casefold() if c.isalpha())
    per, total = defaultdict(set), Counter()
    for i, r in enumerate(rows, 1):
        if r["content_text"] and r["content_text"].strip():
            s = (r["source_id"] or "").strip().lower()
            total[s] += 1
            for line in r["content_text"].split("\n"):
                per[s, key(line)].add(i)
    want = sorted(
        (i, n) for i, r in enumerate(rows, 1) if r["content_text"] and r["content_text"].strip() for n, line in enumerate(r["content_text"].split("\n"), 1)
        if key(line) and len(per[(r["source_id"] or "").strip().lower(), key(line)]) >= max(3, total[(r["source_id"] or "").strip().lower()] / 10)
    )
    df = articles(*rows)
    assert sorted(map(tuple, site_lines.found_lines(df).collect())) == want
    clean = site_lines.without_lines(df, site_lines.recurring_lines(df)).select("article_id", "content_text", "content_clean").collect()
    for r in clean:
        if r.content_text is None:
            assert r.content_clean is None
        else:
            drop = {n for i, n in want if i == r.article_id}
            assert r.content_clean == "\n".join(x for n, x in enumerate(r.content_text.split("\n"), 1) if n not in drop)
    assert site_lines.found_lines(df.limit(0)).count() == 0


def test_exactly_a_tenth_counts(articles):
    df = articles(*({"content_text": f"{'Shared words' if i < 7 else 'x'}\n{'abcdefghij'[i % 10] * (i + 1)}"} for i in range(70)))
    assert {r.article_id for r in site_lines.found_lines(df).where("line_no = 1").collect()} >= set(range(1, 8))


def test_copies_are_one_cluster(articles):
    df = articles(*({"content_text": "same\nbody"} for _ in range(5)), {"content_text": "other\nbody"})
    assert site_lines.found_lines(df, least_clusters=2).count() == 6


def test_days_are_counted_exactly(spark, articles):
    one_day = ["2026-03-03T10:00:00Z", "Tue, 03 Mar 2026 12:00:00 GMT", "1772539200", "2026-03-04T01:00:00+05:00", None, "soon"]
    rows = [*({"content_text": "shared line", "published_at": t} for t in one_day), *({"content_text": "other line", "published_at": f"{d} Mar 2026"} for d in (1, 2, 3, 3))]
    days = lambda df, **x: {r.articles: r.days for r in site_lines.recurring_lines(df, share=0, **x).collect()}
    assert days(articles(*rows), least_days=1) == {6: 1, 4: 3}
    assert days(articles(*rows), least_days=2) == {4: 3}
    clock = spark.createDataFrame([("alpha", "Asia/Tokyo", True)], "source_id string, tz_name string, day_first boolean")
    local = articles(*({"content_text": "shared line", "published_at": t} for t in ("2026-03-03T23:00:00", "2026-03-04T01:00:00", "04/03/2026 02:00")))
    assert days(local, least_days=1, clock=clock) == {3: 1}
    many = articles(*({"content_text": "shared line", "published_at": f"{2000 + i // 336}-{i // 28 % 12 + 1:02}-{i % 28 + 1:02}"} for i in range(3000)))
    assert days(many, least_days=3000) == {3000: 3000}


def test_more_lines_than_are_broadcast(articles, monkeypatch):
    from loomfeed import runtime

    rows = [{"article_id": i, "content_text": f"Foot of {'abc'[i % 3]}\nown line {'xyz'[i % 3] * (i + 1)}\n" + "{{ post.title }}\n<%= yield %>" * (i % 20 == 0), "source_id": "hot" if i % 3 else "b"} for i in range(120)]
    df = articles(*rows)
    lines = site_lines.recurring_lines(df)
    few = [sorted(map(tuple, site_lines.found_lines(df).collect())), sorted(map(tuple, site_lines.without_lines(df, lines).select("article_id", "content_clean").collect())), ids(residue.residue_articles(df))]
    monkeypatch.setattr(site_lines, "BROADCAST_LINES", 0)
    monkeypatch.setattr(runtime, "LEAST_HOT", 10)
    assert few == [sorted(map(tuple, site_lines.found_lines(df).collect())), sorted(map(tuple, site_lines.without_lines(df, lines).select("article_id", "content_clean").collect())), ids(residue.residue_articles(df))]
    assert len(few[0]) > 100


# --- survivor

def member(i, p, **x):
    base = {"record_id": i, "source_id": "s", "source_name": "S", "category": "c", "source_priority": p, "source_tags": [], "title": None, "url": None, "external_id": None, "published_at": None, "updated_at": None,
            "summary": None, "author": None, "fetched_at": f"2026-01-0{i % 9 + 1}T00:00:00Z", "content_html": "", "content_text": "", "content_status": ""}
    return base | x


def test_survivors(spark):
    struct = ", ".join(f"{k}:{'bigint' if k == 'record_id' else 'int' if k == 'source_priority' else 'array<string>' if k == 'source_tags' else 'string'}" for k in member(1, 1))
    schema = f"group_id long, kept_article struct<{struct}>, duplicate_articles array<struct<{struct}>>"
    rows = [
        (1, member(1, 9, title="Untitled", summary="A Title here", author="admin", published_at="0001-01-01T00:00:00Z"),
         [member(2, 5, title="A title here", summary="It says a lot more than that, really.", author="Ann Lee", published_at="2026-01-01T00:00:00+00:00"), member(3, 5, title="A title here", summary="Cut off in the", author="x@y.example", published_at="2026-13-01"), None]),
        (2, member(4, 1, title="Some long head…", author="  "), None),
        (None, None, [member(6, None, title="Lone"), member(7, None, title="Lone")]),
        (3, None, []),
        (4, member(8, 1, title="First"), []), (4, member(9, 1, title="Second"), []),
    ]
    got = {(r.group_id, r.field): r.record_id for r in survivor.survivors(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, "title"): 3, (1, "summary"): 2, (1, "author"): 2, (1, "published_at"): 2, (None, "title"): 7, (4, "title"): 8}
    assert survivor.survivors(spark.createDataFrame([], schema)).count() == 0


def test_a_window_ranks_the_candidates(spark):
    from loomfeed.runtime import table

    got = survivor.survivors(table(spark, "/root/testdata/sf0.001", "duplicate_group"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Aggregate" not in plan
    assert got.select("group_id", "field").distinct().count() == got.count() > 0


def test_large_groups_in_linear_time(spark):
    import time

    def seconds(n):
        struct = ", ".join(f"{k}:{'bigint' if k == 'record_id' else 'int' if k == 'source_priority' else 'array<string>' if k == 'source_tags' else 'string'}" for k in member(1, 1))
        each = [member(i, i % 9, title=f"A title of some length, number {i}", summary=f"A summary that says more about number {i} of them all than a title.", author=f"Ann Lee {i}", published_at="2026-01-01") for i in range(n)]
        df = spark.createDataFrame([(1, each[0], each[1:])], f"group_id long, kept_article struct<{struct}>, duplicate_articles array<struct<{struct}>>").repartition(1)
        df.count()
        began = time.perf_counter()
        best = max((x["source_priority"], x["fetched_at"], -x["record_id"]) for x in each)
        assert {(r.field, r.record_id) for r in survivor.survivors(df).collect()} == {(f, -best[2]) for f in ("title", "summary", "author", "published_at")}
        return time.perf_counter() - began

    seconds(50)
    small, large = seconds(400), seconds(3200)
    assert large < 8 * small + 2


BASE = "Why we patched Oskyelithyor beyond external batches: public adapter lessons from Olacael"


# --- residue

def test_residue(articles):
    foot = "Opinions on Alpha belong to their authors."
    body = ["A long enough sentence about modules that say something real.\n" + f"Second {w} sentence of the article.\n{foot}" for w in "abcdef"]
    df = articles(
        *({"content_text": t} for t in body), {"content_text": f"404 Not Found\nThe link may be broken or the page may have moved.\n{foot}"}, {"content_text": "{{ post.title }}\n<%= yield %>\nTODO: write the intro before launch"},
        {"content_text": "Lorem ipsum dolor sit amet. Veniam culpa aliqua enim."}, {"content_text": "Bitte aktivieren Sie JavaScript, um Alpha zu lesen."}, {"content_text": foot}, {"content_text": None}, {"content_text": " \n"},
        {"content_text": "A 404 Not Found reply made the crawler hide nine plugins from its long list of hosts."}, {"content_text": "Writing {{ cluster.title }} in a relay file tells the engine where the heading goes."}, {"content_text": "test " * 20_000},
    )
    assert ids(residue.residue_articles(df)) == [7, 8, 9, 10, 16]
    assert residue.residue_articles(df.limit(0)).count() == 0


def test_notices_in_other_languages():
    for line in ("Страница не найдена, включите JavaScript.", "ページが見つかりません。JavaScriptを有効にしてください。", "Pagina non trovata. Abilita JavaScript per continuare.", "Página não encontrada, ative o JavaScript.", "페이지를 찾을 수 없습니다.", "页面未找到，请稍后再试。",
                 "Pagina niet gevonden", "Nie znaleziono strony", "Sayfa bulunamadı", "504 Gateway Timeout", "Error 404: Not Found", "Request ID: 7f3a-22", "TODO: write the intro", "undefined undefined null {0} was published in {1} by {2}", "Posted by %AUTHOR% on %DATE% TODO: write the lead before launch", "Main template, version 2.4.41", "Placeholder for the side column, about 300 words.", "TK TK TK {{ body }} null", "Uncaught TypeError: x is not a function"):
        assert residue.covered(line) >= residue.LINE_SHARE, line


def test_ordinary_short_texts_are_no_residue():
    for line in ("Welcome to your draft for hello world.", "Sorry, the copy was gone.", "Hello from your server.", "Your ticket was posted by Ray.", "The words of this block.", "He was forbidden to enter.", "Nothing is null and none of it is undefined.",
                 "A loading dock caught fire.", "The incident was not found to be his fault.", "Fehler machen alle Menschen einmal.", "Una página de error no es un artículo.", "Elle a fait une erreur de calcul.", "Ray 2 is out now, and it is faster.",
                 "The new 404 Gallery opens on Monday.", "Placeholder names confuse new users.", "The page template, version two of which came out in May, is a good start.", "The comment that says TODO: fix the parser has been in this file for nine years, and nobody dares to touch it.", "In {braces} we trust, says the author of a book on templates.", "They test and test again until the build is green.", "JavaScript is a language that runs in every browser.", "東京で新しい店が開きました。"):
        assert residue.covered(line) < residue.LINE_SHARE, (line, residue.covered(line))


def test_floods_of_residue(articles):
    foot = "Opinions on Alpha belong to their authors, not to those who pay for any of their work."
    notice = "Please enable JavaScript to continue."
    body = [{"content_text": f"The team moved module {'abcdefghij'[i % 10] * (i + 1)} to another host.\n{foot}"} for i in range(90)]
    copied = "A long enough piece about heading slots in relay files.\nIt has its own second line.\n{{ cluster.title }}"
    rows = [
        *body, *({"content_text": notice} for _ in range(10)), {"content_text": f"{notice}\n{foot}"},
        *({"content_text": notice, "source_id": "walled"} for _ in range(30)),
        *({"content_text": copied, "source_id": "copies"} for _ in range(12)), *({"content_text": f"Text {'abcdefgh'[i] * 9} of it.", "source_id": "copies"} for i in range(8)),
        *({"content_text": "502 Bad Gateway", "source_id": "down"} for _ in range(300)), *({**b, "source_id": "down"} for b in body[:6]), {"content_text": f"404 Not Found\n{foot}", "source_id": "down"},
    ]
    want = [i for i, r in enumerate(rows, 1) if r["content_text"].split("\n")[0] in (notice, "502 Bad Gateway", "404 Not Found")]
    assert ids(residue.residue_articles(articles(*rows))) == want


# --- stuffing

def test_stuffing(spark):
    prose = "The cache team reverted its workflow because the old trigger failed under load, and nobody had tested it before. "
    long = prose + "Later the planner moved half of its probes to another host, which kept eleven of the batches alive. If a shard stops, the daemon must rebuild its index from the archive within an hour."
    cases = {
        "secret plugin " * 60: True, "\n".join(f"[cheap thing](https://x{i}.test/a)" for i in range(12)): True, "#oneTag #twoTag #threeTag #fourTag #fiveTag #sixTag": True,
        "Tags: alpha, beta, gamma, delta, epsilon, zeta, eta, theta, iota, kappa, lambda, mu": True, "\n".join(f"https://x{i}.test/buy/{i}" for i in range(9)): True, prose + "\n" + "best offer; cheap offer; buy now; " * 30: True,
        long: False, long + "\nhttps://a.test/1\nhttps://a.test/2": False, "": False, None: False, "x" * 90: False, "1234567890": False, "http://a.test": False, "A heading": False, "Contact us": False, "x = 1; y = 2": False,
        "\n".join(f"- option{i}: sets the number of the retries that a client makes before it gives up." for i in range(12)): False,
    }
    df = spark.createDataFrame([(i, t, "en", "z") for i, t in enumerate(cases)], "doc_id long, text string, lang string, share string")
    assert ids(stuffing.stuffed_documents(df), "doc_id") == [i for i, want in enumerate(cases.values()) if want]
    assert stuffing.stuffed_documents(df.limit(0)).count() == 0


def test_ratios_are_fitted(spark):
    import math

    rng = random.Random(1)
    n, level, slope = 4000, 2.2, -0.2
    x = [rng.uniform(5, 8) for _ in range(n)]
    y = [math.log(level) + slope * a + rng.gauss(0, 0.03) for a in x]
    sums = (n, sum(x), sum(y), sum(a * a for a in x), sum(a * b for a, b in zip(x, y, strict=True)))
    made = stuffing.fitted_ratios({"en": sums, "xx": (1.0, 6.0, 5.0, 36.0, 30.0)})
    assert abs(made["en"][0] - level) < 0.1 and abs(made["en"][1] - slope) < 0.01 and abs(made["xx"][0] / made[""][0] - 1) < 0.2
    one = stuffing.fitted_ratios({})[""]
    assert abs(one[0] - stuffing.LEVEL) < 1e-9 and abs(one[1] - stuffing.SLOPE) < 1e-9
    assert [stuffing.language(x) for x in (None, " EN-us", "de", "x", "1234", "日本")] == ["", "en", "de", "", "", ""]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert abs(stuffing.fit_ratios(empty)[""][1] - stuffing.SLOPE) < 1e-9


def test_ratios_are_fitted_on_all_documents(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    prose = lambda n: [f"The {word()} of the {word()} is not in a {word()}, because it {word()} with {word()} and {word()} to the {word()}." for _ in range(n)]
    rows = [(i, "\n".join(prose(2)), "de" if i % 500 == 7 else "en") for i in range(2300)]
    rows += [(None, None, "en"), (9, " ", None), (9, " ".join(prose(120)), "fr"), (9, " ".join(prose(120)), "fr")]
    made = stuffing.fit_ratios(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5))
    sums = defaultdict(lambda: [0.0] * 5)
    for _, text, lang in rows:
        own = sums[stuffing.language(lang)]
        for w, x, y in stuffing.writing_blocks(text):
            own[:] = (a + w * v for a, v in zip(own, (1.0, x, y, x * x, x * y), strict=True))
    want = stuffing.fitted_ratios({k: tuple(v) for k, v in sums.items()})
    assert made.keys() == want.keys() == {"en", "de", "fr", ""}
    assert all(made[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_ratios_are_fitted_on_all_sentences():
    plain = [f"The {i * 7919 % 10007} of the {i * 104729 % 9973} is not in a {i * 31 % 977}, because it was with {i} and {i * i}." for i in range(200)]
    same = ["The cache of the host is not in a rack, because it was with one and two."] * 200
    mean = lambda text: sum(w * y for w, _, y in stuffing.writing_blocks(text))
    head, whole, line = "\n".join(plain[:80]), "\n".join(plain[:80] + same), " ".join(plain)
    assert len(head) > 4000 and mean(whole) < mean(head) - 0.5  # what follows the first 4000 characters counts
    assert max(x for _, x, _ in stuffing.writing_blocks(line)) < 9.5 and sum(w for w, _, _ in stuffing.writing_blocks(line)) == pytest.approx(4)  # as does one line of 18 000
    for lines in (plain, [line], ["The " + "x" * 999], plain[:1]):
        for least in stuffing.SIZES:
            blocks = stuffing._sized(lines, least)
            assert "".join(x for b in blocks for x in b) == "".join(lines) and all(sum(map(len, b)) + len(b) < 3 * least + 3 for b in blocks)
            assert len(blocks) == 1 or min(sum(map(len, b)) + len(b) for b in blocks) >= least
    assert not list(stuffing.writing_blocks(None)) and not list(stuffing.writing_blocks("The a of it."))


def test_long_runs_of_stuffing():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 10)))
    few, many = [word() for _ in range(60)], [word() for _ in range(4000)]
    listed = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    prose = lambda n: ". ".join(f"The {listed(many, 3)} of the {listed(many, 2)} is not in a {listed(many, 4)}" for _ in range(n)) + "."
    for n in (300, 5_000, 150_000):
        assert stuffing.stuffed_share(listed(few, n), "en") > 0.9
    assert stuffing.stuffed_share("\n".join(listed(few, 12) for _ in range(12_000)), "en") > 0.9
    assert stuffing.stuffed_share(prose(12_000), "en") < 0.05
    assert stuffing.stuffed_share("\n".join(listed(many, 30) for _ in range(4_000)), "en") < 0.05
    half = stuffing.stuffed_share(prose(3_000) + " " + listed(few, 60_000), "en")  # one line, a bit over half of it stuffing
    assert 0.5 < half < 0.8
    lines = ["ab " * 50, "x" * 250, "", "y", "z " * 30]
    blocks = stuffing._cut(lines, 40)
    assert "".join(x for b in blocks for x in b) == "".join(lines) and max(sum(map(len, b)) for b in blocks) <= 40


# --- boilerplate

def brute_cut(n, terminal, edges):
    def cost(side):
        cut = sum(t for t, s in zip(terminal, side, strict=True) if t > 0 and not s) + sum(-t for t, s in zip(terminal, side, strict=True) if t < 0 and s)
        return cut + sum(c for u, v, c in edges if side[u] != side[v])

    return min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n)), cost


def test_cuts_are_minimal():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randrange(1, 8)
        terminal = [rng.randrange(-9, 10) for _ in range(n)]
        edges = [(u, v, rng.randrange(5)) for u in range(n) for v in range(u + 1, n) if rng.random() < 0.5]
        least, cost = brute_cut(n, terminal, edges)
        assert cost(boilerplate.minimum_cut(n, terminal, edges)) == least


BODY = "The cache team reverted its workflow beyond the old release, since nobody had benchmarked the clock."
PAGE = """<html><body><nav><a href="/">Home</a><a href="/x">Docs</a></nav><article><h1>A fine headline</h1><p>%s</p><h2>Section</h2><pre>x = 1</pre>
<table><tr><td>a</td><td>1</td></tr></table><p>Tagged: a, b</p><div class="q1">Related story about something else</div></article><footer><p>Terms of use | Privacy | Imprint</p></footer></body></html>""" % BODY
TEXT = f"Home\nDocs\n\nA fine headline\r\n{BODY}\nSection\nx = 1\na | 1\nTagged: a, b\nRelated story about something else\nTerms of use | Privacy | Imprint"


def test_frames(articles):
    df = articles({"content_html": PAGE, "content_text": TEXT, "title": "A fine headline"}, {"content_html": None, "content_text": TEXT}, {"content_html": PAGE, "content_text": None}, {"content_html": " ", "content_text": "x"},
                  {"content_html": "<div", "content_text": "Some other words of text.", "source_id": None, "source_name": None, "title": None}, {"content_html": "<p>" * 3000 + "x", "content_text": "Yet another line of it.\n" * 300})
    got = sorted(map(tuple, boilerplate.page_frames(df).where("article_id < 5").collect()))
    assert got == [(1, n) for n in (1, 2, 9, 10, 11)]
    assert boilerplate.page_frames(df).where("article_id >= 5").count() >= 0
    assert boilerplate.page_frames(df.limit(0)).count() == 0


def test_table_rows_and_dom_edges():
    import time

    table = "".join(f"<tr><td>same</td><td>{i}</td><td>x <b>{i % 7}</b></td></tr>" for i in range(4000))
    html = f"<html><body><nav><p>Menu</p></nav><article><h1>A fine headline</h1><p>{BODY}</p><table>{table}</table></article></body></html>"
    lines = ["Menu", "A fine headline", BODY, *(f"same | {i} | x | {i % 7}" for i in range(4000))]
    began = time.perf_counter()
    features, containers = boilerplate.line_features(lines, html, "A fine headline", "Site", [False] * len(lines))
    assert time.perf_counter() - began < 3 and all("structure" in f for f in features[3:]) and "outside" in features[0]
    hubs, edges = boilerplate.dom_edges([(1,), (1, 2), (1, 2), ()])
    assert hubs == 2 and sorted((u, v) for u, v, _ in edges) == [(0, 4), (1, 5), (2, 5), (4, 5)]


def test_fit_moves_weights_by_evidence(articles):
    assert boilerplate.fitted({}) == boilerplate.PRIOR
    body, frame = frozenset(["bias", "inside", "prose"]), frozenset(["bias", "outside", "recurs"])
    few, many = boilerplate.fitted({body: 10, frame: 10}), boilerplate.fitted({body: 100_000, frame: 100_000})
    assert many["outside"] > few["outside"] > boilerplate.PRIOR["outside"] and many["prose"] < few["prose"] < boilerplate.PRIOR["prose"] and many["label"] == boilerplate.PRIOR["label"]
    assert boilerplate.agreed_label(frozenset(["bias", "inside", "label"])) is None
    flagged = boilerplate.recurring_flags(articles(*({"content_html": PAGE, "content_text": TEXT} for _ in range(30))), least=3, share=0.03)
    assert boilerplate.fit_weights(flagged, 30, sample=5).keys() == boilerplate.PRIOR.keys()
    assert boilerplate.fit_weights(flagged.limit(0), 0) == boilerplate.PRIOR


def test_clashing_columns_and_repeated_rows(spark, articles):
    from pyspark.sql import functions as F

    row = {"article_id": 1, "title": BASE, "url": "https://a.example/x", "content_text": "Alpha line.\nBeta line.", "content_html": "<p>Alpha line.</p>", "external_id": "e"}
    names = ["_source", "_line", "_lines", "_key", "_batch", "_kept", "_t", "_nums", "id", "k", "p", "page", "external", "headline", "text", "flags", "words", "share", "ids", "line_no", "first_id", "_titles", "v", "ts_utc", "field"]
    df = articles(row, row, {**row, "article_id": 2}).withColumns({n: F.lit("x") for n in names})
    assert {r.dup_id: r.first_id for r in history.repeated_items(df).collect()} == {2: 1}
    assert site_lines.found_lines(df).count() == 6
    assert len(ids(capping.excess_articles(df))) == 2
    assert residue.residue_articles(df).count() == 0 and boilerplate.page_frames(df).count() >= 0


def test_entry_without_this_subpackage(monkeypatch):
    import importlib
    import importlib.util

    import __spark_entry__ as entry

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name == "loomfeed.llm" else real(name, *a))
    assert "p2_found" not in importlib.reload(entry).queries()
    monkeypatch.undo()
    assert "p2_found" in importlib.reload(entry).queries()
