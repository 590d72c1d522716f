"""Batches held against all history: planted cases, and random ones against brute force."""

import random
import string

import pytest

pytest.importorskip("loomfeed.llm")
from pyspark.sql import functions as F  # noqa: E402

from loomfeed.llm import history  # noqa: E402

BASE = "Why we patched Oskyelithyor beyond external batches: public adapter lessons from Olacael"


def found(df):
    return {r.dup_id: r.first_id for r in df.collect()}


def test_links_between_copies(articles):
    df = articles(
        {"title": BASE, "url": "https://a.example/x"}, {"title": "Other words about quite another thing here", "url": "http://www.A.example:80/x/?utm_source=q#c"},
        {"title": "[Repost] " + BASE, "source_id": "b"}, {"title": BASE.replace("adapter", "adpater") + " - Alpha"}, {"title": BASE.upper() + "!", "source_id": "c"},
        {"title": "Open thread"}, {"title": "Open thread"}, {"title": "Nimtor Loske notes #1"}, {"title": "Nimtor Loske notes #2"}, {"title": "Nimtor  Loske notes # 1"},
        {"external_id": " k1"}, {"external_id": "k1 ", "source_id": " ALPHA"}, {"external_id": "k1", "source_id": "b"}, {"external_id": "", "url": "nope", "title": None},
    )
    assert found(history.repeated_items(df)) == {2: 1, 3: 1, 4: 1, 5: 1, 10: 8, 12: 11}
    assert history.repeated_items(df.limit(0)).count() == 0


def near(x, y):
    """By plain dynamic programming: what ``is_near`` says."""
    n, m = min(len(x), len(y)), abs(len(x) - len(y))
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        row, last = [i], row
        for j, e in enumerate(y, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != e)))
    d = row[-1]
    short, long = sorted((x, y), key=len)
    place = 0 < m <= history.EDITS and any(long[:p] + long[p + m :] == short for p in range(len(short) + 1))
    return d == 0 or (n >= history.ONE_EDIT and (d == 1 or (d == 2 and (n >= history.TWO_EDITS or sorted(x) == sorted(y))) or place))


def edited(rng, t):
    kind = rng.randrange(5)
    for _ in range(rng.randrange(1, 3)):
        p = rng.randrange(len(t))
        c = rng.choice("abcdefgh")
        t = [t[:p] + c + t[p + 1 :], t[:p] + c + t[p:], t[:p] + t[p + 1 :], t[:p] + t[p + 1 : p + 2] + t[p : p + 1] + t[p + 2 :], t[:p] + rng.choice(["ab", "abc", "abcd"]) + t[p:]][kind]
    return t


def components(n, links):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in range(n) if top(i) != i}


@pytest.mark.parametrize("crowded", [64, 1])
def test_near_headlines_against_brute_force(spark, articles, monkeypatch, crowded):
    """All pairs of random edits are found: the recall of the part hashes is 1, crowded or not."""
    monkeypatch.setattr(history, "CROWDED", crowded)
    rng = random.Random(crowded)
    texts = ["".join(rng.choices(string.ascii_lowercase, k=rng.randrange(14, 80))) for _ in range(14)]
    texts += [edited(rng, rng.choice(texts)) for _ in range(130)]
    same = "".join(rng.choices(string.ascii_lowercase, k=40))
    texts += [same[:p] + rng.choice(string.ascii_lowercase) * 2 + same[p:] for p in (5, 5, 5, 20, 20, 20, 39, 39, 39)]  # equal but for a short window
    spaced = [f"{t[:3]} {t[3:6]} {t[6:8]} {t[8:10]} {t[10:]}" for t in texts]  # five words
    df = articles(*({"article_id": i, "title": t, "batch_no": i % 5} for i, t in enumerate(spaced)))
    links = [(i, j) for j in range(len(texts)) for i in range(j) if near(texts[i], texts[j])]
    want = components(len(texts), links)
    assert len(want) > 90
    assert found(history.repeated_items(df, rounds=1)) == want
    if crowded == 64:
        assert found(history.repeated_items(df, rounds=3)) == want


def test_is_near_against_plain_programming(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(1500):
        t = "".join(rng.choices("abcdefgh", k=rng.randrange(8, 50)))
        pairs.append((t, edited(rng, t)))
    got = spark.createDataFrame(pairs, "x string, y string").select("x", "y", history.is_near(F.col("x"), F.col("y")).alias("n")).collect()
    assert [r.n for r in got] == [near(r.x, r.y) for r in got] and 300 < sum(r.n for r in got) < 1400


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r.id: r.first for r in history.components(links).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 100: 90, 95: 90}


def test_a_batch_that_connects_two_items(spark, articles, tmp_path):
    store = history.History(spark, str(tmp_path / "h"), 3)
    rows = [{"article_id": 1, "url": "https://a.example/a"}, {"article_id": 2, "url": "https://a.example/b", "title": BASE}, {"article_id": 3, "url": "https://a.example/a", "title": BASE}, {"article_id": 4, "url": "https://a.example/b"}]
    got = [found(history.accept(articles(*part), store)) for part in (rows[:2], rows[2:3], rows[3:])]
    assert got == [{}, {3: 1}, {4: 1}]
    assert {r.id: r.first for r in store.labels.read().collect()} == {2: 1, 3: 1, 4: 1}
    assert store.whole.read().count() == 3  # keys that history has aren't stored again
    assert found(history.accept(articles(*rows[1:3]), store)) == {2: 1, 3: 1} and store.whole.read().count() == 3  # held again
    store.drop()


def test_stored_history_outlives_the_session(spark, articles, tmp_path):
    path = str(tmp_path / "h")
    one = history.History(spark, path, 3)
    history.accept(articles({"article_id": 1, "title": BASE}), one)
    for t in (one.whole, one.parts, one.labels):
        spark.sql(f"DROP TABLE {t.name}")
    again = history.History(spark, path, 3)
    assert not again.whole.exists()
    got = history.accept(articles({"article_id": 2, "title": BASE.replace("lessons", "lesson")}), again.reopen())
    assert found(got) == {2: 1}


def test_random_batches_with_bridges(spark, articles):
    rng = random.Random(13)
    letters = lambda k: "".join(rng.choices(string.ascii_lowercase, k=k))
    heads = [f"{letters(9)} {letters(8)} {letters(4)} of {letters(9)}" for _ in range(25)]
    rows = []
    for i in range(150):
        head = rng.choice(heads)
        rows.append({
            "article_id": i, "batch_no": i // 10, "source_id": rng.choice(["a", "A ", "b"]), "url": rng.choice([None, "x", f"https://a.example/{rng.randrange(60)}"]),
            "external_id": rng.choice([None, " ", f"e{rng.randrange(40)}"]), "title": rng.choice([None, "News", head, head.replace("of", "off")]),
        })

    def same(x, y):
        title = lambda r: (r["title"] or "").replace(" ", "")
        return (
            (x["url"] == y["url"] and "https" in (x["url"] or "")) or ((x["external_id"] or "").strip() and x["external_id"] == y["external_id"] and x["source_id"].strip().lower() == y["source_id"].strip().lower())
            or (" " in (x["title"] or "") and " " in (y["title"] or "") and near(title(x), title(y)))
        )

    want = components(len(rows), [(i, j) for j in range(len(rows)) for i in range(j) if same(rows[i], rows[j])])
    df = articles(*rows)
    assert found(history.repeated_items(df, rounds=1)) == want == found(history.repeated_items(df, rounds=5))


def test_history_is_joined_without_an_exchange(spark, articles, tmp_path):
    store = history.History(spark, str(tmp_path / "h"), 5)
    batch = articles({"article_id": 1, "title": BASE, "url": "https://a.example/a"})
    history.accept(batch, store)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for table, key in ((store.whole, "k"), (store.parts, "k"), (store.labels, "id")):
            new = spark.range(1000).withColumnRenamed("id", key)
            plan = table.read().join(new, key, "left_semi")._jdf.queryExecution().executedPlan().toString()
            tree = plan.split("\n")
            scan = next(i for i, x in enumerate(tree) if "FileScan" in x or "Scan parquet" in x)
            above = [x for x in tree[:scan] if "Exchange" in x and x.index("Exchange") < tree[scan].index("Scan")]
            assert plan.count("Exchange") == 1 and not above, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        store.drop()


def test_nulls_repeats_and_clashing_columns(spark, articles):
    names = ["k", "id", "t", "nums", "r", "old", "a", "b", "h", "n", "u", "v", "m", "e", "first", "item", "split", "_t", "_nums", "page", "external", "headline", "first_id", "dup_id"]
    row = {"article_id": 1, "title": BASE, "url": "https://a.example/x", "external_id": "e"}
    none = {c: None for c in ("title", "url", "external_id", "source_id", "source_name", "batch_no")}
    df = articles(row, row, {**row, "article_id": 2, "batch_no": 3}, {**none, "article_id": 3}, {**none, "article_id": None}, {**none, "article_id": 4, "title": ""}, {**none, "article_id": 5, "title": "long " * 30_000}).withColumns({n: F.lit("x") for n in names})
    assert found(history.repeated_items(df)) == {2: 1}
