"""Passages of test items in documents: planted cases, and random edits against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("loomfeed.llm")
from loomfeed.llm import leakage  # noqa: E402

WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]


def test_words_of():
    assert leakage.words_of("<p>It&amp;s <a href='%s'>non-\n\tstop</a>, 1,000.5 don\u2019t soft\xadly A-B</p>" % ("x" * 4000)) == ["it", "s", "nonstop", "10005", "dont", "softly", "a", "b"]
    assert leakage.words_of(None) == leakage.words_of(" \n") == []


def test_every_chain_has_its_anchors_in_one_band():
    """All ways to make a chain of stretches of three words or more with gaps of two at most on either side."""

    def chains(least, words, stretches):
        if words >= least:
            yield stretches
            return
        for gap in range(leakage.GAP + 1 if stretches else 1):
            for n in range(leakage.STRETCH, max(leakage.STRETCH, least - words - gap) + 1):
                yield from chains(least, words + gap + n, [*stretches, n // leakage.STRETCH])

    for least in (3, 5, 8, 14, 20):
        need, width = leakage.least_anchors(least), leakage.drift(least)
        for x in chains(least, 0, []):
            assert any(sum(x[i : j + 1]) >= need and leakage.GAP * (j - i) <= width for i in range(len(x)) for j in range(i, len(x))), (least, x)
    assert (leakage.least_anchors(20), leakage.drift(20)) == (4, 6)


def test_leaks(spark):
    rng = random.Random(6)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    passage = [rng.choice(words) for _ in range(60)]
    other = [rng.choice(words) for _ in range(60)]
    fill = lambda n: [rng.choice(words) for _ in range(n)]
    changed = passage[5:30]
    changed[12] = "changed"
    dropped = passage[5:18] + passage[19:32]
    docs = [
        (1, " ".join(fill(50) + passage + fill(50))), (2, " ".join(fill(30) + passage[10:30] + fill(9))), (3, " ".join(fill(30) + passage[10:29] + fill(9))), (4, " ".join(fill(9) + changed + fill(9))),
        (5, "<p>" + "</p>\n<b>".join(w.upper() + "," for w in passage[:25])), (6, None), (7, ""), (8, " ".join(fill(20_000) + other[:22])), (9, "Answer using only the passage."), (10, " ".join(dropped)), (1, " ".join(passage)), (None, " ".join(passage)),
    ]
    items = spark.createDataFrame([(1, "Answer using only the passage.\n" + " ".join(passage)), (2, " ".join(other)), (3, None), (4, "too short"), (None, "x")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in leakage.leaked(df, items).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (4, 1), (5, 1), (8, 2), (10, 1)]
    assert leakage.leaked(df.limit(0), items).count() == 0 and leakage.leaked(df, items.limit(0)).count() == 0


def test_passages_spread_over_diagonals(spark):
    rng = random.Random(12)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    passage = rng.sample(words, 60)
    fill = lambda n: [rng.choice(words) for _ in range(n)]
    added = [[*passage[k : k + 7], "added"] for k in range(14, 35, 7)]
    dropped = [passage[k : k + 7] for k in range(10, 34, 8)]
    docs = [(1, fill(40) + sum(added, []) + fill(40)), (2, fill(40) + sum(dropped, []) + fill(40)), (3, fill(40) + sum(added[:2], []) + fill(40))]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in docs], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string")
    assert sorted(r.doc_id for r in leakage.leaked(df, items).collect()) == [1, 2]


def test_items_repeated_under_one_id(spark):
    one, two, three = (" ".join(f"{c}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)) for c in "xyz")
    items = spark.createDataFrame([(1, one), (1, two), (1, one), (1, " ".join(one.split()[:25])), (2, three)], "item_id long, text string")
    df = spark.createDataFrame([(1, one), (2, two), (3, f"{two} and {one}"), (3, f"{two} and {one}"), (4, three)], "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.item_id, r.words) for r in leakage.leaked(df, items).collect())
    assert got == [(1, 1, 40), (2, 1, 40), (3, 1, 40), (3, 1, 40), (4, 2, 40)]




def test_long_tags_first_lines_and_instructions(spark):
    rng = random.Random(5)
    one, two, three, four = (rng.sample(WORDS, 40) for _ in range(4))
    instruction = "Read all of the following passage with care and then answer each of the questions below it."
    tag = f'<a href="https://x.test/{"q" * 900}">'
    items = spark.createDataFrame(
        [(1, f"{instruction}\n{' '.join(one)}"), (2, f"{instruction}\n{' '.join(two)}"), (3, f"{' '.join(three[:8])}\n{' '.join(three[8:])}"), (4, f"{' '.join(four[:12])}\r\n\r\n{' '.join(four[12:])}")], "item_id long, text string"
    )
    docs = [
        (1, " ".join([*one[:12], tag, *one[12:24]])), (2, f"{instruction} {' '.join(two[:3])}"), (3, " ".join(three[:20])), (4, " ".join(four[:21])), (5, "un-\n \t".join(["x", *one])),
        (6, " ".join(w[:2] + "-\t\n" + w[2:] for w in two[:22])),
    ]
    got = leakage.leaked(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, r.item_id, r.words, r.exact) for r in got) == [(1, 1, 24, True), (3, 3, 20, True), (4, 4, 21, True), (6, 2, 22, True)]


def test_recall_of_random_edits_against_brute_force(spark):
    rng = random.Random(21)
    items = {i: rng.sample(WORDS, 30) + [rng.choice(WORDS[:30]) for _ in range(30)] for i in range(1, 9)}
    docs = {}
    for d in range(400):
        words = [rng.choice(WORDS[:200]) for _ in range(rng.randrange(0, 60))]
        begin, n = rng.randrange(0, 35), rng.randrange(16, 34)
        for w in rng.choice(list(items.values()))[begin : begin + n]:
            kind = rng.random()
            if kind < 0.04:
                words += ["changed"]
            elif kind < 0.08:
                words += [w, *rng.sample(WORDS, rng.randrange(1, 3))]
            elif kind >= 0.12:
                words.append(w)
        docs[d] = words + [rng.choice(WORDS[:200]) for _ in range(rng.randrange(0, 60))]
    want = {(d, i) for d, words in docs.items() for i, item in items.items() if leakage.aligned(item, words, -len(item), len(words))[0] >= 20}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string").repartition(3)
    rows = leakage.leaked(df, spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert 100 < len(want) < 390 and got == want
    for r in rows:
        phrase = any(docs[r.doc_id][a : a + 20] == items[r.item_id][b : b + 20] for a in range(len(docs[r.doc_id])) for b in range(41))
        assert r.exact == phrase


def test_one_stored_index_serves_many_items(spark, tmp_path):
    rng = random.Random(2)
    docs = {d: rng.choices(WORDS, k=80) for d in range(60)}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()] + [(None, "x"), (99, None), (98, "")], "doc_id long, text string")
    index = leakage.index_corpus(df, str(tmp_path / "index"), 3)
    stored = index.read()
    have = Counter()
    for r in stored.where("term IS NOT NULL").collect():
        doc, at, _ = leakage.read_postings(r.postings)
        assert len(set(doc)) == r.documents
        have.update((r.segment, int(d), int(p), r.term) for d, p in zip(doc, at, strict=True))
    names = {r.segment: np.frombuffer(r.postings, "<i8") for r in stored.where("term IS NULL").collect()}
    assert sorted((int(names[s][d]), p, w) for s, d, p, w in have.elements()) == sorted((d, p, w) for d, x in docs.items() for p, w in enumerate(x))
    for least, k in ((20, 25), (12, 14)):
        items = spark.createDataFrame([(d, " ".join(w[10 : 10 + k])) for d, w in docs.items()], "item_id long, text string")
        got = sorted((r.doc_id, r.item_id) for r in leakage.leaked(df, items, least=least, index=index).collect())
        assert got == [(d, d) for d in range(60)]
    index.drop()


def test_neighbours_meet():
    code = lambda *c: np.array([((c[0] * 64 + c[1]) * 64 + c[2]) * 64 + c[3]])
    met = lambda x, y: leakage._meet(x, y)[0].size
    one = code(1, 2, 3, 4)
    assert [met(one, code(*c)) for c in ((1, 2, 9, 9), (9, 2, 3, 9), (9, 9, 3, 4), (1, 9, 3, 9), (1, 9, 9, 4), (9, 2, 9, 4), (1, 2, 3, 4))] == [1, 1, 1, 0, 0, 0, 1]
    assert met(code(63, 63, 3, 4), code(63, 63, 3, 5)) == 0 and met(code(63, 2, 3, 4), code(63, 2, 3, 63)) == 1


def test_positions_wrap(spark, monkeypatch):
    rng = random.Random(9)
    words = rng.choices(WORDS, k=900)
    monkeypatch.setattr(leakage, "WRAP", 120)
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    texts, edge, held, records = leakage.postings([" ".join(words)])
    assert leakage.read_postings(records.tobytes())[1].max() == 119 and sum(held) == len(texts) == edge.size - 1
    spans = leakage._spans([band + w // 6 for w in range(0, 901, 120) for band in [3]], 6)
    assert any(low <= 738 <= high for low, high in spans) and df.count() == 1


def test_shuffled_anchors_find_the_same(spark, monkeypatch):
    rng = random.Random(7)
    docs = [(d, " ".join(rng.choices(WORDS, k=60))) for d in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(d, t) for d, t in docs[:9]], "item_id long, text string")
    want = sorted(map(tuple, leakage.leaked(df, items).collect()))
    monkeypatch.setattr(leakage, "BROADCAST_ANCHORS", 0)
    monkeypatch.setattr(leakage, "BROADCAST_IDS", 0)
    assert len(want) == 9 and sorted(map(tuple, leakage.leaked(df, items).collect())) == want


def test_the_same_word_over_and_over(spark):
    df = spark.createDataFrame([(1, "tick " * 3000), (2, "tick tock " * 30)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "tick " * 50), (2, "tock tick " * 20)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in leakage.leaked(df, items).collect()) == [(1, 1), (2, 2)]


def test_nulls_repeats_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    text = " ".join(WORDS[:30])
    names = ["words", "item_id", "_asked", "bands", "passage", "term", "part", "postings", "segment", "doc", "head", "rest", "_head", "_n"]
    df = spark.createDataFrame([(1, text), (1, text), (2, None), (None, text), (3, ""), (4, "x " * 50_000 + text)], "doc_id long, text string").withColumns({n: F.lit(None).cast("string") for n in names})
    items = spark.createDataFrame([(7, text), (7, text), (8, None), (None, text), (9, " \n ")], "item_id long, text string").withColumns({n: F.lit("x") for n in names if n != "item_id"} | {"doc_id": F.lit(1)})
    assert sorted(map(tuple, leakage.leaked(df, items).collect())) == [(1, 7, 30, True), (1, 7, 30, True), (4, 7, 30, True)]
    assert leakage.leaked(df.where("false"), items.where("false")).columns == ["doc_id", "item_id", "words", "exact"]


def test_segments_by_size(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(leakage, "SEGMENT_CHARS", 10)
    monkeypatch.setattr(leakage, "MOST_DOCS", 3)
    texts = ["x" * 9, None, "y", "z", "x" * 40, "", "", "", "", "é" * 10]
    b = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts)], ["doc_id", "text"])
    got = [x.column(1).to_pylist() for x in leakage._segments(b)]
    assert sum(got, []) == texts and got == [["x" * 9, None, "y"], ["z"], ["x" * 40], ["", "", ""], ["", "é" * 10]]
    assert list(leakage._segments(b.slice(0, 0))) == []
