"""Find held-out test passages, whole or in part, inside a training corpus.

A positional inverted index is stored once per corpus, and any number of test
items is searched in it with one pass:

1. ``index_corpus`` writes the postings of every token: one row per term and
   segment (an Arrow batch of documents), with the documents, the positions
   and six bits for each of the two words before and after. Rows are bucketed
   by term and by a part of the segments, so that the lists of a frequent term
   lie in many buckets.
2. The rarest of every three successive terms of an item is an anchor. The
   anchors are joined to the postings of their terms. A posting counts if it
   stands in three words that agree, by its neighbours; adjusted by its offset
   in the item, it lies on a diagonal of document and item.
3. A document and an item with four anchors in a band of diagonals are a
   candidate. Any chain of agreeing stretches that is long enough has four in
   one band (``least_anchors``, ``drift``), so nothing is lost here.
4. The candidates' documents alone are read again, and aligned word by word:
   stretches of agreeing words, with the odd word changed, added or left out
   between them, are chained; the longest chain counts.
"""

from __future__ import annotations

import html
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Bucketed, checkpoint, scratch, shuffle_width

#: Successive terms of an item of which the rarest is an anchor: the shortest agreeing stretch.
STRETCH = 3
#: Words that may differ between two agreeing stretches.
GAP = 2
#: Parts of the segments over which the lists of one term are dealt.
PARTS = 16
#: Anchors (one row each) up to which they are broadcast to the index; beyond it they are shuffled to its buckets.
BROADCAST_ANCHORS = 1_000_000

_TAGS = re.compile(r"<[^<>]*>")
_HYPHEN = re.compile(r"(?<=\w)-[^\S\r\n]*(?:\r\n?|\n)\s*(?=\w)")
#: Letters and digits, with apostrophes inside words and separators inside numbers.
_WORD = re.compile(r"[^\W_]+(?:['’ʼ][^\W_]+|(?<=\d)[.,]\d+)*")
_INNER = str.maketrans("", "", "'’ʼ.,")

#: Candidate documents up to which their ids are broadcast to the texts.
BROADCAST_IDS = 1_000_000
#: Bands of diagonals that are aligned at once; the next ones overlap them.
SPAN = 64

#: ``postings`` has eight bytes for each: documents since the last (2), position (3), neighbours (4 times six bits). The
#: row of a segment without a term has its document ids (8 bytes each) in place of postings.
INDEX = "term string, part int, segment long, documents int, postings binary"
RECORD, WRAP, NONE, MOST_DOCS = 8, 1 << 24, 63, 1 << 16
#: Characters of the texts that are inverted together, so that long texts don't fill a task's memory; a longer text is alone.
SEGMENT_CHARS = 1 << 24


def words_of(text: str | None) -> list[str]:
    """Words of a text without letter case, punctuation, spacing, line breaks and markup; none for null."""
    if not text:
        return []
    if "<" in text:
        text = _TAGS.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "\xad" in text:
        text = text.replace("\xad", "")
    if "-" in text and ("\n" in text or "\r" in text):
        text = _HYPHEN.sub("", text)
    return [w if w.isalnum() else w.translate(_INNER) for w in _WORD.findall(text.casefold())]


def least_anchors(least: int) -> int:
    """Anchors that every chain of ``least`` words has at least.

    A stretch of n words (three at least) holds the anchors of n // 3 disjoint
    spans; k stretches with gaps of two between them have least - 2 (k - 1)
    words or more. The least over all k and all ways to share the words.
    """
    best = None
    for k in range(1, least + 1):
        words = max(STRETCH * k, least - GAP * (k - 1))
        spare = words - STRETCH * k  # words beyond three a stretch; two of them in each stretch make no further anchor
        n = k + max(0, spare - (STRETCH - 1) * k + STRETCH - 1) // STRETCH
        best = n if best is None else min(best, n)
    return best or 1


def drift(least: int) -> int:
    """Diagonals over which the anchors that must be there are spread at most.

    Each gap shifts by two at most. A chain of fewer stretches than
    ``least_anchors`` has all its anchors within fewer gaps than that; of a
    longer one, the first so many stretches have an anchor each.
    """
    return GAP * (least_anchors(least) - 1)


def _code(word: str) -> int:
    """Six bits of a word; one value is kept for "no word"."""
    return zlib.crc32(word.encode()) % NONE


def _neighbours(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The codes of the two words before and the two after each word of texts laid end to end, as one number."""
    total = codes.size
    text = np.repeat(np.arange(size.size), size)
    low, high = start[text], (start + size)[text]
    at = np.arange(total)
    out = np.zeros(total, np.int64)
    for shift in (-2, -1, 1, 2):
        there = at + shift
        inside = (there >= low) & (there < high)
        out = out * 64 + np.where(inside, codes[np.clip(there, 0, max(total - 1, 0))] if total else 0, NONE)
    return out


def postings(texts: Sequence[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The inverted lists of some texts: terms, where the list of each begins (and the last ends), in how many texts each is, and the records."""
    number: dict[str, int] = {}
    flat: list[int] = []
    sizes = []
    for text in texts:
        words = words_of(text)
        sizes.append(len(words))
        flat += [number.setdefault(w, len(number)) for w in words]
    terms, size = np.array(flat, np.int64), np.array(sizes, np.int64)
    start = np.cumsum(size) - size
    codes = np.array([_code(w) for w in number], np.int64)
    around = _neighbours(codes[terms], start, size)
    doc = np.repeat(np.arange(size.size), size)
    at = (np.arange(terms.size) - np.repeat(start, size)) % WRAP
    order = np.argsort(terms, kind="stable")
    edge = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(number)))])
    doc, at, around = doc[order], at[order], around[order]
    since = doc.copy()
    since[1:] -= doc[:-1]
    since[edge[:-1]] = doc[edge[:-1]]
    fresh = since > 0
    fresh[edge[:-1]] = True
    records = np.empty((terms.size, RECORD), np.uint8)
    records[:, :2] = since.astype("<u2").view(np.uint8).reshape(-1, 2)
    records[:, 2:5] = at.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    records[:, 5:] = around.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return list(number), edge, np.add.reduceat(fresh.astype(np.int32), edge[:-1]) if len(number) else np.zeros(0, np.int32), records


def _segments(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of successive rows with at most ``SEGMENT_CHARS`` characters and ``MOST_DOCS`` rows, one row at least."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    first = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and (total + size > SEGMENT_CHARS or i - first >= MOST_DOCS):
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += size
    if batch.num_rows:
        yield batch.slice(first)


def read_postings(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents (by their place in the segment), positions and neighbours of a list."""
    records = np.frombuffer(data, np.uint8).reshape(-1, RECORD).astype(np.int64)
    whole = lambda k, n: sum(records[:, k + i] << (8 * i) for i in range(n))
    return np.cumsum(whole(0, 2)), whole(2, 3), whole(5, 3)


def index_corpus(documents: DataFrame, path: str, buckets: int | None = None) -> Bucketed:
    """Write the positional index of ``documents`` (``doc_id``, ``text``) to ``path``, bucketed by term and part.

    Every token of every text is posted. Null ids have no postings; texts
    under one id are found under it. More documents can be appended by
    another call.
    """
    spark = documents.sparkSession
    base = uuid.uuid4().int & ((1 << 22) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        number = 0
        for whole in batches:
            for b in _segments(whole):
                segment = base << 41 | part << 20 | number
                terms, edge, held, records = postings(b.column(1).to_pylist())
                n = len(terms)
                offsets = pa.array(edge * RECORD, pa.int32()) if edge[-1] * RECORD < 1 << 31 else None
                if offsets is None:
                    lists = pa.array([records[edge[i] : edge[i + 1]].tobytes() for i in range(n)], pa.binary())
                else:
                    lists = pa.Array.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], pa.py_buffer(records)])
                ids = b.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
                row = lambda terms, held, lists: pa.RecordBatch.from_arrays(
                    [pa.array(terms, pa.string()), *(pa.array(np.full(len(terms), x, k)) for x, k in (((part + number) % PARTS, np.int32), (segment, np.int64))), pa.array(held, pa.int32()), lists],  # noqa: B023
                    ["term", "part", "segment", "documents", "postings"],
                )
                yield row([None], [b.num_rows], pa.array([ids], pa.binary()))
                yield row(terms, held, lists)
                number += 1

    index = Bucketed(spark, path, ["term", "part"], buckets or shuffle_width(spark))
    index.append(documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX), compression="zstd")
    return index


def passages(items: DataFrame) -> DataFrame:
    """``passage, item_id, words``: the words of each differing text of an item, without an instruction line.

    A first line is an instruction if the items of several other passages open
    with it too; a line that one item alone has is passage. ``passage`` is a
    hash of item and text. Null ids and texts without words have no row.
    """
    texts = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, rests = [], []
            for text in b.column(1).to_pylist():
                head, _, rest = text.strip().partition("\n")
                rest = words_of(rest)
                heads.append(words_of(head) if rest else [])
                rests.append(rest or words_of(text))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(heads, pa.list_(pa.string())), pa.array(rests, pa.list_(pa.string()))], ["item_id", "passage", "head", "rest"])

    made = checkpoint(texts.select("item_id", "text", F.xxhash64("item_id", "text").alias("passage")).mapInArrow(run, "item_id long, passage long, head array<string>, rest array<string>"))
    key = F.array_join("head", " ")
    shared = made.where(F.size("head") > 0).groupBy(key.alias("_head")).agg(F.count_distinct("rest").alias("_n")).where("_n > 1")
    words = F.when(F.col("_n").isNull(), F.concat("head", "rest")).otherwise(F.col("rest"))
    return made.join(shared, key == F.col("_head"), "left").select("passage", "item_id", words.alias("words")).where(F.size("words") > 0)


def anchors(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """``term, passage, place, neighbours``: the rarest of every three successive words of each passage, with its neighbours' codes."""
    at = wanted.select("passage", F.size("words").alias("_n"), F.posexplode("words").alias("place", "term"))
    terms = at.select("term").distinct()
    frequency = index.where("term IS NOT NULL").select("term", "documents").join(terms, "term", "left_semi").groupBy("term").agg(F.sum("documents").alias("_df"))
    known = at.join(frequency, "term", "left").withColumn("_df", F.coalesce("_df", F.lit(0)))
    one = Window.partitionBy("passage").orderBy("place")
    code = lambda c: F.coalesce(F.crc32(c.cast("binary")) % NONE, F.lit(NONE))
    around = [code(f("term", n).over(one)) for f, n in ((F.lag, 2), (F.lag, 1), (F.lead, 1), (F.lead, 2))]
    each = known.withColumns({
        "_least": F.min(F.struct("_df", "place")).over(one.rowsBetween(0, STRETCH - 1)),
        "neighbours": reduce(lambda x, c: x * 64 + c, around).cast("int"),
    })
    chosen = each.where(F.col("place") <= F.greatest(F.col("_n") - STRETCH, F.lit(0))).select("passage", F.col("_least.place").alias("place")).distinct()
    return each.join(chosen, ["passage", "place"], "left_semi").where("_df > 0").select("term", "passage", "place", "neighbours")


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings against the spots of their term's anchors: which stand in three words that agree, as document, passage, place and diagonal."""
    for b in batches:
        segment = b.column(0).to_numpy(zero_copy_only=False)
        lists, spots = b.column(1), b.column(2)
        out: list[tuple[np.ndarray, ...]] = []
        for i in range(b.num_rows):
            doc, at, around = read_postings(lists[i].as_py())
            passage, place, wanted = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in spots.slice(i, 1).flatten().flatten())
            one, two = _meet(around, wanted)
            if one.size:
                out.append((np.full(one.size, segment[i]), doc[one], passage[two], place[two], at[one] - place[two]))
        if out:
            columns = [np.concatenate(x) for x in zip(*out, strict=True)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["segment", "doc", "passage", "place", "diagonal"])


def _meet(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all pairs of neighbour numbers that agree in the two words before, the two after, or one of each."""
    found = []
    for first in (12, 6, 0):  # bits of the lower of two neighbouring codes
        x, y = a >> first & 0xFFF, b >> first & 0xFFF
        real = (x >> 6 != NONE) & (x & 63 != NONE)
        order = np.argsort(y, kind="stable")
        low, high = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
        n = np.where(real, high - low, 0)
        one = np.repeat(np.arange(a.size), n)
        if one.size:
            found.append(one * b.size + order[np.repeat(low, n) + np.arange(one.size) - np.repeat(np.cumsum(n) - n, n)])
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both // max(b.size, 1), both % max(b.size, 1)


def _banded(batches: Iterator[pa.RecordBatch], need: int, width: int) -> Iterator[pa.RecordBatch]:
    """Of each document and passage, the bands (twice ``width`` wide, at its multiples) with at least ``need`` anchors; rows without one are left out."""
    for b in batches:
        hits = b.column(3)
        row = np.repeat(np.arange(b.num_rows), hits.value_lengths().to_numpy(zero_copy_only=False))
        place, diagonal = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in hits.flatten().flatten())
        band = diagonal // width
        once = np.unique(np.stack([np.tile(row, 2), np.concatenate([band, band - 1]), np.tile(place, 2)]), axis=1)
        keys, n = np.unique(once[:2], axis=1, return_counts=True)
        keys = keys[:, n >= need]
        rows, first = np.unique(keys[0], return_index=True)
        edge = pa.array([*first, keys.shape[1]], pa.int32())
        made = pa.ListArray.from_arrays(edge, pa.array(keys[1].astype(np.int32)))
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(3)), made], ["segment", "doc", "passage", "bands"])


def candidates(wanted: DataFrame, index: DataFrame, least: int) -> DataFrame:
    """``doc_id, passage, bands``: documents and passages with enough anchors in one band of diagonals."""
    found = checkpoint(anchors(wanted, index))
    spots = found.groupBy("term").agg(F.collect_list(F.struct("passage", "place", "neighbours")).alias("spots"))  # bounded by the held-out set
    lists = index.where("term IS NOT NULL")
    if found.count() <= BROADCAST_ANCHORS:
        joined = lists.join(F.broadcast(spots), "term")
    else:
        joined = lists.join(spots.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["term", "part"])
    hits = joined.select("segment", "postings", "spots").mapInArrow(_agreeing, "segment long, doc int, passage long, place int, diagonal int")
    # A group is a text's hits of one passage: no longer than the text.
    grouped = hits.groupBy("segment", "doc", "passage").agg(F.collect_list(F.struct("place", "diagonal")).alias("hits")).where(F.size("hits") >= least_anchors(least))
    need, width = least_anchors(least), max(1, drift(least))
    close = checkpoint(grouped.mapInArrow(lambda b: _banded(b, need, width), "segment long, doc int, passage long, bands array<int>"))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed = [np.frombuffer(x, "<i8") for x in b.column(1).to_pylist()]
            sizes = [x.size for x in listed]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), sizes)), pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])), pa.array(np.concatenate(listed))], ["segment", "doc", "doc_id"]
            )

    named = index.where("term IS NULL").select("segment", "postings").mapInArrow(ids, "segment long, doc int, doc_id long")
    bands = close.join(named, ["segment", "doc"]).groupBy("doc_id", "passage").agg(F.array_distinct(F.flatten(F.collect_list("bands"))).alias("bands"))
    return bands


def aligned(item: Sequence[str], document: Sequence[str], low: int, high: int) -> tuple[int, int]:
    """Words of the item in the longest chain, and in the longest single stretch, on diagonals from ``low`` to ``high``.

    A chain is a row of stretches of at least three agreeing words, between
    which at most two words of either side stand.
    """
    first, last = max(0, low), min(len(document), high + len(item))
    if first >= last:
        return 0, 0
    number = {w: i for i, w in enumerate(dict.fromkeys(item))}
    a = np.array([number[w] for w in item])
    b = np.array([number.get(w, -1) for w in document[first:last]])
    same = np.zeros((a.size + 1, b.size + 1), np.int32)
    equal = a[:, None] == b[None, :]
    runs = []
    for i in range(a.size):
        row = np.where(equal[i], same[i, :-1] + 1, 0)
        same[i + 1, 1:] = row
    ends = same.copy()
    ends[:-1, :-1][same[1:, 1:] > 0] = 0
    for i, j in zip(*np.nonzero(ends >= STRETCH), strict=True):
        n = int(same[i, j])
        if low <= first + (j - n) - (i - n) <= high:
            runs.append((int(i) - n, int(j) - n, n))
    if not runs:
        return 0, 0
    x, y, n = np.array(sorted(runs)).T
    begun = x.copy()
    for k in range(1, x.size):
        u, v, w = x[:k] + n[:k], y[:k] + n[:k], begun[:k]  # ends of the earlier stretches, and where their chains begin
        cut = np.maximum(np.maximum(x[k], u), x[k] + v - y[k])  # where this stretch may begin, if an earlier overlaps it
        good = (x[k] + n[k] - cut >= STRETCH) & (cut - u <= GAP) & (cut + (y[k] - x[k]) - v <= GAP)
        if good.any():
            begun[k] = min(begun[k], w[good].min())
    return int((x + n - begun).max()), int(n.max())


def leaked(documents: DataFrame, items: DataFrame, *, least: int = 20, index: Bucketed | None = None) -> DataFrame:
    """``doc_id, item_id, words, exact``: each document with at least ``least`` successive words of an item's passage.

    ``words`` counts the words of the longest match, in which the odd word may
    differ; ``exact`` tells whether it holds a phrase of ``least`` equal words.
    Without an ``index`` (of ``index_corpus``, over the same documents) one is
    written below the shared folder and removed when it was searched.

    Passages shorter than ``least`` words can't be found. Null and blank texts
    hold nothing and null ids name nothing; rows repeated under one id give a
    row each. Items repeated under one id are searched each, and count as one
    item with the most words that any of them finds. Other columns are not
    read. Empty tables give an empty result.
    """
    spark = documents.sparkSession
    wanted = checkpoint(passages(items).where(F.size("words") >= least))
    own = index is None
    index = index_corpus(documents, scratch(spark, "postings")) if index is None else index
    pairs = checkpoint(candidates(wanted, index.read(), least))
    if own:
        index.drop()
    asked = pairs.join(wanted, "passage").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "words", "bands")).alias("_asked"))
    texts = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    ids = pairs.select("doc_id").distinct()
    if ids.count() <= BROADCAST_IDS:  # else texts that aren't candidates would be shuffled too
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    texts = texts.join(asked, "doc_id")
    width = max(1, drift(least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, int, int, bool]] = []
            for doc_id, text, asked in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = words_of(text)
                most: defaultdict[int, tuple[int, int]] = defaultdict(lambda: (0, 0))
                for x in asked:
                    wraps = range(0, len(words) + 1, WRAP)  # positions in the index are remainders
                    for low, high in _spans([band + w // width for w in wraps for band in x["bands"]], width):
                        got = aligned(x["words"], words, low, high)
                        most[x["item_id"]] = tuple(map(max, most[x["item_id"]], got))
                rows += [(doc_id, i, n, s >= least) for i, (n, s) in most.items() if n >= least]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.bool_()))], ["doc_id", "item_id", "words", "exact"])

    return texts.mapInArrow(run, "doc_id long, item_id long, words int, exact boolean")


def _spans(bands: Sequence[int], width: int) -> list[tuple[int, int]]:
    """Ranges of diagonals that cover the bands and some more; joined where they touch, up to ``SPAN`` bands."""
    out: list[tuple[int, int]] = []
    for band in sorted(bands):
        low, high = (band - 1) * width, (band + 3) * width
        if out and low <= out[-1][1] and high - out[-1][0] <= SPAN * width:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out
