"""Identify pages made of keywords, links or tags instead of sentences.

A text is cut into runs of lines that read as sentences, and runs of lines
that don't. A run of the second kind counts as stuffing if its compression
ratio lies far under what writing of its length and language has (extreme
redundancy), confirmed by its low density of sentences; or, since links, tags
and strings of separated terms needn't repeat themselves, if they make it up.
Of a run that as a whole doesn't count, blocks of fixed sizes are judged
alike, and likewise the blocks of a long line: expected ratios fall with the
length, but zlib's don't beyond its window. A page is stuffed if such runs and
blocks hold more than half of its characters.

What ratio writing has is fitted in each run (``fit_ratios``) on all sentences
of all documents: a power of the length, at a level for each language.

Two narrow passes over the texts in Arrow batches, one to fit and one to judge;
no shuffle of texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Frequent function words of the corpus's languages.
FUNCTION_WORDS = {
    "en": "a an the and or but of to in on at by with for from as is are was were be been it its this that these those each every our we you they he she not no did does do can must will would should than then once because since while whereas although unless until if why how what when near behind before after under over against across beyond within without despite inside around",
    "de": "der die das den dem des ein eine einer einem einen und oder aber in im an am auf zu zum zur von vom mit für bei nach vor über unter aus ist sind war wird werden nicht kein sich es er sie wir bis weil wenn dass als auch noch nur warum wie ohne jeden jeder",
    "fr": "le la les l un une des du de d et ou mais en dans sur sous par pour avec sans au aux est sont a ont ne que qui il elle ils nous vous se ce cette ces car tant chaque pourquoi comment après avant",
    "es": "el la los las un una unos unas de del al y o pero en con sin por para sobre que quien se es son no lo su sus este esta cada tras mientras porque cuando como",
}
_FUNCTION = frozenset(w for words in FUNCTION_WORDS.values() for w in words.split())

#: Prior of the compression ratio of ordinary writing, level * bytes ** slope, and the blocks of a language that weigh as much as it.
LEVEL, SLOPE, PRIOR_BLOCKS = 1.78, -0.165, 50.0
#: Characters of the blocks on which ratios are fitted, and bytes under which zlib's header lifts them off any power of the length: such blocks aren't fitted.
SIZES, LEAST_BYTES = (150, 400, 1000, 4000), 100
#: (level, slope) by language (two letters); "" for all others.
Ratios = dict[str, tuple[float, float]]
#: Part of that ratio under which a block is extremely redundant.
REDUNDANT = 0.70
#: Most characters of the blocks into which longer runs and lines are cut: zlib's window, and the end of the fitted range.
BLOCKS = (32_000, 4_000)
#: Sentences per word under which a block isn't made of sentences, and function words per word under which a line isn't one.
SENTENCES_PER_WORD = 0.02
FUNCTION_SHARE = 0.09
#: Part of the words or lines of a block that links, tags or separated terms must hold.
DOMINANT = 0.5

_LINK = re.compile(r"\[[^\[\]\n]*\]\([^()\s]*\)|<a\s[^<>]*>.*?</a>|(?:https?:|ftp:)?//[^\s<>()]+|\bwww\.[^\s<>()]+", re.I)
_TAG = re.compile(r"(?<![\w&])#[^\W\d]\w*")
_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile("[\\r\\n\\x85\\u2028\\u2029]+|<br\\s*/?>", re.I)
_END = re.compile(r"[.!?…。！？](?=\W*\s|\W*$)")
_SEPARATOR = re.compile(r"\s*[,;|/•·\n]\s*|\s{2,}")


def is_sentence_line(line: str) -> bool:
    """A line that says something: enough words, function words among them, and not carried by a link."""
    bare = line
    linked = ("//" in line or "www." in line or "](" in line or "<a" in line) and _LINK.search(line) is not None
    if linked:
        bare = _LINK.sub(" ", bare)
    if "#" in bare:
        bare = _TAG.sub(" ", bare)
    words = bare.lower().split()
    if len(words) < 4 or len(bare.strip()) < 0.5 * len(line):
        return False
    if linked and not _END.search(bare):
        return False
    function = sum(map(_FUNCTION.__contains__, words))
    return function >= FUNCTION_SHARE * len(words) and (function > 1 or _END.search(bare) is not None)


def language(lang: str | None) -> str:
    """Two lower-case letters of a language tag; "" for none and for what isn't one."""
    two = (lang or "").strip().lower()[:2]
    return two if len(two) == 2 and two.isascii() and two.isalpha() else ""


def compression(block: str, lang: str | None, ratios: Ratios | None = None) -> float:
    """Compression ratio of a block over that of ordinary writing of its length and language."""
    raw = block.encode()
    level, slope = (ratios or {}).get(language(lang)) or (ratios or {}).get("", (LEVEL, SLOPE))
    return len(zlib.compress(raw, 6)) / len(raw) / (level * max(len(raw), 60) ** slope)


def is_stuffing(lines: list[str], lang: str | None, ratios: Ratios | None = None) -> bool:
    """Whether a run of lines that aren't sentences is stuffing rather than headings, code or figures."""
    block = "\n".join(lines)
    if not block.strip():
        return False
    words = _WORD.findall(block)
    if not words:
        return bool(_LINK.search(block))
    if len(words) >= 6 and compression(block, lang, ratios) < REDUNDANT:
        distinct = len({w.lower() for w in words})
        if distinct > 1 or len(words) >= 20:
            return True
    # Not redundant, but no writing either: links, tags or separated terms that don't repeat themselves.
    linked = sum(bool(_LINK.search(x)) for x in lines)
    links = _LINK.findall(block)
    if len(links) >= 3 and (linked >= DOMINANT * len(lines) or sum(map(len, links)) >= DOMINANT * len(block)):
        return True
    tags = _TAG.findall(block)
    if len(tags) >= 5 and sum(map(len, tags)) >= DOMINANT * len(block):
        return True
    terms = [t for t in _SEPARATOR.split(block) if _WORD.search(t)]
    function = sum(w.lower() in _FUNCTION for w in words)
    return len(terms) >= 10 and len(words) / len(terms) <= 4 and function < FUNCTION_SHARE / 2 * len(words) and len(_END.findall(block)) < SENTENCES_PER_WORD * len(words)


def _cut(lines: list[str], most: int) -> list[list[str]]:
    """The lines in blocks of about equal size, at most ``most`` characters each; longer lines are cut, between words if there are any."""
    pieces: list[str] = []
    for line in lines:
        part, start = -(-len(line) // max(1, -(-len(line) // most))), 0
        while len(line) - start > most:
            at = line.rfind(" ", start + part // 2, start + part)
            end = at + 1 if at >= 0 else start + part
            pieces.append(line[start:end])
            start = end
        pieces.append(line[start:])
    total = sum(map(len, pieces))
    part = total / -(-total // most)
    blocks: list[list[str]] = [[]]
    size = 0
    for piece in filter(None, pieces):
        if blocks[-1] and (size + len(piece) > most or size >= part):
            blocks.append([])
            size = 0
        blocks[-1].append(piece)
        size += len(piece)
    return blocks


def _stuffed(lines: list[str], lang: str | None, ratios: Ratios | None, sizes: tuple[int, ...] = BLOCKS) -> int:
    """Characters of a run that lie in stuffing: all if the run as a whole is, else those of its blocks."""
    size = sum(map(len, lines))
    if is_stuffing(lines, lang, ratios):
        return size
    for k, most in enumerate(sizes):
        if size > most:
            return sum(_stuffed(block, lang, ratios, sizes[k + 1 :]) for block in _cut(lines, most))
    return 0


def _marked(line: str, lang: str | None, ratios: Ratios | None, sizes: tuple[int, ...] = BLOCKS) -> Iterator[tuple[str, bool]]:
    """A line, or the blocks of a long one, each with whether it reads as sentences and isn't redundant."""
    if not is_sentence_line(line) or _repeats(line, lang, ratios):
        yield line, False
        return
    for k, most in enumerate(sizes):
        if len(line) > most:
            for block in _cut([line], most):
                for piece in block:
                    yield from _marked(piece, lang, ratios, sizes[k + 1 :])
            return
    yield line, True


def stuffed_share(text: str | None, lang: str | None, ratios: Ratios | None = None) -> float:
    """Part of a text's characters that lies in stuffing; 0 for null and blank texts."""
    if not text or not text.strip():
        return 0.0
    total = bad = 0
    run: list[str] = []

    def close() -> int:
        size = _stuffed(run, lang, ratios) if run else 0
        run.clear()
        return size

    for line in _BREAK.split(_without_tags(text)):
        if not (bare := line.strip()):
            continue
        total += len(bare)
        for piece, sentences in _marked(bare, lang, ratios):
            if sentences:
                bad += close()
            else:
                run.append(piece)
    bad += close()
    return bad / total if total else 0.0


def _without_tags(text: str) -> str:
    """Without tags but for links, which are evidence."""
    return re.sub(r"</?(?!a[\s>]|br)[a-z][^<>]*>", " ", text, flags=re.I) if "<" in text else text


def _repeats(line: str, lang: str | None, ratios: Ratios | None) -> bool:
    """A line with function words that is redundant all the same: phrases stuffed with keywords."""
    return len(line) >= 200 and compression(line, lang, ratios) < REDUNDANT


def _sized(lines: list[str], least: int) -> list[list[str]]:
    """All of the lines in blocks of ``least`` characters or somewhat more; longer lines are cut, and what is left over joins the last block."""
    blocks: list[list[str]] = [[]]
    size = 0
    for line in lines:
        for piece in [line] if len(line) <= least else [x for block in _cut([line], least) for x in block]:
            if size >= least:
                blocks.append([])
                size = 0
            blocks[-1].append(piece)
            size += len(piece) + 1
    if size < least and len(blocks) > 1:
        blocks[-2:] = [blocks[-2] + blocks[-1]]
    return blocks


def writing_blocks(text: str | None) -> Iterator[tuple[float, float, float]]:
    """Weight, and logarithms of the bytes and of the compression ratio, of the blocks into which all of a text's sentences are cut at each size.

    The blocks of a size share a weight of 1, so that neither long texts nor short blocks decide alone.
    """
    lines = [x.strip() for x in _BREAK.split(_without_tags(text or ""))]
    lines = [x for x in lines if is_sentence_line(x)]
    known: dict[bytes, float] = {}  # a short text is the same block at several sizes
    for least in SIZES:
        raws = [raw for block in _sized(lines, least) if len(raw := "\n".join(block).encode()) >= LEAST_BYTES]
        known = {raw: known[raw] if raw in known else math.log(len(zlib.compress(raw, 6)) / len(raw)) for raw in raws}
        for raw in raws:
            yield 1 / len(raws), math.log(len(raw)), known[raw]


def fitted_ratios(sums: dict[str, tuple[float, float, float, float, float]]) -> Ratios:
    """Least squares from sums by language (n, x, y, xx, xy): one slope for all, a level for each language.

    Both are drawn to the prior, as by ``PRIOR_BLOCKS`` blocks that lie on its
    line: the slope to the prior's, a language's level to that of all ("").
    """
    everything = tuple(map(sum, zip(*sums.values(), strict=True))) if sums else (0.0,) * 5
    at = [math.log(size) for size in SIZES]
    mean = sum(at) / len(at)
    spread = PRIOR_BLOCKS / len(at) * sum((x - mean) ** 2 for x in at)
    within = [(xx - x * x / n, xy - x * y / n) for n, x, y, xx, xy in sums.values() if n]
    slope = (sum(b for _, b in within) + SLOPE * spread) / (sum(a for a, _ in within) + spread)
    level = lambda n, x, y, prior: (y - slope * x + PRIOR_BLOCKS * prior) / (n + PRIOR_BLOCKS)
    all_ = level(*everything[:3], math.log(LEVEL) + (SLOPE - slope) * mean)
    return {lang: (math.exp(level(n, x, y, all_)), slope) for lang, (n, x, y, _, _) in sums.items()} | {"": (math.exp(all_), slope)}


def fit_ratios(documents: DataFrame) -> Ratios:
    """Ratios fitted on all sentences of all documents (those with under ``LEAST_BYTES`` of them give no block); only sums by language reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[float]] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = sums.setdefault(language(lang), [0.0] * 5)
                for w, x, y in writing_blocks(text):
                    own[:] = (a + w * v for a, v in zip(own, (1.0, x, y, x * x, x * y), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array([v[i] for v in sums.values()], pa.float64()) for i in range(5))], ["lang", *"abcde"])

    totals = documents.select("text", "lang").mapInArrow(run, "lang string, a double, b double, c double, d double, e double").groupBy("lang").sum().collect()
    return fitted_ratios({r[0]: tuple(r[1:]) for r in sorted(totals)})


def shares(documents: DataFrame, *, id_column: str = "doc_id", ratios: Ratios | None = None) -> DataFrame:
    """``doc_id, share DOUBLE``: the stuffed part of each text. Null and blank texts have a share of 0.

    Without ``ratios`` those of the prior hold. Repeated rows are judged each;
    a null or unusable ``lang`` takes the ratio of all languages; other columns
    are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [stuffed_share(t, g, ratios) for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.float64())], [id_column, "share"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(id_column, "text", "lang").mapInArrow(run, f"`{id_column}` {kind}, share double")


def stuffed_documents(documents: DataFrame, *, share: float = 0.5, ratios: Ratios | None = None) -> DataFrame:
    """``doc_id`` of each document more than ``share`` of whose text is stuffing; without ``ratios`` they are fitted first."""
    ratios = fit_ratios(documents) if ratios is None else ratios
    return shares(documents, ratios=ratios).where(f"share > {share}").select("doc_id")
