"""Encode a corpus with a byte-level BPE vocabulary of ranks.

Pre-tokenisation uses no regular expression. A batch of texts becomes one
array of code points; a table maps each to a class; classes and a little
look-ahead become the symbols of a small automaton. The transition functions
of the symbols generate a finite monoid, whose multiplication table is built
once, so composing the functions of any stretch of text is an associative
lookup: blocks are reduced side by side, the block results are scanned, and
every block is replayed from its true entry state. That gives all token
boundaries of the batch in a few array operations.

The slices between boundaries are made unique per batch (slices up to 16 bytes
as pairs of integers, compared exactly); each distinct slice is merged once
and cached, and the ids are gathered back. Byte offsets of the ids are kept on
request, for decoding and alignment.
"""

from __future__ import annotations

import base64
import hashlib
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary files lie by default; they aren't part of this library.
VOCABULARY_DIR = "/opt/tokenizers"
#: Code points that are encoded together; bounds the memory of a task.
CHUNK = 1_000_000
#: Distinct slices that a worker remembers before it starts over.
CACHE_LIMIT = 500_000

LETTER, NUMBER, OTHER, SPACE_IN, BLANK_END, SPACE_END, APOS2, APOS3, RESET = range(9)
FRESH, IN_L, IN_N, IN_O, IN_W, LED, ONE_MORE, TWO_MORE = range(8)

_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """``step[symbol, state]`` -> next state; ``starts[symbol, state]``: a token begins here."""
    step, starts = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for state in range(8):
        step[LETTER, state] = {TWO_MORE: ONE_MORE, ONE_MORE: FRESH}.get(state, IN_L)
        starts[LETTER, state] = state not in (IN_L, LED, ONE_MORE, TWO_MORE)
        step[NUMBER, state], starts[NUMBER, state] = IN_N, state not in (IN_N, LED)
        step[OTHER, state], starts[OTHER, state] = IN_O, state not in (IN_O, LED)
        step[SPACE_IN, state], starts[SPACE_IN, state] = IN_W, state != IN_W
        step[SPACE_END, state] = LED
        step[BLANK_END, state] = FRESH
        inside = state in (IN_O, LED)
        for symbol, follow in ((APOS2, ONE_MORE), (APOS3, TWO_MORE)):
            step[symbol, state], starts[symbol, state] = (IN_O, False) if inside else (follow, True)
        step[RESET, state] = FRESH
    return step, starts


STEP, STARTS = _automaton()


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Element of each symbol, multiplication table (first, then second), and each element as a state map."""
    elements = [tuple(range(8))]
    index = {elements[0]: 0}
    todo = 0
    while todo < len(elements):
        for symbol in range(9):
            made = tuple(int(STEP[symbol, s]) for s in elements[todo])
            if made not in index:
                index[made] = len(elements)
                elements.append(made)
        todo += 1
    maps = np.array(elements, np.uint8)
    table = np.array([[index[tuple(int(b[s]) for s in a)] for b in elements] for a in elements], np.uint16)
    generators = np.array([index[tuple(int(x) for x in STEP[symbol])] for symbol in range(9)], np.uint16)
    return generators, table, maps


GENERATORS, PRODUCT, MAPS = _monoid()

_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of each code point (letter, number, white space as BLANK_END, other)."""
    global _CLASSES
    if _CLASSES is None:
        of = {"L": LETTER, "N": NUMBER}
        made = np.fromiter((of.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        made[_WHITE] = BLANK_END
        _CLASSES = made
    return _CLASSES


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbols of the automaton; ``first`` marks the first code point of each text."""
    kind = classes()[points]
    ends = np.append(first[1:], True)
    after = np.append(kind[1:], BLANK_END)
    white = kind == BLANK_END
    out = kind.copy()
    out[white & ((after == BLANK_END) | ends)] = SPACE_IN
    out[(points == 32) & (out == BLANK_END)] = SPACE_END
    at = np.flatnonzero(points == 39)
    if at.size:
        n = points.size
        room1 = (at + 1 < n) & ~ends[at]
        c1 = np.where(room1, points[np.minimum(at + 1, n - 1)], 0)
        room2 = room1 & (at + 2 < n) & ~ends[np.minimum(at + 1, n - 1)]
        c2 = np.where(room2, points[np.minimum(at + 2, n - 1)], 0)
        is_ = lambda c, letters: np.isin(c, [ord(x) for x in letters])
        out[at[is_(c1, "stmd")]] = APOS2
        out[at[(is_(c1, "rv") & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))]] = APOS3
    return out


def boundaries(points: np.ndarray, first: np.ndarray, block: int = 512) -> np.ndarray:
    """True where a pre-token begins, for texts laid end to end."""
    n = points.size
    if not n:
        return np.zeros(0, bool)
    symbol = symbols(points, first)
    element = GENERATORS[symbol]
    begin = np.flatnonzero(first)
    element[begin] = PRODUCT[GENERATORS[RESET], element[begin]]  # a text begins afresh
    width = -(-n // block)
    grid = np.zeros(width * block, np.uint16)
    grid[:n] = element
    grid = np.ascontiguousarray(grid.reshape(width, block).T)
    total = grid[0].copy()
    for row in grid[1:]:
        total = PRODUCT[total, row]
    shift = 1  # inclusive scan over the blocks by doubling
    while shift < width:
        total = np.concatenate([total[:shift], PRODUCT[total[:-shift], total[shift:]]])
        shift *= 2
    state = np.full(width, FRESH, np.uint8)
    state[1:] = MAPS[total[:-1], FRESH]
    before = np.empty((block, width), np.uint8)
    for i, row in enumerate(grid):
        before[i] = state
        state = MAPS[row, state]
    entry = before.T.reshape(-1)[:n]
    return STARTS[symbol, entry] | first


class Encoder:
    """Byte-pair merging by rank over pre-token slices, with a cache of slices."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.cache: dict[bytes, list[int]] = {}
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.beyond = max(self.bytes_of, default=0) + 1

    def merge(self, word: bytes) -> list[int]:
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        parts = [word[i : i + 1] for i in range(len(word))]
        if len(parts) > 64:
            return self._merge_long(parts)
        none = self.beyond
        get = ranks.get
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        """As ``merge``, by a heap over a linked list: n log n for very long slices."""
        import heapq

        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        alive: list[bytes | None] = list(parts)
        heap: list[tuple[int, int, bytes, bytes]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (r := self.ranks.get(alive[i] + alive[j])) is not None:
                heapq.heappush(heap, (r, i, alive[i], alive[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if alive[i] is not None else -1
            if j < 0 or alive[i] != a or alive[j] != b:
                continue
            alive[i], alive[j] = a + b, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [self.ranks[p] for p in alive if p is not None]

    def slice_ids(self, word: bytes) -> list[int]:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) >= CACHE_LIMIT:
                self.cache.clear()
            got = self.merge(word)
            if len(word) <= 64:
                self.cache[word] = got
        return got

    def encode(self, texts: list[bytes], with_offsets: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts end to end, the end of each text in them, and the byte offset of each id in its text (or nothing)."""
        ids, offsets, ends, done = [], [], [], 0
        group: list[bytes] = []
        size = 0
        for i, text in enumerate(texts):
            group.append(text)
            size += len(text)
            if size >= CHUNK or i == len(texts) - 1:
                a, b, c = self._encode_chunk(group, with_offsets)
                ids.append(a)
                ends.append(b + done)
                offsets.append(c)
                done += a.size
                group, size = [], 0
        if not ids:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate(ids), np.concatenate(ends), np.concatenate(offsets)

    def _encode_chunk(self, texts: list[bytes], with_offsets: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        text_end = np.cumsum(lengths)
        text_start = text_end - lengths
        joined = b"".join(texts)
        n = len(joined)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), np.zeros(0, np.int32)
        raw = np.frombuffer(joined, np.uint8)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)  # byte position of each code point
        points = np.frombuffer(joined.decode("utf-8").encode("utf-32-le"), np.uint32)
        head = np.zeros(n + 1, bool)
        head[text_start[lengths > 0]] = True
        begin = lead[boundaries(points, head[lead])]
        size = np.diff(np.append(begin, n))
        short = size <= 16
        padded = np.concatenate([raw, np.zeros(16, np.uint8)])
        words = np.lib.stride_tricks.as_strided(padded, (n + 1, 16), (1, 1))
        code = np.empty(begin.size, np.int64)
        distinct: list[bytes] = []
        if short.any():
            b, k = begin[short], size[short]
            pair = np.ascontiguousarray(words[b]).view(np.uint64)
            mask = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)
            low = pair[:, 0] & mask[np.minimum(k, 8)]
            high = pair[:, 1] & mask[np.maximum(k - 8, 0)]
            key = low * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
            key = (key + high) * np.uint64(0xBF58476D1CE4E5B9) ^ k.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
            key ^= key >> np.uint64(32)
            code_short, unique = pd.factorize(key)
            at = np.empty(unique.size, np.int64)
            at[code_short[::-1]] = np.arange(code_short.size)[::-1]
            clash = (low != low[at[code_short]]) | (high != high[at[code_short]]) | (k != k[at[code_short]])
            distinct = [joined[s : s + w] for s, w in zip(b[at].tolist(), k[at].tolist(), strict=True)]
            code[short] = code_short
            if clash.any():  # different slices with one hash: looked up one by one
                where = np.flatnonzero(short)[clash]
                short[where] = False
        place: dict[bytes, int] = {}
        for i in np.flatnonzero(~short).tolist():
            w = joined[begin[i] : begin[i] + size[i]]
            j = place.get(w)
            if j is None:
                j = place[w] = len(distinct)
                distinct.append(w)
            code[i] = j
        lists = [self.slice_ids(w) for w in distinct]
        many = np.fromiter((len(x) for x in lists), np.int64, len(lists))
        flat = np.fromiter((i for x in lists for i in x), np.int32, int(many.sum()))
        base = np.cumsum(many) - many
        count = many[code]
        stop = np.cumsum(count)
        place_of = np.arange(int(stop[-1])) + np.repeat(base[code] - (stop - count), count)
        ids = flat[place_of]
        slices = np.searchsorted(begin, text_end, side="left")
        ends = np.concatenate([[0], stop])[slices]
        if not with_offsets:
            return ids, ends, np.zeros(0, np.int32)
        # Byte offsets: the slice's start plus the bytes of the ids before it in the slice.
        width = self.widths[flat]
        before = np.cumsum(width) - width
        within = before - np.repeat(before[np.minimum(base, max(flat.size - 1, 0))], many)
        owner = np.searchsorted(text_end, begin, side="right")
        local = begin - text_start[owner]
        offsets = (np.repeat(local, count) + within[place_of]).astype(np.int32)
        return ids, ends, offsets

    @property
    def widths(self) -> np.ndarray:
        if not hasattr(self, "_widths"):
            made = np.zeros(max(self.bytes_of, default=0) + 1, np.int64)
            for i, b in self.bytes_of.items():
                made[i] = len(b)
            self._widths = made
        return self._widths

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.bytes_of[i] for i in ids)


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: lines of base64 bytes and a number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


_ENCODERS: dict[str, Encoder] = {}


def encoder(raw: bytes) -> Encoder:
    """The encoder of a vocabulary, one per process."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(read_ranks(raw))
    return _ENCODERS[key]


def encode_texts(documents: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", *, id_column: str = "doc_id", text_column: str = "text", with_offsets: bool = False, directory: str = VOCABULARY_DIR) -> DataFrame:
    """``id_column, ids ARRAY<INT>`` of each row, with ``offsets ARRAY<INT>`` (bytes) on request.

    Null and empty texts give an empty list; white space is encoded as it
    stands; the strings of special tokens are ordinary text. Rows stay where
    they are: one narrow pass, no shuffle. The vocabulary (about 1 MB, of
    fixed size) is read by the driver and broadcast. A null id passes through, repeated rows are encoded
    each, other columns are not read, an empty table gives an empty result.
    """
    with open(os.path.join(directory, vocabulary), "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
            ids, ends, offsets = own.encode(texts, with_offsets)
            starts = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            columns = [batch.column(0), pa.ListArray.from_arrays(starts, pa.array(ids))]
            names = [id_column, "ids"]
            if with_offsets:
                columns.append(pa.ListArray.from_arrays(starts, pa.array(offsets)))
                names.append("offsets")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = documents.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, ids array<int>" + ", offsets array<int>" * with_offsets
    return documents.select(id_column, text_column).mapInArrow(run, schema)
