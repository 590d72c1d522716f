import os
import random
import re

import numpy as np
import pytest

tokenizer = pytest.importorskip("loomfeed.llm.tokenizer")
VOCABULARY = os.path.join(tokenizer.VOCABULARY_DIR, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")

ODD = [
    "", " ", "   ", "\n\n \t", "it's they'd we've I'll 's 're  're\n's''s '", "  a  b\n\n c \n", "<|endoftext|> hi", "don''t 'S 'LL", "½ ² ⅷ １２", "日本語テキスト 𝕏𝕐", "\x1c\x1d a\x1e", "x" * 3000,
    "ab" * 2000 + " " * 70 + "z", "\xa0  a", "'", "a'", "'ve", " 've", "\n've", "é'sé", "👩‍🔬🚀", "\x00\x00 a",
]


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, "rb") as f:
        return tokenizer.encoder(f.read())


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(tokenizer.VOCABULARY_DIR, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def split(ids, ends):
    return [x.tolist() for x in np.split(ids, ends[:-1])]


def noise(n, seed=1):
    rng = random.Random(seed)
    alphabet = "ab  \n\t'sdmtlrve019.,!?é日½\xa0 -#"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_equals_the_library_and_round_trips(encoder, library):
    texts = ODD + noise(3000)
    ids, ends, offsets = encoder.encode([t.encode() for t in texts])
    for text, mine, places, theirs in zip(texts, split(ids, ends), split(offsets, ends), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine == theirs.ids, text
        assert encoder.decode(mine) == text.encode()
        assert places == np.cumsum([0, *(len(encoder.bytes_of[i]) for i in mine)])[:-1].tolist()


def test_scan_equals_the_pattern():
    regex = pytest.importorskip("regex")
    pattern = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
    for block in (1, 3, 512):
        texts = [t for t in noise(800, block) if t and not re.search("[\x1c-\x1f]", t)]
        points = np.concatenate([np.array([ord(c) for c in t], np.uint32) for t in texts])
        first = np.zeros(points.size, bool)
        starts = np.cumsum([0, *(len(t) for t in texts)])
        first[starts[:-1]] = True
        want = [s + m.start() for s, t in zip(starts, texts, strict=False) for m in pattern.finditer(t)]
        assert np.flatnonzero(tokenizer.boundaries(points, first, block)).tolist() == want


def test_composition_is_associative():
    n = len(tokenizer.MAPS)
    p = tokenizer.PRODUCT
    for a in range(n):
        for b in range(n):
            assert (tokenizer.MAPS[p[a, b]] == tokenizer.MAPS[b][tokenizer.MAPS[a]]).all()
            assert all(p[p[a, b], c] == p[a, p[b, c]] for c in range(n))


def test_long_slices_merge_alike(encoder):
    for word in (b"abc" * 40, b"zzzzz" * 30, "ünï".encode() * 33):
        parts = [word[i : i + 1] for i in range(len(word))]
        short = tokenizer.Encoder(encoder.ranks)
        assert encoder.merge(word) == short._merge_long(parts)


def test_frame(spark, encoder):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "hello world", "z"), (2, " \n", "w")], "doc_id long, text string, ids string")
    rows = [(r.doc_id, list(r.ids), list(r.offsets)) for r in tokenizer.encode_texts(df, with_offsets=True).collect()]
    assert rows[0] == (1, [], []) and rows[1] == (2, [], []) and encoder.decode(rows[2][1]) == b"hello world" and encoder.decode(rows[3][1]) == b" \n"
    assert tokenizer.encode_texts(df.limit(0)).count() == 0
