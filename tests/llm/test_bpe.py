"""BPE encoding against the public libraries."""

import os

import pytest
from hypothesis import given, settings, strategies as st

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("tokenizers")

from kmerloom.llm import bpe  # noqa: E402
from kmerloom.llm.queries import BYTE_BPE  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.exists(BYTE_BPE), reason="no tokenizer files")

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def both():
    with open(BYTE_BPE, "rb") as f:
        ranks = bpe.load_ranks(f.read())
    return bpe.Encoder(ranks), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [" ", "  ", "\n", "\r\n", "\t", "a", "The", "é", "1", "½", "٣", "00:00:01", "00:00:01,123", ",123", ".5", "'s", "'", "’", "!", "\x1c", "\x85", "\xa0", "　", "日本", "😀", "﻿", "_", " -->", "<|endoftext|>"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=4)), max_size=12))
def test_same_as_library(both, parts):
    text = "".join(parts)
    text = bpe.clean(text)
    assert both[0].encode(text) == both[1].encode_ordinary(text)


def test_long_words(both, monkeypatch):
    """Beyond LONG_WORD a heap gives what the scan gives."""
    words = ["ab" * 2000, "x" * 5000, "the" * 100, "日本語" * 300, "aAbB" * 70]
    by_heap = [both[0].encode(w) for w in words]
    assert by_heap == [both[1].encode_ordinary(w) for w in words]
    monkeypatch.setattr(bpe, "LONG_WORD", 1 << 30)
    short = [w for w in words if len(w) < 1000]
    assert [bpe._merge_long(w.encode(), both[0].ranks) for w in short] == [bpe.merge_word(w.encode(), both[0].ranks) for w in short]


def test_round_trip(spark):
    texts = [None, "", " \r\n", "Na ja… 日本語 😀 ﻿x", "a" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    back = bpe.decode_corpus(bpe.encode_corpus(df, BYTE_BPE), BYTE_BPE)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_edges(both):
    assert both[0].encode(None) == both[0].encode("") == []
    assert both[0].encode("a\ud800b") == both[1].encode_ordinary("a�b")


def test_full_table_is_emptied(both, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_SIZE", 3)
    e = bpe.Encoder(both[0].ranks)
    text = "one two three four five six seven one two three"
    assert e.encode(text) == both[1].encode_ordinary(text) and len(e) <= 3 and len(e.words) <= 3


def test_corpus(spark, both):
    own = tokenizers.Tokenizer.from_file(BYTE_BPE.replace(".tiktoken", ".json"))
    own.encode_special_tokens = True
    texts = [None, "", " ", "a " * 50_000, "Hello, world! <|endoftext|>", "1\n00:00:01,000 --> 00:00:02,500\nNa ja.\n\n", "x"]
    df = spark.createDataFrame([(i if i else None, t, "clash", i) for i, t in enumerate(texts)] + [(6, "x", "clash", 1)], "doc_id bigint, text string, ids string, n_tokens int")
    want = [(i if i else None, own.encode(t, add_special_tokens=False).ids if t else []) for i, t in enumerate(texts)] + [(6, own.encode("x").ids)]
    key = lambda r: (r[0] or 0, r[1])
    got = [(r.doc_id, r.ids) for r in bpe.encode_corpus(df, BYTE_BPE).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    counts = [(r.doc_id, r.n_tokens) for r in bpe.count_corpus(df, BYTE_BPE).collect()]
    assert sorted(counts, key=key) == sorted([(i, len(x)) for i, x in want], key=key)
    assert bpe.encode_corpus(df.limit(0), BYTE_BPE).count() == 0
