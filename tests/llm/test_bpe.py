import base64
import os
import random

import pytest

from roadgrain.llm import bpe

VOCAB = os.path.join(bpe.VOCAB_DIR, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(VOCAB, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "", " ", "\n\n  \t x", "Hello world's end", "<|endoftext|> is text", "naïve café — 12345 ½", "こんにちは世界。加速度計", "Привет, мир!", "👩‍👩‍👧‍👦🏳️‍🌈", "a\u0000b​c﻿", "'s't've'll", "x" * 5000, "ab" * 20000, " " * 3000,
]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_public_encoder(reference, text):
    e = bpe.load()
    ids = e.encode(text)
    assert ids == reference.encode_ordinary(text) and e.decode(ids).decode() == text


def test_random_long_pretokens(reference):
    rng = random.Random(5)
    e = bpe.load()
    for alphabet in ("ab", "abcdefghij", "éàü", "0123456789"):
        text = "".join(rng.choice(alphabet) for _ in range(20000))
        assert e.encode(text) == reference.encode_ordinary(text)


def test_rank_queue():
    q, rng = bpe.RankQueue(50257), random.Random(1)
    ranks = [rng.randrange(50257) for _ in range(3000)]
    for i, r in enumerate(ranks):
        q.push(r, i)
    out = []
    while (top := q.pop_bucket()) is not None:
        out += [top[0]] * len(top[1])
    assert out == sorted(ranks) and q.l2 == 0


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 10)
    e = bpe.ByteBPE(VOCAB)
    for i in range(100):
        e.encode(f"w{i}x y{i}z")
    assert len(e.memo) <= 10


def test_corpus(spark):
    d = spark.createDataFrame([(1, "a b", "x"), (2, "", "x"), (3, None, "x"), (4, "a b", "x"), (4, "a b", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.encode_corpus(d).collect())
    ab = bpe.load().encode("a b")
    assert got == [(1, ab), (2, []), (3, []), (4, ab), (4, ab)]
    assert bpe.encode_corpus(d, distinct=True).count() == 4 and bpe.encode_corpus(d.limit(0)).count() == 0
