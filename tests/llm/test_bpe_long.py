"""Long unbroken pieces: lanes, small tables, and the time they take."""

import random
import time

import numpy as np
import pytest

from rowloom.llm import bpe

from .test_bpe import both, encoded, tokenizers  # noqa: F401


def long_texts(n):
    rng = random.Random(n)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    han = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n // 3))
    return [letters, han, "a" * n, "=" * (n - 1), "abc" * (n // 3), " " * n + "x", ("abcdefghij" * n)[:n] + letters[: n // 4], "ha" * (n // 2) + "é" * (n // 7), letters[:300] + " " + letters[:255] + " " + letters[:256] + " " + letters[:257]]


@pytest.mark.parametrize("slots", [64, 2048, bpe.SLOTS])
def test_long_pieces_as_the_public_encoder(both, slots):  # noqa: F811
    codec, public = both
    own = bpe.Codec(codec.transducer.ranks, slots)
    texts = long_texts(3000 if slots == 64 else 20_000)
    assert encoded(own, texts) == [public.encode_ordinary(t) for t in texts]
    assert own.transducer.filled <= slots


@pytest.mark.parametrize("lane", [1, 2, 7, 64])
def test_lanes_of_any_length(both, lane, monkeypatch):  # noqa: F811
    codec, public = both
    monkeypatch.setattr(bpe, "LANE", lane)
    texts = [t[:700] for t in long_texts(900)] + ["aaaa", "", "x"]
    assert encoded(bpe.Codec(codec.transducer.ranks, 4096), texts) == [public.encode_ordinary(t) for t in texts]


def test_one_long_text_does_not_hold_up_a_chunk(both):  # noqa: F811
    codec, public = both
    for text in (long_texts(400_000)[1], "a" * 1_000_000, "ab" * 500_000):
        started = time.time()
        got = encoded(codec, [text])
        assert time.time() - started < 20
        assert got == [public.encode_ordinary(text)]


def test_exact_comes_from_the_streamed_text(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "héllo 🙂 " * 3000), (2, None), (3, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["exact"] for r in bpe.encode_documents(docs).collect()} == {1: True, 2: None, 3: True}
    codec = bpe.Codec(bpe.load_ranks())
    ids = np.array(encoded(codec, ["🙂é日本 " * 50])[0])
    assert {bpe.decoded(codec, ids, step) for step in (1, 2, 3, 4096)} == {"🙂é日本 " * 50}
