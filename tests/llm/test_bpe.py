import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowloom.llm import bpe
from rowloom.llm import kernels as K

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def both(request):
    ranks = bpe.load_ranks(tokenizers.path(request.param))
    return bpe.Codec(ranks), tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(codec, texts):
    buf, offs = K.text_buffer(pa.array(texts, pa.string()))
    ids, n = codec.encode(buf, offs)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


PARTS = ["a", "'s", "'ll", "'", "''", " ", "  ", "\n", "\t", "\r\n", "é", "日本", "🙂", "12", "don't", "I've'd", "=====", "-" * 40, " " * 30, "\xa0", " ", "ⅷ", "x'", "THE"]


def test_same_as_the_public_encoder(both):
    codec, public = both
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(300)] + ["", "a" * 700, " " * 900, "=" * 500]
    assert encoded(codec, texts) == [public.encode_ordinary(t) for t in texts]


@settings(max_examples=80, deadline=None)
@given(texts=st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_same_on_any_text(texts):
    ranks = bpe.load_ranks()
    codec = test_same_on_any_text.__dict__.setdefault("codec", bpe.Codec(ranks))
    public = test_same_on_any_text.__dict__.setdefault("public", tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert encoded(codec, texts) == [public.encode_ordinary(t) for t in texts]


def test_transducer_is_plain_bpe_with_bounded_lookahead():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"abcd": 260, b"aa": 261}
    t = bpe.Transducer(ranks)
    rng = random.Random(0)
    for _ in range(300):
        piece = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))).encode()
        state, out = 0, []
        for b in piece:
            state, emitted = t.step(state, b)
            out += t.outputs[emitted]
            assert len(t.states[state]) <= 2 * t.longest
        out += t.outputs[t.final[state]]
        assert out == bpe.merge(piece, ranks)


def test_full_table_is_emptied(both):
    codec, public = both
    small = bpe.Codec(codec.transducer.ranks, slots=2048)
    texts = [f"w{random.Random(i).randrange(10**9)} some words {i}" for i in range(300)]
    for t in texts:
        assert encoded(small, [t]) == [public.encode_ordinary(t)]


@pytest.mark.parametrize("size", [1, 2, 5])
def test_streaming_decode(both, size):
    codec, public = both
    text = "héllo 🙂🙂 日本 wörld \U0001f468‍\U0001f469 end"
    ids, stream, shown = public.encode_ordinary(text), bpe.StreamDecoder(codec), ""
    for i in range(0, len(ids), size):
        shown += stream.feed(ids[i : i + size])
        assert text.startswith(shown)
    assert shown + stream.end() == text


def test_utf8_machine_is_pythons():
    rng = random.Random(3)
    for _ in range(3000):
        data = bytes(rng.choice([rng.randrange(256), rng.choice(b"\xc3\xe0\xed\xf0\xf4\x80\x90\xa0\xbf")]) for _ in range(rng.randrange(1, 5)))
        state = bpe.ACCEPT
        for b in data:
            state = bpe.utf8_next(state, b)
            if state == bpe.REJECT:
                break
        try:
            data.decode()
            assert state == bpe.ACCEPT
        except UnicodeDecodeError:
            assert state != bpe.ACCEPT


def test_broken_bytes_decode_as_python_does(both):
    codec, _ = both
    rng = random.Random(5)
    byte_id = {t[0]: i for t, i in codec.transducer.ranks.items() if len(t) == 1}
    for _ in range(200):
        data = bytes(rng.choice(b"a\xc3\xa9\xe2\x82\xac\xf0\x9f\xff") for _ in range(12))
        stream = bpe.StreamDecoder(codec)
        assert "".join(stream.feed([byte_id[b]]) for b in data) + stream.end() == data.decode("utf-8", "replace")
    with pytest.raises(ValueError, match="vocabulary"):
        bpe.StreamDecoder(codec).feed([10**6])


def test_round_trip(documents):
    coded = bpe.encode_documents(documents)
    rows = coded.collect()
    assert all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(coded).collect()}
    assert back == {r["doc_id"]: r["text"] for r in documents.collect()}


def test_odd_cases(odd, none):
    got = bpe.encode_documents(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r["ids"] is None) == (r["n_tokens"] is None) == (r["exact"] is None)
    by = {r["doc_id"]: r for r in got}
    assert by[0]["ids"] is None
    assert (by[1]["ids"], by[1]["n_tokens"], by[1]["exact"]) == ([], 0, True)
    assert bpe.encode_documents(none).isEmpty()
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(bpe.encode_documents(odd)).collect() if r["doc_id"] is not None}
    assert back == {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] is not None}
