import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rowloom.llm import kernels as K
from rowloom.llm.components import connected_components


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
def test_words(texts):
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    w = K.words_of(pa.array(texts, pa.string()))
    want = [re.findall(rb"[a-z0-9\x80-\xff]+", pa.compute.utf8_lower(pa.scalar(t or "")).as_py().encode()) for t in texts]
    assert w.count.tolist() == [len(x) for x in want]
    flat = [x for ws in want for x in ws]
    assert len(set(zip(flat, w.hash.tolist(), strict=True))) == len(set(flat)) == len(set(w.hash.tolist()))


def test_hash_does_not_depend_on_place():
    buf = np.frombuffer(b"abcabcxabc", np.uint8)
    h = K.range_hash(buf, np.array([0, 3, 7, 6]), np.array([3, 6, 10, 10]))
    assert h[0] == h[1] == h[2] != h[3]


def test_chunks_cover_all_rows():
    col = pa.array(["a" * n for n in (5, 0, 100, 3, 3)] + [None], pa.string())
    assert list(K.chunk_bounds(col, 10)) == [(0, 2), (2, 3), (3, 6)]
    assert list(K.chunk_bounds(col.slice(3), 10, rows=1)) == [(0, 1), (1, 2), (2, 3)]


def test_fresh_names():
    assert K.fresh(["_Node", "node"], "node") == "__node"


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 300, (220, 2)).tolist() + [[i, i + 1] for i in range(1000, 1050)] + [[5, 5]]
    df = spark.createDataFrame([tuple(p) for p in pairs] + [(None, 1)], "u long, v long")
    got = {r["id"]: r["root"] for r in connected_components(df).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "u long, v long")).isEmpty()
