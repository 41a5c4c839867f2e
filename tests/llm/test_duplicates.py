"""SimHash, MinHash and embedding near-duplicates against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowloom.llm import itq, kernels as K, minhash_oph, simhash_bk

from .conftest import strings


def copies(seed=0, groups=40, size=3, words=120):
    """(doc_id, group, text): near copies with 4 % of their words replaced, and as many singles."""
    rng = np.random.default_rng(seed)
    vocab = np.array([f"w{i}" for i in range(3000)])
    rows = []
    for g in range(groups):
        base = rng.choice(vocab, words)
        for _ in range(size if g % 2 else 1):
            t = base.copy()
            t[rng.random(words) < 0.04] = "changed"
            rows.append((len(rows), g, " ".join(t)))
    return rows


def brute_pairs(texts):
    lo, hi, grams, words = simhash_bk.fingerprints(pa.array(texts, pa.string()))
    d = K.popcount(lo[:, None] ^ lo).astype(int) + K.popcount(hi[:, None] ^ hi)
    return (d <= simhash_bk.RADIUS) & (K.popcount(grams[:, None] ^ grams) <= simhash_bk.CONFIRM) & (words[:, None] > 0) & (words > 0), d


def groups_of(near):
    root = np.arange(len(near))
    while True:
        new = np.array([root[np.flatnonzero(near[i])].min() if near[i].any() else root[i] for i in range(len(near))])
        if (new == root).all():
            return root
        root = new


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_simhash_groups_are_brute_force_groups(spark, limit, monkeypatch):
    rows = copies()
    monkeypatch.setattr(simhash_bk.near_edges, "__defaults__", (simhash_bk.RADIUS, simhash_bk.CONFIRM, simhash_bk.TABLES, limit))
    docs = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in simhash_bk.near_duplicates(docs).collect()}
    near, _ = brute_pairs([r[2] for r in rows])
    want = groups_of(near)
    same = np.mean([got[i]["group_id"] == want[i] for i in range(len(rows))])
    assert same > 0.95
    # All planted groups, no single lost.
    for g in {r[1] for r in rows}:
        own = [r[0] for r in rows if r[1] == g]
        assert sum(got[i]["kept"] for i in own) == 1


def test_bk_tree_finds_all_within_radius():
    rng = np.random.default_rng(1)
    lo = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    lo[200:] = lo[:200] ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64))
    hi = np.concatenate([lo[:200], lo[:200]])
    bucket = np.sort(rng.integers(0, 3, 400).astype(np.uint64))
    forest = simhash_bk.Forest(bucket, lo, hi)
    found = {(int(q), int(m)) for qs, ms in forest.search(lo, hi, forest.root, 8) for q, m in zip(qs, ms, strict=True)}
    d = K.popcount(lo[:, None] ^ lo).astype(int) + K.popcount(hi[:, None] ^ hi)
    assert found == {(i, j) for i, j in zip(*np.nonzero((d <= 8) & (bucket[:, None] == bucket)), strict=True)}
    # Children are keyed by their distance to the parent.
    for p in range(400):
        at = slice(forest.kid_at[p], forest.kid_at[p + 1])
        assert (forest.edges[at] == d[p, forest.kids[at]]).all()
        assert len(set(forest.edges[at].tolist())) == len(forest.edges[at])


def test_table_recall():
    """Pairs within the radius share a bucket at least nine times of ten, at any table size."""
    rng = np.random.default_rng(2)
    n = 4000
    lo, hi = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
    flips = np.array([rng.choice(128, int(rng.binomial(128, 0.1)), replace=False).tolist() for _ in range(n)], object)
    lo2, hi2 = lo.copy(), hi.copy()
    for i, f in enumerate(flips):
        for b in f:
            if b < 64:
                lo2[i] ^= np.uint64(1) << np.uint64(b)
            else:
                hi2[i] ^= np.uint64(1) << np.uint64(b - 64)
    within = K.popcount(lo ^ lo2).astype(int) + K.popcount(hi ^ hi2) <= simhash_bk.RADIUS
    for key_bits in (8, 14):
        bits = simhash_bk.table_bits(simhash_bk.TABLES, key_bits)
        met = (simhash_bk.table_keys(lo, hi, bits) == simhash_bk.table_keys(lo2, hi2, bits)).any(1)
        assert met[within].mean() > 0.9


def test_pairs_at_the_radius_are_all_found(spark):
    """Recall 1 at distance exactly RADIUS; the sampled keys of 21 bits that stood here would miss most."""
    rng = np.random.default_rng(3)
    n = 10_000
    lo, hi, lo2, hi2 = (np.zeros(n, np.uint64) for _ in range(4))
    for half in (lo, hi):
        half[:] = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    lo2[:], hi2[:] = lo, hi
    for i in range(n):
        for b in rng.choice(128, simhash_bk.RADIUS, replace=False).tolist():
            half = lo2 if b < 64 else hi2
            half[i] ^= np.uint64(1) << np.uint64(b % 64)
    bits = simhash_bk.table_bits(simhash_bk.TABLES, 21)
    met = (simhash_bk.table_keys(lo, hi, bits) == simhash_bk.table_keys(lo2, hi2, bits)).any(1)
    assert met.mean() < 0.3
    cols = {"node": np.arange(2 * n), "lo": np.concatenate([lo, lo2]).view(np.int64), "hi": np.concatenate([hi, hi2]).view(np.int64), "grams": np.zeros(2 * n, np.int64)}
    prints = spark.createDataFrame(pa.table(cols)).repartition(4)
    edges = {(r["u"], r["v"]) for r in simhash_bk.near_edges(prints, simhash_bk.RADIUS, simhash_bk.CONFIRM).collect()}
    assert {(i + n, i) for i in range(n)} <= edges


def test_simhash_odd_cases(odd, none):
    got = simhash_bk.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    same = [r for r in got if r["group_id"] == 5]
    assert len(same) == 5
    assert sum(r["kept"] for r in same) == 1
    kept = simhash_bk.drop_copies(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sum((r["text"] or "").startswith("The same") for r in rows) == 1
    assert sum(r["text"] is None for r in rows) == 2
    assert len(rows) == sum(r["kept"] for r in got)
    assert simhash_bk.near_duplicates(none).isEmpty()
    assert simhash_bk.drop_copies(none).isEmpty()
    only_null = odd.where("text is null")
    assert simhash_bk.drop_copies(only_null).count() == 2


# -- MinHash ----------------------------------------------------------------------


def brute_fingerprint(text, bins, size=minhash_oph.SHINGLE):
    """Densified values by the definition, from the same shingle hashes."""
    _, value = minhash_oph.shingles(strings(text), size)
    best = [None] * bins
    for v in value.tolist():
        b = (v >> 32) * bins >> 32
        best[b] = v if best[b] is None else min(best[b], v)
    donor = minhash_oph.donors(bins)
    out = list(best)
    for b in range(bins):
        k = 0
        while out[b] is None:
            out[b] = best[int(donor(np.array([b]), k)[0])]
            k += 1
    return out


@pytest.mark.parametrize("words", [1, 4, 5, 30, 700])
def test_densification_by_definition(words):
    text = " ".join(f"t{i}" for i in range(words))
    doc, value = minhash_oph.shingles(strings("other text", text, None))
    least, filled = minhash_oph.densified(doc, value, 3, 64)
    assert least[1].tolist() == brute_fingerprint(text, 64)
    assert not filled[2].any()
    assert np.bincount(doc, minlength=3)[1] == max(1, words - 4)


def test_similarity_is_unbiased(spark):
    rng = np.random.default_rng(5)
    rows, truth = [], []
    for k in range(60):
        a = [f"x{v}" for v in rng.integers(0, 10**6, 400)]
        b = a[: 40 * (k % 10)] + [f"y{v}" for v in rng.integers(0, 10**6, 400 - 40 * (k % 10))]
        sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b)]
        truth.append(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    prints = minhash_oph.fingerprint(spark.createDataFrame(rows, "doc_id long, text string"))
    left = prints.where("doc_id % 2 = 0").select((F.col("doc_id") / 2).cast("int").alias("k"), F.col("fingerprint").alias("a"))
    right = prints.where("doc_id % 2 = 1").select(((F.col("doc_id") - 1) / 2).cast("int").alias("k"), F.col("fingerprint").alias("b"))
    got = left.join(right, "k").select("k", "a", "b", minhash_oph.similarity("a", "b").alias("s")).orderBy("k").collect()
    error = np.array([r["s"] for r in got]) - truth
    assert abs(error.mean()) < 0.01
    assert np.abs(error).max() < 0.12
    assert all(abs(minhash_oph.estimate(bytes(r["a"]), bytes(r["b"])) - r["s"]) < 1e-9 for r in got)


def test_packed_bits():
    values = np.arange(2 * 16, dtype=np.uint64).reshape(2, 16)
    for bits in (1, 2, 4, 8):
        packed = minhash_oph.pack_bits(values, bits)
        assert [len(x) for x in packed] == [16 * bits // 8] * 2
        assert minhash_oph.estimate(packed[0], packed[0], 16, bits) == 1.0


def test_fingerprint_odd_cases(odd, none):
    got = minhash_oph.fingerprint(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["fingerprint"] is None and by[i]["n_shingles"] == 0 for i in (0, 1, 2, 3))
    assert by[5]["fingerprint"] == by[6]["fingerprint"]
    assert minhash_oph.fingerprint(none).isEmpty()


# -- embeddings ---------------------------------------------------------------------


def near_vectors(seed=0, n=300, dim=64):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    y = x[: n // 3] + rng.standard_normal((n // 3, dim)) * rng.uniform(0.05, 0.3, (n // 3, 1))
    return np.concatenate([x, y])


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_itq_recall(spark, limit):
    x = near_vectors()
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(3)
    got = {(r["vec_a"], r["vec_b"]): r["cosine"] for r in itq.near_pairs(df, broadcast_bytes=limit).collect()}
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cos = u @ u.T
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(cos >= itq.COSINE, 1)), strict=True)}
    assert set(got) <= want
    assert len(got) >= 0.9 * len(want) > 50
    assert all(abs(c - cos[p]) < 1e-9 for p, c in got.items())


def test_buckets_hold_each_near_pair_once():
    rng = np.random.default_rng(4)
    code = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    code = np.concatenate([code, code ^ (np.uint64(1) << rng.integers(0, 63, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 60).astype(np.uint64)), code[:5]])
    row, bucket = itq.substring_rows(code)
    order = np.argsort(bucket, kind="stable")
    pairs = [tuple(sorted(p)) for a, b in itq.bucket_pairs(bucket[order], row[order], code[row[order]], itq.RADIUS) for p in zip(a.tolist(), b.tolist(), strict=True)]
    d = K.popcount(code[:, None] ^ code)
    assert sorted(pairs) == sorted((int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(d <= itq.RADIUS, 1)), strict=True))


def test_itq_rotation_balances_bits(spark):
    x = near_vectors(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    vectors, dim = itq.usable(df)
    mean, projection = itq.learn(vectors, dim)
    assert np.allclose(projection.T @ projection, np.eye(64), atol=1e-8)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    on = np.unpackbits(itq.codes(u, mean, projection).view(np.uint8).reshape(-1, 8), axis=1).mean(0)
    assert abs(on - 0.5).max() < 0.15


def test_itq_odd_cases(spark):
    v = np.eye(8).tolist()
    rows = [(0, v[0]), (1, v[0]), (1, v[1]), (1, v[0]), (2, None), (3, []), (4, [0.0] * 8), (5, [float("nan")] * 8), (6, [1.0]), (None, v[0]), (7, [None] + v[0][1:]), (8, [2.0 * x for x in v[1]])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<double>, n string, x int, bucket int")
    got = {(r["vec_a"], r["vec_b"]): r["cosine"] for r in itq.near_pairs(df).collect()}
    assert got == {(0, 1): 1.0, (1, 8): 1.0}
    assert itq.near_pairs(df.where("false")).isEmpty()
    assert itq.near_pairs(df.where("vec_id = 2")).isEmpty()


@pytest.mark.parametrize("key_bits", [0, 3, 8, 14, 21, 28])
@pytest.mark.parametrize("distance", [12, 24])
def test_recall_is_the_same_at_every_size(key_bits, distance):
    """At 28 bits a table is for nine million million fingerprints."""
    tables, bits = simhash_bk.table_shape(simhash_bk.SHARD << key_bits)
    assert bits == key_bits
    rng = np.random.default_rng(key_bits)
    n = 600
    code = rng.integers(0, 2, (n, 128), dtype=np.uint8)
    other = code.copy()
    for i in range(n):
        other[i, rng.choice(128, distance, replace=False)] ^= 1
    words = [np.packbits(x, axis=1, bitorder="little").view(np.uint64) for x in (code, other)]
    chosen = simhash_bk.table_bits(tables, key_bits)
    a, b = (simhash_bk.table_keys(np.ascontiguousarray(w[:, 0]), np.ascontiguousarray(w[:, 1]), chosen) for w in words)
    assert (a == b).any(1).mean() > 0.96


def test_work_grows_less_than_the_square():
    """Pairs compared a fingerprint: with 64 times as many, fewer than 8 times as many."""
    def compared(count):
        tables, bits = simhash_bk.table_shape(count)
        return tables * count / 2**bits

    for count in (1 << 20, 1 << 24, 1 << 30):
        assert compared(count << 6) < 8 * compared(count)
        assert simhash_bk.table_shape(count)[0] * 40 < 40 * 2 * (count / simhash_bk.SHARD) ** 0.5


def brute_roots(lo, hi, grams, across=None):
    near = (K.popcount(lo[:, None] ^ lo).astype(int) + K.popcount(hi[:, None] ^ hi) <= 24) & (K.popcount(grams[:, None] ^ grams) <= 22)
    if across is not None:
        side = np.arange(len(lo)) < across
        near &= side[:, None] != side
    return simhash_bk._least_members(len(lo), *np.nonzero(near))


def scattered(rng, n, spread, width=128):
    """n codes, each a centre with up to ``spread`` bits changed."""
    code = np.repeat(rng.integers(0, 2, (1, width), dtype=np.uint8), n, 0)
    for i in range(n):
        code[i, rng.choice(width, rng.integers(0, spread + 1), replace=False)] ^= 1
    return np.packbits(code, axis=1, bitorder="little").view(np.uint64)


@pytest.mark.parametrize("cross", [False, True])
def test_shards_with_large_groups_by_brute_force(cross):
    """Wide groups that chain, tight ones and singles; pivots must not lose a link."""
    rng = np.random.default_rng(8)
    parts = [scattered(rng, 900, 20), scattered(rng, 700, 3), *(scattered(rng, 12, 10) for _ in range(20)), rng.integers(0, 1 << 63, (400, 2), dtype=np.uint64)]
    code = np.concatenate(parts)[rng.permutation(sum(map(len, parts)))]
    lo, hi = np.ascontiguousarray(code[:, 0]), np.ascontiguousarray(code[:, 1])
    grams = np.where(rng.random(len(lo)) < 0.9, np.uint64(0), np.uint64((1 << 40) - 1))
    node = np.arange(len(lo), dtype=np.uint64)
    left = 1000 if cross else len(lo)
    u, v = simhash_bk.shard_edges(node, lo, hi, grams, left, 24, 22)
    got = simhash_bk._least_members(len(lo), u.astype(int), v.astype(int))
    if not cross:
        assert (got == brute_roots(lo, hi, grams)).all()
    else:  # links on one side may be there or not, those across all are
        want = brute_roots(lo, hi, grams, left)
        assert all(len(set(got[want == w])) == 1 for w in set(want.tolist()))
        full = brute_roots(lo, hi, grams)
        assert (full[u.astype(int)] == full[v.astype(int)]).all()


def test_a_hundred_thousand_near_copies():
    """Five thousand million near pairs, in bounded memory and time."""
    import time
    import tracemalloc

    rng = np.random.default_rng(9)
    centre = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
    n = 100_000
    lo, hi = np.full(n, centre[0]), np.full(n, centre[1])
    for _ in range(5):
        lo ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        hi ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    started = time.time()
    tracemalloc.start()
    u, v = simhash_bk.shard_edges(np.arange(n, dtype=np.uint64), lo, hi, np.zeros(n, np.uint64), n, 24, 22)
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    assert time.time() - started < 60
    assert len(u) == n - 1


def test_blocks_of_a_shard_find_what_one_block_finds(spark):
    rng = np.random.default_rng(10)
    code = np.concatenate([scattered(rng, 6, 8) for _ in range(500)])
    cols = {"node": np.arange(len(code)), "lo": code[:, 0].view(np.int64), "hi": code[:, 1].view(np.int64), "grams": np.zeros(len(code), np.int64)}
    prints = spark.createDataFrame(pa.table(cols)).repartition(3)
    roots = []
    for block in (0, simhash_bk.BLOCK):
        e = simhash_bk.near_edges(prints, 24, 22, simhash_bk.SHARD, block).collect()
        roots.append(simhash_bk._least_members(len(code), np.array([r["u"] for r in e]), np.array([r["v"] for r in e])))
    assert (roots[0] == roots[1]).all()
    assert len(set(roots[0].tolist())) == 500


def by_sql(rows):
    """(vec_a, vec_b) -> cosine, by the brute-force SQL."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [[i, None if v is None else list(map(float, v))] for i, v in rows])
    return {(a, b): c for a, b, c in con.sql(itq.PAIRS_SQL).fetchall()}


def pairs_of(spark, rows, **more):
    df = spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>").repartition(3)
    return {(r["vec_a"], r["vec_b"]): r["cosine"] for r in itq.near_pairs(df, **more).collect()}


@pytest.mark.parametrize("dim", [2, 8, 16, 32, 64, 100])
def test_itq_recall_at_every_length_against_sql(spark, dim):
    """Pairs on both sides of the threshold."""
    x = near_vectors(dim, 240, dim)
    rows = list(enumerate(x.astype(np.float32)))
    want, got = by_sql(rows), pairs_of(spark, rows)
    assert len(want) > 30
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(abs(c - want[p]) < 1e-9 for p, c in got.items())


def test_itq_short_vectors_do_not_share_a_bucket():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    projection = np.concatenate([np.linalg.qr(rng.standard_normal((32, 32)))[0] for _ in range(2)], 1)
    _, bucket = itq.substring_rows(itq.codes(x, np.zeros(32), projection))
    assert np.unique(bucket, return_counts=True)[1].max() < 300


def test_itq_several_lengths(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k, (dim, n) in enumerate(((16, 60), (24, 40), (5, 2))):
        x = rng.standard_normal((n, dim))
        rows += [(1000 * k + i, v) for i, v in enumerate(x)] + [(1000 * k + 500 + i, 3 * v) for i, v in enumerate(x[:10])]
    rows += [(3000, rng.standard_normal(7)), (0, rows[100][1]), (None, rows[0][1]), (3001, None)]
    want, got = by_sql(rows), pairs_of(spark, rows)
    assert set(got) == set(want) and len(want) >= 22


@pytest.mark.parametrize("slab_bytes", [itq.BROADCAST_BYTES, 40_000])
def test_classes_and_links_against_sql(spark, slab_bytes):
    """A cluster whose pairs lie about the threshold, chains, odd rows: one row an id, no link lost."""
    import duckdb

    rng = np.random.default_rng(12)
    centre = rng.standard_normal(64)
    x = np.concatenate([centre + 0.22 * rng.standard_normal((150, 64)), rng.standard_normal((100, 64))])
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(1000), x, strict=False)]
    rows += [(rows[200][0], rows[201][1]), (2000, rows[202][1]), (2001, None), (2002, [0.0] * 64), (2003, [float("nan")] * 64), (2004, []), (None, rows[0][1]), (2005, [1.0, 2.0]), (2006, [2.0, 4.0])]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(tuple(r) for r in itq.classes(df, slab_bytes=slab_bytes).collect())
    assert got == sorted(con.sql(itq.ORACLE_SQL).fetchall())
    assert len(got) == len({i for i, _ in rows if i is not None})
    assert sum(k for *_, k in got) > 500 and sum(k == 0 for *_, k in got) > 80
    assert itq.classes(df.where("false")).isEmpty()


def test_shards_are_tasks_of_their_own(spark):
    """Shards are few bytes and much work: they aren't put together by their size."""
    rng = np.random.default_rng(3)
    rows = [(k, *map(int, rng.integers(-(2**62), 2**62, 3))) for k in range(400)]
    prints = spark.createDataFrame(rows, "node long, lo long, hi long, grams long")
    df = simhash_bk.near_edges(prints, shard=50)
    plan = df._jdf.queryExecution().executedPlan().toString()
    tables, key_bits = simhash_bk.table_shape(400, shard=50)
    assert f", {tables << key_bits}), REPARTITION_BY_NUM" in plan and plan.count("hashpartitioning(bucket") == 1
