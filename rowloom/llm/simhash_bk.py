"""SimHash near-duplicates found in BK-trees.

Each text gets a 128-bit SimHash of its distinct words and a 64-bit one of its
word bigrams. Two texts are near copies when the former differ in at most
``RADIUS`` bits and the latter in at most ``CONFIRM``; equal texts are copies
always. Groups are the connected components; the row with the least
(doc_id, nulls last) of a group stays.

Search. Every fingerprint is a query. A table is keyed by ``key_bits`` of the 128
bits, drawn at random for it, and each of its buckets is a shard: a BK-tree of one
level, whose items are the children of a common root, keyed by their integer Hamming
distance to it. A query follows only edges within the radius of its own distance to
the root, and what hangs there is scanned with numpy. (Texts that aren't related lie
near 64 bits apart, so deeper levels cut nothing off at radius 24 and cost more than
a scan.) ``key_bits`` grows with the logarithm of the number of distinct
fingerprints, so that a shard holds some ``SHARD`` of them, and the number of tables
is what a pair at a distance of exactly ``RADIUS`` needs to share a shard with
probability ``RECALL``, whatever the data: recall is the same at every size, higher
for nearer pairs, and 1 up to ``SHARD`` fingerprints, where one table of no bits
holds all. Work and traffic grow with the power 1.3 of the input instead of 2.

A shard of more than ``BLOCK`` fingerprints is cut into blocks, each pair of which is
a task, so memory stays bounded. Within a task large groups are found first, by the
neighbours of a few pivots, and aren't compared with themselves again. A task
reports, for each fingerprint, the least one of its component there: spanning
edges, so a thousand copies cost a thousand rows a task.

Defined cases. Null text: no group, always kept. Text without a word: only an
equal text is a copy. Repeated rows: copies of one another, one stays. Null
doc_id: stays only if its whole group has no id. Empty table: empty result.
Extra columns are carried through by ``drop_copies``; no name can clash, since
decisions are joined on renamed keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .components import connected_components
from .shared import cut, table

RADIUS, CONFIRM = 24, 22
RECALL, SHARD, BLOCK = 0.99, 1 << 15, 1 << 17
TASKS = 1024  # at most, each some shards
QUERIES, TILE, PIVOTS = 64, 8192, 16  # QUERIES x TILE pairs are compared at once
TABLES = 24  # the number once used at every size: only to measure what it missed
U = np.uint64


def _votes(bits64: np.ndarray, starts: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """For each run of hashes, the 64-bit word whose bits are the majority of the run's."""
    ones = np.unpackbits(bits64.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.add.reduceat(ones, starts, axis=0, dtype=np.int32)
    size = np.diff(np.append(starts, len(bits64)))
    out = np.zeros(len(empty), U)
    out[~empty] = np.packbits(2 * total > size[:, None], axis=1, bitorder="little").view(U).ravel()
    return out


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, bigrams, words) of each text of a chunk; words 0: lo and hi hash its bytes."""
    buf, offs = K.text_buffer(column, lower=True)
    w = K.Words(buf, offs)
    doc, word, _ = K.distinct_pairs(w.doc, w.hash)
    bare = w.count == 0
    starts = np.searchsorted(doc, np.flatnonzero(~bare))
    if len(starts):
        lo, hi = _votes(word, starts, bare), _votes(K.mix(word + U(0x51ED270B)), starts, bare)
        follows = w.doc[1:] == w.doc[:-1]
        # The bigram that begins at a word; a text's last word stands alone.
        gram = w.hash.copy()
        gram[:-1][follows] = K.mix(w.hash[:-1][follows] * U(3) + w.hash[1:][follows])
        grams = _votes(gram, np.searchsorted(w.doc, np.flatnonzero(~bare)), bare)
    else:
        lo = hi = grams = np.zeros(len(column), U)
    if bare.any():
        raw, at = K.text_buffer(column)
        h = K.range_hash(raw, at[:-1][bare], at[1:][bare])
        lo, hi = lo.copy(), hi.copy()
        lo[bare], hi[bare] = h, K.mix(h + U(7))
    return lo, hi, grams, w.count


def _node(lo: np.ndarray, hi: np.ndarray, grams: np.ndarray) -> np.ndarray:
    return K.mix(lo ^ K.mix(hi ^ K.mix(grams + U(1))))


def _prints(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, node, lo, hi, grams, words) of each row with a text; copy hashes the text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lo, hi, grams, words = fingerprints(K.column_of(batch, "text"))
        made = (pa.array(x.view(np.int64)) for x in (_node(lo, hi, grams), lo, hi, grams))
        cols = [K.column_of(batch, "doc_id"), K.column_of(batch, "copy"), *made, pa.array(words.astype(np.int64))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "copy", "node", "lo", "hi", "grams", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("copy"), "text").where("text is not null")
    return texts.mapInArrow(K.by_chunk(work), f"doc_id {kind}, copy long, node long, lo long, hi long, grams long, words long")


# -- BK-trees ---------------------------------------------------------------


class Forest:
    """One BK-tree for each run of equal buckets; nodes are the items in their order."""

    def __init__(self, bucket: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.lo, self.hi = lo, hi
        n = len(lo)
        first = np.ones(n, bool)
        first[1:] = bucket[1:] != bucket[:-1]
        root_at = np.flatnonzero(first)
        self.root = np.repeat(root_at, np.diff(np.append(root_at, n)))
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        item, under = np.flatnonzero(~first), self.root[~first]
        while len(item):
            d = self.distance(item, under)
            key = under * 256 + d
            order = np.argsort(key, kind="stable")
            item, under, d, key = item[order], under[order], d[order], key[order]
            new = np.ones(len(item), bool)
            new[1:] = key[1:] != key[:-1]
            parent[item[new]], edge[item[new]] = under[new], d[new]
            child = np.repeat(item[new], np.diff(np.append(np.flatnonzero(new), len(item))))
            item, under = item[~new], child[~new]
        kids = np.flatnonzero(parent >= 0)
        kids = kids[np.lexsort((edge[kids], parent[kids]))]
        self.kids, self.edges = kids, edge[kids]
        self.kid_at = np.searchsorted(parent[kids], np.arange(n + 1))

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (K.popcount(self.lo[a] ^ self.lo[b]).astype(np.int64)) + K.popcount(self.hi[a] ^ self.hi[b])

    def search(self, lo: np.ndarray, hi: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) within the radius, for queries that start at the given roots."""
        query, node = np.arange(len(lo)), root
        while len(query):
            d = K.popcount(lo[query] ^ self.lo[node]).astype(np.int64) + K.popcount(hi[query] ^ self.hi[node])
            near = d <= radius
            yield query[near], node[near]
            begin, size = self.kid_at[node], self.kid_at[node + 1] - self.kid_at[node]
            query, d = np.repeat(query, size), np.repeat(d, size)
            slot = np.arange(len(query)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
            follow = np.abs(self.edges[slot] - d) <= radius
            query, node = query[follow], self.kids[slot[follow]]


def _least_members(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each item's component, given pairs of items."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before, root)
        root = root[root]
        if (root == before).all():
            return root


def shard_edges(node: np.ndarray, lo: np.ndarray, hi: np.ndarray, grams: np.ndarray, left: int, radius: int, confirm: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (node, node) of the near pairs between the first ``left`` items and the
    others; if there are no others, of those among all items."""
    n, same = len(node), left == len(node)
    if not n:
        return node, node
    links: list[tuple[np.ndarray, np.ndarray]] = []
    pivots = np.random.default_rng(n).choice(n, PIVOTS, replace=False) if n > PIVOTS * QUERIES else np.zeros(0, np.int64)
    for p in pivots:
        near = np.flatnonzero((K.popcount(lo ^ lo[p]).astype(np.int64) + K.popcount(hi ^ hi[p]) <= radius) & (K.popcount(grams ^ grams[p]) <= confirm))
        links.append((np.full(len(near), p), near))
    group = np.full(n, -1)
    if links:
        root = _least_members(n, *(np.concatenate(x) for x in zip(*links, strict=True)))
        group = np.where(np.bincount(root, minlength=n)[root] > QUERIES, root, -1)
    to_root = K.popcount(lo ^ lo[0]).astype(np.int64) + K.popcount(hi ^ hi[0])

    def by_group(side: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Each group's items, along the root's edges."""
        side = side[np.lexsort((to_root[side], group[side]))]
        cuts = np.flatnonzero(np.diff(group[side])) + 1
        return [(int(group[x[0]]), x) for x in np.split(side, cuts) if len(x)]

    ours = by_group(np.arange(left))
    theirs = ours if same else by_group(np.arange(left, n))
    held = 0
    for k, (g, a) in enumerate(ours):
        for h, b in theirs[k:] if same else theirs:
            if g == h >= 0:
                continue
            for q, i in _near(lo, hi, grams, to_root, a, b, same and g == h, radius, confirm):
                links.append((q, i))
                held += len(q)
                if held > 1 << 20:
                    root = _least_members(n, *(np.concatenate(x) for x in zip(*links, strict=True)))
                    linked = np.flatnonzero(root != np.arange(n))
                    links, held = [(linked, root[linked])], 0
    if not links:
        return node[:0], node[:0]
    root = _least_members(n, *(np.concatenate(x) for x in zip(*links, strict=True)))
    linked = np.flatnonzero(root != np.arange(n))
    return node[linked], node[root[linked]]


def _near(lo: np.ndarray, hi: np.ndarray, grams: np.ndarray, to_root: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool, radius: int, confirm: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs between items a and b, both along the root's edges; same: they are the same items."""
    edge, la, lb = to_root[b], lo[a], lo[b]
    for at in range(0, len(a), QUERIES):
        to = min(at + QUERIES, len(a))
        begin = int(np.searchsorted(edge, to_root[a[at]] - radius))
        end = int(np.searchsorted(edge, to_root[a[to - 1]] + radius, "right"))
        for tile in range(max(begin, at) if same else begin, end, TILE):
            m = slice(tile, min(tile + TILE, end))
            d = K.popcount(la[at:to, None] ^ lb[None, m]).ravel()
            hit = np.flatnonzero(d <= radius)
            q, i = np.divmod(hit, m.stop - m.start)
            later = q + at < i + tile if same else np.ones(len(q), bool)
            q, i, d = a[q[later] + at], b[i[later] + tile], d[hit[later]]
            ok = (d.astype(np.int64) + K.popcount(hi[q] ^ hi[i]) <= radius) & (K.popcount(grams[q] ^ grams[i]) <= confirm)
            if ok.any():
                yield q[ok], i[ok]


def shared_shard(key_bits: int, distance: int = RADIUS) -> float:
    """The probability that fingerprints at a distance agree in a table's bits."""
    return float(np.prod([(128 - distance - i) / (128 - i) for i in range(key_bits)]))


def table_shape(count: int, radius: int = RADIUS, shard: int = SHARD) -> tuple[int, int]:
    """(tables, key bits) for so many fingerprints."""
    key_bits = max(0, (-(-count // max(shard, 1)) - 1).bit_length())
    p = shared_shard(key_bits, radius)
    return (1 if p == 1 else int(np.ceil(np.log(1 - RECALL) / np.log1p(-p)))), key_bits


def table_bits(tables: int, key_bits: int) -> np.ndarray:
    """The bits that each table's key is made of."""
    rng = np.random.default_rng(7)
    return np.array([np.sort(rng.choice(128, key_bits, replace=False)) for _ in range(tables)])


def table_keys(lo: np.ndarray, hi: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """(fingerprint, table): a 64-bit bucket that holds the table and the key."""
    out = np.empty((len(lo), len(bits)), U)
    for t, chosen in enumerate(bits):
        key = np.zeros(len(lo), U)
        for bit in chosen:
            word = lo if bit < 64 else hi
            key = (key << U(1)) | ((word >> U(bit % 64)) & U(1))
        out[:, t] = K.mix(key * U(len(bits)) + U(t))
    return out


_NAMES = ["node", "lo", "hi", "grams"]


def near_edges(prints: DataFrame, radius: int = RADIUS, confirm: int = CONFIRM, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(u, v): spanning edges over the nodes of ``prints`` (node, lo, hi, grams; distinct)."""
    tables, key_bits = table_shape(prints.count(), radius, shard)
    bits, block = table_bits(tables, key_bits), max(block, 1 << 10)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                cols = [K.column_of(batch.slice(at, 4096), c).to_numpy() for c in _NAMES]
                bucket = table_keys(cols[1].view(U), cols[2].view(U), bits)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket[:, t].view(np.int64), *cols)], ["bucket", *_NAMES])

    def meet(task: pa.Table) -> pa.Table:
        part, *cols = (task[c].to_numpy() for c in ["part", *_NAMES])
        order = np.argsort(part, kind="stable")
        left = int((part == part.min()).sum())
        u, v = (x.view(np.int64) for x in shard_edges(*(c[order].view(U) for c in cols), left, radius, confirm))
        return pa.table({"u": np.maximum(u, v), "v": np.minimum(u, v)})

    entries = prints.select(*_NAMES).mapInArrow(keyed, "bucket long, node long, lo long, hi long, grams long")
    # Blocks i <= j of a shard meet in task (bucket, i, j); all but the largest shards have one block.
    large = entries.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = cut(large.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    sized = entries.join(large, "bucket", "left") if not large.isEmpty() else entries.withColumn("blocks", F.lit(1))
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tasks = dealt.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", *_NAMES)
    # Entries are small and what they cost isn't: by size alone shards would be put together into a few long tasks.
    many = max(prints.sparkSession.sparkContext.defaultParallelism, min(tables << key_bits, TASKS))
    return tasks.repartition(many, "bucket", "i", "j").groupBy("bucket", "i", "j").applyInArrow(meet, "u long, v long").distinct()


# -- groups -----------------------------------------------------------------


def find_groups(docs: DataFrame, radius: int = RADIUS, confirm: int = CONFIRM) -> DataFrame:
    """(doc_id, copy, times, root, keep_id, stays): each distinct (id, text) with its group, and
    whether it is the one that stays."""
    rows = cut(_prints(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "copy")).alias("first")
    prints = cut(rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("lo", "hi", "grams")), F.min("words").alias("words"), first))
    roots = connected_components(near_edges(prints.where("words > 0"), radius, confirm))
    placed = prints.select("node", "first").join(roots.withColumnRenamed("id", "node"), "node", "left")
    placed = placed.select("node", F.coalesce("root", "node").alias("root"), "first")
    keepers = placed.groupBy("root").agg(F.min("first").alias("keep"))
    groups = placed.select("node", "root").join(keepers, "root")
    counted = rows.groupBy("doc_id", "copy", "node").agg(F.count("*").alias("times")).join(groups, "node")
    stays = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("copy") == F.col("keep.copy"))
    return counted.select("doc_id", "copy", "times", "root", F.col("keep.doc_id").alias("keep_id"), stays.alias("stays"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, confirm: int = CONFIRM) -> DataFrame:
    """(doc_id, group_id, copies, kept) of every row of docs.

    group_id is the doc_id that stays; copies is the number of rows of the
    group. Of rows that share the id that stays, one is kept. Null text:
    group_id is the row's own id, copies 1, kept.
    """
    each = find_groups(docs, radius, confirm)
    size = each.groupBy("root").agg(F.sum("times").alias("copies"))
    rows = each.join(size, "root").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    found = rows.select("doc_id", F.col("keep_id").alias("group_id"), "copies", (F.col("stays") & (F.col("k") == 1)).alias("kept"))
    blank = docs.where("text is null").select("doc_id", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("copies"), F.lit(True).alias("kept"))
    return found.unionByName(blank)


def drop_copies(docs: DataFrame, radius: int = RADIUS, confirm: int = CONFIRM) -> DataFrame:
    """docs with one row of each group, all columns kept.

    Rows that go are named by (doc_id, hash of the text), so texts are
    fingerprinted once; only where several rows share both is one of them picked.
    """
    each = find_groups(docs, radius, confirm)
    copy, its_id, its_copy, one = (K.fresh(docs.columns, x) for x in ("copy", "goes_id", "goes_copy", "one"))
    goes = each.where(~F.col("stays") | (F.col("times") > 1)).select(F.col("doc_id").alias(its_id), F.col("copy").alias(its_copy), F.col("stays").alias(one))
    marked = docs.withColumn(copy, F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    joined = marked.join(goes, marked["doc_id"].eqNullSafe(goes[its_id]) & (marked[copy] == goes[its_copy]), "left")
    names = [f"`{c}`" for c in docs.columns]
    plain = joined.where(f"`{one}` is null").select(*names)
    return plain.unionByName(joined.where(f"`{one}`").dropDuplicates(["doc_id", copy]).select(*names))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
