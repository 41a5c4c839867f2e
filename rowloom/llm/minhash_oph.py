"""Document fingerprints: one-permutation MinHash with optimal densification.

Each shingle of ``SHINGLE`` words (the whole text if it is shorter) is hashed
once: the high bits choose one of ``BINS`` bins, the rest is the value, and a
bin keeps its least. An empty bin takes the value of another: a hash of (bin,
attempt), the same for all documents, names candidates until one that isn't
empty turns up (Shrivastava 2017), so equal sets agree in every bin and the
estimate stays unbiased with the least variance. The ``BITS`` lowest bits of
each value are packed side by side.

Two fingerprints agree by chance in a bin with probability 2**-BITS, so with
the share of agreeing bins m the similarity is (m - 2**-b) / (1 - 2**-b), at
least 0 (``similarity``, on columns, JVM-side).

Defined cases. Null or empty text, or one without a word: no shingle, a null
fingerprint, n_shingles 0, filled 0; its similarity with anything is null.
Null doc_id and repeated rows: one result row each. Empty table: empty result.
Extra columns are ignored. Texts are hashed whole, whatever their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import table

SHINGLE, BINS, BITS = 5, 256, 8
U = np.uint64


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document in chunk, hash) of each shingle, documents in order; repeats are kept."""
    w = K.words_of(column)
    if not len(w.hash):
        return w.doc, w.hash
    h = w.hash * U(1)
    # The run of words that begins at each word and ends with its document at the latest.
    reach = np.minimum(np.arange(len(h)) + size, w.bound[1:][w.doc]) - np.arange(len(h))
    total = np.zeros(len(h), U)
    for k in range(size):
        inside = reach > k
        at = np.flatnonzero(inside)
        total[at] = K.mix(total[at] * U(3) + h[at + k])
    whole = (reach == size) | (np.arange(len(h)) == w.bound[:-1][w.doc])
    return w.doc[whole], total[whole]


def donors(bins: int) -> "np.ndarray":
    """An endless sequence of candidate bins for each bin, as a function of the attempt."""

    def at(which: np.ndarray, attempt: int) -> np.ndarray:
        return (K.mix(which.astype(U) * U(0x9E3779B97F4A7C15) + U(attempt)) % U(bins)).astype(np.int64)

    return at


def densified(doc: np.ndarray, value: np.ndarray, n_docs: int, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(documents x bins values, which were filled at first). A document without any shingle stays empty."""
    least = np.full(n_docs * bins, np.iinfo(np.uint64).max, U)
    slot = doc * bins + ((value >> U(32)) * U(bins) >> U(32)).astype(np.int64)
    order = np.lexsort((value, slot))
    slot, value = slot[order], value[order]
    first = np.append(True, slot[1:] != slot[:-1]) if len(slot) else np.zeros(0, bool)
    least[slot[first]] = value[first]
    filled = np.zeros(n_docs * bins, bool)
    filled[slot[first]] = True
    some = np.repeat(filled.reshape(n_docs, bins).any(1), bins)
    open_, donor, attempt = np.flatnonzero(~filled & some), donors(bins), 0
    while len(open_):
        at = open_ // bins * bins + donor(open_ % bins, attempt)
        got = filled[at]
        least[open_[got]] = least[at[got]]
        open_, attempt = open_[~got], attempt + 1
    return least.reshape(n_docs, bins), filled.reshape(n_docs, bins)


def pack_bits(values: np.ndarray, bits: int) -> list[bytes]:
    low = (K.mix(values) & U((1 << bits) - 1)).astype(np.uint16)
    planes = (low[:, :, None] >> np.arange(bits, dtype=np.uint16)) & np.uint16(1)
    packed = np.packbits(planes.reshape(len(values), -1).astype(np.uint8), axis=1, bitorder="little")
    return [x.tobytes() for x in packed]


def fingerprint(docs: DataFrame, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint, n_shingles, filled): filled is the number of bins that had a shingle."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        doc, value = shingles(K.column_of(batch, "text"), shingle)
        least, filled = densified(doc, value, n, bins)
        count = np.bincount(doc, minlength=n)
        prints = pa.array([x if c else None for x, c in zip(pack_bits(least, bits), count, strict=True)], pa.binary())
        cols = [K.column_of(batch, "doc_id"), prints, pa.array(count), pa.array(filled.sum(1).astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "fingerprint", "n_shingles", "filled"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, fingerprint binary, n_shingles long, filled int"
    return docs.select("doc_id", "text").mapInArrow(K.by_chunk(work, rows=2048), out)


def similarity(a: str, b: str, bins: int = BINS, bits: int = BITS) -> Column:
    """The bias-corrected Jaccard estimate of two fingerprint columns, from whole bytes (BITS 8)
    or bit groups; null if either is null."""
    width = bins * bits // 8
    if bits == 8:
        same = [(F.substring(a, i + 1, 1) == F.substring(b, i + 1, 1)).cast("int") for i in range(width)]
        m = sum(same[1:], same[0]) / F.lit(float(bins))
    else:
        raise ValueError("similarity on columns is for 8 bits; use estimate() otherwise")
    chance = 2.0**-bits
    return F.greatest(F.lit(0.0), (m - chance) / (1 - chance))


def estimate(a: bytes, b: bytes, bins: int = BINS, bits: int = BITS) -> float:
    """The bias-corrected Jaccard estimate of two fingerprints."""
    x, y = (np.unpackbits(np.frombuffer(v, np.uint8), bitorder="little")[: bins * bits].reshape(bins, bits) for v in (a, b))
    m, chance = (x == y).all(1).mean(), 2.0**-bits
    return max(0.0, float((m - chance) / (1 - chance)))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))
