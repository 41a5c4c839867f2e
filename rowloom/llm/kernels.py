"""Vectorised text kernels over Arrow string buffers, shared by the operators.

Everything here works on a chunk: a slice of an Arrow batch whose text is at
most ``CHUNK_BYTES`` long (a single longer document is a chunk by itself), so
a Python worker's memory doesn't follow the batch. Texts are never cut.

A *word* is a maximal run of ASCII letters, digits and non-ASCII bytes of the
lower-cased text; a null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_BYTE = np.random.default_rng(20_231).integers(1, 1 << 63, 256, dtype=np.uint64)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2**64, n + 1 of each."""
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        made = []
        for base in (_MULT, _INV):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection on 64-bit words."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if lower:
        column = pc.utf8_lower(column)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunk_bounds(column: pa.Array, most: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """(from, to) row ranges with at most ``most`` bytes and ``rows`` rows, one row at least."""
    n = len(column)
    size = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size.astype(np.int64))
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        to = min(to, at + rows, n)
        yield at, to
        at = to


def range_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; equal bytes have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a chunk: ``doc`` (index in the chunk), ``start``, ``end``, ``hash``."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, hashed: bool = True):
        self.n_docs = len(offs) - 1
        inside = np.zeros(len(buf) + 2, bool)
        inside[1:-1] = _WORD[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[offs] = True
        left, right = inside[:-1], inside[1:]
        self.start = np.flatnonzero(right & (edge | ~left))
        self.end = np.flatnonzero(left & (edge | ~right))
        per_doc = np.searchsorted(self.start, offs)
        self.bound = per_doc
        self.count = np.diff(per_doc)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)
        self.hash = range_hash(buf, self.start, self.end) if hashed else None


def words_of(column: pa.Array) -> Words:
    return Words(*text_buffer(column, lower=True))


def distinct_pairs(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, value), sorted by both, and how often each occurs. doc is not falling."""
    if not len(doc):
        return doc, value, np.zeros(0, np.int64)
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(first)
    return d[at], v[at], np.diff(np.append(at, len(d)))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def fresh(taken: list[str], name: str) -> str:
    """name, with underscores before it until no column has it, whatever the case."""
    low = {x.lower() for x in taken}
    while (name := f"_{name}").lower() in low:
        pass
    return name


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array with counts[i] of the values in row i."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def by_chunk(
    work: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str = "text", most: int = CHUNK_BYTES, rows: int = 1 << 30
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that applies ``work`` to chunks of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in chunk_bounds(column_of(batch, text), most, rows):
                out = work(batch.slice(at, to - at))
                if out is not None and out.num_rows:
                    yield out

    return run
