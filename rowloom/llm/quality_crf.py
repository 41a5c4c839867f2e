"""Document quality from a linear-chain CRF over lines.

Each line is labelled good or bad. Features of a line are its own shape (length,
capitals, digits, punctuation, symbols, table bars, word length, repetition)
and those of the lines before and after it; a transition matrix ties
neighbouring labels. Forward-backward gives each line's probability to be good
given the whole document; their mean, weighted by line length, is the
document's quality.

Training is on at most ``TRAIN_DOCS`` labelled documents, those whose ids hash
lowest (the documented bound), cut into at most ``TRAIN_LINES`` lines before
anything reaches the driver (a document that would exceed that is left out). Labels are
per document, so lines start with their document's label; after a first fit the
lines of bad documents that the model calls good are relabelled (the worst line
of a document stays bad) and the model is fitted again, ``ROUNDS`` times.
Scoring covers every line of every document.

Defined cases. Null or empty text: no line, quality null, n_lines 0, kept false.
Blank lines are no lines. Null doc_id: scored, never trained on. Repeated rows:
each scored. Conflicting labels: a document is bad if any label says so. No
labels, or only one kind: quality 1.0 for every document with a line. Ties with
the threshold are kept. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import table

TRAIN_DOCS, TRAIN_LINES, ROUNDS = 6_000, 40_000, 2
THRESHOLD = 0.4

_CLASS = np.zeros((256, 7), np.float32)  # upper, lower, digit, space, punctuation, symbol, bar
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = (
        "A" <= _ch <= "Z", "a" <= _ch <= "z", _ch.isdigit() and _c < 128, _ch in " \t\r", _ch in ".,;:'\"()-?!", _c < 128 and _c > 32 and not _ch.isalnum() and _ch not in ".,;:'\"()-?!|", _ch == "|",
    )
OWN = ["bias", "log_length", "upper", "digit", "punctuation", "exclamation", "symbol", "bar", "space", "word_length", "repeated", "short", "no_end"]


def lines_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document in chunk, characters, features) of each line that isn't blank, in order."""
    buf, offs = K.text_buffer(column)
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros((0, len(OWN)))
    newline = buf == 10
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    edge[np.flatnonzero(newline) + 1] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(buf))
    start, end = start[start < end], end[start < end]
    lead = (buf & 0xC0) != 0x80
    lead &= ~newline

    def count(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, start, dtype=np.int64).astype(np.float64)

    chars, space = count(lead), count(_CLASS[buf, 3] > 0)
    two = np.append(buf[1:], 0).astype(np.int64)
    capital = (_CLASS[buf, 0] > 0) | ((buf == 0xC3) & (two >= 0x80) & (two <= 0x9E)) | ((buf == 0xD0) & (two >= 0x90) & (two <= 0xAF))
    small = (_CLASS[buf, 1] > 0) | ((buf == 0xC3) & (two >= 0x9F)) | ((buf >= 0xD0) & (buf <= 0xD1) & lead & ~capital)
    capitals, smalls = count(capital), count(small)
    line_start = np.append(start, len(buf))
    w = K.Words(buf, line_start)
    words = np.maximum(w.count, 1)
    distinct = np.bincount(K.distinct_pairs(w.doc, w.hash)[0], minlength=len(start))
    body = np.maximum(chars - space, 1)
    last = end - 1 - newline[end - 1]
    ended = np.isin(buf[np.maximum(last, start)], np.frombuffer(b".?!:\"')", np.uint8)) | (buf[np.maximum(last, start)] >= 128)
    feats = np.stack(
        [
            np.ones(len(start)), np.log1p(chars) / 5, capitals / np.maximum(capitals + smalls, 1), count(_CLASS[buf, 2] > 0) / body,
            count(_CLASS[buf, 4] > 0) / body, count(buf == 33) / body * 5, count(_CLASS[buf, 5] > 0) / body * 3, count(buf == 124) / body * 5,
            space / np.maximum(chars, 1), np.minimum(body / words, 30) / 10, 1 - distinct / words, chars < 20, ~ended,
        ],
        axis=1,
    )
    doc = np.searchsorted(offs, start, "right") - 1
    there = chars - space > 0
    return doc[there], chars[there], feats[there]


def with_neighbours(doc: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Each line's features, then the previous line's, then the next line's; zeros beyond the document."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = (doc[1:] == doc[:-1])[:, None]
    before[1:] = own[:-1] * same
    after[:-1] = own[1:] * same
    return np.concatenate([own, before, after], 1)


def forward_backward(doc: np.ndarray, emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(good) of each line, sums of pair marginals, log partition), label 1 is good.

    emit: scores of label 1 against 0; trans: 2 x 2 scores. Documents advance
    together, a line at a time, those that have ended dropping out.
    """
    n = len(doc)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    size = np.diff(np.append(first, n))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    active = np.searchsorted(-size, -np.arange(size[0]), "left")  # documents with more than t lines
    e = np.stack([np.zeros(n), emit], 1)
    alpha, beta = np.empty((n, 2)), np.zeros((n, 2))
    alpha[first] = e[first]
    for t in range(1, size[0]):
        at = first[: active[t]] + t
        s = alpha[at - 1][:, :, None] + trans
        alpha[at] = np.logaddexp(s[:, 0], s[:, 1]) + e[at]
    for t in range(size[0] - 2, -1, -1):
        at = first[: active[t + 1]] + t
        s = trans + (e[at + 1] + beta[at + 1])[:, None, :]
        beta[at] = np.logaddexp(s[:, :, 0], s[:, :, 1])
    z = np.logaddexp(alpha[first + size - 1, 0], alpha[first + size - 1, 1])
    of = np.empty(n)
    of[np.repeat(first, size) + np.arange(n) - np.repeat(np.cumsum(size) - size, size)] = np.repeat(z, size)
    good = np.exp(alpha[:, 1] + beta[:, 1] - of)
    inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    pair = np.exp(alpha[inner - 1][:, :, None] + trans + (e[inner] + beta[inner])[:, None, :] - of[inner, None, None]).sum(0)
    return np.clip(good, 0, 1), pair, float(z.sum())


@dataclass
class Crf:
    weight: np.ndarray
    trans: np.ndarray

    def marginals(self, doc: np.ndarray, own: np.ndarray) -> np.ndarray:
        return forward_backward(doc, with_neighbours(doc, own) @ self.weight, self.trans)[0]


def fit_crf(doc: np.ndarray, x: np.ndarray, label: np.ndarray, steps: int = 150, ridge: float = 1e-3, start: Crf | None = None) -> Crf:
    """Maximum likelihood by Adam on the mean gradient of a line; x has the neighbours' features."""
    d = x.shape[1]
    theta = np.concatenate([start.weight, start.trans.ravel()]) if start else np.zeros(d + 4)
    inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[inner - 1], label[inner]), 1)
    held = x.T @ label
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        good, pair, _ = forward_backward(doc, x @ theta[:d], theta[d:].reshape(2, 2))
        g = np.concatenate([x.T @ good - held, (pair - seen).ravel()]) / len(doc) + ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Crf(theta[:d], theta[d:].reshape(2, 2))


def fit(doc: np.ndarray, own: np.ndarray, quality: np.ndarray, rounds: int = ROUNDS) -> Crf | None:
    """quality: 0 or 1 of each line's document."""
    if not len(doc) or quality.min() == quality.max():
        return None
    x, label, model = with_neighbours(doc, own), quality.astype(np.int64).copy(), None
    for k in range(rounds + 1):
        model = fit_crf(doc, x, label, 150 if k == 0 else 60, start=model)
        p = model.marginals(doc, own)
        label = np.where(quality == 1, 1, (p > 0.5).astype(np.int64))
        # A bad document has a bad line: its worst.
        order = np.lexsort((p, doc))
        worst = order[np.append(True, doc[order][1:] != doc[order][:-1])]
        label[worst[quality[worst] == 0]] = 0
    return model


def document_quality(n_docs: int, doc: np.ndarray, chars: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(quality, lines) of each document; nan without a line."""
    total = np.bincount(doc, chars, n_docs)
    with np.errstate(invalid="ignore"):
        return np.bincount(doc, chars * good, n_docs) / np.where(total > 0, total, np.nan), np.bincount(doc, minlength=n_docs)


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Crf | None:
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = known.select("doc_id", "quality", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(most)
    # ``most`` ids: safe to broadcast at any size. Their lines' features come to the driver, not their texts.
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text is not null")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, _, own = lines_of(K.column_of(batch, "text"))
        cut = np.searchsorted(doc, np.arange(1, batch.num_rows))
        blobs = pa.array([x.astype(np.float32).tobytes() for x in np.split(own, cut)], pa.binary())
        return pa.RecordBatch.from_arrays([K.column_of(batch, "h"), K.column_of(batch, "quality").cast(pa.int32()), blobs], ["h", "quality", "own"])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = 0
        for batch in batches:
            size = pc.binary_length(K.column_of(batch, "own")).to_numpy() // (4 * len(OWN))
            keep = np.zeros(len(size), bool)
            for i, n in enumerate(size.tolist()):
                if lines + n <= TRAIN_LINES:
                    keep[i], lines = True, lines + n
            yield batch.filter(pa.array(keep))

    # One task sees the sample's features, whatever its texts' lengths; TRAIN_LINES lines come here.
    made = sample.mapInArrow(K.by_chunk(work), "h long, quality int, own binary")
    rows = made.repartition(1).sortWithinPartitions("h", "own").mapInArrow(bounded, made.schema).collect()
    docs_, owns, quality = [], [], []
    for i, r in enumerate(rows):
        own = np.frombuffer(r["own"], np.float32).reshape(-1, len(OWN)).astype(np.float64)
        docs_.append(np.full(len(own), i))
        owns.append(own)
        quality.append(np.full(len(own), int(r["quality"] > 0)))
    return fit(np.concatenate(docs_), np.concatenate(owns), np.concatenate(quality)) if sum(map(len, owns)) else None


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, quality, n_lines, kept) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, chars, own = lines_of(K.column_of(batch, "text"))
        model = shared.value
        good = model.marginals(doc, own) if model else np.ones(len(doc))
        q, n = document_quality(batch.num_rows, doc, chars, good)
        cols = [K.column_of(batch, "doc_id"), pa.array(q, mask=n == 0), pa.array(n), pa.array(np.nan_to_num(q, nan=-1) >= threshold)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "quality", "n_lines", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(K.by_chunk(work), f"doc_id {kind}, quality double, n_lines long, kept boolean")


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
