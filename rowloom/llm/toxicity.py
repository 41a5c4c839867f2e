"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training is one online pass in one task over a bounded, hash-ordered sample of
the labelled documents (``TRAIN_ROWS``, the documented bound); each coordinate
has its own learning rate and L1 keeps most weights at exactly zero, so what is
broadcast for scoring is the sparse remainder, at most a few thousand pairs.
Scoring reads every document whole, in one map-only pass.

Defined cases. Null or empty text: no features, the score is the bias alone.
Null doc_id: scored like any other, but it can't be trained on. Repeated rows:
each scored. A document labelled more than once counts as toxic if any label
says so; null labels are ignored. No labels at all: every score is 0 and nothing
is toxic; toxic means score > threshold. Columns beyond doc_id and text are
carried through by ``drop_toxic`` and ignored else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import table

BITS = 22
TRAIN_ROWS = 30_000
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 0.5
NGRAM, SKIP = 2, 1
THRESHOLD = 0.2
UNTRAINED = float("-inf")  # the bias of a model without training rows


def features(column: pa.Array, bits: int = BITS, ngram: int = NGRAM, skip: int = SKIP) -> tuple[np.ndarray, np.ndarray]:
    """(document in chunk, hashed feature) of each n-gram of up to ``ngram`` words and
    each pair of words with 1 to ``skip`` words between them. Repeats are kept."""
    w = K.words_of(column)
    shift = np.uint64(64 - bits)
    docs, feats = [w.doc], [w.hash >> shift]
    gram, n = w.hash, len(w.hash)
    for k in range(1, ngram):
        gram = K.mix(gram[: n - k] * np.uint64(3) + w.hash[k:]) if n > k else gram[:0]
        same = w.doc[: max(n - k, 0)] == w.doc[k:]
        docs.append(w.doc[k:][same])
        feats.append(gram[same] >> shift)
    for gap in range(2, skip + 2):
        same = w.doc[: max(n - gap, 0)] == w.doc[gap:]
        pair = K.mix(w.hash[: max(n - gap, 0)] * np.uint64(2 * gap + 1) + w.hash[gap:] + np.uint64(gap))
        docs.append(w.doc[gap:][same])
        feats.append(pair[same] >> shift)
    return np.concatenate(docs), np.concatenate(feats).astype(np.uint32)


class Ftrl:
    """FTRL-proximal (McMahan et al., 2013) for binary presence features and a bias."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.bias = 1 << bits
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weight(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        l1 = np.where(at == self.bias, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / rate)

    def learn(self, feats: np.ndarray, label: int) -> None:
        at = np.append(feats.astype(np.int64), self.bias)
        w = self.weight(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        at = np.flatnonzero(np.abs(self.z[:-1]) > self.l1)
        return at.astype(np.uint32), self.weight(at).astype(np.float32), float(self.weight(np.array([self.bias]))[0])


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of the ``rows`` labelled documents whose ids hash lowest."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = known.select("doc_id", "toxic", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(rows)
    # ``rows`` ids at most, whatever the size of the tables: safe to broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text is not null")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias), non-zero weights only."""

    def prepare(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, feat = features(K.column_of(batch, "text"))
        doc, feat, _ = K.distinct_pairs(doc, feat)
        blobs = [x.tobytes() for x in np.split(feat, np.searchsorted(doc, np.arange(1, batch.num_rows)))]
        return pa.RecordBatch.from_arrays(
            [K.column_of(batch, "h"), K.column_of(batch, "toxic").cast(pa.int32()), pa.array(blobs, pa.binary())], ["h", "toxic", "feats"]
        )

    def fit(batches):
        model, seen = Ftrl(), 0
        for batch in batches:
            seen += batch.num_rows
            for toxic, blob in zip(K.column_of(batch, "toxic").to_pylist(), K.column_of(batch, "feats"), strict=True):
                model.learn(np.frombuffer(blob.as_py(), np.uint32), int(toxic > 0))
        at, w, bias = model.sparse() if seen else (np.zeros(0, np.uint32), np.zeros(0, np.float32), UNTRAINED)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (at.tobytes(), w.tobytes(), np.float64(bias).tobytes())], ["at", "w", "bias"])

    ready = training_sample(docs, labels, rows).mapInArrow(K.by_chunk(prepare), "h long, toxic int, feats binary")
    one = ready.repartition(1).sortWithinPartitions("h").mapInArrow(fit, "at binary, w binary, bias binary").first()
    if one is None:
        return np.zeros(0, np.uint32), np.zeros(0, np.float32), UNTRAINED
    return np.frombuffer(one["at"], np.uint32), np.frombuffer(one["w"], np.float32), float(np.frombuffer(one["bias"])[0])


def chunk_scores(column: pa.Array, weights: np.ndarray, bias: float, bits: int = BITS) -> np.ndarray:
    doc, feat = features(column, bits)
    hit = np.flatnonzero(weights[feat] != 0)
    doc, feat, _ = K.distinct_pairs(doc[hit], feat[hit])
    total = np.bincount(doc, weights[feat].astype(np.float64), len(column)) + bias
    return np.where(total == UNTRAINED, 0.0, 1 / (1 + np.exp(-np.clip(total, -35, 35))))


def _scorer(spark: SparkSession, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS):
    shared = spark.sparkContext.broadcast(model)
    made: dict[str, np.ndarray] = {}

    def score(column: pa.Array) -> np.ndarray:
        at, w, bias = shared.value
        if "dense" not in made:
            made["dense"] = np.zeros(1 << bits, np.float32)
            made["dense"][at] = w
        return chunk_scores(column, made["dense"], bias, bits)

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, score, toxic) of every row of docs."""
    score = _scorer(docs.sparkSession, train(docs, labels, rows))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = score(K.column_of(batch, "text"))
        return pa.RecordBatch.from_arrays([K.column_of(batch, "doc_id"), pa.array(s), pa.array(s > threshold)], ["doc_id", "score", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(K.by_chunk(work), f"doc_id {kind}, score double, toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that aren't toxic, with all their columns."""
    score = _scorer(docs.sparkSession, train(docs, labels, rows))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(score(K.column_of(batch, "text")) <= threshold))

    return docs.mapInArrow(K.by_chunk(work), docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
