"""Language identification with a string kernel.

The kernel is the blended-spectrum presence kernel over UTF-8 byte n-grams of
the lower-cased text, n = 1 to 3: k(x, y) counts the n-grams present in both,
divided by the root of k(x, x) k(y, y). A Nystrom map through ``LANDMARKS``
landmarks a language turns it into one-versus-rest kernel ridge regression that
is trained on a bounded, hash-ordered sample (``TRAIN_PER_LANG`` documents a
language, the documented bound, kept before anything reaches the driver; every
label of the table gets a model, so the driver's memory grows with the number of
labels). Since k(x, landmark) is a product of presence
rows, all landmark columns and regression weights fold into one matrix; scoring
is presence matrix times that matrix, a batch at a time, over whole texts.

A document is *rejected* when no one-versus-rest score exceeds ``MIN_SCORE``:
no known language claims it.

Defined cases. Null or empty text, or one without any n-gram of a landmark:
every score -1, language null, rejected. Null lang or doc_id: scored like any other row, never trained on.
Ties: the alphabetically first language. Repeated rows: each scored, trained on
once; rows that share an id but not a text are told apart by the text. An empty table, or one without any lang: language null and
rejected for every row. Extra columns are carried through by ``keep_known``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import table

TRAIN_PER_LANG, LANDMARKS = 400, 48
RIDGE, MIN_SCORE = 1e-2, -0.3
NOTHING = -1.0  # every score of a text that shares no n-gram with any landmark
GROUP = 128  # documents a batch of the matrix product


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, n-gram), n from 1 to 3, of at most 256 documents. An n-gram
    is coded as its bytes, with n in the highest of the four."""
    buf, offs = K.text_buffer(column, lower=True)
    doc = np.repeat(np.arange(len(offs) - 1, dtype=np.uint64), np.diff(offs)) << np.uint64(32)
    b = buf.astype(np.uint64)
    codes = []
    gram = np.zeros(len(b), np.uint64)
    for n in (1, 2, 3):
        m = max(len(b) - n + 1, 0)
        gram = (gram[:m] << np.uint64(8)) | b[n - 1 :]
        same = doc[:m] == doc[n - 1 :]
        key = (doc[:m] | np.uint64(n << 24) | gram)[same]
        key.sort()
        if len(key):
            key = key[np.append(True, key[1:] != key[:-1])]
        codes.append(key)
    key = np.concatenate(codes)
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # n-grams of the landmarks, sorted
    matrix: np.ndarray  # their rows: one column a language
    bias: np.ndarray


def _presence(texts: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Presence of each code in each text, and each text's number of distinct n-grams."""
    rows, sizes = [], []
    for at in range(0, len(texts), GROUP):
        part = pa.array(texts[at : at + GROUP], pa.string())
        doc, code = ngrams(part)
        sizes.append(np.bincount(doc, minlength=len(part)))
        where = np.searchsorted(codes, code)
        known = (where < len(codes)) & (codes[np.minimum(where, len(codes) - 1)] == code)
        p = np.zeros((len(part), len(codes)), np.float32)
        p[doc[known], where[known]] = 1
        rows.append(p)
    return np.concatenate(rows), np.concatenate(sizes)


def fit(sample: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """sample: (lang, text) in a fixed order; texts aren't empty."""
    langs = sorted({lang for lang, _ in sample})
    if not langs:
        return None
    by = {lang: [t for at, t in sample if at == lang] for lang in langs}
    marks = [t for lang in langs for t in by[lang][:landmarks]]
    codes = np.unique(np.concatenate([ngrams(pa.array(marks[i : i + GROUP], pa.string()))[1] for i in range(0, len(marks), GROUP)]))
    pm, sm = _presence(marks, codes)
    unit_m = pm / np.sqrt(np.maximum(sm, 1))[:, None]
    texts, truth = [t for lang in langs for t in by[lang]], np.repeat(np.arange(len(langs)), [len(by[lang]) for lang in langs])
    px, sx = _presence(texts, codes)
    k_xm = (px @ unit_m.T).astype(np.float64) / np.sqrt(np.maximum(sx, 1))[:, None]
    k_mm = (unit_m @ unit_m.T).astype(np.float64)
    value, vector = np.linalg.eigh(k_mm)
    good = value > 1e-6 * value[-1]
    nystrom = vector[:, good] / np.sqrt(value[good])
    phi = k_xm @ nystrom
    weight = 1 / np.bincount(truth)[truth]  # languages count alike
    weight *= len(truth) / weight.sum()
    target = np.where(truth[:, None] == np.arange(len(langs)), 1.0, -1.0)
    mean_phi, mean_y = np.average(phi, 0, weight), np.average(target, 0, weight)
    centred = phi - mean_phi
    beta = np.linalg.solve(centred.T @ (centred * weight[:, None]) + ridge * len(truth) / 100 * np.eye(phi.shape[1]), centred.T @ ((target - mean_y) * weight[:, None]))
    return Model(langs, codes, (unit_m.T.astype(np.float64) @ (nystrom @ beta)).astype(np.float32), mean_y - mean_phi @ beta)


def training_sample(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> list[tuple[str, str]]:
    """(lang, text) of the ``per_lang`` rows of each language that hash lowest, in that order."""
    h = F.xxhash64("doc_id", "lang", "text").alias("h")
    known = docs.where("doc_id is not null and lang is not null and text is not null and text != ''").select("lang", "text", h)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    first = known.select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= per_lang)
    last = first.groupBy("lang").agg(F.max("h").alias("h")).collect()
    if not last:
        return []
    limit = F.create_map(*[F.lit(x) for r in last for x in (r["lang"], r["h"])])
    rows = known.where(F.col("h") <= F.try_element_at(limit, F.col("lang"))).dropDuplicates(["lang", "h"]).collect()
    return [(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["lang"], r["h"]))]


def chunk_scores(column: pa.Array, model: Model, place: np.ndarray) -> np.ndarray:
    """Scores of at most 256 documents; place: each code's row of the matrix, or -1."""
    doc, code = ngrams(column)
    size = np.bincount(doc, minlength=len(column))
    at = place[code]
    known = at >= 0
    presence = np.zeros((len(column), len(model.codes)), np.float32)
    presence[doc[known], at[known]] = 1
    scores = (presence @ model.matrix).astype(np.float64) / np.sqrt(np.maximum(size, 1))[:, None] + model.bias
    scores[~presence.any(1)] = NOTHING
    return scores


def _scorer(spark: SparkSession, model: Model):
    shared = spark.sparkContext.broadcast(model)
    made: dict[str, np.ndarray] = {}

    def score(column: pa.Array) -> np.ndarray:
        if "place" not in made:
            made["place"] = np.full(4 << 24, -1, np.int16 if len(shared.value.codes) < 1 << 15 else np.int32)
            made["place"][shared.value.codes] = np.arange(len(shared.value.codes))
        return chunk_scores(column, shared.value, made["place"])

    return score


def identify(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, language, score, rejected) of every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    model = fit(training_sample(docs, per_lang))
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("string").alias("language"), F.lit(NOTHING).alias("score"), F.lit(True).alias("rejected"))
    score = _scorer(docs.sparkSession, model)
    names = np.array(model.langs, object)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = score(K.column_of(batch, "text"))
        best = s.max(1)
        language = pa.array(names[s.argmax(1)], pa.string(), mask=best == NOTHING)
        return pa.RecordBatch.from_arrays(
            [K.column_of(batch, "doc_id"), language, pa.array(best), pa.array(best <= min_score)], ["doc_id", "language", "score", "rejected"]
        )

    return docs.select("doc_id", "text").mapInArrow(
        K.by_chunk(work, rows=GROUP), f"doc_id {kind}, language string, score double, rejected boolean"
    )


def keep_known(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns."""
    model = fit(training_sample(docs, per_lang))
    if model is None:
        return docs.where(F.lit(False))
    score = _scorer(docs.sparkSession, model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(score(K.column_of(batch, "text")).max(1) > min_score))

    return docs.mapInArrow(K.by_chunk(work, rows=GROUP), docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
