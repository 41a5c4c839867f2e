"""Toxicity, language and quality: held-out accuracy, brute-force scores, odd cases."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowloom.llm import kernels as K
from rowloom.llm import langid, quality_crf, toxicity

from .conftest import strings

BAD = ["idiot", "scum", "trash"]


def corpus(n, seed):
    """(doc_id, text, toxic): random words, with a bad one in every fourth text."""
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(400)])
    out = []
    for i in range(n):
        ws = rng.choice(words, rng.integers(5, 60)).tolist()
        toxic = int(i % 4 == 0)
        if toxic:
            ws.insert(int(rng.integers(0, len(ws))), BAD[int(rng.integers(0, 3))])
        out.append((seed * 100_000 + i, " ".join(ws), toxic))
    return out


def test_toxicity_held_out(spark):
    train, test = corpus(1500, 1), corpus(400, 2)
    docs = spark.createDataFrame([r[:2] for r in train + test], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in train], "doc_id long, toxic int")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score_toxicity(docs, labels).collect()}
    hit = [got[i] == bool(t) for i, _, t in test]
    assert np.mean(hit) > 0.98
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, labels).select("doc_id").collect()}
    assert kept == {i for i, t in got.items() if not t}


def test_ftrl_is_the_published_update():
    model = toxicity.Ftrl(bits=4, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    z, n = {}, {}
    for feats, y in [([1, 3], 1), ([3, 5], 0), ([1], 1), ([], 0)]:
        w = {}
        for i in [*feats, 16]:
            l1 = 0.0 if i == 16 else 0.1
            zi = z.get(i, 0.0)
            w[i] = 0.0 if abs(zi) <= l1 else (math.copysign(l1, zi) - zi) / ((1.0 + math.sqrt(n.get(i, 0.0))) / 0.5 + 0.2)
        p = 1 / (1 + math.exp(-sum(w.values())))
        for i in w:
            g, old = p - y, n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / 0.5 * w[i]
            n[i] = old + g * g
        model.learn(np.array(feats, np.uint32), y)
    assert np.allclose([model.z[i] for i in z], list(z.values()))


def test_toxic_features_are_ngrams_and_skipgrams():
    doc, feat = toxicity.features(strings("a b c", "c", None, ""))
    assert np.bincount(doc, minlength=4).tolist() == [3 + 2 + 1, 1, 0, 0]
    assert len(set(feat[doc == 0].tolist())) == 6


def test_toxicity_odd_cases(odd, none, odd_labels):
    scored = toxicity.score_toxicity(odd, odd_labels).collect()
    assert len(scored) == odd.count()
    assert all(0 <= r["score"] <= 1 for r in scored)
    blank = {r["score"] for r in scored if r["doc_id"] in (0, 1, 2, 3)}
    assert len(blank) == 1
    assert toxicity.drop_toxic(odd, odd_labels).columns == odd.columns
    assert toxicity.score_toxicity(none, odd_labels).isEmpty()
    unlabelled = toxicity.score_toxicity(odd, odd_labels.where("false"))
    assert {r["score"] for r in unlabelled.collect()} == {0.0}
    assert unlabelled.where("toxic").isEmpty()


# -- language ---------------------------------------------------------------------


def test_language_held_out(spark, data):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = docs.where("doc_id % 2 = 0").unionByName(docs.where("doc_id % 2 = 1").withColumn("lang", F.lit(None).cast("string")))
    got = {r["doc_id"]: r for r in langid.identify(known).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.where("doc_id % 2 = 1").collect()}
    assert np.mean([got[i]["language"] == lang for i, lang in truth.items()]) > 0.95
    assert np.mean([got[i]["rejected"] for i in truth]) < 0.01


def kernel(a: str, b: str) -> float:
    grams = [{x.lower().encode()[i : i + n] for n in (1, 2, 3) for i in range(len(x.encode()) - n + 1)} for x in (a, b)]
    return len(grams[0] & grams[1]) / math.sqrt(len(grams[0]) * len(grams[1])) if all(grams) else 0.0


def test_language_scores_are_kernel_ridge():
    sample = [("de", "der die das und"), ("de", "ist nicht und der"), ("en", "the and of that"), ("en", "with the of this")]
    model = langid.fit(sample, landmarks=2, ridge=0.1)
    marks = [t for _, t in sample]
    m = np.array([[kernel(a, b) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(m)
    root = vector / np.sqrt(value)
    target = np.array([[1, -1], [1, -1], [-1, 1], [-1, 1]], float)
    phi = m @ root
    c, y = phi - phi.mean(0), target - target.mean(0)
    beta = np.linalg.solve(c.T @ c + 0.1 * 4 / 100 * np.eye(4), c.T @ y)
    place = np.full(4 << 24, -1, np.int32)
    place[model.codes] = np.arange(len(model.codes))
    texts = ["the und", "dieser Hund", "Ж", ""]
    want = [np.array([kernel(t, b) for b in marks]) @ root @ beta + target.mean(0) - phi.mean(0) @ beta for t in texts[:2]]
    got = langid.chunk_scores(strings(*texts), model, place)
    assert np.allclose(got[:2], want, atol=1e-4)
    assert (got[2:] == langid.NOTHING).all()


def test_language_odd_cases(odd, none):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count()
    assert all(r["rejected"] and r["language"] is None for r in got if r["doc_id"] in (0, 1))
    assert langid.keep_known(odd).columns == odd.columns
    assert langid.identify(none).isEmpty()
    assert langid.keep_known(none).isEmpty()
    unlabelled = langid.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert unlabelled.where("not rejected or language is not null").isEmpty()


# -- quality ----------------------------------------------------------------------


def brute_marginals(doc, emit, trans):
    out = np.zeros(len(doc))
    for d in np.unique(doc):
        at = np.flatnonzero(doc == d)
        total = np.zeros(len(at))
        z = 0.0
        for k in range(1 << len(at)):
            y = [(k >> i) & 1 for i in range(len(at))]
            w = math.exp(sum(emit[a] * v for a, v in zip(at, y, strict=True)) + sum(trans[p, q] for p, q in zip(y, y[1:], strict=False)))
            z += w
            total += np.array(y) * w
        out[at] = total / z
    return out


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    doc = np.repeat([0, 1, 2, 3], [1, 5, 3, 8])
    emit, trans = rng.standard_normal(17), rng.standard_normal((2, 2))
    good, pair, _ = quality_crf.forward_backward(doc, emit, trans)
    assert np.allclose(good, brute_marginals(doc, emit, trans))
    assert np.isclose(pair.sum(), 17 - 4)


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_crf.score_quality(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("y")), "doc_id")
    rows = got.where("n_lines > 0").collect()
    assert np.mean([r["kept"] for r in rows if r["y"] == 1]) > 0.95
    assert np.mean([not r["kept"] for r in rows if r["y"] == 0]) > 0.7


def test_quality_odd_cases(odd, none, odd_labels):
    got = {r["doc_id"]: r for r in quality_crf.score_quality(odd, odd_labels).collect()}
    assert all(got[i]["quality"] is None and got[i]["n_lines"] == 0 and not got[i]["kept"] for i in (0, 1, 2))
    assert got[9]["n_lines"] == 4
    assert quality_crf.score_quality(odd, odd_labels).count() == odd.count()
    assert quality_crf.score_quality(none, odd_labels).isEmpty()
    one_kind = quality_crf.score_quality(odd, odd_labels.where("quality = 1"))
    assert {r["quality"] for r in one_kind.collect()} == {None, 1.0}


@pytest.mark.parametrize("text", ["a\nb", "\n\na\n", "é\n\nÉÉ!!\n"])
def test_lines(text):
    doc, chars, feats = quality_crf.lines_of(pa.array([text, None, text]))
    lines = [x for x in text.split("\n") if x.strip()]
    assert chars.tolist() == [len(x) for x in lines] * 2
    assert doc.tolist() == [0] * len(lines) + [2] * len(lines)
    assert np.isfinite(feats).all()
    assert K.CHUNK_BYTES > 0


def test_every_label_gets_a_model(spark):
    rows = [(i, f"tag-{i % 300}", f"text{i % 300} of label {i % 300}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.fit(langid.training_sample(docs))
    assert model.langs == sorted({r[1] for r in rows})
