"""The pipeline's rows against its definition, one document, pair and candidate at a time."""

import math
import re

import numpy as np

import corpus_pipeline
from rowloom.llm import langid, packing, pii, toxicity

from .conftest import strings
from .test_duplicates import brute_pairs, groups_of
from .test_packing import brute, packs_of, place


def toxic(text, model):
    at, w, bias = model
    weight = dict(zip(at.tolist(), w.tolist(), strict=True))
    _, feats = toxicity.features(strings(text))
    total = bias + sum(weight.get(f, 0.0) for f in set(feats.tolist()))
    return 1 / (1 + math.exp(-total)) > toxicity.THRESHOLD


def known(text, model):
    data = text.lower().encode()
    grams = {data[i : i + n] for n in (1, 2, 3) for i in range(len(data) - n + 1)}
    row = {int(c): k for k, c in enumerate(model.codes)}
    held = [row[c] for g in grams if (c := (len(g) << 24) | int.from_bytes(g, "big")) in row]
    if not held:
        return False
    return (model.matrix[held].astype(np.float64).sum(0) / math.sqrt(len(grams)) + model.bias).max() > langid.MIN_SCORE


def test_pipeline_by_brute_force(spark, data, documents, labels):
    rows = [(r["doc_id"], r["text"]) for r in documents.orderBy("doc_id").collect()]
    model = toxicity.train(documents, labels)
    clean = [(i, t) for i, t in rows if not toxic(t, model)]
    assert len(clean) < len(rows)
    left = documents.where(documents["doc_id"].isin([i for i, _ in clean]))
    model = langid.fit(langid.training_sample(left))
    spoken = [(i, t) for i, t in clean if known(t, model)]
    near, _ = brute_pairs([t for _, t in spoken])
    texts = np.array([t for _, t in spoken], object)
    near |= texts[:, None] == texts
    root = groups_of(near)
    single = [r for k, r in enumerate(spoken) if root[k] == k]
    assert len(single) < len(spoken)
    one = pii.Replacer(pii.DEFAULT_KEY)
    hidden = [(i, one.text(t)[0]) for i, t in single]
    assert hidden != single
    # Names at these sizes need no redraw.
    assert not re.search(r"\b(?:Mr|Mrs|Dr) [A-Z]", " ".join(t for _, t in single)) or pii.redrawn_names(left, pii.DEFAULT_KEY).isEmpty()
    want = brute(hidden, packing.WINDOW, packing.SHARD_WORDS, place)
    assert packs_of(corpus_pipeline.run(spark, data)) == sorted(want, key=str)


def test_only_the_last_stage_is_left(spark, data):
    from pathlib import Path

    from rowloom.llm.shared import ensure_shared_dir

    folder = Path(ensure_shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("**/pipeline-*"))
    out = corpus_pipeline.run(spark, data)
    (new,) = set(folder.glob("**/pipeline-*")) - before
    assert [p.name for p in new.iterdir()] == ["4-packing"]
    assert out.count() > 0
