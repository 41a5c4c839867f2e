"""Samples are bounded before they reach the driver, and odd ids don't upset them."""

import pytest

from rowloom.llm import langid, quality_crf

from .conftest import strings


def rows_of(n, lang, ident=lambda i: i, text=lambda i: f"text number {i} of some words"):
    return [(ident(i), lang, text(i)) for i in range(n)]


SCHEMA = "doc_id long, lang string, text string"


def test_null_ids_are_never_trained_on(spark):
    docs = spark.createDataFrame(rows_of(3000, "en", lambda i: None) + rows_of(50, "fr", text=lambda i: f"le texte {i}"), SCHEMA)
    assert {lang for lang, _ in langid.training_sample(docs, 40)} == {"fr"}


@pytest.mark.parametrize("ident", [7, 8, 9])
def test_repeated_ids_give_as_many_samples_as_any(spark, ident):
    docs = spark.createDataFrame(rows_of(3000, "en", lambda i: ident) + rows_of(30, "fr"), SCHEMA)
    sample = langid.training_sample(docs, 40)
    assert sum(lang == "en" for lang, _ in sample) == 40
    assert sum(lang == "fr" for lang, _ in sample) == 30
    assert sample == langid.training_sample(docs.repartition(7), 40)


def test_repeated_rows_are_trained_on_once(spark):
    docs = spark.createDataFrame(rows_of(500, "en", lambda i: 1, lambda i: "the same") + rows_of(5, "fr"), SCHEMA)
    assert sum(lang == "en" for lang, _ in langid.training_sample(docs, 40)) == 1


def test_every_row_is_scored_beside_null_ids(spark):
    docs = spark.createDataFrame(rows_of(60, "en", lambda i: None if i % 3 else i) + rows_of(60, "fr", text=lambda i: f"le petit texte français {i}"), SCHEMA)
    got = langid.identify(docs).collect()
    assert len(got) == 120
    assert not any(r["rejected"] for r in got)


def test_few_lines_reach_the_driver(spark, monkeypatch):
    monkeypatch.setattr(quality_crf, "TRAIN_LINES", 100)
    long = "\n".join("a line of words" for _ in range(5000))
    rows = [(i, "Good words here.\nAnd more of them.") for i in range(60)] + [(i, "!!! | |\n$$$ 1 | 2") for i in range(60, 120)] + [(200, long)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(200, 1)], "doc_id long, quality int")
    seen = []
    real = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: seen.append(real(df)) or seen[-1])
    model = quality_crf.train(docs, labels)
    assert sum(len(r["own"]) // (4 * len(quality_crf.OWN)) for r in seen[-1]) == 100
    doc, chars, own = quality_crf.lines_of(strings("Good words here.\nAnd more of them.", "!!! | |\n$$$ 1 | 2"))
    q, _ = quality_crf.document_quality(2, doc, chars, model.marginals(doc, own))
    assert q[0] > 0.5 > q[1]
