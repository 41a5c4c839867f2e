"""The pipeline against its stages' single-document definitions, and the registry."""

from collections import Counter

import corpus_pipeline
from rowloom.llm import pii, simhash_bk, toxicity, langid
from rowloom.llm.queries import ORACLE, QUERIES


def test_registry():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_copies", "personal_data", "packing"]


def test_stages_take_effect(spark, data, documents, labels):
    docs, seen = documents, [documents.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, data).checkpoint()
        assert docs.columns == documents.columns, name
        seen.append(docs.count())
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.score_toxicity(before, labels).where("toxic").collect()}
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()} - bad
        if name == "language_id":
            out = {r["doc_id"] for r in langid.identify(before).where("rejected").collect()}
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()} - out
        if name == "near_copies":
            kept = {r["doc_id"] for r in simhash_bk.near_duplicates(before).where("kept").collect()}
            assert {r["doc_id"] for r in docs.collect()} == kept
        if name == "personal_data":
            one = pii.Replacer(pii.DEFAULT_KEY)
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == {r["doc_id"]: one.text(r["text"])[0] for r in before.collect()}
    assert seen[0] > seen[1] >= seen[2] > seen[3] == seen[4]
    ran = corpus_pipeline.run(spark, data)
    placed = Counter(i for r in ran.collect() for i in set(r["doc_ids"]))
    assert set(placed) == {r["doc_id"] for r in docs.collect()}


def test_stages_on_odd_rows(spark, data, odd, none):
    for rows in (odd, none):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, data).checkpoint()
            if name != "packing":
                assert docs.columns == rows.columns
        assert docs.isEmpty() == rows.isEmpty()
