import pyarrow as pa
import pytest

#: A table of the shape of documents with every odd case: nulls, blanks, repeats, an unknown
#: script, a long text, and columns whose names operators might want for themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, _node string, kept string, h int, entities string"


def odd_rows():
    long = "the quick brown fox jumps over the lazy dog and runs away " * 4000
    texts = [None, "", " \n\n ", "!!! ???", "one", "The same text here for all of them.", "The same text here for all of them.", "Ж" * 50, long, "a\nb\n\nc | d | e\nF!! G!!", "x" * 5000, "mail a@b.org now"]
    rows = [(i, t, [None, "en", "fr", "de"][i % 4], "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[5], "en", None, 3), (None, None, None, None, None), (None, "no id here", "en", "s", 1)]
    return [(*r, 0.5, 7, "n", "k", 1, "e") for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet")


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(1, 1, 0), (4, 0, 1), (4, 1, None), (5, 1, 0), (9, 0, 0), (None, 1, 1), (99, None, None), (8, 1, 0), (11, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def strings(*texts):
    return pa.array(texts, pa.string())
