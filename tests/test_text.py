import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowloom.functions import extract as E
from rowloom.functions import score as S
from rowloom.functions import text as N


def values(spark, column, inputs, kind="string"):
    """column(x) for each input, in one job."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_variants(spark):
    odd = ["  a\xa0  b\t\nc ", "", None, "; a, ", "• a •", "\x1cx\x1f"]
    assert values(spark, N.clean, odd) == ["a b c", "", "", "; a,", "• a •", "x"]
    assert values(spark, N.clean_field, odd)[3] == "a"
    assert values(spark, N.clean_record, odd)[4] == "a"
    assert values(spark, N.clean_line, ["|a;,"]) == ["|a"]
    assert values(spark, N.clean_list, [[" a ", "", "b"], [], None], "array<string>") == ["a; b", "", None]


def test_names_phones_sites(spark):
    assert values(spark, N.normalized_name, ["St. Élan's  Clinic", None]) == ["st lan s clinic", ""]
    phones = ["+1 416 555 0100", "(251) 555-1212", "ext", "1-251-555-1212 x9", "", None]
    assert values(spark, N.normalize_phone, phones) == ["4165550100", "2515551212", "ext", "125155512129", None, None]
    sites = ["example.com", "//a.b", "HTTP://x", "ftp://q", "", None]
    assert values(spark, N.normalize_site, sites) == ["https://example.com", "https://a.b", "HTTP://x", "https://ftp://q", None, None]


@pytest.mark.parametrize(
    ("code", "name", "region", "expected"),
    [
        ("", "Canada", "", ("CA", "Canada")), ("", "ca", "", ("CA", "CA")), ("usa", "USA", "", ("US", "USA")), ("", "", "al", ("US", "United States")),
        ("", "Narnia", "", ("XX", "Narnia")), (None, None, None, ("XX", "Unknown")), ("gb", "", "", ("GB", "GB")),
    ],
)
def test_country(spark, code, name, region, expected):
    df = spark.createDataFrame([(code, name, region)], "c string, n string, r string")
    assert tuple(df.select(N.normalize_country("c", "n", "r").alias("p")).first()["p"]) == expected


def test_full_address(spark):
    df = spark.createDataFrame([("10 Main", "Toronto", "toronto", None, "Canada")], "a string, b string, c string, d string, e string")
    assert df.select(N.full_address(*"abcde").alias("x")).first()["x"] == "10 Main, Toronto, Canada"


def test_keys(spark):
    item = ("Alpha Medical Clinic", "https://x.org/list", None)
    df = spark.createDataFrame([item], "name string, url string, none string")
    row = df.select(
        N.dedupe_key("url", "none", "none", "name", "none").alias("by_url"),
        N.dedupe_key("none", "none", "none", "name", "none").alias("by_name"),
        N.fingerprint("name", "none").alias("f"),
    ).first()
    import hashlib

    assert row["by_url"] == hashlib.sha256(b"https://x.org/list").hexdigest()
    assert row["by_name"] == hashlib.sha256(b"alpha medical clinic|").hexdigest()
    assert row["f"] == "provider-fingerprint://" + hashlib.sha256(b"alpha medical clinic|").hexdigest()


def test_numbers_go_to_quarantine(spark):
    assert values(spark, N.number, ["30.6", "", None, "abc"]) == [30.6, None, None, None]
    assert values(spark, N.bad_number, ["30.6", "", None, "abc"]) == [False, False, False, True]


def test_urls(spark):
    assert values(spark, N.normalized_url, ["https://a/b/#c", "https://a//", "/", "#x"]) == ["https://a/b", "https://a", "/", ""]
    assert values(spark, N.url_host, ["https://u@A.b:80/c", "x", None]) == ["a.b", None, None]
    assert values(spark, N.slug, ["Côte d'Ivoire"]) == ["gov_health_c-te-d-ivoire"]
    base = "https://e.org/a/b?q=1"
    hrefs = ["c", "/c", "//f/c", "?z=2", "#t", "", "../c", "mailto:x", "./c", "https://o/"]
    got = values(spark, lambda x: E.resolve(F.lit(base), x), hrefs)
    from urllib.parse import urljoin

    assert got == [urljoin(base, h) for h in hrefs]


def test_parameters():
    assert [N.truthy(x) for x in (None, "0", " No", "yes", 1)] == [True, False, False, True, True]
    assert [N.clamp(x, 1, 10, 5) for x in ("3", "x", 99, float("nan"), None)] == [3, 5, 10, 5, 5]
    assert N.identifier("a_1") == "`a_1`"
    with pytest.raises(ValueError):
        N.identifier("a; drop")


def test_address_like_line(spark):
    assert values(spark, E.address_like_line, ["Foo | 20 Queen Street, Toronto, ON M5H 2N2 | 555", "nothing", None]) == ["20 Queen Street, Toronto, ON M5H 2N2", "", ""]


def test_whole_words(spark):
    assert values(spark, lambda x: E.terms_in(x, ["spa", "x-ray", "park"]), ["Space spa", "x-ray, sparking", None, "PARK"]) == [["spa"], ["x-ray"], [], ["park"]]


@pytest.mark.parametrize(
    ("fields", "expected"),
    [
        ({}, 0.5), ({"address": "a"}, 0.7), ({"phone": "1"}, 0.6), ({"address": "a", "phone": "1"}, 0.7999999999999999), ({"address": "a", "website": "w"}, 0.7999999999999999),
        ({"address": "a", "phone": "1", "website": "w"}, 0.8999999999999999), ({"address": "a", "phone": "1", "website": "w", "lat": "1", "lng": "2"}, 0.95),
    ],
)
def test_confidence(spark, fields, expected):
    names = "name address phone email website sourceUrl lat lng".split()
    cols = [F.lit({"name": "n"}.get(n) or fields.get(n)).cast("string") for n in names]
    assert spark.range(1).select(S.confidence(*cols).alias("c")).first()["c"] == expected


ORG = "https://example.org"
LINKS = [
    (f"{ORG}/locations", f"{ORG}/locations?page=2", "Next", 17),
    (f"{ORG}/locations", f"{ORG}/providers/abc", "Doctor profile", 9),
    (f"{ORG}/a", "https://sub.example.org/locations", "x", 7),
    (f"{ORG}/a", f"{ORG}/express-clinic", "x", -100),
    (f"{ORG}/a", f"{ORG}/about", "x", -1),
    ("https://sub.example.org/a", f"{ORG}/clinic", "x", -100),
    (f"{ORG}/a", "https://facebook.com/e", "Facebook", -100),
    (f"{ORG}/a", "ftp://example.org/clinic", "x", -100),
    (f"{ORG}/a", None, None, -100),
]


def test_link_score(spark):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(LINKS)], "i int, a string, b string, t string, s int")
    assert [r["y"] for r in df.select("i", S.link_score("a", "b", "t").alias("y")).orderBy("i").collect()] == [x[3] for x in LINKS]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_clean_is_pythons(spark, inputs):
    inputs = [x.replace("\x00", "").encode("utf-8", "ignore").decode() for x in inputs]
    assert values(spark, N.clean, inputs) == [" ".join(x.split()) for x in inputs]


def test_word_edges_are_those_of_sql(spark):
    """A letter of another script ends a word, as in the SQL."""
    assert values(spark, E.address_like_line, ["Kast 5 der stßzu lich", "Kast 5 der stzu lich", "ü1234ü und so"]) == ["Kast 5 der stßzu lich", "", "ü1234ü und so"]
    assert values(spark, lambda x: E.first_match(x, E.POSTAL), ["ü12345", "a12345"]) == ["12345", ""]


def test_postal_code_stands_behind_the_state(spark):
    part = lambda x: E.address_parts(x, F.lit(""), F.lit(""), F.lit(""), F.lit(""))["postalCode"]
    assert values(spark, part, ["10000 Main St, Mobile, AL 36602", "10000 Main St, Mobile, AL 36602-1234, USA", "Box 12345, Nowhere", "1 A St, tx"]) == ["36602", "36602-1234", "12345", ""]


def test_address_parts_are_spread_and_computed_once(spark, tmp_path):
    """A table in one small file is dealt to all cores; the plan names the address's cleaning once, not at each use."""
    from rowloom.plans import registry

    spark.range(50).selectExpr("id as p_partkey", "'x, y' as p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = registry.QUERIES["derive_address_parts"](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert df._jdf.queryExecution().optimizedPlan().toString().count("•") <= 3  # address, name, a part
