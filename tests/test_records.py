import json

import pytest
from pyspark.sql import functions as F

from rowloom.operators import records
from rowloom.sources import files

MAPS = "https://www.google.com/maps/place/x"
JSONL = [
    {"name": "Mobile Nursing and Rehabilitation, LLC", "category": ["Nursing home", "Rehabilitation center"], "address": "Mobile Nursing and Rehabilitation, LLC, 7020 Bruns Dr, Mobile, AL 36695", "phone": "(251) 555-1212", "latitude": 30.6, "longitude": -88.2, "url": MAPS, "state": "Open"},
    {"name": "Purple Peanut", "category": ["Boutique"], "address": "1 Main St, Mobile, AL 36602", "phone": "2515550000"},
    {"name": "Pizza Hut", "category": ["Pizza restaurant"], "address": "2 Main St, Mobile, AL 36602"},
    {"name": "Piney Grove Freewill Baptist", "category": ["Church"], "address": "3 Main St, Mobile, AL 36602"},
    {"name": "Linx Plaza Apartments", "category": ["Apartment building"], "address": "4 Main St, Mobile, AL 36602"},
]
TEXT = """Alpha Medical Clinic
10 Main St, Mobile, AL 36602
251-555-1000
Beta Urgent Care
20 Broad St, Mobile, AL 36603
251-555-2000
"""


@pytest.fixture
def jsonl(tmp_path):
    path = tmp_path / "in.txt"
    path.write_text("\n".join(map(json.dumps, JSONL)))
    return str(path)


def test_jsonl_in_a_text_file(spark, jsonl):
    assert files.detect(spark, jsonl) == "jsonl"
    accepted, rejected, report = files.import_file(spark, jsonl)
    (row,) = accepted.collect()
    assert (row["lat"], row["lng"], row["sourceUrl"], row["website"], row["state"], row["postalCode"], row["city"]) == ("30.6", "-88.2", MAPS, "", "AL", "36695", "Mobile")
    assert row["address"] == "7020 Bruns Dr, Mobile, AL 36695"
    assert row["services"] == "Nursing home; Rehabilitation center"
    assert row["score"] == 14
    assert row["match_reasons"] == "service:rehabilitation; service:nursing home; name:rehabilitation; evidence:rehabilitation; evidence:nursing home; location evidence; contact/source evidence"
    assert [r["score"] for r in rejected.collect()] == [-10] * 4
    got = report.first()
    assert (got["total_rows_read"], got["accepted_count"], got["rejected_count"]) == (5, 1, 4)
    assert [tuple(x) for x in got["top_rejection_reasons"]] == [("excluded business category", 4)]


def test_text_without_blank_lines(spark, tmp_path):
    path = tmp_path / "in.txt"
    path.write_text(TEXT)
    accepted, _, _ = files.import_file(spark, str(path))
    rows = accepted.collect()
    assert [(r["name"], r["score"], r["services"], r["postalCode"]) for r in rows] == [("Alpha Medical Clinic", 14, "clinic; medical clinic", "36602"), ("Beta Urgent Care", 14, "urgent care", "36603")]
    assert [r["phone"] for r in rows] == ["251-555-1000", "251-555-2000"]


def test_csv_aliases(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('﻿phone,address,category,specialty,provider_type,provider_name\n2515551212,"10 Main St, Mobile, AL 36602",Clinic,Primary care,Medical clinic,Test Medical\n')
    accepted, _, _ = files.import_file(spark, str(path))
    (row,) = accepted.collect()
    assert (row["name"], row["services"], row["score"]) == ("Test Medical", "Clinic; Primary care; Medical clinic", 10)


def test_json_shapes(spark, tmp_path):
    for k, (text, n) in enumerate([(json.dumps(JSONL[1:3]), 2), (json.dumps({"records": JSONL[1:4]}), 3), (json.dumps({"other": 1}), 0)]):
        path = tmp_path / f"{k}.json"
        path.write_text(text)
        assert files.read_json(spark, str(path)).count() == n
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"name": "a"}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.read_jsonl(spark, str(bad)).select("name").collect()


def structured(spark, **row):
    df = spark.createDataFrame([(0, *row.values())], "position int, " + ", ".join(f"`{k}` string" for k in row))
    return records.score_rows(records.normalize_structured(df)).first()


def test_quirks(spark):
    church = structured(spark, name="Church Street Clinic", address="12 Church St, Mobile, AL 36602")
    assert (church["score"], church["reasons"]) == (-10, ["reject:church"])
    park = structured(spark, name="Good Clinic", address="12 Park Ave, Mobile, AL 36602")
    assert (park["score"], park["reasons"]) == (-10, ["reject:park"])
    la = structured(spark, name="x", address="100 La Brea, Los Angeles, CA 90001")
    assert (la["state"], la["city"]) == ("LA", "Los Angeles")
    lost = structured(spark, name="x", url="https://good.example")
    assert (lost["website"], lost["sourceUrl"]) == ("", "")


def test_evidence_needs_no_strict_parity(spark):
    df = spark.createDataFrame([(0, "Good Clinic", "12 Park Ave")], "position int, name string, address string")
    rows = records.normalize_structured(df)
    assert records.score_rows(rows, strict_parity=False).first()["score"] > 0


def test_labelled_lines(spark):
    block = "Name: Alpha Clinic\nPhone: 251-555-1000\nWebsite: https://a.example\nfax 1\nmail x@y.org or z@y.org"
    df = spark.createDataFrame([(0, block), (1, ""), (2, None)], "position int, block string")
    rows = records.block_rows(df).orderBy("position").collect()
    assert (rows[0]["name"], rows[0]["phone"], rows[0]["website"], rows[0]["email"]) == ("Name: Alpha Clinic", "251-555-1000", "https://a.example", "x@y.org")
    assert [r["name"] for r in rows[1:]] == ["", ""]


def test_repeats_count_as_read_only(spark):
    raw = spark.createDataFrame([(i, "Clinic A", "1 St") for i in range(3)], "position int, name string, address string")
    rows = records.normalize_structured(raw)
    got = records.import_report(rows, records.score_rows(rows)).first()
    assert (got["total_rows_read"], got["accepted_count"] + got["rejected_count"]) == (3, 1)


def test_limit_and_sinks(spark, jsonl, tmp_path):
    assert files.import_rows(spark, jsonl, limit=2).count() == 2
    accepted, rejected, report = files.import_file(spark, jsonl)
    files.write_csv(rejected, str(tmp_path / "r"))
    files.write_report(report, str(tmp_path / "j"))
    back = spark.read.option("header", True).csv(str(tmp_path / "r"))
    assert back.columns == records.REJECTED_COLUMNS
    assert back.count() == 4
    assert spark.read.json(str(tmp_path / "j")).first()["rejected_count"] == 4


def test_csv_in_splits(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("name,phone\n" + "".join(f'"a, ""{i}""",{i}\n' for i in range(2000)))
    whole, split = files.read_csv(spark, str(path)), files.read_csv(spark, str(path), quoted_newlines=False)
    assert sorted(map(tuple, whole.select("name", "phone").collect())) == sorted(map(tuple, split.select("name", "phone").collect()))


def test_json_lines_feed(spark, tmp_path):
    df = spark.createDataFrame([("a", 'q"x'), (None, "é")], "name string, note string")
    files.write_jsonl(df, str(tmp_path / "feed"))
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "feed")).select("name", "note").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_raw_evidence_is_appended(spark, tmp_path):
    row = ("n", "q", "CA", "c", "a", "p", "w", 1.0, 2.0, "{}")
    df = spark.createDataFrame([row], "name string, source_query string, country_code string, category string, address string, phone string, website string, latitude double, longitude double, raw string")
    for _ in range(3):
        files.append_raw(df, str(tmp_path / "raw"))
    rows = spark.read.parquet(str(tmp_path / "raw")).collect()
    assert len(rows) == 3 and rows[0]["title"] == "n" and rows[0]["categories"] == ["c"]


def test_database_table(spark, tmp_path):
    """Through the database that Spark ships; a missing table is an error, not a row."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.range(5).selectExpr("id", "concat('r', id) as name")
    df.write.jdbc(url, "RUNS", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    got = files.read_jdbc(spark, url, "RUNS", driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert {r[1] for r in got.collect()} == {f"r{i}" for i in range(5)}
    with pytest.raises(Exception, match="(?i)exist"):
        files.read_jdbc(spark, url, "NOTHING", driver="org.apache.derby.jdbc.EmbeddedDriver").collect()


def test_registry(spark, tmp_path):
    head = "country,sourceTag,url,allowedDomain,crawlMode,enabled,notes\n"
    (tmp_path / "a.csv").write_text(head + "Canada,t1,https://a,,facility_registry,False,\nCanada,,https://b,,facility_registry,true,\n,x,https://c,,facility_registry,true,\nSri Lanka,,https://d,,,true,\n")
    (tmp_path / "b.csv").write_text(head + "France,t5,https://e,,facility_registry,yes,\n")
    reg = files.read_registry(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert [tuple(r) for r in records.registry_seeds(reg).collect()] == [("https://b", "Canada", "gov_health_canada"), ("https://e", "France", "t5")]
    assert [r["url"] for r in records.registry_seeds(reg, include_disabled=True, max_sources=2).collect()] == ["https://a", "https://b"]
    assert {r["url"] for r in records.registry_seeds(reg, mode="any").collect()} == {"https://b", "https://d", "https://e"}
    assert {r["url"] for r in records.discovery_sources(reg).collect()} == {"https://b", "https://d", "https://e"}
    assert {r["url"] for r in records.discovery_sources(reg, ["canada"]).collect()} == {"https://a", "https://b"}


def test_numbers_of_five_digits_are_no_addresses(spark, tmp_path):
    """A number in the name or before the street is no postal code where one stands behind the state."""
    (tmp_path / "in.txt").write_text("Clinic 10000\n10000 Main St, Mobile, AL 36602\n251-555-0000\n\nClinic 12345\n251-555-0001\n")
    got = [(r["name"], r["address"], r["city"], r["postalCode"]) for r in files.import_rows(spark, str(tmp_path / "in.txt"), "txt").orderBy("position").collect()]
    assert got == [("Clinic 10000", "10000 Main St, Mobile, AL 36602", "Mobile", "36602"), ("Clinic 12345", "Clinic 12345", "", "12345")]


def test_long_plain_lines_take_little_time(spark):
    """Patterns are tried only on lines that have what they need: 60,000 lines of words alone."""
    import time

    line = " ".join(["der", "und", "weiter", "auf", "dem"] * 60)
    blocks = spark.range(1000).select(F.col("id").alias("position"), F.lit("\n".join([line] * 60)).alias("block"))
    records.block_rows(blocks.limit(4)).collect()
    started = time.time()
    got = records.block_rows(blocks).agg(F.count("*"), F.max("address"), F.max("email")).first()
    assert tuple(got) == (1000, "", "") and time.time() - started < 12
