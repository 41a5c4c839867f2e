import random
import time

import pytest
from pyspark.sql import functions as F

from rowloom.operators import frontier, merge, reports
from rowloom.operators.graph import components
from rowloom.streaming import incremental

ITEM = dict(
    sourceType="pasted_url_scrape", sourceTag="canada_registry", sourceUrl="https://example.org/clinic", website="example.com", services="occupational medicine",
    phone="+1 416 555 0100", name="Central Occupational Clinic", country="Canada", postalCode="M5V 2T6", region="Ontario", city="Toronto", address="10 Main Street",
)
APP = ["id", "normalized_name", "clinic_name", "status", "admin_area", "clinic_type", "services", "source_url", "source_kind", "source_label", "dedupe_key", "phone", "confidence"]


def items(spark, *rows):
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} string" for n in names))


def test_value_record(spark):
    v = merge.value_records(items(spark, ITEM))
    row = v.first()
    assert row["address"] == "10 Main Street, Toronto, Ontario, M5V 2T6, Canada"
    assert row["confidence_score"] == 0.8999999999999999
    app = merge.app_values(v, APP).first()
    assert (app["status"], app["admin_area"], app["clinic_type"], app["services"], app["source_url"], app["source_kind"], app["source_label"]) == ("candidate", "Ontario", "occupational medicine", ["occupational medicine"], "https://example.org/clinic", "pasted_url_scrape", "canada_registry")
    done = merge.write_results(v.unionByName(merge.value_records(items(spark, ITEM | {"name": ""}))), columns=APP).select("write_status", "write_reason").collect()
    assert [tuple(r) for r in done] == [("written", None), ("skipped", "missing_name")]


def test_fingerprints_tell_items_of_a_page_apart(spark):
    url = "https://example.org/list"
    both = merge.clean_items(items(spark, dict(sourceUrl=url, name="Alpha Medical Clinic", address="1 A St"), dict(sourceUrl=url, name="Beta Urgent Care", address="2 B St"))).collect()
    assert both[0]["sourceUrl"] != both[1]["sourceUrl"]
    assert both[0]["evidenceUrl"] == both[1]["evidenceUrl"] == url


def test_drops_and_fills(spark):
    got = merge.clean_items(items(spark, {"type": "discovered_link", "name": "x"}, {"name": " "}, {"name": "n"}, {"name": "n", "state": "AL", "address1": "1 A", "address2": "B"})).collect()
    assert [r["drop_reason"] for r in got] == ["discovered_link", "missing_name", "missing_evidence", None]
    assert (got[3]["region"], got[3]["address"], got[3]["internalStatus"]) == ("AL", "1 A B", "candidate")


# -- staging: the fold equals one upsert after another ----------------------------

FIELDS = ["name", "normalized_name", "category", "status", "country_code", *merge.FILL_TEXT, *merge.FILL_NUMBER, "confidence_score"]


def sequential(rows):
    table = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        if not r["name"]:
            continue
        if (old := table.get(r["dedupe_key"])) is None:
            table[r["dedupe_key"]] = {f: r[f] for f in FIELDS}
            continue
        if old["country_code"] in ("US", "XX") and r["country_code"] != "XX":
            old["country_code"] = r["country_code"]
        for f in merge.FILL_TEXT:
            old[f] = old[f] if old[f] not in (None, "") else r[f]
        for f in merge.FILL_NUMBER:
            old[f] = r[f] if old[f] is None else old[f]
        old["confidence_score"] = max(old["confidence_score"], r["confidence_score"])
    return table


def random_rows(rng, n):
    text = lambda: rng.choice(["", None, "a", "b", "c"])
    return [
        {"seq": i, "dedupe_key": f"k{rng.randrange(8)}", "name": rng.choice(["", "n1", "n2"]), "normalized_name": "x", "category": rng.choice("pq"), "status": "new", "country_code": rng.choice(["US", "XX", "CA", "GB"])}
        | {f: text() for f in merge.FILL_TEXT} | {f: rng.choice([None, 1.0, 2.0]) for f in merge.FILL_NUMBER} | {"confidence_score": rng.random()}
        for i in range(n)
    ]


SCHEMA = "seq long, dedupe_key string, " + ", ".join(f"{f} {'double' if f in (*merge.FILL_NUMBER, 'confidence_score') else 'string'}" for f in FIELDS)


def frame(spark, rows):
    names = ["seq", "dedupe_key", *FIELDS]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(4))
def test_staging_fold_is_sequential(spark, seed):
    rng = random.Random(seed)
    rows = random_rows(rng, 60)
    shuffled = rng.sample(rows, len(rows))
    got = {r["dedupe_key"]: {f: r[f] for f in FIELDS} for r in merge.staging_upsert(frame(spark, shuffled)).collect()}
    assert got == sequential(rows)
    half = merge.staging_upsert(frame(spark, rows[:25]))
    again = {r["dedupe_key"]: {f: r[f] for f in FIELDS} for r in merge.staging_upsert(frame(spark, rows[25:]), half).collect()}
    assert again == sequential(rows)


def test_stream_resumes(spark, tmp_path):
    rows = random_rows(random.Random(9), 40)
    table, check, into = (str(tmp_path / x) for x in ("table", "check", "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{into}/*")
    for k in range(2):
        frame(spark, rows[20 * k : 20 * k + 20]).coalesce(1).write.parquet(f"{into}/{k}")
        incremental.stream_upsert(stream, table, check).awaitTermination()
    got = {r["dedupe_key"]: {f: r[f] for f in FIELDS} for r in incremental.latest(spark, table).collect()}
    assert got == sequential(rows)


# -- app table ------------------------------------------------------------------

OLD = ["id", "dedupe_key", "source_url", "phone", "normalized_name", "address", "confidence"]


def app_sequential(old, new):
    table = [dict(r, action=None) for r in old]
    same = lambda c, a, b: b[c] not in (None, "") and a[c] == b[c]
    for r in new:
        hit = next((t for c in ("dedupe_key", "source_url", "phone") if r[c] not in (None, "") for t in table if same(c, t, r)), None)
        if hit is None and r["normalized_name"] and r["address"]:
            hit = next((t for t in table if t["normalized_name"] and t["address"] and (t["normalized_name"].lower(), t["address"].lower()) == (r["normalized_name"].lower(), r["address"].lower())), None)
        if hit is None:
            table.append({c: r.get(c) if r.get(c) != "" else None for c in OLD} | {"id": None, "action": "inserted"})
            continue
        for c in OLD[1:-1]:
            if hit[c] in (None, "") and r[c] not in (None, ""):
                hit[c] = r[c]
        hit["confidence"] = max(hit["confidence"] or 0.0, r["confidence"])
        hit["action"] = hit["action"] or "updated"
    return table


@pytest.mark.parametrize("seed", range(3))
def test_app_upsert_is_sequential(spark, seed):
    rng = random.Random(seed)
    key = lambda p, n: rng.choice([None, "", *(f"{p}{i}" for i in range(n))])
    make = lambda: {"dedupe_key": key("k", 12), "source_url": key("u", 12), "phone": key("5", 12), "normalized_name": key("n", 4), "address": key("a", 4), "confidence": rng.random()}
    old = [{"id": i} | make() for i in range(6)]
    new = [{"seq": i} | make() for i in range(15)]
    kinds = "dedupe_key string, source_url string, phone string, normalized_name string, address string, confidence double"
    df = lambda rows, first: spark.createDataFrame([tuple(r[c] for c in [first, *OLD[1:]]) for r in rows], f"{first} long, {kinds}")
    blank = lambda x: None if x == "" else x
    norm = lambda rows: sorted((tuple(blank(r[c]) for c in [*OLD, "action"]) for r in rows), key=repr)
    got = merge.app_upsert(df(new, "seq"), df(old, "id")).collect()
    assert norm(got) == norm(app_sequential(old, new))


def test_app_upsert_of_one_large_group(spark):
    """Twenty thousand rows that share a website take time in proportion; large ids beside nulls stay exact."""
    n = 20_000
    new = spark.range(n).selectExpr("id as seq", "concat('k', id % 5000) as dedupe_key", "if(id % 3 = 0, 'https://shared', null) as website", "id / 1e5 as confidence")
    old = spark.createDataFrame([(2**60 + 1, "k1", None, 0.5), (2**60 + 3, None, "https://shared", None)], "id long, dedupe_key string, website string, confidence double")
    started = time.time()
    rows = merge.app_upsert(new, old).collect()
    assert time.time() - started < 60
    assert {r["id"] for r in rows if r["id"] is not None} == {2**60 + 1, 2**60 + 3}
    assert sum(r["action"] == "inserted" for r in rows) == len(rows) - 2
    keys = [r["dedupe_key"] for r in rows]
    assert len(set(keys)) == len(keys)


def test_app_table_without_id(spark):
    old = spark.createDataFrame([("k1", "a"), ("k3", "")], "dedupe_key string, phone string")
    new = spark.createDataFrame([(0, "k1", "x"), (1, "k2", "b"), (2, "k3", "c")], "seq long, dedupe_key string, phone string")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows(merge.app_upsert(new, old)) == sorted([("k1", "a", "updated"), ("k2", "b", "inserted"), ("k3", "c", "updated")], key=repr)
    assert rows(merge.app_upsert(new, old, strict_parity=True)) == sorted([("k1", "a", None), ("k3", "", None), ("k1", "x", "inserted"), ("k2", "b", "inserted"), ("k3", "c", "inserted")], key=repr)


def test_components(spark):
    chain = [(f"{i:03}", f"{i + 1:03}") for i in range(40) if i != 20] + [("x", "x"), (None, "y")]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(chain, "u string, v string")).collect()}
    assert got == {f"{i:03}": "000" if i <= 20 else "021" for i in range(41)} | {"x": "x"}
    assert components(spark.createDataFrame([], "u string, v string")).isEmpty()


# -- runs and reports -------------------------------------------------------------


def test_runs(spark):
    events = [("r", 1, "a", "processed", 2, None), ("r", 2, "b", "failed", 0, "e" * 2000), ("r", 3, "c", "pending", 0, None), ("s", 4, "d", "failed", 0, None)]
    df = spark.createDataFrame(events, "run_key string, seq int, url string, status string, found int, error string")
    got = {r["run_key"]: r for r in frontier.run_rollup(df).collect()}
    assert (got["r"]["pages_crawled"], got["r"]["providers_found"], got["r"]["last_url"], len(got["r"]["last_error"])) == (1, 2, "b", 1500)
    assert (got["s"]["pages_crawled"], got["s"]["last_url"]) == (0, None)
    assert {(r["url"], r["status"]) for r in frontier.page_states(df).collect()} >= {("a", "processed"), ("c", "pending")}
    runs = spark.createDataFrame([("r", "m", "u", "paused", "c", "2024-01-02", None, "x"), ("t", "m", "u", "completed", "c", "2024-01-03", "2024-01-03", None)], "run_key string, mode string, start_url string, status string, config string, updated_at string, completed_at string, last_error string")
    runs = runs.withColumns({c: F.col(c).cast("timestamp") for c in ("updated_at", "completed_at")})
    assert frontier.latest_resumable(runs).first()["run_key"] == "r"
    started = frontier.start_runs(runs, spark.createDataFrame([("r", "m2", "u2", "c2"), ("n", "m", "u", "c")], "run_key string, mode string, start_url string, config string"))
    state = {r["run_key"]: (r["mode"], r["status"], r["last_error"], r["action"]) for r in started.collect()}
    assert state == {"r": ("m", "running", None, "reopened"), "n": ("m", "running", None, "started"), "t": ("m", "completed", None, None)}
    words = spark.createDataFrame([("finished",), ("timeout",), (None,)], "w string")
    assert [r["s"] for r in words.select(frontier.finished_status("w").alias("s")).collect()] == ["completed", "paused", "paused"]


def test_checkpoint_is_whole_unless_limited(spark):
    rows = [("r", f"u{i}", ["processed", "failed", "pending"][i % 3], i // 2, "2024-01-01") for i in range(9)]
    queue = spark.createDataFrame(rows, "run_key string, url string, status string, depth int, updated_at string")
    done, todo = frontier.checkpoint(queue, "r")
    assert (done.count(), todo.count()) == (3, 6)
    done, todo = frontier.checkpoint(queue, "r", limit=4)
    assert (done.count(), todo.count()) == (2, 2)


def test_warnings(spark):
    sources = spark.createDataFrame([("npi",), ("new",)], "source string")
    none = spark.createDataFrame([(0,)], "n long")
    got = {r["code"] for r in reports.warnings(False, True, none, sources, ["npi"]).collect()}
    assert got == {"app_write_disabled", "nothing_written_since_start", "legacy_rows_exist"}
    jobs = spark.createDataFrame([(1, None, "b", None), (2, "No mapped results", "a", None), (3, "x", None, "c")], "id int, error string, completed_at string, started_at string").withColumn("created_at", F.lit("a"))
    assert [(r["id"], r["kind"]) for r in reports.recent_errors(jobs).collect()] == [(3, "error"), (2, "legacy_map_scraper")]


def test_stream_query_of_many_files(spark, tmp_path):
    """Events in many files: the stream's fold is still in the order of events."""
    import duckdb

    from rowloom.plans import registry

    at = f"{tmp_path}/events.parquet"
    user, kind = F.col("event_id") % 7, F.element_at(F.array(F.lit("view"), F.lit("click")), (F.col("event_id") % 2 + 1).cast("int"))
    spark.range(6000).select(F.col("id").alias("event_id")).select("event_id", user.alias("user_id"), kind.alias("event_type"), (F.col("event_id") % 100 / 4).alias("value")).repartition(6).write.parquet(at)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{at}/*.parquet')")
    want = con.sql(registry.ORACLE["stream_upsert"])
    got = registry.QUERIES["stream_upsert"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_app_upsert_streams_a_group():
    """The rows of one large group pass batch by batch, none of them held: each batch is answered before the next is asked for."""
    import pyarrow as pa

    asked = []

    def batches():
        for b in range(5):
            asked.append(b)
            rows = [(f"n{b * 10 + k}", b * 10 + k, None, f"p{k % 3}", "root") for k in range(10)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["__ident", "__seq", "id", "__k0", "__root"])

    for b, out in enumerate(merge._targets(1)(batches())):
        assert asked == list(range(b + 1)) and out.column("target").to_pylist() == [f"n{(b * 10 + k - b * 10) % 3}" for k in range(10)]
