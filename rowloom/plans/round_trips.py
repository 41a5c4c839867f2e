"""Queries over files that are written first, and over pages and tables made of suppliers,
whose results SQL can tell from the suppliers alone."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import frontier, merge, records, reports
from ..sources import files
from ..sources import pages as P
from ..streaming import incremental
from .registry import _STAGING_SQL, _VALUES_SQL, query
from .session import read, shared_folder
from .views import event_values, suppliers


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/round-trip-{uuid.uuid4().hex}"


def _text(x: Column) -> Column:
    return x.cast("string")


# -- files (SRC1-SRC6, SNK1, SNK3, E14, E15) -------------------------------------------

_IMPORTED = "name, address, city, state, postalCode, phone, website, services, sourceType, sourceTag"
_IMPORT_SQL = """WITH k AS (SELECT s_suppkey AS k FROM supplier),
structured AS (SELECT 'Clinic ' || k AS name, k || ' Main St, Mobile, AL 36602' AS address, 'Mobile' AS city, 'AL' AS state, '36602' AS postalCode, '251555' || lpad((k % 10000)::VARCHAR, 4, '0') AS phone,
  CASE WHEN k % 3 = 0 THEN '' ELSE 'https://s' || k || '.example' END AS website, CASE WHEN k % 4 = 0 THEN 'Medical clinic' ELSE 'Dentist; Medical clinic' END AS services FROM k),
blocks AS (SELECT 'Clinic ' || k AS name, k || ' Main St, Mobile, AL 36602' AS address, 'Mobile' AS city, 'AL' AS state, '36602' AS postalCode, '251-555-' || lpad((k % 10000)::VARCHAR, 4, '0') AS phone,
  CASE WHEN k % 3 = 0 THEN '' ELSE 'https://s' || k || '.example' END AS website, 'clinic' AS services FROM k)
SELECT f.format, s.*, 'provider_file_import' AS sourceType, 'provider_text_import' AS sourceTag FROM structured s, (VALUES ('csv'), ('jsonl'), ('json')) f(format)
UNION ALL SELECT 'txt', b.*, 'provider_file_import', 'provider_text_import' FROM blocks b"""


@query(_IMPORT_SQL)
def file_imports(spark, sf_dir):
    """The same records written in each format by a sink and read again by suffix; the text has a block a record."""
    at, k = _folder(spark), F.col("s_suppkey")
    address = F.concat(_text(k), F.lit(" Main St, Mobile, AL 36602"))
    digits = F.lpad(_text(k % 10000), 4, "0")
    site = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("https://s"), _text(k), F.lit(".example")))
    rows = read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("Clinic "), _text(k)).alias("provider_name"), F.when(k % 4 == 0, "").otherwise("Dentist").alias("category"), F.lit("Medical clinic").alias("type"),
        address.alias("Street Address"), F.concat(F.lit("251555"), digits).alias("phone_number"), site.alias("website"),
    )
    files.write_csv(rows, f"{at}/in.csv")
    files.write_jsonl(rows, f"{at}/in.jsonl")
    rows.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).coalesce(1).write.text(f"{at}/in.json")
    line = F.concat_ws("\n", F.concat(F.lit("Clinic "), _text(k)), address, F.concat(F.lit("251-555-"), digits), F.when(site != "", site))
    blocks = read(spark, sf_dir, "supplier").select(line.alias("b"))
    blocks.agg(F.array_join(F.collect_list("b"), "\n\n").alias("value")).coalesce(1).write.text(f"{at}/in.txt")
    parts = [files.import_rows(spark, f"{at}/in.{fmt}", fmt if fmt == "txt" else "auto").select(F.lit(fmt).alias("format"), *_IMPORTED.split(", ")) for fmt in ("csv", "jsonl", "json", "txt")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH v AS ({_VALUES_SQL}) SELECT name AS title, source_query, country_code, category, address, phone, website, latitude, longitude, 2::BIGINT * count(*) AS times FROM v GROUP BY ALL")
def raw_evidence(spark, sf_dir):
    """Raw evidence appended twice (SNK4)."""
    at = _folder(spark)
    values = merge.value_records(suppliers(spark, sf_dir)).withColumn("raw", F.lit("{}"))
    for _ in range(2):
        files.append_raw(values, at)
    back = spark.read.parquet(at).where("categories[0] <=> category and created_at is not null")
    return back.groupBy("title", "source_query", "country_code", "category", "address", "phone", "website", "latitude", "longitude").agg(F.count("*").alias("times"))


@query("""WITH r AS (SELECT s_suppkey % 3 AS file_no, s_suppkey AS k FROM supplier)
SELECT 'https://s' || k || '.example.com' AS url, 'Canada' AS country, CASE WHEN k % 6 = 0 THEN 'gov_health_canada' ELSE 'tag' || k END AS source_tag FROM r WHERE k % 4 != 0 ORDER BY file_no, k LIMIT 25""")
def registry_files(spark, sf_dir):
    """Source registries written as CSV, read in order, and their seeds (SRC10)."""
    at, k = _folder(spark), F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select(
        k, F.lit("Canada").alias("country"), F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("tag"), _text(k))).alias("sourceTag"), F.concat(F.lit("https://s"), _text(k), F.lit(".example.com")).alias("url"),
        F.lit("").alias("allowedDomain"), F.lit("facility_registry").alias("crawlMode"), F.when(k % 4 == 0, "False").otherwise("true").alias("enabled"), F.lit('with, a "sign"').alias("notes"),
    )
    for n in range(3):
        files.write_csv(rows.where(k % 3 == n).repartition(1).sortWithinPartitions("s_suppkey"), f"{at}/{n}.csv", files.REGISTRY_COLUMNS)
    return records.registry_seeds(files.read_registry(spark, [f"{at}/{n}.csv" for n in range(3)]), ["Canada"], max_sources=25)


# -- pages (E9-E13) ----------------------------------------------------------------------

_LISTED = "; ".join(t for t in vocab.HEALTH_TERMS if t in "central clinic main street, toronto call")
_ALONE = "; ".join(t for t in vocab.HEALTH_TERMS if t in "lakeside hospital call 416 555 0100 about us.")
_PAGE_FIELDS = "page_url, position, name, address, city, region, postalCode, country, phone, website, services, sourceUrl, crawlRunKey, type"
_PAGES_SQL = f"""WITH k AS (SELECT s_suppkey AS k, 'https://e.org/p' || s_suppkey AS u, s_suppkey % 7 AS kind FROM supplier)
SELECT u AS page_url, p AS position, name, address, city, region, postalCode, country, phone, website, services, u AS sourceUrl, 'run' AS crawlRunKey, 'provider_candidate' AS type FROM (
  SELECT u, 0 AS p, 'Clinic ' || k AS name, k || ' Main St' AS address, 'Toronto' AS city, 'ON' AS region, 'M5V 2T6' AS postalCode, 'CA' AS country, '+1 416 555 0100' AS phone, '/c/' || k AS website, 'MedicalClinic' AS services FROM k WHERE kind = 0
  UNION ALL SELECT u, 0, 'P ' || k, k || ' A St', '', '', '', 'Canada', '', '', 'LocalBusiness; Physician' FROM k WHERE kind = 2
  UNION ALL SELECT u, 0, 'Joe Dental ' || k, '', '', '', '', 'Canada', '', '', 'LocalBusiness' FROM k WHERE kind = 3
  UNION ALL SELECT u, 0, 'Central ' || k % 100 || ' Clinic', k % 100 || ' Main Street, Toronto', '', '', '', 'Canada', '416555' || lpad((k % 10000)::VARCHAR, 4, '0'), '', '{_LISTED}' FROM k WHERE kind = 5
  UNION ALL SELECT u, 0, 'Lakeside ' || k % 100 || ' Hospital', 'Call 416 555 0100 about us.', '', '', '0100', 'Canada', '416 555 0100', u, '{_ALONE}' FROM k WHERE kind = 6)"""


@query(_PAGES_SQL)
def page_candidates(spark, sf_dir):
    """Records of pages made of suppliers: nested and flat structured data, kinds that don't count
    (an item within a list item, a business without a term), repeats, a card, a page by itself. (Four
    digits pass for a postal code, and a line with one for an address.)"""
    k = F.col("s_suppkey")
    ld = lambda x: F.concat(F.lit('<html><body><script type="application/ld+json">{broken</script><script type="application/ld+json">'), F.to_json(x), F.lit("</script></body></html>"))
    named = lambda prefix: F.concat(F.lit(prefix), _text(k)).alias("name")
    kind = lambda *names: (F.array(*[F.lit(n) for n in names]) if len(names) > 1 else F.lit(names[0])).alias("@type")
    where = F.struct(F.concat(_text(k), F.lit(" Main St")).alias("streetAddress"), F.lit("Toronto").alias("addressLocality"), F.lit("ON").alias("addressRegion"), F.lit("M5V 2T6").alias("postalCode"), F.lit("CA").alias("addressCountry")).alias("address")
    clinic = F.struct(kind("MedicalClinic"), named("Clinic "), where, F.lit("+1 416 555 0100").alias("telephone"), F.concat(F.lit("/c/"), _text(k)).alias("url"))
    item = F.struct(kind("ItemList"), F.array(F.struct(kind("ListItem"), F.struct(kind("Hospital"), named("H ")).alias("item"))).alias("itemListElement"))
    graph = F.struct(F.array(F.struct(kind("Physician", "LocalBusiness"), named("P "), F.concat(_text(k), F.lit(" A St")).alias("address"))).alias("@graph"))
    dental, pizza = (F.struct(kind("LocalBusiness"), named(x)) for x in ("Joe Dental ", "Joe Pizza "))
    low = _text(k % 100)
    card = F.concat(F.lit('<div class="a provider-x"><h3>Central '), low, F.lit(" Clinic</h3> <address>"), low, F.lit(' Main Street, Toronto</address> <a href="/c">Call</a> <a href="tel:416555'), F.lpad(_text(k % 10000), 4, "0"), F.lit('"></a></div>'))
    alone = F.concat(F.lit("<html><head><title>Lakeside "), low, F.lit(" Hospital</title></head><body><p>Call 416 555 0100 about us.</p></body></html>"))
    html = F.when(k % 7 == 0, ld(clinic)).when(k % 7 == 1, ld(item)).when(k % 7 == 2, ld(graph)).when(k % 7 == 3, ld(F.array(dental, dental))).when(k % 7 == 4, ld(pizza)).when(k % 7 == 5, card).otherwise(alone)
    made = read(spark, sf_dir, "supplier").select(F.concat(F.lit("https://e.org/p"), _text(k)).alias("url"), html.alias("html"), F.lit("Canada").alias("country"))
    return P.extract_records(made, run_key="run").select(*_PAGE_FIELDS.split(", "))


@query("""WITH k AS (SELECT s_suppkey AS k FROM supplier)
SELECT 'page' AS kind, 'https://d.org/list/' || k AS page_url, 'https://d.org/list/' || (k + 1) AS link, NULL AS name, NULL AS services, NULL AS country, NULL AS phone, NULL AS source FROM k
UNION ALL SELECT 'item', 'https://d.org/list/' || k, NULL, 'Plain ' || k, NULL, 'CA', NULL, 'https://d.org/list/' || k FROM k
UNION ALL SELECT 'completed', 'https://d.org/a/' || k, NULL, 'Row ' || k, 'x' || k || ', y', 'CA', '555-' || k, 'https://d.org/a/' || k FROM k""")
def rule_file_items(spark, sf_dir):
    """Items of list pages by a rule file: completed on their detail page, whole as they are, and further pages (E12, SRC9)."""
    rules = {
        "listSelector": "div.row", "fields": {"name": "h2::text", "services": {"css": "i::text", "join": ", "}}, "defaults": {"country": "CA"},
        "follow": {"detailLinks": "a.more::attr(href)", "pagination": {"type": "xpath", "selector": "//a[@rel='next']/@href"}}, "detailFields": {"phone": "b.tel::text"},
    }
    k = F.col("s_suppkey")
    key = _text(k)
    listing = F.concat(F.lit('<div class="row"><h2>Row '), key, F.lit("</h2><i>x"), key, F.lit('</i><i>y</i><a class="more" href="/a/'), key, F.lit('">m</a></div><div class="row"><h2>Plain '), key, F.lit('</h2></div><a rel="next" href="'), _text(k + 1), F.lit('">n</a>'))
    detail = F.concat(F.lit('<b class="tel">555-'), key, F.lit("</b>"))
    s = read(spark, sf_dir, "supplier")
    lists = s.select(F.concat(F.lit("https://d.org/list/"), key).alias("url"), listing.alias("html"))
    details = s.select(F.concat(F.lit("https://d.org/a/"), key).alias("url"), detail.alias("html"))
    found = P.rule_records(lists, rules)
    fields = [F.get_json_object("item", f"$.{c}").alias(a) for c, a in (("name", "name"), ("services", "services"), ("country", "country"), ("phone", "phone"), ("sourceUrl", "source"))]
    listed = found.where("kind != 'detail'").select("kind", "page_url", "link", *fields)
    done = P.complete_details(found, details, rules).select(F.lit("completed").alias("kind"), "page_url", F.lit(None).cast("string").alias("link"), *fields)
    return listed.unionByName(done)


# -- merges (UPS3, UPS6, SNK5) -------------------------------------------------------------


@query("""WITH i AS (SELECT s_suppkey AS k, 'p' || s_suppkey AS phone, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'n' || s_suppkey END AS name, (s_suppkey % 10) / 10.0::DOUBLE AS c FROM supplier)
SELECT CASE WHEN k % 2 = 0 THEN k END AS id, phone, CASE WHEN k % 4 = 0 THEN 'old' WHEN name = '' THEN NULL ELSE name END AS provider_name,
  CASE WHEN k % 2 = 0 THEN greatest(0.5, c) ELSE c END AS confidence, CASE WHEN k % 2 = 0 THEN 'updated' ELSE 'inserted' END AS action FROM i""")
def app_upsert_values(spark, sf_dir):
    """An app upsert whose rows don't touch one another: blanks filled, the higher confidence kept, the rest inserted."""
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    phone = F.concat(F.lit("p"), _text(k)).alias("phone")
    old = s.where(k % 2 == 0).select(k.alias("id"), phone, F.when(k % 4 == 0, "old").when(k % 3 == 0, "").alias("provider_name"), F.lit(0.5).alias("confidence"))
    new = s.select(k.alias("seq"), phone, F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("n"), _text(k))).alias("provider_name"), (k % 10 / 10).alias("confidence"))
    return merge.app_upsert(new, old).withColumn("provider_name", F.when(F.col("provider_name") != "", F.col("provider_name")))


@query("""SELECT false AS strict, 'k' || s_suppkey AS dedupe_key, CASE WHEN s_suppkey % 3 = 0 THEN 'updated' END AS action FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT false, 'k' || s_suppkey, 'inserted' FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey % 3 = 0
UNION ALL SELECT true, 'k' || s_suppkey, NULL FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT true, 'k' || s_suppkey, 'inserted' FROM supplier WHERE s_suppkey % 3 = 0""")
def app_rows_without_id(spark, sf_dir):
    """In a table without ids rows are updated by what they match, or all inserted (UPS6)."""
    k = F.col("s_suppkey")
    s = read(spark, sf_dir, "supplier").select(k, F.concat(F.lit("k"), _text(k)).alias("dedupe_key"))
    new, old = s.where(k % 3 == 0).withColumnRenamed("s_suppkey", "seq"), s.where(k % 2 == 0).select("dedupe_key")
    return merge.app_upsert(new, old).withColumn("strict", F.lit(False)).unionByName(merge.app_upsert(new, old, strict_parity=True).withColumn("strict", F.lit(True)))


@query(_STAGING_SQL)
def upsert_table(spark, sf_dir):
    """The staging fold written in three batches to a table in buckets (SNK5, UPS8)."""
    at = _folder(spark)
    v = event_values(spark, sf_dir)
    for part in ("seq < 2000", "seq >= 2000 and seq < 5000", "seq >= 5000"):
        incremental.upsert_table(v.where(part), at)
    return incremental.latest(spark, at)


# -- registries, runs and statuses (F4, N24, ST1, ST2, ST4, UPS7, SNK6) -----------------------


@query("""SELECT 'https://s' || s_suppkey AS url, 'Canada' AS country, CASE WHEN s_suppkey % 6 = 0 THEN 'gov_health_canada' ELSE 'tag' || s_suppkey END AS sourceTag,
  CASE WHEN s_suppkey % 4 = 0 THEN 'authority_discovery' ELSE 'facility_registry' END AS crawlMode, '' AS notes, a.asked FROM supplier, (VALUES (true), (false)) a(asked) WHERE a.asked OR s_suppkey % 5 != 0""")
def discovery_registry(spark, sf_dir):
    """Disabled sources go only where no country is asked for."""
    k = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select(
        F.lit(" Canada ").alias("country"), F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("tag"), _text(k))).alias("sourceTag"), F.concat(F.lit("https://s"), _text(k)).alias("url"),
        F.when(k % 4 == 0, "").otherwise("facility_registry").alias("crawlMode"), F.when(k % 5 == 0, "No").otherwise("yes").alias("enabled"), F.lit(None).cast("string").alias("notes"),
    )
    asked, all_ = records.discovery_sources(rows, ["canada"]), records.discovery_sources(rows)
    return asked.withColumn("asked", F.lit(True)).unionByName(all_.withColumn("asked", F.lit(False)))


@query("""WITH k AS (SELECT s_suppkey AS k, 'https://www.google.com/maps/' || s_suppkey AS map FROM supplier)
SELECT k, CASE k % 5 WHEN 0 THEN 'own ' || k WHEN 1 THEN 'alt' WHEN 2 THEN map WHEN 3 THEN map ELSE '' END AS source, CASE WHEN k % 5 IN (0, 2) THEN 'https://site' ELSE '' END AS website FROM k""")
def record_origins(spark, sf_dir):
    """Where a record comes from: a plain address counts only if it is a map's, and isn't a website then."""
    k = F.col("s_suppkey")
    kind, map_ = k % 5, F.concat(F.lit("https://www.google.com/maps/"), _text(k))
    rows = read(spark, sf_dir, "supplier").select(
        k.alias("position"), F.when(kind == 0, F.concat(F.lit("own  "), _text(k))).alias("sourceUrl"), F.when(kind == 1, " alt ").when(kind == 2, "").alias("source_url"), F.when(kind == 2, map_).alias("maps_url"),
        F.when(kind == 3, map_).when(kind == 4, "https://elsewhere.example").otherwise("x").alias("url"), F.when(kind.isin(0, 2), "https://site").when(kind == 3, map_).alias("website"), F.lit("N").alias("name"),
    )
    return records.normalize_structured(rows).select(F.col("position").alias("k"), F.col("sourceUrl").alias("source"), "website")


_QUEUE_SQL = "q AS (SELECT 'r' || event_id % 3 AS run_key, 'https://p/' || event_id AS url, ['processed', 'failed', 'pending', 'processing', 'skipped'][(event_id % 5 + 1)::INT] AS status, event_id % 4 AS depth FROM events)"


def _queue(spark: SparkSession, sf_dir: str):
    k = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(x) for x in ("processed", "failed", "pending", "processing", "skipped")]), (k % 5 + 1).cast("int"))
    return read(spark, sf_dir, "events").select(F.concat(F.lit("r"), _text(k % 3)).alias("run_key"), F.concat(F.lit("https://p/"), _text(k)).alias("url"), status.alias("status"), (k % 4).alias("depth"), F.lit("2024").alias("updated_at"))


@query(f"WITH {_QUEUE_SQL} SELECT url, status = 'processed' AS done FROM q WHERE run_key = 'r1' AND status != 'skipped'")
def run_checkpoint(spark, sf_dir):
    """A run's pages as it resumes: done, and still to do, however many (ST4)."""
    done, todo = frontier.checkpoint(_queue(spark, sf_dir), "r1")
    return done.select("url", F.lit(True).alias("done")).unionByName(todo.select("url", F.lit(False).alias("done")))


@query(f"""WITH {_QUEUE_SQL}, l AS (SELECT 'https://s/' || event_id % 7 AS src_url, 'https://p/' || event_id % 2500 AS dst_url, event_id % 9 + 1 AS score FROM events),
best AS (SELECT * FROM l WHERE dst_url NOT IN (SELECT url FROM q WHERE run_key = 'r1') QUALIFY row_number() OVER (PARTITION BY dst_url ORDER BY score DESC, src_url) = 1)
SELECT 'r1' AS run_key, dst_url AS url, 'pending' AS status, 3 AS depth, src_url AS parent_url FROM best""")
def enqueued_links(spark, sf_dir):
    """New rows of a run's queue: addresses it hasn't, each by its best link (ST2)."""
    k = F.col("event_id")
    links = read(spark, sf_dir, "events").select(F.concat(F.lit("https://s/"), _text(k % 7)).alias("src_url"), F.concat(F.lit("https://p/"), _text(k % 2500)).alias("dst_url"), (k % 9 + 1).alias("score"))
    return frontier.enqueue(_queue(spark, sf_dir), links, "r1", 2)


@query("""SELECT 'r' || k AS run_key, CASE WHEN k % 2 = 0 THEN 'old' ELSE 'new' END AS mode, CASE WHEN k % 3 = 0 THEN 'running' ELSE 'failed' END AS status, CASE WHEN k % 3 = 0 THEN NULL ELSE 'e' END AS last_error,
  CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'reopened' ELSE 'started' END END AS action FROM (SELECT c_custkey AS k FROM customer) WHERE k % 2 = 0 OR k % 3 = 0""")
def run_starts(spark, sf_dir):
    """Runs started anew or again (ST1): every second customer is a known run, every third one starts."""
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select(k, F.concat(F.lit("r"), _text(k)).alias("run_key"))
    text, moment = F.lit(None).cast("string"), F.lit("2024-01-01").cast("timestamp")
    known = c.where(k % 2 == 0).select("run_key", F.lit("old").alias("mode"), F.lit("u").alias("start_url"), F.lit("failed").alias("status"), text.alias("config"), moment.alias("updated_at"), moment.alias("completed_at"), F.lit("e").alias("last_error"))
    started = c.where(k % 3 == 0).select("run_key", F.lit("new").alias("mode"), F.lit("v").alias("start_url"), F.lit("c").alias("config"))
    return frontier.start_runs(known, started).select("run_key", "mode", "status", "last_error", "action")


@query(f"WITH v AS ({_VALUES_SQL}) SELECT seq, CASE WHEN name != '' THEN 'written' ELSE 'skipped' END AS write_status, CASE WHEN coalesce(name, '') = '' THEN 'missing_name' END AS write_reason, CASE WHEN name != '' THEN 'missing_table' END AS app_status FROM v")
def write_statuses(spark, sf_dir):
    """What became of each value record while the app table is missing (UPS7)."""
    return merge.write_results(merge.value_records(suppliers(spark, sf_dir)), table_exists=False).select("seq", "write_status", "write_reason", "app_status")


@query("SELECT o_orderkey AS run_key, o_orderdate AS updated_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30")
def run_history(spark, sf_dir):
    """The newest 30 runs (SNK6)."""
    return reports.run_history(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_key"), F.col("o_orderdate").alias("updated_at")))


@query("""WITH a AS (SELECT count(*) AS e, count(DISTINCT event_type) AS t FROM events), o AS (SELECT count(*) AS n FROM orders), c AS (SELECT count(*) AS n FROM customer), w AS (SELECT count(*) AS n FROM supplier)
SELECT x.part, x.n::BIGINT AS n FROM a, o, c, w, LATERAL (VALUES ('totals', 1), ('current_source_counts', 2), ('legacy_source_counts', least(20, t - 2)), ('recent_staging', least(30, o.n)), ('recent_app', least(30, c.n)),
  ('crawl_runs', least(20, w.n)), ('legacy_jobs', least(25, w.n)), ('legacy_errors', least(25, (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0))), ('warnings', 1)) x(part, n)""")
def dashboard_answer(spark, sf_dir):
    """The parts of the dashboard's one answer and their rows (SNK7)."""
    e, o, c, s = (read(spark, sf_dir, t) for t in ("events", "orders", "customer", "supplier"))
    stamp = F.lit("2024-01-01").cast("timestamp")
    jobs = s.select(F.col("s_suppkey").alias("id"), *[stamp.alias(x) for x in ("completed_at", "started_at", "created_at")], F.when(F.col("s_suppkey") % 2 == 0, "mapped").alias("error"))
    parts = reports.answer(
        "/api/dashboard", raw=e.select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("source")), current=["click", "view"], start=F.lit("1999-01-01").cast("timestamp"),
        staging=o.select(F.col("o_orderkey").alias("id"), stamp.alias("updated_at"), stamp.alias("created_at")), app=c.select(F.col("c_custkey").alias("id"), stamp.alias("updated_at"), stamp.alias("created_at")),
        runs=s.select(F.col("s_suppkey").alias("run_key"), stamp.alias("updated_at")), jobs=jobs, legacy=["purchase"],
    )
    out = [reports.count_all(df).select(F.lit(name).alias("part"), "n") for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), out)
