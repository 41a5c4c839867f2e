"""Queries by name, and the SQL that says what each must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import score as S
from ..functions import text as N
from ..functions import vocab
from ..operators import frontier, merge, records, reports
from ..sources import pages as P
from .session import read, shared_folder
from .shape import spread
from .views import EVENT_VALUES_SQL, SUPPLIERS_SQL, event_values, suppliers

#: The parts of an address, in order.
PLACE = "address city region postalCode country".split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# -- SQL building blocks, RE2 in place of Java's patterns -----------------------------

_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_ALNUM = "[:alnum:]"
EMAIL_SQL = f"[{_ALNUM}._%+-]+@[{_ALNUM}.-]+[.][[:alpha:]]{{2,}}"
POSTAL_SQL = r"(?i)\b(?:[0-9]{4,6}(?:-[0-9]{3,4})?|[A-Z][0-9][A-Z][ -]?[0-9][A-Z][0-9]|[A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2})\b"
_SEP = r"[\s.-]?"
PHONE_US_SQL = rf"(?:[+]?1{_SEP})?(?:[(]?[0-9]{{3}}[)]?{_SEP})[0-9]{{3}}{_SEP}[0-9]{{4}}"
PHONE_LOOSE_SQL = rf"(?:[+]?[0-9]{{1,3}}[\s().-]?)?(?:[(]?[0-9]{{2,4}}[)]?{_SEP})?[0-9]{{3,4}}{_SEP}[0-9]{{3,4}}"
PHONE_RUN_SQL = r"(?:[+]?[0-9][0-9\s().-]{7,}[0-9])"
STATE_SQL = rf"(?i)(?:^|[^\pL\pN_])({'|'.join(vocab.STATES)})(?:$|[^\pL\pN_])"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_SPACES}', ' ', 'g'))"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def _phone(x: str) -> str:
    d = f"regexp_replace({_clean(x)}, '\\D+', '', 'g')"
    n = f"CASE WHEN length({d}) = 11 AND {d} LIKE '1%' THEN substr({d}, 2) ELSE {d} END"
    return f"nullif(coalesce(nullif({n}, ''), {_clean(x)}), '')"


def _site(x: str) -> str:
    v = f"CASE WHEN {_clean(x)} LIKE '//%' THEN 'https:' || {_clean(x)} ELSE {_clean(x)} END"
    return f"CASE WHEN {_clean(x)} = '' THEN NULL WHEN regexp_matches({v}, '(?i)^https?://') THEN {v} ELSE 'https://' || ({v}) END"


def _url(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace({x}, '#.*$', ''), '/+$', ''), ''), regexp_replace({x}, '#.*$', ''))"


def _host(x: str) -> str:
    return f"nullif(lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '')"


_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sorted(vocab.COUNTRY_ALIASES.items())) + "}"
_STATES = ", ".join(f"'{s}'" for s in vocab.STATES)


def _country(code: str, name: str, region: str) -> tuple[str, str]:
    c, n, r = _clean(code), _clean(name), _clean(region)
    two = r"'^\pL{2}$'"
    codes = f"CASE WHEN regexp_matches({c}, {two}) THEN upper({c}) WHEN regexp_matches({n}, {two}) THEN upper({n}) WHEN {n} != '' THEN coalesce({_MAP}[lower({n})], 'XX') WHEN upper({r}) IN ({_STATES}) THEN 'US' ELSE 'XX' END"
    names = f"CASE WHEN regexp_matches({c}, {two}) THEN coalesce(nullif({n}, ''), upper({c})) WHEN regexp_matches({n}, {two}) THEN upper({n}) WHEN {n} != '' THEN {n} WHEN upper({r}) IN ({_STATES}) THEN 'United States' ELSE 'Unknown' END"
    return codes, names


def _address(*parts: str) -> str:
    """Blank and repeated parts left out."""
    kept = f"list_filter([{', '.join(_clean(p) for p in parts)}], lambda x: x != '')"
    return f"array_to_string(list_filter({kept}, lambda x, i: list_position(list_transform({kept}, lambda y: lower(y)), lower(x)) = i), ', ')"


def _terms(x: str, terms: list[str]) -> str:
    import re

    hits = [f"CASE WHEN regexp_matches(lower({x}), '(^|[^a-z0-9]){re.sub('[^a-z0-9 ]', lambda m: '[' + m[0] + ']', t)}($|[^a-z0-9])') THEN '{t}' END" for t in terms]
    return f"list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL)"


# -- scalars ---------------------------------------------------------------------------


@query(f"SELECT c_custkey, {_norm('c_name')} AS normalized, {_clean('c_mktsegment')} AS segment, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer")
def normalize_names(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", N.normalized_name("c_name").alias("normalized"), N.clean("c_mktsegment").alias("segment"), N.slug("c_name", "").alias("slug"))


@query(f"SELECT doc_id, sha256({_norm('text')}) AS fingerprint, length({_clean('text')})::BIGINT AS clean_chars FROM documents")
def normalize_document_fingerprint(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", N.sha256(N.normalized_name("text")).alias("fingerprint"), F.length(N.clean("text")).cast("long").alias("clean_chars"))


@query(f"""SELECT doc_id, regexp_extract(text, '{EMAIL_SQL}', 0) AS email, regexp_extract(text, '{PHONE_US_SQL}', 0) AS phone_us,
  regexp_extract(text, '{PHONE_LOOSE_SQL}', 0) AS phone_loose, regexp_extract(text, '{PHONE_RUN_SQL}', 0) AS phone_run,
  regexp_extract(text, '{POSTAL_SQL}', 0) AS postal FROM documents""")
def extract_email_phone_postal(spark, sf_dir):
    found = {"email": E.EMAIL, "phone_us": E.PHONE_US, "phone_loose": E.PHONE_LOOSE, "phone_run": E.PHONE_RUN, "postal": E.POSTAL}
    return read(spark, sf_dir, "documents").select("doc_id", *[E.first_match("text", p).alias(k) for k, p in found.items()])


@query(f"SELECT doc_id, upper(regexp_extract(text, '{STATE_SQL}', 1)) AS state FROM documents")
def extract_state(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.upper(E.first_match("text", E.STATE, 1)).alias("state"))


@query(f"SELECT doc_id, {_phone(f'''regexp_extract(text, '{PHONE_US_SQL}', 0)''')} AS phone FROM documents")
def normalize_phone_from_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", N.normalize_phone(E.first_match("text", E.PHONE_US)).alias("phone"))


@query(f"SELECT page_id, {_url('url')} AS normalized, {_host('url')} AS host, {_site('''regexp_replace(url, '^https?:', '')''')} AS site FROM pages")
def normalize_urls(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", N.normalized_url("url").alias("normalized"), N.url_host("url").alias("host"), N.normalize_site(F.regexp_replace("url", "^https?:", "")).alias("site"))


@query(f"SELECT {_host('url')} AS host, count(*)::BIGINT AS n FROM pages GROUP BY 1")
def url_host_counts(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(N.url_host("url").alias("host")).agg(F.count("*").alias("n"))


_CC, _CN = _country("countryCode", "country", "region")


@query(f"WITH s AS ({SUPPLIERS_SQL}) SELECT seq, {_CC} AS code, {_CN} AS name FROM s")
def country_lookup(spark, sf_dir):
    c = N.normalize_country("countryCode", "country", "region")
    return suppliers(spark, sf_dir).select("seq", c["code"].alias("code"), c["name"].alias("name"))


_FULL = _address(*PLACE)


@query(f"WITH s AS ({SUPPLIERS_SQL}) SELECT seq, {_FULL} AS full_address FROM s")
def full_address_build(spark, sf_dir):
    return suppliers(spark, sf_dir).select("seq", N.full_address(*PLACE).alias("full_address"))


def _has(*xs: str) -> str:
    return " OR ".join(f"coalesce({x}, '') != ''" for x in xs)


_CONF = f"""least(0.30::DOUBLE + (CASE WHEN {_has('name')} THEN 0.20 ELSE 0 END)::DOUBLE + (CASE WHEN {_FULL} != '' THEN 0.20 ELSE 0 END)::DOUBLE
  + (CASE WHEN {_has('phone')} THEN 0.10 ELSE 0 END)::DOUBLE + (CASE WHEN {_has('website', 'sourceUrl')} THEN 0.10 ELSE 0 END)::DOUBLE
  + (CASE WHEN ({_has('lat')}) AND ({_has('lng')}) THEN 0.10 ELSE 0 END)::DOUBLE, 0.95::DOUBLE)"""


@query(f"WITH s AS ({SUPPLIERS_SQL}) SELECT seq, {_CONF} AS confidence FROM s")
def confidence_score(spark, sf_dir):
    full = N.full_address(*PLACE)
    return suppliers(spark, sf_dir).select("seq", S.confidence("name", full, "phone", F.lit(""), *"website sourceUrl lat lng".split()).alias("confidence"))


_VALUES_SQL = f"""WITH s AS ({SUPPLIERS_SQL}) SELECT seq, {_clean('name')} AS name, {_norm('name')} AS normalized_name, {_CC} AS country_code, {_CN} AS country,
  {_clean('city')} AS city, {_clean('region')} AS region, {_clean('postalCode')} AS postal_code, coalesce(nullif({_clean('services')}, ''), 'healthcare provider') AS category,
  {_FULL} AS address, {_phone('phone')} AS phone, {_site('website')} AS website, try_cast(nullif(lat, '') AS DOUBLE) AS latitude, try_cast(nullif(lng, '') AS DOUBLE) AS longitude,
  {_CONF} AS confidence_score,
  sha256(coalesce(nullif({_clean('sourceUrl')}, ''), {_phone('phone')}, {_site('website')}, {_norm('name')} || '|' || {_norm(_FULL)})) AS dedupe_key,
  'scrapy_directory' AS source_query, '' AS crawl_run_key, coalesce(lat, '') != '' AND try_cast(nullif(lat, '') AS DOUBLE) IS NULL AS bad_number
FROM s"""


@query(_VALUES_SQL)
def value_records(spark, sf_dir):
    return merge.value_records(suppliers(spark, sf_dir)).select("seq", *merge.VALUE_FIELDS, "bad_number")


@query(f"""WITH s AS ({SUPPLIERS_SQL}) SELECT seq, CASE WHEN seq % 23 = 0 THEN 'discovered_link' WHEN {_clean('name')} = '' THEN 'missing_name'
  WHEN NOT ({_has('sourceUrl', 'website', 'phone')} OR {_has('lat', 'lng', *PLACE)}) THEN 'missing_evidence' END AS drop_reason,
  'provider-fingerprint://' || sha256(lower({_clean('name')}) || '|' || lower({_clean('address')}) || '|' || lower({_clean('city')}) || '|' || lower({_clean('region')}) || '|' || lower({_clean('postalCode')})
    || '|' || lower({_clean('country')}) || '|' || lower({_clean('phone')}) || '|' || lower({_clean('website')})) AS fingerprint, nullif(sourceUrl, '') AS evidence_url
FROM s""")
def item_gate(spark, sf_dir):
    items = suppliers(spark, sf_dir).withColumn("type", F.when(F.col("seq") % 23 == 0, "discovered_link"))
    return merge.clean_items(items).select("seq", "drop_reason", F.col("sourceUrl").alias("fingerprint"), F.col("evidenceUrl").alias("evidence_url"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.source'), 'unknown') AS source FROM events")
def json_fields(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", N.json_field("props", "$.k").alias("k"), N.json_field("props", "$.source").alias("source"))


_WORDS = ["the", "in", "ist", "no", "of the"]


@query(f"SELECT doc_id, array_to_string({_terms('text', _WORDS)}, ';') AS terms FROM documents")
def vocabulary_terms(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(E.terms_in("text", _WORDS), ";").alias("terms"))


# -- import ------------------------------------------------------------------------------

#: The part table's own words in place of the default vocabularies.
ACCEPT, REJECT = ["ring", "widget", "gear", "small ring", "economy"], ["plate", "anvil", "old bolt"]


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    blank = {c: F.lit("") for c in ("city", "state", "postalCode", "email", "website", "sourceType", "sourceTag", "lat", "lng")}
    return p.select(
        k.alias("position"), F.when(k % 19 == 0, "").otherwise(F.col("p_name")).alias("name"), F.lower("p_type").alias("services"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("Shelf "), (k % 50).cast("string"))).alias("address"), F.when(k % 4 == 0, "").otherwise((k % 40).cast("string")).alias("phone"),
        F.when(k % 29 == 0, F.concat(F.lit("https://p/"), k.cast("string"))).otherwise("").alias("sourceUrl"), F.concat(F.lit("brand "), F.col("p_brand")).alias("evidenceNote"),
        *[v.alias(c) for c, v in blank.items()],
    )


_PARTS_SQL = """SELECT p_partkey AS position, CASE WHEN p_partkey % 19 = 0 THEN '' ELSE p_name END AS name, lower(p_type) AS services,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Shelf ' || (p_partkey % 50) END AS address, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE (p_partkey % 40)::VARCHAR END AS phone,
  CASE WHEN p_partkey % 29 = 0 THEN 'https://p/' || p_partkey ELSE '' END AS sourceUrl, 'brand ' || p_brand AS evidenceNote FROM part"""

_SCORED_SQL = f"""rows_read AS ({_PARTS_SQL}),
hits AS (SELECT *, {_terms("(name || ' ' || services || ' ' || evidenceNote)", REJECT)} AS rejects, {_terms('services', ACCEPT)} AS a, {_terms('name', ACCEPT)} AS b, {_terms('evidenceNote', ACCEPT)} AS c,
  address != '' AS placed, (phone != '' OR sourceUrl != '') AS reachable FROM rows_read),
judged AS (SELECT *, CASE WHEN len(rejects) > 0 THEN -10 ELSE 6 * (len(a) > 0)::INT + 4 * (len(b) > 0)::INT + 2 * (len(c) > 0)::INT + placed::INT + reachable::INT END AS score,
  CASE WHEN len(rejects) > 0 THEN list_transform(rejects, lambda x: 'reject:' || x) ELSE list_transform(a[1:5], lambda x: 'service:' || x) || list_transform(b[1:3], lambda x: 'name:' || x)
    || list_transform(c[1:3], lambda x: 'evidence:' || x) || CASE WHEN placed THEN ['location evidence'] ELSE [] END || CASE WHEN reachable THEN ['contact/source evidence'] ELSE [] END END AS reasons,
  CASE WHEN len(rejects) > 0 THEN 'excluded business category' WHEN name = '' THEN 'missing name' WHEN NOT placed AND NOT reachable THEN 'missing location/contact/source evidence' ELSE 'below min score' END AS rejection
  FROM hits),
scored AS (SELECT *, score >= 5 AND NOT starts_with(rejection, 'missing') AS accepted FROM judged
  QUALIFY row_number() OVER (PARTITION BY lower(name), lower(address), phone, sourceUrl ORDER BY position) = 1)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.score_rows(_parts(spark, sf_dir), 5, ACCEPT, REJECT)


@query(f"WITH {_SCORED_SQL} SELECT position, name, score::INT AS score, array_to_string(reasons, '; ') AS match_reasons, rejection AS rejection_reason, accepted FROM scored")
def vocab_accept_reject(spark, sf_dir):
    return _scored(spark, sf_dir).select("position", "name", "score", "match_reasons", "rejection_reason", "accepted")


@query(f"WITH {_SCORED_SQL} SELECT rejection AS reason, count(*)::BIGINT AS n FROM scored WHERE NOT accepted GROUP BY 1 ORDER BY n DESC, min(position) LIMIT 10")
def reject_reasons_top10(spark, sf_dir):
    return records.top_reasons(_scored(spark, sf_dir), False)


@query(f"""WITH {_SCORED_SQL}, each AS (SELECT position, unnest(CASE WHEN len(reasons) > 0 THEN reasons ELSE ['accepted'] END) AS reason, generate_subscripts(CASE WHEN len(reasons) > 0 THEN reasons ELSE ['accepted'] END, 1) AS i FROM scored WHERE accepted)
SELECT reason, count(*)::BIGINT AS n FROM each GROUP BY 1 ORDER BY n DESC, min((position, i)) LIMIT 10""")
def accept_reasons_top10(spark, sf_dir):
    return records.top_reasons(_scored(spark, sf_dir), True)


@query(f"WITH {_SCORED_SQL} SELECT (SELECT count(*) FROM rows_read)::BIGINT AS total_rows_read, count(*) FILTER (accepted)::BIGINT AS accepted_count, count(*) FILTER (NOT accepted)::BIGINT AS rejected_count FROM scored")
def import_totals(spark, sf_dir):
    report = records.import_report(_parts(spark, sf_dir), _scored(spark, sf_dir))
    return report.select("total_rows_read", "accepted_count", "rejected_count")


@query(f"""WITH p AS (SELECT p_partkey, p_name || ', ' || (p_partkey % 90) || ' Main St, ' || ['Mobile', 'Austin', ''][(p_partkey % 3 + 1)::INT] || ', ' || ['AL', 'tx', 'Nowhere'][(p_partkey % 3 + 1)::INT] || ' ' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') AS addr FROM part),
d AS (SELECT *, substr(addr, strpos(addr, ', ') + 2) AS rest FROM p),
parts AS (SELECT *, list_filter(list_transform(string_split(rest, ','), lambda x: trim(x)), lambda x: x != '') AS parts FROM d)
SELECT p_partkey, rest AS address, upper(regexp_extract(rest, '{STATE_SQL}', 1)) AS state, regexp_extract(rest, '\\b[0-9]{{5}}(?:-[0-9]{{4}})?\\b', 0) AS postalCode,
  coalesce(list_filter(parts, lambda x, i: i < len(parts) AND regexp_matches(parts[i + 1], '{STATE_SQL}'))[1], '') AS city FROM parts""")
def derive_address_parts(spark, sf_dir):
    k = F.col("p_partkey")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % 3 + 1).cast("int"))
    addr = F.concat("p_name", F.lit(", "), (k % 90).cast("string"), F.lit(" Main St, "), pick(["Mobile", "Austin", ""]), F.lit(", "), pick(["AL", "tx", "Nowhere"]), F.lit(" "), F.lpad((k % 100000).cast("string"), 5, "0"))
    d = E.address_parts(addr, "p_name", F.lit(""), F.lit(""), F.lit(""))
    return spread(read(spark, sf_dir, "part")).select("p_partkey", d.alias("d")).select("p_partkey", "d.address", "d.state", "d.postalCode", "d.city")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
c AS (SELECT doc_id, n, trim(trim(regexp_replace(line, '[\\s\\x{a0}•]+', ' ', 'g')), ' ,;|') AS line FROM l),
f AS (SELECT *, (length(line) <= 160 AND NOT regexp_matches(line, '^[[:alpha:]][[:alpha:] ./_-]{1,35}\\s*(?:=|:)')
  AND (regexp_matches(lower(line), '(^|[^a-z0-9])the($|[^a-z0-9])') OR regexp_matches(lower(line), '(^|[^a-z0-9])der($|[^a-z0-9])')
    OR (regexp_matches(line, '^[[:upper:][:digit:]][[:alnum:] +,./&''()-]{2,120}$') AND len(string_split(line, ' ')) <= 10 AND NOT regexp_matches(line, '[0-9]'))))::INT AS start FROM c WHERE line != ''),
r AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY n) - first_value(start) OVER (PARTITION BY doc_id ORDER BY n) AS rec FROM f)
SELECT doc_id, rec::INT AS position, count(*)::BIGINT AS n_lines, length(string_agg(line, chr(10) ORDER BY n))::BIGINT AS chars FROM r GROUP BY 1, 2""")
def text_line_islands(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.regexp_replace("text", "\n\\s*\n", "\n").alias("text"))
    blocks = records.text_blocks(d, accept=["the"], reject=["der"])
    return blocks.select(F.col("doc").alias("doc_id"), "position", F.size(F.split("block", "\n")).cast("long").alias("n_lines"), F.length("block").cast("long").alias("chars"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
c AS (SELECT doc_id, line_no, trim(trim(regexp_replace(line, '[\\s\\x{a0}]+', ' ', 'g')), ' ,;') AS line FROM l),
w AS (SELECT doc_id, line_no, line, concat_ws(' ', line, lead(line, 1) OVER o, lead(line, 2) OVER o, lead(line, 3) OVER o, lead(line, 4) OVER o) AS blob FROM c WHERE line != '' WINDOW o AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, line_no::INT AS line_no, left(line, 160) AS name, length(blob)::BIGINT AS chars FROM w WHERE contains(lower(blob), 'the') OR contains(lower(blob), 'les')""")
def sliding_line_window(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), "text")
    out = P.text_windows(d, ["the", "les"])
    return out.select(F.col("doc").alias("doc_id"), "line_no", "name", F.length("blob").cast("long").alias("chars"))


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
c AS (SELECT doc_id, line_no, trim(trim(regexp_replace(line, '[\\s\\x{{a0}}]+', ' ', 'g')), ' ,;') AS line FROM l),
w AS (SELECT doc_id, line_no, line, concat_ws(' ', line, lead(line, 1) OVER o, lead(line, 2) OVER o, lead(line, 3) OVER o, lead(line, 4) OVER o) AS blob FROM c WHERE line != '' WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
f AS (SELECT *, regexp_extract(blob, '{PHONE_RUN_SQL}') AS phone, regexp_extract(blob, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}') AS email, regexp_extract(blob, '(?:https?://|www\\.)\\S+') AS website FROM w)
SELECT doc_id, line_no::INT AS line_no, left(line, 160) AS name, length(blob)::BIGINT AS chars, left(blob, 500) AS address, phone, email, website FROM f
WHERE (contains(lower(blob), 'the') OR contains(lower(blob), 'les')) AND (phone != '' OR email != '' OR website != '')""")
def printed_contact_windows(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), "text")
    out = P.printed_text_windows(d, ["the", "les"])
    return out.select(F.col("doc").alias("doc_id"), "line_no", "name", F.length("blob").cast("long").alias("chars"), "address", "phone", "email", "website")


@query("""WITH r AS (SELECT s_suppkey AS row_no, s_suppkey % 2 AS file_no,
  ['Canada', ' usa ', '', 'Narnia'][(s_nationkey % 4 + 1)::INT] AS country, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'https://s' || s_suppkey || '.example.com' END AS url,
  CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE ['facility_registry', 'authority_discovery', ' Facility_Registry '][(s_suppkey % 3 + 1)::INT] END AS mode, CASE WHEN s_suppkey % 4 = 0 THEN 'False' ELSE 'true' END AS enabled,
  CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE 'tag' || s_suppkey END AS tag FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT url, trim(country) AS country, CASE WHEN tag != '' THEN tag ELSE 'gov_health_' || replace(lower(trim(country)), ' ', '-') END AS source_tag FROM r
WHERE trim(country) != '' AND url != '' AND lower(trim(country)) IN ('canada', 'usa') AND coalesce(nullif(lower(trim(mode)), ''), 'authority_discovery') = 'facility_registry' AND enabled != 'False'
ORDER BY file_no, row_no LIMIT 20""")
def registry_seed_filter(spark, sf_dir):
    k = F.col("s_suppkey")
    pick = lambda xs, by, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (by % n + 1).cast("int"))
    r = read(spark, sf_dir, "supplier").select(
        k.alias("row_no"), (k % 2).alias("file_no"), pick(["Canada", " usa ", "", "Narnia"], F.col("s_nationkey"), 4).alias("country"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example.com"))).alias("url"),
        F.when(k % 5 == 0, "").otherwise(pick(["facility_registry", "authority_discovery", " Facility_Registry "], k, 3)).alias("crawlMode"),
        F.when(k % 4 == 0, "False").otherwise("true").alias("enabled"), F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("tag"), k.cast("string"))).alias("sourceTag"),
    )
    return records.registry_seeds(r, ["Canada", "USA"], max_sources=20)


# -- links and frontier ---------------------------------------------------------------------

_LINKS_SQL = f"""a AS (SELECT url AS src_url, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref="([^"]*)"[^>]*>(.*?)</a>', 0)) AS a FROM pages),
h AS (SELECT src_url, regexp_extract(a, '(?is)href="([^"]*)"', 1) AS href, trim(trim(regexp_replace(regexp_replace(regexp_extract(a, '(?is)>(.*?)</a>', 1), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), ' ,;|') AS anchor FROM a),
links AS (SELECT src_url, {_url("CASE WHEN regexp_matches(href, '^https?:') THEN href ELSE regexp_extract(src_url, '^(https?://[^/?#]*)', 1) || href END")} AS dst_url, anchor FROM h WHERE href != '')"""


@query(f"WITH {_LINKS_SQL} SELECT * FROM links")
def page_links(spark, sf_dir):
    return frontier.page_links(read(spark, sf_dir, "pages"))


#: Words that the pages do hold, in place of the default vocabularies.
LINK_WORDS = {"follow": ["the", "ou", "sch"], "paging": ["page=", "an"], "health": ["er", "que"], "skip": ["est", "for"], "skip_extensions": ["d", ".ss"]}
_POINTS = " + ".join([*(f"5 * contains(blob, '{t}')::INT" for t in LINK_WORDS["paging"]), *(f"3 * contains(blob, '{t}')::INT" for t in LINK_WORDS["follow"])])
_SCORE_SQL = f"""WITH {_LINKS_SQL}, b AS (SELECT *, lower(anchor || ' ' || dst_url) AS blob, {_host('src_url')} AS a, {_host('dst_url')} AS b, lower(regexp_extract(dst_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS path FROM links),
s AS (SELECT *, coalesce(a = b OR ends_with(b, '.' || a), false) AS near FROM b),
t AS (SELECT *, near::INT + {_POINTS} + 2 * (contains(blob, 'er') OR contains(blob, 'que'))::INT AS score_ FROM s)
SELECT DISTINCT src_url, dst_url, (CASE WHEN NOT regexp_matches(dst_url, '^https?://') OR contains(blob, 'est') OR contains(blob, 'for') OR ends_with(path, 'd') OR ends_with(path, '.ss') OR NOT near THEN -100
  WHEN score_ >= 3 THEN score_ ELSE -1 END)::INT AS score FROM t"""


@query(f"SELECT * FROM ({_SCORE_SQL}) WHERE score > 0")
def link_score(spark, sf_dir):
    return frontier.scored_links(read(spark, sf_dir, "pages"), **LINK_WORDS)


@query(f"SELECT s.* FROM ({_SCORE_SQL}) s WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT dst_url FROM ({_SCORE_SQL}) WHERE src_url IN (SELECT url FROM pages WHERE page_id % 2 = 0)) q WHERE q.dst_url = s.dst_url)")
def frontier_anti_join(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    # A page is its address: where several rows have one, the links of all of them are seen.
    even = p.where("page_id % 2 = 0").select("url").distinct()
    seen = frontier.page_links(p.join(even, "url", "left_semi")).select(F.col("dst_url").alias("url")).distinct()
    return frontier.unseen(frontier.scored_links(p, **LINK_WORDS), seen)


_CRAWL_SQL = f"""WITH RECURSIVE scored AS (SELECT DISTINCT {_url('src_url')} AS src_url, dst_url FROM ({_SCORE_SQL}) WHERE score > 0),
walk AS (SELECT DISTINCT {_url('url')} AS url, 0 AS depth FROM pages WHERE page_id % 10 = 0 UNION SELECT s.dst_url, w.depth + 1 FROM walk w JOIN scored s ON w.url = s.src_url WHERE w.depth < 3)
SELECT url, min(depth)::INT AS depth, bool_or(url IN (SELECT {_url('url')} FROM pages)) AS fetched FROM walk GROUP BY url"""


@query(_CRAWL_SQL)
def crawl_levels(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return frontier.crawl(p, p.where("page_id % 10 = 0").select("url"), max_depth=3, **LINK_WORDS)


_TITLE, _H1 = "(?is)<title>(.*?)</title>", "(?is)<h1>(.*?)</h1>"


@query(f"SELECT page_id, {_clean(f'''regexp_extract(html, '{_TITLE}', 1)''')} AS title, {_clean(f'''regexp_extract(html, '{_H1}', 1)''')} AS h1 FROM pages")
def html_title_h1(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", N.clean(E.first_match("html", _TITLE, 1)).alias("title"), N.clean(E.first_match("html", _H1, 1)).alias("h1"))


@query()
def html_records(spark, sf_dir):
    return P.extract_records(read(spark, sf_dir, "pages"), run_key="run", terms=["ing", "ung", "eau", "ado"])


@query()
def html_rule_records(spark, sf_dir):
    rules = {"sourceTag": "pages", "listSelector": "article", "fields": {"name": "h1::text", "services": {"css": "p::text", "join": " "}}, "follow": {"pagination": {"xpath": "//nav//a/@href"}}}
    return P.rule_records(read(spark, sf_dir, "pages"), rules)


# -- merges -----------------------------------------------------------------------------


@query(f"SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY {_norm('text')} ORDER BY doc_id) = 1")
def dedupe_documents(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", N.sha256(N.normalized_name("text")).alias("k"))
    return merge.first_wins(d, [F.col("k")], [F.col("doc_id")]).drop("k")


def _first(c: str, ok: str) -> str:
    return f"arg_min({c}, seq) FILTER ({ok})"


_FOLD = ", ".join(f"coalesce({_first(c, _has(c))}, arg_max_null({c}, seq)) AS {c}" for c in merge.FILL_TEXT)
_STAGING_SQL = f"""WITH v AS ({EVENT_VALUES_SQL}) SELECT dedupe_key, arg_min(name, seq) AS name, arg_min(normalized_name, seq) AS normalized_name, arg_min(category, seq) AS category, 'new' AS status,
  coalesce({_first('country_code', "country_code NOT IN ('US', 'XX')")}, CASE WHEN bool_or(country_code = 'US') THEN 'US' END, 'XX') AS country_code, {_FOLD},
  {_first('latitude', 'latitude IS NOT NULL')} AS latitude, {_first('longitude', 'longitude IS NOT NULL')} AS longitude, max(confidence_score) AS confidence_score FROM v GROUP BY dedupe_key"""


@query(_STAGING_SQL)
def staging_upsert_fold(spark, sf_dir):
    return merge.staging_upsert(event_values(spark, sf_dir))


@query(_STAGING_SQL)
def staging_upsert_on_existing(spark, sf_dir):
    """The same fold in two steps: the first half becomes the existing table."""
    v = event_values(spark, sf_dir)
    half = merge.staging_upsert(v.where("seq < 4000"))
    return merge.staging_upsert(v.where("seq >= 4000"), half)


@query(_STAGING_SQL)
def stream_upsert(spark, sf_dir):
    """The same fold as a stream that is stopped and resumed: each run takes all files that have come
    since, so the order is that of the parts, however many files each of them has."""
    import uuid

    from ..streaming import incremental

    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    v = event_values(spark, sf_dir)
    for k, part in enumerate(("seq < 3000", "seq >= 3000")):
        v.where(part).write.parquet(f"{folder}/in/{k}")
        stream = spark.readStream.schema(v.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        incremental.stream_upsert(stream, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return incremental.latest(spark, f"{folder}/table")


_EXISTING = "c_custkey % 3 = 0"
_MATCH_SQL = f"""WITH e AS (SELECT c_custkey AS id, 'k' || c_custkey AS dedupe_key, 'u' || (c_custkey // 2) AS source_url, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 700)::VARCHAR END AS phone, {_norm('c_name')} AS normalized_name, c_mktsegment AS address FROM customer WHERE {_EXISTING}),
i AS (SELECT c_custkey AS seq, 'k' || (c_custkey + c_custkey % 4) AS dedupe_key, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'u' || (c_custkey // 3) END AS source_url, (c_custkey % 900)::VARCHAR AS phone, {_norm('c_name')} AS normalized_name, lower(c_mktsegment) AS address FROM customer WHERE NOT ({_EXISTING})),
m AS (SELECT seq, id, 0 AS priority FROM i JOIN e USING (dedupe_key) UNION ALL SELECT seq, id, 3 FROM i JOIN e USING (source_url) WHERE source_url != '' UNION ALL SELECT seq, id, 4 FROM i JOIN e USING (phone)
  UNION ALL SELECT seq, id, 8 FROM i JOIN e ON lower(i.normalized_name) = lower(e.normalized_name) AND lower(i.address) = lower(e.address))
SELECT seq, id, priority::INT AS priority FROM m QUALIFY row_number() OVER (PARTITION BY seq ORDER BY priority, id) = 1"""


def _app_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, sf_dir, "customer")
    k, text = F.col("c_custkey"), lambda x: x.cast("string")
    named = N.normalized_name("c_name").alias("normalized_name")
    half = F.expr("c_custkey div 2")
    old = c.where(_EXISTING).select(k.alias("id"), F.concat(F.lit("k"), text(k)).alias("dedupe_key"), F.concat(F.lit("u"), text(half)).alias("source_url"), F.when(k % 2 == 0, text(k % 700)).alias("phone"), named, F.col("c_mktsegment").alias("address"))
    third = F.expr("c_custkey div 3")
    new = c.where(f"not ({_EXISTING})").select(
        k.alias("seq"), F.concat(F.lit("k"), text(k + k % 4)).alias("dedupe_key"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("u"), text(third))).alias("source_url"), text(k % 900).alias("phone"), named, F.lower("c_mktsegment").alias("address")
    )
    return new, old


@query(_MATCH_SQL)
def app_upsert_priority_match(spark, sf_dir):
    return merge.match_existing(*_app_tables(spark, sf_dir))


@query()
def app_upsert(spark, sf_dir):
    new, old = _app_tables(spark, sf_dir)
    return merge.app_upsert(new, old)


@query(f"""WITH v AS ({_VALUES_SQL}) SELECT seq, nullif(name, '') AS provider_name, nullif(address, '') AS address, nullif(region, '') AS admin_area, nullif(postal_code, '') AS zip, phone, website AS url,
  latitude AS lat, category AS clinic_type, 'scrapy_directory' AS source_kind, dedupe_key AS external_key, confidence_score AS confidence, 'candidate' AS status FROM v""")
def app_columns(spark, sf_dir):
    columns = ["provider_name", "address", "admin_area", "zip", "phone", "url", "lat", "clinic_type", "source_kind", "external_key", "confidence", "status"]
    return merge.app_values(merge.value_records(suppliers(spark, sf_dir)), columns)


# -- reports -----------------------------------------------------------------------------

_CURRENT = ["click", "view"]


@query("SELECT event_type AS source, count(*)::BIGINT AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def source_counts(spark, sf_dir):
    return reports.source_counts(read(spark, sf_dir, "events"), F.col("event_type"), _CURRENT)


@query("SELECT user_id::VARCHAR AS source, count(*)::BIGINT AS n FROM events WHERE user_id NOT IN (1, 2) GROUP BY 1 ORDER BY n DESC, source LIMIT 20")
def other_sources_top20(spark, sf_dir):
    return reports.source_counts(read(spark, sf_dir, "events"), F.col("user_id").cast("string"), ["1", "2"], complement=True, most=20)


@query("SELECT coalesce(json_extract_string(props, '$.k'), 'unknown') AS source, count(*)::BIGINT AS n FROM events GROUP BY 1")
def json_source_counts(spark, sf_dir):
    return reports.source_counts(read(spark, sf_dir, "events"), N.json_field("props", "$.k"))


@query("SELECT event_id, ts, user_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 30")
def recent_top30(spark, sf_dir):
    return reports.recent(read(spark, sf_dir, "events"), ["ts"], 30, "event_id", ["event_id", "ts", "user_id", "event_type", "value"])


@query("SELECT o_orderkey, o_orderstatus, coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END, o_orderdate + INTERVAL 1 DAY) AS moment FROM orders ORDER BY moment DESC, o_orderkey DESC LIMIT 25")
def recent_jobs_top25(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("a"), (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("b"))
    return reports.recent(o, ["a", "b"], 25, "o_orderkey").select("o_orderkey", "o_orderstatus", F.coalesce("a", "b").alias("moment"))


@query("SELECT count(*)::BIGINT AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_type IN ('click', 'view')")
def count_since(spark, sf_dir):
    return reports.count_since(read(spark, sf_dir, "events"), F.col("ts"), F.lit("2024-01-15").cast("timestamp"), F.col("event_type"), _CURRENT)


_ERRORS = "CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'No Mapped results' ELSE 'timeout ' || event_id END END"


@query(f"SELECT CASE WHEN regexp_matches(e, '(?i)mapped') THEN 'legacy_map_scraper' ELSE 'error' END AS kind, count(*)::BIGINT AS n FROM (SELECT {_ERRORS} AS e FROM events) WHERE e IS NOT NULL GROUP BY 1")
def error_kind_counts(spark, sf_dir):
    k = F.col("event_id")
    text = F.when(F.col("event_type") == "error", F.when(k % 3 == 0, "No Mapped results").otherwise(F.concat(F.lit("timeout "), k.cast("string"))))
    return read(spark, sf_dir, "events").select(text.alias("e")).where("e is not null").groupBy(N.error_kind("e").alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id % 20 AS run_key, event_id AS seq, 'p' || event_id AS url, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'pending' ELSE 'processed' END AS status,
  (event_id % 5)::BIGINT AS found, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'e' || event_id END AS error FROM events)
SELECT run_key, count(*) FILTER (status = 'processed')::BIGINT AS pages_crawled, coalesce(sum(found) FILTER (status = 'processed'), 0)::BIGINT AS providers_found,
  arg_max(url, seq) FILTER (status = 'processed' OR error IS NOT NULL) AS last_url, arg_max(error, seq) FILTER (status != 'processed' AND error IS NOT NULL) AS last_error FROM e GROUP BY 1""")
def crawl_run_rollup(spark, sf_dir):
    k, t = F.col("event_id"), F.col("event_type")
    e = read(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("run_key"), k.alias("seq"), F.concat(F.lit("p"), k.cast("string")).alias("url"), F.when(t == "error", "failed").when(t == "signup", "pending").otherwise("processed").alias("status"),
        (k % 5).alias("found"), F.when((t == "error") & (k % 2 == 0), F.concat(F.lit("e"), k.cast("string"))).alias("error"),
    )
    return frontier.run_rollup(e)


@query("SELECT user_id, event_type, value, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'running' END AS status FROM events WHERE event_type != 'signup' ORDER BY ts DESC, user_id DESC LIMIT 1")
def latest_resumable_run(spark, sf_dir):
    t = F.col("event_type")
    runs = read(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("ts").alias("updated_at"), F.col("user_id").alias("run_key"), F.when(t == "error", "failed").when(t == "signup", "completed").otherwise("running").alias("status"))
    return frontier.latest_resumable(runs).select("user_id", "event_type", "value", "status")


@query("""SELECT (SELECT count(*) FROM events)::BIGINT AS raw_results, (SELECT count(*) FROM orders)::BIGINT AS staging_rows,
  (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_type IN ('click', 'view'))::BIGINT AS current_raw_since_start, (SELECT count(*) FROM customer)::BIGINT AS app_candidates""")
def dashboard_totals(spark, sf_dir):
    e, o, c = (read(spark, sf_dir, t) for t in ("events", "orders", "customer"))
    return reports.dashboard_totals(e, o, c, count_since(spark, sf_dir))


@query("SELECT page_id, url, country FROM (SELECT page_id, url, ['de', 'en', 'es', 'fr'][(page_id % 4 + 1)::INT] AS country, page_id % 6 AS depth FROM pages) QUALIFY row_number() OVER (PARTITION BY country ORDER BY depth, url) <= 7")
def pages_per_country(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    country = F.element_at(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), (F.col("page_id") % 4 + 1).cast("int"))
    capped = frontier.cap_per_country(p.select("page_id", "url", country.alias("country"), (F.col("page_id") % 6).alias("depth")), 7)
    return capped.select("page_id", "url", "country")


# -- more extraction ------------------------------------------------------------------


@query(r"SELECT page_id, array_to_string(regexp_extract_all('at ' || url || ', or www.x.org/a;', '(?i)(?:https?://|www[.])[^\s;,)<]+', 0), ' ') AS listed, regexp_extract('at ' || url || ' too', '(?:https?://|www[.])\S+', 0) AS first FROM pages")
def extract_urls(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    listed = E.all_matches(F.concat(F.lit("at "), "url", F.lit(", or www.x.org/a;")), E.URL_LISTED)
    return p.select("page_id", F.array_join(listed, " ").alias("listed"), E.first_match(F.concat(F.lit("at "), "url", F.lit(" too")), E.URL_ANY).alias("first"))


_PIECES = ["the", "ing", "ou", "sch"]
_CONTAINED = ", ".join(f"CASE WHEN contains(lower(text), '{t}') THEN '{t}' END" for t in _PIECES)


@query(f"SELECT doc_id, array_to_string(list_filter([{_CONTAINED}], lambda x: x IS NOT NULL), ';') AS terms, left(text, 180) AS head FROM documents")
def substring_terms(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(E.substrings_in("text", _PIECES), ";").alias("terms"), N.truncate("text", 180).alias("head"))


_CHUNK = f"trim(trim(regexp_replace(x, '{_SPACES}', ' ', 'g')), ' ,;|')"


@query(f"""SELECT doc_id, coalesce(list_filter(list_transform(regexp_split_to_array(text, '[|•\\n]'), lambda x: {_CHUNK}),
  lambda x: length(x) BETWEEN 8 AND 260 AND regexp_matches(x, '[0-9]') AND (regexp_matches(x, '{POSTAL_SQL}') OR regexp_matches(x, '{E.STREET}')))[1], '') AS address FROM documents""")
def address_like_lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", E.address_like_line("text").alias("address"))


_FOUND = ["the", "en", "es"]


@query(f"""WITH {_LINKS_SQL}, j AS (SELECT *, {_terms("(anchor || ' ' || dst_url)", _FOUND)} AS r, {_host('src_url')} AS a, {_host('dst_url')} AS b, lower(regexp_extract(dst_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS path FROM links)
SELECT src_url, dst_url, anchor, array_to_string(r[1:8], '; ') AS match_reasons FROM j WHERE len(r) > 0 AND regexp_matches(dst_url, '^https?://') AND coalesce(a = b OR ends_with(b, '.' || a), false)
  AND NOT regexp_matches(path, '[.]({"|".join(x[1:] for x in vocab.DISCOVERY_EXTENSIONS)})$')""")
def discovered_links(spark, sf_dir):
    return frontier.discovered(read(spark, sf_dir, "pages"), _FOUND)


@query()
def text_block_records(spark, sf_dir):
    """Import rows of documents read as free text, with words that they hold."""
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return records.block_rows(records.text_blocks(texts, ["the"], ["der"]), accept=["the", "of", "und"])


@query("SELECT run_key, url, arg_max(status, seq) AS status, arg_max(found, seq) AS found FROM (SELECT user_id % 20 AS run_key, event_id AS seq, 'p' || (event_id % 500) AS url, event_type AS status, event_id % 5 AS found FROM events) GROUP BY 1, 2")
def crawl_page_states(spark, sf_dir):
    k = F.col("event_id")
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("run_key"), k.alias("seq"), F.concat(F.lit("p"), (k % 500).cast("string")).alias("url"), F.col("event_type").alias("status"), (k % 5).alias("found"))
    return frontier.page_states(e)


from . import round_trips  # noqa: E402, F401  (registers its queries)
