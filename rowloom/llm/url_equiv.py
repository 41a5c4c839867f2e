"""URL filters over redirect equivalence.

Edges join a page's address to what it redirects to: the targets of its meta
refreshes, its canonical links, and the normal form that servers redirect to
(https, lower-case host without default port or www, no fragment, no tracking
parameters, no trailing slash or index page). Components of this graph are
aliases of one resource. A component is blocked if a rule blocks any address in
it, unless a rule allows any address in it: an explicit allow takes precedence.

Rules: (kind, value, action), kind 'host' (that host and those below it) or
'url' (an address of that normal form), action 'block' or 'allow'. Hosts' parent
domains are spread out, so rules are found by an equi-join, whose side Spark
broadcasts only if it is small.

Defined cases. Null or empty url: no alias, root null, aliases 0, decision
'none'. Null page_id: kept as it is. Repeated rows: one result row each. Null
html, or one without links: only the normal form counts. Targets may be absolute,
//host, /path, ?query or relative, quoted or not, with attributes in any order; all
canonical links and refreshes of a page count. What doesn't resolve to an http
address is ignored. Rules with nulls
are ignored; repeated ones count once. Empty tables: empty result, or decision
'none'. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import resolve
from .components import connected_components
from .shared import cut, table

RULES = [("host", "example.net", "block"), ("host", "ththon.example.org", "block"), ("host", "tiontion.example.net", "allow")]

_TRACKING = "(utm_[a-z]+|gclid|fbclid|ref|sessionid)"
_TAG = "(?i)<(?:link|meta)\\s[^>]*>"
_CANONICAL = "(?i)^<link\\s(?:[^>]*\\s)?rel\\s*=\\s*(?:canonical|\"[^\">]*\\bcanonical\\b|'[^'>]*\\bcanonical\\b)"
_REFRESH = "(?i)^<meta\\s(?:[^>]*\\s)?http-equiv\\s*=\\s*[\"']?\\s*refresh\\b"
#: An attribute's value in double quotes, in single ones, or bare.
_VALUE = "(?i)\\s{}\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+))"
_TARGET = "(?i)^\\s*[0-9.]*\\s*[;,]?\\s*url\\s*=\\s*[\"']?\\s*([^\"'\\s>]+)"


def normal_url(url: Column) -> Column:
    """The address a server would redirect to."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.lower(F.regexp_extract(u, "(?i)^https?://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(head, "^www[.]", ""), ":(80|443)$", "")
    rest = F.regexp_replace(u, "(?i)^https?://[^/?]*", "")
    path = F.regexp_extract(rest, "^([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, "/index[.](html?|php)$", "/"), "/+$", "")
    query = F.regexp_extract(rest, "[?](.*)$", 1)
    query = F.regexp_replace(F.regexp_replace(query, f"(^|&){_TRACKING}=[^&]*", ""), "^&", "")
    return F.concat(F.lit("https://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def _attribute(tag: Column, name: str) -> Column:
    value = F.concat(*(F.regexp_extract(tag, _VALUE.format(name), g) for g in (1, 2, 3)))
    return F.regexp_replace(F.trim(value), "&amp;", "&")


def page_targets(pages: DataFrame) -> DataFrame:
    """(u, v): an address and a canonical link or refresh target of its page."""
    tag = F.explode(F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))).alias("tag")
    tags = pages.where("url != ''").select(F.col("url").alias("u"), tag)
    t = F.col("tag")
    link = F.when(t.rlike(_CANONICAL), _attribute(t, "href")).when(t.rlike(_REFRESH), F.regexp_extract(_attribute(t, "content"), _TARGET, 1))
    found = tags.select("u", link.alias("link")).where("link != ''")
    return found.select("u", resolve("u", F.col("link")).alias("v")).where(F.col("v").rlike("(?i)^https?://[^/?#]")).distinct()


def redirect_edges(pages: DataFrame) -> DataFrame:
    """(u, v): an address and what it redirects to. The pages' html is read once."""
    linked = cut(page_targets(pages))
    # Targets have normal forms as well.
    ends = pages.where("url != ''").select(F.col("url").alias("u")).unionByName(linked.select(F.col("v").alias("u")))
    return cut(linked.unionByName(ends.select("u", normal_url(F.col("u")).alias("v"))).distinct())


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "kind string, value string, action string")


def rule_hits(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, action) of each address (id) that a rule names."""
    clean = rules.where("kind is not null and value is not null and action is not null").select("kind", F.lower("value").alias("value"), "action").distinct()
    host = F.split(F.regexp_extract(F.lower("id"), "^https?://(?:www[.])?([^/?#:]*)", 1), "[.]")
    n = F.size(host)
    above = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(host, i, n), "."))
    by_host = addresses.select("id", F.explode(above).alias("value")).join(clean.where("kind = 'host'"), "value").select("id", "action")
    by_url = addresses.select("id", F.lower(normal_url(F.col("id"))).alias("value")).join(clean.where("kind = 'url'"), "value").select("id", "action")
    return by_host.unionByName(by_url).distinct()


def decide(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url, root, aliases, decision) of every row of pages."""
    pages = pages.select("page_id", "url", "html")
    edges = redirect_edges(pages)
    linked = connected_components(edges)
    alone = edges.where("u = v").select(F.col("u").alias("id")).join(linked, "id", "left_anti").select("id", F.col("id").alias("root"))
    members = linked.unionByName(alone)
    hits = rule_hits(members.select("id"), rules)
    per_root = members.join(hits, "id", "left").groupBy("root").agg(
        F.countDistinct("id").alias("aliases"), F.max(F.coalesce(F.col("action") == "allow", F.lit(False))).alias("allow"), F.max(F.coalesce(F.col("action") == "block", F.lit(False))).alias("block")
    )
    decision = F.when(F.col("allow"), "allow").when(F.col("block"), "block").otherwise("none")
    known = members.join(per_root, "root").select(F.col("id").alias("url"), "root", "aliases", decision.alias("decision"))
    return pages.select("page_id", "url").join(known, "url", "left").select(
        "page_id", "url", "root", F.coalesce("aliases", F.lit(0).cast("long")).alias("aliases"), F.coalesce("decision", F.lit("none")).alias("decision")
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(table(spark, sf_dir, "pages"), default_rules(spark))


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_normal(u: str) -> str:
    bare = f"regexp_replace(trim({u}), '#.*$', '')"
    host = f"regexp_replace(regexp_replace(lower(regexp_extract({bare}, '(?i)^https?://([^/?]*)', 1)), '^www[.]', ''), ':(80|443)$', '')"
    rest = f"regexp_replace({bare}, '(?i)^https?://[^/?]*', '')"
    path = f"regexp_replace(regexp_replace(regexp_extract({rest}, '^([^?]*)', 1), '/index[.](html?|php)$', '/'), '/+$', '')"
    query = f"regexp_replace(regexp_replace(regexp_extract({rest}, '[?](.*)$', 1), '(^|&){_TRACKING}=[^&]*', '', 'g'), '^&', '')"
    return f"'https://' || {host} || {path} || CASE WHEN {query} != '' THEN '?' || {query} ELSE '' END"


def _sql_attribute(name: str) -> str:
    value = " || ".join(f"regexp_extract(tag, {_q(_VALUE.format(name))}, {g})" for g in (1, 2, 3))
    return f"replace(trim({value}), '&amp;', '&')"


def _sql_resolved(h: str, base: str) -> str:
    origin = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
    path = f"regexp_extract({base}, '^([^?#]*)', 1)"
    folder = f"CASE WHEN length({path}) > length({origin}) THEN regexp_replace({path}, '[^/]*$', '') ELSE {path} || '/' END"
    plain = f"regexp_replace(({folder}) || {h}, '/[.](/|$)', '\\1', 'g')"
    for _ in range(4):
        plain = f"regexp_replace({plain}, '([^/:])/(?:[^/?#.][^/?#]*|[.][^/?#.][^/?#]*)/[.][.](/|$)', '\\1\\2', 'g')"
    return f"""CASE WHEN regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {h}
      WHEN starts_with({h}, '//') THEN regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) || ':' || {h} WHEN starts_with({h}, '/') THEN {origin} || {h}
      WHEN starts_with({h}, '?') THEN {path} || {h} WHEN starts_with({h}, '#') THEN regexp_replace({base}, '#.*$', '') || {h} ELSE {plain} END"""


ORACLE_SQL = f"""
WITH RECURSIVE tags AS (SELECT url AS u, unnest(regexp_extract_all(html, {_q(_TAG)})) AS tag FROM pages WHERE url != ''),
found AS (
  SELECT u, CASE WHEN regexp_matches(tag, {_q(_CANONICAL)}) THEN {_sql_attribute("href")}
                 WHEN regexp_matches(tag, {_q(_REFRESH)}) THEN regexp_extract({_sql_attribute("content")}, {_q(_TARGET)}, 1) END AS link FROM tags
),
linked AS (SELECT DISTINCT u, v FROM (SELECT u, {_sql_resolved("link", "u")} AS v FROM found WHERE link != '') WHERE regexp_matches(v, '(?i)^https?://[^/?#]')),
ends AS (SELECT url AS u FROM pages WHERE url != '' UNION SELECT v FROM linked),
edges AS (SELECT u, v FROM linked UNION SELECT u, {_sql_normal("u")} FROM ends),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach AS (SELECT u AS id, u AS other FROM both_ways UNION SELECT r.id, b.v FROM reach r JOIN both_ways b ON r.other = b.u),
members AS (SELECT id, min(other) AS root FROM reach GROUP BY id),
rules(value, action) AS (VALUES {", ".join(f"('{v}', '{a}')" for k, v, a in RULES if k == "host")}),
hits AS (
  SELECT m.id, r.action FROM (SELECT id, regexp_extract(lower(id), '^https?://(?:www[.])?([^/?#:]*)', 1) AS host FROM members) m
  JOIN rules r ON m.host = r.value OR ends_with(m.host, '.' || r.value)
),
per_root AS (
  SELECT root, count(DISTINCT m.id) AS aliases, coalesce(bool_or(action = 'allow'), false) AS allow, coalesce(bool_or(action = 'block'), false) AS block
  FROM members m LEFT JOIN hits h ON m.id = h.id GROUP BY root
)
SELECT p.page_id, p.url, m.root, coalesce(r.aliases, 0)::BIGINT AS aliases,
       CASE WHEN r.allow THEN 'allow' WHEN r.block THEN 'block' ELSE 'none' END AS decision
FROM pages p LEFT JOIN members m ON p.url = m.id LEFT JOIN per_root r ON m.root = r.root
"""
