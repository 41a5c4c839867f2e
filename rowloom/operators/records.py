"""The import: source rows or text blocks to normalised rows, scored, deduped, judged, reported."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import text as N
from ..functions import vocab
from ..functions.score import accepted, import_hits, import_score
from ..plans.shape import computed, spread
from .merge import import_dedupe

ROW_FIELDS = "name address city state postalCode phone email website services sourceType sourceTag sourceUrl lat lng evidenceNote".split()
ACCEPTED_COLUMNS = [*ROW_FIELDS[:-1], "score", "match_reasons"]
REJECTED_COLUMNS = "name address city state postalCode phone website services sourceUrl score rejection_reason evidenceNote".split()


def _norm(name: str) -> str:
    return re.sub("[^a-z0-9]+", " ", name.lower()).strip()


def _quoted(c: Column) -> Column:
    """A string as a JSON string."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def _json(df: DataFrame, name: str) -> Column:
    """'"name": value' as JSON with spaces after separators; null for null."""
    kind, c = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind == "string":
        value = _quoted(c)
    elif kind == "array<string>":
        value = F.concat(F.lit("["), F.array_join(F.transform(c, _quoted), ", "), F.lit("]"))
    elif kind.startswith(("struct", "map", "array")):
        value = F.to_json(c)
    else:
        value = c.cast("string")
    return F.when(c.isNotNull(), F.concat(F.lit(f'"{name}": '), value))


def _string(df: DataFrame, name: str) -> Column:
    """A source value as clean text: arrays joined, structures as JSON."""
    kind, c = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind == "array<string>":
        return N.clean_list(c, N.clean_record)
    return N.clean_record(F.to_json(c) if kind.startswith(("struct", "map", "array")) else c.cast("string"))


def _raw_present(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return c.isNotNull() & (c != "") if dict(df.dtypes)[name] == "string" else c.isNotNull()


def _with_service(so_far: Column, one: Column) -> Column:
    """Services so far and another one, which stands alone if it is among them."""
    joined = F.regexp_replace(F.concat_ws("; ", so_far, one), "^[; ]+|[; ]+$", "")
    return F.when((so_far != "") & ~F.lower(so_far).contains(F.lower(one)), joined).otherwise(one)


def normalize_structured(raw: DataFrame, source_type: str = "provider_file_import", source_tag: str = "provider_text_import", position: str = "position") -> DataFrame:
    """Rows of a table with any column names as import rows.

    Names are matched in lower case with signs as spaces; the projection is
    generated from them, so it costs no UDF. ``position`` is carried along.
    """
    source = [c for c in raw.columns if c != position]
    by_norm = {_norm(c): c for c in source}
    row: dict[str, Column] = {}
    for field, aliases in vocab.FIELD_ALIASES.items():
        if field == "sourceUrl":
            continue
        have = [by_norm[_norm(a)] for a in aliases if _norm(a) in by_norm]
        if field == "services":
            row[field] = F.lit("")
            if have:
                parts = F.array_compact(F.array(*[F.when(_raw_present(raw, c), _string(raw, c)) for c in have]))
                row[field] = F.aggregate(parts, F.lit(""), _with_service)
        else:
            row[field] = F.coalesce(*[F.when(_raw_present(raw, c), _string(raw, c)) for c in have], F.lit(""))
    exact = lambda c: _string(raw, c) if c in source else F.lit("")
    origin = N.source_url(exact("sourceUrl"), exact("source_url"), exact("maps_url"), exact("url"))
    evidence = F.substring(F.concat(F.lit("{"), F.concat_ws(", ", *[_json(raw, c) for c in source]), F.lit("}")), 1, 1500)
    out = computed(
        raw,
        F.col(position),
        *[v.alias(k) for k, v in row.items()],
        origin.alias("sourceUrl"),
        N.default(exact("sourceType"), source_type).alias("sourceType"),
        N.default(exact("sourceTag"), source_tag).alias("sourceTag"),
        evidence.alias("evidenceNote"),
    )
    own_map = F.col("sourceUrl").startswith("https://www.google.com/maps") & (F.col("website") == F.col("sourceUrl"))
    out = out.withColumn("website", F.when(own_map, "").otherwise(F.col("website")))
    out = out.withColumn("state", F.when(N.clean_record("state").rlike(f"^{E.STATE}$"), F.col("state")).otherwise(""))
    return with_derived(out).select(position, *ROW_FIELDS)


def with_derived(rows: DataFrame) -> DataFrame:
    d = E.address_parts("address", "name", "state", "postalCode", "city")
    with_parts = computed(rows, *(F.col(c) for c in rows.columns), d.alias("__d"))
    return with_parts.withColumns({c: F.col(f"__d.{c}") for c in ("address", "city", "state", "postalCode")}).drop("__d")


def block_rows(blocks: DataFrame, source_type: str = "provider_file_import", source_tag: str = "provider_text_import", accept: Sequence[str] = vocab.ACCEPT_TERMS) -> DataFrame:
    """Import rows from (position, block): labelled lines by their label, other lines by what
    is found in them, the first value of a field kept (E14)."""
    label_of = {_norm(a): f for f, aliases in vocab.FIELD_ALIASES.items() for a in aliases}
    known = F.create_map(*[F.lit(x) for pair in label_of.items() for x in pair])
    lines = F.filter(F.transform(F.split(N.text("block"), r"\r\n|[\n\r\u000b\f\u001c-\u001e\u0085\u2028\u2029]"), N.clean_record), lambda x: x != "")

    def tagged(x: Column) -> Column:
        field = F.try_element_at(known, N.normalized_name(F.regexp_extract(x, E.LABEL, 1)))
        able = x.contains(":") | x.contains("=")  # few lines have either: the pattern is tried on these
        return F.struct(x.alias("line"), F.when(able & x.rlike(E.LABEL), field).alias("field"), F.when(able, N.clean_record(F.regexp_extract(x, E.LABEL, 2))).alias("value"))

    df = computed(blocks, "position", "block", F.transform(lines, tagged).alias("__lines"))

    def values(field: str, found: "None | object" = None) -> Column:
        def of(x: Column, i: Column) -> Column:
            labelled = F.when(x["field"] == field, F.array(x["value"])).otherwise(F.array().cast("array<string>"))
            return F.when(x["field"].isNotNull(), labelled).otherwise(found(x["line"], i)) if found else labelled

        cleaned = F.transform(F.flatten(F.transform("__lines", of)), N.clean_record)
        return F.coalesce(F.try_element_at(F.filter(cleaned, lambda v: v != ""), F.lit(1)), F.lit(""))

    # A plain search or one for a digit comes first: patterns of many branches seldom have to be tried.
    none = F.array().cast("array<string>")
    digit = lambda x: x.rlike(r"\p{Nd}")

    def urls(maps: bool):
        kept = lambda u: u.contains("google.com/maps") if maps else ~u.contains("google.com/maps")
        there = lambda x: x.contains("google.com/maps") if maps else x.contains("://") | x.contains(".")
        return lambda x, i: F.when(there(x), F.filter(E.all_matches(x, E.URL_LISTED), kept)).otherwise(none)

    # The name's own line is an address for five digits only if no other line is one.
    placed = lambda x, i: F.when(digit(x) & (((i > 0) & x.rlike(E.ZIP)) | x.rlike(E.STATE)), F.array(x)).otherwise(none)
    numbered = lambda x, i: F.when(digit(x) & x.rlike(E.ZIP), F.array(x)).otherwise(none)
    found = {
        "email": lambda x, i: F.when(x.contains("@"), E.all_matches(x, E.EMAIL)).otherwise(none), "phone": lambda x, i: F.when(digit(x), E.all_matches(x, E.PHONE_US)).otherwise(none), "website": urls(False), "sourceUrl": urls(True), "address": placed,
    }
    named = F.coalesce(F.try_element_at(F.transform("__lines", lambda x: x["line"]), F.lit(1)), F.lit(""))
    cols = {f: values(f, found.get(f)) for f in vocab.FIELD_ALIASES if f not in ("name", "services")}
    cols["address"] = F.coalesce(N.first_present(cols["address"]), values("address", numbered))
    terms = F.array_join(F.slice(E.terms_in("block", accept), 1, 6), "; ")
    out = computed(
        df, "position", named.alias("name"), *[v.alias(k) for k, v in cols.items()], F.coalesce(N.first_present(values("services")), terms).alias("services"),
        F.lit(source_type).alias("sourceType"), F.lit(source_tag).alias("sourceTag"), F.substring(N.text("block"), 1, 1500).alias("evidenceNote"),
    )
    return with_derived(out).select("position", *ROW_FIELDS)


def text_blocks(texts: DataFrame, accept: Sequence[str] = vocab.ACCEPT_TERMS, reject: Sequence[str] = vocab.REJECT_TERMS) -> DataFrame:
    """(doc, position, block) of whole texts (doc, text): parts between blank lines; in a text
    without any, lines from one record start to the next (TXT1-TXT3), an islands window."""
    whole = spread(texts).select("doc", F.regexp_replace(N.text("text"), "\r\n", "\n").alias("text"))
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    parted = computed(whole, "doc", "text", parts.alias("parts"))
    # Islands within the row, so nothing is shuffled: each line after a mark, one that begins a
    # record after a mark of its own (white space to ``clean_record``, so no line holds it).
    lines = F.filter(F.transform(F.split("text", "\n"), N.clean_record), lambda x: x != "")
    lined = computed(parted, "doc", "parts", F.when(F.size("parts") <= 1, lines).alias("lines"))
    marked = F.transform("lines", lambda x: F.concat(F.when(E.record_start(x, accept, reject), F.lit("\x1e")).otherwise(F.lit("\n")), x))
    joined = computed(lined, "doc", "parts", F.substring(F.array_join(marked, ""), 2, 1 << 30).alias("joined"))
    blocks = F.when(F.col("joined").isNull(), F.col("parts")).when(F.col("joined") != "", F.split("joined", "\x1e"))
    return joined.select("doc", F.posexplode(blocks).alias("position", "block"))


def score_rows(rows: DataFrame, min_score: float = 5, accept: Sequence[str] = vocab.ACCEPT_TERMS, reject: Sequence[str] = vocab.REJECT_TERMS, strict_parity: bool = True) -> DataFrame:
    """rows with score, reasons, match_reasons, rejection and accepted, without repeats (SC2, D1, F2)."""
    fields = {k: k for k in "name services lat lng address email phone website sourceUrl".split()} | {"evidence": "evidenceNote"}
    # Lower case once, each term searched once, then the score: three steps, no expression twice.
    own = [F.col(c) for c in rows.columns]
    texts = {"name": "name", "services": "services", "evidence": "evidenceNote"}
    low = computed(rows, *own, *[F.lower(N.text(c)).alias(f"__low_{k}") for k, c in texts.items()])
    hits = import_hits({k: F.col(f"__low_{k}") for k in texts}, accept, reject, strict_parity)
    found = computed(low, *own, *[v.alias(f"__hit_{k}") for k, v in hits.items()])
    s = import_score({k: F.col(v) for k, v in fields.items()}, accept, reject, strict_parity, {k: F.col(f"__hit_{k}") for k in hits})
    scored = computed(found, *own, s.alias("__s")).withColumns({"score": F.col("__s.score"), "reasons": F.col("__s.reasons"), "rejection_reason": F.col("__s.rejection")}).drop("__s")
    scored = scored.withColumn("match_reasons", F.array_join("reasons", "; ")).withColumn("accepted", accepted(F.col("score"), F.col("rejection_reason"), min_score))
    return import_dedupe(scored)


def accepted_rows(scored: DataFrame) -> DataFrame:
    return scored.where("accepted").orderBy("position").select(*ACCEPTED_COLUMNS)


def rejected_rows(scored: DataFrame) -> DataFrame:
    return scored.where("not accepted").orderBy("position").select(*REJECTED_COLUMNS)


def top_reasons(scored: DataFrame, of_accepted: bool, most: int = 10) -> DataFrame:
    """(reason, n): the most frequent reasons, of equals the one seen first."""
    reason = F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("accepted"))) if of_accepted else F.array("rejection_reason")
    each = scored.where(F.col("accepted") == F.lit(of_accepted)).select("position", F.posexplode(reason).alias("i", "reason"))
    counted = each.groupBy("reason").agg(F.count("*").alias("n"), F.min(F.struct("position", "i")).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(most).select("reason", "n")


def import_report(read: DataFrame, scored: DataFrame, source: str = "", fmt: str = "", written: int = 0, skipped: int = 0) -> DataFrame:
    """One row: what was read, accepted, rejected, written and skipped, and the top reasons."""
    total = read.agg(F.count("*").alias("total_rows_read"))
    counts = scored.agg(F.count_if("accepted").alias("accepted_count"), F.count_if(~F.col("accepted")).alias("rejected_count"))

    def listed(ok: bool, name: str) -> DataFrame:
        top = top_reasons(scored, ok).withColumn("k", F.monotonically_increasing_id())
        return top.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "reason", "n"))), lambda x: F.struct(x["reason"].alias("reason"), x["n"].alias("n"))).alias(name))

    out = total.crossJoin(counts).crossJoin(listed(True, "top_accepted_reasons")).crossJoin(listed(False, "top_rejection_reasons"))
    return out.select(F.lit(source).alias("input_file"), F.lit(fmt).alias("detected_format"), "*", F.lit(written).alias("written_count"), F.lit(skipped).alias("skipped_count"))


# -- source registry ------------------------------------------------------------------


def registry_seeds(registry: DataFrame, countries: Sequence[str] = (), mode: str = "facility_registry", include_disabled: object = False, max_sources: int = 50, order: Sequence[str] = ("file_no", "row_no")) -> DataFrame:
    """(url, country, source_tag): the first ``max_sources`` seeds in file order."""
    wanted = [c.strip().lower() for c in countries if c.strip()]
    country, url = N.clean("country"), N.clean("url")
    row_mode = N.default(F.lower(N.clean("crawlMode")), "authority_discovery")
    ok = (country != "") & (url != "")
    if wanted:
        ok &= F.lower(country).isin(wanted)
    if mode not in ("all", "any"):
        ok &= row_mode == mode
    if not N.truthy(include_disabled):
        ok &= ~F.lower(N.clean("enabled")).isin("0 no off false".split())
    tag = F.coalesce(N.first_present(N.clean("sourceTag")), F.concat(F.lit("gov_health_"), F.regexp_replace(F.lower(country), " ", "-")))
    return registry.where(ok).orderBy(*order).limit(max(1, max_sources)).select(url.alias("url"), country.alias("country"), tag.alias("source_tag"))


def discovery_sources(registry: DataFrame, countries: Sequence[str] = (), include_disabled: bool = False) -> DataFrame:
    """The registry rows of a discovery run: disabled ones go only if no country is asked for."""
    wanted = [c.strip().lower() for c in countries if c.strip()]
    country, url = F.trim(N.text("country")), F.trim(N.text("url"))
    ok = (country != "") & (url != "")
    if wanted:
        ok &= F.lower(country).isin(wanted)
    elif not include_disabled:
        ok &= ~F.lower(F.trim(F.coalesce("enabled", F.lit("true")))).isin("0 n no off false".split())
    tag = F.trim(F.coalesce(N.first_present("sourceTag"), N.slug(country)))
    mode = F.trim(N.default("crawlMode", "authority_discovery"))
    return registry.where(ok).select(country.alias("country"), tag.alias("sourceTag"), url.alias("url"), mode.alias("crawlMode"), F.trim(N.text("notes")).alias("notes"))
