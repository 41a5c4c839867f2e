"""Scores and admissibility, as Column functions over plain columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .extract import terms_in
from .text import any_of, col, present, text, url_host


#: Fields that a record can be reached or traced by.
REACH = "email phone website sourceUrl".split()


def confidence(name: Column | str, address: Column | str, phone: Column | str, email: Column | str, website: Column | str, source_url: Column | str, lat: Column | str, lng: Column | str) -> Column:
    """0.30 to 0.95 by what is known of a record (SC1). The sum runs left to right in doubles:
    the order shows in the last digit."""

    def part(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))

    total = F.lit(0.30) + part(present(name), 0.20) + part(present(address), 0.20)
    total = total + part(present(phone) | present(email), 0.10) + part(present(website) | present(source_url), 0.10)
    return F.least(total + part(present(lat) & present(lng), 0.10), F.lit(0.95))


def import_hits(low: dict[str, Column], accept: Sequence[str], reject: Sequence[str], strict_parity: bool = True) -> dict[str, Column]:
    """The reject terms, and the accept terms of each field, in lower-case name, services and evidence."""
    searched = [low["name"], low["services"]] + ([low["evidence"]] if strict_parity else [])
    return {"rejects": terms_in(F.concat_ws(" ", *searched), reject)} | {k: terms_in(low[k], accept) for k in ("services", "name", "evidence")}


def import_score(fields: dict[str, Column | str], accept: Sequence[str] = vocab.ACCEPT_TERMS, reject: Sequence[str] = vocab.REJECT_TERMS, strict_parity: bool = True, hits: dict[str, Column] | None = None) -> Column:
    """struct(score, reasons, rejection) of an imported row (SC2).

    fields: name, services, evidence, address, phone, email, website, sourceUrl,
    lat, lng; missing ones count as blank. With strict_parity the evidence, the
    whole source row, is searched for reject terms, so a street name can reject
    a row; without it only name and services are. hits: the terms found, see
    ``import_hits``, if they have been computed already.
    """
    f = {k: text(fields.get(k, F.lit(""))) for k in "name services evidence lat lng address email phone website sourceUrl".split()}
    by = hits or import_hits({k: F.lower(f[k]) for k in ("name", "services", "evidence")}, accept, reject, strict_parity)
    rejects = by["rejects"]
    place = present(f["address"]) | (present(f["lat"]) & present(f["lng"]))
    contact = any_of([present(f[k]) for k in REACH])
    points = [(F.size(by["services"]) > 0, 6), (F.size(by["name"]) > 0, 4), (F.size(by["evidence"]) > 0, 2), (place, 1), (contact, 1)]
    score = reduce(lambda a, b: a + b, [F.when(c, n).otherwise(0) for c, n in points])

    def named(key: str, label: str, most: int) -> Column:
        return F.transform(F.slice(by[key], 1, most), lambda t: F.concat(F.lit(f"{label}:"), t))

    def note(condition: Column, words: str) -> Column:
        return F.array_compact(F.array(F.when(condition, F.lit(words))))

    reasons = F.concat(named("services", "service", 5), named("name", "name", 3), named("evidence", "evidence", 3), note(place, "location evidence"), note(contact, "contact/source evidence"))
    bare = ~any_of([present(f[k]) for k in (*REACH, "address", "lat")])
    rejection = F.when(~present(f["name"]), "missing name").when(bare, "missing location/contact/source evidence").otherwise("below min score")
    out = F.size(rejects) > 0
    return F.struct(
        F.when(out, -10).otherwise(score).alias("score"),
        F.when(out, F.transform(rejects, lambda t: F.concat(F.lit("reject:"), t))).otherwise(reasons).alias("reasons"),
        F.when(out, "excluded business category").otherwise(rejection).alias("rejection"),
    )


def accepted(score: Column, rejection: Column, min_score: float = 5) -> Column:
    """The import gate (F2)."""
    return (score >= min_score) & ~rejection.startswith("missing")


def _path(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(text(url), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))


def same_host(current: Column | str, following: Column | str) -> Column:
    """The same host, or one below it."""
    a, b = url_host(current), url_host(following)
    return F.coalesce((a == b) | b.endswith(F.concat(F.lit("."), a)), F.lit(False))


def admissible(current: Column | str, following: Column | str, skip_extensions: Sequence[str] = vocab.DISCOVERY_EXTENSIONS) -> Column:
    """An http address on the same host, not a file to skip (F5, for discovery)."""
    http = text(following).rlike("^https?://")
    return http & ~any_of([_path(following).endswith(x) for x in skip_extensions]) & same_host(current, following)


def link_score(
    current: Column | str, following: Column | str, anchor: Column | str, same_domain: bool = True,
    follow: Sequence[str] = vocab.FOLLOW_TERMS, paging: Sequence[str] = vocab.PAGING_TERMS, health: Sequence[str] = vocab.HEALTH_TERMS,
    skip: Sequence[str] = vocab.SKIP_TERMS, skip_extensions: Sequence[str] = vocab.SKIP_EXTENSIONS,
) -> Column:
    """-100 for what may not be followed, -1 for what isn't worth it, else the score (SC3).

    Terms are substrings, so 'express' holds 'press'; overlapping ones all count.
    """
    blob = F.lower(F.concat_ws(" ", text(anchor), text(following)))
    near = same_host(current, following)
    bad = ~text(following).rlike("^https?://") | any_of([blob.contains(t) for t in skip]) | any_of([_path(following).endswith(x) for x in skip_extensions])
    if same_domain:
        bad = bad | ~near
    points = [near.cast("int")] + [F.when(blob.contains(t), 5).otherwise(0) for t in paging] + [F.when(blob.contains(t), 3).otherwise(0) for t in follow]
    score = reduce(lambda a, b: a + b, points) + F.when(any_of([blob.contains(t) for t in health]), 2).otherwise(0)
    return F.when(bad, -100).when(score >= 3, score).otherwise(-1)


def drop_reason(kind: Column | str, name: Column | str, evidence: Sequence[Column | str]) -> Column:
    """Why a crawled record is dropped, null if it isn't (F1)."""
    return (
        F.when(text(kind) == "discovered_link", "discovered_link")
        .when(~present(name), "missing_name")
        .when(~any_of([present(c) for c in evidence]), "missing_evidence")
    )


