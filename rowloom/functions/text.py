"""Scalar normalisation as Column functions: JVM-side, foldable, no UDF.

Two missing values exist side by side, null and the empty string; ``present``
tells a value from either, and every function here treats them alike.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import COUNTRY_ALIASES, STATES

#: All white space that Python's str.split knows; Java's plain \\s is ASCII only.
SPACE = r"(?U)[\s\u001c-\u001f]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """The value as a string, '' for null."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def present(c: Column | str) -> Column:
    return text(c) != ""


def first_present(*cs: Column | str) -> Column:
    """The first value that is present, or null."""
    return F.coalesce(*[F.when(present(c), col(c)) for c in cs])


def default(c: Column | str, value: str) -> Column:
    return F.coalesce(first_present(c), F.lit(value))


def collapse(c: Column | str) -> Column:
    """White space collapsed and trimmed; '' for null."""
    return F.trim(F.regexp_replace(text(c), SPACE, " "))


def strip(c: Column, signs: str) -> Column:
    """Without the signs at either end."""
    kind = "[" + re.escape(signs).replace("/", "") + "]"
    return F.regexp_replace(c, f"^{kind}+|{kind}+$", "")


def clean(c: Column | str) -> Column:
    """Collapsed text."""
    return collapse(c)


def clean_field(c: Column | str) -> Column:
    """Collapsed, without spaces, commas, semicolons and bars at the ends."""
    return strip(collapse(c), " ,;|")


def clean_record(c: Column | str) -> Column:
    """As clean_field, bullets being spaces."""
    return strip(F.trim(F.regexp_replace(F.translate(text(c), "•", " "), SPACE, " ")), " ,;|\t\r\n")


def clean_line(c: Column | str) -> Column:
    """Collapsed, without spaces, commas and semicolons at the ends."""
    return strip(collapse(c), " ,;")


def clean_list(c: Column | str, one=clean_field) -> Column:
    """Clean parts of an array that aren't empty, joined by '; '."""
    return F.array_join(F.filter(F.transform(col(c), one), lambda x: x != ""), "; ")


def clean_map(c: Column | str) -> Column:
    """Clean values of a map that aren't empty, joined by ', '."""
    return F.array_join(F.filter(F.transform(F.map_values(col(c)), clean_field), lambda x: x != ""), ", ")


def normalized_name(c: Column | str) -> Column:
    """Lower case, every run of other than a-z and 0-9 one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def normalize_phone(c: Column | str) -> Column:
    """Digits, without a leading 1 of eleven; text without a digit stays; null if blank."""
    raw = clean(c)
    digits = F.regexp_replace(raw, r"(?U)\D+", "")
    national = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return F.when(raw == "", None).when(national != "", national).otherwise(raw)


def normalize_site(c: Column | str) -> Column:
    """With a scheme: // and none become https; null if blank."""
    v = clean(c)
    full = F.when(v.startswith("//"), F.concat(F.lit("https:"), v)).otherwise(v)
    return F.when(v == "", None).when(full.rlike("(?i)^https?://"), full).otherwise(F.concat(F.lit("https://"), full))


def normalize_country(code: Column | str, name: Column | str, region: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """struct(code, name): a two-letter code, a two-letter name, a known name, a US region, XX."""
    aliases = COUNTRY_ALIASES if aliases is None else aliases
    code, name, region = clean(code), clean(name), clean(region)
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    two = "^\\p{L}{2}$"

    def pair(a: Column | str, b: Column | str) -> Column:
        return F.struct((F.lit(a) if isinstance(a, str) else a).alias("code"), (F.lit(b) if isinstance(b, str) else b).alias("name"))

    return (
        F.when(code.rlike(two), pair(F.upper(code), F.when(name != "", name).otherwise(F.upper(code))))
        .when(name.rlike(two), pair(F.upper(name), F.upper(name)))
        .when(name != "", pair(F.coalesce(F.try_element_at(known, F.lower(name)), F.lit("XX")), name))
        .when(F.upper(region).isin(STATES), pair("US", "United States"))
        .otherwise(pair("XX", "Unknown"))
    )


def full_address(*parts: Column | str) -> Column:
    """Clean parts joined by ', ', without blank ones and later repeats in any case."""
    kept = F.filter(F.array(*[clean(p) for p in parts]), lambda x: x != "")
    fresh = F.filter(kept, lambda x, i: F.array_position(F.transform(kept, F.lower), F.lower(x)) == i + 1)
    return F.array_join(fresh, ", ")


def number(c: Column | str) -> Column:
    """A double; null for blank. What isn't a number is null as well, see ``bad_number``."""
    return first_present(c).cast("string").try_cast("double")


def bad_number(c: Column | str) -> Column:
    """Whether a value is there but isn't a number: such rows go to quarantine."""
    return present(c) & number(c).isNull()


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def dedupe_key(source_url: Column | str, phone: Column | str, website: Column | str, name: Column | str, address: Column | str) -> Column:
    """SHA-256 of the first present of address of origin, phone, website, and 'name|address' (N12)."""
    last = F.concat_ws("|", normalized_name(name), normalized_name(address))
    return sha256(F.coalesce(first_present(clean(source_url)), first_present(phone), first_present(website), last))


def fingerprint(*cs: Column | str) -> Column:
    """A stable address of a record's identity: the hash of its trimmed lower-case fields."""
    parts = [F.lower(F.trim(text(c))) for c in cs]
    return F.concat(F.lit("provider-fingerprint://"), sha256(F.concat_ws("|", *parts)))


def normalized_url(c: Column | str) -> Column:
    """Without fragment and trailing slashes, unless nothing is left."""
    bare = F.regexp_replace(col(c), "#.*$", "")
    short = F.regexp_replace(bare, "/+$", "")
    return F.when(short != "", short).otherwise(bare)


def url_host(c: Column | str) -> Column:
    """The lower-case host; null for what isn't an address."""
    host = F.regexp_extract(col(c), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(host != "", F.lower(host))


def slug(c: Column | str, prefix: str = "gov_health_") -> Column:
    return F.concat(F.lit(prefix), F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "-"), "^-+|-+$", ""))


def source_url(source: Column | str, source_alt: Column | str, maps: Column | str, url: Column | str) -> Column:
    """The address a record comes from; a plain url counts only if it is a map's."""
    u = clean_record(url)
    picked = F.coalesce(*[first_present(clean_record(c)) for c in (source, source_alt, maps)], F.when(u.contains("google.com/maps"), u))
    return F.coalesce(picked, F.lit(""))


def error_kind(c: Column | str) -> Column:
    """legacy_map_scraper or error, from the error's text."""
    legacy = "(?i)google-maps-scraper binary exited|mapped"
    return F.when(text(c).rlike(legacy), "legacy_map_scraper").otherwise("error")


def json_field(c: Column | str, path: str, missing: str = "unknown") -> Column:
    """A field of a JSON document, ``missing`` where it isn't."""
    return F.coalesce(F.get_json_object(col(c), path), F.lit(missing))


def truncate(c: Column | str, n: int) -> Column:
    """The first n code points."""
    return F.substring(text(c), 1, n)


# -- driver-side parameters -----------------------------------------------------


def truthy(value: object, otherwise: bool = True) -> bool:
    """Whether a parameter says yes: anything but 0, false, no and off."""
    return otherwise if value is None else str(value).strip().lower() not in ("0", "false", "no", "off")


def clamp(value: object, low: float, high: float, otherwise: float) -> float:
    """A number within bounds; what isn't a finite one is the default."""
    try:
        x = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return otherwise
    return min(max(x, low), high) if x == x and abs(x) != float("inf") else otherwise


def identifier(name: str) -> str:
    """A quoted column or table name; ValueError for what isn't a plain one."""
    if not re.fullmatch(r"[A-Za-z_]\w*", name or "", re.ASCII):
        raise ValueError(f"not an identifier: {name!r}")
    return f"`{name}`"


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
