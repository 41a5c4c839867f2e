"""Patterns and vocabulary matches in text, as Column functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_field, clean_record, col, first_present, text
from .vocab import STATES

_WORD = r"\p{Alnum}"
EMAIL = rf"[{_WORD}._%+-]+@[{_WORD}.-]+[.]\p{{Alpha}}{{2,}}"
_SEP = "[\\s.-]?"
#: North American, loosely international, and long runs of digits.
PHONE_US = rf"(?:[+]?1{_SEP})?(?:[(]?[0-9]{{3}}[)]?{_SEP})[0-9]{{3}}{_SEP}[0-9]{{4}}"
PHONE_LOOSE = rf"(?:[+]?[0-9]{{1,3}}[\s().-]?)?(?:[(]?[0-9]{{2,4}}[)]?{_SEP})?[0-9]{{3,4}}{_SEP}[0-9]{{3,4}}"
PHONE_RUN = r"(?:[+]?[0-9][0-9\s().-]{7,}[0-9])"
URL_LISTED = r"(?i)(?:https?://|www[.])[^\s;,)<]+"
URL_ANY = r"(?:https?://|www[.])\S+"


def ascii_edges(pattern: str) -> str:
    """The pattern with word edges as SQL's patterns have them: only A-Z, 0-9 and _ make words. (Java's
    \\b counts letters of any script before version 19, and not from then on.)"""
    word = "[0-9A-Za-z_]"
    return pattern.replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")


POSTAL = ascii_edges(r"(?i)\b(?:[0-9]{4,6}(?:-[0-9]{3,4})?|[A-Z][0-9][A-Z][ -]?[0-9][A-Z][0-9]|[A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2})\b")
ZIP = ascii_edges(r"\b[0-9]{5}(?:-[0-9]{4})?\b")
#: Two letters each, those of one first letter together: fewer branches to try.
STATE = r"(?iU)\b(" + "|".join(f"{a}[{''.join(s[1] for s in STATES if s[0] == a)}]" for a in sorted({s[0] for s in STATES})) + r")\b"
#: A ZIP code behind a state, the second group: a house number may have five digits as well.
STATE_ZIP = rf"{STATE}[\s,.]*({ZIP})"
STREET = r"(?i)\b(" + "|".join(["suite", "unit", "way", *(f"{a}|{b}[.]?" for a, b in (("avenue", "ave"), ("boulevard", "blvd"), ("drive", "dr"), ("lane", "ln"), ("road", "rd"), ("street", "st")))]) + r")\b"
_LABELLED = r"\p{Alpha}[\p{Alpha} ./_-]{1,35}?"
LABEL = rf"^({_LABELLED})\s*(?:=|:)\s*(.+)$"


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), c being computed once however often it is named there, within other functions' too."""
    return F.element_at(F.transform(F.array(c), use), 1)


def first_match(c: Column | str, pattern: str, group: int = 0) -> Column:
    """The first match, '' if none."""
    return F.regexp_extract(text(c), pattern, group)


def all_matches(c: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text(c), F.lit(pattern), F.lit(group))


def terms_in(c: Column | str, terms: Sequence[str]) -> Column:
    """The terms that stand in the text as whole words, in the vocabulary's order.

    A word ends where no a-z or 0-9 follows. One expression whatever the number
    of terms, so it compiles fast; the plain search seldom succeeds, and only
    then the pattern is tried.
    """
    if not terms:
        return F.array().cast("array<string>")
    listed = F.array(*[F.lit(t) for t in terms])
    edge = "[^a-z0-9]"

    def hit(low: Column, t: Column) -> Column:
        return low.contains(t) & F.rlike(low, F.concat(F.lit(f"(^|{edge})\\Q"), t, F.lit(f"\\E($|{edge})")))

    found = F.transform(F.array(F.lower(text(c))), lambda low: F.filter(listed, lambda t: hit(low, t)))
    return F.element_at(found, 1)


def substrings_in(c: Column | str, terms: Sequence[str]) -> Column:
    """The terms that the text contains, whole words or not."""
    low = F.lower(text(c))
    return F.array_compact(F.array(*[F.when(low.contains(t), F.lit(t)) for t in terms]))


def address_like_line(c: Column | str) -> Column:
    """The first chunk between bars, bullets or line ends that looks like an address."""
    chunks = F.transform(F.split(text(c), "[|•\n]"), clean_field)
    street = ascii_edges(STREET)

    def good(x: Column) -> Column:
        return F.length(x).between(8, 260) & x.rlike("[0-9]") & (x.rlike(POSTAL) | x.rlike(street))

    return F.coalesce(F.try_element_at(F.filter(chunks, good), F.lit(1)), F.lit(""))


def address_parts(address: Column | str, name: Column | str, state: Column | str, postal: Column | str, city: Column | str) -> Column:
    """struct(address, city, state, postalCode): the gaps filled from the address's text.

    A leading repeat of the record's name is dropped. The city is the part
    before the first part, other than the very first, that names a state. The
    postal code is the one behind a state, else the first.
    """

    def parts_of(a: Column) -> Column:
        return F.filter(F.transform(F.split(a, ","), clean_record), lambda x: x != "")

    def before_state(parts: Column) -> Column:
        """The first part that another follows which names a state."""
        named = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.rlike(STATE))
        return once(F.array_position(named, True), lambda at: F.when(at > 0, F.get(parts, at.cast("int") - 1)))

    def fill(own: Column | str, found: Column) -> Column:
        return F.when(text(own) != "", text(own)).otherwise(F.coalesce(found, F.lit("")))

    def gaps(addr: Column) -> Column:
        there = addr != ""
        return F.struct(
            F.when(there, addr).otherwise(text(address)).alias("address"),
            fill(city, F.when(there, once(parts_of(addr), before_state))).alias("city"),
            fill(state, F.when(there, F.upper(first_match(addr, STATE, 1)))).alias("state"),
            fill(postal, F.when(there, first_present(first_match(addr, STATE_ZIP, 2), first_match(addr, ZIP)))).alias("postalCode"),
        )

    def without_name(s: Column) -> Column:
        repeated = (s["nm"] != "") & F.lower(s["whole"]).startswith(F.concat(F.lower(s["nm"]), F.lit(",")))
        return F.when(repeated, F.trim(F.substring(s["whole"], F.length(s["nm"]) + 2, F.length(s["whole"])))).otherwise(s["whole"])

    both = F.struct(clean_record(address).alias("whole"), clean_record(name).alias("nm"))
    return once(both, lambda s: once(without_name(s), gaps))


def record_start(line: Column | str, accept: Sequence[str], reject: Sequence[str]) -> Column:
    """Whether a line, clean already (``clean_record``), looks like the start of a record (TXT2)."""
    line = text(line)
    title = r"^[\p{Upper}0-9][\p{Alnum} +,./&'()-]{2,120}$"
    words = F.size(F.split(line, " "))
    named = line.rlike(title) & (words <= 10) & ~line.rlike(r"\p{Nd}")
    hit = (F.size(terms_in(line, reject)) > 0) | (F.size(terms_in(line, accept)) > 0)
    labelled = (line.contains(":") | line.contains("=")) & line.rlike(rf"^{_LABELLED}\s*(?:=|:)")
    return (line != "") & (F.length(line) <= 160) & ~labelled & (hit | named)


def links(html: Column | str) -> Column:
    """The href values of a page, in order."""
    return F.regexp_extract_all(text(html), F.lit('href="([^"]+)"'), F.lit(1))


def resolve(base: Column | str, href: Column | str) -> Column:
    """An absolute address of a link on a page: absolute, //host, /path, ?query, #fragment or relative."""
    b, h = col(base), text(href)
    scheme = F.regexp_extract(b, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(b, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(b, "^([^?#]*)", 1)
    folder = F.when(F.length(path) > F.length(origin), F.regexp_replace(path, "[^/]*$", "")).otherwise(F.concat(path, F.lit("/")))
    # Dot segments of relative links, four levels up at most.
    plain = F.regexp_replace(F.concat(folder, h), r"/\.(?=/|$)", "")
    for _ in range(4):
        plain = F.regexp_replace(plain, r"(?<=[^/:])/(?!\.\./)[^/?#]+/\.\.(?=/|$)", "")
    return (
        F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("?"), F.concat(path, h))
        .when(h.startswith("#"), F.concat(F.regexp_replace(b, "#.*$", ""), h))
        .when(h == "", b)
        .otherwise(plain)
    )
