"""Records from fetched pages: structured data, cards, the page itself, and rule files.

The parser is the one place where rows go to Python: Arrow batches of
(url, html), one parse a page, only the columns that it needs. All that follows
is plain DataFrame work.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Mapping
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import vocab
from ..plans.shape import computed, spread
from .markup import Node, css, parse, select, xpath

FIELDS = "name address city region postalCode country phone email website services sourceUrl lat lng evidenceNote".split()
SCHEMA = ", ".join(["page_url string", "position int", *(f"{f} string" for f in FIELDS)])
MAX_NODES, MIN_TEXT, MAX_TEXT, MAX_NAME = 1500, 12, 2500, 180
CARD_SELECTORS = [
    *(f'[itemtype*="{x}"]' for x in ("Medical", "Hospital", "Physician")),
    *(f'[class*="{x}"]' for x in ("provider", "facility", "clinic", "location", "hospital", "practice")),
    "article", "li",
]

_D, _S = "[0-9]", r"[\s.\-]?"
PHONE = re.compile(rf"(?:\+?\d{{1,3}}[\s().\-]?)?(?:\(?\d{{2,4}}\)?{_S})?\d{{3,4}}{_S}\d{{3,4}}")
EMAIL = re.compile(r"[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}", re.I | re.A)
_POSTAL_FORMS = ["[0-9]{4,6}(?:-[0-9]{3,4})?", "[A-Z][0-9][A-Z][ -]?[0-9][A-Z][0-9]", "[A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2}"]
POSTAL = re.compile(rf"(?i)\b(?:{'|'.join(_POSTAL_FORMS)})\b")
STREET = re.compile(r"\b(suite|unit|way|" + "|".join(rf"{a}|{b}\.?" for a, b in (("avenue", "ave"), ("boulevard", "blvd"), ("drive", "dr"), ("lane", "ln"), ("road", "rd"), ("street", "st"))) + r")\b", re.I)


def tidy(value: object) -> str:
    """Collapsed text of a value; lists join by '; ', mappings' values by ', '."""
    for kind, glue in ((list, "; "), (dict, ", ")):
        if isinstance(value, kind):
            parts = value.values() if kind is dict else value
            return glue.join(filter(None, map(tidy, parts)))
    words = str(value or "").split()
    return " ".join(words).strip(",;| ")


def address_in(text: str) -> str:
    for chunk in map(tidy, re.split("\n|•|[|]", text)):
        if 8 <= len(chunk) <= 260 and any(map(str.isdigit, chunk)) and (POSTAL.search(chunk) or STREET.search(chunk)):
            return chunk
    return ""


def _found(pattern: re.Pattern[str], text: str) -> str:
    m = pattern.search(text)
    return m[0] if m else ""


def _terms(low: str, terms: Iterable[str]) -> list[str]:
    return [t for t in terms if t in low]


def _record(**known: str) -> dict[str, str]:
    return {f: known.get(f, "") for f in FIELDS}


def _kinds(thing: Mapping) -> set[str]:
    kind = thing.get("@type") or thing.get("type") or []
    return {kind} if isinstance(kind, str) else set(map(str, kind)) if isinstance(kind, list) else set()


def structured_rows(page: Node, url: str, country: str, terms: list[str], types: frozenset[str]) -> Iterator[dict[str, str]]:
    """Records of JSON-LD scripts (E9), breadth first; a script that can't be read is skipped."""
    for script in select(page, "script"):
        if script.attrs.get("type") != "application/ld+json":
            continue
        try:
            data = json.loads("".join(script.texts()))
        except ValueError:
            continue
        queue = list(data) if isinstance(data, list) else [data]
        for thing in queue:  # grows while it is read
            if not isinstance(thing, dict):
                continue
            if isinstance(thing.get("@graph"), list):
                queue += thing["@graph"]
            for part in "department subOrganization member itemListElement".split():
                below = thing.get(part)
                queue += below if isinstance(below, list) else [below] if isinstance(below, dict) else []
            kinds = _kinds(thing)
            if not kinds & types and not ("LocalBusiness" in kinds and _terms(json.dumps(thing, ensure_ascii=False).lower(), terms)):
                continue
            name = tidy(thing.get("name"))
            if not name:
                continue
            where, geo = thing.get("address") or {}, thing.get("geo") or {}
            where = {"streetAddress": where} if isinstance(where, str) else where
            listed = not isinstance(where, dict)
            part = (lambda key: "") if listed else (lambda key, w=where: tidy(w.get(key)))
            spot = geo if isinstance(geo, dict) else {}
            # The set of types has no order of its own: it is listed alphabetically.
            yield _record(
                name=name, evidenceNote="json-ld", services=tidy(thing.get("medicalSpecialty") or thing.get("description") or sorted(kinds)),
                website=tidy(thing.get("url")), phone=tidy(thing.get("telephone")), email=tidy(thing.get("email")), lat=tidy(spot.get("latitude")), lng=tidy(spot.get("longitude")),
                country=tidy(country) if listed else part("addressCountry"), region=part("addressRegion"), city=part("addressLocality"),
                postalCode=part("postalCode"), address=tidy(where) if listed else part("streetAddress"),
            )


def _link(node: Node, start: str) -> str:
    hits = [n.attrs["href"] for n in node.walk() if n is not node and n.tag == "a" and n.attrs.get("href", "").startswith(start)]
    return tidy(hits[0]) if hits else ""


def card_rows(page: Node, url: str, country: str, terms: list[str]) -> Iterator[dict[str, str]]:
    """Records of elements that look like entries of a directory."""
    scanned = 0
    for selector in CARD_SELECTORS:
        for node in select(page, selector):
            scanned += 1
            if scanned > MAX_NODES:
                return
            text = tidy(" ".join(node.texts()))
            low = text.lower()
            if not MIN_TEXT <= len(text) <= MAX_TEXT or not (hits := _terms(low, terms)):
                continue
            phone = _link(node, "tel:").replace("tel:", "") or tidy(_found(PHONE, text))
            email = _link(node, "mailto:").replace("mailto:", "") or tidy(_found(EMAIL, text))
            address = tidy(" ".join(t for n in select(node, "address") for t in n.texts())) or address_in(text)
            heads = [t for n in node.walk() if n is not node and (re.fullmatch("h[1-5]", n.tag) or n.attrs.get("itemprop") == "name") for t in n.own_texts()]
            name = tidy(" ".join(heads)) or tidy((node.texts() or [""])[0])
            website, postal = _link(node, "http"), tidy(_found(POSTAL, text))
            if name and len(name) <= MAX_NAME and (address or phone or email or postal or website):
                site = urljoin(url, website) if website else ""
                yield _record(name=name, services="; ".join(hits)[:500], evidenceNote=text[:1500], website=site, email=email, phone=phone, country=country, postalCode=postal, address=address)


def page_row(page: Node, url: str, country: str, terms: list[str]) -> dict[str, str] | None:
    """The page as one record, if it names and places something."""
    title = tidy(" ".join(t for n in page.walk() if n.tag in ("h1", "title") for t in n.own_texts()))
    body = select(page, "body")
    text = tidy(" ".join(t for n in body[:1] for t in n.texts()))[:8000]
    hits = _terms(f"{title} {text}".lower(), terms)
    if not title or not hits:
        return None
    phone, email, postal = (_found(p, text) for p in (PHONE, EMAIL, POSTAL))
    address = tidy(" ".join(t for n in select(page, "address") for t in n.texts())) or address_in(text)
    if not (address or phone or email or postal):
        return None
    return _record(name=title[:MAX_NAME], services="; ".join(hits)[:500], evidenceNote=text[:1500], website=url, email=email, phone=phone, country=country, postalCode=postal, address=address)


def page_records(html: str | None, url: str, country: str = "", terms: list[str] | None = None, types: frozenset[str] = vocab.HEALTH_TYPES) -> list[dict[str, str]]:
    """The records of a page, without repeats by name, address, phone digits and website."""
    terms = vocab.HEALTH_TERMS if terms is None else terms
    page = parse(html)
    rows = [*structured_rows(page, url, country, terms, types), *card_rows(page, url, country, terms)]
    if not rows and (alone := page_row(page, url, country, terms)):
        rows = [alone]
    out: dict[tuple[str, ...], dict[str, str]] = {}
    for row in rows:
        digits = "".join(filter(str.isdecimal, row["phone"]))
        key = (digits, *(row[f].lower() for f in ("name", "website", "address")))
        out.setdefault(key, row | {"sourceUrl": url, "country": row["country"] or country})
    return list(out.values())


def extract_records(pages: DataFrame, run_key: str = "", source_type: str = "pasted_url_scrape", source_tag: str = "scrapy_directory", terms: list[str] | None = None) -> DataFrame:
    """One row a record of pages (url, html, and country if there is one).

    A null or empty html has no records; a null url counts as ''.
    """
    has_country = "country" in pages.columns

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url, html, country in zip(pdf["url"], pdf["html"], pdf["country"], strict=True):
                for k, r in enumerate(page_records(html, url or "", country or "", terms)):
                    rows.append([url, k, *(r.get(f, "") for f in FIELDS)])
            yield pd.DataFrame(rows, columns=["page_url", "position", *FIELDS])

    wanted = pages.select("url", "html", (F.col("country") if has_country else F.lit("")).alias("country"))
    stamps = {"crawlRunKey": run_key, "sourceType": source_type, "sourceTag": source_tag, "type": "provider_candidate"}
    return spread(wanted).mapInPandas(work, SCHEMA).withColumns({k: F.lit(v) for k, v in stamps.items()})


# -- rule files (E12, SRC9) -------------------------------------------------------


def by_rule(node: Node, rule: object) -> list[str]:
    """What a rule gives: a selector, or {type, selector | css | xpath}."""
    if not rule:
        return []
    if isinstance(rule, str):
        found = css(node, rule)
    else:
        selector = next((rule[k] for k in ("selector", "css", "xpath") if rule.get(k)), None)
        if selector is None:
            return []
        found = (xpath if rule.get("type") == "xpath" or rule.get("xpath") else css)(node, selector)
    return [x for x in (" ".join(v.split()) for v in found) if x]


def _one(node: Node, rule: object) -> str | None:
    found = by_rule(node, rule)
    if not found:
        return None
    glue = None if isinstance(rule, str) else rule.get("join")
    return str(glue).join(found) if glue else found[0]


def _item(node: Node, url: str, config: Mapping, tag: str) -> dict[str, str]:
    item = dict(config.get("defaults", {}))
    for name, rule in config.get("fields", {}).items():
        if value := _one(node, rule):
            item[name] = value
    for k, v in (("sourceTag", tag), ("sourceUrl", url), ("internalStatus", "candidate")):
        item.setdefault(k, v)
    return item


def rule_records(pages: DataFrame, config: Mapping) -> DataFrame:
    """(page_url, position, kind, link, item) by a rule file, over pages (url, html).

    kind 'item': a record. 'detail': a record to be completed on the page
    ``link``. 'page': a further page of the list. item is a JSON object.
    """
    tag = config.get("sourceTag", "scrapy_directory")
    follow = config.get("follow", {})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url, html in zip(pdf["url"], pdf["html"], strict=True):
                page, url = parse(html), url or ""
                listed = config.get("listSelector")
                for node in select(page, listed) if listed else [page]:
                    item = json.dumps(_item(node, url, config, tag), ensure_ascii=False)
                    links = by_rule(node, follow.get("detailLinks")) if listed else []
                    for link in links or [None]:
                        rows.append([url, len(rows), "detail" if link else "item", urljoin(url, link) if link else None, item])
                for link in by_rule(page, follow.get("pagination")):
                    rows.append([url, len(rows), "page", urljoin(url, link), None])
            yield pd.DataFrame(rows, columns=["page_url", "position", "kind", "link", "item"])

    return pages.select("url", "html").mapInPandas(work, "page_url string, position int, kind string, link string, item string")


def complete_details(seeds: DataFrame, pages: DataFrame, config: Mapping) -> DataFrame:
    """(page_url, item): seeds (link, item) completed by the rules for detail pages."""
    rules = config.get("detailFields", {})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url, html, seed in zip(pdf["url"], pdf["html"], pdf["item"], strict=True):
                page, item = parse(html), json.loads(seed or "{}")
                item |= {name: value for name, rule in rules.items() if (value := _one(page, rule))}
                rows.append([url, json.dumps(item | {"sourceUrl": url}, ensure_ascii=False)])
            yield pd.DataFrame(rows, columns=["page_url", "item"])

    joined = seeds.where("kind = 'detail'").select("link", "item").join(pages.select(F.col("url").alias("link"), "html"), "link")
    return joined.select(F.col("link").alias("url"), "html", "item").mapInPandas(work, "page_url string, item string")


# -- printed directories (SRC7, E18) -----------------------------------------------

PRINTED_TERMS = ["clinic", "dentist", "doctor", "health", "hospital", "laboratory", "medical", "physician", "rehabilitation"]


PRINTED_PHONE = r"(?U)\+?\d[\d\s().-]{7,}\d"
PRINTED_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PRINTED_WEBSITE = r"(?U)(?:https?://|www\.)\S+"


def term_windows(lines: DataFrame, terms: list[str] | None = None, size: int = 5) -> DataFrame:
    """(doc, page, line_no, name, blob): windows of ``size`` lines of (doc, page, line_no, text)
    that hold a term. A plain window of leads: no Python."""
    from pyspark.sql import Window

    from ..functions.text import any_of, clean_line

    terms = PRINTED_TERMS if terms is None else terms
    w = Window.partitionBy("doc", "page").orderBy("line_no")
    kept = lines.withColumn("text", clean_line("text")).where("text != ''")
    blob = F.concat_ws(" ", *[F.lead("text", k).over(w) if k else F.col("text") for k in range(size)])
    out = kept.select("doc", "page", "line_no", F.substring("text", 1, 160).alias("name"), blob.alias("blob"))
    return out.where(any_of([F.lower("blob").contains(t) for t in terms]))


def printed_windows(lines: DataFrame, terms: list[str] | None = None, size: int = 5) -> DataFrame:
    """(doc, page, line_no, name, blob, address, phone, email, website): windows of ``size`` lines that
    hold a term and a phone number, an e-mail address or a URL; the first of each, '' if there is
    none; address is the window's beginning."""
    return _with_contacts(term_windows(lines, terms, size))


def _with_contacts(windows: DataFrame) -> DataFrame:
    contacts = {"phone": PRINTED_PHONE, "email": PRINTED_EMAIL, "website": PRINTED_WEBSITE}
    found = computed(windows, *windows.columns, *[F.regexp_extract("blob", p, 0).alias(c) for c, p in contacts.items()])
    found = found.where(" or ".join(f"{c} != ''" for c in contacts))
    return found.select("doc", "page", "line_no", "name", "blob", F.substring("blob", 1, 500).alias("address"), *contacts)


def text_windows(texts: DataFrame, terms: list[str] | None = None, size: int = 5, contact: bool = False) -> DataFrame:
    """``term_windows`` of whole texts (doc, page, text): each text's lines stay in its row, so nothing
    is shuffled or sorted. ``contact`` leaves out windows that can't hold one: none of their lines has a
    digit or a sign of an address."""
    from ..functions.text import any_of, clean_line

    terms = PRINTED_TERMS if terms is None else terms
    own = ["doc", "page"]
    sign = lambda x: x.contains("@") | x.contains("://") | x.contains("www.") | x.rlike(r"(?U)\d") if contact else F.lit(True)
    cleaned = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line_no"), clean_line(x).alias("text")))
    kept = computed(spread(texts), *own, F.filter(cleaned, lambda x: x["text"] != "").alias("kept"))
    lines = computed(kept, *own, "kept", F.transform("kept", lambda x: x["text"]).alias("texts"), F.transform("kept", lambda x: sign(x["text"])).alias("signs"))

    def window(x: Column, i: Column) -> Column:
        able = F.exists(F.slice("signs", i + 1, size), lambda s: s)
        blob = F.when(able, F.array_join(F.slice("texts", i + 1, size), " "))
        return F.struct(x["line_no"].alias("line_no"), F.substring(x["text"], 1, 160).alias("name"), blob.alias("blob"))

    def has_term(w: Column) -> Column:
        return E.once(F.lower(w["blob"]), lambda low: any_of([low.contains(t) for t in terms]))

    windows = F.filter(F.transform("kept", window), lambda w: w["blob"].isNotNull() & has_term(w))
    return lines.select(*own, F.inline(windows))


def printed_text_windows(texts: DataFrame, terms: list[str] | None = None, size: int = 5) -> DataFrame:
    """``printed_windows`` of whole texts (doc, page, text)."""
    return _with_contacts(text_windows(texts, terms, size, contact=True))
