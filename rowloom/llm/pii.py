"""Personal data: keyed, type-consistent surrogates for detected entities.

Types: e-mail, IPv4, payment card (13 to 19 digits), phone, US social security
number, IBAN, access keys and assigned secrets, names after an honorific, and
every other place in the same text where a word of such a name stands with a
capital first letter. Cards, phones and social security numbers may be written in
the decimal digits of any script and keep that script.

Distinctness. Everything but names goes through a keyed permutation (a Feistel
network over the strings of the same format, with cycle walking): digits stay
digits, letters keep their case, separators stay, the check digit of a card and
of an IBAN stays as right or wrong as it was, a private address stays private. Texts
of over ``BLOCK`` signs go block by block, each block's permutation keyed by what
stands before it.
Two entities of a format can't share a surrogate, however many there are, and
nothing has to be looked up, so replacement is one map-only pass.

Names. Given names map to given names of the honorific's gender and the name's
script, family names to family names of the script, each by a keyed draw; a name
in capitals gets one in capitals. After an honorific of no gender a given name has
the gender that the corpus's other honorifics give that word, if they agree.
Draws can collide: all distinct names of the corpus are gathered (names only),
and while two share a surrogate, or a surrogate is itself a name in the corpus,
all but the alphabetically first draw again from a longer range. The rare names
that drew more than once are broadcast if there are at most ``MAX_REDRAWN``;
beyond that they are joined to the texts that hold them.

Coreference. A surrogate depends on the key, the type and the normalised entity
alone (case, a phone's or card's separators and the digits' script don't count),
so an entity has the same surrogate in every document and on every executor. The
key is the session's ``rowloom.pii.key``; where that is unset a built-in key, which
anyone can know, is used with a warning.

Defined cases. Null text stays null, empty text empty, both with 0 entities.
Null doc_id: the row is treated as any other. Repeated rows get equal results.
Overlapping entities: the leftmost wins, at one place the type named first
above. Every sign that isn't part of an entity stays as it is, whatever its script;
time is linear in the text's length, with or without white space. Empty table: empty result. Other columns are carried through untouched
by ``replace_pii``. Texts are processed whole.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import warnings
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .shared import cut, table

DEFAULT_KEY = "rowloom-surrogates"
MAX_REDRAWN = 100_000
BLOCK = 64
PARTS = 8  # hyphenated parts of a name's word that its bare repeats are looked up by

TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Sir", "Signor", "Г-н", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Srta", "Sra", "Doña", "Madam", "Signora", "Г-жа", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof", "Mx"],
}
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_TITLE = "|".join(sorted(_GENDER, key=len, reverse=True))
_UPPER = "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c)) == "Lu") + "".join(chr(c) for c in range(0x370, 0x530) if unicodedata.category(chr(c)) == "Lu")
#: What the corpus settled about a given name after an honorific of no gender, beside the redraws.
_SETTLED = {-1: "m", -2: "f"}
_PY_NAME = rf"[{_UPPER}](?:[^\W\d_]|['’\-\u0300-\u036f])*[^\W\d_]"

_DETECT = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9\-]))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?\d))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9]))"
    r"|(?P<card>(?<!\d)(?<!\d\.)(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){2}[ \-]\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d))"
    r"|(?P<ssn>(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]))"
    r"|(?P<phone>(?<![\w.])(?:(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]?\d{3,4}|\+\d{8,15})(?![\w\-]))"
    r"|(?P<key>(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:gh[pousr]_|sk_live_|sk-|xox[abp]-)[A-Za-z0-9_\-]{16,})"
    r"|(?i:(?<!\w)(?:\w*api[_\-]?key|\w*secret|\w*token|passw(?:or)?d|pwd|access[_\-]?key)[\"']?\s*[:=]\s*[\"']?)(?P<secret>[A-Za-z0-9+/_\-.=]{8,})"
    rf"|(?P<title>(?<!\w)(?:{_TITLE}))\.?[ \xa0](?P<name>{_PY_NAME}(?:[ \xa0]{_PY_NAME}){{0,2}})(?!\w)"
)
_JOINT = re.compile("['’\\-]")
_CAPITAL = re.compile(rf"(?<![\w]){_PY_NAME}(?!\w)")
#: Without one of these a text has no entity; RE2 looks for them before anything else is done.
_TITLED = rf"(?:{_TITLE})\.?[ \x{{a0}}]"
_HINT = rf"[\p{{Nd}}@]|(?i:key|secret|token|passw|pwd)|{_TITLED}"

_GIVEN = {
    ("LATIN", "m"): ["Adrian", "Bruno", "Casper", "Dario", "Emil", "Felix", "Gideon", "Hugo", "Ivo", "Jonas", "Karl", "Leon", "Marius", "Nils", "Oskar", "Pablo"],
    ("LATIN", "f"): ["Alma", "Berta", "Clara", "Dora", "Elena", "Frida", "Greta", "Hanna", "Ida", "Julia", "Klara", "Lena", "Marta", "Nora", "Olivia", "Paula"],
    ("LATIN", "n"): ["Alex", "Billie", "Charlie", "Dana", "Eden", "Frankie", "Jamie", "Kim", "Lou", "Morgan", "Noor", "Quinn", "Robin", "Sam", "Taylor", "Val"],
    ("CYRILLIC", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Олег"],
    ("CYRILLIC", "f"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    ("CYRILLIC", "n"): ["Саша", "Женя", "Валя", "Слава"],
    ("GREEK", "m"): ["Ανδρέας", "Γιάννης", "Νίκος", "Πέτρος"],
    ("GREEK", "f"): ["Άννα", "Ελένη", "Μαρία", "Σοφία"],
    ("GREEK", "n"): ["Αλέξης", "Χάρι"],
}
_SYLLABLES = {
    "LATIN": ["bar", "cor", "dal", "fen", "gar", "hol", "ken", "lor", "mar", "nor", "pel", "ros", "sel", "tor", "val", "win"],
    "CYRILLIC": ["бор", "вал", "гор", "дам", "зор", "кал", "лес", "мир", "нов", "пет", "рад", "сел", "тих", "фед", "хол", "чер"],
    "GREEK": ["αν", "βασ", "γερ", "δημ", "καρ", "λαμ", "μαν", "νικ", "παπ", "ραλ", "σαμ", "τσα", "φιλ", "χρι", "ψαρ", "ζαχ"],
}
_FAMILY_END = {"LATIN": ["son", "er", "ley", "ton"], "CYRILLIC": ["ов", "ин", "енко", "ский"], "GREEK": ["ίδης", "άκης", "όπουλος", "ου"]}


def _draw(key: bytes, *parts: str, size: int = 8) -> int:
    return int.from_bytes(hashlib.shake_256(key + b"\0" + "\0".join(parts).encode("utf-8", "surrogatepass")).digest(size), "big")


def permute(key: bytes, tweak: str, x: int, size: int, valid=None) -> int:
    """A keyed permutation of range(size); with ``valid``, of those x that it holds for."""
    if not 0 <= x < size or (valid is not None and not valid(x)):
        raise ValueError("x is not among what is permuted")
    if size < 2:
        return x
    bits = max(2, (size - 1).bit_length())
    half = (bits + 1) // 2
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = x >> half, x & mask
        for i in range(8):
            left, right = right, left ^ (_draw(key, tweak, f"{size:x}", str(i), f"{right:x}", size=width) & mask)
        x = left << half | right
        if x < size and (valid is None or valid(x)):
            return x


def _classes(text: str) -> list[tuple[int, int]]:
    return [(10, 48) if "0" <= c <= "9" else (26, 97) if "a" <= c <= "z" else (26, 65) if "A" <= c <= "Z" else (1, ord(c)) for c in text]


def permute_text(key: bytes, tweak: str, text: str, hexadecimal: bool = False, valid=None) -> str:
    """A keyed permutation of the strings of text's format: digits, small and capital letters
    stay such, all else stays. hexadecimal: digits and a to f are one class."""
    if len(text) > BLOCK:
        # Formats that ask for more are shorter.
        parts, before = [], hashlib.sha256(f"{tweak}:{len(text)}:{hexadecimal}".encode())
        for at in range(0, len(text), BLOCK):
            block = text[at : at + BLOCK]
            parts.append(permute_text(key, f"{tweak}:{before.hexdigest()}", block, hexadecimal))
            before.update(block.encode())
        return "".join(parts)
    if hexadecimal:
        n = int(text, 16)
        return format(permute(key, f"{tweak}:x{len(text)}", n, 16 ** len(text)), f"0{len(text)}x")
    classes = _classes(text)
    form = "".join("d" if r == 10 else "l" if (r, b) == (26, 97) else "u" if r == 26 else chr(b) for r, b in classes)
    x, size = 0, 1
    for c, (radix, base) in zip(text, classes, strict=True):
        x, size = x * radix + (ord(c) - base), size * radix

    def back(x: int) -> str:
        out = []
        for radix, base in reversed(classes):
            x, r = divmod(x, radix)
            out.append(chr(base + r))
        return "".join(reversed(out))

    return back(permute(key, f"{tweak}:{form}", x, size, valid and (lambda y: valid(back(y)))))


def _refill(template: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in template)


def plain_digits(text: str) -> str:
    """text with decimal digits of other scripts as ASCII ones."""
    return text if text.isascii() else "".join(c if (d := unicodedata.decimal(c, None)) is None else str(d) for c in text)


def in_script_of(template: str, digits: str) -> str:
    """digits, sign for sign in the script of the template's."""
    if template.isascii():
        return digits
    return "".join(new if old.isascii() or (d := unicodedata.decimal(old, None)) is None else chr(ord(old) - d + int(new)) for old, new in zip(template, digits, strict=True))


def luhn(digits: str) -> int:
    """The check digit for the digits before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _email(key: bytes, text: str) -> str:
    local, _, domain = text.lower().partition("@")
    rest, _, top = domain.rpartition(".")
    out = f"{permute_text(key, 'local', local)}@{permute_text(key, 'domain', rest)}.{top}"
    return "".join(o.upper() if c.isupper() else o for c, o in zip(text, out, strict=True))


def _ip_class(x: int) -> str:
    a, b = x >> 24, x >> 16 & 255
    if a == 10 or (a == 172 and 16 <= b < 32) or (a == 192 and b == 168):
        return "private"
    return "loopback" if a == 127 else "special" if a == 0 or a >= 224 else "public"


def _ip(key: bytes, text: str) -> str:
    x = int.from_bytes(bytes(map(int, text.split("."))), "big")
    kind = _ip_class(x)
    y = permute(key, "ip:" + kind, x, 1 << 32, lambda z: _ip_class(z) == kind)
    return ".".join(map(str, y.to_bytes(4, "big")))


def _card(key: bytes, text: str) -> str:
    d = "".join(c for c in text if c.isdigit())
    body = d[0] + permute_text(key, "card" + d[0], d[1:-1])
    return _refill(text, body + str((luhn(body) + int(d[-1]) - luhn(d[:-1])) % 10))


def _phone(key: bytes, text: str) -> str:
    head = m[0] if (m := re.match(r"\+\d{1,3}(?=[ .\-(])", text)) else ""
    rest = text[len(head) :]
    d = "".join(c for c in rest if c.isdigit())
    north = len(d) == 10 and d[0] > "1" and d[3] > "1"
    return head + _refill(rest, permute_text(key, f"phone{north:d}", d, valid=(lambda s: s[0] > "1" and s[3] > "1") if north else None))


def _iban(key: bytes, text: str) -> str:
    flat = text.replace(" ", "")
    body = permute_text(key, "iban" + flat[:2], flat[4:])
    out = flat[:2] + f"{98 - _mod97(body + flat[:2] + '00'):02d}" + body
    it = iter(out)
    return "".join(c if c == " " else next(it) for c in text)


def _secret(key: bytes, text: str) -> str:
    if len(text) % 2 == 0 and re.fullmatch(r"[0-9a-f]+", text):
        return permute_text(key, "secret", text, hexadecimal=True)
    return permute_text(key, "secret", text)


def _access_key(key: bytes, text: str) -> str:
    head = m[0] if (m := re.match(r"AKIA|ASIA|gh[pousr]_|sk_live_|sk-|xox[abp]-", text)) else ""
    return head + permute_text(key, "key" + head, text[len(head) :])


def script_of(word: str) -> str:
    for c in word:
        name = unicodedata.name(c, "")
        for script in _SYLLABLES:
            if name.startswith(script):
                return script
    return "LATIN"


def name_surrogate(key: bytes, kind: str, word: str, attempt: int = 0) -> str:
    """kind: given name by gender ('m', 'f', 'n'), or 'family'. Each attempt has a longer range."""
    low = word.lower()
    script = script_of(low)
    x = _draw(key, kind, low, str(attempt), size=16)
    if kind != "family":
        names = _GIVEN[script, kind]
        x, r = divmod(x, len(names))
        first = names[r]
        syllables = 2 + attempt
    else:
        first, syllables = "", 4 + attempt
    parts = []
    for _ in range(syllables):
        x, r = divmod(x, 16)
        parts.append(_SYLLABLES[script][r])
    tail = "".join(parts)
    if kind == "family":
        return (tail + _FAMILY_END[script][x % 4]).capitalize()
    return f"{first}-{tail.capitalize()}"


def in_case_of(template: str, name: str) -> str:
    """name, in capitals if the template is."""
    return name.upper() if len(template) > 1 and template.isupper() else name


def name_parts(title: str, name: str) -> list[tuple[str, str]]:
    """(kind, word) of each word: the last is the family name, those before are given names."""
    words = re.split("[ \xa0]", name)
    return [(_GENDER[title], w) for w in words[:-1]] + [("family", words[-1])]


class Replacer:
    def __init__(self, key: str, redrawn: dict[tuple[str, str], int] | None = None):
        self.key = key.encode()
        self.redrawn = redrawn or {}
        self.one = lru_cache(1 << 16)(self._one)

    def _one(self, kind: str, text: str) -> str | None:
        if kind == "iban":
            flat = text.replace(" ", "")
            return _iban(self.key, text) if _mod97(flat[4:] + flat[:4]) == 1 else None
        made = {"email": _email, "ip": _ip, "key": _access_key, "secret": _secret}
        if kind in made:
            return made[kind](self.key, text)
        numbers = {"card": _card, "phone": _phone, "ssn": lambda key, t: permute_text(key, "ssn", t)}
        return in_script_of(text, numbers[kind](self.key, plain_digits(text)))

    def _name(self, kind: str, word: str, redrawn: dict[tuple[str, str], int]) -> str:
        low = word.lower()
        if kind == "n" and (gender := redrawn.get((kind, low), 0)) < 0:
            kind = _SETTLED[gender]
        return in_case_of(word, name_surrogate(self.key, kind, word, redrawn.get((kind, low), 0)))

    def text(self, text: str, redrawn: dict[tuple[str, str], int] | None = None) -> tuple[str, int]:
        redrawn = self.redrawn if redrawn is None else redrawn
        spans: list[tuple[int, int, str]] = []
        kinds: dict[str, str] = {}
        for m in _DETECT.finditer(text):
            kind = m.lastgroup
            if kind == "name":
                parts = name_parts(m["title"], m["name"])
                at, out = m.start(kind), []
                for part, word in parts:
                    # The sign between two words stays.
                    out += [self._name(part, word, redrawn), text[at + len(word) : at + len(word) + 1]]
                    at += len(word) + 1
                    kinds.setdefault(word.lower(), part)
                spans.append((*m.span(kind), "".join(out[:-1])))
            elif (new := self.one(kind, m[kind])) is not None:
                spans.append((*m.span(kind), new))
        if kinds:
            spans = self._repeats(text, spans, kinds, redrawn)
        out, at = [], 0
        for start, end, new in spans:
            out += [text[at:start], new]
            at = end
        return ("".join([*out, text[at:]]) if spans else text), len(spans)

    def _repeats(self, text: str, spans: list[tuple[int, int, str]], kinds: dict[str, str], redrawn: dict[tuple[str, str], int]) -> list[tuple[int, int, str]]:
        """spans and those between them where a name's word stands by itself."""
        more, at = [], 0
        for start, end in [*((a, b) for a, b, _ in spans), (len(text), len(text))]:
            for m in _CAPITAL.finditer(text, at, start):
                cuts = [m.start(), *(x.end() for x in _JOINT.finditer(text, *m.span()))]
                ends = [*(x.start() for x in _JOINT.finditer(text, *m.span())), m.end()]
                # The longest run of parts that is such a word, then what follows it.
                i = 0
                while i < len(cuts):
                    for j in range(min(len(ends), i + PARTS) - 1, i - 1, -1):
                        word = text[cuts[i] : ends[j]]
                        if word[:1].isupper() and (kind := kinds.get(word.lower())) is not None:
                            more.append((cuts[i], ends[j], self._name(kind, word, redrawn)))
                            i = j
                            break
                    i += 1
            at = end
        return sorted([*spans, *more])

    def column(self, column: pa.Array, redrawn: list | None = None) -> tuple[pa.Array, np.ndarray]:
        counts = np.zeros(len(column), np.int32)
        hint = np.flatnonzero(pc.match_substring_regex(column, _HINT).fill_null(False).to_numpy(zero_copy_only=False))
        changed: dict[int, str] = {}
        for i in hint:
            own = None
            if redrawn is not None:
                own = {(r["kind"], r["word"]): r["attempt"] for r in redrawn[i] or []}
            new, n = self.text(column[i].as_py(), own)
            if n:
                changed[i], counts[i] = new, n
        if not changed:
            return column, counts
        mask = np.zeros(len(column), bool)
        mask[list(changed)] = True
        return pc.replace_with_mask(column, pa.array(mask), pa.array([changed[i] for i in sorted(changed)], column.type)), counts


# -- names of the corpus ------------------------------------------------------


def _spoken_names(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(kind, word), with_text also text: the name words that ``Replacer`` replaces, by its own matcher."""
    names = ["kind", "word", *["text"] * with_text]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = K.column_of(batch, "text")
        titled = column.filter(pc.match_substring_regex(column, _TITLED).fill_null(False)).to_pylist()
        found = {(k, w.lower(), *[t] * with_text) for t in titled for m in _DETECT.finditer(t) if m.lastgroup == "name" for k, w in name_parts(m["title"], m["name"])}
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in range(len(names))], names)

    return docs.select("text").mapInArrow(K.by_chunk(work), ", ".join(f"{c} string" for c in names))


def gathered_names(docs: DataFrame) -> DataFrame:
    """(kind, word): the distinct name words of docs."""
    return cut(_spoken_names(docs).distinct())


def settled_genders(names: DataFrame) -> DataFrame:
    """(kind, word, attempt) of given names of kind n that otherwise have one gender; attempt is
    its number in ``_SETTLED``."""
    seen = names.where("kind != 'family'").groupBy("word").agg(*(F.max((F.col("kind") == k).cast("int")).alias(k) for k in "nmf"))
    return seen.where("n = 1 and m + f = 1").select(F.lit("n").alias("kind"), "word", F.when(F.col("m") == 1, -1).otherwise(-2).alias("attempt"))


def redrawn_names(docs: DataFrame, key: str) -> DataFrame:
    """(kind, word, attempt) of those names that needed more than one draw to be distinct.
    docs: documents, or the names gathered from them."""
    secret = key.encode()
    gathered = gathered_names(docs) if "text" in docs.columns else docs
    settled = settled_genders(gathered).select("kind", "word")

    @F.pandas_udf("string")
    def draw(kind, word, attempt):
        import pandas as pd

        return pd.Series([name_surrogate(secret, k, w, int(a)).lower() for k, w, a in zip(kind, word, attempt, strict=True)], dtype="object")

    drawn = gathered.join(settled, ["kind", "word"], "left_anti").withColumn("attempt", F.lit(0))
    names = cut(drawn.withColumn("sub", draw("kind", "word", "attempt")))
    while True:
        # kind and attempt shape a surrogate, so only equal surrogates of a kind can collide.
        firsts = names.groupBy("kind", "sub").agg(F.min("word").alias("first"), F.count("*").alias("n"))
        real = names.select("kind", F.col("word").alias("sub")).withColumn("real", F.lit(True))
        again = F.coalesce("real", F.lit(False)) | ((F.col("n") > 1) & (F.col("word") != F.col("first")))
        seen = names.join(firsts, ["kind", "sub"]).join(real, ["kind", "sub"], "left").withColumn("again", again)
        if seen.where("again").isEmpty():
            return names.where("attempt > 0").select("kind", "word", "attempt")
        moved = seen.select("kind", "word", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
        names = cut(moved.withColumn("sub", draw("kind", "word", "attempt")))


def _replaced(docs: DataFrame, key: str, count: str, max_redrawn: int) -> DataFrame:
    """docs with surrogates in text, and the number of entities in the column ``count``."""
    gathered = gathered_names(docs)
    redrawn = redrawn_names(gathered, key).unionByName(settled_genders(gathered))
    names = docs.columns
    at = names.index("text")
    some = [(r["kind"], r["word"], r["attempt"]) for r in redrawn.limit(max_redrawn + 1).collect()]
    if len(some) <= max_redrawn:
        shared = docs.sparkSession.sparkContext.broadcast({(k, w): a for k, w, a in some})
        source, own = docs, None
    else:
        own, hashed = K.fresh(names, "redrawn"), K.fresh(names, "text_hash")
        # By the word alone: what is settled about a given name refers to another kind.
        spoken = _spoken_names(docs, True).select("word", "text").join(redrawn, "word")
        per_text = spoken.groupBy(F.sha2("text", 256).alias(hashed)).agg(F.collect_set(F.struct("kind", "word", "attempt")).alias(own))
        source = docs.withColumn(hashed, F.sha2("text", 256)).join(per_text, hashed, "left").select(*[docs[f"`{c}`"] for c in names], own)
        shared = None
    made: dict[str, Replacer] = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "it" not in made:
            made["it"] = Replacer(key, shared.value if shared else None)
        text, n = made["it"].column(batch.column(at), K.column_of(batch, own).to_pylist() if own else None)
        cols = list(batch.columns[: len(names)])
        cols[at] = text
        return pa.RecordBatch.from_arrays([*cols, pa.array(n)], [*names, count])

    return source.mapInArrow(K.by_chunk(work), T.StructType([*docs.schema.fields, T.StructField(count, T.IntegerType())]))


def session_key(spark: SparkSession) -> str:
    """The session's key; the built-in one, which hides nothing from who knows it, only with a warning."""
    key = spark.conf.get("rowloom.pii.key", None)
    if key is None:
        warnings.warn("rowloom.pii.key isn't set: surrogates are drawn with a key that is public", stacklevel=3)
    return DEFAULT_KEY if key is None else key


def replace_pii(docs: DataFrame, key: str | None = None, max_redrawn: int = MAX_REDRAWN) -> DataFrame:
    """docs with surrogates in place of the entities in text; all else as it was."""
    count = K.fresh(docs.columns, "entities")
    return _replaced(docs, session_key(docs.sparkSession) if key is None else key, count, max_redrawn).select(*[f"`{c}`" for c in docs.columns])


def surrogates(docs: DataFrame, key: str | None = None, max_redrawn: int = MAX_REDRAWN) -> DataFrame:
    """(doc_id, text, entities) of every row of docs."""
    return _replaced(docs.select("doc_id", "text"), session_key(docs.sparkSession) if key is None else key, "entities", max_redrawn)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates(table(spark, sf_dir, "documents"))
