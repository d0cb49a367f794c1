"""Surrogates for personal data.

Entities are found in whole texts (``_entities``) and replaced by surrogates of the same
kind, format, script and, for names, gender (``_surrogates`` below).  One value has one
surrogate in every document of the corpus, and two values of a kind never share one; both
hold by construction, and ``collisions`` checks them over a whole corpus.

Kinds: e-mail addresses (of any alphabet), IBANs, payment cards, IPv4 and IPv6 addresses,
US social security numbers, phone numbers, numbers of identity documents and dates of birth
after a word that tells them, and persons.  A person is a titled name, a listed first name
with what follows it, a run of two to four capitalised words beside words that are said of
persons, such a run after a person and "and", and any later single part of a found name.

A surrogate is a keyed permutation without fixed points of all strings of the same shape: a
Feistel network over the shape's numbers, conjugating a shift by one.  The shape follows from
the value alone, never from its spelling, so a number with and without separators has one
surrogate in two spellings.  Letters stay letters of their script and case and digits digits;
separators, country prefixes, top-level domains, issuer digits, titles, particles, endings
that tell a gender and address classes stay; check digits are made anew; dates of birth stay
in their decade.  Listed first names stay in their list (gender and script).

Defined cases: null text stays null with no entities; overlapping finds go to the leftmost,
then to the kind listed first; every found entity changes; a value's surrogate does not
depend on what else is in its text; repeated rows get equal results; an empty table gives an
empty result; other columns are kept only by ``redact_column``.  A national phone number and
the same number with its country code are two values (North American ones are one).
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import ipaddress
import itertools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._entities import KINDS, LIST_OF, MONTHS, NAMES, PARTICLES, find, luhn, solid, valid

__all__ = ["KINDS", "NAMES", "canonical", "collisions", "find", "luhn", "redact", "redact_column", "surrogates", "valid"]

_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
_ALPHABETS = (
    "0123456789",
    _VOWELS,
    _CONSONANTS,
    _VOWELS.upper(),
    _CONSONANTS.upper(),
    "аеиоуыэюя",
    "бвгдзклмнпрстфхцчшщ",
    "АЕИОУЭЮЯ",
    "БВГДЗКЛМНПРСТФХЦЧШЩ",
    "àáâãäåèéêëìíîïòóôõöùúûü",
    "çñýÿ",
    "ÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜ",
    "ÇÑÝŸ",
)
_CLASS = {c: a for a in _ALPHABETS for c in a}
#: Digits that may begin an area or an exchange of a North American number, and the others.
_AREA = ("23456789", "01")
#: Characters that are permuted together.
_PIECE = 64
#: Endings of surnames that tell a gender, the longer first.
_ENDINGS = ("ская", "цкая", "ский", "цкий", "skaya", "ович", "евич", "овна", "евна", "ова", "ева", "ина", "ová", "ova", "eva", "ská", "ska", "sky", "ski", "ов", "ев", "ин", "ov", "ev")


def _kin(c: str) -> str:
    """The unlisted letters of a letter's category among the 16 code points about it."""
    kind, at = unicodedata.category(c), ord(c) & ~15
    return "".join(x for x in map(chr, range(at, at + 16)) if unicodedata.category(x) == kind and x not in _CLASS)


@functools.cache
def _lone() -> dict[str, str]:
    """By category, the letters without kin: they are an alphabet together."""
    out: dict[str, list[str]] = {}
    for c in map(chr, range(0x80, 0x110000)):
        if c.isalpha() and c not in _CLASS and len(_kin(c)) == 1:
            out.setdefault(unicodedata.category(c), []).append(c)
    every = "".join(x for kind in out.values() if len(kind) == 1 for x in kind)
    return {kind: "".join(found) if len(found) > 1 else every for kind, found in out.items()}


@functools.lru_cache(65536)
def _alphabet(c: str) -> str:
    """The alphabet of a character, empty if it stays.  Alphabets part the letters: a member has the same one."""
    if c in _CLASS or not c.isalpha():
        return _CLASS.get(c, "")
    found = _kin(c)
    return found if len(found) > 1 else _lone()[unicodedata.category(c)]


class Permutation:
    """Keyed permutation of 0..size-1 without fixed points."""

    def __init__(self, key: bytes, tag: str, size: int) -> None:
        self.size, self.half = size, max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.seed = hashlib.blake2b(f"{tag}:{size:x}".encode(errors="surrogatepass"), key=key[:64]).digest()[:32]

    def _round(self, i: int, x: int) -> int:
        width = (self.half + 7) // 8
        raw = hashlib.blake2b(x.to_bytes(width, "little"), key=self.seed, salt=bytes([i]), digest_size=min(64, width)).digest()
        while len(raw) < width:
            raw += hashlib.blake2b(raw, key=self.seed).digest()
        return int.from_bytes(raw[:width], "little") & self.mask

    def _walk(self, x: int, order: tuple[int, ...]) -> int:
        while True:
            left, right = x >> self.half, x & self.mask
            for i in order:
                left, right = right, left ^ self._round(i, right)
            x = right << self.half | left
            if x < self.size:
                return x

    def __call__(self, x: int) -> int:
        """Network backwards after a shift of the network: as both are permutations, so is this; a shift has no fixed point."""
        if self.size < 2:
            return x
        there = self._walk(x, (0, 1, 2, 3, 4, 5))
        return self._walk((there + 1) % self.size, (5, 4, 3, 2, 1, 0))


@functools.lru_cache(4096)
def _permutation(key: bytes, tag: str, size: int) -> Permutation:
    return Permutation(key, tag, size)


def _shaped(key: bytes, tag: str, text: str, fixed: frozenset[int] = frozenset(), parted: dict[int, tuple[str, ...]] | None = None) -> str:
    """Permute the characters of known alphabets outside the ``fixed`` places; ``parted`` gives, for some
    places, the classes in which their characters stay."""
    alphabets = {}
    for i, c in enumerate(text):
        if i not in fixed and (alphabet := next((a for a in (parted or {}).get(i, ()) if c in a), None) or _alphabet(c)):
            alphabets[i] = alphabet
    shape = "".join(f"{len(alphabets[i])}{alphabets[i][0]}" if i in alphabets else c for i, c in enumerate(text))
    if len(alphabets) > _PIECE:
        shape = hashlib.blake2b(shape.encode(errors="surrogatepass")).hexdigest()
    places, out = list(alphabets), list(text)
    for at in range(0, len(places), _PIECE):  # a long value is permuted in pieces
        part = places[at : at + _PIECE]
        size, number = 1, 0
        for i in part:
            size, number = size * len(alphabets[i]), number * len(alphabets[i]) + alphabets[i].index(text[i])
        number = _permutation(key, f"{tag}:{at}:{shape}" if at else f"{tag}:{shape}", size)(number)
        for i in reversed(part):
            number, place = divmod(number, len(alphabets[i]))
            out[i] = alphabets[i][place]
    return "".join(out)


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _address_class(x: int) -> tuple[bool, ...]:
    a = ipaddress.IPv4Address(x)
    return a.is_private, a.is_loopback, a.is_multicast, a.is_reserved, x >> 24 == 0


#: The networks of the registry of special addresses, at whose ends a class may end.
_NETWORKS = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.0/29", "192.0.0.8/32", "192.0.0.9/32", "192.0.0.10/32", "192.0.0.170/31", "192.0.2.0/24",
    "192.31.196.0/24", "192.52.193.0/24", "192.88.99.0/24", "192.168.0.0/16", "192.175.48.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "255.255.255.255/32",
)


@functools.cache
def _address_ranges() -> dict[tuple[bool, ...], list[tuple[int, int]]]:
    """The first address and the number of addresses of the ranges of each class."""
    networks = [ipaddress.IPv4Network(n) for n in _NETWORKS]
    ends = sorted({0, 1 << 32, *(int(n.network_address) for n in networks), *(int(n.broadcast_address) + 1 for n in networks)})
    out: dict[tuple[bool, ...], list[tuple[int, int]]] = {}
    for a, b in itertools.pairwise(ends):
        out.setdefault(_address_class(a), []).append((a, b - a))
    return out


def _numbered(ranges: list[tuple[int, int]], x: int) -> int:
    """The number of an address among those of its class."""
    return sum(min(max(x - a, 0), n) for a, n in ranges)


def _address(ranges: list[tuple[int, int]], number: int) -> int:
    for a, n in ranges:
        if number < n:
            return a + number
        number -= n
    raise ValueError("no such address")


def canonical(kind: str, text: str) -> str:
    """What coreferent spellings share."""
    if kind == "email":
        return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if kind == "ip":
        return ".".join(str(int(x)) for x in text.split("."))
    if kind == "ipv6":
        return ipaddress.IPv6Address(text).exploded
    if kind == "phone":
        digits = "".join(text[i] for i in solid(kind, text))
        if "+" in text:
            return "+" + digits
        return "+1" + digits if len(digits) == 10 and digits[0] in _AREA[0] else digits
    if kind == "birth":
        day, _, _ = _date(text)
        return day.isoformat()
    if kind in ("card", "ssn", "iban"):
        return "".join(text[i] for i in solid(kind, text))
    if kind == "person":
        return "".join(c.lower() if len(c.lower()) == 1 else c for c in re.sub(r"\s+", " ", text))
    return re.sub(r"\s+", " ", text)


def _country_digits(value: str) -> int:
    """Length of the country code of ``+digits``: by the numbering plan 1 and 7 stand alone, the listed have two digits, others three."""
    two = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
    return 1 if value[1] in "17" else 2 if value[1:3] in two.split() else 3


def _ending(part: str) -> str:
    return next((e for e in _ENDINGS if len(part) > len(e) + 1 and part.endswith(e)), "")


def _name(key: bytes, part: str) -> str:
    """A name's surrogate wherever it stands in a person's name: listed ones within their list, others within
    the strings of their shape and ending that are not listed."""
    listed = part if part in LIST_OF else part.capitalize()
    if listed in LIST_OF:
        names = NAMES[LIST_OF[listed]]
        new = names[_permutation(key, "name" + "".join(LIST_OF[listed]), len(names))(names.index(listed))]
        return new if part in LIST_OF else new.lower()
    ending, new = _ending(part), part
    stays = frozenset(range(len(part) - len(ending), len(part)))
    while True:
        new = _shaped(key, "surname", new, stays)
        if new not in LIST_OF and new.capitalize() not in LIST_OF and _ending(new) == ending:
            return new


def _person(key: bytes, value: str) -> str:
    out = []
    for part in re.split(r"([ '’-])", value):
        out.append(part if part.lower() in PARTICLES or len(part) < 2 and not part.isalpha() else _name(key, part))
    # An O' or d' before a name is a particle too.
    return "".join(v if i + 1 < len(out) and out[i + 1] in "'’" and len(v) == 1 else w for i, (v, w) in enumerate(zip(re.split(r"([ '’-])", value), out, strict=True)))


@functools.lru_cache(65536)
def _next(key: bytes, kind: str, value: str, fixed: int = 0) -> str:
    """The surrogate of a canonical value; ``fixed`` more leading characters stay."""
    if kind == "email":
        return _shaped(key, kind, value, frozenset(range(value.rindex("."), len(value))))
    if kind == "card":
        body = _shaped(key, kind, value[:-1], frozenset({0}))
        return next(body + c for c in "0123456789" if luhn(body + c))
    if kind == "ip":
        x = int(ipaddress.IPv4Address(value))
        ranges = _address_ranges()[_address_class(x)]
        size = sum(n for _, n in ranges)  # a class of one address has no other
        new = _permutation(key, f"ip:{ranges[0][0]}", size)(_numbered(ranges, x)) if size > 1 else 0
        return str(ipaddress.IPv4Address(_address(ranges, new)))
    if kind == "ipv6":  # the first group and zero groups stay, so that the short form is as long
        groups = [int(g, 16) for g in value.split(":")]
        places = [i for i, g in enumerate(groups) if g and (i or not any(groups[1:]))]
        number = functools.reduce(lambda n, i: n * 65535 + groups[i] - 1, places, 0)
        number = _permutation(key, f"ipv6:{places}", 65535 ** len(places))(number)
        for i in reversed(places):
            number, rest = divmod(number, 65535)
            groups[i] = rest + 1
        return ":".join(f"{g:04x}" for g in groups)
    if kind == "iban":
        body = _shaped(key, kind + value[:2], value[4:].lower()).upper()
        return value[:2] + _iban_check(value[:2], body) + body
    if kind == "phone":
        if value[0] != "+":
            return _shaped(key, kind, value, frozenset({0, 1} if value[0] == "0" else ()))
        stays = max(1 + _country_digits(value), fixed)
        american = len(value) == 12 and value[1] == "1"
        return _shaped(key, kind, value, frozenset(range(stays)), {2: _AREA, 5: _AREA} if american else {stays: ("123456789", "0")})
    if kind == "birth":
        day = datetime.date.fromisoformat(value)
        first = datetime.date(day.year // 10 * 10 or 1, 1, 1)
        days = (datetime.date(day.year // 10 * 10 + 9, 12, 31) - first).days + 1
        return (first + datetime.timedelta(_permutation(key, f"birth:{first}", days)((day - first).days))).isoformat()
    if kind == "ssn":
        sound = lambda v: v[:3] not in ("000", "666") and v[0] != "9" and v[3:5] != "00" and v[5:] != "0000"
        new = value
        while True:
            new = _shaped(key, kind, new)
            if sound(new) == sound(value):
                return new
    if kind == "person":
        return _person(key, value)
    return _shaped(key, kind, value)


def _date(text: str) -> tuple[datetime.date, str, list[str]]:
    """The day of a date's spelling, the order of its parts and their texts.  Of two numbers that may both be
    months the first is the day, but after a year the month comes first."""
    parts = re.findall(r"[0-9]+|[^\W\d_]{3,}", re.sub(r"\b(?:de|of)\b", "", text))
    month = next((i for i, p in enumerate(parts) if not p.isdigit()), None)
    if month is not None:
        order = "dmy" if month == 1 else "mdy"
    else:
        order = "ymd" if len(parts[0]) == 4 else "mdy" if int(parts[1]) > 12 else "dmy"
    of = dict(zip(order, parts, strict=True))
    number = int(of["m"]) if of["m"].isdigit() else 1 + next(i for names in MONTHS for i, n in enumerate(names) if n == of["m"].lower() or len(of["m"]) == 3 and n[:3] == of["m"].lower())
    return datetime.date(int(of["y"]), number, int(of["d"])), order, parts


def _spell_date(spelling: str, value: str) -> str:
    """The day of ``value`` as ``spelling`` writes its own."""
    _, order, parts = _date(spelling)
    new = datetime.date.fromisoformat(value)
    out, at = [], 0
    for kind, part in zip(order, parts, strict=True):
        start = spelling.index(part, at)
        number = {"d": new.day, "m": new.month, "y": new.year}[kind]
        if part.isdigit():
            text = f"{number:04d}" if kind == "y" else f"{number:02d}" if part[0] == "0" or len(part) == 2 else str(number)
        else:
            names = next((names for names in MONTHS if part.lower() in names), MONTHS[0])
            text = names[number - 1] if part.lower() in names else names[number - 1][:3]
            text = text.upper() if part.isupper() else text.capitalize() if part[0].isupper() else text
        out += [spelling[at:start], text]
        at = start + len(part)
    return "".join([*out, spelling[at:]])


def _spell_name(spelling: str, surrogate: str) -> str:
    """A lower-case surrogate with the capitals, and the white space, of the name it replaces."""
    cut = r"(\s+|['’-])"
    old, new = re.split(cut, spelling), re.split(cut, surrogate)
    out = []
    for i, part in enumerate(new):
        like = old[i] if i < len(old) else ""
        letters = [c for c in like if c.lower() != c.upper()]
        if i % 2:
            out.append(like or part)
        elif len(letters) > 1 and all(c == c.upper() for c in letters):
            out.append("".join(c.upper() if len(c.upper()) == 1 else c for c in part))
        elif len(like) == len(part):
            out.append("".join(b.upper() if a != a.lower() and len(b.upper()) == 1 else b for a, b in zip(like, part, strict=True)))
        else:
            out.append(part.capitalize() if letters and letters[0] != letters[0].lower() else part)
    return "".join(out)


def _spell(kind: str, spelling: str, surrogate: str) -> str:
    """The surrogate in the format of the text it replaces."""
    if kind == "email":
        return "".join(s.upper() if c.isupper() and len(s.upper()) == 1 else s for c, s in zip(spelling, surrogate, strict=True))
    if kind == "birth":
        return _spell_date(spelling, surrogate)
    if kind == "ipv6":
        short = surrogate if len(spelling) == 39 else str(ipaddress.IPv6Address(surrogate))
        return short.upper() if any(c.isupper() for c in spelling) else short
    if kind == "person":
        return _spell_name(spelling, surrogate)
    if kind in ("card", "ssn", "phone", "iban"):
        places, out = solid(kind, spelling), list(spelling)
        for i, c in zip(places, surrogate[len(surrogate) - len(places) :], strict=True):
            out[i] = c
        return "".join(out)
    return surrogate


def _mark(key: bytes, kind: str, value: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(errors="surrogatepass"), key=key[:64], digest_size=8).digest(), "little", signed=True)


def surrogates(text: str, key: bytes) -> tuple[str, list[dict]]:
    spans = find(text)
    if not spans:
        return text, []
    out, rows, at = [], [], 0
    for start, end, kind in spans:
        spelling = text[start:end]
        value = canonical(kind, spelling)
        replaced = _next(key, kind, value)
        new = _spell(kind, spelling, replaced)
        out += [text[at:start], new]
        rows.append({"kind": kind, "start": start, "end": end, "surrogate": new, "entity": _mark(key, kind, value), "replaced": _mark(key, kind, replaced)})
        at = end
    return "".join([*out, text[at:]]), rows


_FIELDS = {"kind": pa.string(), "start": pa.int64(), "end": pa.int64(), "surrogate": pa.string(), "entity": pa.int64(), "replaced": pa.int64()}
_ENTITIES = pa.list_(pa.struct(list(_FIELDS.items())))


def _redact(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [], []
            for text in batch.column(1).to_pylist():
                new, rows = surrogates(text, key) if text else (text, [])
                texts.append(new)
                found.append(rows)
            counts = pa.array([len(x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), counts, pa.array(found, _ENTITIES)], names=["doc_id", "text", "n_entities", "entities"])

    return run


def redact(docs: DataFrame, key: bytes) -> DataFrame:
    """Rows ``(doc_id, text, n_entities, entities)``: the texts with surrogates, and each entity's kind, span
    in the old text (code points, end exclusive), surrogate, and keyed marks of the value and of what replaced
    it: entities of equal marks are the same value in other spellings or documents.  ``key`` decides the surrogates."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    entity = "struct<kind:string,start:long,end:long,surrogate:string,entity:long,replaced:long>"
    return base.mapInArrow(_redact(key), f"doc_id long, text string, n_entities long, entities array<{entity}>")


def collisions(redacted: DataFrame) -> DataFrame:
    """Rows ``(kind, mark, values)`` for every surrogate of ``redacted`` that stands for more than one value, and
    every value with more than one surrogate: none, unless marks of 64 bits collide."""
    found = redacted.select(F.explode("entities").alias("e")).select("e.kind", "e.entity", "e.replaced").distinct()
    sides = [found.groupBy("kind", F.col(side).alias("mark")).agg(F.count("*").alias("values")).where(F.col("values") > 1) for side in ("replaced", "entity")]
    return sides[0].unionByName(sides[1])


def redact_column(docs: DataFrame, key: bytes, column: str = "text") -> DataFrame:
    """``docs`` with surrogates in one string column and all other columns as they are."""
    names = docs.columns
    where = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([surrogates(t, key)[0] if t else t for t in batch.column(where).to_pylist()], batch.schema.field(where).type)
            yield batch.set_column(where, batch.schema.field(where), texts)

    return docs.mapInArrow(run, docs.schema)
