"""Where personal data stands in a text.

Candidates come from one pass per family of patterns; what has a checksum, a range or a
calendar is checked.  No pattern tries a place more often than a bounded number of times, so
the cost of a text is linear in its length.
"""

from __future__ import annotations

import calendar
import ipaddress
import itertools
import re

#: First names by (script, gender); a surrogate stays in its list.
NAMES: dict[tuple[str, str], tuple[str, ...]] = {
    ("latin", "f"): (
        "Alice", "Amelia", "Anna", "Barbara", "Carmen", "Catherine", "Charlotte", "Claire", "Elena", "Elizabeth", "Emily", "Emma",
        "Eva", "Hannah", "Helen", "Ingrid", "Isabel", "Jane", "Jennifer", "Jessica", "Julia", "Karen", "Laura", "Linda",
        "Lucia", "Margaret", "Maria", "Marie", "Mary", "Monica", "Nancy", "Natalie", "Nina", "Olivia", "Patricia", "Priya",
        "Rachel", "Rebecca", "Ruth", "Sandra", "Sarah", "Sofia", "Sophie", "Susan", "Teresa", "Ursula", "Victoria", "Yolanda",
    ),
    ("latin", "m"): (
        "Adam", "Ahmed", "Alexander", "Andrew", "Antonio", "Arthur", "Benjamin", "Carlos", "Charles", "Christopher", "Daniel", "David",
        "Edward", "Eric", "Francisco", "Frank", "George", "Hans", "Henri", "Jack", "James", "John", "Jose", "Joseph",
        "Karl", "Kevin", "Louis", "Manuel", "Mark", "Martin", "Matthew", "Michael", "Miguel", "Mohammed", "Oliver", "Patrick",
        "Paul", "Peter", "Pierre", "Rafael", "Richard", "Robert", "Samuel", "Stefan", "Steven", "Thomas", "Walter", "William",
    ),
    ("cyrillic", "f"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Татьяна"),
    ("cyrillic", "m"): ("Алексей", "Андрей", "Борис", "Виктор", "Дмитрий", "Иван", "Михаил", "Сергей"),
}
LIST_OF = {name: key for key, names in NAMES.items() for name in names}
MONTHS = (
    ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"),
    ("januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"),
    ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
)
PARTICLES = frozenset({"van", "von", "der", "den", "de", "del", "della", "di", "da", "la", "le", "du", "dos", "bin", "ibn", "al", "el", "y", "zu"})
KINDS = ("email", "iban", "card", "ip", "ipv6", "ssn", "phone", "birth", "document", "person")

_WIDE = "⺀-퟿＀-￯"  # scripts written without spaces
_LOCAL = re.compile(rf"(?<![.+%-])(?<![^\W{_WIDE}])[^\W{_WIDE}](?:[^\W{_WIDE}]|[.%+-])*\Z")
_DOMAIN = re.compile(rf"(?:(?:[^\W_{_WIDE}]|-)+\.)+(?:xn--[A-Za-z0-9-]+|[^\W\d_{_WIDE}]{{2,}})")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_CARD = r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]|\.[0-9])"
_IP = r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])"
_SSN = r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
_FOREIGN = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,5}"
_AMERICAN = r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"
_NATIONAL = r"0[1-9](?:[ .-][0-9]{2}){4}|0[1-9][0-9]{8}|0[1-9][0-9]{0,3} [0-9]{3,4} [0-9]{4}|0[1-9][0-9]{1,3}[ /-][0-9]{5,8}|[2-9][0-9]{9}"
_PHONE = rf"(?<![\w+])(?:{_FOREIGN}|{_AMERICAN}|(?<![0-9]\.)(?:{_NATIONAL})(?!\.[0-9]))(?![\w])"
_NUMERIC = re.compile(f"(?P<card>{_CARD})|(?P<ip>{_IP})|(?P<ssn>{_SSN})|(?P<phone>{_PHONE})")
_IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
_MONTH = "|".join(sorted({m for names in MONTHS for m in names} | {m[:3] for m in MONTHS[0]}, key=len, reverse=True))
_DAY = rf"(?:[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}|[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{4}}|[0-9]{{1,2}}\.? (?:de )?(?:{_MONTH})\.?,? (?:de )?[0-9]{{4}}|(?:{_MONTH})\.? [0-9]{{1,2}},? [0-9]{{4}})"
_BIRTH = re.compile(rf"\b(?:born(?: on)?|date of birth|birth ?date|dob|d\.o\.b\.|geboren(?: am)?|geburtsdatum|née?(?: le)?|nacid[oa](?: el)?|fecha de nacimiento|date de naissance)\s?[:=]?\s?({_DAY})(?![\w])", re.I)
_DOCUMENT = re.compile(
    r"\b(?i:passport|passeport|reisepass|pasaporte|identity card|id card|national id|driver'?s licen[cs]e|driving licen[cs]e|personalausweis)"
    r"(?i:[ -]?(?:no|nr|number|num|nummer|n°|#)\b)?\.?\s?[:#=]?\s?#?([A-Z0-9]{6,12})(?!\w)"
)

_LOWER = "a-z" + "".join(c for c in map(chr, range(0x80, 0x590)) if c.islower())
_UP = rf"[^\W\d_{_LOWER}]"
_WORD = rf"{_UP}(?:[^\W\d_]+(?:['’-]{_UP}[^\W\d_]+)*|['’]{_UP}[^\W\d_]+|[^\W\d_]*-{_UP}[^\W\d_]+)"
_LINK = r"(?:(?:van|von|der|den|de|del|della|di|da|la|le|du|dos|bin|ibn|al|el|zu) ){0,2}"
_TITLE = r"(?:Mrs?|Ms|Miss|Dr|Prof|Sir|Madam|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señora?|Sra?|Doña|Don)\.?"
_TITLED = re.compile(rf"\b{_TITLE} (?!{_TITLE} )({_LINK}{_WORD}(?: (?:{_UP}\. )?{_LINK}{_WORD})?)")
_RUN = re.compile(rf"(?<![\w'’-]){_WORD}(?: (?:{_UP}\. )?{_LINK}{_WORD})+")
_PIECE = re.compile(_WORD)
_SOLE = re.compile(rf"(?<![\w'’-]){_UP}[^\W\d_]+(?![\w-]|['’]{_UP})")
_TITLES = re.compile(_TITLE)
#: Words that a letter's name follows.
_GREETED = re.compile(rf"\b(?:Dear|Hello|Hi|Cher|Chère|Liebe|Lieber|Hallo|Estimado|Estimada|Querido|Querida|Bonjour|Hola) (?!{_TITLE} )({_WORD}(?: {_LINK}{_WORD})?)(?=\s*[,!:])")
_INSIDE = re.compile(r"[^\W\d_] \Z|, \Z")
#: Words after which, and before which, a run of capitalised words is a person.
_BEFORE = re.compile(
    r"(?:\b(?:[Mm]y name is|I am|I['’]m|[Nn]amed|[Cc]ontact|[Aa]ttn:?|[Dd]ear|[Rr]egards,|[Ss]incerely,|[Ss]igned(?: by)?|(?:spoke|talked|spoken) (?:to|with)|[Mm]et(?: with)?"
    r"|[Cc]alled|[Ee]mailed|[Ww]rote to|[Tt]old|[Aa]sked|[Pp]atient:?|[Aa]uthor:?|[Cc]lient:?|[Ee]mployee:?|[Nn]ame(?: is)?:|[Ii]ch heiße|[Jj]e m['’]appelle|[Mm]e llamo)\s)\Z"
)
_AFTER = re.compile(r"\s(?:said|says|wrote|told|asked|replied|spoke|lives|lived|works|worked|was born|met|called|emailed)\b")
_AND = re.compile(r"\s?(?:,|,? (?:and|und|et|y|&))\s\Z")


def luhn(digits: str) -> bool:
    numbers = [int(c) for c in digits]
    return (sum(numbers[::-2]) + sum([_DOUBLED[d] for d in numbers[-2::-2]])) % 10 == 0


def solid(kind: str, text: str) -> list[int]:
    """Places of the characters of a value in its spelling; a trunk zero in brackets is none of them."""
    if kind == "iban":
        return [i for i, c in enumerate(text) if c.isalnum()]
    trunk = text.find("(0)") + 1 if kind == "phone" and "+" in text else 0
    return [i for i, c in enumerate(text) if c.isdecimal() and c.isascii() and (not trunk or i != trunk)]


def valid(kind: str, text: str) -> bool:
    if kind == "card":
        return luhn(re.sub(r"[^0-9]", "", text))
    if kind == "ip":
        return all(int(x) < 256 for x in text.split("."))
    if kind == "ipv6":
        try:
            ipaddress.IPv6Address(text)
        except ValueError:
            return False
        groups = [g for g in text.split(":") if g]
        return len(groups) > 1 and any(c.isdigit() for c in text)
    if kind == "iban":
        plain = text.replace(" ", "")
        return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    if kind == "phone":
        return 8 <= len(solid(kind, text)) <= 15
    if kind == "birth":
        return _is_day(text)
    if kind == "document":
        return sum(c.isdigit() for c in text) >= 3
    return True


def _is_day(text: str) -> bool:
    numbers = [int(x) for x in re.findall("[0-9]+", text)]
    year = next(x for x in numbers if x > 31) if any(x > 31 for x in numbers) else 0
    if not 1000 <= year:
        return False
    numbers.remove(year)
    if len(numbers) == 1:
        name = next(n.lower() for n in re.findall(r"[^\W\d_]{3,}", text))
        month = next((1 + i for names in MONTHS for i, n in enumerate(names) if name == n or len(name) == 3 and n[:3] == name), 0)
        return 0 < month and 1 <= numbers[0] <= calendar.monthrange(year, month)[1]
    first, second = numbers
    month, day = (first, second) if re.match("[0-9]{4}", text) or second > 12 else (second, first)
    return 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]


#: The sum of the digits of twice a digit.
_DOUBLED = tuple(sum(divmod(2 * d, 10)) for d in range(10))


def _card_within(run: str, start: int) -> list[tuple[int, int, str]]:
    """The longest run of digit groups with a valid check digit in a longer run; the leftmost of equals."""
    places = [i for i, c in enumerate(run) if c.isdigit()]
    digits = [int(run[i]) for i in places]
    doubled = [_DOUBLED[d] for d in digits]
    mixed = [list(digits), list(doubled)]  # the digits of even, and of odd, places plain
    mixed[0][1::2], mixed[1][1::2] = doubled[1::2], digits[1::2]
    sums = [list(itertools.accumulate(m, initial=0)) for m in mixed]  # running check sums
    edge = [k for k, i in enumerate(places) if not k or places[k - 1] != i - 1] + [len(places)]
    tries = [(b - a, -a) for n, a in enumerate(edge) for b in edge[n + 1 :] if 13 <= b - a and (sums[(b - 1) % 2][b] - sums[(b - 1) % 2][a]) % 10 == 0]
    if not tries:
        return []
    length, first = max(tries)
    return [(start + places[-first], start + places[length - first - 1] + 1, "card")]


def _emails(text: str) -> list[tuple[int, int, str]]:
    """Addresses about each @, with hosts of at most 253 characters; each search ends at the @ before."""
    found, past, at = [], 0, text.find("@")
    while at >= 0:
        if host := _DOMAIN.match(text, at + 1, at + 254):
            if name := _LOCAL.search(text, max(past, at - 64), at) or _LOCAL.search(text, past, at):
                found.append((name.start(), host.end(), "email"))
        past, at = at + 1, text.find("@", at + 1)
    return found


def _numbers(text: str) -> list[tuple[int, int, str]]:
    found, at = [], 0
    while m := _NUMERIC.search(text, at):
        at = m.end()
        if valid(m.lastgroup, m[0]):
            found.append((m.start(), at, m.lastgroup))
        elif m.lastgroup == "card":  # what is no card may hold one, and other kinds beside it
            within = _card_within(m[0], m.start())
            found += within
            at = within[0][1] if within else m.start() + len(re.match("[0-9]+", m[0])[0])
    return found


def _listed(word: str) -> bool:
    return word in LIST_OF or word.isupper() and word.capitalize() in LIST_OF


def _persons(text: str, other: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Names, and single parts of them wherever the text has them again; ``other`` are the spans of other entities."""
    sure = [m.span(1) for m in _TITLED.finditer(text)] + [m.span(1) for m in _GREETED.finditer(text)]
    likely: list[tuple[int, int]] = []
    for m in _RUN.finditer(text):
        start, end = m.span()
        words = [w.span() for w in _PIECE.finditer(text, start, end)]
        while words and _TITLES.fullmatch(text, *words[0]):
            words.pop(0)
        if not words:
            continue
        start = words[0][0]
        told = next((i for i, (a, b) in enumerate(words[:-1]) if _listed(text[a:b])), None)
        if told is not None:
            last = len(words) if len(words) - told <= 3 else told + 2
            sure.append((words[told][0], words[last - 1][1]))
        elif len(words) in (2, 3, 4) and (_BEFORE.search(text, max(0, start - 24), start) or _AFTER.match(text, end)):
            likely.append((start, end))
        elif len(words) in (2, 3, 4) and any(b <= start and start - b <= 6 and _AND.search(text, b, start) for _, b in sure[-1:] + likely[-2:]):
            likely.append((start, end))
    alone = [m for m in _SOLE.finditer(text) if _listed(m[0])]
    if not sure and not likely and not alone:
        return []
    plain, at = [], 0  # what other entities hold is no ordinary word
    for a, b, _ in sorted(other):
        plain.append(text[at:a])
        at = max(at, b)
    ordinary = set(re.findall(r"[^\W\d_]+", " ".join([*plain, text[at:]])))
    sure += [m.span() for m in alone if m[0].lower() not in ordinary]
    split = lambda spans: {p.lower() for a, b in spans for p in re.split(r"[ '’.-]+", text[a:b]) if len(p) > 2 and p.lower() not in PARTICLES}
    parts, perhaps = split(sure), split(likely)
    found = sure + likely
    for m in _SOLE.finditer(text):
        low = m[0].lower()
        # A part of a name that is only likely, and an ordinary word too, is told by its capital inside a sentence.
        if low in parts or low in perhaps and (low not in ordinary or _INSIDE.search(text, max(0, m.start() - 2), m.start())):
            found.append(m.span())
    for part in parts | perhaps:
        if re.fullmatch(f"[{_WIDE}]+", part):
            found += [m.span() for m in re.finditer(part, text)]
    return [(a, b, "person") for a, b in found]


def find(text: str) -> list[tuple[int, int, str]]:
    """Spans of the entities of a text, leftmost first, without overlaps."""
    found = _emails(text) + _numbers(text)
    found += [(m.start(), m.end(), "iban") for m in _IBAN.finditer(text) if valid("iban", m[0])]
    if "::" in text or text.count(":") > 6:
        found += [(m.start(), m.end(), "ipv6") for m in _IPV6.finditer(text) if valid("ipv6", m[0])]
    found += [(*m.span(1), "birth") for m in _BIRTH.finditer(text) if valid("birth", m[1])]
    found += [(*m.span(1), "document") for m in _DOCUMENT.finditer(text) if valid("document", m[1])]
    found += _persons(text, found)
    out: list[tuple[int, int, str]] = []
    for span in sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), -x[1])):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out
