"""The parts of a written postal address: unit, number, street, postal code, and the words left over for town and region."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

# Fixed values, each with its spellings: usual street words before and behind a name, directions, and those sought where a value
# has no usual one - before a name, behind a name, at a word's end; then unit, number and area words.
STREET_BEFORE = {"jalan": "jalan jln jl j", "lorong": "lorong lrg lor", "persiaran": "persiaran psrn psn"}
STREET_BEHIND = {"avenue": "avenue ave av", "boulevard": "boulevard blvd", "lane": "lane ln", "road": "road rd", "street": "street str st", "drive": "drive dr"}
DIRECTIONS = {"n": "north n", "s": "south s", "e": "east e", "w": "west w"}
OTHER_BEFORE = {
    "lebuh": "lebuh lbh", "lebuhraya": "lebuhraya", "lintang": "lintang ltg", "solok": "solok", "medan": "medan", "changkat": "changkat", "rue": "rue", "place": "place pl", "chemin": "chemin ch",
    "impasse": "impasse", "quai": "quai", "calle": "calle c", "avenida": "avenida avda", "plaza": "plaza pza", "paseo": "paseo", "via": "via", "viale": "viale",
}
OTHER_BEHIND = {
    "court": "court ct", "way": "way wy", "place": "place pl", "square": "square sq", "terrace": "terrace ter", "close": "close", "crescent": "crescent cres cr", "highway": "highway hwy", "parkway": "parkway pkwy",
    "circle": "circle cir", "trail": "trail trl", "alley": "alley aly", "grove": "grove grv", "row": "row", "walk": "walk", "gardens": "gardens gdns", "weg": "weg", "platz": "platz", "gasse": "gasse",
}
ENDINGS = {"strasse": "strasse str", "weg": "weg", "platz": "platz pl", "gasse": "gasse", "allee": "allee"}
UNIT_WORDS = frozenset("unit u suite ste apt".split())
NUMBER_WORDS = frozenset("no lot".split())
AREA_WORDS = frozenset("taman tmn bandar bdr".split())
#: Characters taken for one another by OCR: as digits, and as letters.
AS_DIGITS = str.maketrans("oqilzsb", "0011258")
AS_LETTERS = str.maketrans("012589!|", "olzsbgll")

_BEFORE = {w: k for k, v in STREET_BEFORE.items() for w in v.split()}
_BEHIND = {w: k for k, v in STREET_BEHIND.items() for w in v.split()}
_OTHER_BEFORE = {w: k for k, v in OTHER_BEFORE.items() for w in v.split()}
_OTHER_BEHIND = {w: k for k, v in OTHER_BEHIND.items() for w in v.split()}
_ENDING = re.compile(r"(\w{3,}?)(%s)" % "|".join(w for v in ENDINGS.values() for w in v.split()))
_ENDINGS = {w: k for k, v in ENDINGS.items() for w in v.split()}
_DIRECTION = {w: k for k, v in DIRECTIONS.items() for w in v.split()}
_TOKEN = re.compile(r"[#]|[&]|[,;]|[^\W_]+(?:[-/!|'][^\W_]+)*|[!|]", re.UNICODE)
_NUMBER = re.compile(r"(\d{1,4})-?([a-z]?)")


class Address(NamedTuple):
    lot: bool
    number: str
    unit: str
    kind: str
    street: str
    more: list[str]
    whole: bool
    street_no: str
    direction: str
    code: str
    rest: list[str]
    near_code: list[str]


def one_edit(a: str, b: str) -> bool:
    """At most one letter inserted, left out, replaced or exchanged with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :]


def _digits(token: str) -> str | None:
    """The token as digits if it is a number, with at least one real digit, misread letters repaired."""
    if not any(c.isdigit() for c in token):
        return None
    folded = token.translate(AS_DIGITS)
    return folded if folded.isdigit() else None


def _letters(token: str) -> str:
    return token.translate(AS_LETTERS) if sum(c.isalpha() for c in token) > sum(c.isdigit() for c in token) else token


def _word(token: str, known: dict[str, str]) -> str | None:
    """The street word a token stands for; long words also with one edit."""
    token = _letters(token)
    if token in known:
        return known[token]
    return next((k for w, k in known.items() if len(w) >= 5 and len(token) >= 5 and one_edit(w, token)), None)


def _pair(tokens: list[str], a: tuple, b: tuple) -> bool:
    """Whether two numbers are the two of one building: joined by '&' or 'and', or by a comma where the second is the next on its side of the street."""
    between = tokens[a[0] + 1 : b[0]]
    if any(t in ("&", "and") for t in between):
        return all(t in ("&", "and", "no", "lot", "#", ",") for t in between)
    return between == [","] and a[1].isdigit() and b[1].isdigit() and int(b[1]) == int(a[1]) + 2


#: A value with so many marks sets its parts apart by them.
MARKS = 2


def _is_name(token: str) -> bool:
    """Whether a token may be a word of a street's name."""
    return len(token) > 1 and token[0].isalnum() and _digits(token) is None and not any(c.isdigit() for c in token[:1]) and token not in AREA_WORDS and token not in UNIT_WORDS and token not in NUMBER_WORDS and token != "and"


def _run(tokens: list[str], taken: list[bool], i: int, step: int) -> list[str]:
    """The words of a name from token i on, in the direction of `step`."""
    out = []
    while 0 <= i < len(tokens) and not taken[i] and _is_name(tokens[i]):
        out.append(_letters(tokens[i]))
        i += step
    return out


def _street(tokens: list[str], taken: list[bool]) -> tuple[str, str, list[str], bool, str, str] | None:
    """(kind, nearest word of the name, further words, whether all are the name's, number of the street, direction); marks the tokens it is sure of as taken."""
    n = len(tokens)
    marked = sum(t in ",;" for t in tokens) >= MARKS
    for before, behind in ((_BEFORE, _BEHIND), (_OTHER_BEFORE, _OTHER_BEHIND)):
        for i, t in enumerate(tokens[:-1]):
            if taken[i] or t in ",;" or taken[i + 1] or len(tokens[i + 1]) < 2 or not _is_name(tokens[i + 1]) or not (k := _word(t, before)):
                continue
            if before is _BEFORE and len(tokens[i + 1]) < 3:
                continue
            name = _run(tokens, taken, i + 1, 1)
            taken[i] = taken[i + 1] = True
            at = i + 1 + len(name)  # a number behind the name is the street's
            if at < n and not taken[at] and (((d := _digits(tokens[at])) and len(d) <= 2) or tokens[at] in ("l", "i")):
                if len(name) == 1 or (before is _BEFORE and tokens[at - 1] not in NUMBER_WORDS):
                    taken[at] = True
                    return k, name[0], name[1:], True, d or "1", ""
            return k, name[0], name[1:], marked or len(name) == 1, "", ""
        for i, t in enumerate(tokens):
            if not i or taken[i] or taken[i - 1] or len(tokens[i - 1]) < 3 or not _is_name(tokens[i - 1]) or not (k := _word(t, behind)):
                continue
            name = _run(tokens, taken, i - 1, -1)
            taken[i] = taken[i - 1] = True
            direction, first = "", i - len(name) - 1
            numbered = first >= 0 and not taken[first] and (tokens[first] in _DIRECTION or any(c.isdigit() for c in tokens[first]))
            for j in range(i - 2, i - 1 - len(name) - 1, -1):  # a direction opens the name
                if j >= 0 and not taken[j] and tokens[j] in _DIRECTION:
                    direction, taken[j] = _DIRECTION[tokens[j]], True
                    name = name[: i - 1 - j]
                    break
            return k, name[0], name[1:], marked or numbered or bool(direction) or len(name) == 1, "", direction
    for i, t in enumerate(tokens):
        if not taken[i] and (m := _ENDING.fullmatch(t)) and any(any(c.isdigit() for c in x) for x in tokens):
            taken[i] = True
            return _ENDINGS[m.group(2)], m.group(1), [], True, "", ""
    # no street word: the words behind a number within its own part of the value, if a mark sets them apart
    for i, t in enumerate(tokens[:-1]):
        if not taken[i] and any(c.isdigit() for c in t) and (name := _run(tokens, taken, i + 1, 1)):
            end = i + 1 + len(name)
            if end < n and tokens[end] in ",;":
                taken[i + 1 : end] = [True] * len(name)
                return "", " ".join(name), [], True, "", ""
    return None


def parse(value: str | None) -> Address | None:
    """None unless the value has a street and a number: a town alone, or no address at all, denotes no location.

    `street` is the word of the street's name next to its street word, `more` the words that follow it before the next
    mark or number: further words of the name, or an area and a town written without a comma. Where the value has MARKS
    marks or the building's number is on the other side of them, all belong to the name (`whole`); else the records tell.
    """
    if not value:
        return None
    text = unicodedata.normalize("NFKC", value).lower().replace("ß", "ss")
    tokens = _TOKEN.findall(text.replace(".", " ").replace(":", " "))
    tokens = [t for t in tokens if t]
    n = len(tokens)
    taken = [False] * n
    # postal code: a word of five digits
    code, code_at = "", -1
    for i, t in enumerate(tokens):
        d = _digits(t)
        if d and len(d) == 5 and len(t) == 5 and sum(c.isdigit() for c in t) >= 2 and not (i and tokens[i - 1] in ("bill", "tel")):
            code, code_at, taken[i] = d, i, True
    street = _street(tokens, taken)
    if street is None:
        return None
    kind, name, more, whole_name, street_no, direction = street
    # unit: after its word, or a number with a hyphen between numbers
    unit = ""
    for i, t in enumerate(tokens):
        if taken[i]:
            continue
        j = i + 1
        if (t in UNIT_WORDS or (len(t) > 4 and _word(t, {"suite": "unit"}))) and j < n:
            if tokens[j] == "no" and j + 1 < n:
                j += 1
            if tokens[j] == "#" and j + 1 < n:
                j += 1
            u = tokens[j].translate(AS_DIGITS)
            if re.fullmatch(r"\d+(-\d+)?[a-z]?", u):
                unit = u
                for x in range(i, j + 1):
                    taken[x] = True
                break
    if not unit:
        for i, t in enumerate(tokens):
            m = re.fullmatch(r"(\d[0-9oilzsb]*)-([0-9oilzsb]*\d)", t)
            if taken[i] or not m:
                continue
            low, high = (x.translate(AS_DIGITS) for x in m.groups())
            if (i and tokens[i - 1] == "#") or int(high) != int(low) + 2:  # two buildings of one side of a street are no unit
                unit, taken[i] = f"{low}-{high}", True
                if i and tokens[i - 1] == "#":
                    taken[i - 1] = True
                break
    # numbers left: after a number word or '#', or bare; those before the street or next to it
    found: list[tuple[int, str, bool]] = []
    i = 0
    while i < n:
        t = tokens[i]
        if not taken[i] and t not in ",;#&" and any(c.isdigit() for c in t) and i != code_at:
            whole = re.fullmatch(r"([0-9oqilzsb]{1,4})-?([a-z]?)", t)
            pair = re.fullmatch(r"(\d[0-9oilzsb]*)-([0-9oilzsb]*\d)", t)
            if pair:
                a, b = (x.translate(AS_DIGITS).lstrip("0") for x in pair.groups())
                taken[i] = True
                found.append((i, f"{a}&{b}", i > 0 and tokens[i - 1] == "#"))
                i += 1
                continue
            digits, letter = (_digits(t), "") if _digits(t) else (None, "")
            if digits is None and whole:
                m = _NUMBER.fullmatch(t) or re.fullmatch(r"(\d[0-9oilzsb]{0,3})-?([a-z])", t)
                if m:
                    digits, letter = m.group(1).translate(AS_DIGITS), m.group(2)
            elif digits and _NUMBER.fullmatch(t) and t[-1].isalpha() and t[:-1].isdigit():
                digits, letter = t[:-1], t[-1]  # a letter behind digits is the building's
            if digits and len(digits) <= 4:
                taken[i] = True
                if not letter and i + 1 < n and len(tokens[i + 1]) == 1 and tokens[i + 1].isalpha() and not taken[i + 1] and tokens[i + 1] not in _DIRECTION and tokens[i + 1] not in ("j", "u"):
                    letter, taken[i + 1] = tokens[i + 1], True
                elif not letter and i + 2 < n and len(tokens[i + 1]) == 1 and tokens[i + 1] in _DIRECTION and not taken[i + 1] and tokens[i + 2] in ",;":
                    letter, taken[i + 1] = tokens[i + 1], True
                found.append((i, digits.lstrip("0") + letter, i > 0 and tokens[i - 1] == "#"))
        i += 1
    if not found:
        return None
    number = ""
    if not unit and len(found) > 1:
        # '#731, street, 147': of two separate numbers the one behind '#' is the unit
        marked = [f for f in found if f[2]]
        if len(marked) == 1 and not any(_pair(tokens, *sorted((f, marked[0]))) for f in found if f is not marked[0]):
            unit = marked[0][1]
            found.remove(marked[0])
    first = found[0]
    number = first[1]
    if len(found) > 1:
        second = found[1]
        if _pair(tokens, first, second):
            number = f"{first[1]}&{second[1]}"
    rest = [_letters(t) for i, t in enumerate(tokens) if not taken[i] and t not in ",;&#" and t not in NUMBER_WORDS and t != "and" and len(t) > 1]
    near = [_letters(tokens[j]) for j in (code_at - 1, code_at - 2, code_at + 1, code_at + 2) if code_at >= 0 and 0 <= j < n and not taken[j] and tokens[j].isalpha() and len(tokens[j]) > 2]
    lot = "lot" in (tokens[max(0, first[0] - 1)], tokens[max(0, first[0] - 2)]) if first[0] else False
    return Address(lot, number, unit, kind, name, more, whole_name, street_no, direction, code, rest, near)
