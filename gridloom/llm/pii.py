"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A value that passes its kind's validation (Luhn, mod 97, calendar, octets, numbering rules) is read as a
number in mixed radix, one digit for each place that may vary, and permuted by a keyed
Feistel network over exactly that range; values that would fall outside walk on along the cycle.
So a pseudonym has its value's format and validity, and equal values have equal pseudonyms
in every document, with no table to share.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import math
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame

from gridloom.llm.common import kept, with_text

ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Dates that are taken for dates of a life.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

#: Whole runs of the characters that numbers are written in; the patterns below look closer, and this far beyond a run.
NEAR, BEYOND = re.compile(r"[0-9 ().\-/+]{7,}+"), 4
NUMBER = re.compile(
    r"(?<![\w.])(?P<ip>(?:\d{1,3}\.){3}\d{1,3})(?![\w]|\.\d)"
    r"|(?<![\w.\-/])(?P<ymd>(?P<y1>\d{4})(?P<s1>[-/.])(?P<m1>\d{1,2})(?P=s1)(?P<d1>\d{1,2}))(?!(?!T\d\d)\w|[\-/])"
    r"|(?<![\w.\-/])(?P<dmy>(?P<d2>\d{1,2})(?P<s2>[-/.])(?P<m2>\d{1,2})(?P=s2)(?P<y2>\d{4}))(?!(?!T\d\d)\w|[\-/])"
    r"|(?<![\w\-])(?P<ssn>(?P<area>\d{3})-(?P<group>\d{2})-(?P<serial>\d{4}))(?![\w\-])"
    r"|(?<!\w)(?P<card>\d(?:[ -]?\d){12,18})(?!\w)"
    r"|(?<!\w)(?P<phone>(?P<country>\+\d{1,3}[ .-]?)?(?P<rest>\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|(?:(?<!\d\d\d[ \-])|(?<=\+\d\d\d[ \-]))\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4}(?![ \-]\d{3})|(?<=\+)\d{8,14}))(?!\w)"
    r"|(?<!\w)(?P<e164>\+\d{8,15})(?!\w)"
)
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
CARD = re.compile(r"(?<!\w)\d(?:[ -]?\d){12,18}(?!\w)")
#: Characters of an IBAN by country.
IBAN_LENGTH = dict(re.findall(
    r"([A-Z]{2})(\d\d)",
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 "
    "KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20",
))
LOCAL = re.compile(r"[A-Za-z0-9._%+\-]{1,64}$")
DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}")


def permuted(x: int, size: int, key: bytes, kind: str) -> int:
    """A keyed permutation of range(size): alternating Feistel over two halves, walking on while outside."""
    if size < 2:
        return x
    right = math.isqrt(size - 1) + 1
    left = -(-size // right)

    def f(turn: int, half: int, modulus: int) -> int:
        said = f"{kind}|{size}|{turn}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(said, key=key, digest_size=16 + modulus.bit_length() // 8).digest(), "big") % modulus

    while True:
        a, b = divmod(x, right)
        for turn in range(ROUNDS):
            if turn % 2:
                b = (b + f(turn, a, right)) % right
            else:
                a = (a + f(turn, b, left)) % left
        x = a * right + b
        if x < size:
            return x


def in_format(value: str, key: bytes, kind: str, alphabets: list[str] | None = None) -> str:
    """Permute a string's letters and digits, each within its own alphabet; other characters stay."""
    alphabets = alphabets or [next((a for a in (DIGITS, LOWER, UPPER) if c in a), "") for c in value]
    x, size = 0, 1
    for c, a in zip(value, alphabets, strict=True):
        if a:
            x, size = x * len(a) + a.index(c), size * len(a)
    x, out = permuted(x, size, key, kind), []
    for c, a in zip(reversed(value), reversed(alphabets), strict=True):
        if a:
            x, r = divmod(x, len(a))
            c = a[r]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The sum that is 0 for a valid number."""
    twice = [int(c) for c in reversed(digits)]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(twice)) % 10


def mod_97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def like(shape: str, chars: str) -> str:
    """``chars`` in the places that letters and digits have in ``shape``."""
    new = iter(chars)
    return "".join(next(new) if c.isalnum() else c for c in shape)


def card(value: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", value)
    if luhn(digits) or len(set(digits)) == 1:
        return None
    body = in_format(digits[:-1], key, "card")
    return like(value, body + str(-luhn(body + "0") % 10))


#: Calling codes of two digits; of one digit there are 1 and 7, all others have three.
CODES_OF_TWO = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def calling_code(digits: str) -> str:
    """The country's code at the start of an international number."""
    return digits[:1] if digits[0] in "17" else digits[:2] if digits[:2] in CODES_OF_TWO else digits[:3]


def phone(country: str, rest: str, key: bytes) -> str | None:
    """The country stays, and what follows its code is permuted: one number is one pseudonym, however it is spaced."""
    digits = re.sub(r"\D", "", country + rest)
    code = calling_code(digits) if country else ""
    if not 7 <= len(digits) - len(code) <= 14:
        return None
    return like(country + rest, code + in_format(digits[len(code) :], key, "phone"))


def ssn(area: str, group: str, serial: str, key: bytes) -> str | None:
    if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
        return None
    areas = [k for k in range(1, 900) if k != 666]
    x = (areas.index(int(area)) * 99 + int(group) - 1) * 9999 + int(serial) - 1
    x, c = divmod(permuted(x, len(areas) * 99 * 9999, key, "ssn"), 9999)
    a, b = divmod(x, 99)
    return f"{areas[a]:03}-{b + 1:02}-{c + 1:04}"


def ip(value: str, key: bytes) -> str | None:
    octets = value.split(".")
    if any(str(int(o)) != o or int(o) > 255 for o in octets):
        return None
    spans = [((0, 10), (10, 100), (100, 256))[len(o) - 1] for o in octets]
    x = 0
    for o, (a, b) in zip(octets, spans, strict=True):
        x = x * (b - a) + int(o) - a
    x, out = permuted(x, math.prod(b - a for a, b in spans), key, "ip"), []
    for a, b in reversed(spans):
        x, r = divmod(x, b - a)
        out.append(str(a + r))
    return ".".join(reversed(out))


def day(year: str, month: str, date: str, key: bytes) -> tuple[str, str, str] | None:
    """Month and day may stand the other way round; then so do the pseudonym's."""
    for m, d, swapped in ((month, date, False), (date, month, True)):
        try:
            at = datetime.date(int(year), int(m), int(d)).toordinal()
        except ValueError:
            continue
        if FIRST_DAY <= at <= LAST_DAY:
            new = datetime.date.fromordinal(FIRST_DAY + permuted(at - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))
            m, d = str(new.month).zfill(len(m)), str(new.day).zfill(len(d))
            return str(new.year), *((d, m) if swapped else (m, d))
    return None


def iban(value: str, key: bytes) -> str | None:
    bare = value.replace(" ", "")
    if not 15 <= len(bare) <= 34 or mod_97(bare) != 1:
        return None
    body = in_format(bare[4:], key, "iban")
    return like(value, bare[:2] + f"{98 - mod_97(bare[:2] + '00' + body):02}" + body)


@lru_cache(maxsize=20_000)
def email(local: str, domain: str, key: bytes) -> str:
    """Both sides in lower case decide, so that a written address stays linked to its capitals."""
    host, _, top = domain.rpartition(".")
    return like_case(local, in_format(local.lower(), key, "local")) + "@" + like_case(host, in_format(host.lower(), key, "host")) + "." + top


def like_case(shape: str, text: str) -> str:
    return "".join(t.upper() if c.isupper() else t for c, t in zip(shape, text, strict=True))


@lru_cache(maxsize=20_000)
def number(found: tuple[tuple[str, str], ...], key: bytes) -> str | None:
    """The pseudonym of what NUMBER found (its groups), or None if it isn't valid."""
    g = dict(found)
    if "ip" in g:
        return ip(g["ip"], key)
    if "ymd" in g:
        new = day(g["y1"], g["m1"], g["d1"], key)
        return new and g["s1"].join(new)
    if "dmy" in g:
        new = day(g["y2"], g["m2"], g["d2"], key)
        return new and g["s2"].join((new[2], new[1], new[0]))
    if "ssn" in g:
        return ssn(g["area"], g["group"], g["serial"], key)
    if "card" in g:
        return card(g["card"], key)
    if "e164" in g:
        return phone("+", g["e164"][1:], key)
    return phone(g.get("country", ""), g["rest"], key)


def ends(text: str, start: int, end: int) -> list[int]:
    """``end`` and, from the last, where its groups end before it."""
    return [end, *(k for k in range(end - 1, start, -1) if text[k] in " -" and text[k - 1] not in " -")]


def card_end(text: str, start: int, key: bytes, free: Callable[[int, int], bool]) -> int | None:
    """Where the longest valid card from ``start`` ends: a group of other digits may follow it."""
    m = CARD.match(text, start)
    for end in ends(text, start, m.end()) if m else ():
        value = text[start:end]
        if sum(c.isdigit() for c in value) < 13:
            break
        if free(start, end) and number((("card", value),), key):
            return end
    return None


def cut_card(text: str, start: int, whole: int, key: bytes, free: Callable[[int, int], bool]) -> int | None:
    """Where a card ends whose run of digits up to ``whole`` isn't valid, unless one that begins within it has more digits."""
    end = card_end(text, start, key, free)
    if end is None or end == whole:
        return end

    def digits(a: int, b: int) -> int:
        return sum(c.isdigit() for c in text[a:b])

    for later in range(start + 1, end):
        if text[later - 1] in " -" and (its := card_end(text, later, key, free)) and digits(later, its) > digits(start, end):
            return None
    return end


def iban_end(text: str, start: int, whole: int, key: bytes) -> tuple[int, str] | None:
    """End and pseudonym of the IBAN at ``start``: by its country's length, as long as it was found, or, of an unknown country, by groups."""
    length, all_ends = int(IBAN_LENGTH.get(text[start : start + 2], 0)), ends(text, start, whole)
    known = [e for e in all_ends if e - start - text.count(" ", start, e) == length]
    for end in known + (all_ends[:1] if length else all_ends):
        if new := iban(text[start:end], key):
            return end, new
    return None


def clear_of(spans: list[tuple[int, int, str]]) -> Callable[[int, int], bool]:
    """Whether a stretch touches none of ``spans``, which are apart from each other."""
    spans = sorted(spans)
    starts, stops = [s[0] for s in spans], [s[1] for s in spans]

    def free(start: int, end: int) -> bool:
        k = bisect.bisect_left(starts, end)
        return not k or stops[k - 1] <= start

    return free


def findings(text: str, key: bytes) -> list[tuple[int, int, str]]:
    """Start, end and pseudonym of each valid value, in order and apart from each other, in time that grows with the text's length."""
    out: list[tuple[int, int, str]] = []
    at = text.find("@")
    done = 0
    while at >= 0:
        a, b = LOCAL.search(text[max(done, at - 64) : at]), DOMAIN.match(text, at + 1)
        if a and b and (local := a[0].strip(".-")):
            out.append((at - len(a[0].lstrip(".-")), b.end(), email(local, b[0], key) if local == a[0].lstrip(".-") else email(a[0].lstrip(".-"), b[0], key)))
            done = b.end()
        at = text.find("@", max(at + 1, done))
    free, pos = clear_of(out), 0
    while m := IBAN.search(text, pos):
        pos = m.start() + 1
        if (found := iban_end(text, m.start(), m.end(), key)) and free(m.start(), found[0]):
            out.append((m.start(), *found))
            pos = found[0]
    free = clear_of(out)  # before numbers: groups of an IBAN may look like a card
    for near in NEAR.finditer(text):
        pos, last = near.start(), near.end()
        while pos < last and (m := NUMBER.search(text, pos, last + BEYOND)) and m.start() < last:
            end, new = m.end(), number(tuple((k, v) for k, v in m.groupdict().items() if v is not None), key)
            if m["card"] and not (new and free(m.start(), end)):
                end = cut_card(text, m.start(), end, key, free)
                new = end and number((("card", text[m.start() : end]),), key)
            if new and free(m.start(), end):
                out.append((m.start(), end, new))
                pos = end
            else:  # it may begin a little later, or be of another kind
                pos = m.start() + 1
    out.sort()
    kept, end = [], 0
    for f in out:
        if f[0] >= end:
            kept.append(f)
            end = f[1]
    return kept


def replaced(text: str | None, key: bytes) -> tuple[str | None, int]:
    """The text with pseudonyms, and how many."""
    if not text:
        return text, 0
    found = findings(text, key)
    if not found:
        return text, 0
    out, at = [], 0
    for a, b, new in found:
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], len(found)


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """All rows and columns of ``docs``, with ``text`` (whole) pseudonymised and ``n_pii`` values counted.

    Null and empty texts stay and count 0. Values that overlap: addresses go first, then IBANs, then what begins first. Dates before
    1900 or after 2099 are not dates of a life and stay. An input column ``n_pii`` is replaced. No shuffle. ``key`` (1 to 64
    bytes) decides the permutations; whoever holds it can undo them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(key)

    def new(texts: list) -> tuple[list, list]:
        kept("pseudonyms", dict)  # what other operators kept in this worker goes
        found = [replaced(t, shared.value) for t in texts]
        return [t for t, _ in found], [n for _, n in found]

    return with_text(docs, new, "n_pii long", replaces=True)
