"""Personal information inside free text (problem 1).

Items are found in the text as it is drawn: full-width forms, look-alike
letters and characters without shape are read through, while positions stay
those of the stored text. E-mail addresses, phone numbers, identity numbers and
street addresses have known shapes; the words before a number in its sentence
decide between a person's number and that of an order or a part.

Names are runs of two or three name parts. Each part is weighed: known parts
(the list) count most; other words by a character model of the list's parts
against the words of all texts, which are counted in one pass; frequent words
of a language count against a name. To this come a title before the run
and, in Latin letters, capitals within a sentence (less so where a determiner
or a place stands before, and not at all in texts that capitalize much).
Initials belong to the run. No word around a name but titles is asked for.

Each item is replaced by a typed placeholder, or, where pseudonyms are wanted,
numbers and dates of birth keep their format: a keyed Feistel network permutes
them within it (letters among letters, digits among digits, days among the
days of a fixed range), and check digits that were right are made right again.
A number is permuted in one canonical form, whatever its notation: a phone
number without country code and trunk zero, an identity number without
separators and case. So equal values stay equal in every document and
notation, and the mapping can be undone with the key, which the caller gives.

Null, empty and blank texts have no items and come out as they are. Items
don't overlap: the earlier kind of e-mail, address, identity number, phone,
name, date of birth wins. Equal rows give equal rows.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import math
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality
from .common import per_text
from .lookalike import base_shapes, simple_form
from .mojibake import repair

KINDS = ("email", "address", "id_number", "phone", "name", "birth_date")
ROUNDS = 10
#: words that a task counts before it hands its counts on
COUNTED_WORDS = 200_000

# ---------------------------------------------------------------- Feistel


def _round(key: bytes, tweak: bytes, i: int, value: int, modulus: int) -> int:
    mac = hmac.new(key, tweak + bytes([i]) + value.to_bytes(16, "big"), hashlib.sha256).digest()
    return int.from_bytes(mac[:16], "big") % modulus


def permute(value: int, low_size: int, high_size: int, key: bytes, tweak: bytes = b"", back: bool = False) -> int:
    """Keyed permutation of range(low_size * high_size): an unbalanced Feistel network over (high, low)."""
    high, low = divmod(value, low_size)
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if i % 2:
            low = (low + sign * _round(key, tweak, i, high, low_size)) % low_size
        else:
            high = (high + sign * _round(key, tweak, i, low, high_size)) % high_size
    return high * low_size + low


def _sizes(form: str) -> list[int]:
    return [10 if c == "9" else 26 for c in form]


def permute_form(value: str, key: bytes, kind: str, back: bool = False) -> str:
    """Permute upper-case letters among letters and digits among digits; a single sign is a form too."""
    form = "".join("9" if c.isdigit() else "A" for c in value)
    sizes = _sizes(form)
    half = len(sizes) // 2
    n = 0
    for c, size in zip(value, sizes):
        n = n * size + (int(c) if size == 10 else ord(c) - 65)
    n = permute(n, math.prod(sizes[half:]), math.prod(sizes[:half]), key, f"{kind}{form}".encode(), back)
    out = []
    for size in reversed(sizes):
        n, d = divmod(n, size)
        out.append(str(d) if size == 10 else chr(65 + d))
    return "".join(reversed(out))


def _walk(value: str, key: bytes, kind: str, back: bool, fits: Callable[[str], bool]) -> str:
    """Permute until the value fits; a value that fits comes to one that fits, and back."""
    while True:
        value = permute_form(value, key, kind, back)
        if fits(value):
            return value


# check signs: the value without them -> the signs
#: The dihedral group's table and permutation of the Verhoeff check.
_VERHOEFF_D = ("0123456789", "1234067895", "2340178956", "3401289567", "4012395678", "5987604321", "6598710432", "7659821043", "8765932104", "9876543210")
_VERHOEFF_P = ("0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258")
#: The letters of the Spanish identity number, by remainder.
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"


def _verhoeff(body: str) -> str:
    c = 0
    for i, d in enumerate(reversed(body), 1):
        c = int(_VERHOEFF_D[c][int(_VERHOEFF_P[i % 8][int(d)])])
    return next(str(x) for x in range(10) if _VERHOEFF_D[c][x] == "0")


def _luhn(body: str) -> str:
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(body)))
    return str(-total % 10)


def _mod_11_10(body: str) -> str:
    p = 10
    for d in body:
        p = (((p + int(d)) % 10) or 10) * 2 % 11
    return str((11 - p) % 10)


#: form of an identity number -> number of check signs at its end, and how they are made
CHECKS: dict[str, tuple[int, Callable[[str], str]]] = {
    "9" * 12: (1, _verhoeff),
    "9" * 9: (1, _luhn),
    "9" * 11: (1, _mod_11_10),
    "9" * 8 + "A": (1, lambda body: _DNI[int(body) % 23]),
    "9" * 15: (2, lambda body: f"{97 - int(body) % 97:02d}"),
}


def checked(value: str) -> bool:
    """Whether a canonical identity number has check signs and they are right."""
    n, make = CHECKS.get("".join("9" if c.isdigit() else "A" for c in value), (0, None))
    return make is not None and make(value[:-n]) == value[-n:]


def id_pseudonym(value: str, key: bytes, back: bool = False) -> str:
    """Another identity number of the form of a canonical one, with right check signs where they were right."""
    if not checked(value):
        return _walk(value, key, "id", back, lambda v: not checked(v))
    n, make = CHECKS["".join("9" if c.isdigit() else "A" for c in value)]
    body = permute_form(value[:-n], key, "checked", back)
    return body + make(body)


#: Country codes of two digits (ITU); 1 and 7 have one, all others three.
_TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def phone_prefix(text: str, digits: str) -> int:
    """Digits before the national number: international prefix, country code and trunk zeros."""
    n = 0
    if "+" in text[:2] or digits.startswith("00"):
        n = 0 if "+" in text[:2] else 2
        n += 1 if digits[n : n + 1] in ("1", "7") else 2 if digits[n : n + 2] in _TWO_DIGITS else 3
    while digits[n : n + 1] == "0":
        n += 1
    return n if len(digits) - n >= 4 else 0


def pseudonym(text: str, key: bytes, kind: str, back: bool = False) -> str:
    """A number in its own notation with its canonical form permuted; everything else is kept.

    Digits of any script keep their script, letters their case.
    """
    at = [i for i, c in enumerate(text) if c.isdigit() or (kind != "phone" and "A" <= c.upper() <= "Z")]
    value = "".join(str(int(text[i])) if text[i].isdigit() else text[i].upper() for i in at)
    if kind == "phone":
        n = phone_prefix(text, value)
        at, value = at[n:], value[n:]
    if len(value) < 2:
        return text
    if kind == "phone":
        # a national number that begins with no zero stays one
        out = _walk(value, key, "phone", back, lambda v: (v[0] == "0") == (value[0] == "0"))
    else:
        out = id_pseudonym(value, key, back)
    chars = list(text)
    for i, d in zip(at, out):
        c = chars[i]
        chars[i] = chr(ord(c) - int(c) + int(d)) if c.isdigit() else d if c.isupper() else d.lower()
    return "".join(chars)


#: the days that dates are permuted among: 1900-01-01 and the 196 * 256 days after it
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), (196, 256)


def date_pseudonym(day: int, month: int, year: int, key: bytes, back: bool = False) -> tuple[int, int, int] | None:
    """Another valid (day, month, year), or None for what is no date of the range."""
    try:
        n = datetime.date(year, month, day).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    if not 0 <= n < _DAYS[0] * _DAYS[1]:
        return None
    d = datetime.date.fromordinal(_FIRST_DAY + permute(n, *_DAYS, key, b"date", back))
    return d.day, d.month, d.year


# ---------------------------------------------------------------- finding

_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_+-])?"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|DOT|Dot)\s?[\])}]\s?|\s(?:dot|DOT)\s)"
_SPELLED_DOT = r"(?:\s?[\[({]\s?(?:dot|DOT|Dot)\s?[\])}]\s?|\s(?:dot|DOT)\s)"  # no plain dot: the local part holds those itself
_EMAIL = re.compile(rf"(?<![\w@.+-]){_LOCAL}(?:{_SPELLED_DOT}{_LOCAL})*(?:(?:\s?@\s?|\s?[\[({{]\s?(?:at|AT|At)\s?[\])}}]\s?)[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}|\s(?:at|AT)\s[A-Za-z0-9-]+(?:\s(?:dot|DOT)\s[A-Za-z0-9-]+)*\s(?:dot|DOT)\s[A-Za-z]{{2,}})(?![\w@])")
#: a sign that every match of _EMAIL holds
_EMAIL_SIGN = re.compile(r"@|[\[({]\s?(?:at|AT|At)\s?[\])}]|\s(?:at|AT)\s[A-Za-z0-9-]+\s(?:dot|DOT)\s")

#: Shapes of phone numbers.
_PHONE = re.compile(
    r"""(?<![\w./+-])(?:
        \+\d{1,3}[\s.-]?\(?\d{2,5}\)?(?:[\s.-]?\d{2,6}){1,4}
      | \(0?\d{2,4}\)\s?\d{3,4}[\s.-]?\d{4}
      | 00\d{2}(?:\s\d{2}){4}
      | 0\d{2,4}[\s-]\d{6,8}
      | 0\d(?:[\s.]\d{2}){4}
      | \d{3}[.-]\d{3}[.-]\d{4}
      | [5-9]\d{9}
      | [5-9]\d{4}[\s-]\d{5}
    )(?![\w/-]|[.,]\d)""",
    re.X,
)
#: Shapes of identity, tax, voter and passport numbers.
_PERSON_CODE = re.compile(r"(?<![\w/-])(?:[A-Z]{5}\d{4}[A-Z]|[A-Z]{3}[\s/]?\d{7}|\d{3}-\d{2}-\d{4})(?![\w/-])")
_LONG_NUMBER = re.compile(r"(?<![\w/.-])(?:\d{4}([\s-]?)\d{4}\1\d{4}|[A-Z]{1,2}\d{6,8}|\d{8,11}[A-Z]?|[A-Za-z]{5}\d{4}[A-Za-z]|[A-Za-z]{3}[\s/]?\d{7})(?![\w/-]|[.,]\d)")
#: Words before a person's number, and before one of a thing.
_PERSON_WORD = re.compile(
    r"(?i:identity|passport|\bpan\b|aadhaar|aadhar|voter|tax\s(?:card|id|number)|social\ssecurity|\bssn\b|ausweis|steuer|reisepass|personalausweis|pasaporte|documento|\bdni\b|\bnif\b|identité|passeport|fiscal)|ఆధార్|పాస్‌?పోర్ట్|గుర్తింపు|పాన్|ఓటరు|आधार|पहचान|पासपोर्ट|ओळखपत्र|पैन|पॅन|मतदाता|मतदार|ஆதார்|பாஸ்போர்ட்|ಆಧಾರ್|ಪಾಸ್ಪೋರ್ಟ್"
)
_THING_WORD = re.compile(r"(?i:order|invoice|part\s|serial|batch|server|build|ticket|tracking|bestellung|rechnung|commande|facture|pedido|factura|isbn|replaces|volumes)|ఆర్డర్|బిల్లు|ऑर्डर|बिल|ಆರ್ಡರ್|ஆர்டர்")

_NUM = r"\d[\dA-Za-z]*(?:[/-][\dA-Za-z]+)*"
_CITY = r"[A-ZÀ-Þ][\w'’-]+(?:\s[A-ZÀ-Þ][\w'’-]+)?"
_POST = r"\d{5,6}(?!\d)"
_IN = r"[ఀ-౿ऀ-ॿಀ-೿஀-௿]+"
#: Forms of street addresses, from the house number or street to the postal code.
_ADDRESSES = (
    (re.compile(r"Lane|Street|St\b|Road|Rd\b|Avenue|Ave\b|Nagar|Colony|Drive|Way|Close|Court|Square"), re.compile(rf"(?<![\w/-])(?:(?:Flat|Plot|House|Door|Apt\.?|Apartment|Unit|H\.)\s*(?:No\.?\s*)?{_NUM},?\s+)?(?:{_NUM},?\s+)?{_CITY}\s+(?:Lane|Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Nagar|Colony|Drive|Way|Close|Court|Square)\b\.?,?\s+{_CITY},?\s*(?:[-–]\s*)?{_POST}")),
    (re.compile("rue |avenue |boulevard |place |chemin |allée |impasse |quai |route |cours "), re.compile(rf"(?<![\w/-])\d+(?:\s?(?:bis|ter|quater))?,?\s+(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours)\s+[^,\n\d]{{1,40}},\s*{_POST}")),
    (re.compile("straße|strasse|str\\.|weg|platz|gasse|allee|ring|damm|ufer|Am |An der |Im |Unter den "), re.compile(rf"(?<!\w)(?:[A-ZÄÖÜ][\w-]*(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm|ufer)|(?:Am|An der|Im|Unter den)\s[A-ZÄÖÜ]\w+)\s+\d+\s?[a-z]?,\s*{_POST}")),
    (re.compile("Calle|C/|Avda|Avenida|Plaza|Paseo|Camino|Carrera|Ronda"), re.compile(rf"(?<!\w)(?:Calle|C/|Avda\.?|Avenida|Plaza|Paseo|Camino|Carrera|Ronda)\s+[^,\n\d]{{1,40}},?\s*\d+\w?(?:,\s*[^,\n]{{1,12}}){{0,2}},\s*{_POST}")),
    (re.compile("వీధి|నగర్|కాలనీ|రోడ్|వాడ|గల్లీ"), re.compile(rf"(?<![\w/-])(?:(?:ఇంటి|డోర్|ఇల్లు|ఫ్లాట్|ప్లాట్)\s*(?:నం|నెం|సంఖ్య)\.?\s*)?{_NUM},\s*{_IN}\s*(?:వీధి|నగర్|కాలనీ|రోడ్డు?|వాడ|గల్లీ),\s*{_IN},?\s*(?:[-–]\s*)?{_POST}")),
    (re.compile("गली|मार्ग|नगर|रोड|सड़क|पेठ|कॉलोनी|रस्ता|चौक"), re.compile(rf"(?<![\w/-])(?:(?:मकान|घर|फ्लैट|प्लॉट|फ्लॅट|दुकान)\s*(?:नं|क्र|नंबर|संख्या|क्रमांक)\.?\s*)?{_NUM},\s*{_IN}\s*(?:गली|मार्ग|नगर|रोड|सड़क|पेठ|कॉलोनी|रस्ता|चौक),\s*{_IN},?\s*(?:[-–]\s*)?{_POST}")),
)

#: Words after a name that make it a firm's, a school's or a street's.
_NOT_PERSON = re.compile(
    r"\s*(?:[,&]\s*)?(?:&|(?:College|School|University|Street|Lane|Road|Rd|Nagar|Avenue|Ltd|Inc|Corp|GmbH|AG|KG|Mill|Mills|Company|Co|Sons|Brothers|Hospital|Bank|Institute|et\sFils|e\sHijos|y\sHijos)\b|కళాశాల|పాఠశాల|వీధి|నగర్|బ్యాంక్|కంపెనీ|రోడ్డు?|कॉलेज|महाविद्यालय|विद्यालय|स्कूल|मार्ग|गली|नगर|कंपनी|बैंक)"
)
#: Titles that a name follows.
_TITLES = frozenset(
    """
    dr mr mrs ms miss mx sir prof professor doctor rev capt sr sra srta señor señora señorita don doña mme mlle madame monsieur mademoiselle frau herr herrn fräulein shri smt kumari
    డా డాక్టర్ శ్రీ శ్రీమతి కుమారి ప్రొఫెసర్ श्री श्रीमती डॉ डॉक्टर सुश्री कुमारी प्रो डॅ
    """.split()
)
#: those that are whole words: a full stop after them ends a sentence
_WHOLE_TITLES = frozenset("miss sir professor doctor señor señora señorita don doña madame monsieur mademoiselle frau herr herrn fräulein shri smt kumari".split())
#: Words after which capitalized words name a thing or a place.
_PLACES = frozenset("the an at in near into der die das den dem im am le la les un une aux dans chez en el los las una".split())
#: Abbreviations and words of things, which are no name parts.
_ORDINARY = frozenset("no nos nr fig art vol inv uu ee and or und et y de la street road lane".split())
#: Words of firms, schools and streets; no run of parts with one of them is a person.
_FIRMS = frozenset(
    """
    college school university street lane road rd nagar avenue ltd inc corp gmbh ag kg mill mills company co sons brothers hospital bank institute
    కళాశాల పాఠశాల వీధి వీధిలో నగర్ బ్యాంక్ కంపెనీ రోడ్ రోడ్డు కాలనీ కార్డు कॉलेज महाविद्यालय विद्यालय स्कूल मार्ग गली नगर कंपनी बैंक पेठ रोड पत्र क्रमांक
    """.split()
)
#: weights: a known part, the most and least of another, a title, a capital within a sentence; what a run needs
KNOWN, MOST, LEAST, TITLE, CAPITAL, NEEDED = 4.0, 4.0, -4.0, 12.0, 7.0, 5.0
#: what a pair needs in a script without capitals if one of its parts is known, or as likely
NEEDED_BESIDE = 3.0
#: share of the texts from which a word in them is no name part unless it is a known one
FREQUENT = 0.01
#: strength with which both sides of the model of names are drawn together, in n-grams
DRAWN = 100
#: share of capitalized words within sentences from which capitals say nothing (as in German), and how many it takes to tell
MANY_CAPITALS, FEW_CAPITALS = 0.2, 8

#: characters of the longest word that is looked for before a name
LONGEST = max(map(len, _TITLES | _PLACES)) + 2

_LATIN_RUN = re.compile(r"(?<![\w@/.<&'’-])(?:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’]+|[A-ZÀ-ÖØ-Þ]{2,}|[A-ZÀ-ÖØ-Þ]\.)(?:(?:,?[^\S\n]+|,?[^\S\n]*\n[^\S\n]*|-)(?:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’]+|[A-ZÀ-ÖØ-Þ]{2,}|[A-ZÀ-ÖØ-Þ]\.))+(?![\w@])")
_LATIN_TOKEN = re.compile(r"[A-ZÀ-ÖØ-Þ]\.|[A-Za-zÀ-ÖØ-öø-ÿ'’]+")
_BEFORE = re.compile(r"([^\W\d_]+)(\.?)([^\S\n]*)$")
_MID_CAPITAL = re.compile(r"[a-zß-öø-ÿ,;] ([A-ZÀ-ÖØ-Þ])[a-zß-öø-ÿ]")
_MID_LOWER = re.compile(r"[a-zß-öø-ÿ,;] [a-zß-öø-ÿ]")
_INDIC_TOKEN = re.compile(r"[ఀ-౿]+|[ऀ-ॣॲ-ॿ]+")
_DIGIT = re.compile(r"\d")
_NUMBERS = re.compile(r"[+(]?\d[\d\s().\-+]{6,}\d|[A-Za-z]{1,5}[\s/]?\d{4}")
_SENTENCE = re.compile(r"[.!?।॥](?=\s)\s+|\n\s*\n")
_ODD = re.compile("[\u0370-\u03ff\u0400-\u052f\u0530-\u058f\xad\u200b-\u200d\u2060\ufeff\ufb00-\ufb06\uff01-\uff5e\xa0\u2000-\u200a\u202f\u205f\u3000]")
#: digits of the Indian scripts are read as the digits they are
_ASCII_DIGITS = {zero + d: 48 + d for zero in (0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66) for d in range(10)}
_NATIVE = re.compile("[" + "".join(map(chr, _ASCII_DIGITS)) + "]")
_BORN = re.compile(r"(?i:\bborn\b|date\sof\sbirth|\bdob\b|geboren|geburtsdatum|né[e]?\sle|nacid[oa]|fecha\sde\snacimiento)|జన్మ|పుట్టిన|जन्म")
_DATE = re.compile(r"(?<![\d.,/-])(\d{1,2})([./-])(\d{1,2})\2(\d{4})(?![\d/-]|[.,]\d)")


def _script(c: str) -> str:
    return "Latin" if c < "\u0250" else "Telugu" if "ఀ" <= c <= "౿" else "Devanagari" if "ऀ" <= c <= "ॿ" else ""


def _grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)]


def word_counts(texts: Iterable[str]) -> tuple[Counter[str], Counter[str]]:
    """How often each word stands in texts, and in how many of them."""
    seen: Counter[str] = Counter()
    holders: Counter[str] = Counter()
    for t in texts:
        words = Counter(map(str.lower, (*_LATIN_TOKEN.findall(t), *_INDIC_TOKEN.findall(t))))
        seen.update(words)
        holders.update(words.keys())
    return seen, holders


def _lowered(names: list[str]) -> frozenset[str]:
    return frozenset(n.lower() for n in names)


def _frequent(n_texts: int) -> float:
    """In how many of so many texts a frequent word stands."""
    return max(3, FREQUENT * n_texts)


def _outside(word: str) -> Counter[tuple[str, str]]:
    script = _script(word[0])
    return Counter((script, g) for g in _grams(word))


class NameModel:
    """How much a word looks like a name part: log odds of its n-grams among the list's parts and among the words of texts."""

    def __init__(self, names: list[str], texts: list[str], common: dict[str, list[str]]):
        seen, holders = word_counts(texts)
        known = _lowered(names)
        rows = ((gram, k * seen[w]) for w in seen if w not in known for gram, k in _outside(w).items())
        self._weigh(known, common, (w for w, k in holders.items() if k >= _frequent(len(texts))), rows)

    @classmethod
    def counted(cls, names: list[str], common: dict[str, list[str]], frequent: Iterable[str], outside: Iterable[tuple[tuple[str, str], int]]) -> NameModel:
        """From the frequent words of the texts and the ((script, n-gram), count) of their words that are no known parts."""
        model = cls.__new__(cls)
        model._weigh(_lowered(names), common, frequent, outside)
        return model

    def _weigh(self, known: frozenset[str], common: dict[str, list[str]], frequent: Iterable[str], grams: Iterable[tuple[tuple[str, str], int]]) -> None:
        self.known = known
        self.common = (frozenset(w.lower() for words in common.values() for w in words) | frozenset(frequent)) - known
        inside: dict[str, Counter[str]] = {}
        outside: dict[str, Counter[str]] = {}
        for n in self.known:
            if n:
                inside.setdefault(_script(n[0]), Counter()).update(_grams(n))
        for (script, g), k in grams:
            outside.setdefault(script, Counter())[g] += k
        self.odds: dict[str, dict[str, float]] = {}
        for script, pos in inside.items():
            neg = outside.get(script, Counter())
            both = pos + neg
            p, q, n = pos.total(), neg.total(), both.total() + len(both)
            # both are drawn towards what they have together, so an n-gram that neither has says nothing
            prior = {g: DRAWN * (k + 1) / n for g, k in both.items()}
            self.odds[script] = {g: math.log((pos[g] + x) / (p + DRAWN)) - math.log((neg[g] + x) / (q + DRAWN)) for g, x in prior.items()}

    def weight(self, word: str) -> float:
        """Between ``LEAST`` and ``KNOWN``."""
        w = word.lower()
        if w in self.known:
            return KNOWN
        odds = self.odds.get(_script(w[0]))
        if odds is None or len(w) < 2 or w in self.common or w in _ORDINARY:
            return LEAST
        return max(LEAST, min(MOST, sum(odds.get(g, 0.0) for g in _grams(w)) / 2))


class _Plain(dict):
    """str.translate table to the characters the patterns know; '' where there is no shape."""

    def __init__(self):
        super().__init__()
        self.shapes = base_shapes()

    def __missing__(self, o: int):
        c = chr(o)
        form = simple_form(c) if c not in "\u200c\u200d" else ""
        if (shape := self.shapes.get(form)) is not None:
            form = next(iter(shape.values()))
        self[o] = form
        return form


class _Items:
    """Items that don't overlap, in order."""

    def __init__(self):
        self.spans: list[tuple[int, int, str]] = []

    def add(self, a: int, b: int, kind: str) -> bool:
        at = bisect_left(self.spans, (a, b, ""))
        if (at < len(self.spans) and self.spans[at][0] < b) or (at and self.spans[at - 1][1] > a):
            return False
        insort(self.spans, (a, b, kind))
        return True


def _lead(text: str, at: int, words: int) -> str:
    """The last ``words`` words before ``at`` in its sentence."""
    size = 128
    while True:  # as much as holds the words, however long they are
        piece = text[max(0, at - size) : at].split()
        if size >= at or len(piece) > words:
            break
        size *= 2
    joined = " ".join(piece[-words:])
    start = max((m.end() for m in _SENTENCE.finditer(joined)), default=0)
    return joined[start:]


def finder(model: NameModel) -> Callable[[str], list[tuple[int, int, str]]]:
    """A function from text to items (start, end, kind), in order and apart from each other."""
    plain = _Plain()
    memo: dict[str, float] = {}

    def weight(w: str) -> float:
        x = memo.get(w)
        if x is None:
            if len(memo) >= quality.KEPT_WORDS:
                memo.clear()
            x = memo[w] = model.weight(w)
        return x

    def latin(text: str) -> Iterator[tuple[int, int]]:
        capital: float | None = None
        for run in _LATIN_RUN.finditer(text):
            a, b = run.span()
            k = a
            while k and text[k - 1].isspace():
                k -= 1
            before = None if "\n" in text[k:a] else _BEFORE.search(text, max(0, k - LONGEST), a)
            word = before.group(1).lower() if before else ""
            title = word in _TITLES and not (before.group(2) and word in _WHOLE_TITLES)
            # whether the run opens a sentence: the first capital then says nothing
            lead = text[k - 1 : k]
            opens = not title and (not lead or lead in ".!?।…:\"“”„«»‘’'()]—–•*;|>" or "\n" in text[max(0, a - 2) : a])
            if capital is None:
                upper, lower = len(_MID_CAPITAL.findall(text)), len(_MID_LOWER.findall(text))
                capital = CAPITAL if upper <= MANY_CAPITALS * (upper + lower) or upper < FEW_CAPITALS else 0.0
            for piece, titled in pieces(text, a, b, title):
                first = piece[0][0] == a
                yield from named(text, piece, titled, opens and first, -capital if first and word in _PLACES and not before.group(2) else capital)

    def pieces(text: str, a: int, b: int, title: bool) -> Iterator[tuple[list[tuple[int, int, str]], bool]]:
        """The runs of parts (start, end, word) in text[a:b], and whether a title stands before: ordinary words and commas part them, but 'Family, Given' is one."""
        runs: list[tuple[list[tuple[int, int, str]], bool]] = [([], title)]
        for m in _LATIN_TOKEN.finditer(text, a, b):
            w = m.group().lower()
            if w in _FIRMS:
                return
            titled = runs[-1][1] and len(runs[-1][0]) < 2  # what follows a title belongs to it
            if w in _TITLES or w in _ORDINARY or w in _PLACES or (w in model.common and not titled and not _initial(w)):
                runs.append(([], w in _TITLES))
                continue
            parts = runs[-1][0]
            if parts and "," in text[parts[-1][1] : m.start()]:
                runs.append(([], False))
            runs[-1][0].append((m.start(), m.end(), m.group()))
        k = 0
        while k < len(runs):
            parts, title = runs[k]
            after = runs[k + 1][0] if k + 1 < len(runs) else []
            if parts and after and "," in text[parts[-1][1] : after[0][0]] and len(after) == 1 and len(parts) < 3 and not _initial(parts[-1][2]):
                parts, k = parts + after, k + 1
            if parts:
                yield parts, title
            k += 1

    def named(text: str, parts: list[tuple[int, int, str]], title: bool, opens: bool, capital: float) -> Iterator[tuple[int, int]]:
        """The name in a run of parts (start, end, word), if there is one."""
        # 'M.' before two parts is a title, before one an initial
        if len(parts) > 2 and parts[0][2] == "M." and not any(_initial(w) for _, _, w in parts[1:]):
            parts, title = parts[1:], True
        if opens and len(parts) > 2 and not _initial(parts[0][2]) and weight(parts[0][2]) < MOST:
            parts, opens = parts[1:], False  # the word that opens the sentence, then a name
        full = [w for _, _, w in parts if not _initial(w)]
        if not 2 <= len(parts) <= 3 or not full:
            return
        comma = "," in text[parts[0][1] : parts[-1][0]]
        total = TITLE if title else 0.0
        for k, (_, _, w) in enumerate(parts):
            if _initial(w):
                total += 2.0
                continue
            total += weight(w)
            if w[1:].islower() and not comma and not (opens and k == 0):
                total += capital
        if total * 2 >= NEEDED * len(full):
            end = parts[-1][1]
            yield parts[0][0], end - 1 if text[end - 1] == "." else end

    def indic(text: str) -> Iterator[tuple[int, int]]:
        """Two parts side by side, the likelier of two pairs that share one; a third is not looked for."""
        tokens = list(_INDIC_TOKEN.finditer(text))
        weights = [weight(m.group()) for m in tokens]
        n = len(tokens)

        def pair(i: int) -> float:
            if i < 0 or i > n - 2:
                return 0.0
            x = weights[i] + weights[i + 1]
            if x < NEEDED - TITLE:
                return 0.0
            before = tokens[i - 1] if i else None
            if before is not None and before.group() in _TITLES and not text[before.end() : tokens[i].start()].strip(" ."):
                x += TITLE
            needed = NEEDED_BESIDE if KNOWN in (weights[i], weights[i + 1]) else NEEDED
            if x < needed or tokens[i].group() in _TITLES or tokens[i].group() in _FIRMS or tokens[i + 1].group() in _FIRMS or not _adjoin(text, tokens[i], tokens[i + 1]):
                return 0.0
            return x

        i = 0
        while i < n - 1:
            if weights[i] + weights[i + 1] >= NEEDED - TITLE and (x := pair(i)) and x >= pair(i + 1):
                yield tokens[i].start(), tokens[i + 1].end()
                i += 1
            i += 1

    def find(text: str) -> list[tuple[int, int, str]]:
        where: list[int] | None = None
        if _NATIVE.search(text):
            text = text.translate(_ASCII_DIGITS)  # one character for one: positions stay
        if _ODD.search(text):
            forms = [plain[ord(c)] for c in text]
            clean = "".join(forms)
            if clean != text:
                where = [i for i, f in enumerate(forms) for _ in f]
                where.append(len(text))
                text = clean
        items = _Items()
        if _EMAIL_SIGN.search(text):
            for m in _EMAIL.finditer(text):
                items.add(m.start(), m.end(), "email")
        digits = len(_DIGIT.findall(text))
        if digits >= 5:
            for hint, rx in _ADDRESSES:
                if hint.search(text):
                    for m in rx.finditer(text):
                        items.add(m.start(), m.end(), "address")
        if digits >= 4 and _NUMBERS.search(text):
            for m in _PERSON_CODE.finditer(text):
                if not _THING_WORD.search(_lead(text, m.start(), 3)):
                    items.add(m.start(), m.end(), "id_number")
            for m in _LONG_NUMBER.finditer(text):
                before = _lead(text, m.start(), 4)
                hits = list(_PERSON_WORD.finditer(before))
                if not hits and not before.isascii():
                    before = repair(_lead(text, m.start(), 8))[0]
                    hits = list(_PERSON_WORD.finditer(before))
                if hits and not _THING_WORD.search(before, hits[-1].end()) and not re.search(r"\d{4}|[.!?।]\s", before[hits[-1].end() :]):
                    items.add(m.start(), m.end(), "id_number")
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m.group())) <= 15 and not _THING_WORD.search(_lead(text, m.start(), 2)):
                    items.add(m.start(), m.end(), "phone")
        for people in (latin(text), indic(text)):
            for a, b in people:
                if not _NOT_PERSON.match(text, b) and text[a - 1 : a] not in ("@", "_", "/") and text[b : b + 1] not in ("@", "_", "-"):
                    items.add(a, b, "name")
        if digits >= 6 and _BORN.search(text):
            for m in _DATE.finditer(text):
                start = max((x.end() for x in _SENTENCE.finditer(text, 0, m.start())), default=0)
                if _BORN.search(text, start, m.start()):
                    items.add(m.start(), m.end(), "birth_date")
        found = items.spans
        if where is not None:
            found = [(where[a], where[b - 1] + 1, k) for a, b, k in found]
        return found

    return find


def _initial(token: str) -> bool:
    return len(token) == 2 and token[1] == "."


def _adjoin(text: str, left: re.Match[str], right: re.Match[str]) -> bool:
    gap = text[left.end() : right.start()]
    return bool(gap) and gap.isspace() and "\n\n" not in gap and _script(left.group()[0]) == _script(right.group()[0])


def known_names(names: DataFrame) -> list[str]:
    """The name parts of a small fixed table."""
    return [r.n for r in names.select(F.trim("name_text").alias("n")).where("n <> ''").distinct().orderBy("n").collect()]  # about a thousand rows


def fit(df: DataFrame, names: DataFrame, common_words: DataFrame) -> NameModel:
    """The model of names from the list and the words of all texts of ``df`` (field, rec_id, text).

    Tasks count the words of their texts, the counts are summed by word, then
    those of n-grams by n-gram. Frequent words (at most the words of a text
    over ``FREQUENT``) and n-grams (of at most three letters) reach the driver.
    """
    parts = known_names(names)
    known = _lowered(parts)
    texts = df.select("text").where(F.col("text").isNotNull())
    least = _frequent(texts.count())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        holders: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            words = list(seen)
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64()), pa.array([holders[w] for w in words], pa.int64())], names=["word", "seen", "holders"])
            seen.clear()
            holders.clear()
            return batch

        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                for into, more in zip((seen, holders), word_counts(whole.column(0).slice(at, 100).to_pylist())):
                    into.update(more)
                if len(seen) > COUNTED_WORDS:
                    yield flush()
        yield flush()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Frequent words (without a script), and n-grams of the words that are no known parts."""
        grams: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            frequent = []
            for word, seen, holders in zip(*(batch.column(c).to_pylist() for c in ("word", "seen", "holders"))):
                if word in known:
                    continue
                if holders >= least:
                    frequent.append(word)
                script = _script(word[0])
                for g in _grams(word):
                    grams[script, g] += seen
            yield pa.RecordBatch.from_arrays([pa.nulls(len(frequent), pa.string()), pa.array(frequent, pa.string()), pa.array([1] * len(frequent), pa.int64())], names=["script", "part", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in grams], pa.string()), pa.array([g for _, g in grams], pa.string()), pa.array(list(grams.values()), pa.int64())], names=["script", "part", "n"])

    words = texts.mapInArrow(count, "word string, seen bigint, holders bigint").groupBy("word").agg(F.sum("seen").alias("seen"), F.sum("holders").alias("holders"))
    rows = words.mapInArrow(cut_up, "script string, part string, n bigint").groupBy("script", "part").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    both = list(zip(rows["script"], rows["part"], rows["n"]))
    return NameModel.counted(parts, quality.common_by_language(common_words), (w for s, w, _ in both if s is None), (((s, g), n) for s, g, n in both if s is not None))


def replaced(item: str, kind: str, key: bytes) -> str:
    """The pseudonym of a number or date, or the typed placeholder of anything else."""
    if kind in ("phone", "id_number"):
        return pseudonym(item, key, kind)
    if kind == "birth_date" and (m := _DATE.fullmatch(item.translate(_ASCII_DIGITS))) and (d := date_pseudonym(int(m.group(1)), int(m.group(3)), int(m.group(4)), key)) is not None:
        return f"{d[0]:02d}{m.group(2)}{d[1]:02d}{m.group(2)}{d[2]:04d}"
    return f"[{kind.upper()}]"


def places(df: DataFrame, model: NameModel) -> DataFrame:
    """(field, rec_id, start_pos, end_pos, kind): where every item of every text lies."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the list, the frequent words and the n-grams
    columns = [("start_pos", pa.int64()), ("end_pos", pa.int64()), ("kind", pa.string())]
    return per_text(df, lambda: finder(shared.value), "field string, rec_id bigint, start_pos bigint, end_pos bigint, kind string", ["field", "rec_id"], columns)


def items(df: DataFrame, model: NameModel, key: bytes) -> DataFrame:
    """(field, rec_id, start_pos, end_pos, kind, item, pseudonym): every item of every text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        find = finder(shared.value)

        def scan(text: str) -> Iterator[tuple]:
            for a, b, kind in find(text):
                yield a, b, kind, text[a:b], replaced(text[a:b], kind, key)

        return scan

    columns = [("start_pos", pa.int64()), ("end_pos", pa.int64()), ("kind", pa.string()), ("item", pa.string()), ("pseudonym", pa.string())]
    return per_text(df, make, "field string, rec_id bigint, start_pos bigint, end_pos bigint, kind string, item string, pseudonym string", ["field", "rec_id"], columns)


def masked_text(text: str, found: list[tuple[int, int, str]], key: bytes | None = None) -> str:
    """``text`` with placeholders, or, with a key, format-preserving pseudonyms of numbers and dates of birth."""
    parts, at = [], 0
    for a, b, kind in found:
        parts += [text[at:a], f"[{kind.upper()}]" if key is None else replaced(text[a:b], kind, key)]
        at = b
    return "".join([*parts, text[at:]])


def masked(df: DataFrame, model: NameModel, key: bytes) -> DataFrame:
    """(field, rec_id, n_items, masked, pseudonymized): every row of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        find = finder(shared.value)

        def scan(text: str | None) -> Iterator[tuple]:
            found = find(text) if text else []
            yield len(found), masked_text(text, found) if found else text, masked_text(text, found, key) if found else text

        return scan

    columns = [("n_items", pa.int64()), ("masked", pa.string()), ("pseudonymized", pa.string())]
    return per_text(df, make, "field string, rec_id bigint, n_items bigint, masked string, pseudonymized string", ["field", "rec_id"], columns, nulls=True)
