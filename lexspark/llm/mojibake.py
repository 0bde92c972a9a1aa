"""Garbled text from a wrong decoding (problem 10).

Characters are mapped back to the bytes of a legacy code page, and an automaton
over the byte structure of UTF-8 (lead bytes with their count of continuation
bytes, no overlong forms, surrogates or values past the last code point) finds
the maximal well-formed multibyte spans. Only those spans are decoded, so the
sound parts of a partly garbled text stay as they are. Each span is read in the
page that covers most of the text, or, where that page has none, in the next
one, so parts may differ in their pages. Spans that come out garbled again are
decoded again, until nothing changes (each step makes the text shorter).

The automaton is written as one regular expression per code page over the
page's characters. Further damage has its own scans:

* bytes lost on the way: U+FFFD stands for any continuation byte; its character
  comes out as U+FFFD, and the text is 'lossy'. A '?' in place of a byte is not
  told from a question mark: such a span stays as it is, and alone it is not found;
* U+FFFD inside a word or beside it, left by a legacy text decoded as UTF-8:
  found, not restorable;
* text in 16-bit units decoded with the wrong unit size: characters whose
  bytes are all ASCII text.

Null, empty and blank texts are not garbled and come out as they are. Every
row is judged by its own text, so copies agree.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: single-byte pages tried, the likeliest first
PAGES = ("cp1252", "cp1251", "cp1250", "cp437", "mac_roman", "cp850", "cp866", "koi8_r", "cp1254", "cp1253")
#: stands for a byte that is gone
LOST_BYTE = "\ufffd"


@lru_cache(maxsize=None)
def page_bytes(page: str) -> dict[str, int]:
    """Character -> byte for the upper half; undefined bytes stand for themselves (C1)."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(page)] = b
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0xA0):  # many decoders pass these through
        out.setdefault(chr(b), b)
    return out


def _set(page: str, low: int, high: int) -> str:
    return "[" + "".join(re.escape(c) for c, b in page_bytes(page).items() if low <= b <= high) + "]"


@lru_cache(maxsize=None)
def automaton(page: str) -> re.Pattern[str]:
    """Maximal runs of well-formed multibyte sequences, as the page shows them."""

    def s(low: int, high: int) -> str:
        return _set(page, low, high)

    def after(low: int, high: int) -> str:
        return s(low, high)[:-1] + LOST_BYTE + "]"

    c = after(0x80, 0xBF)
    two = s(0xC2, 0xDF) + c
    three = f"{s(0xE0, 0xE0)}{after(0xA0, 0xBF)}{c}|{s(0xE1, 0xEC)}{c}{c}|{s(0xED, 0xED)}{after(0x80, 0x9F)}{c}|{s(0xEE, 0xEF)}{c}{c}"
    four = f"{s(0xF0, 0xF0)}{after(0x90, 0xBF)}{c}{c}|{s(0xF1, 0xF3)}{c}{c}{c}|{s(0xF4, 0xF4)}{after(0x80, 0x8F)}{c}{c}"
    return re.compile(f"(?:{two}|{three}|{four})+")


def _decoded(page: str, span: str) -> str:
    """The span's characters; U+FFFD for each that lost a byte."""
    table = page_bytes(page)
    if LOST_BYTE not in span:
        return bytes(table[c] for c in span).decode("utf-8")
    out, at = [], 0
    while at < len(span):
        lead = table[span[at]]
        shown = span[at : at + (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)]
        out.append(LOST_BYTE if LOST_BYTE in shown else bytes(table[c] for c in shown).decode("utf-8"))
        at += len(shown)
    return "".join(out)


def _plain(c: str) -> bool:
    """A decoded character that needs no company: signs and Latin letters of everyday text."""
    return "\xa0" <= c <= "\u024f" or "\u2010" <= c <= "\u2122" or c in "\ufeff\ufffd"


def _possible(span: str, plain: str, before: str, after: str) -> bool:
    """False for spans that decode only to what no text holds, and for drawn boxes.

    Beside other characters C1 controls are allowed: a text decoded wrongly
    twice has them after the first step.
    """

    def unheard(o: int) -> bool:
        return 0x80 <= o < 0xA0 or 0xE000 <= o < 0xF900 or o >= 0xE0000 or (o & 0xFFFE) == 0xFFFE

    if all(unheard(ord(c)) for c in plain):
        return False
    if all("\u2500" <= c <= "\u257f" for c in span):
        drawn = "\u2500" <= before <= "\u257f" or "\u2500" <= after <= "\u257f"
        return not drawn and all(_plain(c) for c in plain)
    return True


#: how a span of sound text shows: letters, then marks that close a word, or a space that doesn't break and anything
_NATURAL = re.compile("[^\\W\\d_]+(?:[\u2026\u2019\u201d\xbb\u203a\u2013\u2014\xb7\xb0\xb2\xb3\xb9\xba\xaa\xae\xa9\u2122\u2022]*|\xa0.*)", re.S)


def _telling(span: str, decoded: str) -> bool:
    """Whether one of the span's characters of three or four bytes is damage even alone.

    All are but those whose bytes show as sound text: letters of one script and
    case with a mark that closes a word ('oubli\xe9\u2026\xbb'), as any page has them.
    """
    if LOST_BYTE in span:
        return True  # found by its lost byte
    at = 0
    for c in decoded:
        size = len(c.encode("utf-8"))
        shown, at = span[at : at + size], at + size
        if size < 3:
            continue
        letters = "".join(x for x in shown if x.isalpha())
        cased = not letters or letters.islower() or letters.isupper() or letters.istitle()
        scripts = {unicodedata.name(x, "").split(" ", 1)[0] for x in letters}
        if not (cased and len(scripts) < 2 and _NATURAL.fullmatch(shown)):
            return True
        # a symbol whose bytes are two letters and a mark ('\xe2\u0153\u201d')
        if unicodedata.category(c)[0] == "S" and not shown.isalpha() and shown[1].isalpha():
            return True
    return False


def _spans(page: str, text: str) -> list[tuple[int, int, str]]:
    """(start, end, decoded) of the page's spans; a lone letter of a rare script is no damage.

    That holds for characters of two bytes, and for longer ones that sound text can show.
    """
    found = [(m.start(), m.end(), p) for m in automaton(page).finditer(text) if _possible(m.group(), p := _decoded(page, m.group()), text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1])]
    blocks: dict[int, int] = {}
    for _, _, p in found:
        for c in p:
            blocks[ord(c) >> 7] = blocks.get(ord(c) >> 7, 0) + 1
    return [x for x in found if any(_plain(c) or blocks[ord(c) >> 7] > 1 for c in x[2]) or _telling(text[x[0] : x[1]], x[2])]


def decode_spans(text: str) -> tuple[str, bool]:
    """One step: in each region of spans that meet, the page decides that covers most of it, of equals the one that covers most of the text."""
    by_page = [spans for page in PAGES if (spans := _spans(page, text))]
    if not by_page:
        return text, False
    by_page.sort(key=lambda spans: -sum(b - a for a, b, _ in spans))  # stable: of equals the likelier page
    taken: list[tuple[int, int, str]] = []
    # region after region, over the spans of all pages in order of place
    region: list[list[tuple[int, int, str]]] = [[] for _ in by_page]
    end = -1
    for a, b, k, p in sorted((a, b, k, p) for k, spans in enumerate(by_page) for a, b, p in spans):
        if a > end:
            taken += max(region, key=lambda spans: sum(y - x for x, y, _ in spans))
            region = [[] for _ in by_page]
        region[k].append((a, b, p))
        end = max(end, b)
    taken += max(region, key=lambda spans: sum(y - x for x, y, _ in spans))
    parts, at = [], 0
    for a, b, p in taken:
        parts += [text[at:a], p]
        at = b
    return "".join([*parts, text[at:]]), True


#: characters a text of one page shows when read in another: page -> {shown: meant}
@lru_cache(maxsize=None)
def _swaps(page: str) -> dict[str, str]:
    out = {}
    for c, b in page_bytes(page).items():
        try:
            meant = bytes([b]).decode("cp1252")
        except UnicodeDecodeError:
            continue
        if meant != c:
            out[c] = meant
    return out


_WORD = re.compile(r"[^\W\d_]*[a-z\xdf-\xf6\xf8-\xff](?:[^\W\d_]|[\xb7\xaf\xb1\xb3\xb8\xbe\u02c6\u02d9\u02da\u02dc\u2030\u2320\u2321\u2229\u2261\u2248\u2264\u2265\u221a\u221e\xf7\ufb01\ufb02])+")
_SWAP_PAGES = ("cp1251", "mac_roman", "cp437", "cp850", "cp1250", "cp1253", "koi8_r", "cp866")
#: single signs of a wrong page, by what they must have been: a currency before digits, a degree, an apostrophe, a half
_SIGNS = (
    (re.compile(r"(?<![^\W\d_])[\u0408\u0402\xfa](?=\d)"), "\xa3\u20ac"),
    (re.compile(r"(?<=\d )[\u2591\u221e](?=C\b)"), "\xb0"),
    (re.compile(r"(?<=[a-z]n)[\xed\xc6](?=t\b)|(?<=[a-z])\xc6(?=(?:s|re|ll|ve|d)\b)"), "\u2019"),
    (re.compile(r"(?<=[a-z] )[\u03a9\u255c](?= [a-z])"), "\xbd"),
)
#: and quotes in pairs, within a line
_QUOTES = re.compile(r"(?<!\w)([\xec\xf4])(?=[A-Za-z])([^\n\xec\xee\xf4\xf6]*[A-Za-z.,!?\u2026])([\xee\xf6])(?!\w)")


def signs(text: str) -> tuple[str, bool]:
    """Single signs read in a wrong page, each put right by the page that has it for what it must have been."""

    def meant(shown: str, expected: str) -> str:
        return next((m for page in _SWAP_PAGES if (m := _swaps(page).get(shown)) and m in expected), shown)

    out = text
    for rx, expected in _SIGNS:
        out = rx.sub(lambda m: meant(m.group(), expected), out)
    out = _QUOTES.sub(lambda m: meant(m.group(1), "\u201c") + m.group(2) + meant(m.group(3), "\u201d"), out)
    return out, out != text


#: letters of other scripts that are drawn like Latin ones: a spelling trick, not damage
_LIKE = set("\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0456\u0458\u0455\u0410\u0412\u0415\u041a\u041c\u041d\u041e\u0420\u0421\u0422\u0425\u03bf\u03bd\u03b1\u03b9")


def _odd(word: str) -> set[str]:
    """Characters that don't belong in a Latin word written in lower case."""
    odd = set()
    for k in range(1, len(word)):
        before, c = word[k - 1], word[k]
        if c <= "\x7f" or not (before.islower() or before > "\u024f" or (c > "\u024f" and c.isalpha())):
            continue
        # a sign (such as a superscript) is out of place only between letters
        if c > "\u024f" or c.isupper() or (not c.isalpha() and word[k + 1 : k + 2].isalpha()):
            odd.add(c)
    if word[0] > "\u024f":
        odd.add(word[0])
    if word.lower() == "l\xb7l" or "l\xb7l" in word:
        odd.discard("\xb7")
    return odd


def swapped(text: str) -> tuple[str, bool]:
    """One page read as another: lower-case Latin words with letters that only the wrong page has."""
    score: dict[str, int] = {}
    words = [(m, odd) for m in _WORD.finditer(text) if not m.group().isascii() and (odd := _odd(m.group())) and any("a" <= c <= "z" for c in m.group())]
    decisive = False
    for page in _SWAP_PAGES:
        table = _swaps(page)
        for _, odd in words:
            if all((m := table.get(c)) and m.isalpha() and m.islower() for c in odd):
                score[page] = score.get(page, 0) + 1
                # of the look-alikes only two stand for letters that are frequent in Latin texts
                decisive = decisive or bool(odd - _LIKE) or (page == "cp1251" and odd <= {"\u0441", "\u0443"})
    if not (score and decisive):
        return signs(text)
    page = max(score, key=lambda p: score[p])
    table = _swaps(page)
    # letters no Latin text holds are the page's throughout; others only in damaged words
    sure = {c: m for c, m in table.items() if c > "\u024f" and c.isalpha()}
    parts, at = [], 0
    for m, odd in words:
        parts += [text[at : m.start()].translate(str.maketrans(sure)), "".join(table.get(c, c) if c in odd or c > "\u024f" else c for c in m.group())]
        at = m.end()
    return "".join([*parts, text[at:].translate(str.maketrans(sure))]), True


_ASCII = frozenset([9, 10, 13, *range(0x20, 0x7F)])


def units(text: str) -> tuple[str, bool]:
    """Runs of 16-bit units that are pairs of ASCII bytes, in either byte order."""
    if not re.search("[\u2000-\u7e7e]{8}", text):
        return text, False
    hit = False

    def fix(run: str) -> str:
        nonlocal hit
        for order in ("utf-16-le", "utf-16-be"):
            plain = run.encode(order, "surrogatepass")
            letters = sum(b in _ASCII and (chr(b).isalpha() or b in (32, 10)) for b in plain)
            if letters >= 0.8 * len(plain) and plain.count(32) * 25 >= len(plain):
                hit = True
                return plain.decode("latin-1")
        return run

    # maximal runs of characters both of whose bytes are ASCII text
    parts, run = [], []
    for c in text:
        o = ord(c)
        if o > 0xFF and o <= 0xFFFF and (o >> 8) in _ASCII and (o & 0xFF) in _ASCII:
            run.append(c)
            continue
        if run:
            parts.append(fix("".join(run)) if len(run) >= 10 else "".join(run))
            run = []
        parts.append(c)
    if run:
        parts.append(fix("".join(run)) if len(run) >= 10 else "".join(run))
    return "".join(parts), hit


_LOST = re.compile("\ufffd")
_C1 = re.compile("[\x80-\x84\x86-\x9f]")
_QUOTED = re.compile("[\"'\u201c\u2018\u00ab(]\\s?\ufffd\\s?[\"'\u201d\u2019\u00bb)]")
_SUSPECT = re.compile("[\x80-\u02ff\u0370-\u058f\u2000-\u2008\u200e-\u200f\u2020-\u2023\u2030-\u203f\u2070-\u2e7f\u3100-\u3fff\ufb00-\ufb06\ufffd]|[\u2000-\u7e7e]{10}")


def repair(text: str | None) -> tuple[str | None, str]:
    """(text, status): 'sound', 'restored', or 'lossy' where some of the original is gone."""
    if not text or text.isascii() or not _SUSPECT.search(text):
        return text, "sound"
    out, garbled, hit = text, False, True
    while hit:
        out, hit = decode_spans(out)
        garbled |= hit
    if not garbled:
        out, garbled = units(out)
    if not garbled:
        out, garbled = swapped(out)
    lost = bool(_LOST.search(_QUOTED.sub("", out)) or _C1.search(out))
    if not (garbled or lost):
        return text, "sound"
    return out, "lossy" if lost or out == text else "restored"


def repair_corpus(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``id_col``, status, restored): every row, with its text after the repair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                done = [repair(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for _, s in done], pa.string()), pa.array([t for t, _ in done], pa.string())], names=[id_col, "status", "restored"])

    both = df.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return both.mapInArrow(run, f"{id_col} bigint, status string, restored string")
