"""Text that looks the same in one consistent form (problem 2).

Each token's letters carry the set of scripts in which their shape can be
written. The sets are intersected over the token: a token whose own scripts
differ (mixed-script) or that could be another script's word letter by letter
(whole-script confusable) is spelled in the first script of the intersection.
Where no script can spell the whole token, each shape takes its first script.
The choice depends on shapes alone, so two tokens that look the same always
get the same spelling, and the normalized text is the key of its look.

Shapes are the confusables of the Unicode standard, as the ICU library beside
Spark has them: letters or signs of several scripts with one skeleton and one
case are one shape (``shapes``). A few letters whose shape is settled here
differently, or that must work without the library, are in ``SHAPES``. Two
letters of one script stay apart, but for phonetic forms of Latin letters.

Other forms first: full- and half-width, presentation and font variants and
letter ligatures lose their variant; characters without shape go, except a
joiner or non-joiner right after a virama; every space character of any width
is U+0020. Letters are respelled without their accents (NFD), so an accent is
no part of a shape; canonical composition (NFC) comes last. Tabs, line breaks,
the number of spaces, superscripts, case and punctuation stay.

Null stays null and matches nothing; texts without a letter or digit are
normalized but are never paired. Repeated rows are rows of their own.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import meet

#: scripts in the order in which a spelling is chosen; all others follow by name
ORDER = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "TELUGU", "KANNADA")
#: a shape: script -> its letter, in the order of choice
Shape = dict[str, str]
#: Letters of one shape. Columns: Latin, Greek, Cyrillic, Armenian ('-' where the script has none).
SHAPES = """
A Α А -
B Β В -
C Ϲ С -
E Ε Е -
F Ϝ - -
G - Ԍ -
H Η Н -
I Ι І -
J Ϳ Ј -
K Κ К -
M Μ М -
N Ν - -
O Ο О Օ
P Ρ Р -
Q - Ԛ -
S - Ѕ Տ
T Τ Т -
U - - Ս
V - Ѵ -
W - Ԝ -
X Χ Х -
Y Υ Ү -
Z Ζ - -
- Γ Г -
- Π П -
- Φ Ф -
a α а -
c ϲ с -
d - ԁ -
e - е -
g - - ց
h - һ հ
i ι і -
j ϳ ј -
l - ӏ -
n - - ո
o ο о օ
p ρ р -
q - ԛ զ
s - ѕ -
u - - ս
v ν ѵ -
w - ԝ -
x - х -
y - у -
"""
#: Telugu and Kannada letters and signs of one shape; the two
#: blocks are laid out alike, the second 0x80 after the first.
TELUGU_KANNADA = "ంఃఅఆఇఒఓఔజఞణయఱల౦౧౨౯"
#: Latin letters that are drawn like another Latin letter
LATIN_TWINS = {"ɑ": "a", "ɡ": "g", "ı": "i", "ʜ": "н"}

_LETTER_TAGS = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")


def _ordered(shape: Shape) -> Shape:
    return dict(sorted(shape.items(), key=lambda x: (ORDER.index(x[0]) if x[0] in ORDER else len(ORDER), x[0])))


def base_shapes() -> dict[str, Shape]:
    """Letter -> its shape, of the letters settled here."""
    out: dict[str, Shape] = {}
    for line in SHAPES.split("\n"):
        shape = {script: c for script, c in zip(ORDER, line.split()) if c != "-"}
        out |= dict.fromkeys(shape.values(), shape)
    for c in TELUGU_KANNADA:
        shape = {"TELUGU": c, "KANNADA": chr(ord(c) + 0x80)}
        out |= dict.fromkeys(shape.values(), shape)
    return out


@lru_cache(maxsize=1)
def _settled() -> frozenset[str]:
    return frozenset(base_shapes())


def _phonetic(c: str) -> bool:
    """Latin letters of phonetic alphabets, which no ordinary word holds beside the letter they look like."""
    return "\u0250" <= c <= "\u02af" or "\u1d00" <= c <= "\u1dbf" or "\ua720" <= c <= "\ua7ff" or "\uab30" <= c <= "\uab6f"


def _case(c: str, skeleton: str) -> str:
    """The bucket in which letters of one skeleton are one shape; letters without case go by the skeleton's, Lisu ones are capitals."""
    cat = unicodedata.category(c)
    if cat == "Lo" and len(skeleton) == 1 and unicodedata.category(skeleton) in ("Lu", "Ll"):
        return "Lu" if _script(c) == "LISU" else unicodedata.category(skeleton)
    return f"{cat}{unicodedata.combining(c)}" if cat[0] == "M" else cat  # marks of another class are put in another order


def shapes(spark: SparkSession) -> dict[str, Shape]:
    """Letter -> its shape, of all confusable letters and signs; made on the driver in one call, a few thousand entries."""
    known = getattr(spark.sparkContext, "_lexspark_shapes", None)
    if known is not None:
        return known
    out = base_shapes()
    every = [c for c in map(chr, range(0x21, 0x20000)) if unicodedata.category(c) in ("Lu", "Ll", "Lo", "Mc", "Mn") and not unicodedata.decomposition(c) and simple_form(c) == c]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    skeletons = checker.getSkeleton("\n".join(every)).split("\n")
    groups: dict[tuple[str, str], list[str]] = {}
    for c, skeleton in zip(every, skeletons):
        groups.setdefault((skeleton, _case(c, skeleton)), []).append(c)
    for letters in groups.values():
        settled = [out[c] for c in letters if c in out]
        shape = dict(settled[0]) if settled else {}
        added: list[str] = []
        for c in letters:
            script = _script(c)
            if c in out or not script:
                continue
            if script not in shape:
                shape[script] = c
                added.append(c)
            elif _phonetic(c):
                added.append(c)
        if added and len(shape) > 1 or len(added) > 1:
            shape = _ordered(shape)
            # the letters settled in one shape with these are of the same one from now on
            out |= dict.fromkeys((*shape.values(), *added), shape)
    spark.sparkContext._lexspark_shapes = out
    return out


#: letters and marks of several scripts (Common, Inherited): any script can have them
_SHARED = regex.compile(r"[\p{Script=Common}\p{Script=Inherited}]")


def _script(c: str) -> str:
    """The script of a letter or mark, by its name; '' for what several scripts share."""
    name = unicodedata.name(c, "")
    cat = unicodedata.category(c)
    if cat[0] == "L" or (cat[0] in "MN" and not name.startswith(("COMBINING", "DIGIT", "SUPERSCRIPT", "VULGAR"))):
        return "" if _SHARED.match(c) else name.split(" ", 1)[0]
    return ""


def simple_form(c: str) -> str:
    """One character without width, font, ligature or invisible variants."""
    cat = unicodedata.category(c)
    if c in "\t\n\r\x0b\x0c\x85\u2028\u2029":
        return c
    if cat == "Zs":
        return " "
    if c in LATIN_TWINS:
        return LATIN_TWINS[c]
    o = ord(c)
    if cat == "Cf" or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF:
        return "" if not (0x600 <= o <= 0x605 or o in (0x6DD, 0x70F, 0x8E2, 0x110BD)) else c
    if c in _settled():
        return c  # such as the lunate sigma, which is c and no other sigma
    d = unicodedata.decomposition(c)
    if d.startswith(_LETTER_TAGS) or (d.startswith("<compat>") and cat in ("Ll", "Lu", "Lo", "Lt")):
        return unicodedata.normalize("NFKC", c)
    return c


class _Forms(dict):
    """str.translate table that works out each character once."""

    def __missing__(self, o: int):
        c = chr(o)
        form = c if c in "\u200c\u200d" else simple_form(c)  # joiners need their neighbour
        self[o] = form
        return form


@lru_cache(maxsize=4)
def _letters_of(scripts: frozenset[str]) -> frozenset[str]:
    return frozenset(c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c)[0] in "LM" and _script(c) in scripts)


def _ranges(chars: set[str]) -> str:
    """A character class of the characters, as ranges."""
    out: list[list[int]] = []
    for o in sorted(map(ord, chars)):
        if out and out[-1][1] == o - 1:
            out[-1][1] = o
        else:
            out.append([o, o])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out) + "]"


#: scripts that are written together in one word
_TOGETHER = {"CJK": "HAN", "HIRAGANA": "HAN", "KATAKANA": "HAN", "HANGUL": "HAN", "BOPOMOFO": "HAN"}


def normalizer(letters: dict[str, Shape]) -> Callable[..., str]:
    """A function from text to its consistent form; built once per task.

    Given a list of two numbers, it adds the respelled or alien tokens to them:
    those that mix scripts, and those that another script could write whole.
    """
    forms = _Forms()
    scripts: dict[str, str] = {}
    sets = {c: frozenset(shape) for c, shape in letters.items()}
    first = {c: next(iter(shape.values())) for c, shape in letters.items()}
    rank = {script: k for k, script in enumerate(_ordered({x: "" for shape in letters.values() for x in shape}))}
    # characters that are their own form, whatever stands beside them
    plain = re.compile("[\t\n\r\x20-\x7e।॥‐-‧ऀ-नप-रलव-ऻऽ-ॗఀ-౅ేొ-్ౠ-౿一-鿿฀-าิ-າ\xe0-\xf6\xc0-\xcf\xd1-\xd6\xf8-\xff\xd8-\xdf]*")
    joiner = re.compile("([्্੍્୍்్್്්្္])[\u200c\u200d]*?([\u200c\u200d])[\u200c\u200d]*|[\u200c\u200d]+")
    # characters without which a token keeps its spelling: Latin and Telugu come first in their shapes, so
    # only a letter of another script that shares shapes, or one that isn't the first of its own, changes a token
    some = {c for c in letters if first[c] != c} | _letters_of(frozenset(rank) - {"LATIN", "TELUGU"})
    basic = re.compile(_ranges({c for c in some if c <= "\uffff"})).search
    # characters beyond the basic plane would make the class slow; all of them are looked at
    beyond = re.compile("[\U00010000-\U0010ffff]").search

    def special(x: str) -> bool:
        return basic(x) is not None or beyond(x) is not None

    token = re.compile(r"[^\s!-/:-@\[-`{-~।॥‐-‧、-】]+")

    def script_of(c: str) -> str:
        s = scripts.get(c)
        if s is None:
            s = scripts[c] = _script(c)
        return s

    def respelled(word: str) -> tuple[str, bool]:
        """The spelling, and whether one script has all of it."""
        able: frozenset[str] | None = None
        for c in word:
            can = sets.get(c)
            if can is None:
                s = script_of(c)
                if not s:
                    continue
                can = frozenset((s,))
            able = can if able is None else able & can
        if able:
            script = min(able, key=lambda x: rank.get(x, len(rank)))
            return "".join(letters[c].get(script, c) if c in letters else c for c in word), True
        # no script spells all of it: every shape by itself
        return "".join(first.get(c, c) for c in word), False

    def normalize(text: str, count: list[int] | None = None) -> str:
        if plain.fullmatch(text) and (count is None or not special(text)):
            if count is not None and not text.isascii():
                for word in token.findall(text):
                    count[0] += mixed(word)
            if not special(text):
                return text
        text = text.translate(forms)
        if "\u200c" in text or "\u200d" in text:
            text = joiner.sub(lambda m: (m.group(1) + m.group(2)) if m.group(1) else "", text)
        text = unicodedata.normalize("NFC", text)
        if special(text):

            def respell(m: re.Match[str]) -> str:
                word = m.group()
                new, whole = respelled(word) if special(word) else (word, False)
                if count is not None:
                    mixes = mixed(word)
                    count[0] += mixes
                    count[1] += whole and new != word and not mixes
                return new

            text = unicodedata.normalize("NFC", token.sub(respell, unicodedata.normalize("NFD", text)))
        elif count is not None and not text.isascii():
            for word in token.findall(text):
                count[0] += mixed(word)
        return text

    def mixed(word: str) -> bool:
        if word.isascii():
            return False
        found = {_TOGETHER.get(s, s) for s in map(script_of, word) if s}
        return len(found) > 1

    return normalize


def normalize_corpus(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys``, normalized, changed (whether the text had another form), mixed_script and whole_script.

    The last two count the tokens whose letters are of several scripts, and
    those of one script that were respelled as another script's word; null texts have none.
    """
    letters = shapes(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normalize = normalizer(letters)
        for batch in batches:
            old = batch.column(batch.num_columns - 1).to_pylist()
            new, mixes, wholes = [], [], []
            for t in old:
                count = [0, 0]
                new.append(None if t is None else normalize(t, count))
                mixes.append(count[0])
                wholes.append(count[1])
            cells = [pa.array(new, pa.string()), pa.array([a != b for a, b in zip(old, new)], pa.bool_()), pa.array(mixes, pa.int64()), pa.array(wholes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cells], names=[*keys, "normalized", "changed", "mixed_script", "whole_script"])

    kept = df.select(*keys, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{schema}, normalized string, changed boolean, mixed_script bigint, whole_script bigint")


def _signed(raw: bytes) -> int:
    return int.from_bytes(raw, "big", signed=True)


def look_keys(df: DataFrame) -> DataFrame:
    """(field, id, k1, k2, t): the 128-bit hash of the look and a 64-bit one of the stored text.

    ``df`` has field, rec_id and text. Texts without a letter or digit are left
    out. ``t`` only tells texts of one look apart.
    """
    letters = shapes(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normalize = normalizer(letters)
        word = re.compile(r"[^\W_]")
        wide, narrow = xxhash.xxh3_128_digest, xxhash.xxh3_64_digest
        for batch in batches:
            rows: list[int] = []
            cells: list[list[int]] = [[], [], []]
            for i, t in enumerate(batch.column(2).to_pylist()):
                form = normalize(t)
                if not word.search(form):
                    continue
                look = wide(form.encode("utf-8", "surrogatepass"))
                rows.append(i)
                for c, v in zip(cells, (look[:8], look[8:], narrow(t.encode("utf-8", "surrogatepass")))):
                    c.append(_signed(v))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, pa.int64()) for c in cells)], names=["field", "id", "k1", "k2", "t"])

    texts = df.where(F.col("text").isNotNull()).select("field", "rec_id", "text")
    return texts.mapInArrow(run, "field string, id bigint, k1 bigint, k2 bigint, t bigint")


def same_looking(keys: DataFrame) -> DataFrame:
    """(field, first_id, other_id): rows that look like an earlier row but are written otherwise.

    Groups are found by combining aggregation; only groups with two texts or
    more meet their rows again, hot ones where the rows are (see ``meet``). An id
    that stands in several rows has the text of one of them as first text.
    """
    key = ["field", "k1", "k2"]
    groups = keys.groupBy(*key).agg(F.min("id").alias("first_id"), F.min_by("t", "id").alias("first_t"), F.min("t").alias("low"), F.max("t").alias("high"))
    mixed = groups.where(F.col("low") != F.col("high")).select(*key, "first_id", "first_t")
    other = (F.col("id") != F.col("first_id")) & (F.col("t") != F.col("first_t"))
    return meet(keys, mixed, key, "k1").where(other).select("field", "first_id", F.col("id").alias("other_id")).distinct()
