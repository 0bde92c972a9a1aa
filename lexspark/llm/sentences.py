"""Sentence boundaries across languages and scripts (problem 4).

The sentence-break rules of the Unicode standard, by character property:
terminators of every script (STerm), ambiguous full stops (ATerm), opening and
closing quotes and brackets (Close), marks before which a sentence goes on
(SContinue), separators that end a paragraph, and no break before a lower-case
continuation. The sets are read from the property tables. They are tailored by

* abbreviations of each language, initials, numbers, dates and addresses, whose
  full stop doesn't end a sentence;
* a stack of open quotes and brackets: a mark before the closing one ends the
  sentence only if the sentence doesn't go on after it (who said it, or a
  bracket within a sentence);
* pauses: dots right before a letter, or before a lower-case word;
* missing spaces after a full stop;
* a blank line always ends a unit, a single line break is white space;
* Thai: a space or line break ends a sentence, unless it stands next to a
  number or after the repetition mark.

Null, empty and blank texts have no sentence. A text without any terminator is
one sentence a paragraph. Texts are scanned whole; equal rows give equal rows.
Positions are code points.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import per_text

#: Abbreviations that stand before the rest of their sentence.
NEVER_LAST = frozenset(
    """
    dr mr mrs ms prof rev hon st mt sr sra srta don dña mme mlle mm hr fr frau herr dipl ing
    vs e.g i.e cf viz al eg ie esp incl resp
    bzw z.b u.a d.h o.ä v.a s.o s.u vgl evtl ggf inkl zzgl bspw sog
    p.ex av env apr c.-à-d
    p.ej ee avda c/ pza
    uda smt kum km.
    డా డాక్టర్ ఉదా శ్రీ కుమారి ప్రొ చి సౌ
    डॉ उदा प्रो श्री सौ कु पं
    ಡಾ ಉದಾ ಶ್ರೀ ಪ್ರೊ
    டாக்டர் எ.கா உதா திரு
    """.split()
)
#: Abbreviations that stand before a number or a code.
BEFORE_NUMBER = frozenset(
    """
    no nos nr nrn núm num n.º pág págs pag art arts fig figs vol vols p pp ch chap sec ex eq tab tel ph
    approx ca aprox env bd s abs kap rs re inr usd eur jan feb mar apr jun jul aug sep sept oct nov dec
    నం సం రూ పే క్ర ఫో తే
    नं क्र रु पृ सं अ
    ಸಂ ರೂ ನಂ ಪು ಕ್ರ
    எண் ரூ பக் தொ
    """.split()
)
#: of those, the ones that are words too and may end a sentence before anything else
ALSO_WORDS = frozenset("no art fig p s ex ch tab re mar jun dec ca sec अ".split())
#: Abbreviations that may end a sentence, if a new one begins after them.
MAYBE_LAST = frozenset("etc usw u.s u.k u.n uu ee.uu j.-c v.chr n.chr a.m p.m inc ltd co corp jr ph.d b.a m.a rd st ave blvd ln str km kg ఇ.టి.సి వగైరా ఆది मो इ".split())
#: Words that take up what was quoted (said, saying, so, that), in Telugu, Kannada, Tamil, Hindi and Marathi.
QUOTATIVES = frozenset(
    """
    అని అంటూ అన్నారు అన్నాడు అన్నది అనే అనగా
    ಎಂದು ಎಂದರು ಎಂದನು ಎನ್ನುತ್ತಾ ಅಂತ
    என்று என்றார் என்றாள் எனக் என
    कहकर कहते बोलकर म्हणून म्हणाले म्हणाला म्हणाली
    """.split()
)
#: Words that point back to it if who said it, or a verb of saying, comes next.
POINTERS = frozenset("ऐसा यह यों यूँ असे असं अशी".split())
SAYING = frozenset("उसने उन्होंने इसने इन्होंने मैंने हमने किसी त्यांनी त्याने तिने मी आम्ही कहा कहता कहते कहती लिखा पूछा बोला बोले बोली बताया सोचा सांगितले म्हटले विचारले लिहिले बोलले".split())
#: Who said it, after a quote without a space.
_SAYS = re.compile(r"[一-鿿]{1,6}?[说道问答喊叫写]|[他她它我你]们?回答")
#: Pronouns with which romanized Telugu opens a sentence in lower case
STARTERS = frozenset("aayana ayana ame aame atanu".split())
_MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
#: Devanagari letter names, which are initials before a full stop
_LETTER_NAMES = frozenset("ए बी सी डी ई एफ जी एच आई जे के एल एम एन ओ पी क्यू आर एस टी यू वी डब्ल्यू एक्स वाई जेड".split())

_CHARS = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x20000))))


def _with(value: str) -> str:
    """The characters of a value of the sentence-break property."""
    return "".join(regex.findall(rf"\p{{Sentence_Break={value}}}", _CHARS))


#: opening mark -> closing mark: the quotes in use, and every bracket whose partner follows it
_OPEN = {c: chr(ord(c) + 1) for c in _with("Close") if unicodedata.category(c) == "Ps" and unicodedata.category(chr(ord(c) + 1)) == "Pe"}
_OPEN |= {"(": ")", "[": "]", "{": "}", "“": "”", "‘": "’", "«": "»", "„": "“", "‚": "‘", "‹": "›"}
_BRACKETS = frozenset(_OPEN[c] for c in _OPEN if unicodedata.category(c) == "Ps" and "QUOTATION" not in unicodedata.name(c) and c not in "「『《〈")  # closing marks within which nothing ends
_ENDING = frozenset(_OPEN.values()) - {"“", "‘"}  # closing marks whose partner need not be seen
_CLOSERS = frozenset(_OPEN.values()) | {'"', "'"}
_STERM = _with("STerm") + "﹒．"
_TERM = "." + _STERM + "…‥․"
_TERMS = frozenset(_TERM)
_CONTINUE = frozenset(_with("SContinue")) | frozenset("–—)")
_COMMA = _CONTINUE - frozenset("-–—:：)︓﹕")


def _events(most: str) -> re.Pattern[str]:
    """Runs of terminators, quotes and brackets, up to the character ``most``."""
    terms, marks = (re.escape("".join(c for c in x if c <= most)) for x in (_TERM, [*_OPEN, *_OPEN.values()]))
    return re.compile(f"[{terms}]+|[{marks}\"']")


#: a class within the basic plane is much faster; most paragraphs need no other
_EVENT, _EVENT_BASIC = _events("\U0010ffff"), _events("\uffff")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*|\r\n[^\S\n]*\r\n\s*|[\u2029]+")
_SPACE = re.compile(r"\s*")
_THAI_BREAK = re.compile(r"(?<=[ก-ฺเ-ๅ็-๎])([\"”’')»]*)\s+(?![\s\d๐-๙])")
_EDGES = frozenset("\"'“”‘’«»„()[]{}")
_WORD = re.compile(r"[^\W\d_]+")
_ANY = re.compile(r"\w+")
_NEXT = re.compile(r"\S+")
#: a label without a space before its value ('tel:', 'mail:') opens a unit of its own
_LABEL = re.compile(r"[a-z]+:\S")
_REST = re.compile(r"[^\s.]*(\.?)")
_INDIC = re.compile("[ऀ-ൿ]")
_CLUSTER = re.compile("[ऀ-ൿ](?:[ऀ-ःऺ-ॏॢॣঁ-ঃ়-্ਁ-ਃ਼-ੑઁ-ઃ઼-્ଁ-ଃ଼-ୗஂா-்ఀ-ఄా-ౖಁ-ಃ಼-ೖഀ-ഃാ-്\u200c\u200d]|(?<=[्್్])[ऀ-ൿ])*")


def _clusters(piece: str) -> int:
    return len(_CLUSTER.findall(piece))


_STRIP = ".,;:!?।॥'\"”’"


def _goes_on(text: str, after: int, b: int) -> bool:
    """Whether the sentence that holds a quote goes on with who said it."""
    first = _NEXT.match(text, after, b)
    word = first.group().strip(_STRIP) if first else ""
    if word not in POINTERS:
        return word in QUOTATIVES
    second = _NEXT.match(text, _SPACE.match(text, first.end(), b).end(), b)
    return second is not None and first.group()[-1] not in _TERMS and second.group().strip(_STRIP) in SAYING


def _starter(text: str, after: int) -> bool:
    word = _WORD.match(text, after)
    return word is not None and word.group() in STARTERS


def _full_stop(text: str, start: int, word: int, at: int, after: int, b: int) -> bool:
    """Whether the single full stop at ``at`` ends the sentence.

    ``word``: where the run of characters before it begins; ``after``: the next character that isn't white space.
    """
    spaced = after > at + 1
    nxt = text[after]
    token = text[max(start, word) : at]
    if not spaced:
        return _unspaced(text, at, nxt, token, b)
    if len(token) == 1 and token.isupper() and nxt.isupper():
        return False  # an initial
    bare = token.lower().lstrip("-–—*•(")
    last = bare.rsplit(".", 1)[-1]
    if bare in NEVER_LAST or (last in NEVER_LAST and "." not in bare):
        return False
    if bare in BEFORE_NUMBER:
        if nxt.isdigit() or nxt in "#([" or (nxt.isupper() and any(map(str.isdigit, _NEXT.match(text, after).group()))):
            return False
        return bare in ALSO_WORDS and not nxt.islower()
    if bare in ("p", "p.") and text.startswith("ex.", after) or (bare == "ex" and _before(text, start, word) == "p."):
        return False
    if bare == "av" and text.startswith("J", after):
        return False
    new = nxt.isupper() or nxt in _OPEN or nxt in "\"'¿¡"
    if bare in MAYBE_LAST:
        return new
    if not bare:
        return True
    if _INDIC.match(bare) or _INDIC.search(bare[-1]):
        if "." in bare:
            if all(0 < _clusters(p) <= 3 for p in bare.split(".") if p):
                return False
        elif _clusters(bare) == 1 and len(_CLUSTER.findall(bare)[0]) == len(bare):
            if "ऀ" <= bare[0] < "ঀ":
                return bare not in _LETTER_NAMES
            return False
        return True
    if bare[-1].isdigit():
        if token == text[start:at].strip() and len(token) <= 3:
            return False  # the number of a list item
        if nxt.islower():
            return _LABEL.match(text, after) is not None or (_starter(text, after) and not (token.isdigit() and len(token) <= 2))
        if token.isdigit() and len(token) <= 2:
            month = _ANY.match(text, after)
            return not (month and month.group().lower() in _MONTHS)
        return True
    if "." in bare and all(len(p) <= 2 for p in bare.split(".")):
        return False if nxt.islower() else new and bare not in NEVER_LAST and len(bare) > 3 and not re.fullmatch(r"(?:\w\.)+\w", token)
    if nxt.islower():
        return _starter(text, after) or _LABEL.match(text, after) is not None
    return True


def _before(text: str, start: int, at: int) -> str:
    """The word before ``at``, white space left out."""
    k = at
    while k > start and text[k - 1].isspace():
        k -= 1
    a = k
    while a > start and not text[a - 1].isspace():
        a -= 1
    return text[a:k].lower()


class _Stack:
    """Open quotes and brackets: (closing mark, where it opened, whether an introduction came before)."""

    def __init__(self):
        self.open: list[tuple[str, int, bool]] = []
        self.at: dict[str, list[int]] = {}  # closing mark -> its places in ``open``

    def push(self, entry: tuple[str, int, bool]) -> None:
        self.at.setdefault(entry[0], []).append(len(self.open))
        self.open.append(entry)

    def close(self, mark: str) -> tuple[str, int, bool] | None:
        """The innermost entry that the mark closes, with all within it closed too; None if there is none."""
        places = self.at.get(mark)
        if not places:
            return None
        place = places[-1]
        entry = self.open[place]
        for x, _, _ in self.open[place:]:
            self.at[x].pop()
        del self.open[place:]
        return entry

    def holds(self, mark: str) -> bool:
        return bool(self.at.get(mark))

    def innermost(self) -> str:
        return self.open[-1][0] if self.open else ""

    def clear(self) -> None:
        self.open.clear()
        self.at.clear()


def _unspaced(text: str, at: int, nxt: str, token: str, b: int) -> bool:
    """A full stop with no space after it."""
    if nxt.isdigit() or not (nxt.isalpha() or nxt in "“‘«„\"'¿¡@(" or nxt.isupper()):
        return False
    if "://" in token or "@" in token or token.lower().startswith("www."):
        return False
    if not token:
        return nxt.isalpha() and nxt.isupper()
    before = token[-1]
    if nxt in "“‘«„\"'¿¡@(":
        return token.lower() not in NEVER_LAST and token.lower() not in BEFORE_NUMBER and len(token) > 1
    piece = token.rsplit(".", 1)[-1]
    if _INDIC.match(before):
        if token.lower() in NEVER_LAST or token in BEFORE_NUMBER or "." in token and all(_clusters(p) <= 3 for p in token.split(".")):
            return False
        end = _REST.match(text, at + 1, b)
        if _clusters(piece) <= 2 and end.group(1) and _clusters(end.group()) <= 3:
            return False  # an abbreviation with inner full stops
        return True
    if "一" <= before <= "鿿":
        return True
    return nxt.isupper() and len(piece) > 1 and (piece[-1].islower() or piece[-1].isdigit()) and "." not in token


def sentence_ends(text: str) -> list[int]:
    """End positions of the sentences of ``text``, in order."""
    ends: list[int] = []
    a = 0
    for blank in _BLANK.finditer(text):
        _paragraph(text, a, blank.start(), ends)
        a = blank.end()
    _paragraph(text, a, len(text), ends)
    return ends


def _paragraph(text: str, a: int, b: int, ends: list[int]) -> None:
    while b > a and text[b - 1].isspace():
        b -= 1
    start = _SPACE.match(text, a, b).end()
    if start >= b:
        return
    cuts: list[int] = []
    highest = max(text[start:b])
    if "฀" < highest and re.search("[ก-ฮ]", text[start:b]):
        cuts = [m.end(1) for m in _THAI_BREAK.finditer(text, start, b) if text[m.start() - 1] != "ๆ"]
    stack = _Stack()
    at = start
    cut = 0
    word = seen = start  # where the run of characters before a full stop begins, and how far that is known
    for m in (_EVENT if highest > "\uffff" else _EVENT_BASIC).finditer(text, start, b):
        i = m.start()
        while cut < len(cuts) and cuts[cut] <= i:
            ends.append(cuts[cut])
            cut += 1
            start = _SPACE.match(text, ends[-1], b).end()
            stack.clear()
        if text[i] == ".":
            k = i
            while k > seen and not (text[k - 1] in _EDGES or text[k - 1].isspace()):
                k -= 1
            word, seen = k if k > seen else word, i
        if i < at:
            continue
        c = text[i]
        if c not in _TERMS:
            _quote(text, start, i, b, stack)
            continue
        j = m.end()
        # closing quotes and brackets, and marks after them, belong to the sentence
        closed: list[tuple[str, int, bool]] = []
        k = j
        while k < b:
            x = text[k]
            if x in _CLOSERS and stack.holds(x):
                closed.append(stack.close(x))
                k += 1
            elif x in _TERMS and (closed or x != "."):
                k += 1
            elif x in "  \u202f" and k + 1 < b and text[k + 1] in "»?!" and (text[k + 1] != "»" or stack.holds("»")):
                k += 1
            elif x in _ENDING and k == j and not stack.open and not (x == "’" and text[k + 1 : k + 2].isalpha()):
                k += 1  # a closing mark whose partner was not seen
            else:
                break
        at = k
        if k >= b:
            break
        after = _SPACE.match(text, k, b).end()
        nxt = text[after]
        spaced = after > k
        run = text[i:j]
        late = text[k - 1] in _TERMS and closed  # a mark after the closing quote decides like one without quotes
        if closed and not late:
            quote = next((q for q in closed if q[0] not in _BRACKETS), None)
            if quote is None:
                end = closed[-1][1] <= start
            elif stack.innermost() in _BRACKETS:
                end = False
            else:
                _, opened, intro = quote
                latin = text[i - 1 : i].isascii() or text[i - 1 : i].islower() or text[i - 1 : i].isupper()
                if _goes_on(text, after, b):
                    end = False
                elif not spaced and _SAYS.match(text, k, b):
                    end = intro
                elif nxt.islower():
                    end = intro or (not latin and not opened <= start) or _starter(text, after)
                elif nxt in _CONTINUE:
                    end = False
                else:
                    end = True
        elif stack.innermost() in _BRACKETS:
            end = False  # within brackets
        elif run in ("...", "…", "……", "‥") or (run.startswith("..") and set(run) == {"."}):
            before = text[i - 1 : i]
            if not spaced:
                end = nxt in "“‘«„\"'「『"
            else:
                end = not (nxt.islower() and (before.islower() or before.isascii())) or _starter(text, after)
                end = end and nxt not in ",;:"
        elif run == "." and not closed:
            end = _full_stop(text, start, word, i, after, b) if k == j else True
        elif run == "．" and not spaced and nxt.isdigit() or run == "．" and text[i - 1 : i].isdigit() and nxt.isdigit() and not spaced:
            end = False
        else:
            end = spaced or not (nxt.isascii() and (nxt.islower() or nxt.isdigit() or nxt in "=&/%#_-+,;:"))
            if nxt in _COMMA:
                end = False
        if end:
            ends.append(k)
            start = after
            stack.clear()
    for place in cuts[cut:]:
        if place > start:
            ends.append(place)
            start = _SPACE.match(text, place, b).end()
    if start < b:
        ends.append(b)


def _quote(text: str, start: int, i: int, b: int, stack: _Stack) -> None:
    """Keep the stack of open quotes and brackets."""
    c = text[i]
    before = text[i - 1] if i > start else " "
    after = text[i + 1] if i + 1 < b else " "
    if c == "'" or c == "’":
        if before.isalpha() and after.isalpha():
            return  # an apostrophe
        if stack.holds(c) and not after.isalpha():
            stack.close(c)
            return
        if c == "’" or not (before.isspace() or before in _OPEN or before in _TERMS) or after.isspace():
            return
        closing = "'"
    elif stack.holds(c):
        stack.close(c)
        return
    elif c == '"':
        closing = '"'
    elif c in _OPEN:
        closing = _OPEN[c]
    else:
        return
    k = i - 1
    while k >= start and text[k].isspace():
        k -= 1
    stack.push((closing, i, k >= start and text[k] in ",:，：،"))


def sentences(df: DataFrame) -> DataFrame:
    """(field, rec_id, end_pos): the end of every sentence of every record."""

    def make():
        return lambda text: [(e,) for e in sentence_ends(text)]

    return per_text(df, make, "field string, rec_id bigint, end_pos bigint", ["field", "rec_id"], [("end_pos", pa.int64())])


def sentence_texts(df: DataFrame) -> DataFrame:
    """(field, rec_id, sent_idx, start_pos, end_pos, sentence)."""

    def make():
        def scan(text: str) -> Iterator[tuple]:
            a = 0
            for n, e in enumerate(sentence_ends(text)):
                a = _SPACE.match(text, a, e).end()
                yield n, a, e, text[a:e]
                a = e

        return scan

    return per_text(df, make, "field string, rec_id bigint, sent_idx bigint, start_pos bigint, end_pos bigint, sentence string", ["field", "rec_id"], [("sent_idx", pa.int64()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("sentence", pa.string())])
