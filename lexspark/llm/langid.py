"""Missing or wrong language labels, and texts of several languages (problem 5).

The script of a word narrows its languages; within Latin and Devanagari a word
is scored by character n-grams and by the frequent words of each language. A
Viterbi pass over the words of a text finds the labelling of least cost, with
a high penalty for a switch within a sentence and a low one between sentences,
so single foreign words keep the language around them while foreign sentences
don't. Sentences of two words or more in a script that the language around them
doesn't use, and the cells of lists and tables (judged together per column and
script over the whole text), are labelled by their own words. Runs of one label are segments; a segment's confidence is the share of
its best label's weight among all candidates, and a text's language is the one
that holds most letters.

The n-gram model is fitted here, on at most ``SAMPLE_PER_CLASS`` labelled
texts per language of a reference table (a bound, whatever its size) chosen by
hash in one scan; everything else covers all rows. Telugu in Latin letters is a
class of its own that reports ``te``. A further class of the Latin script
takes every n-gram for equally likely: words that are stranger to all languages
of the model than that, and letters of scripts that no language here uses, are
``und``, which is reported but names no language.

Null and blank texts, and texts without a letter, have no language and no
segment. Junk has none either: it is told by the statistics and the sketches
of ``quality``, taken in the same pass. Equal rows give equal rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality
from .common import cut

#: labelled texts a language gives to the model, at most
SAMPLE_PER_CLASS = 250
#: cost of a switch within a sentence, and between two sentences (nats)
SWITCH, SWITCH_BETWEEN = 14.0, 5.0
#: cost of a word whose script the language doesn't use, and the most a word can cost a language
FOREIGN, MOST = 5.0, 4.0
#: no language of the model; how much less likely than usual its n-grams count (nats): close relatives of a language of the model still pass for it
UNKNOWN, STRANGE = "und", 2.5
#: longest n-gram, words a task remembers
NGRAM = 4
KEPT_WORDS = 300_000
#: rows a list or table has at least, and cells a language needs in a column; words of a cell, at most
ROWS, CELL_WORDS = 3, 4
#: model classes of the scripts that several languages share
CLASSES = {"Latin": ("en", "de", "fr", "es", "te-Latn"), "Devanagari": ("hi", "mr")}
#: scripts of many languages beside those of the model
OPEN = ("Latin",)
#: languages with a script of their own
OWN = {"Telugu": "te", "Kannada": "kn", "Tamil": "ta", "Thai": "th", "Han": "zh", "Malayalam": "ml", "Bengali": "bn", "Gujarati": "gu", "Gurmukhi": "pa", "Oriya": "or", "Arabic": "ar", "Hebrew": "he", "Hangul": "ko", "Kana": "ja", "Greek": "el", "Cyrillic": "ru"}
_BLOCKS = [(0x41, 0x24F, "Latin"), (0x370, 0x3FF, "Greek"), (0x400, 0x52F, "Cyrillic"), (0x590, 0x5FF, "Hebrew"), (0x600, 0x77F, "Arabic"), (0x900, 0x97F, "Devanagari"), (0x980, 0x9FF, "Bengali"), (0xA00, 0xA7F, "Gurmukhi"), (0xA80, 0xAFF, "Gujarati"), (0xB00, 0xB7F, "Oriya"), (0xB80, 0xBFF, "Tamil"), (0xC00, 0xC7F, "Telugu"), (0xC80, 0xCFF, "Kannada"), (0xD00, 0xD7F, "Malayalam"), (0xE00, 0xE7F, "Thai"), (0x1E00, 0x1EFF, "Latin"), (0x3040, 0x30FF, "Kana"), (0x3400, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul")]
#: English names and three-letter codes of languages (ISO 639).
NAMES = {
    "en": "english eng", "de": "german deu ger", "fr": "french fra fre", "es": "spanish spa castilian", "te": "telugu tel", "hi": "hindi hin", "mr": "marathi mar", "kn": "kannada kan", "ta": "tamil tam", "th": "thai tha", "zh": "chinese zho chi cmn mandarin",
    "ml": "malayalam mal", "bn": "bengali ben bangla", "gu": "gujarati guj", "pa": "punjabi pan panjabi", "or": "odia ori oriya", "ar": "arabic ara", "he": "hebrew heb", "ko": "korean kor", "ja": "japanese jpn", "el": "greek ell gre", "ru": "russian rus",
    "ne": "nepali nep", "sa": "sanskrit san", "pt": "portuguese por", "nl": "dutch nld dut", "it": "italian ita", "ur": "urdu urd",
}
_LABELS = {word: code for code, words in NAMES.items() for word in (code, *words.split())}


def label_language(label: str | None) -> str | None:
    """The two-letter code a label names, with or without a region, in any case; else null."""
    if label is None:
        return None
    word = label.strip().lower()
    if (code := _LABELS.get(word)) is not None:
        return code
    m = re.fullmatch(r"([a-z]{2,3})[-_][a-z0-9]{2,8}(?:[-_][a-z0-9]{2,8})*", word)
    return _LABELS.get(m.group(1)) if m else None


def _code(state: str) -> str:
    """The code that a class reports."""
    return state if state == UNKNOWN else state[:2]


def _script(c: str) -> str:
    o = ord(c)
    for low, high, name in _BLOCKS:
        if low <= o <= high:
            return name
    return ""


def _grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for n in range(2, NGRAM + 1) for i in range(len(w) - n + 1)] + list(word)


class Model:
    """Character n-gram scores of the classes of each shared script."""

    def __init__(self, samples: dict[str, list[str]], common: dict[str, list[str]]):
        self.grams: dict[str, dict[str, dict[str, float]]] = {}
        self.common: dict[str, dict[str, frozenset[str]]] = {}
        self.chance: dict[str, float] = {}
        self.unseen: dict[str, float] = {}
        for script, classes in CLASSES.items():
            low, high = next((a, b) for a, b, s in _BLOCKS if s == script)
            word = re.compile(f"[{chr(low)}-{chr(high)}]+")
            counts = {}
            for c in classes:
                n: Counter[str] = Counter()
                for t in samples.get(c, []):
                    for w, k in Counter(word.findall(t.lower())).items():
                        for g in _grams(w):
                            n[g] += k
                for w in common.get(c, []):
                    for g in _grams(w.lower()):
                        n[g] += 50
                counts[c] = n
            known = set().union(*counts.values()) if counts else set()
            self.grams[script] = {}
            total = {c: sum(n.values()) + len(known) + 1 for c, n in counts.items()}
            # the n-gram of a word as the best fitted language has it, on average
            usual = [sum(k * math.log((k + 0.5) / total[c]) for k in n.values()) / sum(n.values()) for c, n in counts.items() if n]
            self.chance[script] = max(usual, default=0.0) - STRANGE
            self.unseen[script] = max((math.log(0.5 / total[c]) for c, n in counts.items() if n), default=0.0)
            for g in known:
                if sum(n[g] for n in counts.values()) > 2:
                    self.grams[script][g] = {c: math.log((n[g] + 0.5) / total[c]) for c, n in counts.items()}
            self.common[script] = {c: frozenset(w.lower() for w in common.get(c, [])) for c in classes}

    def word(self, script: str, word: str) -> dict[str, float]:
        """Cost of a word in each class of its script: 0 for the best, at most ``MOST``."""
        classes = CLASSES[script]
        table = self.grams[script]
        lower = word.lower()
        score = dict.fromkeys(classes, 0.0)
        grams = _grams(lower)
        unseen = 0
        for g in grams:
            if (s := table.get(g)) is not None:
                for c in classes:
                    score[c] += s[c]
            else:
                unseen += 1
        strange = len(grams) * self.chance[script] - unseen * self.unseen[script]
        # n-grams overlap: a quarter of their sum is about the word's own score
        score = {c: s / NGRAM for c, s in score.items()}
        for c, words in self.common[script].items():
            if lower in words:
                score[c] += 3.0
        best = max(score.values())
        out = {c: min(MOST, best - s) for c, s in score.items()}
        if script not in OPEN:
            return out
        strange /= NGRAM
        if strange > best:
            out = {c: min(MOST, x + strange - best) for c, x in out.items()}
        out[UNKNOWN] = min(MOST, max(0.0, best - strange))
        return out


def fit(reference: DataFrame, text_col: str, lang_col: str, common_words: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled texts of each class.

    One scan: the texts of a class fall into ``per_class`` buckets by hash, and
    each bucket gives the text of the lowest hash, by combining aggregation.
    """
    text, lang = F.col(text_col), F.col(lang_col)
    romanized = text.rlike(r"\A[\x00-\x40]*[A-Za-z]{3}")
    cls = F.when(lang == "te", F.when(romanized, F.lit("te-Latn"))).when(lang.isin([c for cs in CLASSES.values() for c in cs]), lang)
    rows = reference.where(F.length(text) > 40).select(cls.alias("c"), text.alias("t"), F.xxhash64(text).alias("h")).where(F.col("c").isNotNull())
    chosen = rows.groupBy("c", F.pmod("h", F.lit(per_class)).alias("b")).agg(F.min_by("t", F.struct("h", "t")).alias("t"))
    samples: dict[str, list[str]] = {}
    for r in chosen.collect():  # at most per_class rows a class
        samples.setdefault(r.c, []).append(r.t)
    return Model({c: sorted(t) for c, t in samples.items()}, quality.common_by_language(common_words))


_UNIT = re.compile(r"\S+|\n\s*")
_ENDS = re.compile(r"[.!?।॥…。！？．;|»]+[\"'”’»)\]“]*$")
#: a dot that ends an abbreviation ('no. 5', 'approx. half'), not a sentence
_ABBREVIATED = re.compile(r"\.[ \t]+[\da-z\xe0-\xff]")
_HAN_END = re.compile("(?<=[。！？])(?=[^”’」』）。！？])")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯऀ-ഄ\u200c\u200dัิ-ฺ็-๎]|[ऺ-ൿ])*")
#: what parts the cells of a row: a sign by itself or at the end of a word, or a gap
_PARTS = frozenset(["|", "-", "–", "—", "=", ":", "/", "→", "•"])
_PART_END = (":", "|", ";", ",", "=")
_GAP = re.compile(r"\t|[ \u3000]{2,}")
_SQUEEZE = re.compile("[\xa0\xad\u2000-\u200b\u202f\u2060\u3000\ufeff\ufb00-\ufb06\uff01-\uff5e]")


def tagger(model: Model) -> Callable[[str], list[tuple[int, int, str, float, bool]]]:
    """A function from text to segments (start, end, language, confidence, holds a whole sentence)."""
    memo: dict[str, tuple[str, int, dict[str, float]]] = {}
    scripts: dict[str, str] = {}

    def look(unit: str) -> tuple[str, int, dict[str, float]]:
        """Script, letters and costs of a run of characters without white space."""
        plain = unicodedata.normalize("NFKC", unit) if _SQUEEZE.search(unit) else unit
        found: Counter[str] = Counter()
        for c in plain:
            if c.isalpha():
                s = scripts.get(c)
                if s is None:
                    s = scripts[c] = _script(c)
                found[s] += 1
        if not found:
            out = ("", 0, {})
        else:
            script, n = found.most_common(1)[0]
            if script in CLASSES:
                words = [w for w in _WORD.findall(plain) if _script(w[0]) == script]
                url = "://" in plain or "@" in plain or plain.lower().startswith("www.")
                costs: dict[str, float] = dict.fromkeys((*CLASSES[script], *((UNKNOWN,) if script in OPEN else ())), 0.0)
                if not url:
                    for w in words:
                        for c, x in model.word(script, w).items():
                            costs[c] = min(MOST, costs[c] + x)
                    out = (script, n, costs)
                else:
                    out = ("", 0, {})
            else:
                out = (script, n, {OWN.get(script, UNKNOWN): 0.0})
        if len(memo) >= KEPT_WORDS:
            memo.clear()
        if len(unit) < 100:
            memo[unit] = out
        return out

    def best_class(group: list) -> tuple[str, dict[str, float]]:
        totals = {c: sum(u[4][c] for u in group) for c in group[0][4]}
        return min(totals, key=lambda c: (totals[c], c)), totals

    def abbreviated(text: str, unit: tuple) -> bool:
        return _ABBREVIATED.match(text, unit[1] - 1) is not None

    def short_sentences(text: str, units: list, labels: list[str]) -> None:
        """Relabel sentences of two words or more whose one script their label doesn't use."""
        i, n = 0, len(units)
        while i < n:
            j = i + 1
            while j < n and not units[j][5]:
                j += 1
            words = sum(2 if u[2] >= 12 else 1 for u in units[i:j])
            cut = abbreviated(text, units[j - 1]) or (i > 0 and abbreviated(text, units[i - 1]))
            if words > 1 and not cut and all(u[3] == units[i][3] and label not in u[4] for u, label in zip(units[i:j], labels[i:j])):
                labels[i:j] = [best_class(units[i:j])[0]] * (j - i)
            i = j

    def entries(text: str, units: list, places: list[tuple[int, int]], labels: list[str]) -> list[bool]:
        """Label the cells of a list or table per column and script; whether a unit belongs to such a cell."""
        entry = [False] * len(units)
        rows: dict[int, dict[int, list[int]]] = {}
        for k, (line, column) in enumerate(places):
            rows.setdefault(line, {}).setdefault(column, []).append(k)
        short = [row for row in rows.values() if all(len(c) <= CELL_WORDS and all(units[k][2] < 24 for k in c) for c in row.values())]
        if len(short) < ROWS or len(short) < 0.7 * len(rows):
            return entry
        columns: dict[tuple[int, str], list[list[int]]] = {}
        for row in short:
            for column, cell in row.items():
                script = units[cell[0]][3]
                # codes and capitals are no words of a language
                if all(units[k][3] == script and not any(map(str.isdigit, w := text[units[k][0] : units[k][1]])) and not w.isupper() for k in cell):
                    columns.setdefault((column, script), []).append(cell)
        for cells in columns.values():
            if len(cells) < ROWS:
                continue
            best, totals = best_class([units[k] for cell in cells for k in cell])
            for k in (k for cell in cells for k in cell):
                if labels[k] not in totals or totals[labels[k]] - totals[best] > SWITCH:
                    labels[k] = best
                entry[k] = True
        return entry

    def segments(text: str) -> list[tuple[int, int, str, float, bool]]:
        # units with their place, script and whether a new sentence may begin before them
        units: list[tuple[int, int, int, str, dict[str, float], bool]] = []
        places: list[tuple[int, int]] = []  # line and column of every unit
        fresh = True
        line = column = last = 0
        parted = False
        for m in _UNIT.finditer(text):
            unit = m.group()
            if unit[0] == "\n":
                fresh = True
                line, column, parted, last = line + 1, 0, False, m.end()
                continue
            at = m.start()
            parted = parted or unit in _PARTS or (at - last > 0 and _GAP.search(text, last, at) is not None)
            last = m.end()
            pieces = _HAN_END.split(unit) if "。" in unit or "！" in unit or "？" in unit else (unit,)
            for piece in pieces:
                script, n, costs = memo.get(piece) or look(piece)
                if n:
                    if parted and places and places[-1][0] == line:
                        column += 1
                    parted = False
                    places.append((line, column))
                    units.append((at, at + len(piece), n, script, costs, fresh))
                    fresh = False
                if not fresh and _ENDS.search(piece):
                    fresh = True
                at += len(piece)
            parted = parted or unit.endswith(_PART_END)
        if not units:
            return []
        states = sorted({c for u in units for c in u[4]})
        if len(states) == 1:
            return [(units[0][0], units[-1][1], _code(states[0]), 1.0, True)]
        cost = dict.fromkeys(states, 0.0)
        back: list[dict[str, str]] = []
        for _, _, n, _, costs, new in units:
            weight = 1.0 if n < 12 else n / 6.0  # scripts without spaces
            jump = SWITCH_BETWEEN if new else SWITCH
            best = min(cost, key=lambda s: (cost[s], s))
            enter = cost[best] + jump
            now, came = {}, {}
            for s in states:
                stay = cost[s]
                if stay <= enter:
                    came[s], base = s, stay
                else:
                    came[s], base = best, enter
                now[s] = base + weight * (costs[s] if s in costs else FOREIGN)
            cost = now
            back.append(came)
        state = min(cost, key=lambda s: (cost[s], s))
        labels = [state]
        for came in reversed(back[1:]):
            state = came[state]
            labels.append(state)
        labels.reverse()
        short_sentences(text, units, labels)
        entry = entries(text, units, places, labels)
        out = []
        i, n = 0, len(units)
        while i < n:
            j = i
            totals = dict.fromkeys(states, 0.0)
            whole = opened = False
            words = 0
            while j < n and labels[j] == labels[i]:
                _, _, k, _, costs, new = units[j]
                if new:
                    whole = whole or opened
                    opened = True
                weight = 1.0 if k < 12 else k / 6.0
                words += 2 if k >= 12 else 1
                for s in states:
                    totals[s] += weight * (costs[s] if s in costs else FOREIGN)
                j += 1
            if opened and (j == n or units[j][5]):
                whole = True
            # one foreign word is no sentence, nor are two before an abbreviation's dot
            enough = words > 2 or j - i == n or (words == 2 and not abbreviated(text, units[j - 1]) and not (i > 0 and abbreviated(text, units[i - 1])))
            whole = (whole and enough) or any(entry[i:j])
            label = labels[i]
            other = min((totals[s] for s in states if _code(s) != _code(label)), default=60.0)
            confidence = 1.0 / (1.0 + math.exp(-min(60.0, max(-60.0, other - totals[label]))))
            out.append((units[i][0], units[j - 1][1], _code(label), confidence, whole))
            i = j
        return out

    return segments


_SEGMENTS = [("start_pos", pa.int64()), ("end_pos", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("whole", pa.bool_()), ("letters", pa.int64())]
_TAGGED = f"rec_id bigint, label string, {quality.record_schema()}, segments array<struct<start_pos:bigint,end_pos:bigint,lang:string,confidence:double,whole:boolean,letters:bigint>>"


def tagged(df: DataFrame, id_col: str, text_col: str, lang_col: str, model: Model, common_words: DataFrame) -> DataFrame:
    """(rec_id, label, statistics, segments): every text that isn't blank, measured and tagged in one pass."""
    common = quality.common_by_language(common_words)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    names = ["rec_id", "label", *quality.RECORD, "segments"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = tagger(shared.value)
        profile = quality.profiler(common)
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 1000):
                batch = whole_batch.slice(at, 1000)
                kept, measures, found = [], [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    if (p := profile(t)) is not None:
                        kept.append(i)
                        measures.append(p)
                        found.append(tag(t))
                take = pa.array(kept, pa.int64())
                labels = pa.array([label_language(x) for x in batch.column(2).take(take).to_pylist()], pa.string())
                cells = list(zip(*measures)) if measures else [()] * len(quality.MEASURE_TYPES)
                flat = [(a, b, lang, conf, whole, b - a) for segments in found for a, b, lang, conf, whole in segments]
                columns = list(zip(*flat)) if flat else [()] * len(_SEGMENTS)
                structs = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _SEGMENTS)], names=[n for n, _ in _SEGMENTS])
                ends = [0]
                for segments in found:
                    ends.append(ends[-1] + len(segments))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), labels, *(pa.array(c, t) for c, t in zip(cells, quality.MEASURE_TYPES)), lists], names=names)

    both = df.select(F.col(id_col).cast("bigint").alias("rec_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return both.where(F.col("text").isNotNull()).mapInArrow(run, _TAGGED)


def segment_languages(df: DataFrame, id_col: str, text_col: str, lang_col: str, model: Model, common_words: DataFrame) -> DataFrame:
    """(rec_id, label, start_pos, end_pos, lang, confidence, whole, letters): the language segments of every text that isn't junk."""
    rows = cut(tagged(df, id_col, text_col, lang_col, model, common_words))
    kind = quality.kind_of(quality.z_scores(quality.scales(rows)))
    return rows.where(kind != "junk").select("rec_id", "label", F.inline("segments"))


def unnamed_languages(segments: DataFrame) -> DataFrame:
    """(rec_id, lang): languages that fill a whole sentence of a text and that its label doesn't name."""
    segments = segments.where(F.col("lang") != UNKNOWN)
    other = F.col("label").isNull() | (F.col("label") != F.col("lang"))
    return segments.where(F.col("whole") & other).select("rec_id", "lang").distinct()


def document_languages(segments: DataFrame) -> DataFrame:
    """(rec_id, label, lang, confidence): the language of most of each text's letters."""
    by = segments.groupBy("rec_id", "label", "lang").agg(F.sum("letters").alias("n"), F.sum(F.col("letters") * F.col("confidence")).alias("w"))
    best = by.groupBy("rec_id", "label").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"), F.max("n").alias("n"), F.sum("n").alias("total"), F.max_by("w", F.struct("n", "lang")).alias("w"))
    return best.select("rec_id", "label", "lang", (F.col("w") / F.col("total")).alias("confidence"))
