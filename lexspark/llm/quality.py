"""Per-document text quality statistics (problem 3).

One pass measures every record: words, mean word length, symbol ratio, share
of lines that end in punctuation, share of common words and four more, and
five that speak for a kind: shares of the record that stand in item lines, in
rows of cells, in codes or markup, separators per word, and how far the record
repeats itself. Each statistic gets a mergeable quantile sketch (KLL) per
language, built by combining aggregation. The sketches' quantiles turn every
value into a robust z-score, and the tails are flagged: a record whose item,
separator, cell, code or repetition score lies in the tail of its language is
a ``list``, ``table`` or ``junk``; everything else is ``prose``. Values in the tail of any other statistic are reported
(``flagged``).

The sketches hold the records that are prose at first sight, those with each
kind's share under ``FIRST``, so that any share of lists, tables and junk in a
language leaves them as they are; the z-scores then decide over all records.
Quantiles of a language are drawn towards those of all languages together
(where there are none, to 0) by n / (n + ``SHRINK``), n its records in the
sketch, so no size of a group changes the rule.

Languages are told by script and common words (the label may be wrong).
Words are runs without white space; in Chinese every character is a word, in
Thai every common word (the longest at its place) and every piece with a letter
or digit between two of them or at an end of the run. Null and blank records have no
statistics (kind null). A record of any length is measured whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: robust z-scores beyond which a value lies in the tail: of an ordinary statistic, of one that speaks for a kind
TAIL, KIND_TAIL = 3.0, 6.0
#: share of a record from which it is no prose at first sight
FIRST = 0.4
#: records by which the quantiles of a language are drawn towards those of all
SHRINK = 50
#: words a task remembers
KEPT_WORDS = 300_000
#: accuracy of the quantile sketches (KLL's k)
SKETCH_K = 200

#: groups that are no language; their records don't enter the quantiles of all languages
UNKNOWN = ("latin", "deva", "other", "none")

#: ordinary statistic -> least scale of its z-score (a spread below it counts as this)
STATS = {
    "mean_word_length": 0.5,
    "symbol_ratio": 0.01,
    "punctuated_lines": 0.15,
    "common_words": 0.08,
    "words_per_line": 4.0,
    "stops_per_word": 0.02,
    "digit_ratio": 0.01,
    "distinct_words": 0.1,
}
#: statistics whose upper tail is ordinary (long lines, sound punctuation)
LOW_ONLY = ("punctuated_lines", "words_per_line", "common_words", "distinct_words")
#: statistic -> the kind it speaks for, and the least scale of its z-score
EVIDENCE = {
    "item_lines": ("list", 0.1),
    "separators": ("list", 0.06),
    "cell_rows": ("table", 0.08),
    "repeats": ("junk", 0.1),
    "coded": ("junk", 0.06),
}
MEASURED = (*STATS, *EVIDENCE)

_STOP = r".!?।॥…。！？．"
_CLOSE = "\"'”’»）)\\]」』›*_"
STOPS = frozenset(_STOP)
TRAIL = "\"'”’»）)]」』›*_ \t\r"
_EDGE = ".,;:!?\"'()[]“”‘’«»।|"
_STOPS = re.compile(f"[{_STOP}]+[{_CLOSE}]*(?=\\s|$)|[。！？．]")
_MARK = re.compile(r"(?:[-*•→◦▪·–—+>]|\(?(?:\d{1,3}|[a-zA-Z]{1,2}|[ivxIVX]{1,5})[.)])[ \t]")
_NUMERIC = re.compile(r"[-–]|[-+]?[\d.,/:]+%?|[^\w\s]?\s?[\d.,]+\s?[^\w\s]?")
_SPACED = re.compile(r"[ \t]{2,}")
_TAG = re.compile(r"<[a-zA-Z/!][^<>]*>|&[a-z]+;|&#\d+;")
_CODE = re.compile(r"[{};]\s*(?=$|\n|[a-zA-Z.#}])|\b(?:var|function|return|document|if|else|const|let|margin|padding|color|display)\b\s*[(:=.{]|\w\(['\"\w]*\)|=>|==|\|\|")
_HEXLIKE = re.compile(r"(?=[0-9a-fA-F]*\d)(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{6,}|\d{7,}|(?=[\w+/=-]*\d)(?=[\w+/=-]*[A-Z])(?=[\w+/=-]*[a-z])[\w+/=-]{12,}|[A-Z0-9]{3,}-\d[\w-]*", re.A)
_WORDLIKE = re.compile(r"[^\W_]")
_LATIN = re.compile(r"[A-Za-z]+")
_SYMBOLS = re.compile(r"(?:[^\w\s]|_)+")
_SEPARATORS = (" » ", " | ", " • ", " · ", " / ", " > ", " – ", " → ", ", ", "; ", "、", "، ")
#: languages whose common words aren't written in Latin letters: such words say nothing about them
_OWN_SCRIPT = frozenset(("te", "ta", "kn", "th", "zh", "hi", "mr", "deva", "none"))
_HARD = re.compile(r"[bcdfghjklmnpqrstvwxz]{4}|^[bcdfghjklmnpqrstvwxz]{3,}$|q[^u]|[jvwxz][bcdfgjkmpqtvwxz]|[bcdfgjkmpqtvwxz][jx]", re.I)


#: full-width forms, odd spaces and characters without shape don't count as symbols
_WIDE = re.compile("[\u00a0\u00ad\u2000-\u200b\u202f\u2060\u3000\ufeff\uff01-\uff5e]")
NARROW = {**{o: o - 0xFEE0 for o in range(0xFF01, 0xFF5F) if chr(o) not in "，：；！？（）"}, **{o: " " for o in (0xA0, *range(0x2000, 0x200B), 0x202F, 0x3000)}, 0xAD: None, 0x200B: None, 0x2060: None, 0xFEFF: None}


def profiler(common: dict[str, list[str]]) -> Callable[[str], tuple | None]:
    """A function from text to (language, words, *MEASURED), or None for blank texts."""
    sets = {lang: frozenset(w.lower() for w in words) for lang, words in common.items()}
    latin = [lang for lang, words in sets.items() if any(w.isascii() for w in words)]
    deva = [lang for lang in sets if lang in ("hi", "mr", "ne", "sa")]
    thai = re.compile("|".join(sorted(map(re.escape, sets.get("th", frozenset())), key=len, reverse=True)) or "(?!)")
    han = re.compile("|".join(sorted(map(re.escape, sets.get("zh", frozenset())), key=len, reverse=True)) or "(?!)")
    blocks = {0x0C00: "te", 0x0C80: "kn", 0x0B80: "ta", 0x0900: "deva", 0x0E00: "th", 0x0000: "latin", 0x0080: "latin"}

    kinds: dict[str, str] = {}  # character -> its kind: symbol, digit or other

    def kind_of(c: str) -> str:
        cat = unicodedata.category(c)
        k = "d" if cat == "Nd" else "o" if cat[0] in "LMNZ" or cat in ("Cf", "Cc") else "s"
        kinds[c] = k
        return k

    bit = {lang: 1 << k for k, lang in enumerate(sets)}
    known_in: dict[str, int] = {}  # word -> the languages in which it is common, and a bit that is always set
    seen_bit = 1 << len(sets)

    def mask_of(word: str) -> int:
        bare = word.strip(_EDGE).lower()
        mask = seen_bit | sum(bit[lang] for lang, known in sets.items() if bare in known)
        if len(known_in) >= KEPT_WORDS:
            known_in.clear()
        known_in[word] = mask
        return mask

    def language(words: list[str]) -> tuple[str, float]:
        """The language and its share of common words."""
        seen: Counter[int] = Counter()
        for c, k in Counter([w[0] for w in words]).items():
            if c.isalpha():
                seen[ord(c) >> 7 << 7] += k
        if not seen:
            seen = Counter(ord(c) >> 7 << 7 for w in words for c in w if c.isalpha())
        if not seen:
            return "none", 0.0
        top = max(seen, key=lambda x: (seen[x], x))
        if 0x3400 <= top < 0xA000 or 0x3000 <= top < 0x3100:
            return "zh", 0.0
        kind = blocks.get(top, "other")
        options = latin if kind == "latin" else deva if kind == "deva" else [kind]
        get = known_in.get
        masks = Counter([get(w) or mask_of(w) for w in words]).items()
        hits = {x: sum(k for m, k in masks if m & bit[x]) for x in options if x in bit}
        best = max(hits, key=lambda x: (hits[x], x), default=None)
        if best and (hits[best] or best == kind):
            return best, hits[best] / len(words)
        return kind, 0.0

    def thai_words(runs: list[str]) -> tuple[int, int]:
        """Common words and words of runs without white space, each run cut at its common words."""
        hits = total = 0
        for run in runs:
            parts = thai.split(run)  # one more than there are common words
            found = len(parts) - 1
            hits += found
            total += (found + sum(1 for p in parts if p and _WORDLIKE.search(p))) or 1
        return hits, total

    def profile(text: str) -> tuple | None:
        if _WIDE.search(text):
            text = text.translate(NARROW)
        words = text.split()
        if not words:
            return None
        n = len(words)
        length = sum(map(len, words))
        lang, share = language(words)
        lines = [x for x in text.split("\n") if x and not x.isspace()]
        if lang == "zh":
            hits = sum(map(len, han.findall(text)))
            n_words = max(1, sum(map(str.isalpha, text)))
            share = hits / n_words
        elif lang == "th":
            n_common, n_words = thai_words(words)
            share = n_common / n_words
        else:
            n_words = n
        symbols = digits = 0
        for c in set(text):
            k = kinds.get(c) or kind_of(c)
            if k == "s":
                symbols += text.count(c)
            elif k == "d":
                digits += text.count(c)
        ends = sum(1 for x in lines if x[-1] in STOPS or x.rstrip(TRAIL)[-1:] in STOPS)
        stops = len(_STOPS.findall(text))
        unknown = 0.0 if lang in _OWN_SCRIPT else max(0.0, 1.0 - 10.0 * share)
        evidence = (_item_lines(lines), _separators(text, n_words), _cell_rows(lines), _repeats(words), _coded(text, words, lines, length, symbols, unknown))
        return (lang, n_words, length / n_words, symbols / length, ends / len(lines), share, n_words / len(lines), stops / n_words, digits / length, len(set(words)) / n, *evidence)

    return profile


def _item_lines(lines: list[str]) -> float:
    """Share of the text in lines that are items: marked, or short and without a final stop; 0 for less than three lines."""
    if len(lines) < 3:
        return 0.0
    items = 0
    for x in lines:
        if (len(x) <= 60 and x.count(" ") < 6 and x.rstrip(TRAIL)[-1:] not in STOPS) or _MARK.match(x.lstrip()):
            items += len(x)
    return items / sum(map(len, lines))


def _separators(text: str, n_words: int) -> float:
    """Signs of the most frequent separator of items after the first one, per word (signs that stand apart are no words)."""
    most = 0.0
    for sep in _SEPARATORS:
        if (k := text.count(sep)) > 1:
            most = max(most, (k - 1) / max(1, n_words - (k if sep[0] == " " else 0)))
    return min(1.0, most)


def _cell_rows(lines: list[str]) -> float:
    """Share of the lines that have the most frequent number of cells under one separator, times the share of short cells.

    Three rows are needed. Commas and semicolons part cells only as far as numbers stand between them.
    """
    most = 0.0
    if len(lines) < 3:
        return most
    for sep in ("\t", "|", ";", '","', ",", None):
        if sep is None:
            rows = [_SPACED.split(x.strip()) for x in lines] if any("  " in x or "\t" in x for x in lines) else []
        else:
            rows = [x.strip(" \r\n").strip("|").split(sep) for x in lines] if sum(sep in x for x in lines) > 2 else []
        often = max((k for w, k in Counter(map(len, rows)).items() if w > 1), default=0)
        if often < 3:
            continue
        cells = [c.strip(' "') for r in rows for c in r]
        rate = often / len(lines) * sum(1 for c in cells if c.count(" ") < 4) / len(cells)
        if sep in (",", ";") and rate > most:
            rate *= min(1.0, 4.0 * sum(1 for c in cells if _NUMERIC.fullmatch(c)) / len(cells))
        most = max(most, rate)
    return most


def _repeats(words: list[str]) -> float:
    """How far the text agrees with itself, moved by the distance at which its middle comes again; 0 for less than three periods."""
    squeezed = "".join(words)
    n, most = len(squeezed), 0.0
    for at in (n // 3, n // 2):
        probe = squeezed[at : at + min(12, n // 4)]
        again = squeezed.find(probe, at + 1) if len(probe) > 3 else -1
        period = again - at
        if again > 0 and n >= 3 * period:
            most = max(most, sum(map(str.__eq__, squeezed, squeezed[period:])) / (n - period))
    return most


def _coded(text: str, words: list[str], lines: list[str], length: int, symbols: int, unknown: float) -> float:
    """Share of the characters in codes (all but one), tags, program text, words of symbols, or unpronounceable words.

    ``unknown``: how far the words are strange to the language (1: none is common).
    """
    sizes = [len(w) for w in words if len(w) > 5 and _HEXLIKE.fullmatch(w.strip(".,;:()[]\"'"))]
    most = sum(sizes) - min(40, max(sizes)) if sizes else 0
    if symbols > 0.08 * length:
        most = max(most, sum(len(w) for w in words if len(w) > 1 and _SYMBOLS.fullmatch(w)))
        if "<" in text:
            most = max(most, sum(map(len, _TAG.findall(text))))
        if "{" in text or "(" in text or "=" in text:
            most = max(most, 12 * sum(len(_CODE.findall(x)) for x in lines if not _MARK.match(x)))
    if unknown:
        most = max(most, unknown * sum(len(p) for p in _LATIN.findall(text) if len(p) > 3 and _HARD.search(p)))
    return min(1.0, most / length)


#: columns of a measured record
RECORD = ("lang", "words", *MEASURED)


def record_schema() -> str:
    return "lang string, words bigint, " + ", ".join(f"{s} double" for s in MEASURED)


MEASURE_TYPES = (pa.string(), pa.int64(), *[pa.float64()] * len(MEASURED))
_PROFILE = f"field string, rec_id bigint, {record_schema()}"


def common_by_language(common_words: DataFrame) -> dict[str, list[str]]:
    """The frequent words of each language, from a small fixed table."""
    common: dict[str, list[str]] = {}
    for r in common_words.select("lang", "word").where("lang is not null and word is not null").collect():  # a few hundred rows
        common.setdefault(r.lang, []).append(r.word)
    return common


def profiles(df: DataFrame, common_words: DataFrame) -> DataFrame:
    """(field, rec_id, lang, words, statistics) of every record that isn't blank."""
    common = common_by_language(common_words)
    names = ["field", "rec_id", *RECORD]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile = profiler(common)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                kept, rows = [], []
                for i, t in enumerate(batch.column(2).to_pylist()):
                    if (p := profile(t)) is not None:
                        kept.append(i)
                        rows.append(p)
                take = pa.array(kept, pa.int64())
                cols = [batch.column(0).take(take), batch.column(1).take(take)]
                cells = list(zip(*rows)) if rows else [()] * len(MEASURE_TYPES)
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c, t) for c, t in zip(cells, MEASURE_TYPES))], names=names)

    return df.where(F.col("text").isNotNull()).select("field", "rec_id", "text").mapInArrow(run, _PROFILE)


#: quantiles read from the sketches, and the normal distribution's at the same shares
_SHARES, _NORMAL = (0.25, 0.5, 0.75, 0.99), (-0.6745, 0.0, 0.6745, 2.3263)
Scales = dict[str | None, dict[str, tuple[float, float]]]


def scales(measured: DataFrame) -> Scales:
    """Language -> statistic -> (median, scale), from the sketches; None stands for every other language.

    The scale of an ordinary statistic is its interquartile range in units of
    the normal distribution's; that of one that speaks for a kind, which is 0
    for most prose, the distance of its last percentile from the median.
    """
    prose = measured.where(" AND ".join(f"{s} < {FIRST}" for s in EVIDENCE))
    sketches = prose.groupBy("lang").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(s, F.lit(SKETCH_K)).alias(s) for s in MEASURED))
    at = F.array(*map(F.lit, _SHARES))
    by_lang = sketches.select("lang", "n", *(F.kll_sketch_get_quantile_double(s, at).alias(s) for s in MEASURED)).collect()  # one row a language
    pooled = {s: (0.0,) * len(_SHARES) for s in MEASURED}
    if any(r.lang not in UNKNOWN for r in by_lang):
        whole = sketches.where(~F.col("lang").isin(*UNKNOWN)).agg(*(F.kll_merge_agg_double(s).alias(s) for s in MEASURED))
        merged = whole.select(*(F.kll_sketch_get_quantile_double(s, at).alias(s) for s in MEASURED)).first()
        pooled = {s: tuple(map(float, merged[s])) for s in MEASURED}

    def scale(own: dict[str, tuple[float, ...]], n: int) -> dict[str, tuple[float, float]]:
        out = {}
        for s in MEASURED:
            w = n / (n + SHRINK)
            low, mid, high, last = (w * a + (1 - w) * b for a, b in zip(own[s], pooled[s]))
            if s in STATS:
                out[s] = mid, max((high - low) / (_NORMAL[2] - _NORMAL[0]), STATS[s])
            else:
                out[s] = mid, max((last - mid) / _NORMAL[3], EVIDENCE[s][1])
        return out

    return {None: scale(pooled, 0)} | {r.lang: scale({s: tuple(map(float, r[s])) for s in MEASURED}, r.n) for r in by_lang}


def z_scores(held: Scales) -> dict[str, Column]:
    """The robust z-score of each statistic of a measured record.

    There are as many (median, scale) pairs as languages the language rule can
    name: they stand in the plan as map literals.
    """
    known = [lang for lang in held if lang is not None]

    def of(k: int, s: str) -> Column:
        other = F.lit(held[None][s][k])
        if not known:
            return other
        return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for lang in known for x in (lang, held[lang][s][k]))), F.col("lang")), other)

    return {s: (F.col(s) - of(0, s)) / of(1, s) for s in MEASURED}


def kind_of(z: dict[str, Column]) -> Column:
    """The kind of a score beyond ``KIND_TAIL``.

    The rows of a table are short lines too, and so is a phrase over and over:
    junk comes before table, table before list.
    """
    out: Column | None = None
    for kind in ("junk", "table", "list"):
        top = F.greatest(*(z[s] for s, (k, _) in EVIDENCE.items() if k == kind), F.lit(0.0))
        out = (F if out is None else out).when(top > KIND_TAIL, F.lit(kind))
    return out.otherwise(F.lit("prose"))


def scored(measured: DataFrame) -> DataFrame:
    """``measured`` with a robust z-score per statistic (z_...), ``flagged`` and ``kind``."""
    columns = measured.select("*", *(v.alias(f"z_{s}") for s, v in z_scores(scales(measured)).items()))
    z = {s: F.col(f"z_{s}") for s in MEASURED}
    tail = F.lit(False)
    for s in STATS:
        tail = tail | ((z[s] < -TAIL) if s in LOW_ONLY else (F.abs(z[s]) > TAIL))
    return columns.select("*", tail.alias("flagged"), kind_of(z).alias("kind"))
