"""A lossy sentence split kept for comparison with the lossless one.

Stretches of a paragraph are protected from the split: URLs, then e-mail
addresses and decimals in what is left. A boundary is white space after a
terminator outside of them. Within a sentence the protected places are gaps
(adjacent ones join into one), and every stretch of the whole paragraph, URLs
first, lands at the start of the first gap of the sentence that still has room
for it. So a sentence can show a stretch of another one; what stays of a gap
is shown as NULs. The number of sentences is that of the lossless split.

Everything is worked out on positions of the paragraph; a NUL of the text
itself is a place of a gap, unless a protected stretch holds it. Null, empty
and blank paragraphs have no sentences.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.charclass import DECIMAL, EMAIL, SENT_BOUNDARY, URL

Span = tuple[int, int]

_ORDER = tuple(map(regex.compile, (URL, EMAIL, DECIMAL)))
_BOUNDARY = regex.compile(SENT_BOUNDARY)
_NULS = regex.compile("\0+")


def _between(spans: list[Span], end: int) -> list[Span]:
    """The stretches up to ``end`` that no span covers."""
    edges = [0, *(x for s in sorted(spans) for x in s), end]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2]) if a < b]


def protected(text: str) -> list[Span]:
    """Protected stretches by kind, then by place; they don't overlap."""
    spans: list[Span] = []
    for kind in _ORDER:
        spans += [(a + m.start(), a + m.end()) for a, b in _between(spans, len(text)) for m in kind.finditer(text[a:b])]
    return spans


def _gaps(spans: list[Span]) -> list[Span]:
    """Maximal runs of covered places, in order."""
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _filled(text: str, a: int, b: int, gaps: list[Span], spans: list[Span]) -> str:
    """text[a:b] with the stretches that land in its gaps."""
    room = {g: g for g, _ in gaps}  # start of a gap -> next free place
    landed: dict[int, list[str]] = {g: [] for g, _ in gaps}
    for s, e in spans:
        place = next((g for g, end in gaps if end - room[g] >= e - s), None)
        if place is not None:
            landed[place].append(text[s:e])
            room[place] += e - s
    out, at = [], a
    for g, end in gaps:
        out += [text[at:g], *landed[g], "\0" * (end - room[g])]
        at = end
    return "".join([*out, text[at:b]])


def split_literally(paragraph: str | None) -> list[str]:
    text = (paragraph or "").strip()
    spans = protected(text)
    gaps = _gaps([*spans, *(m.span() for a, b in _between(spans, len(text)) for m in _NULS.finditer(text, a, b))])
    ends = {b for _, b in gaps}
    cuts = [(0, 0), *(m.span() for m in _BOUNDARY.finditer(text) if m.start() not in ends), (len(text), len(text))]
    out, k = [], 0
    for (_, a), (b, _) in zip(cuts, cuts[1:]):
        first = k
        while k < len(gaps) and gaps[k][1] <= b:
            k += 1
        if sentence := _filled(text, a, b, gaps[first:k], spans).strip():
            out.append(sentence)
    return out


@F.pandas_udf(ArrayType(StringType()))
def literal_sentences(text: pd.Series) -> pd.Series:
    return text.map(lambda t: split_literally(t if isinstance(t, str) else None))
