"""Tokenization as column expressions: built-in functions only, so plans stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .charclass import KINDS, MARK, SENT_BOUNDARY, TOKEN, TOKEN_NO_AT, URL, WS

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: ColumnLike) -> Column:
    """Remove white space (all of Unicode's) at both ends."""
    return F.regexp_replace(_col(c), rf"\A[{WS}]+|[{WS}]+\z", "")


def words(c: ColumnLike) -> Column:
    """Split on white space without empty parts; null gives null."""
    return F.regexp_extract_all(_col(c), F.lit(f"[^{WS}]+"), F.lit(0))


def word_tokens(c: ColumnLike) -> Column:
    """Typed word tokens in order: URL, e-mail, date, decimal, integer, Telugu, Latin, punctuation, any other character."""
    text = _col(c)
    found = {p: F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (TOKEN, TOKEN_NO_AT)}
    return F.when(F.contains(text, F.lit("@")), found[TOKEN]).otherwise(found[TOKEN_NO_AT])


def sentences(c: ColumnLike) -> Column:
    """Sentences of a paragraph, stripped, without empty ones; a URL's last mark ends none."""
    text = strip(F.translate(_col(c), MARK, ""))
    marked = F.regexp_replace(text, f"({URL})", f"$1{MARK}")
    parts = F.transform(F.split(marked, SENT_BOUNDARY), lambda s: strip(F.translate(s, MARK, "")))
    return F.filter(parts, lambda s: s != "")


def paragraph_tokens(c: ColumnLike) -> Column:
    """Tokens of each sentence: array<array<string>>."""
    return F.transform(sentences(c), word_tokens)


def joined(tokens: ColumnLike) -> Column:
    """Tokens as a string, one space between them."""
    return F.array_join(_col(tokens), " ")


def token_kind(token: ColumnLike) -> Column:
    """The kind a token was matched as; 'other' for the single-character fallback."""
    t = _col(token)
    out = F.lit("other")
    for name, pattern in reversed(KINDS):
        out = F.when(t.rlike(rf"\A(?:{pattern})\z"), F.lit(name)).otherwise(out)
    return out
