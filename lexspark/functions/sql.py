"""The tokenization functions for SQL callers, as temporary SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .charclass import MARK, SENT_BOUNDARY, TOKEN, TOKEN_NO_AT, URL, WS


def _raw(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def register(spark: SparkSession) -> list[str]:
    """Create lex_strip, lex_words, lex_word_tokens, lex_sentences and lex_plural_class; returns their names."""
    trim = _raw(rf"\A[{WS}]+|[{WS}]+\z")
    bodies = {
        "lex_strip(s STRING) RETURNS STRING": f"regexp_replace(s, {trim}, '')",
        "lex_words(s STRING) RETURNS ARRAY<STRING>": f"regexp_extract_all(s, {_raw(f'[^{WS}]+')}, 0)",
        "lex_word_tokens(s STRING) RETURNS ARRAY<STRING>": f"CASE WHEN contains(s, '@') THEN regexp_extract_all(s, {_raw(TOKEN)}, 0) ELSE regexp_extract_all(s, {_raw(TOKEN_NO_AT)}, 0) END",
        "lex_sentences(s STRING) RETURNS ARRAY<STRING>": f"filter(transform(split(regexp_replace(regexp_replace(translate(s, '{MARK}', ''), {trim}, ''), {_raw(f'({URL})')}, '$1{MARK}'), {_raw(SENT_BOUNDARY)}), x -> regexp_replace(translate(x, '{MARK}', ''), {trim}, '')), x -> x <> '')",
        "lex_plural_class(w STRING) RETURNS STRING": "CASE WHEN endswith(w, 'y') THEN 'Y' WHEN w rlike '(s|z|x|ch|sh)$' THEN 'ES' ELSE 'S' END",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in bodies]
