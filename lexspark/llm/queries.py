"""The pN_ queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encode, formatdup, langid, lookalike, mixing, mojibake, pii, quality, sentences, termfreq
from .common import cut, domain_texts, spread, table, texts

Query = Callable[[SparkSession, str], DataFrame]


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "indiccorp_te_tokenized").select("sent_id", "tokenized_sentence"))


def _documents(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", *more))


# 1 personal information
def _pii(spark: SparkSession, d: str) -> tuple[DataFrame, pii.NameModel]:
    both = domain_texts(spark, d)
    return spread(both), pii.fit(both, table(spark, d, "name_list"), table(spark, d, "common_words"))


def _key(spark: SparkSession) -> bytes:
    """The key of the pseudonyms; without one, a key of this run alone, so nothing can be undone or linked later."""
    return bytes.fromhex(spark.conf.get("spark.lexspark.pseudonym.key", "")) or secrets.token_bytes(32)


def p1_items(spark: SparkSession, d: str) -> DataFrame:
    return pii.items(*_pii(spark, d), _key(spark))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.places(*_pii(spark, d)).where(F.col("kind") != "birth_date").select("field", "rec_id", "start_pos", "kind")


def p1_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.masked(*_pii(spark, d), _key(spark))


# 2 look-alike characters
def _look_texts(spark: SparkSession, d: str) -> DataFrame:
    sentences = texts(table(spark, d, "indiccorp_te_tokenized"), "sent_id", "tokenized_sentence", "tokenized_sentence")
    pages = texts(table(spark, d, "oscar_te"), "rec_id", "content", "content")
    return spread(sentences.unionByName(pages))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looking(cut(lookalike.look_keys(_look_texts(spark, d))))


def p2_normalized(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.normalize_corpus(_look_texts(spark, d), ["field", "rec_id"], "text")


# 3 text quality
def p3_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.scored(cut(quality.profiles(spread(domain_texts(spark, d)), table(spark, d, "common_words"))))


def p3_measures(spark: SparkSession, d: str) -> DataFrame:
    """The statistics that don't depend on the language."""
    measured = quality.profiles(spread(domain_texts(spark, d)), table(spark, d, "common_words"))
    return measured.select("field", "rec_id", "symbol_ratio", "digit_ratio", "punctuated_lines", "distinct_words")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_quality(spark, d).where(F.col("kind") != "prose").select("field", "rec_id", "kind")


# 4 sentences
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    checked = table(spark, d, "sentence_check").select("field", "rec_id")
    return sentences.sentences(spread(domain_texts(spark, d)).join(checked, ["field", "rec_id"], "left_semi"))


def p4_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_texts(spread(domain_texts(spark, d)))


# 5 languages
def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    common = table(spark, d, "common_words")
    model = langid.fit(table(spark, d, "documents"), "text", "lang", common)
    pages = spread(table(spark, d, "oscar_te").select("rec_id", "content", "lang"))
    return langid.segment_languages(pages, "rec_id", "content", "lang", model, common)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.unnamed_languages(p5_segments(spark, d))


def p5_documents(spark: SparkSession, d: str) -> DataFrame:
    return langid.document_languages(p5_segments(spark, d))


# 6 terms
def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    return termfreq.marked_terms(_sentences(spark, d), "tokenized_sentence")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_terms(spark, d).where(F.col("mark").isNotNull()).select("term", "mark")


# 7 formatting differences
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return formatdup.copies(cut(formatdup.keyed(_sentences(spark, d), "sent_id", "tokenized_sentence")))


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    return formatdup.copy_counts(formatdup.keyed(_sentences(spark, d), "sent_id", "tokenized_sentence"))


def p7_collisions(spark: SparkSession, d: str) -> DataFrame:
    return formatdup.collisions(formatdup.keyed(_sentences(spark, d), "sent_id", "tokenized_sentence"))


# 8 encoding
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(_documents(spark, d), "doc_id", "text")


# 9 mixing
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_documents(spark, d, "source"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(cut(p9_mix(spark, d)), table(spark, d, "mix_targets"))


# 10 garbled text
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_repaired(spark, d).where(F.col("status") != "sound").select("doc_id")


def p10_repaired(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repair_corpus(_documents(spark, d), "doc_id", "text")


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_items": p1_items,
        "p1_masked": p1_masked,
        "p2_found": p2_found,
        "p2_normalized": p2_normalized,
        "p3_found": p3_found,
        "p3_quality": p3_quality,
        "p3_measures": p3_measures,
        "p4_found": p4_found,
        "p4_sentences": p4_sentences,
        "p5_found": p5_found,
        "p5_segments": p5_segments,
        "p5_documents": p5_documents,
        "p6_found": p6_found,
        "p6_terms": p6_terms,
        "p7_found": p7_found,
        "p7_records": p7_records,
        "p7_collisions": p7_collisions,
        "p8_ids": p8_ids,
        "p9_mix": p9_mix,
        "p9_shares": p9_shares,
        "p10_found": p10_found,
        "p10_repaired": p10_repaired,
    }


#: white space for DuckDB's patterns: Unicode's, and U+001C-U+001F
_WS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_TERMS = rf"""
SELECT sent_id, unnest(regexp_extract_all(tokenized_sentence, '[^{_WS}]+')) AS term
FROM indiccorp_te_tokenized
"""
_TERM_COUNTS = f"""
WITH t AS ({_TERMS}), n AS (SELECT count(DISTINCT sent_id) AS holders FROM t),
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT sent_id) AS records FROM t GROUP BY term)
SELECT term, occurrences, records,
  CASE WHEN records <= 2 THEN 'rare' WHEN records >= 0.05 * holders THEN 'common' END AS mark
FROM c, n
"""


def _narrowed(x: str) -> str:
    """SQL of a text without width forms, odd spaces and some characters without shape, as the statistics read it."""
    pairs = {chr(o): chr(v) if isinstance(v, int) else v for o, v in quality.NARROW.items() if v is not None}
    gone = "".join(chr(o) for o, v in quality.NARROW.items() if v is None)
    quoted = [t.replace("'", "''") for t in ("".join(pairs), "".join(pairs.values()))]
    return f"regexp_replace(translate({x}, '{quoted[0]}', '{quoted[1]}'), '[{gone}]', '', 'g')"


_STOPS, _TRAIL = "".join(sorted(quality.STOPS)), quality.TRAIL.replace("'", "''").replace("]", "\\]")
#: a share counts characters or words among all that aren't white space
_MEASURES = rf"""
WITH r AS (SELECT 'text' AS field, doc_id AS rec_id, text AS t FROM documents UNION ALL SELECT 'content', rec_id, content FROM oscar_te),
n AS (SELECT field, rec_id, {_narrowed("t")} AS t FROM r WHERE t IS NOT NULL),
w AS (SELECT *, regexp_extract_all(t, '[^{_WS}]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_WS}]')) AS lines FROM n)
SELECT field, rec_id,
  length(regexp_replace(t, '[\p{{L}}\p{{M}}\p{{N}}\p{{Z}}\p{{Cf}}\p{{Cc}}]', '', 'g')) / length(array_to_string(words, '')) AS symbol_ratio,
  length(regexp_replace(t, '\P{{Nd}}', '', 'g')) / length(array_to_string(words, '')) AS digit_ratio,
  len(list_filter(lines, lambda x: regexp_matches(x, '[{_STOPS}][{_TRAIL}]*\z'))) / len(lines) AS punctuated_lines,
  len(list_distinct(words)) / len(words) AS distinct_words
FROM w WHERE len(words) > 0
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_measures": _MEASURES,
        "p6_terms": _TERM_COUNTS,
        "p6_found": f"SELECT term, mark FROM ({_TERM_COUNTS}) WHERE mark IS NOT NULL",
    }
