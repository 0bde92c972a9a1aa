"""Noun-plural morphology as joins against a lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as T

INVALID = "Invalid Word"


def lexicon(lines: DataFrame, column: str) -> DataFrame:
    """(noun): distinct lines of only a-z after stripping and lower-casing."""
    noun = F.lower(T.strip(column))
    return lines.select(noun.alias("noun")).where(F.col("noun").rlike(r"\A[a-z]+\z")).distinct()


def plural_class(word: Column) -> Column:
    """'Y' after y, 'ES' after s, z, x, ch, sh, else 'S'."""
    return F.when(word.endswith("y"), F.lit("Y")).when(word.rlike("(?:s|z|x|ch|sh)$"), F.lit("ES")).otherwise(F.lit("S"))


def analyze(words: DataFrame, column: str, nouns: DataFrame) -> DataFrame:
    """``words`` with ``analysis``: root+N+PL, word+N+SG or 'Invalid Word'.

    Rules in order: -ies of a Y noun, -es of an ES noun, -s of an S noun, the
    noun itself. The distinct words are looked up once, by an equi-join on the
    candidate roots; the planner broadcasts the lexicon if it is small.
    """
    distinct = words.select(F.lower(column).alias("_w")).where(F.col("_w").rlike(r"\A[a-z]+\z")).distinct()
    w = F.col("_w")

    def cut(n: int) -> Column:
        return F.expr(f"left(_w, length(_w) - {n})")

    def rule(when: Column, priority: int, root: Column, tag: str, cls: str | None) -> Column:
        return F.when(when, F.struct(F.lit(priority).alias("p"), root.alias("noun"), F.lit(tag).alias("tag"), F.lit(cls).alias("cls")))

    rules = F.array(
        rule(w.endswith("ies"), 1, F.concat(cut(3), F.lit("y")), "+N+PL", "Y"),
        rule(w.endswith("es"), 2, cut(2), "+N+PL", "ES"),
        rule(w.endswith("s"), 3, cut(1), "+N+PL", "S"),
        rule(F.lit(True), 4, w, "+N+SG", None),
    )
    candidates = distinct.select("_w", F.inline(F.filter(rules, lambda r: r.isNotNull())))
    fits = candidates.where(F.col("cls").isNull() | (plural_class(F.col("noun")) == F.col("cls")))
    hits = fits.join(nouns, "noun").groupBy("_w").agg(F.min_by(F.concat("noun", "tag"), "p").alias("_a"))
    joined = words.withColumn("_w", F.lower(column)).join(hits, "_w", "left")
    return joined.withColumn("analysis", F.coalesce("_a", F.lit(INVALID))).drop("_w", "_a")


def parts(analysis: Column) -> Column:
    """STRUCT<root, pos, number> of an analysis; null for invalid words."""
    p = F.split(analysis, r"\+")
    return F.when(analysis != INVALID, F.struct(p[0].alias("root"), p[1].alias("pos"), p[2].alias("number")))


def analyze_lexicon(nouns: DataFrame) -> DataFrame:
    """(noun, value): every noun against the lexicon, as ``noun = analysis``."""
    return analyze(nouns, "noun", nouns).select("noun", F.concat_ws(" = ", "noun", "analysis").alias("value"))
