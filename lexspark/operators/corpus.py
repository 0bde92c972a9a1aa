"""The corpus pipeline: documents -> tokenized sentences -> statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as T


def documents(df: DataFrame, text_field: str, order_field: str) -> DataFrame:
    """(doc_ord, text): the text field, '' where it is null or missing."""
    text = F.coalesce(F.col(text_field).cast("string"), F.lit("")) if text_field in df.columns else F.lit("")
    return df.select(F.col(order_field).cast("bigint").alias("doc_ord"), text.alias("text"))


#: bits of ``doc_ord`` told apart at each level of the search for the n-th one
_LEVELS = (48, 32, 16, 0)


def nth_ord(docs: DataFrame, n: int) -> Column:
    """The ``n``-th smallest ``doc_ord`` as a scalar subquery; null where there are fewer.

    Nested histograms over the ordinals alone: documents are counted by the
    upper bits, the bucket in which the running count reaches ``n`` is cut by
    the next bits. A level has at most 65,536 rows, whatever the table's size,
    and no document text is read.
    """
    found: Column | None = None
    for level, shift in enumerate(_LEVELS):
        part = docs.select("doc_ord").where(F.col("doc_ord").isNotNull())
        if found is None:
            part = part.withColumn("below", F.lit(0).cast("bigint"))
        else:
            part = part.withColumn("_at", found).where(F.shiftright("doc_ord", _LEVELS[level - 1]) == F.col("_at.b")).withColumn("below", F.col("_at.below"))
        counts = part.groupBy(F.shiftright("doc_ord", shift).alias("b"), "below").agg(F.count("*").alias("n"))
        upto = counts.withColumn("upto", F.col("below") + F.sum("n").over(Window.orderBy("b")))  # the level's few rows
        found = upto.where(F.col("upto") >= n).agg(F.min(F.struct("b", (F.col("upto") - F.col("n")).alias("below")))).scalar()
    return found["b"]


def limit_documents(docs: DataFrame, n: int, literal: bool = False) -> DataFrame:
    """The first ``n`` documents by ``doc_ord``, which is unique; documents without one are never among them.

    The limit is a threshold on ``doc_ord``: documents are neither sorted nor
    moved, and the plan is lazy. 0 or less keeps nothing.

    ``literal``: the limit is only tested after a document with text, so empty
    ones at the limit let more through (the first document with text at or
    after the n-th ends the run); 0 or less counts as 1.
    """
    if not literal:
        if n <= 0:
            return docs.where(F.lit(False))
        return docs.where(F.col("doc_ord") <= F.coalesce(nth_ord(docs, n), F.lit((1 << 63) - 1)))
    last = docs.where((F.col("doc_ord") >= nth_ord(docs, max(n, 1))) & (F.col("text") != "")).agg(F.min("doc_ord")).scalar()
    return docs.where(F.col("doc_ord") <= F.coalesce(last, F.lit((1 << 63) - 1)))


def sentence_rows(docs: DataFrame) -> DataFrame:
    """(doc_ord, sent_idx, sentence) of documents with text."""
    return docs.where(F.col("text") != "").select("doc_ord", F.posexplode(T.sentences("text")).alias("sent_idx", "sentence"))


def tokenized_sentences(docs: DataFrame) -> DataFrame:
    """(doc_ord, sent_idx, tokens, tokenized_sentence); sentences without tokens are dropped."""
    rows = sentence_rows(docs).select("doc_ord", "sent_idx", T.word_tokens("sentence").alias("tokens"))
    return rows.where(F.size("tokens") > 0).withColumn("tokenized_sentence", T.joined("tokens"))


def token_rows(docs: DataFrame) -> DataFrame:
    """(doc_ord, sent_idx, tok_idx, token)."""
    return tokenized_sentences(docs).select("doc_ord", "sent_idx", F.posexplode("tokens").alias("tok_idx", "token"))


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def _totals(rows: DataFrame, **measures: Column) -> DataFrame:
    """One row: ``total_sentences``, the sums of ``measures`` and ``types``, the distinct tokens.

    Every sentence is tokenized once: its distinct tokens are exploded, the
    first carries the sentence's measures, and one combining aggregation by
    token feeds the totals.
    """
    sums = {"total_sentences": F.lit(1), **measures}
    parts = rows.select(*(c.cast("bigint").alias(n) for n, c in sums.items()), F.posexplode(F.array_distinct("tokens")).alias("pos", "token"))
    first = F.col("pos") == 0
    by_token = parts.groupBy("token").agg(*(F.sum(F.when(first, F.col(n)).otherwise(F.lit(0))).alias(n) for n in sums))
    return by_token.agg(*(F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in sums), F.count("*").alias("types"))


def run_statistics(sentences: DataFrame, documents: Column, original_characters: Column) -> DataFrame:
    """One row of the statistics of a run, from its ``tokens`` and ``tokenized_sentence``."""
    totals = _totals(sentences, total_words=F.size("tokens"), total_characters=F.length("tokenized_sentence"))
    words = F.col("total_words")
    return totals.select(
        documents.alias("total_documents"),
        "total_sentences",
        "total_words",
        "total_characters",
        original_characters.alias("original_characters"),
        ratio(words, F.col("total_sentences")).alias("average_sentence_length"),
        ratio(F.col("total_characters"), words).alias("average_word_length"),
        F.col("types").alias("unique_tokens"),
        ratio(F.col("types"), words).alias("type_token_ratio"),
    )


def document_counts(docs: DataFrame) -> dict[str, Column]:
    """Aggregates over the documents of a run: all of them, and the characters of their texts as given."""
    return {"documents": F.count("*"), "characters": F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint")}


def inline_statistics(docs: DataFrame) -> DataFrame:
    """One row: documents, sentences, words, characters (joining spaces included), averages, distinct tokens.

    The average word length here is characters per word, spaces included;
    ``original_characters`` are those of the texts as given. All values are
    unrounded; zero denominators give 0.
    """
    counts = {k: docs.agg(v).scalar() for k, v in document_counts(docs).items()}
    return run_statistics(tokenized_sentences(docs), counts["documents"], counts["characters"])


def table_statistics(df: DataFrame, column: str = "tokenized_sentence") -> DataFrame:
    """One row of statistics of a persisted table; the average word length leaves spaces out.

    Null and blank sentences are skipped; characters are those of the stored
    sentence, outer spaces included.
    """
    rows = df.select(F.col(column).alias("s"), T.words(column).alias("tokens")).where(F.size("tokens") > 0)
    totals = _totals(rows, total_words=F.size("tokens"), total_characters=F.length("s"), word_characters=F.length(F.array_join("tokens", "")))
    words = F.col("total_words")
    return totals.select(
        "total_sentences",
        "total_words",
        "total_characters",
        ratio(words, F.col("total_sentences")).alias("average_sentence_length"),
        ratio(F.col("word_characters"), words).alias("average_word_length"),
        F.col("types").alias("unique_token_types"),
        ratio(F.col("types"), words).alias("type_token_ratio"),
    )


def head_split(df: DataFrame, order: list[str], column: str = "tokenized_sentence", n: int = 10) -> DataFrame:
    """The first ``n`` rows by ``order`` with their words."""
    return df.orderBy(*order).limit(n).select(*order, column, T.words(column).alias("words"))


def profile(df: DataFrame) -> DataFrame:
    """(row_count, column_names) of a table."""
    return df.agg(F.count("*").alias("row_count")).select("row_count", F.lit(",".join(df.columns)).alias("column_names"))
