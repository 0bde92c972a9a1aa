"""The queries of the lexical operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import sql as sqlfuncs
from ..functions import tokens as T
from ..operators import automata, compat, corpus, dot, morphology, segment

Query = Callable[[SparkSession, str], DataFrame]
DOC_LIMIT = 100


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """Regular expressions want cores: few splits of a scan are spread, large inputs stay as they are.

    For bare scans only: to count the splits of a join would run it.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return corpus.documents(_spread(_table(spark, d, "documents").select("doc_id", "text")), "text", "doc_id")


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return _spread(_table(spark, d, "indiccorp_te_tokenized").select("sent_id", "tokenized_sentence"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return corpus.sentence_rows(_docs(spark, d))


def sentence_split_literal(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return docs.select("doc_ord", F.posexplode(compat.literal_sentences("text")).alias("sent_idx", "sentence"))


def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    return corpus.token_rows(_docs(spark, d))


def tokenized_sentences(spark: SparkSession, d: str) -> DataFrame:
    return corpus.tokenized_sentences(_docs(spark, d)).select("doc_ord", "sent_idx", "tokenized_sentence")


def tokenized_sentences_sql(spark: SparkSession, d: str) -> DataFrame:
    sqlfuncs.register(spark)
    _docs(spark, d).createOrReplaceTempView("lex_docs")
    return spark.sql("SELECT doc_ord, sent_idx, array_join(lex_word_tokens(sentence), ' ') AS tokenized_sentence FROM (SELECT doc_ord, lex_sentences(text) AS parts FROM lex_docs WHERE text <> '') LATERAL VIEW posexplode(parts) s AS sent_idx, sentence")


def corpus_stats_inline(spark: SparkSession, d: str) -> DataFrame:
    return corpus.inline_statistics(_docs(spark, d))


def corpus_stats_table(spark: SparkSession, d: str) -> DataFrame:
    return corpus.table_statistics(_sentences(spark, d))


def doc_limit(spark: SparkSession, d: str) -> DataFrame:
    return corpus.limit_documents(corpus.documents(_table(spark, d, "documents"), "text", "doc_id"), DOC_LIMIT).select("doc_ord")


def doc_limit_literal(spark: SparkSession, d: str) -> DataFrame:
    return corpus.limit_documents(corpus.documents(_table(spark, d, "documents"), "text", "doc_id"), DOC_LIMIT, literal=True).select("doc_ord")


def table_profile(spark: SparkSession, d: str) -> DataFrame:
    return corpus.profile(_table(spark, d, "indiccorp_te_tokenized"))


def head_split(spark: SparkSession, d: str) -> DataFrame:
    return corpus.head_split(_table(spark, d, "indiccorp_te_tokenized"), ["sent_id"])


def url_tokens(spark: SparkSession, d: str) -> DataFrame:
    pages = corpus.documents(_spread(_table(spark, d, "oscar_te").select("rec_id", "content")), "content", "rec_id")
    rows = pages.select("doc_ord", F.explode(T.word_tokens("text")).alias("token"))
    return rows.where(T.token_kind("token") == "url").groupBy("doc_ord", "token").agg(F.count("*").alias("n"))


def token_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    distinct = corpus.token_rows(_docs(spark, d)).groupBy("token").agg(F.count("*").alias("n"))
    return distinct.groupBy(T.token_kind("token").alias("kind")).agg(F.sum("n").alias("tokens"), F.count("*").alias("types"))


def _distinct_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).select(F.explode(F.array_distinct(T.words("tokenized_sentence"))).alias("word")).distinct()


def dfa_accept(spark: SparkSession, d: str) -> DataFrame:
    return _distinct_tokens(spark, d).select("word", automata.accept(F.col("word")).alias("result"))


def dfa_accept_ci(spark: SparkSession, d: str) -> DataFrame:
    return _distinct_tokens(spark, d).select("word", automata.accept_ignoring_case(F.col("word")).alias("valid"))


def dfa_run(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "noun_list").select("line_no", automata.run(F.col("noun"), automata.word_table(), "q0", {"q1"}).alias("accepted"))


def dfa_transitions(spark: SparkSession, d: str) -> DataFrame:
    return automata.transitions(spark)


def dfa_check(spark: SparkSession, d: str) -> DataFrame:
    return automata.check(automata.states(spark), automata.transitions(spark))


def dfa_faults(spark: SparkSession, d: str) -> DataFrame:
    """The check on a word acceptor with faults: a move doubled, moves missing, a move to no state, two starts."""
    moves = automata.transitions(spark).where("src <> 'q1' OR symbol NOT IN ('x', 'y')")
    extra = spark.createDataFrame([("q0", "a", "q0"), ("q1", "x", "q9")], "src string, symbol string, dst string")
    states = automata.states(spark).withColumn("is_start", F.col("is_start") | (F.col("state") == "q1"))
    return automata.check(states, moves.unionByName(extra))


def dfa_dot(spark: SparkSession, d: str) -> DataFrame:
    edges = automata.transitions(spark).withColumnRenamed("symbol", "label")
    return dot.dot(edges, automata.states(spark), "words").select("line")


def noun_fst_dot(spark: SparkSession, d: str) -> DataFrame:
    return dot.dot(dot.noun_edges(spark), dot.noun_states(spark), "nouns").select("line")


def _nouns(spark: SparkSession, d: str) -> DataFrame:
    return morphology.lexicon(_table(spark, d, "noun_list"), "noun")


def noun_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return _nouns(spark, d)


def plural_class(spark: SparkSession, d: str) -> DataFrame:
    return _nouns(spark, d).select("noun", morphology.plural_class(F.col("noun")).alias("plural_class"))


def _forms(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("noun")
    forms = F.array(n, F.upper(n), F.concat(n, F.lit("s")), F.concat(n, F.lit("es")), F.concat(F.expr("left(noun, length(noun) - 1)"), F.lit("ies")), F.concat(n, F.lit("!")))
    lines = _table(spark, d, "noun_list").select(F.col("noun").alias("word"))
    return _nouns(spark, d).select(F.explode(forms).alias("word")).unionByName(lines.where(F.col("word").isNotNull())).distinct()


def morph_analyze(spark: SparkSession, d: str) -> DataFrame:
    return morphology.analyze(_forms(spark, d), "word", _nouns(spark, d))


def morph_corpus(spark: SparkSession, d: str) -> DataFrame:
    return morphology.analyze_lexicon(_nouns(spark, d)).select("value")


def _segmentation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, object]:
    vocab = segment.vocabulary(_table(spark, d, "vocab"))
    return _table(spark, d, "seg_cases"), vocab, vocab.agg(F.sum("cnt")).scalar()


def segment_greedy(spark: SparkSession, d: str) -> DataFrame:
    cases, vocab, total = _segmentation(spark, d)
    return segment.segmentations(cases, vocab, total).select("case_id", F.array_join("greedy", "|").alias("words"))


def segment_dp(spark: SparkSession, d: str) -> DataFrame:
    return segment.segmentations(*_segmentation(spark, d)).select("case_id", F.array_join("dp", "|").alias("words"))


def segment_documents(spark: SparkSession, d: str) -> DataFrame:
    """Word boundaries put back into the Latin-letter sentences of all documents, with the corpus' own words."""
    sentences = corpus.sentence_rows(_docs(spark, d)).where(F.col("sentence").rlike(r"\A[\x00-\x7F]*[A-Za-z][\x00-\x7F]*\z"))
    # read for the words, again for the cases: split once
    cases = cut(sentences.select(F.xxhash64("doc_ord", "sent_idx").alias("case_id"), F.lower("sentence").alias("ground_truth")))
    words = cases.select(F.explode(T.words("ground_truth")).alias("word")).where(F.length("word") <= 20)
    vocab = segment.vocabulary(words.groupBy("word").agg(F.count("*").alias("cnt")))
    cases = cases.withColumn("input", F.regexp_replace("ground_truth", r"\s+", ""))
    return segment.metrics(cases, vocab, vocab.agg(F.sum("cnt")).scalar())


def segment_metrics(spark: SparkSession, d: str) -> DataFrame:
    return segment.metrics(*_segmentation(spark, d))


def segment_report(spark: SparkSession, d: str) -> DataFrame:
    return segment.report(segment_metrics(spark, d))


def queries() -> dict[str, Query]:
    every = (
        sentence_split, sentence_split_literal, word_tokens, tokenized_sentences, tokenized_sentences_sql, corpus_stats_inline, corpus_stats_table, doc_limit, doc_limit_literal, table_profile, head_split,
        url_tokens, token_kind_counts, dfa_accept, dfa_accept_ci, dfa_run, dfa_transitions, dfa_check, dfa_faults, dfa_dot, noun_fst_dot, noun_lexicon, plural_class, morph_analyze, morph_corpus, segment_greedy, segment_dp, segment_metrics, segment_report, segment_documents,
    )
    return {f.__name__: f for f in every}
