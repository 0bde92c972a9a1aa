"""Command line: corpus runs, statistics, conversion, viewing, segmentation, nouns, diagrams."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from .operators import automata, corpus, dot, morphology, progress, segment
from .ship import ship
from .sources import io

#: text field and document limit of the two corpus runs
PRESETS = {"indiccorp": ("text", 1_000_000), "oscar": ("content", 10_000)}
COMMANDS = {"stats": ("parquet", "json"), "to-text": ("parquet", "text"), "view": ("parquet",), "segment": ("json",), "nouns": ("list", "output"), "dfa": ("output",), "noun-fst": ("output",)}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lexspark", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("corpus", help="tokenize a corpus: text, Parquet and statistics")
    p.add_argument("preset", choices=PRESETS)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--order", default="doc_id")
    p.add_argument("--limit", type=int)
    p.add_argument("--literal-limit", action="store_true")
    for name, args in COMMANDS.items():
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
    return parser


def corpus_run(spark: SparkSession, preset: str, source: str, target: str, order: str, limit: int | None, literal: bool) -> dict:
    """Tokenize once into Parquet; the text and the statistics are derived from it."""
    field, most = PRESETS[preset]
    docs = corpus.documents(io.read_corpus(spark, source), field, order)
    docs = corpus.limit_documents(docs, most if limit is None else limit, literal)
    seen = Observation()
    counts = corpus.document_counts(docs)
    docs = docs.orderBy("doc_ord").observe(seen, *(c.alias(k) for k, c in counts.items()))
    parquet = f"{target}/{preset}_tokenized.parquet"
    with progress.tasks(spark, preset):
        io.write_tokenized(corpus.tokenized_sentences(docs), parquet, ordered=True)
        io.parquet_to_text(spark, parquet, f"{target}/{preset}_tokenized.txt")
        stored = spark.read.parquet(parquet)
        tokens = stored.select("tokenized_sentence", corpus.T.words("tokenized_sentence").alias("tokens"))
        stats = corpus.run_statistics(tokens, F.lit(seen.get["documents"]), F.lit(seen.get["characters"]))
        return io.write_statistics(stats, f"{target}/{preset}_statistics.json")


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("lexspark").getOrCreate()
    ship(spark)
    if a.command in ("stats", "view", "to-text") and not io.exists(spark, a.parquet):
        print(f"{a.parquet}: no such file", file=sys.stderr)
        return 1
    if a.command == "corpus":
        for k, v in corpus_run(spark, a.preset, a.input, a.output, a.order, a.limit, a.literal_limit).items():
            print(f"{k}: {v:.6f}" if k == "type_token_ratio" else f"{k}: {v:.4f}" if isinstance(v, float) else f"{k}: {v:,}")
    elif a.command == "stats":
        print(io.write_statistics(corpus.table_statistics(spark.read.parquet(a.parquet)), a.json, rounded=True))
    elif a.command == "to-text":
        io.parquet_to_text(spark, a.parquet, a.text)
    elif a.command == "view":
        df = spark.read.parquet(a.parquet)
        print(df.count(), df.columns)
        for r in corpus.head_split(io.stored_order(df), list(io.PLACE)).collect():  # ten rows
            print(r.tokenized_sentence, r.words, sep="\n")
    elif a.command == "segment":
        vocab, cases, total = io.read_segmentation(spark, a.json)
        segment.report(segment.metrics(cases, segment.vocabulary(vocab), total)).show(truncate=False)
    elif a.command == "nouns":
        nouns = morphology.lexicon(io.read_lines(spark, a.list), "value")
        if nouns.isEmpty():
            print("the noun list is empty", file=sys.stderr)
            return 1
        io.write_text(morphology.analyze_lexicon(nouns), a.output, "value", order=("noun",))
    elif a.command == "dfa":
        edges = automata.transitions(spark).where(F.col("src") != automata.DEAD).withColumnRenamed("symbol", "label")
        io.write_text(dot.dot(edges, automata.states(spark), "words"), a.output, "line", single_file=True, order=("ord",))
    else:
        io.write_text(dot.dot(dot.noun_edges(spark), dot.noun_states(spark), "nouns"), a.output, "line", single_file=True, order=("ord",))
    return 0


if __name__ == "__main__":
    sys.exit(main())
