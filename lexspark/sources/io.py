"""Readers and sinks of the corpus pipeline."""

from __future__ import annotations

import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENTATION_SCHEMA = T.StructType(
    [
        T.StructField("word_counts", T.MapType(T.StringType(), T.LongType())),
        T.StructField("test_cases", T.ArrayType(T.StructType([T.StructField("input", T.StringType()), T.StructField("ground_truth", T.StringType())]))),
        T.StructField("metadata", T.StructType([T.StructField("total_corpus_words", T.LongType())])),
    ]
)
STATISTICS_A = ("total_documents", "total_sentences", "total_words", "total_characters", "original_characters", "average_sentence_length", "average_word_length", "unique_tokens", "type_token_ratio")
STATISTICS_B = ("total_sentences", "total_words", "total_characters", "average_sentence_length", "average_word_length", "unique_token_types", "type_token_ratio")
#: decimals of the report of a persisted table
_DIGITS = {"average_sentence_length": 4, "average_word_length": 4, "type_token_ratio": 6}


#: where a row of a stored table lies: its file, then its place in it
PLACE = ("_file", "_row")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or pattern) of any file system Spark knows holds anything."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def stored_order(df: DataFrame) -> DataFrame:
    """``df``, a Parquet table as read, with the columns ``PLACE`` that give the order it was written in."""
    return df.select("*", F.col("_metadata.file_name").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """A corpus of any built-in format; JSON and CSV want a schema, so no pass is spent on inferring one."""
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)


def read_segmentation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    """(vocabulary, cases, total words) of a segmentation file."""
    data = spark.read.schema(SEGMENTATION_SCHEMA).option("multiLine", True).json(path)
    vocab = data.select(F.explode("word_counts").alias("word", "cnt"))
    cases = data.select(F.posexplode("test_cases").alias("case_id", "c")).select(F.col("case_id").cast("bigint").alias("case_id"), "c.input", "c.ground_truth")
    return vocab, cases, data.select("metadata.total_corpus_words").first()[0]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): one line a row; a missing file gives an empty table and a message."""
    if exists(spark, path):
        return spark.read.text(path)
    print(f"{path}: no such file", file=sys.stderr)
    return spark.createDataFrame([], "value string")


def write_tokenized(rows: DataFrame, path: str, ordered: bool = False) -> None:
    """Parquet (Snappy) of the one column ``tokenized_sentence``, in (document, sentence) order.

    ``ordered``: the rows come from documents already in order, so they aren't
    sorted (a sort would tokenize everything once more to sample its ranges).
    """
    out = rows if ordered else rows.orderBy("doc_ord", "sent_idx")
    out.select("tokenized_sentence").write.mode("overwrite").parquet(path, compression="snappy")


def write_text(rows: DataFrame, path: str, column: str = "tokenized_sentence", single_file: bool = False, order: tuple[str, ...] = ("doc_ord", "sent_idx")) -> None:
    """Lines in order; null rows are left out (Spark would write them as empty lines)."""
    out = rows.where(F.col(column).isNotNull())
    if order and all(c in rows.columns for c in order):
        out = out.orderBy(*order)
    out = out.select(F.col(column).alias("value"))
    (out.coalesce(1) if single_file else out).write.mode("overwrite").text(path)


def write_statistics(stats: DataFrame, path: str, rounded: bool = False) -> dict:
    """The one row of statistics as JSON: indent 4 unrounded, or indent 2 with the report's decimals."""
    row = stats.first().asDict()
    keys = STATISTICS_B if rounded else STATISTICS_A
    out = {k: round(row[k], _DIGITS[k]) if rounded and k in _DIGITS else row[k] for k in keys}
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, indent=2 if rounded else 4, ensure_ascii=False)
    return out


def parquet_to_text(spark: SparkSession, source: str, target: str, column: str = "tokenized_sentence") -> None:
    """The column's lines in the order in which the table was written."""
    write_text(stored_order(spark.read.parquet(source)).select(column, *PLACE), target, column, order=PLACE)
