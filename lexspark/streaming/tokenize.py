"""The tokenizer on a stream: stateless, so the batch expressions serve as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import corpus


def read_documents(spark: SparkSession, path: str, schema: str, text_field: str, order_field: str, fmt: str = "parquet") -> DataFrame:
    """Documents of new files; the number of each batch is observed for ``operators.progress``."""
    docs = corpus.documents(spark.readStream.format(fmt).schema(schema).load(path), text_field, order_field)
    return docs.observe("documents", F.count(F.lit(1)).alias("documents"))


def write_tokenized(docs: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append tokenized sentences of the new files, each exactly once; ends when all are read."""
    rows = corpus.tokenized_sentences(docs).select("doc_ord", "sent_idx", "tokenized_sentence")
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
