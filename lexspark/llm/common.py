"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpoint_dir as checkpoint_dir
from ..checkpoints import cut as cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy per-row work enough tasks when a scan has few splits.

    Large inputs already have more splits than cores and are returned as they
    are; a handful of small files would otherwise keep most cores idle. For
    bare scans only: to count the splits of a join would run it.
    """
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)


def texts(df: DataFrame, id_col: str, text_col: str, field: str) -> DataFrame:
    """The columns ``field, rec_id, text`` of one text table; further columns are left behind."""
    return df.select(F.lit(field).alias("field"), F.col(id_col).cast("bigint").alias("rec_id"), F.col(text_col).cast("string").alias("text"))


def domain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents.text`` and ``oscar_te.content`` as one table (field, rec_id, text)."""
    docs = texts(table(spark, sf_dir, "documents"), "doc_id", "text", "text")
    pages = texts(table(spark, sf_dir, "oscar_te"), "rec_id", "content", "content")
    return docs.unionByName(pages)


def per_text(df: DataFrame, make: Callable[[], Callable[[str], list[tuple]]], schema: str, keys: list[str], out: list[tuple[str, pa.DataType]], text_col: str = "text", nulls: bool = False) -> DataFrame:
    """Explode each text into rows by a Python scanner, in Arrow batches.

    ``make`` builds the scanner once per task; it maps a text to tuples of the
    columns ``out``. ``keys`` are carried along. Null texts yield nothing,
    unless ``nulls`` is set and the scanner defines them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = make()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows: list[int] = []
                cells: list[list] = [[] for _ in out]
                for i, t in enumerate(batch.column(text_col).to_pylist()):
                    if t is None and not nulls:
                        continue
                    for hit in scan(t):
                        rows.append(i)
                        for c, v in zip(cells, hit):
                            c.append(v)
                take = pa.array(rows, pa.int64())
                cols = [batch.column(k).take(take) for k in keys] + [pa.array(c, t) for c, (_, t) in zip(cells, out)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, *(n for n, _ in out)])

    return df.select(*keys, text_col).mapInArrow(run, schema)


def share(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def bucket_sample(df: DataFrame, text_col: str, n: int, longest: int) -> list[str]:
    """At most ``n`` texts of at most ``longest`` characters, chosen by hash.

    A hash threshold, set by the number of rows (which a scan knows from its
    footers), leaves about eight texts for each of ``n`` buckets; a bucket gives
    the one of the lowest hash. One scan of the texts; at most ``n`` rows reach
    the driver. Equal tables give equal samples.
    """
    share = min(1.0, 8 * n / max(1, df.count()))
    text, low = F.col(text_col), F.col("h").bitwiseAND(F.lit((1 << 32) - 1))
    rows = df.select(text.alias("t"), F.xxhash64(text_col).alias("h")).where(F.col("t").isNotNull() & (low <= int(share * ((1 << 32) - 1))) & (F.length("t") <= longest))
    chosen = rows.groupBy(F.pmod(F.shiftright("h", 32), F.lit(n)).alias("b")).agg(F.min_by("t", F.struct("h", "t")).alias("t"))
    return sorted(r.t for r in chosen.collect())


#: rows from which a key is hot, and hot keys looked for, at most
HOT_ROWS, HOT_KEYS = 1_000_000, 10_000


def meet(rows: DataFrame, groups: DataFrame, on: list[str], key: str) -> DataFrame:
    """``rows`` joined with the one row of their group, whatever the size of a group.

    ``groups`` are an aggregation of ``rows`` by ``on``. Frequent values of
    ``key`` (a hash among ``on``) are found by a sketch; their groups, at most
    ``HOT_KEYS`` and few under one hash, are broadcast, so their rows stay where
    they are. All other rows meet their group in a shuffle. Which keys are
    taken for frequent changes the plan, never the result.
    """
    top = rows.agg(F.expr(f"approx_top_k(`{key}`, {HOT_KEYS}, {10 * HOT_KEYS})").alias("top"), F.count("*").alias("n")).first()
    least = max(HOT_ROWS, top.n // HOT_KEYS)
    hot = [x["item"] for x in top.top or () if x["count"] >= least]
    if not hot:
        return rows.join(groups, on)
    frequent = F.col(key).isin(hot)
    near = rows.where(frequent).join(F.broadcast(groups.where(frequent)), on)
    return near.unionByName(rows.where(~frequent).join(groups.where(~frequent), on))
