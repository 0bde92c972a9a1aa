"""Duplicates hidden by formatting differences (problem 7).

A row's canonical text is its consistent form (see ``lookalike``) without
case, white space and punctuation; a mark right between two digits stays, and
in rows of ``label : value`` fields the fields are canonicalized one by one
and sorted. Only a 128-bit hash of the canonical text travels, with a second,
independent 64-bit hash as the collision check: rows are equal where both
agree, so texts that collide in one of them are still kept apart, and
``collisions`` reports them. Copies are counted with map-side combining,
whatever the size of a group.

Null rows and rows without a letter or digit take no part. Exact repeats are
copies; a row repeated under the same id is counted, but is no copy of itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import meet
from .lookalike import Shape, normalizer, shapes

#: seeds of the two hashes
SEED, CHECK_SEED = 0, 0x9E3779B9

_FIELD, _VALUE = "\x1e", "\x1f"


class _Kept(dict):
    """str.translate table: white space and punctuation go, other characters stay."""

    def __missing__(self, o: int):
        c = chr(o)
        out = "" if c.isspace() or c == "\u200b" or unicodedata.category(c)[0] in "PZ" else c
        self[o] = out
        return out


def canonicalizer(letters: dict[str, Shape]) -> Callable[[str], str | None]:
    """A function from text to canonical text, null where it holds no letter or digit."""
    normalize = normalizer(letters)
    kept = _Kept()
    between = re.compile(r"(?<=\d)([^\w\s])(?=\d)")
    fields = re.compile(r"[;|]")
    word = re.compile(r"[^\W_]")

    def flat(text: str) -> str:
        # marks between digits move to a private place while the others go
        if between.search(text):
            text = between.sub(lambda m: chr(0xF0000 + ord(m.group(1))) if ord(m.group(1)) < 0xFFFE else m.group(1), text)
        return text.translate(kept)

    def canonical(text: str) -> str | None:
        text = normalize(text).lower()
        if not word.search(text):
            return None
        if ":" in text and (";" in text or "|" in text):
            parts = [p for p in fields.split(text) if word.search(p)]
            if len(parts) > 1 and all(p.count(":") >= 1 for p in parts):
                pairs = []
                for p in parts:
                    label, _, value = p.partition(":")
                    pairs.append(flat(label) + _VALUE + flat(value))
                return _FIELD.join(sorted(pairs))
        return flat(text)

    return canonical


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k1, k2, chk): the 128-bit hash in two halves and the check hash; rows without a key are left out."""

    letters = shapes(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = canonicalizer(letters)
        wide, check = xxhash.xxh3_128_digest, xxhash.xxh64_intdigest
        for batch in batches:
            at, k1, k2, chk = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t is None or (c := canonical(t)) is None:
                    continue
                raw = c.encode("utf-8", "surrogatepass")
                h = wide(raw, SEED)
                at.append(i)
                k1.append(int.from_bytes(h[:8], "big", signed=True))
                k2.append(int.from_bytes(h[8:], "big", signed=True))
                v = check(raw, CHECK_SEED)
                chk.append(v - (1 << 64) if v >> 63 else v)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(chk, pa.int64())], names=["id", "k1", "k2", "chk"])

    both = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    return both.mapInArrow(run, "id bigint, k1 bigint, k2 bigint, chk bigint")


_KEY = ["k1", "k2", "chk"]


def copy_counts(keys: DataFrame) -> DataFrame:
    """(first_id, copies): one row per distinct record with the number of its rows."""
    groups = keys.groupBy(*_KEY).agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    return groups.select("first_id", "copies")


def collisions(keys: DataFrame) -> DataFrame:
    """(k1, k2, records, first_id): the 128-bit hashes under which records of different check hashes meet."""
    groups = keys.groupBy("k1", "k2").agg(F.count("*").alias("records"), F.min("id").alias("first_id"), F.min("chk").alias("low"), F.max("chk").alias("high"))
    return groups.where(F.col("low") != F.col("high")).select("k1", "k2", "records", "first_id")


def copies(keys: DataFrame) -> DataFrame:
    """(first_id, copy_id): every further row of a record that has several ids; rows of hot records aren't moved (see ``meet``)."""
    firsts = keys.groupBy(*_KEY).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where(F.col("first_id") != F.col("last_id"))
    return meet(keys, firsts, _KEY, "k1").where(F.col("id") != F.col("first_id")).select("first_id", F.col("id").alias("copy_id")).distinct()
