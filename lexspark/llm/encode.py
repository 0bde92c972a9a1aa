"""Encoding a corpus with a public byte-level BPE vocabulary (problem 8).

A text is cut into short words by the vocabulary's pattern, and each word is
merged by rank over a contiguous array: part boundaries with the rank of the
pair that starts at each. The array is scanned for the lowest rank, its
boundary deleted and the ranks of both neighbours refreshed, until no pair has
a rank. Words longer than ``SHORT`` bytes use the same rule over linked parts
with a heap, which is not quadratic. Results of words are kept in a bounded
map per task, so a frequent word is merged once.

Null and empty texts give an empty list; control tokens spelled out in a text
are ordinary text. Ids are 32-bit integers. Every row gives one row, repeated
rows too.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: where the public vocabularies lie; a parameter of every operator here
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: fixed value: the published word pattern of this vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: bytes up to which a word is merged by scanning
SHORT = 256
#: words a task remembers, and the longest word it does so for
KEPT_WORDS, KEPT_LENGTH = 400_000, 40

_NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: scan the contiguous rank array for the minimum, merge, refresh."""
    get = ranks.get
    bounds = list(range(len(word) + 1))
    # near[i]: rank of the two parts from bounds[i] to bounds[i + 2]
    near = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while near:
        low = min(near)
        if low == _NONE:
            break
        i = near.index(low)
        del bounds[i + 1], near[i]
        if i < len(near):
            near[i] = get(word[bounds[i] : bounds[i + 2]], _NONE)
        if i:
            near[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a long word: linked parts and a heap of (rank, start)."""
    n, get = len(word), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # next and previous start
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or after[j] != end:
            continue  # one of the two parts has changed since
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
            if (r := get(word[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        if (p := before[i]) >= 0 and (r := get(word[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : after[i]]])
        i = after[i]
    return ids


def encoder(directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> Callable[[str | None], list[int]]:
    """A function from text to ids; built once per task."""
    import regex

    ranks = load_ranks(os.path.join(directory, vocabulary))
    words = regex.compile(PATTERN).findall
    kept: dict[str, list[int]] = {}

    def ids_of(word: str) -> list[int]:
        raw = word.encode("utf-8")
        if (whole := ranks.get(raw)) is not None:
            ids = [whole]
        else:
            ids = merge_short(raw, ranks) if len(raw) <= SHORT else merge_long(raw, ranks)
        if len(word) <= KEPT_LENGTH:
            if len(kept) >= KEPT_WORDS:
                kept.clear()
            kept[word] = ids
        return ids

    def encode(text: str | None) -> list[int]:
        out: list[int] = []
        add = out.extend
        for word in words(text) if text else ():
            try:
                add(kept[word])
            except KeyError:
                add(ids_of(word))
        return out

    return encode


def encode_corpus(df: DataFrame, id_col: str, text_col: str, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(``id_col``, ids): the token ids of every row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(directory, vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids = pa.array([encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    both = df.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return both.mapInArrow(run, f"{id_col} bigint, ids array<int>")


def count_tokens(df: DataFrame, keys: list[str], text_col: str, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keys`` and ``tokens``, the number of ids of every row's text (0 for null and empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(directory, vocabulary)
        for batch in batches:
            n = pa.array([len(encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*keys, "tokens"])

    kept = df.select(*keys, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{schema}, tokens bigint")
