"""Word boundaries in unspaced text: longest match and maximum probability.

A case's candidate words are its substrings of at most the vocabulary's
longest word that the vocabulary holds. One walk over the candidates of a case
gives both segmentations, so work and memory follow the text's length times
the longest word. A vocabulary of at most ``HELD_WORDS`` words goes to the
tasks, which look its words up in place. Of a larger one each block of texts
gets the words that its texts hold: a bit table of the whole vocabulary leaves
few other substrings, each goes once a block to the join with the vocabulary,
and what is found goes to the block. Either way the same walk runs over the
same candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import tokens as T

#: words (of together at most ``HELD_CHARACTERS``) a task can hold
HELD_WORDS, HELD_CHARACTERS = 200_000, 4_000_000
#: characters of the texts of a block, about
BLOCK_CHARACTERS = 4_000_000
#: bit table of a larger vocabulary: bits a word, bits at most (as a power of 2), places of a word
BITS, MOST_BITS, PROBES = 16, 28, 4
#: characters whose substrings are looked at together
AT_ONCE = 200_000

#: (length, log probability) of the words that start at each place
Edges = list[list[tuple[int, float]]]


def vocabulary(df: DataFrame) -> DataFrame:
    """(word, cnt): non-empty words with a positive count, one row each."""
    return df.where((F.col("cnt") > 0) & (F.col("word") != "")).groupBy("word").agg(F.sum("cnt").alias("cnt"))


def _weighted(vocab: DataFrame, total: Column | int) -> DataFrame:
    total_col = F.lit(total) if isinstance(total, int) else total
    return vocab.select("word", F.ln(F.col("cnt") / total_col).alias("logp"))


def held(vocab: DataFrame, total: Column | int) -> dict[str, float] | None:
    """Word -> log probability if the vocabulary is small enough to be held, else None."""
    size = vocab.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("c")).first()
    if size.n > HELD_WORDS or size.c > HELD_CHARACTERS:
        return None
    return {r.word: r.logp for r in _weighted(vocab, total).collect()}  # at most HELD_WORDS rows


#: words are told apart by their first characters
_HEAD = 4


class Words:
    """Word -> log probability, and which sizes to try after the first characters."""

    def __init__(self, known: dict[str, float]):
        self.known = known
        sizes: dict[str, set[int]] = {}
        for w in known:
            if len(w) >= _HEAD:
                sizes.setdefault(w[:_HEAD], set()).add(len(w))
        same: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.sizes = {h: same.setdefault(t := tuple(sorted(x)), t) for h, x in sizes.items()}
        self.short = sorted({len(w) for w in known if len(w) < _HEAD})

    def edges(self, text: str) -> Edges:
        get, sizes, short, n = self.known.get, self.sizes.get, self.short, len(text)
        out: Edges = []
        for a in range(n):
            words = [(k, p) for k in short if (p := get(text[a : a + k])) is not None and a + k <= n]
            for k in sizes(text[a : a + _HEAD], ()):
                if (p := get(text[a : a + k])) is not None and a + k <= n:
                    words.append((k, p))
            out.append(words)
        return out


#: Odd factors of the hash of a substring.
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """Texts as one, its code points, the size of each text."""
    whole = "".join(texts)
    return whole, np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), np.fromiter(map(len, texts), np.int64, len(texts))


def _rolled(points: np.ndarray, at: np.ndarray, room: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For k = 1, 2, ...: k, the places with room for k characters, their room, the hashes of the k characters there."""
    h, k = np.zeros(len(at), np.uint64), 0
    while True:
        if not (more := room > k).all():
            at, room, h = at[more], room[more], h[more]
        if not len(at):
            return
        h = (h + points[at + k] + np.uint64(1)) * _FACTOR
        h ^= h >> np.uint64(32)
        k += 1
        yield k, at, room, h


def _probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The places of hashes in a table of 2 ** bits bits."""
    x = h * _MIX
    step = (x >> np.uint64(32)) | np.uint64(1)
    for _ in range(PROBES):
        yield x >> np.uint64(64 - bits)
        x = (x + step) * _FACTOR


def bit_table(vocab: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """A Bloom filter of the ``n`` words: the power of its size, its bits in words of 64; at most 2 ** ``MOST_BITS`` bits reach the driver."""
    bits = min(MOST_BITS, max(10, (BITS * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, points, sizes = _points(batch.column(0).to_pylist())
            for k, _, room, h in _rolled(points, np.cumsum(sizes) - sizes, sizes):
                for at in _probes(h[room == k], bits):
                    yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["cell", "bit"])

    cells = vocab.select("word").mapInArrow(run, "cell bigint, bit bigint").groupBy("cell").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[cells["cell"].to_numpy()] = cells["bit"].to_numpy().view(np.uint64)
    return bits, table


def _some(texts: list[str], longest: int, bits: int, table: np.ndarray) -> set[str]:
    """The substrings of texts that may be words: all words and few others."""
    whole, points, sizes = _points(texts)
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(points))
    out: set[str] = set()
    for k, at, _, h in _rolled(points, at, np.minimum(ends - at, longest)):
        x = h * _MIX
        step = (x >> np.uint64(32)) | np.uint64(1)
        for _ in range(PROBES):  # each looks at those that the one before has left
            place = x >> np.uint64(64 - bits)
            there = (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
            at, x, step = at[there], x[there], step[there]
            x = (x + step) * _FACTOR
        out.update([whole[a : a + k] for a in at.tolist()])
    return out


def candidates(texts: DataFrame, vocab: DataFrame, total: Column | int, n: int, longest: int) -> DataFrame:
    """(block, word, logp): the vocabulary's words that the texts (block, input) of each block hold."""
    shared = texts.sparkSession.sparkContext.broadcast((bit_table(vocab, n), longest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bits, table), longest = shared.value
        seen: set[str] = set()
        last = None

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([last] * len(seen), pa.int32()), pa.array(list(seen), pa.string())], names=["block", "word"])
            seen.clear()
            return batch

        for batch in batches:
            blocks, inputs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            a = 0
            while a < len(inputs):
                b, size = a, 0
                while b < len(inputs) and blocks[b] == blocks[a] and size < AT_ONCE:
                    size += len(inputs[b])
                    b += 1
                if blocks[a] != last or len(seen) > HELD_WORDS:
                    yield flush()
                last = blocks[a]
                seen |= _some(inputs[a:b], longest, bits, table)
                a = b
        yield flush()

    found = texts.select("block", "input").mapInArrow(run, "block int, word string").distinct()
    return found.join(_weighted(vocab, total), "word").select("block", "word", "logp")


def longest_match(text: str, edges: Edges) -> list[str]:
    """At each position the longest word, or one character where none fits."""
    words, i = [], 0
    while i < len(text):
        k = max((size for size, _ in edges[i]), default=1)
        words.append(text[i : i + k])
        i += k
    return words


def most_probable(text: str, edges: Edges) -> list[str]:
    """The segmentation of highest unigram probability.

    Ties keep the shortest last word. A position that no word reaches from a
    reachable one yields single characters, so everything after an unknown
    character does.
    """
    score, last = [-math.inf] * (len(text) + 1), [1] * (len(text) + 1)
    score[0] = 0.0
    for a, words in enumerate(edges):
        base = score[a]
        if base == -math.inf:
            continue
        for size, logp in words:
            # later starts are shorter last words: they win ties
            if (s := base + logp) >= score[a + size]:
                score[a + size], last[a + size] = s, size
    out, end = [], len(text)
    while end > 0:
        out.append(text[end - last[end] : end])
        end -= last[end]
    return out[::-1]


def _walked(batch: pa.RecordBatch, words: Words, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, 500):
        part = batch.slice(at, 500)
        greedy, dp = [], []
        for text in part.column("input").to_pylist():
            edges = words.edges(text)
            greedy.append(longest_match(text, edges))
            dp.append(most_probable(text, edges))
        kind = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(greedy, kind), pa.array(dp, kind)], names=[*keep, "greedy", "dp"])


def segmentations(cases: DataFrame, vocab: DataFrame, total: Column | int, *carried: str) -> DataFrame:
    """(case_id, carried columns, greedy, dp): both segmentations of every case; null inputs count as empty."""
    keep = ["case_id", *carried]
    texts = cases.select(F.col("case_id").cast("bigint").alias("case_id"), *carried, F.coalesce("input", F.lit("")).alias("input"))
    schema = ", ".join([*(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep), "greedy array<string>, dp array<string>"])
    known = held(vocab, total)
    if known is not None:
        shared = cases.sparkSession.sparkContext.broadcast(Words(known))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _walked(batch, shared.value, keep)

        return texts.mapInArrow(look_up, schema)

    vocab = cut(vocab)
    size = vocab.agg(F.count("*").alias("n"), F.max(F.length("word")).alias("m")).first()
    blocks = max(cases.sparkSession.sparkContext.defaultParallelism, 1 + (texts.agg(F.sum(F.length("input"))).first()[0] or 0) // BLOCK_CHARACTERS)
    # written once: a block is a partition of the stored texts
    texts = cut(texts.repartition(blocks)).select(F.spark_partition_id().alias("block"), *keep, "input")
    words = candidates(texts, vocab, total, size.n, size.m)
    rows = words.withColumn("input", F.lit(None).cast("string")).unionByName(texts, allowMissingColumns=True)

    def block_by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        words: Words | None = None  # of the block at hand, once its words are all there
        block = None
        for batch in batches:
            a, ids, some = 0, batch.column("block").to_pylist(), batch.column("word").to_pylist()
            while a < len(ids):
                if ids[a] != block:
                    block, known, words = ids[a], {}, None
                b = a
                while b < len(ids) and ids[b] == block and (some[b] is None) == (some[a] is None):
                    b += 1
                if some[a] is not None:
                    known.update(zip(some[a:b], batch.column("logp").slice(a, b - a).to_pylist()))
                else:
                    words = words or Words(known)
                    yield from _walked(batch.slice(a, b - a), words, keep)
                a = b

    # the words of a block come before its texts
    near = rows.repartition("block").sortWithinPartitions("block", F.col("word").isNull())
    return near.mapInArrow(block_by_block, schema)


def accuracy(predicted: Column, actual: Column) -> Column:
    """Share of positions of ``actual`` with the same word; 0 where it is empty."""
    n = F.least(F.size(predicted), F.size(actual))
    same = F.size(F.filter(F.arrays_zip(F.slice(predicted, F.lit(1), n).alias("p"), F.slice(actual, F.lit(1), n).alias("a")), lambda x: x["p"] == x["a"]))
    return F.when(F.size(actual) > 0, same / F.size(actual)).otherwise(F.lit(0.0))


def edit_distance(predicted: Column, actual: Column) -> Column:
    """Levenshtein distance of the space-joined words."""
    p, a = F.array_join(predicted, " "), F.array_join(actual, " ")
    return F.when(p == a, F.lit(0)).otherwise(F.levenshtein(p, a))


def metrics(cases: DataFrame, vocab: DataFrame, total: Column | int) -> DataFrame:
    """One row a case: accuracy and edit distance of both segmentations."""
    a = F.coalesce(T.words("ground_truth"), F.array().cast("array<string>"))
    both = segmentations(cases, vocab, total, "ground_truth").select("case_id", "greedy", "dp", a.alias("actual"))
    a = F.col("actual")
    return both.select("case_id", *(x.alias(f"{m}_{n}") for m in ("greedy", "dp") for n, x in (("accuracy", accuracy(F.col(m), a)), ("distance", edit_distance(F.col(m), a)))))


def report(scores: DataFrame) -> DataFrame:
    """Unweighted means over the cases and which method does better."""

    def verdict(x: str, y: str) -> Column:
        return F.when(F.col(x) > F.col(y), F.lit("greedy")).when(F.col(x) < F.col(y), F.lit("dp")).otherwise(F.lit("same"))

    means = scores.agg(*(F.avg(c).alias(c) for c in ("greedy_accuracy", "greedy_distance", "dp_accuracy", "dp_distance")), F.count("*").alias("cases"))
    return means.select("*", verdict("greedy_accuracy", "dp_accuracy").alias("better_accuracy"), verdict("dp_distance", "greedy_distance").alias("better_distance"))
