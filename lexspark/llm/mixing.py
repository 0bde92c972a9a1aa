"""Mixing sources to target weights (problem 9).

Hash-threshold histograms: each document has a hash that orders the documents
of its source at random. The wanted tokens of a source are its share of the
mix's size; whole passes over the source come first, the rest is a budget
that a hash threshold cuts from a further pass. The threshold is found from
sums of tokens by (source, hash bucket): the bucket in which the running sum
crosses the budget is cut into finer buckets, level by level, until it holds a
single hash value. No documents are sorted, and only histograms of at most
(sources in ``targets``) x ``BUCKETS`` rows a level reach the driver.

Defined results: source names are compared without case and outer spaces; a
null source, and one that ``targets`` doesn't name, takes no part. A document
without tokens is used as its hash says. Equal rows have equal hashes and are
taken together. A source that can't reach its share within ``max_repeats``
passes is used ``max_repeats`` times; with ``redistribute`` what it lacks is
asked of the other sources, by their shares and within their caps, so the mix
has its size if it can be had at all. Where ``targets`` names a source twice,
its shares add up and the lower cap holds. Null, negative or zero shares give
0 tokens; a null or negative cap counts as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, share
from .encode import TOKENIZER_DIR, VOCABULARY, count_tokens

#: bits of the hash used at each level; six levels use 60 bits
BITS = 10
BUCKETS = 1 << BITS
LEVELS = 6


def source_key(column: str):
    return F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = targets.where(F.col("source").isNotNull()).groupBy(source_key("source").alias("s")).agg(F.sum(F.greatest(F.col("target_share"), F.lit(0.0))).alias("w"), F.min(F.greatest(F.coalesce(F.col("max_repeats"), F.lit(0)), F.lit(0))).alias("m")).collect()  # one row a target
    return {r.s: (float(r.w or 0.0), int(r.m)) for r in rows}


def wanted(want: dict[str, tuple[float, int]], have: dict[str, int], size: int, redistribute: bool) -> dict[str, int]:
    """Tokens to take of each source: its share of ``size``, at most all of it ``max_repeats`` times."""
    most = {s: have[s] * cap for s, (_, cap) in want.items()}
    out = {s: min(round(size * w), most[s]) for s, (w, _) in want.items()}
    if not redistribute:
        return out
    short = round(size * min(1.0, sum(w for w, _ in want.values()))) - sum(out.values())
    while short > 0:
        open_ = [s for s, (w, _) in want.items() if w > 0 and out[s] < most[s]]
        total = sum(want[s][0] for s in open_)
        before = short
        for s in open_:
            more = min(most[s] - out[s], round(before * want[s][0] / total))
            out[s] += more
            short -= more
        if short == before:  # nothing open, or less than a token each
            break
    return out


def _bucket(level: int):
    """The bucket of a hash at a level, among the next ``BITS`` of it."""
    return F.shiftright("h", BITS * (LEVELS - 1 - level)).bitwiseAND(F.lit(BUCKETS - 1))


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", total_tokens: int | None = None, seed: int = 42, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY, redistribute: bool = False) -> DataFrame:
    """(id, source, tokens, copies): how often each document is used; unused ones have 0 copies.

    ``total_tokens`` is the size of the mix; by default all tokens of the
    sources in ``targets``.
    """
    spark = docs.sparkSession
    want = _targets(targets)
    used = docs.select(F.col(id_col).cast("bigint").alias(id_col), source_key("source").alias("source"), F.xxhash64(F.lit(seed), F.col(id_col), F.col("text")).bitwiseAND(F.lit((1 << (BITS * LEVELS)) - 1)).alias("h"), "text").where(F.col("source").isin(list(want)))
    sized = cut(count_tokens(used, [id_col, "source", "h"], "text", directory, vocabulary))

    def histogram(level: int, inside: dict[str, int]) -> dict[str, dict[int, tuple[int, int, int]]]:
        """(tokens, lowest, highest hash) by source and bucket of ``level``, of hashes whose upper bits are ``inside``."""
        part = sized
        if level:
            pairs = [F.struct(F.lit(s).alias("source"), F.lit(b).cast("bigint").alias("b")) for s, b in inside.items()]
            part = part.where(F.struct(F.col("source"), F.shiftright("h", BITS * (LEVELS - level)).alias("b")).isin(pairs))
        rows = part.groupBy("source", _bucket(level).alias("b")).agg(F.sum("tokens").alias("n"), F.min("h").alias("low"), F.max("h").alias("high")).collect()  # at most sources x BUCKETS rows
        out: dict[str, dict[int, tuple[int, int, int]]] = {}
        for r in rows:
            out.setdefault(r.source, {})[r.b] = (r.n, r.low, r.high)
        return out

    found = histogram(0, {})
    have = {s: sum(n for n, _, _ in found.get(s, {}).values()) for s in want}
    size = sum(have.values()) if total_tokens is None else total_tokens
    passes: dict[str, int] = {}
    budget: dict[str, int] = {}
    for s, tokens in wanted(want, have, size, redistribute).items():
        passes[s], budget[s] = divmod(tokens, have[s]) if have[s] else (0, 0)
    # nested thresholds: the bucket that crosses the budget is the next level's range
    threshold: dict[str, int] = {}
    open_, level = {s: 0 for s in want if budget[s]}, 0
    while open_:
        if level:
            found = histogram(level, open_)
        for s in list(open_):
            for b, (n, low, high) in sorted(found[s].items()):
                if n > budget[s]:
                    break
                budget[s] -= n
            open_[s] = open_[s] * BUCKETS + b
            if low == high:  # documents of one hash stay together: those below it are in
                threshold[s] = low
                del open_[s]
        level += 1
    spec = [(s, passes[s], threshold.get(s, 0)) for s in want]
    if not spec:
        return sized.select(id_col, "source", "tokens", F.lit(0).cast("bigint").alias("copies"))
    cuts = spark.createDataFrame(spec, "source string, passes bigint, threshold bigint")
    copies = F.col("passes") + (F.col("h") < F.col("threshold")).cast("bigint")
    return sized.join(F.broadcast(cuts), "source").select(id_col, "source", "tokens", copies.alias("copies"))  # a row a target


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: what it has, what was used and the shares reached."""
    by = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens_held"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.count("*").alias("documents"), F.sum("copies").alias("documents_used"), F.max("copies").alias("most_copies"))
    want = targets.where(F.col("source").isNotNull()).groupBy(source_key("source").alias("source")).agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    joined = want.join(by, "source", "left").na.fill(0, ["tokens_held", "tokens_used", "documents", "documents_used", "most_copies"])
    whole = joined.agg(F.sum("tokens_used")).scalar()
    return joined.select("source", "target_share", share(F.col("tokens_used"), whole).alias("actual_share"), "tokens_held", "tokens_used", "documents", "documents_used", "most_copies", "max_repeats")
