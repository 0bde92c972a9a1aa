"""Frequency of every distinct term (problem 6).

A range-partitioned external sort of (term, record) pairs with run-length
counting:

1. run generation - each task gathers the pairs of its records, ``RUN_PAIRS``
   at a time, sorts them by term and record and scans the sorted pairs: equal
   pairs are occurrences in one record, a new record under the same term is
   one record more. A run keeps (term, records, occurrences), in order; a
   record never lies in two runs, so runs add up. Memory is bounded by the
   run, and a hot term costs one row a run, however many records hold it. The
   records that hold any term are counted on the way (a row without a term);
2. the runs are written once, before their ranges are sampled, and
   range-partitioned by term, so a term lies in one partition and the result
   is globally ordered;
3. each partition is sorted by term (spilling where it must), and a scanner
   adds up the adjacent rows of each term, carrying the open one from batch to
   batch.

A term is a longest run without white space (Unicode's, and U+001C-U+001F),
compared code point by code point. Null, empty and blank records hold no term.
Repeated rows are records of their own, whatever their id. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: (term, record) pairs a task sorts at a time
RUN_PAIRS = 1_000_000
RARE_ROWS = 2
COMMON_SHARE = 0.05

_RUN = "term string, records bigint, occurrences bigint"
_NAMES = ["term", "records", "occurrences"]
#: rows of an emitted batch
_ROWS = 20_000


def _batches(terms: list[str | None], records: np.ndarray, occurrences: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(terms), _ROWS):
        to = at + _ROWS
        yield pa.RecordBatch.from_arrays([pa.array(terms[at:to], pa.string()), pa.array(records[at:to], pa.int64()), pa.array(occurrences[at:to], pa.int64())], names=_NAMES)


def sorted_run(terms: list[str], record: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct terms, records, occurrences) of pairs whose records come in ascending order."""
    names = sorted(set(terms))
    rank = dict(zip(names, range(len(names))))
    term = np.fromiter(map(rank.__getitem__, terms), np.int64, len(terms))
    order = np.argsort(term, kind="stable")  # by term, and within it by record
    term, record = term[order], record[order]
    starts = np.flatnonzero(np.diff(term, prepend=-1))  # where a term's pairs begin
    new = np.ones(len(term), np.int64)  # a pair that differs from the one before
    new[1:] = (term[1:] != term[:-1]) | (record[1:] != record[:-1])
    return names, np.add.reduceat(new, starts), np.diff(starts, append=len(term))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms: list[str] = []
    sizes: list[int] = []  # terms of each record of the open run
    holders = 0

    def run() -> Iterator[pa.RecordBatch]:
        if terms:
            yield from _batches(*sorted_run(terms, np.repeat(np.arange(len(sizes)), sizes)))

    for batch in batches:
        for text in batch.column(0).to_pylist():
            found = text.split() if text else ()  # str.split() cuts at exactly this white space
            if found:
                holders += 1
                terms += found
                sizes.append(len(found))
                if len(terms) >= RUN_PAIRS:
                    yield from run()
                    terms.clear()
                    sizes.clear()
    yield from run()
    yield from _batches([None], np.array([holders]), np.array([0]))


def scan_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the adjacent rows of each term; the last term of a batch stays open."""
    open_term, records, occurrences = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        term = batch.column(0)
        change = np.ones(len(term), bool)
        change[1:] = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(change)
        names = term.take(pa.array(starts)).to_pylist()
        r, n = (np.add.reduceat(batch.column(c).to_numpy(), starts) for c in (1, 2))
        if open_term is not None:
            if names[0] == open_term:
                r[0] += records
                n[0] += occurrences
            else:
                yield from _batches([open_term], np.array([records]), np.array([occurrences]))
        open_term, records, occurrences = names[-1], int(r[-1]), int(n[-1])
        yield from _batches(names[:-1], r[:-1], n[:-1])
    if open_term is not None:
        yield from _batches([open_term], np.array([records]), np.array([occurrences]))


def term_runs(df: DataFrame, column: str) -> DataFrame:
    """The sorted runs of ``column``, written once; a row without a term has a task's records that hold any."""
    return cut(df.select(F.col(column).cast("string").alias("t")).mapInArrow(_runs, _RUN))


def term_frequencies(runs: DataFrame) -> DataFrame:
    """(term, records, occurrences) of the runs, ordered by term over the partitions."""
    ranged = runs.where(F.col("term").isNotNull()).repartitionByRange(F.col("term"))
    return ranged.sortWithinPartitions("term").mapInArrow(scan_sorted, _RUN)


def marked_terms(df: DataFrame, column: str, rare_rows: int = RARE_ROWS, common_share: float = COMMON_SHARE) -> DataFrame:
    """(term, occurrences, records, mark): mark is 'rare', 'common' or null.

    ``rare``: at most ``rare_rows`` records hold it; else ``common``: at least
    ``common_share`` of the records that hold any term.
    """
    runs = term_runs(df, column)
    holders = runs.where(F.col("term").isNull()).agg(F.sum("records")).scalar()
    mark = F.when(F.col("records") <= rare_rows, F.lit("rare")).when(F.col("records") >= F.lit(common_share) * holders, F.lit("common"))
    return term_frequencies(runs).select("term", "occurrences", "records", mark.alias("mark"))
