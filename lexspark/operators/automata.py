"""Word acceptors: regular expressions for the hot path, tables for the automaton itself."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACCEPTED, REJECTED = "Accepted", "Not Accepted"
DEAD = "q_dead"


def accept(word: Column) -> Column:
    """One or more of a-z, as written; null is rejected."""
    return F.when(word.rlike(r"\A[a-z]+\z"), F.lit(ACCEPTED)).otherwise(F.lit(REJECTED))


def accept_ignoring_case(word: Column) -> Column:
    """One or more of a-z after lower-casing; null and '' are not valid."""
    return F.coalesce(F.lower(word).rlike(r"\A[a-z]+\z"), F.lit(False))


def states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("q0", True, False), ("q1", False, True), (DEAD, False, False)], "state string, is_start boolean, is_accept boolean")


def transitions(spark: SparkSession) -> DataFrame:
    """(src, symbol, dst) of the word acceptor: 3 states x 26 letters."""
    letters = spark.range(ord("a"), ord("z") + 1).select(F.char("id").alias("symbol"))
    target = F.when(F.col("src") == DEAD, F.lit(DEAD)).otherwise(F.lit("q1"))
    return letters.select(F.explode(F.array(F.lit("q0"), F.lit("q1"), F.lit(DEAD))).alias("src"), "symbol").select("src", "symbol", target.alias("dst"))


def run(word: Column, delta: dict[tuple[str, str], str], start: str, accepting: set[str], dead: str = DEAD) -> Column:
    """Any automaton as a fold over the word's characters; missing moves lead to ``dead``.

    The table is a map literal, for automata of a few hundred moves.
    """
    table = F.create_map(*(F.lit(x) for (s, a), t in delta.items() for x in (f"{s}\t{a}", t)))
    chars = F.filter(F.split(F.coalesce(word, F.lit("")), ""), lambda c: c != "")
    end = F.aggregate(chars, F.lit(start), lambda s, c: F.coalesce(F.try_element_at(table, F.concat(s, F.lit("\t"), c)), F.lit(dead)))
    return end.isin(*accepting)


def word_table() -> dict[tuple[str, str], str]:
    return {(s, a): (DEAD if s == DEAD else "q1") for s in ("q0", "q1", DEAD) for a in string.ascii_lowercase}


def check(states: DataFrame, transitions: DataFrame) -> DataFrame:
    """(problem): what keeps the tables from being a complete deterministic automaton; empty if sound."""
    one_start = states.agg((F.count_if("is_start") != 1).alias("bad")).where("bad").select(F.lit("not exactly one start state").alias("problem"))
    double = transitions.groupBy("src", "symbol").count().where("count > 1").select(F.concat_ws(" ", F.lit("two moves:"), "src", "symbol").alias("problem"))
    symbols = transitions.agg(F.countDistinct("symbol")).scalar()
    gaps = states.join(transitions.groupBy(F.col("src").alias("state")).agg(F.countDistinct("symbol").alias("n")), "state", "left").where(F.coalesce("n", F.lit(0)) != symbols).select(F.concat_ws(" ", F.lit("moves missing:"), "state").alias("problem"))
    ends = transitions.select(F.explode(F.array("src", "dst")).alias("state")).distinct().join(states, "state", "left_anti").select(F.concat_ws(" ", F.lit("unknown state:"), "state").alias("problem"))
    return one_start.unionByName(double).unionByName(gaps).unionByName(ends)
