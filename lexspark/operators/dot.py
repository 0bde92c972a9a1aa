"""DOT text of the automata, in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: States (name, accepting) and moves of the noun-plural diagram.
NOUN_STATES = (("q0", False), ("qN", False), ("qES", False), ("qY", False), ("qF", True), ("qD", False))
NOUN_EDGES = (
    ("q0", "letter : same", "qN"),
    ("qN", "normal letter : same", "qN"),
    ("qN", "s/x/z : same", "qES"),
    ("qN", "ch/sh : same", "qES"),
    ("qN", "y : y", "qY"),
    ("qN", "END : +N+SG", "qF"),
    ("qN", "s : +N+PL", "qF"),
    ("qES", "es : +N+PL", "qF"),
    ("qY", "ies : +N+PL", "qF"),
    ("qES", "s : Invalid", "qD"),
    ("qY", "s : Invalid", "qD"),
)


def noun_states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, s == "q0", f) for s, f in NOUN_STATES], "state string, is_start boolean, is_accept boolean")


def noun_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOUN_EDGES), "src string, label string, dst string")


def dot(edges: DataFrame, states: DataFrame | None = None, name: str = "automaton") -> DataFrame:
    """(ord, line): a left-to-right digraph; ``edges`` has src, label, dst."""
    body = edges.select(F.lit(2).alias("part"), F.format_string('  "%s" -> "%s" [label="%s"]', "src", "dst", "label").alias("line"))
    head = edges.sparkSession.createDataFrame([(-1, f"digraph {name} {{"), (0, "  rankdir=LR"), (3, "}")], "part int, line string")
    nodes = head.limit(0)
    if states is not None:
        shape = F.when(F.col("is_accept"), F.lit("doublecircle")).otherwise(F.lit("circle"))
        nodes = states.select(F.lit(1).alias("part"), F.format_string('  "%s" [shape=%s]', "state", shape).alias("line"))
        start = states.where("is_start").select(F.explode(F.array(F.lit('  "" [shape=none]'), F.format_string('  "" -> "%s"', "state"))).alias("line")).select(F.lit(1).alias("part"), "line")
        nodes = nodes.unionByName(start)
    # a diagram is small: one ordered partition
    return head.unionByName(nodes).unionByName(body).orderBy("part", "line").coalesce(1).select(F.monotonically_increasing_id().alias("ord"), "line")
