"""Connected components of an edge table by alternating large and small stars.

Each round gives every node's neighbours the smallest node near it; rounds end when the edges are stars. Minima are
taken with map-side combine; they are joined back by a plain equal join, of which a node with very many neighbours
is split at run time (adaptive skew join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from brigade.operators.spread import settle


def _stars(edges: DataFrame) -> DataFrame:
    """Each node u of (u, v) with its smallest neighbour."""
    return edges.groupBy("u").agg(F.min("v").alias("low"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _stars(both).withColumn("low", F.least("low", "u"))
    return (
        both.join(low, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("low").alias("v"))
        .where(F.col("u") != F.col("v")).distinct()
    )


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    low = _stars(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b); the label is the smallest node of its component."""
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    seen, state = None, ()
    while state != seen:
        seen, note = state, Observation()
        marks = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        now = settle((now if state == () else _small(_large(now))).observe(note, *marks), "edges")
        state = note.get
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
