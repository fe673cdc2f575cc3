"""Chat formatting after cumulative-snapshot collapse, with column expressions only.

A service that logs a conversation after every turn leaves many conversations that are prefixes of longer ones.
Each turn gets the rolling hash of its conversation up to it; a conversation whose last hash is the hash of an earlier
turn elsewhere is a snapshot and goes, and of equal conversations the one with the smallest id stays. What is left
is rendered.

Turns follow (turn, role, text), null turns first. Null roles and texts count as empty, exactly repeated rows as one.
Rows with a null conversation id form one conversation. A conversation of more than ``page_turns`` turns continues on
further pages, so no row grows without bound. Hashes are 120 bits wide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brigade.llm.joins import attach
from brigade.operators.spread import running, settle

PAGE_TURNS = 1000


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id of the conversations that no other one continues, n_turns, and n_copies with equal turns."""
    hashes = {}
    for k in range(2):  # two sums of 60-bit terms that depend on the place of the turn
        term = F.xxhash64(F.lit(k), "pos", "role", "text")
        hashes[f"h{k}"] = F.pmod(term, F.lit((1 << 60) - 1)).cast("decimal(20,0)")
    rolling = settle(
        running(turns.select("conv_id", "pos", "n_turns", *[c.alias(n) for n, c in hashes.items()]),
                ["conv_id"], [F.col("pos")], rank="_again", totals={"p0": F.col("h0"), "p1": F.col("h1")}, stored=True),
        "prefixes",
    )
    key = ["n_turns", "p0", "p1"]
    whole = rolling.where(F.col("pos") == F.col("n_turns")).groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    shorter = rolling.where(F.col("pos") < F.col("n_turns")).select(F.col("pos").alias("n_turns"), "p0", "p1").distinct()
    return whole.join(shorter, key, "left_anti").select("conv_id", "n_turns", "n_copies")


def render(df: DataFrame, page_turns: int = PAGE_TURNS) -> DataFrame:
    """Maximal conversations as text: conv_id, page (0 for most), n_turns, n_copies, rendered."""
    rows = df.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()
    turns = settle(
        running(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], rank="pos", size="n_turns"),
        "turns",
    )
    kept = maximal(turns).select(
        F.struct("conv_id").alias("_id"), F.col("n_turns").alias("_n"), "n_copies")
    # as a struct a null id equals itself
    near = attach(turns.withColumn("_id", F.struct("conv_id")), kept, ["_id"], "inner", weight="_n", spread_by=["pos"])
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n"))
    return (
        near.select("conv_id", "pos", "n_turns", "n_copies", F.floor((F.col("pos") - 1) / page_turns).cast("long").alias("page"), line.alias("line"))
        .groupBy("conv_id", "page", "n_turns", "n_copies")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "").alias("rendered"))
    )
