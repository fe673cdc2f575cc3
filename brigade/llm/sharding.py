"""Extendible hashing with column expressions only.

A row's key is hashed to 60 bits. A bucket is a prefix of these bits; the directory starts with one bucket, and only
buckets over the byte limit split, on one more bit, until each fits. Several bits are looked at in one pass: a
bucket's bytes at every further depth come from one grouping, and its split stops at the first depth that fits.

A row larger than the limit ends alone in a bucket that is marked as not fitting. Rows that share all bits (repeated
keys) and are still too many go to overflow pages within the limit. Null keys count as empty text, null texts as no
bytes. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brigade.llm.joins import attach
from brigade.operators.spread import running, settle

BITS = 60
# Bits looked at in one pass: an oversized bucket gives at most 2^STEP cells.
STEP = 12
LIMIT_BYTES = 64 << 20


def key_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _shifted(bits: Column, by: Column) -> Column:
    return F.call_function("shiftright", bits, by.cast("int"))


def _prefix(depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return _shifted(F.col("_h"), F.lit(BITS) - depth)


def _name(prefix: Column, depth: Column) -> Column:
    """The prefix as text of ``depth`` binary digits."""
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.conv(prefix.cast("string"), 10, 2), depth, "0"))


def shards(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES, step: int = STEP) -> DataFrame:
    """Each row's shard: key, n_bytes, shard (bits and overflow page), depth, shard_docs, shard_bytes, fits."""
    rows = settle(
        df.select(
            F.col(f"`{key}`").alias("_key"),
            key_bits(F.col(f"`{key}`")).alias("_h"),
            F.coalesce(F.octet_length(f"`{text}`"), F.lit(0)).cast("long").alias("_bytes"),
        ),
        "keys",
    )
    size = [F.sum("_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs")]
    # the bucket of depth 0 is the whole table
    front = rows.groupBy().agg(*size).where("docs > 0").select(
        F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("depth"), "bytes", "docs")
    stuck = (F.col("bytes") > limit) & (F.col("docs") > 1)
    leaves, depth = [front.where(~stuck)], 0
    front = front.where(stuck)
    while depth < BITS and front.take(1):
        # rows of the oversized buckets only
        inside = attach(
            rows.withColumn("_at", _prefix(depth)), front.select(F.col("prefix").alias("_at"), F.col("docs").alias("_n")),
            ["_at"], "inner", weight="_n", spread_by=["_h"],
        ).drop("_n")
        last = min(depth + step, BITS)
        cells = inside.groupBy(_prefix(last).alias("cell")).agg(*size)
        levels = settle(
            cells.withColumn("depth", F.explode(F.sequence(F.lit(depth + 1), F.lit(last))))
            .groupBy(_shifted(F.col("cell"), F.lit(last) - F.col("depth")).alias("prefix"), "depth")
            .agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs")),
            "levels",
        )
        # a bucket exists where its parent had to split
        split = levels.where(stuck).select(F.col("prefix").alias("up"), (F.col("depth") + 1).alias("depth"))
        born = levels.where(F.col("depth") == depth + 1).unionByName(
            levels.where(F.col("depth") > depth + 1)
            .withColumn("up", _shifted(F.col("prefix"), F.lit(1)))
            .join(split, ["up", "depth"], "left_semi").drop("up")
        )
        leaves.append(born.where(~stuck))
        front, depth = settle(born.where(stuck & (F.col("depth") == last)), "front"), last
    return _assigned(rows, leaves, front if depth == BITS else None, key, limit)


def _assigned(rows: DataFrame, leaves: list[DataFrame], full: DataFrame | None, key: str, limit: int) -> DataFrame:
    """Rows joined to their leaf: one equal join per depth that has leaves, on (prefix, depth)."""
    found = settle(reduce(DataFrame.unionByName, leaves), "leaves")
    if full is not None:
        found = found.unionByName(full)
    depths = found.select(F.collect_set("depth")).scalar()  # at most 61 values, one cell
    tried = rows.withColumn("depth", F.explode(depths)).withColumn("prefix", _prefix(F.col("depth")))
    placed = attach(tried, found, ["prefix", "depth"], "inner", weight="docs", spread_by=["_h", "_key"])
    at = [F.col("_key").alias(key), F.col("_bytes").alias("n_bytes"), _name(F.col("prefix"), F.col("depth")).alias("shard"),
          F.col("depth").cast("long").alias("depth")]
    over = (F.col("bytes") > limit) & (F.col("docs") > 1)
    plain = placed.where(~over).select(*at, F.col("docs").alias("shard_docs"), F.col("bytes").alias("shard_bytes"),
                                       (F.col("bytes") <= limit).alias("fits"))
    if full is None:
        return plain
    # rows that share all bits: pages by running size, a row over half the limit on a page of its own
    big = F.col("_bytes") * 2 > limit
    laid = running(
        placed.where(over).withColumn("_big", big), ["prefix", "_big"], [F.col("_key"), F.col("_bytes")],
        rank="_pos", totals={"_upto": F.col("_bytes")},
    )
    half = max(limit // 2, 1)
    page = F.when(F.col("_big"), F.concat(F.lit("b"), F.col("_pos"))).otherwise(
        F.concat(F.lit("s"), F.floor(F.greatest(F.col("_upto") - 1, F.lit(0)) / half)))
    paged = settle(laid.select("_key", "_bytes", "prefix", "depth", page.alias("_page")), "pages")
    sizes = paged.groupBy("prefix", "_page").agg(F.sum("_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
    name = F.concat_ws("+", _name(F.col("prefix"), F.col("depth")), "_page").alias("shard")
    return plain.unionByName(
        attach(paged, sizes, ["prefix", "_page"], "inner", weight="docs", spread_by=["_key"]).select(
            at[0], at[1], name, at[3], F.col("docs").alias("shard_docs"), F.col("bytes").alias("shard_bytes"),
            (F.col("bytes") <= limit).alias("fits")))
