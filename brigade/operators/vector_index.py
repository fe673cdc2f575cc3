"""Approximate vector top-k: an index of random projections with several probes and exact re-ranking.

Every vector is scaled to length one and given, for each of ``tables`` tables, a code of 32 bits: on which side of 32 random
planes it lies. A bucket is a prefix of a code. Its depth follows the data: it begins at about ``bucket`` vectors for
each prefix of a scope of even vectors, and prefixes that hold more are split by four bits at a time, so a dense region gets
deep, small buckets. Only a bucket of full depth can hold more vectors than that: they are on one side of every plane.

A query looks into its own bucket and into those behind the planes it lies nearest to; what it finds is compared
exactly. So it meets about tables x probes x bucket vectors, however many its scope holds. Recall depends on the data: near
neighbours are found with few probes, the best of evenly spread vectors (with similarities not far above the rest) take many.

Equal vectors are indexed once, with their smallest ids, so a vector in a third of all rows costs one row. Zero vectors
and nulls have no direction and are left out. The planes have entries of 1 and -1 by a fixed rule, so an index can be
extended and queried by other sessions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brigade.operators.spread import attach, settle, top_within
from brigade.operators.vectors import dot, unit

CODE_BITS, STEP = 32, 4
TABLES, BUCKET, PROBES = 16, 128, 8
COPIES = 100  # ids kept of equal vectors: the largest k that a query may ask for


def planes(tables: int, width: int) -> np.ndarray:
    """(width, tables x CODE_BITS) entries: 1 where the first hex digit of the MD5 of 'table:bit:cell' is below 8, else -1."""
    rows = [
        [1.0 if hashlib.md5(f"{t}:{b}:{d}".encode()).hexdigest() < "8" else -1.0 for t in range(tables) for b in range(CODE_BITS)]
        for d in range(width)
    ]
    return np.array(rows).reshape(width, tables * CODE_BITS)


def _margins(column: pa.Array, known: dict[int, np.ndarray], tables: int) -> Iterator[np.ndarray]:
    """(tables, CODE_BITS) margins of each vector; vectors of equal width are projected together."""
    sizes = np.diff(column.offsets.to_numpy())
    out: list = [None] * len(column)
    cells = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for width in np.unique(sizes).tolist():
        if width not in known:
            known[width] = planes(tables, width)
        rows = np.nonzero(sizes == width)[0]
        block = cells[(ends[rows] - width)[:, None] + np.arange(width)]
        for row, m in zip(rows.tolist(), (block @ known[width]).reshape(len(rows), tables, CODE_BITS)):
            out[row] = m
    yield from out


_WEIGHTS = 1 << np.arange(CODE_BITS - 1, -1, -1, dtype=np.int64)


def codes(df: DataFrame, key: str, tables: int) -> DataFrame:
    """(key, table, code) of each unit vector in ``_unit``; the first plane is the highest bit."""
    kind = df.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            made = np.array([(m > 0) @ _WEIGHTS for m in _margins(batch.column(1), known, tables)], np.int64).reshape(-1)
            table = np.tile(np.arange(tables, dtype=np.int32), n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(n), tables))), pa.array(table), pa.array(made)], names=[key, "table", "code"])

    return df.select(key, "_unit").mapInArrow(work, f"{key} {kind}, table int, code bigint")


def probe_codes(df: DataFrame, key: str, tables: int, probes: int) -> DataFrame:
    """(key, table, depth, prefix) to look into: at every depth the own bucket and those behind the nearest planes."""
    kind = df.schema[key].dataType.simpleString()
    depths = range(0, CODE_BITS + 1, STEP)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            rows, found = [], []
            for row, m in enumerate(_margins(batch.column(1), known, tables)):
                for t in range(tables):
                    code = int((m[t] > 0) @ _WEIGHTS)
                    for d in depths:
                        near = np.argsort(np.abs(m[t][:d]), kind="stable")[: probes - 1].tolist()
                        own = code >> (CODE_BITS - d)
                        made = [own, *[own ^ (1 << (d - 1 - b)) for b in near]]
                        found += [(t, d, p) for p in made]
                        rows += [row] * len(made)
            table, depth, prefix = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(table, pa.int32()), pa.array(depth, pa.int32()), pa.array(prefix, pa.int64())],
                names=[key, "table", "depth", "prefix"])

    return df.select(key, "_unit").mapInArrow(work, f"{key} {kind}, table int, depth int, prefix bigint")


class Index(NamedTuple):
    scope: tuple[str, ...]
    chunk_id: str
    tables: int
    vectors: DataFrame  # scope, _vector (a key), _unit, _ids: the distinct vectors
    buckets: DataFrame  # scope, table, depth, prefix, _vector, _n (vectors in the bucket)


def _prefix(depth: Column) -> Column:
    return F.call_function("shiftright", F.col("code"), (F.lit(CODE_BITS) - depth).cast("int"))


def build(
    chunks: DataFrame, scope: Sequence[str], chunk_id: str = "chunk_id", embedding: str = "embedding", tables: int = TABLES, bucket: int = BUCKET,
) -> Index:
    """Index every vector; both tables are settled."""
    scope = list(scope)
    rows = chunks.select(*scope, F.col(chunk_id).alias("_id"), F.col(embedding).alias("_raw")).where(F.col("_raw").isNotNull())
    # the smallest ids of each vector; Spark keeps only so many in each task before the shuffle
    first = top_within(rows, [*scope, "_raw"], [F.col("_id")], COPIES, "_place")
    vectors = first.groupBy(*scope, "_raw").agg(
        F.min("_id").alias("_vector"), F.sort_array(F.collect_list("_id")).alias("_ids")
    ).select(*scope, "_vector", unit("_raw").alias("_unit"), "_ids").where(F.col("_unit").isNotNull())
    vectors = settle(vectors.withColumn("_key", F.struct(*scope, "_vector")), "vectors")
    sizes = vectors.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n"))
    over = F.floor(F.col("_n") / bucket)
    begin = F.when(over < 1, 0).otherwise(F.ceil(F.length(F.bin(over)) / STEP) * STEP)
    coded = codes(vectors, "_key", tables).select("_key.*", "table", "code")
    start = sizes.select(*scope, F.least(begin, F.lit(CODE_BITS)).cast("int").alias("depth"), "_n")
    open_rows = settle(attach(coded, start, scope, "inner", weight="_n", spread_by=["_vector"]).drop("_n"), "codes")
    done = None
    while True:
        at = [*scope, "table", "depth", "prefix"]
        placed = open_rows.withColumn("prefix", _prefix(F.col("depth")))
        counts = placed.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
        known = settle(attach(placed, counts, at, "inner", weight="_n", spread_by=["_vector"]), "placed")
        fits = (F.col("_n") <= bucket) | (F.col("depth") >= CODE_BITS)
        part = known.where(fits).select(*at, "_vector", "_n")
        done = part if done is None else done.unionByName(part)
        open_rows = known.where(~fits).select(*scope, "_vector", "table", "code", F.least(F.col("depth") + STEP, F.lit(CODE_BITS)).alias("depth"))
        if open_rows.isEmpty():  # at most CODE_BITS / STEP rounds, each over what is left
            break
    return Index(tuple(scope), chunk_id, tables, vectors.drop("_key"), done)


def candidates(index: Index, queries: DataFrame, query_id: str = "query_id", probes: int = PROBES) -> DataFrame:
    """(query, scope, _vector): what the probes of a query meet, each vector once. Wants ``_unit`` in the queries."""
    scope = list(index.scope)
    asked = queries.select(query_id, *scope, "_unit").withColumn("_key", F.struct(query_id, *scope))
    depths = index.buckets.select(*scope, "table", "depth").distinct()  # at most nine for each scope and table
    looks = attach(probe_codes(asked, "_key", index.tables, probes).select("_key.*", "table", "depth", "prefix"), depths, [*scope, "table", "depth"], "inner")
    at = [*scope, "table", "depth", "prefix"]
    uses = looks.groupBy(*at).agg(F.count(F.lit(1)).alias("_q"))
    # a bucket has few vectors but may be asked by many queries: those are spread over copies of it
    buckets = index.buckets.drop("_n").join(uses, at)
    return attach(looks, buckets, at, "inner", weight="_q", spread_by=[query_id]).select(query_id, *scope, "_vector").distinct()


def similar_chunks(index: Index, queries: DataFrame, k: int = 5, query_id: str = "query_id", probes: int = PROBES) -> DataFrame:
    """The k most similar chunks of the query's scope among those that the probes meet: the columns of the exact search."""
    if k > COPIES:
        raise ValueError(f"k may be at most {COPIES}")
    scope = list(index.scope)
    q = settle(queries.select(query_id, *scope, unit("embedding").alias("_unit")).where(F.col("_unit").isNotNull()), "queries")
    met = settle(candidates(index, q, query_id, probes), "candidates")
    uses = met.groupBy(*scope, "_vector").agg(F.count(F.lit(1)).alias("_n"))
    used = index.vectors.join(uses, [*scope, "_vector"])
    pairs = attach(met, used, [*scope, "_vector"], "inner", weight="_n", spread_by=[query_id]).select(query_id, *scope, "_ids", F.col("_unit").alias("_c"))
    mine = attach(pairs, q.select(query_id, *scope, F.col("_unit").alias("_q")), [query_id, *scope], "inner")
    scored = mine.select(query_id, *scope, "_ids", dot(F.col("_c"), F.col("_q")).alias("similarity"))
    # k vectors are enough before copies are unfolded, and k rows behind that
    best = top_within(scored, [query_id, *scope], [F.col("similarity").desc(), F.col("_ids")[0]], k, "_place")
    rows = best.select(query_id, *scope, F.explode("_ids").alias(index.chunk_id), "similarity")
    return top_within(rows, [query_id, *scope], [F.col("similarity").desc(), F.col(index.chunk_id)], k)
