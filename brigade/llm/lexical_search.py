"""Ranked lexical search: the best documents of every query, by range-maximum tables on posting lists.

Documents are read twice. First their terms (maximal runs of letters and digits of ASCII, A-Z lower-cased, and of all bytes
beyond ASCII; null has none) are counted into one narrow row each, which gives the number of documents N, their length L and
each term's document frequency. Then the rows are searched in shards, each with posting lists of impacts, sorted by document
and topped by a sparse table (see ``range_maxima``); a task carries what it has found from shard to shard, and leaves
at most k rows for each query, of which the best are ranked.

A posting's impact is w * ((1000000000 * tf) div (1000 * tf + 8 * m)) with w = floor(1000 * ln((2N + 2) / (2 df + 1))) and
m = 25 + (75 * n * N) div L; a score is the sum over the query's terms, repeats included. All but the logarithm is whole
64-bit numbers, so the result does not depend on shards or order. Terms are told apart by a 64-bit hash.

Only terms of queries are kept, so a row is as long as the number of them in the document. Queries are taken in
blocks of bounded text, which are broadcast; every block reads the documents anew. No pair of a query and a document is
made but for those that a task keeps.

Every row of the documents is ranked on its own, also where ids repeat; a null id ranks behind all others of its score.
Every row of the queries is a query of its own. Queries without a known term, and documents without one, give no rows.
Columns beyond the named ones are not read. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brigade.llm import arrow_text, words
from brigade.llm.range_maxima import LAST, Best, Shard
from brigade.operators.spread import _settled, top_within

TOP = 10
# Text of the queries that are broadcast at once; a longer query is a block of its own.
BLOCK_BYTES = 4 << 20
# Postings of a shard; a document is never cut.
SHARD_POSTINGS = 1 << 20
_ROWS = "doc_id bigint, n_terms bigint, terms array<int>, times array<int>"


class Queries(NamedTuple):
    items: list  # the ids
    hashes: np.ndarray  # of all terms, ascending
    terms: list[np.ndarray]  # for each query: places in hashes
    times: list[np.ndarray]  # and how often they occur


def _queries(rows: list) -> Queries:
    found = [words.find(data, np.array([0, len(data)]))[2] for _, t in rows for data in [np.frombuffer(t, np.uint8)]]
    hashes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    counted = [np.unique(np.searchsorted(hashes, f), return_counts=True) for f in found]
    return Queries([i for i, _ in rows], hashes, [c[0] for c in counted], [c[1] for c in counted])


def _blocks(queries: DataFrame, item: str, text: str, limit: int) -> Iterator[Queries]:
    """The queries in runs of bounded size; the driver holds one run at a time."""
    rows = queries.select(F.col(f"`{item}`").alias("i"), F.col(f"`{text}`").cast("binary").alias("t")).where("t IS NOT NULL")
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r["t"]) > limit:
            yield _queries(block)
            block, size = [], 0
        block.append((r["i"], bytes(r["t"])))
        size += len(r["t"])
    if block:
        yield _queries(block)


def postings(df: DataFrame, hashes: np.ndarray, key: str, text: str) -> DataFrame:
    """For each document with a term: its id, its number of terms, and the places in ``hashes`` of those it has, with their counts."""
    shared = df.sparkSession.sparkContext.broadcast(hashes)  # of at most BLOCK_BYTES of text

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids = batch.column(0)
            for row, end, data, at in arrow_text.pieces(batch.column(1)):
                _, _, found, first = words.find(data, at)
                n = np.diff(first)
                place = np.searchsorted(known, found)
                ours = np.nonzero(known[np.minimum(place, len(known) - 1)] == found)[0] if len(known) else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(end - row), n)[ours]
                pair, times = np.unique(doc * (len(known) + 1) + place[ours], return_counts=True)
                offsets = np.searchsorted(pair, np.arange(end - row + 1) * (len(known) + 1)).astype(np.int32)
                terms = (pair % (len(known) + 1)).astype(np.int32)
                made = pa.RecordBatch.from_arrays(
                    [ids.slice(row, end - row), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(offsets, terms),
                     pa.ListArray.from_arrays(offsets, times.astype(np.int32))], names=["doc_id", "n_terms", "terms", "times"])
                yield made.filter(pa.array(n > 0))

    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(work, _ROWS)


def weights(n_docs: int, frequencies: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in frequencies.tolist()], np.int64)


def shard(rows: list[pa.RecordBatch], weight: np.ndarray, n_docs: int, length: int) -> Shard | None:
    """Posting lists of documents, in the order of their ids."""
    table = pa.Table.from_batches(rows).combine_chunks()
    ids, n = table["doc_id"].fill_null(LAST).to_numpy(), table["n_terms"].to_numpy()
    lists, counts = (x.chunk(0) if x.num_chunks else pa.array([], x.type) for x in (table["terms"], table["times"]))
    term, tf = lists.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
    if not len(term):
        return None
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    doc = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
    m = 25 + 75 * n * n_docs // length
    impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
    place = rank[doc]
    by = np.lexsort((place, term))
    return Shard(ids[order], term[by], place[by], impact[by])


def _cut(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows in runs of at most so many postings, or one row."""
    held, size = [], 0
    for batch in batches:
        ends = batch.column(2).offsets.to_numpy().astype(np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + (not held), int(np.searchsorted(ends, ends[at] + limit - size, "right")) - 1)
            if end > at:
                held.append(batch.slice(at, end - at))
                size += int(ends[end] - ends[at])
            if end < batch.num_rows:
                yield held
                held, size = [], 0
            at = end
    if held:
        yield held


def search_block(rows: DataFrame, asked: Queries, n_docs: int, length: int, k: int, shard_postings: int) -> DataFrame:
    """At most k rows of each query and task: the query's number, doc_id and score."""
    counts = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each term of the block
    frequencies = np.zeros(len(asked.hashes), np.int64)
    for t, n in counts:
        frequencies[t] = n
    shared = rows.sparkSession.sparkContext.broadcast((asked.terms, asked.times, weights(n_docs, frequencies)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, times, weight = shared.value
        best = [Best(k) for _ in terms]
        for run in _cut(batches, shard_postings):
            part = shard(run, weight, n_docs, length)
            if part is not None:
                for t, c, b in zip(terms, times, best):
                    part.search(t, c, b)
        query = np.repeat(np.arange(len(best), dtype=np.int32), [len(b.ids) for b in best])
        ids = np.concatenate([b.ids for b in best]) if best else np.zeros(0, np.int64)
        scores = np.concatenate([b.scores for b in best]) if best else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(ids, pa.int64(), mask=ids == LAST), pa.array(scores)], names=["query", "doc_id", "score"])

    return rows.mapInArrow(work, "query int, doc_id bigint, score bigint")


def ranked(
    df: DataFrame, queries: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES, shard_postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """(item, rank, doc_id, score): the k best documents of every query, equal scores by id."""
    spark = df.sparkSession
    kind = queries.schema[item].dataType
    empty = spark.createDataFrame([], "rank int, doc_id bigint, score bigint").select(F.lit(None).cast(kind).alias(item), "*")
    found = None
    for asked in _blocks(queries, item, item_text, block_bytes):
        rows, seen = _settled(
            postings(df, asked.hashes, key, text), "postings", n=F.count(F.lit(1)), length=F.sum("n_terms"))
        if not seen["n"]:
            continue
        best = search_block(rows, asked, seen["n"], seen["length"], k, shard_postings)
        first = top_within(best, ["query"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k)
        names = spark.createDataFrame(list(enumerate(asked.items)), f"query int, {item} {kind.simpleString()}")
        named = first.join(F.broadcast(names), "query").select(item, "rank", "doc_id", "score")  # ids of one block
        found = named if found is None else found.unionByName(named)
    return empty if found is None else found
