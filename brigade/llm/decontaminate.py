"""Benchmark decontamination by suffix arrays over the training texts.

The words of a run of documents form one sequence with gaps between documents; its suffixes, sorted by their words,
are a shard's suffix array. Every suffix of the benchmark is looked up in every shard by binary search: the range of
suffixes that begin with its window gives all verbatim occurrences, and the words shared beyond the window give
the longest match and its place.

Only suffixes that begin with as many benchmark words as a window has can be found at all; the others are left out of
the arrays. The benchmark is taken in blocks of bounded size, each in a job of its own over the documents as
the one before has left them, so it may be of any size: a task, and the driver, hold one block. Words are compared by 64-bit hashes of their lower-cased bytes.

A null or empty text has no words and is clean; so is every document when the benchmark is empty. Items
with the same id count as one. All columns of the input are kept; an added column replaces one of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brigade.llm import arrow_text, words
from brigade.operators.spread import settle

WINDOW = 10
# Text bytes of the benchmark in one broadcast block; a longer item makes a block of its own.
BLOCK_BYTES = 16 << 20
ADDED = {
    "n_words": T.LongType(),
    "hits": T.ArrayType(T.LongType()),
    "items": T.ArrayType(T.StringType()),
    "longest_match": T.LongType(),
    "longest_at": T.LongType(),
    "longest_item": T.StringType(),
}


class Suffixes:
    """The benchmark's suffixes of a block: word ids, where windows begin, and whose they are."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        data = np.frombuffer(b"".join(x[1] for x in items), np.uint8)
        at = np.r_[0, np.cumsum([len(x[1]) for x in items])].astype(np.int64)
        _, _, hashes, first = words.find(data, at)
        self.names = [x[0] for x in items]
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        n_words = np.diff(first)
        n_windows = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
        self.item = np.repeat(np.arange(len(items)), n_windows)
        begin = np.repeat(first[:-1] - np.r_[0, np.cumsum(n_windows)[:-1]], n_windows) + np.arange(len(self.item))
        self.begin, self.end = begin, first[1:][self.item]
        self.length = np.minimum(self.end - begin, width)
        self.ids = ids.astype(np.int32) + 1  # id 0: no benchmark word

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of training words, 0 for words that the block does not have."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)


def suffix_array(ids: np.ndarray, last: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts sorted by their next ``depth`` words, and these words row by row; a document's end counts as 0."""
    place = starts[:, None] + np.arange(depth)
    rows = np.where(place < last[starts][:, None], ids[np.minimum(place, len(ids) - 1)], 0)
    order = np.lexsort(rows.T[::-1])
    return starts[order], rows[order]


def _search(rows: np.ndarray, keys: np.ndarray, upper: bool) -> np.ndarray:
    """Where each key belongs among the sorted rows, in front of its equals or behind them: one binary search for all."""
    low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(rows), np.int64)
    each = np.arange(len(keys))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        row = rows[np.minimum(mid, len(rows) - 1)]
        at = (row != keys).argmax(1)  # 0 where all are equal, and then neither is less
        goes_right = (row[each, at] < keys[each, at]) | (upper & (row[each, at] == keys[each, at]))
        low = np.where(open_ & goes_right, mid + 1, low)
        high = np.where(open_ & ~goes_right, mid, high)
    return low


def _found(block: Suffixes, ids: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix of the block, start in ``ids``) of every occurrence of a window.

    ``last[i]``: end of the document that word i is in.
    """
    known, n = np.r_[0, np.cumsum(ids != 0)], len(ids)
    suffixes, places = [], []
    for length in np.unique(block.length).tolist():  # the width, and those of shorter items
        mine = np.nonzero(block.length == length)[0]
        keys = block.ids[block.begin[mine][:, None] + np.arange(length)]
        opens = np.zeros(len(block.vocabulary) + 1, bool)
        opens[keys[:, 0]] = True
        end = np.arange(n) + length
        starts = np.nonzero((end <= last) & (known[np.minimum(end, n)] - known[:n] == length) & opens[ids])[0]
        if not len(starts):
            continue
        starts, rows = suffix_array(ids, last, starts, length)
        low, high = _search(rows, keys, False), _search(rows, keys, True)
        many = high - low
        suffixes.append(np.repeat(mine, many))
        places.append(starts[np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(suffixes or none), np.concatenate(places or none)


def _longest(block: Suffixes, ids: np.ndarray, last: np.ndarray, suffix: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Words that each occurrence shares with its item from its start on."""
    shared = block.length[suffix].copy()
    going = np.arange(len(suffix))
    while len(going):
        a, b = block.begin[suffix[going]] + shared[going], start[going] + shared[going]
        inside = (a < block.end[suffix[going]]) & (b < last[start[going]])
        going, a, b = going[inside], a[inside], b[inside]
        same = block.ids[a] == ids[b]
        going = going[same]
        shared[going] += 1
    return shared


def _scan(block: Suffixes, batch: pa.RecordBatch, names: list[str], keep: list[str], text: str) -> Iterator[pa.RecordBatch]:
    for row, end, data, at in arrow_text.pieces(batch.column(names.index(text))):
        _, _, hashes, first = words.find(data, at)
        ids = block.numbered(hashes)
        last = np.repeat(first[1:], np.diff(first))
        suffix, start = _found(block, ids, last)
        shared = _longest(block, ids, last, suffix, start)
        n = end - row
        part = batch.slice(row, n)
        old = {c: part.column(names.index(c)).to_pylist() for c in ("hits", "items", "longest_match", "longest_at", "longest_item")} if "hits" in names else None
        doc = np.searchsorted(first, start, "right") - 1
        made: dict[str, list] = {c: [] for c in ADDED}
        order = np.argsort(doc, kind="stable")
        bounds = np.searchsorted(doc[order], np.arange(n + 1))
        for k in range(n):
            mine = order[bounds[k] : bounds[k + 1]]
            hits, items, longest = [], [], (0, None, None)
            if len(mine):
                spans = np.unique(np.stack([start[mine] - first[k], block.length[suffix[mine]]], 1), axis=0)
                hit = np.unique(np.concatenate([np.arange(a, a + b) for a, b in spans]))
                hits = hit.tolist()
                items = [block.names[i] for i in np.unique(block.item[suffix[mine]])]
                # of equally long matches the first in the document, then the first item
                best = min(mine, key=lambda x: (-shared[x], start[x], suffix[x]))
                longest = int(shared[best]), int(start[best] - first[k]), block.names[block.item[suffix[best]]]
            if old:
                hits = sorted({*hits, *old["hits"][k]})
                items = [*old["items"][k], *items]
                if old["longest_match"][k] >= longest[0]:
                    longest = old["longest_match"][k], old["longest_at"][k], old["longest_item"][k]
            for c, v in zip(ADDED, (int(first[k + 1] - first[k]), hits, sorted(set(items)), *longest)):
                made[c].append(v)
        yield pa.RecordBatch.from_arrays(
            [*[part.column(names.index(c)) for c in keep],
             *[pa.array(made[c], {"hits": pa.list_(pa.int64()), "items": pa.list_(pa.string())}.get(c) or (pa.string() if c == "longest_item" else pa.int64())) for c in ADDED]],
            names=[*keep, *ADDED],
        )


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in runs of bounded size; the driver holds one run at a time."""
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{text}`").cast("binary").alias("t")).where("t IS NOT NULL")
    block, size = [], 0
    for r in rows.toLocalIterator(prefetchPartitions=False):
        if block and size + len(r["t"]) > limit:
            yield block
            block, size = [], 0
        block.append((r["i"] if r["i"] is not None else "", bytes(r["t"])))
        size += len(r["t"])
    yield block


def scan(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    width: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The input with n_words, hits (places of the words inside an occurrence), items with an occurrence, and the
    longest verbatim match: its words, its place and its item."""
    context = df.sparkSession.sparkContext
    keep = [c for c in df.columns if c.lower() not in ADDED]
    out = df.select(*[f"`{c}`" for c in keep])
    schema = T.StructType([*out.schema.fields, *[T.StructField(c, t) for c, t in ADDED.items()]])
    for number, items in enumerate(_blocks(benchmark, item, item_text, block_bytes)):
        if number:  # the block before is done with when the next one begins
            out = settle(out, "scanned")
        shared = context.broadcast(items)  # at most block_bytes of text, or one item

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = Suffixes(shared.value, width)
            for batch in batches:
                yield from _scan(block, batch, batch.schema.names, keep, text)

        out = out.mapInArrow(work, schema)
    return out

