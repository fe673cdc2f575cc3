"""Removal of repeated byte strings with sparse suffix arrays.

A byte goes when it lies in a 100-byte string that also starts earlier: in a document of smaller id, or before it in the
same one. What repeats is judged on the input.

1. Anchors. Of the 32-byte grams inside a 100-byte string the one with the smallest hash (the leftmost of equals) is its
   anchor, so equal strings have equal anchors at equal places. A text has an anchor every 35 bytes or so, and each
   stands for a run of string starts.
2. An anchor whose gram occurs once in the corpus cannot belong to a repeat. A task asks for each of its grams once.
3. Around each anchor that is left, the bytes of its run of strings are sent to the task of its gram. Equal surroundings
   within a task are sent once, the later ones are removed there and then.
4. There the bytes from the anchor on are sorted as suffixes, and so are the bytes before it, read backwards: multikey
   quicksort to a shallow depth, blind tries below. Two strings are equal when their ends agree in the one array and
   their fronts in the other, which is read off the common prefixes; of equal strings the first stays.

A gram that occurs HOT_ROWS times or more is split: each of its strings is sent to a task of its own hash. A removed
string that cuts a character leaves its remaining bytes, so what is kept is binary.

Null and empty texts, and those under 100 bytes, keep all they have. Null ids sort before all others; rows with the same
id count as one document, of which equal rows stay or go alike. An id must be an integer. All columns of the input are
kept; an added column replaces one of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brigade.llm import arrow_text, deep_shallow
from brigade.llm.words import powers
from brigade.llm.joins import attach, fresh
from brigade.operators.spread import settle

LENGTH = 100
GRAM = 32
# Occurrences from which on the strings of a gram are dealt out one by one.
HOT_ROWS = 200_000
# Anchors a task gathers before it asks for their grams, and surroundings it remembers as sent; what lies beyond is asked
# for and sent again, with the same result.
ASKED_ROWS, SENT_ROWS = 2_000_000, 400_000
# Measured size up to which the spans are broadcast to the texts.
SPANS_BYTES = 32 << 20
_BASE = 0xC2B2AE3D27D4EB4F | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW32 = np.uint64(0xFFFFFFFF)
# A spot packs an anchor (40 bits) with how far before it its first and last string start (8 bits each).
ADDED = {
    "n_bytes": T.LongType(),
    "n_removed": T.LongType(),
    "spans": T.ArrayType(T.ArrayType(T.LongType())),
    "kept": T.BinaryType(),
}


def anchors(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, place, first start, last start) of every anchor of a piece; places count from the piece's start."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.view(np.uint64), none, none, none
    assert n < 1 << 32
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n)[:n], out=sums[1:])
    grams = arrow_text.mixed((sums[gram:] - sums[:-gram]) * powers(_INVERSE, n)[: n - gram + 1])
    # the upper half orders, the place breaks ties to the left
    low = grams & ~_LOW32 | np.arange(len(grams), dtype=np.uint64)
    reach, width = 1, length - gram + 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    place = (low & _LOW32).astype(np.int64)
    sizes = np.diff(at)
    n_starts = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), n_starts)
    start = np.repeat(at[:-1] - np.r_[0, np.cumsum(n_starts)[:-1]], n_starts) + np.arange(len(text))
    if not len(start):
        return none.view(np.uint64), none, none, none
    place = place[start]
    new = np.nonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])[0]
    last = np.r_[new[1:], len(start)] - 1
    return grams[place[new]], place[new], start[new], start[last]


def _asked(length: int, gram: int):
    """Per task: each gram once with its count, to be looked up; further occurrences are repeats already."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids = np.array(batch.column(0))
            for row, end, data, at in arrow_text.pieces(batch.column(1)):
                key, place, first, last = anchors(data, at, length, gram)
                doc = np.searchsorted(at, place, "right") - 1
                spot = (place - at[doc]) << 16 | (place - first) << 8 | (place - last)
                parts.append((key, ids[row + doc], spot))
                held += len(key)
                if held >= ASKED_ROWS:
                    yield from questions(*(np.concatenate(x) for x in zip(*parts)))
                    parts, held = [], 0
        if held:
            yield from questions(*(np.concatenate(x) for x in zip(*parts)))

    def questions(key: np.ndarray, ids: np.ndarray, spot: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.r_[True, key[1:] != key[:-1]][: len(key)]
        count = np.zeros(len(key), np.int64)
        heads = np.nonzero(first)[0]
        count[heads] = np.diff(np.r_[heads, len(key)])
        # what is known already goes anywhere: dealt by place, not by gram, and with its gram beside it
        deal = np.where(first, key, arrow_text.mixed(spot[order].astype(np.uint64) ^ ids[order].view(np.uint64))).view(np.int64)
        for x in range(0, len(key), 1 << 16):
            s = slice(x, x + (1 << 16))
            o = order[s]
            yield pa.RecordBatch.from_arrays(
                [pa.array(deal[s]), pa.array(ids[o]), pa.array(spot[o]), pa.array(count[s]), pa.array(key[s].view(np.int64), mask=first[s])],
                names=["deal", "id", "spot", "n", "key"],
            )

    return work


def _repeated(hot_rows: int):
    """Occurrences of grams that are repeated. Only hot grams, and those not asked for here, are named."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            deal, ids, spot, n = (np.array(c) for c in batch.columns[:4])
            parts.append((np.where(n > 0, deal, np.array(batch.column(4).fill_null(0))), ids, spot, n))
        if not parts:
            return
        key, ids, spot, n = (np.concatenate(x) for x in zip(*parts))
        asked = n > 0
        order = np.argsort(key[asked], kind="stable")
        sorted_key = key[asked][order]
        heads = np.nonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]][: len(sorted_key)])[0]
        total = np.add.reduceat(n[asked][order], heads) if len(heads) else np.zeros(0, np.int64)
        of_row = np.zeros(len(key), np.int64)
        of_row[np.nonzero(asked)[0][order]] = np.repeat(total, np.diff(np.r_[heads, len(sorted_key)]))
        keep, hot = ~asked | (of_row > 1), of_row >= hot_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[keep]), pa.array(spot[keep]), pa.array(hot[keep]), pa.array(key[keep], mask=(asked & ~hot)[keep])],
            names=["id", "spot", "hot", "key"])

    return work


def _surroundings(length: int):
    """Per task: the bytes around each anchor, once; further equal ones as strings to remove."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            ids, tags = (np.array(batch.column(c)) for c in (0, 1))
            data, at = arrow_text.flat_utf8(batch.column(2))
            spots, spot_at = batch.column(3).flatten(), np.r_[0, np.cumsum(np.array(batch.column(3).value_lengths()))]
            hot, spots = np.array(batch.column(4).flatten()), np.array(spots)
            row = np.repeat(np.arange(len(ids)), np.diff(spot_at))
            place, before, upto = spots >> 16, spots >> 8 & 0xFF, spots & 0xFF
            # spots of another row with the same id may lie beyond this text; those inside do no harm
            fits = place - upto + length <= np.diff(at)[row]
            row, place, before, upto, hot = (x[fits] for x in (row, place, before, upto, hot))
            rel = before
            if hot.any():  # every string of a hot gram on its own
                times = np.where(hot, before - upto + 1, 1)
                step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, place, before, upto, hot = (np.repeat(x, times) for x in (row, place, before, upto, hot))
                before = np.where(hot, before - step, before)
                upto = np.where(hot, before, upto)
                rel = np.where(hot, 0, before)
            first = place - before
            n = before - upto + 1
            low = at[row] + first
            whole = data.tobytes()
            context, keys, sent = [], [], np.zeros(len(row), bool)
            # smaller ids first, so that hardly anything is sent twice
            for k in np.lexsort((place, ids[row])).tolist():
                x = whole[low[k] : low[k] + n[k] - 1 + length]
                digest = hashlib.blake2b(x, digest_size=16, salt=bytes([rel[k]])).digest()
                mark = (int(ids[row[k]]), int(first[k]))
                known = seen.get(digest)
                if known is None or mark <= known:
                    if len(seen) >= SENT_ROWS:
                        seen.clear()
                    seen[digest] = mark
                    sent[k] = True
                    context.append(x)
                    gram = digest if hot[k] else hashlib.blake2b(x[rel[k] : rel[k] + GRAM], digest_size=8).digest()
                    keys.append(int.from_bytes(gram[:8], "little", signed=True))
            order = np.lexsort((place, ids[row]))
            kept, rest = order[sent[order]], np.nonzero(~sent)[0]
            # neighbouring strings to remove as one run
            rest = rest[np.lexsort((first[rest], row[rest]))]
            new = np.r_[True, (row[rest][1:] != row[rest][:-1]) | (first[rest][1:] > (first + n)[rest][:-1])][: len(rest)]
            heads = np.nonzero(new)[0]
            runs = np.maximum.reduceat((first + n)[rest], heads) - first[rest[heads]] if len(heads) else np.zeros(0, np.int64)
            rest = rest[heads]
            none = np.zeros(len(rest), np.int64)
            deal = arrow_text.mixed(first[rest].astype(np.uint64) ^ ids[row[rest]].view(np.uint64)).view(np.int64)
            for who, texts, *columns in ((kept, context, np.array(keys, np.int64), n[kept], rel[kept]), (rest, None, deal, runs, none)):
                for x in range(0, len(who), 1 << 15):
                    s, y = who[x : x + (1 << 15)], slice(x, x + (1 << 15))
                    to, size, before_anchor = (pa.array(c[y]) for c in columns)
                    yield pa.RecordBatch.from_arrays(
                        [to, pa.array(ids[row[s]]), pa.array(tags[row[s]]), pa.array(first[s]), size, before_anchor,
                         pa.array(texts[y], pa.binary()) if texts is not None else pa.nulls(len(s), pa.binary())],
                        names=["deal", "id", "tag", "first", "n", "rel", "context"],
                    )

    return work


def _later(length: int):
    """Per task: the runs of string starts that also start earlier."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int, bytes], int] = {}
        parts = []
        for batch in batches:
            given = np.array(batch.column(6).is_valid())
            columns = [np.array(batch.column(c)) for c in range(6)]
            if not given.all():
                _, ids, tags, first, n, _ = (c[~given] for c in columns)
                yield _removed(ids, tags, first, n)
            columns = [c[given] for c in columns]
            texts = batch.column(6).filter(pa.array(given)).to_pylist()
            of = [known.setdefault(x, len(known)) for x in zip(columns[0].tolist(), columns[5].tolist(), texts)]
            parts.append([*columns[1:5], np.array(of, np.int64)])
        if not known:
            return
        ids, tags, first, n, of = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((first, ids, of))
        heads = order[np.r_[True, np.diff(of[order]) != 0]]  # the first member of each class
        later = (ids != ids[heads][of]) | (first != first[heads][of])
        yield _removed(ids[later], tags[later], first[later], n[later])
        classes = list(known)
        deal = np.array([c[0] for c in classes], np.int64)
        _, group, size = np.unique(deal, return_inverse=True, return_counts=True)
        several = np.nonzero(size[group] > 1)[0]
        if not len(several):
            return
        rel = np.array([classes[c][1] for c in several], np.int64)
        which, back = _equal_starts(
            [classes[c][2] for c in several], group[several], rel, n[heads[several]],
            ids[heads[several]], first[heads[several]] + rel, length)
        # the class's members that are its first one lose these starts; there may be equal rows of them
        lost: dict[int, list[int]] = {}
        for c, j in zip(which.tolist(), back.tolist()):
            lost.setdefault(int(several[c]), []).append(j)
        firsts = np.nonzero(~later)[0]
        out: list[tuple[int, int, int, int]] = []
        for m in firsts[np.isin(of[firsts], list(lost))].tolist():
            c = int(of[m])
            starts = np.sort(first[m] + classes[c][1] - np.array(lost[c]))
            for run in np.split(starts, np.nonzero(np.diff(starts) > 1)[0] + 1):
                out.append((ids[m], tags[m], run[0], len(run)))
        if out:
            yield _removed(*(np.array(x, np.int64) for x in zip(*out)))

    return work


def _equal_starts(contexts, group, rel, n, ids, place, length) -> tuple[np.ndarray, np.ndarray]:
    """(class, bytes from the start to the anchor) of every string that an earlier class of its group has too."""
    m = len(contexts)
    size = np.fromiter(map(len, contexts), np.int64, m)
    # eight leading bytes keep the groups apart
    name = group.astype(">u8").view(np.uint8).reshape(m, 8)
    flat, begin = np.frombuffer(b"".join(contexts), np.uint8), np.cumsum(size) - size
    sides = []
    for forward in (True, False):
        reach = size - rel if forward else rel
        width = int(reach.max())
        step = np.arange(width)
        at = (begin + rel)[:, None] + step if forward else (begin + rel - 1)[:, None] - step
        rows = np.where(step < reach[:, None], flat[np.clip(at, 0, len(flat) - 1)], 0).astype(np.uint8)
        sides.append(deep_shallow.suffix_array(np.hstack([name, rows]), reach + 8))
    back = np.arange(int(rel.max()) + 1)
    which, far = [], []
    for j in back.tolist():
        has = (rel - n + 1 <= j) & (j <= rel)
        if not has.any():
            continue
        interval = []
        for (order, common), depth in zip(sides, (length - j, j)):
            number = np.empty(m, np.int64)
            number[order] = np.cumsum(common < depth + 8)
            interval.append(number)
        who = np.nonzero(has)[0]
        who = who[np.lexsort((place[who], ids[who], interval[1][who], interval[0][who]))]
        same = (interval[0][who[1:]] == interval[0][who[:-1]]) & (interval[1][who[1:]] == interval[1][who[:-1]])
        heads = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(who)), 0))
        head = who[heads]
        later = who[(ids[who] != ids[head]) | (place[who] != place[head])]
        which.append(later)
        far.append(np.full(len(later), j))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(which or none), np.concatenate(far or none)


def _removed(ids, tags, first, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(tags, pa.int32()), pa.array(first << 32 | n, pa.int64())], names=["id", "tag", "run"])


def _merged(length: int):
    """Runs of starts as the spans of bytes that go."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for runs in batch.column(2):
                run = np.sort(np.array(runs.values))
                low, high = run >> 32, (run >> 32) + (run & 0xFFFFFFFF) - 1 + length
                high = np.maximum.accumulate(high)
                new = np.r_[True, low[1:] > high[:-1]]
                spans.append(np.stack([low[new], high[np.r_[new[1:], True]]], 1).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int64()))], names=["id", "tag", "spans"])

    return work


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, tag, spans) of the texts that lose something; spans: start and end of each, one after the other.

    Wants id, tag (a hash that tells texts with the same id apart) and text.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = docs.select("id", "text").mapInArrow(_asked(length, gram), "deal bigint, id bigint, spot bigint, n bigint, key bigint")
    found = settle(
        asked.repartition(parts, "deal").mapInArrow(_repeated(hot_rows), "id bigint, spot bigint, hot boolean, key bigint"), "repeated")
    # at most one gram in hot_rows anchors is hot
    hot = found.where("hot").select("key", F.lit(True).alias("_hot")).distinct()
    open_ = F.col("key").isNotNull() & ~F.col("hot")
    marked = attach(found.where(open_), hot, ["key"], "left").select("id", "spot", F.coalesce("_hot", F.lit(False)).alias("hot"))
    marked = marked.unionByName(found.where(~open_).select("id", "spot", "hot"))
    spots = marked.groupBy("id").agg(F.collect_list(F.struct("spot", "hot")).alias("_s"))
    spots = spots.select("id", F.col("_s.spot").alias("spots"), F.col("_s.hot").alias("hot"))
    near = attach(docs, spots, ["id"], "inner").select("id", "tag", "text", "spots", "hot")
    sent = near.mapInArrow(_surroundings(length), "deal bigint, id bigint, tag int, first bigint, n bigint, rel bigint, context binary")
    runs = sent.repartition(parts, "deal").mapInArrow(_later(length), "id bigint, tag int, run bigint")
    return runs.groupBy("id", "tag").agg(F.collect_list("run").alias("runs")).mapInArrow(
        _merged(length), "id bigint, tag int, spans array<bigint>")


def dedup(
    df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot_rows: int = HOT_ROWS,
    whole_characters: bool = False,
) -> DataFrame:
    """The input with n_bytes, n_removed, spans (start and end of each removed run) and kept (the remaining bytes).

    With ``whole_characters`` kept is text, without the rest of characters that were cut.
    """
    if not 1 <= gram <= length <= gram + 255:
        raise ValueError("a gram must fit into the string, and at most 256 starts share one")
    keep = [c for c in df.columns if c.lower() not in ADDED]
    ident = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63)))
    tag = F.hash(f"`{text}`")
    docs = df.select(ident.alias("id"), tag.alias("tag"), F.col(f"`{text}`").alias("text"))
    spans = repeated_spans(docs, length, gram, hot_rows)
    a, b, c = (fresh(x, keep) for x in ("_id", "_tag", "_spans"))
    source = df.select(*[F.col(f"`{x}`") for x in keep], ident.alias(a), tag.alias(b))
    joined = attach(source, spans.select(F.col("id").alias(a), F.col("tag").alias(b), F.col("spans").alias(c)), [a, b], broadcast_bytes=SPANS_BYTES)
    joined = joined.select(*[f"`{x}`" for x in keep], c)
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(c, t) for c, t in ADDED.items()]])
    if whole_characters:
        schema["kept"].dataType = T.StringType()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = arrow_text.flat_utf8(batch.column(keep.index(text)))
            whole, at = data.tobytes(), at.tolist()
            n_removed, pairs, kept = [], [], []
            for k, spans in enumerate(batch.column(len(keep)).to_pylist()):
                own, spans = whole[at[k] : at[k + 1]], spans or []
                edges = [0, *spans, len(own)]
                rest = b"".join(own[x:y] for x, y in zip(edges[::2], edges[1::2]))
                kept.append(rest.decode("utf-8", "ignore") if whole_characters else rest)
                pairs.append([list(x) for x in zip(spans[::2], spans[1::2])])
                n_removed.append(len(own) - len(rest))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.diff(at)), pa.array(n_removed, pa.int64()),
                 pa.array(pairs, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string() if whole_characters else pa.binary())],
                names=[*keep, *ADDED],
            )

    return joined.mapInArrow(cut, schema)
