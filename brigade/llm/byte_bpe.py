"""Byte-level BPE encoding and decoding over whole texts.

Boundaries come from `pretokens`; distinct pre-tokens are merged together and kept in a cache of bounded size. Ids are turned back into bytes through the vocabulary alone.

Nulls and empty texts encode to no ids and decode to no bytes. All columns of the input are kept; a column
that the operator adds replaces one of the same name.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from brigade.llm import arrow_text, pretokens
from brigade.llm.merging import PairMerger

# A rank file is broadcast; none may be larger than this.
VOCABULARY_BYTES = 64 << 20
# Distinct pre-tokens kept by a worker; when full the cache starts anew, results are the same.
CACHE_ENTRIES = 150_000
# Longer pre-tokens are merged but not kept.
CACHE_KEY_BYTES = 64
OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType()),
    "offsets": T.ArrayType(T.IntegerType()),
    "decoded": T.BinaryType(),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def read_ranks(path: str) -> bytes:
    """The rank file (token in base 64, rank), checked to be small enough to broadcast."""
    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """Ranks to merge by, and the bytes of each id."""

    def __init__(self, lines: bytes):
        pairs = (line.split() for line in lines.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        ranks = self.ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        # two parts merge when their concatenation has a rank, whichever parts these are
        splits = [(a, b, r) for t, r in ranks.items() for i in range(1, len(t))
                  if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
        table = np.array(splits, np.int64).reshape(-1, 3)
        of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.merger = PairMerger(of_byte, table[:, 0], table[:, 1], table[:, 2], table[:, 2])
        self.cache: dict[bytes, tuple[tuple[int, ...], str]] = {}

    def encode_all(self, words: Sequence[bytes]) -> list[tuple[tuple[int, ...], str]]:
        """Ids of each pre-token, and the same in decimal; new pre-tokens are merged together."""
        found = list(map(self.cache.get, words))
        missed = [i for i, x in enumerate(found) if x is None]
        if missed:
            new = list({words[i] for i in missed})
            ids, sizes = self.merger.merge(new)
            ids, ends = ids.tolist(), np.cumsum(sizes).tolist()
            fresh = {}
            for w, a, b in zip(new, [0, *ends], ends):
                made = (self.ranks[w],) if w in self.ranks else tuple(ids[a:b])
                fresh[w] = made, " ".join(map(str, made))
            for i in missed:
                found[i] = fresh[words[i]]
            if len(self.cache) + len(fresh) > CACHE_ENTRIES:
                self.cache.clear()
            self.cache.update((w, x) for w, x in fresh.items() if len(w) <= CACHE_KEY_BYTES)
        return found

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[int, Codec] = {}


def _codec(lines: bytes) -> Codec:
    """One codec per worker and rank file."""
    key = hash(lines)
    if key not in _codecs:
        _codecs[key] = Codec(lines)
    return _codecs[key]


def encode(df: DataFrame, ranks: bytes, text: str = "text", outputs: Sequence[str] = ("ids", "offsets")) -> DataFrame:
    """The input with the asked columns added.

    ids: token ids. offsets: byte offset of each pre-token. decoded: bytes made from the ids.
    n_tokens; ids_sha256 over the decimal ids joined by a blank; decoded_sha256 over the decoded bytes.
    """
    spark = df.sparkSession
    # at most VOCABULARY_BYTES, see read_ranks
    shared = spark.sparkContext.broadcast(ranks)
    keep = [c for c in df.columns if c.lower() not in outputs]
    source = df.select(*[f"`{c}`" for c in keep])
    schema = T.StructType([*source.schema.fields, *[T.StructField(c, OUTPUTS[c]) for c in outputs]])
    outputs = list(outputs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        kinds = {"ids": pa.list_(pa.int32()), "offsets": pa.list_(pa.int32()), "decoded": pa.binary(), "n_tokens": pa.int64()}
        with arrow_text.quiet():
            for batch in batches:
                for row, end, data, at in arrow_text.pieces(batch.column(keep.index(text))):
                    made = _encode_piece(codec, data, at, outputs)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.slice(row, end - row).columns, *[pa.array(made[c], kinds.get(c, pa.string())) for c in outputs]],
                        names=[*keep, *outputs],
                    )

    return source.mapInArrow(work, schema)


def _encode_piece(codec: Codec, data: np.ndarray, at: np.ndarray, outputs: Sequence[str]) -> dict[str, list]:
    cuts = pretokens.boundaries(data, at)
    whole = data.tobytes()
    marks = [*cuts.tolist(), len(whole)]
    found = codec.encode_all([whole[a:b] for a, b in zip(marks, marks[1:])])
    bounds = np.searchsorted(cuts, at, "left").tolist()
    made: dict[str, list] = {c: [] for c in outputs}
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        part = found[a:b]
        ids = list(chain.from_iterable([x[0] for x in part]))
        decoded = codec.decode(ids) if "decoded" in made or "decoded_sha256" in made else b""
        for c in outputs:
            if c == "ids":
                made[c].append(ids)
            elif c == "offsets":
                made[c].append((cuts[a:b] - at[k]).astype(np.int32))
            elif c == "decoded":
                made[c].append(decoded)
            elif c == "n_tokens":
                made[c].append(len(ids))
            elif c == "ids_sha256":
                made[c].append(hashlib.sha256(" ".join([x[1] for x in part]).encode()).hexdigest())
            else:
                made[c].append(hashlib.sha256(decoded).hexdigest())
    return made
