"""Token counts by rank-synchronous merging of ragged arrays.

All new pre-tokens of a batch lie in one symbol array. In every round each sequence finds its lowest-ranked
adjacent pair and merges all its occurrences at once, until no sequence has a pair left; what survives is
counted. Added special tokens that occur in a text count as one token each, as the library's default has it.

Nulls and empty texts have no tokens. All columns of the input are kept; an added column replaces one of the
same name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from brigade.llm import arrow_text, pretokens
from brigade.llm.byte_bpe import CACHE_KEY_BYTES, read_ranks
from brigade.llm.merging import PairMerger

# Distinct pre-tokens kept by a worker; when full the cache starts anew, results are the same.
CACHE_ENTRIES = 1_000_000


@cache
def byte_letters() -> dict[str, int]:
    """The visible letter of every byte in vocabularies of this kind: printable Latin-1 stands for itself,
    the rest follow from code point 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Merges and special strings of one tokenizer."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        model, split = spec["model"], spec["pre_tokenizer"]
        usual = model["type"] == "BPE" and split["type"] == "ByteLevel" and split["use_regex"]
        if not usual or spec["normalizer"] or split["add_prefix_space"] or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE without a normalizer is counted")
        vocabulary = model["vocab"]
        of_byte = np.zeros(256, np.int64)
        for letter, byte in byte_letters().items():
            of_byte[byte] = vocabulary[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = np.array([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        self.merger = PairMerger(of_byte, ids[:, 0], ids[:, 1], np.arange(len(pairs)), ids[:, 2])
        self.specials = [t["content"].encode() for t in spec["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match literally")
        self.cache: dict[bytes, int] = {}

    def count_texts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Tokens of each text of a piece."""
        specials = self._specials_in(data, at)
        # a special string is a segment of its own, its neighbours are pre-tokenised apart
        cuts = np.unique(np.concatenate([at, *specials])) if specials else at
        words, bounds = pretokens.slices(data, cuts)
        each = list(map(self.cache.get, words))
        missed = [i for i, n in enumerate(each) if n is None]
        if missed:
            new = list({words[i] for i in missed})
            size = dict(zip(new, self.merger.merge(new)[1].tolist()))
            for i in missed:
                each[i] = size[words[i]]
            if len(self.cache) + len(size) > CACHE_ENTRIES:
                self.cache.clear()
            self.cache.update((w, n) for w, n in size.items() if len(w) <= CACHE_KEY_BYTES)
        total = np.r_[0, np.cumsum(np.array(each, np.int64))]
        if not specials:
            return total[bounds[1:]] - total[bounds[:-1]]
        segments = total[bounds[1:]] - total[bounds[:-1]]
        segments[np.searchsorted(cuts, specials[0])] = 1
        total = np.r_[0, np.cumsum(segments)]
        here = np.searchsorted(cuts, at)
        return total[here[1:]] - total[here[:-1]]

    def _specials_in(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Offsets at which special strings start and end; nothing if none occurs."""
        whole = data.tobytes()
        starts, ends = [], []
        for special in self.specials:
            here = whole.find(special)
            while here >= 0:
                row = int(np.searchsorted(at, here, "right")) - 1
                inside = here + len(special) <= at[row + 1]  # else it only seems to occur, across two texts
                if inside:
                    starts.append(here)
                    ends.append(here + len(special))
                here = whole.find(special, here + (len(special) if inside else 1))
        return [np.array(starts, np.int64), np.array(ends, np.int64)] if starts else []


_counters: dict[int, Counter] = {}


def _counter(blob: bytes) -> Counter:
    key = hash(blob)
    if key not in _counters:
        _counters[key] = Counter(blob)
    return _counters[key]


def count_tokens(df: DataFrame, tokenizer: bytes, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """The input with the token count of each text."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)  # at most VOCABULARY_BYTES, see read_tokenizer
    keep = [c for c in df.columns if c.lower() != name.lower()]
    source = df.select(*[f"`{c}`" for c in keep])
    schema = T.StructType([*source.schema.fields, T.StructField(name, T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        with arrow_text.quiet():
            for batch in batches:
                counts = [counter.count_texts(data, at) for _, _, data, at in arrow_text.pieces(batch.column(keep.index(text)))]
                made = np.concatenate(counts) if counts else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int64())], names=[*keep, name])

    return source.mapInArrow(work, schema)


read_tokenizer = read_ranks
