"""Quality by compression.

Two zstandard dictionaries are built from labelled text, one from good and one from bad. A text is compressed with
either, piece by piece over its whole length; the difference of the two sizes, divided by the text's size, says which
dictionary knows it better. A logistic curve, fitted on labelled rows that are not in the dictionaries, turns it into
a score.

The fit uses at most SAMPLE_ROWS labelled rows of each label with texts of at most SAMPLE_BYTES (documented bounds); half
of them go into the dictionaries. A score uses the text alone. Null and empty texts have a difference of 0 and the
score of that; without rows of both labels every score is 0.5. Rows with contradicting labels count for both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brigade.llm import arrow_text, sampling

SAMPLE_ROWS, SAMPLE_BYTES = 3000, 32 << 10
DICTIONARY_BYTES = 256 << 10
LEVEL = 3
# Bytes compressed at a time, so that a long text does not become its own dictionary.
PART_BYTES = 512


def _parts(text: bytes) -> list[bytes]:
    return [text[i : i + PART_BYTES] for i in range(0, len(text), PART_BYTES)]


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary from texts: trained, or the texts themselves where these are too few to train on."""
    parts = [p for t in texts for p in _parts(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:DICTIONARY_BYTES]


class Model:
    """Both dictionaries and the logistic curve."""

    def __init__(self, good: bytes, bad: bytes, slope: float = 0.0, offset: float = 0.0):
        self.good, self.bad, self.slope, self.offset = good, bad, slope, offset
        self._ready: list | None = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def difference(self, text: bytes) -> float:
        """(size by the bad dictionary - size by the good one) / size of the text."""
        if not text:
            return 0.0
        if self._ready is None:
            self._ready = []
            for blob in (self.bad, self.good):
                known = zstandard.ZstdCompressionDict(blob)
                known.precompute_compress(level=LEVEL)
                self._ready.append(zstandard.ZstdCompressor(
                    dict_data=known, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False))
        parts = _parts(text)
        bad, good = (sum([len(c.compress(p)) for p in parts]) for c in self._ready)
        return (bad - good) / len(text)

    def score(self, difference: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, self.slope * difference + self.offset))))


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve by Newton steps, lightly pulled to 0; both labels weigh the same."""
    scale = float(np.abs(x).max()) or 1.0
    a = np.stack([x / scale, np.ones(len(x))], 1)
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + 1e-4 * b
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / scale), float(b[1])


def fit(
    docs: DataFrame, labels: DataFrame, eligible: Column, key: str = "doc_id", text: str = "text", label: str = "quality",
) -> Model | None:
    """A model from up to SAMPLE_ROWS eligible labelled rows of each label; none if one of them is missing."""
    rows = labels.where(eligible & F.col(label).isin(0, 1) & F.col(key).isNotNull())
    short = docs.where(F.octet_length(text).between(1, SAMPLE_BYTES))
    sample = sampling.with_texts(sampling.drawn(rows, label, key, SAMPLE_ROWS), short, key, text)
    # at most 2 x SAMPLE_ROWS texts of SAMPLE_BYTES
    found = sorted((r[0], r[1], r[2].encode()) for r in sample.select(label, "_draw", "_text").collect())
    if {r[0] for r in found} != {0, 1}:
        return None
    taught = {k: [t for q, n, t in found if q == k and n % 2] or [t for q, n, t in found if q == k] for k in (0, 1)}
    model = Model(dictionary(taught[1]), dictionary(taught[0]))
    rest = [(q, model.difference(t)) for q, n, t in found if n % 2 == 0]
    if {q for q, _ in rest} != {0, 1}:
        rest = [(q, model.difference(t)) for q, _, t in found]
    model.slope, model.offset = calibrate(np.array([d for _, d in rest]), np.array([q for q, _ in rest]))
    return model


def score(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The input with size_difference and score."""
    added = ["size_difference", "score"]
    keep = [c for c in df.columns if c.lower() not in added]
    if model is None:
        return df.select(*[f"`{c}`" for c in keep], F.lit(0.0).alias("size_difference"), F.lit(0.5).alias("score"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(c, T.DoubleType()) for c in added]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, at = arrow_text.flat_utf8(batch.column(keep.index(text)))
            whole, at = data.tobytes(), at.tolist()
            found = [model.difference(whole[a:b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64()), pa.array([model.score(d) for d in found], pa.float64())], names=[*keep, *added])

    return df.select(*[f"`{c}`" for c in keep]).mapInArrow(work, schema)
