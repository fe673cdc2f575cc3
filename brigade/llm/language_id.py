"""Language identification with string kernels.

Two texts are compared by the n-grams (one to four bytes) that both contain, each counted once: the blended-spectrum
presence kernel, normalised by the number of n-grams of either. Nystroem features over landmark texts carry it into
a space of bounded size, where one ridge regression per language is solved against the rest. As the kernel is linear in
the presence vectors, landmarks and weights fold into one matrix, and a batch of texts is scored by one product.

N-grams are taken from whole texts, lower-cased, with everything that is not a letter as a blank, and hashed to 2^15 bins.
The fit uses at most SAMPLE_ROWS labelled rows per language (a documented bound); prediction uses the text alone. A
null text, one without a letter, and every text when nothing was learned is ``und`` with score 0. Ties go to the first
language by name. Rows without an id are predicted like all others and never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brigade.llm import arrow_text, sampling

# Labelled rows per language in the fit, and how many of these are landmarks.
SAMPLE_ROWS, LANDMARKS = 400, 64
BINS = 1 << 15
ORDERS = (1, 2, 3, 4)
RIDGE = 1e-3
# Sharpness of the softmax that turns margins into a score.
SHARPNESS = 4.0
_ROWS = 64  # texts in one product
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def presence(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, BINS) which bins a text's n-grams fall into."""
    n = len(at) - 1
    seen = np.zeros(n * BINS, bool)
    low = np.frombuffer(data.tobytes().translate(_FOLD), np.uint8)
    text = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
    code = np.zeros(len(low), np.uint32)
    for order in ORDERS:
        m = len(low) - order + 1
        if m <= 0:
            break
        code = code[:m] << np.uint32(8) | low[order - 1 :]
        own = text[:m] == text[order - 1 :]
        # a multiplicative hash, another one per order
        bins = (code * np.uint32(0x9E3779B1 + 2 * order)) >> np.uint32(17)
        seen[(text[:m] * BINS + bins)[own]] = True
    return seen.reshape(n, BINS)


def _vectors(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    for low in range(0, len(column), _ROWS):
        for row, end, data, at in arrow_text.pieces(column.slice(low, _ROWS)):
            yield low + row, low + end, presence(data, at)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [np.packbits(row).tobytes() for _, _, seen in _vectors(batch.column(1)) for row in seen]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], names=["label", "draw", "bits"])


def _normed(seen: np.ndarray) -> np.ndarray:
    x = seen.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


class Model:
    """Languages and the folded matrix of landmarks and weights, (BINS, languages)."""

    def __init__(self, labels: Sequence[str], weights: np.ndarray):
        self.labels, self.weights = list(labels), weights

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its score."""
        best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
        for _, _, seen in _vectors(column):
            margins = (_normed(seen) @ self.weights).astype(np.float64) * SHARPNESS
            parts = np.exp(margins - margins.max(1, keepdims=True))
            best.append(margins.argmax(1))
            score.append(parts.max(1) / parts.sum(1))
        return np.concatenate(best), np.concatenate(score)


def fit(df: DataFrame, eligible: Column, key: str = "doc_id", text: str = "text", label: str = "lang") -> Model | None:
    """A model from up to SAMPLE_ROWS eligible rows of each language; none if there is no such row."""
    rows = df.where(eligible & F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    sample = sampling.with_texts(sampling.drawn(rows, label, key, SAMPLE_ROWS), df, key, text)
    bits = sample.select(label, "_text", "_draw").mapInArrow(_bits, "label string, draw int, bits binary")
    # SAMPLE_ROWS rows of BINS / 8 bytes for each language
    found = sorted(tuple(r) for r in bits.collect())
    if not found:
        return None
    labels = sorted({r[0] for r in found})
    seen = np.unpackbits(np.frombuffer(b"".join(r[2] for r in found), np.uint8).reshape(len(found), -1), axis=1)
    marks = _normed(seen[[i for i, r in enumerate(found) if r[1] <= LANDMARKS]])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # W^-1/2 on the landmarks' span
    kernel = np.concatenate([_normed(seen[i : i + 256]) @ marks.T for i in range(0, len(seen), 256)])
    features = kernel.astype(np.float64) @ root
    target = np.where(np.array([r[0] for r in found])[:, None] == np.array(labels), 1.0, -1.0)
    beta = np.linalg.solve(features.T @ features + RIDGE * len(found) * np.eye(features.shape[1]), features.T @ target)
    return Model(labels, (marks.T.astype(np.float64) @ (root @ beta)).astype(np.float32))


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The input with lang_pred and score."""
    added = ["lang_pred", "score"]
    keep = [c for c in df.columns if c.lower() not in added]
    if model is None:
        return df.select(*[f"`{c}`" for c in keep], F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # BINS floats for each language
    has_letter = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    source = df.select(*[f"`{c}`" for c in keep], has_letter.alias("_letter"))
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            best, score = model.predict(batch.column(keep.index(text)))
            letter = np.array(batch.column(len(keep)))
            names = [model.labels[i] if ok else "und" for i, ok in zip(best.tolist(), letter.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(np.where(letter, score, 0.0))], names=[*keep, *added])

    return source.mapInArrow(work, schema)
