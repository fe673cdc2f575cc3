"""Bounded samples of labelled rows for fitting; everything else runs over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brigade.llm.joins import attach
from brigade.operators.spread import top_within


def remainder(key: Column, of: int) -> Column:
    """CRC-32 of the key as text, modulo ``of``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % of


def drawn(labelled: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """Up to ``per_label`` keys of each label, drawn by a hash of the key, with their place in the draw."""
    order = [F.xxhash64(F.col(key).cast("string")), F.col(key).asc()]
    return top_within(labelled.select(key, label).distinct(), [label], order, per_label, rank="_draw")


def with_texts(drawn_keys: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The drawn keys with a text each: where rows share a key, the one whose text has the smallest hash.

    So there are no more rows than were drawn, however often a key is repeated.
    """
    texts = docs.select(key, F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    found = attach(texts, drawn_keys, [key], "inner")
    one = F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("_one")
    return found.groupBy(*drawn_keys.columns).agg(one).select(*drawn_keys.columns, F.col("_one._text").alias("_text"))
