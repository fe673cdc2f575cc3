"""Questions matched to the first entry of a catalog, by one automaton over all its patterns.

The automaton is a trie of the patterns with failure links; each question runs through it once, whatever the number of patterns.
The catalog is a table: ``prompt_id``, ``position`` (its order), ``pattern``, ``is_kpi`` and ``skip_with_period``. It is broadcast up to
a measured size; a larger one is looked up by the gram index of ``substrings``, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brigade.operators import substrings
from brigade.operators.catalog import PERIOD_WORDS
from brigade.operators.spread import attach

CATALOG_BYTES = 16 << 20
NONE = np.iinfo(np.int64).max
_BEST = ("_any", "_timed", "_kpi")  # of all entries, of those that a period allows, of KPI entries


def low(text: str) -> Column:
    return F.coalesce(F.lower(F.trim(text)), F.lit(""))


def timed(text: str) -> Column:
    """Does the question name a period?"""
    return F.coalesce(*[F.when(low(text).contains(w), True) for w in PERIOD_WORDS], F.lit(False))


def entries(catalog: DataFrame) -> DataFrame:
    """The places of each pattern: the first of all its entries, of those that stand with a period, and of its KPI entries."""
    def first(test: Column) -> Column:
        return F.coalesce(F.min(F.when(test, F.col("position"))), F.lit(NONE)).cast("long")

    skip, is_kpi = F.coalesce("skip_with_period", F.lit(False)), F.coalesce("is_kpi", F.lit(False))
    return catalog.where(F.col("pattern").isNotNull()).groupBy(F.lower("pattern").alias("pattern")).agg(
        first(F.lit(True)).alias("_any"), first(~skip).alias("_timed"), first(is_kpi).alias("_kpi"))


def _automaton(rows: list[tuple]) -> tuple[ahocorasick.Automaton, tuple]:
    """The automaton, and what an empty pattern, which is in every text, gives."""
    made, always = ahocorasick.Automaton(), (NONE, NONE, NONE)
    for pattern, *places in rows:
        if pattern:
            made.add_word(pattern, tuple(places))
        else:
            always = tuple(places)
    made.make_automaton()
    return made, always


def match(questions: DataFrame, text: str, catalog: DataFrame, catalog_bytes: int = CATALOG_BYTES) -> DataFrame:
    """The questions with ``prompt_id``: the first entry in catalog order with a pattern that occurs in the text, ignoring case.

    A question that names a period takes the first KPI entry, if any matches, and none that is skipped with a period.
    Null texts match what an empty text does. The columns of the questions are kept.
    """
    held = entries(catalog)
    size = held.agg(F.sum(F.octet_length("pattern") + 48)).first()[0] or 0
    best = _by_automaton(questions, text, held) if size <= catalog_bytes else _by_grams(questions, text, held)
    place = F.when(F.col("_with_period"), F.least("_kpi", F.lit(NONE))).otherwise(F.lit(NONE))
    place = F.when(place < NONE, place).when(F.col("_with_period"), F.col("_timed")).otherwise(F.col("_any"))
    ids = catalog.groupBy(F.col("position").cast("long").alias("_place")).agg(F.min("prompt_id").alias("prompt_id"))
    found = best.withColumn("_place", place).drop(*_BEST, "_with_period")
    uses = found.groupBy("_place").agg(F.count(F.lit(1)).alias("_n"))
    # one entry may answer a third of all questions
    return attach(found, ids.join(uses, "_place"), ["_place"], weight="_n").drop("_place", "_n").select(*questions.columns, "prompt_id")


def _by_automaton(questions: DataFrame, text: str, held: DataFrame) -> DataFrame:
    rows = [tuple(r) for r in held.toLocalIterator()]  # at most CATALOG_BYTES
    shared = questions.sparkSession.sparkContext.broadcast(rows)
    source = questions.withColumn("_with_period", timed(text)).withColumn("_low", low(text))
    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(c, T.LongType()) for c in _BEST]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, always = _automaton(shared.value)
        for batch in batches:
            best = np.empty((batch.num_rows, len(_BEST)), np.int64)
            for k, value in enumerate(batch.columns[-1]):
                found = always
                if len(automaton):
                    for _, places in automaton.iter(value.as_py()):
                        found = tuple(map(min, found, places))
                best[k] = found
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(best[:, j]) for j in range(len(_BEST))]], names=[f.name for f in schema])

    return source.mapInArrow(work, schema)


def _by_grams(questions: DataFrame, text: str, held: DataFrame) -> DataFrame:
    source = questions.withColumn("_with_period", timed(text)).withColumn("_low", low(text))
    pairs = substrings.pairs(source, "_low", held, "pattern")
    uses = pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("_n"))
    each = attach(pairs, held.join(uses, "pattern"), ["pattern"], "inner", weight="_n", spread_by=["_low"])
    always = held.where("pattern = ''").agg(*[F.coalesce(F.min(c), F.lit(NONE)).alias(c) for c in _BEST])
    rows = source.groupBy("_low").agg(F.count(F.lit(1)).alias("_rows"))
    best = each.groupBy("_low").agg(*[F.min(c).alias(c) for c in _BEST]).join(rows, "_low")
    told = attach(source, best, ["_low"], weight="_rows")
    return told.select(*questions.columns, "_with_period", *[
        F.least(F.coalesce(c, F.lit(NONE)), always.select(c).scalar()).alias(c) for c in _BEST])
