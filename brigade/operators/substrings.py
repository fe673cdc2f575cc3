"""Which needles occur in which texts: an index of grams, looked up by each needle's rarest one.

Texts lay one row for each different run of ``gram`` characters they hold, so rows grow with the length of the texts and not
with the lengths of needles. A needle that holds a gram no text has cannot occur; any other is looked up by the gram that the
fewest texts have, and what that finds is verified. Needles shorter than a gram are looked up among the runs of their own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brigade.operators.spread import attach, settle

GRAM = 3


def grams(low: Column, size: Column | int) -> Column:
    """The different runs of ``size`` characters of a text; none if it is shorter."""
    size = F.lit(size) if isinstance(size, int) else size

    def runs(c: Column) -> Column:  # the characters, split once: each run takes a slice of them
        places = F.sequence(F.lit(1), F.size(c) - size + 1)
        return F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice(c, i, size), "")))

    def checked(c: Column) -> Column:
        return F.when(F.size(c) >= size, runs(c)).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(F.split(low, "")), checked)[0]


def pairs(texts: DataFrame, text: str, needles: DataFrame, needle: str, gram: int = GRAM) -> DataFrame:
    """All (text, needle) pairs of distinct values where the needle occurs in the text, ignoring case.

    Null texts, and null and empty needles, pair with nothing.
    """
    names = settle(
        texts.select(F.col(text).alias("_text")).where(F.length("_text") > 0).distinct().withColumn("_low", F.lower("_text")).withColumn(
            "_t", F.monotonically_increasing_id()), "texts")
    wanted = needles.select(F.col(needle).alias("_needle")).where(F.length("_needle") > 0).distinct().withColumn("_find", F.lower("_needle"))
    long = F.length("_find") >= gram
    found = _by_rarest(names, wanted.where(long), gram).unionByName(_short(names, wanted.where(~long)))
    met = settle(found, "candidates")
    uses = met.groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    # a text that many needles may occur in is spread over them
    told = attach(met, names.join(uses, "_t"), ["_t"], "inner", weight="_n", spread_by=["_needle"])
    return told.where(F.contains("_low", "_find")).select(F.col("_text").alias(text), F.col("_needle").alias(needle))


def _by_rarest(names: DataFrame, wanted: DataFrame, gram: int) -> DataFrame:
    laid = settle(names.select("_t", F.explode(grams(F.col("_low"), gram)).alias("_gram")), "grams")
    counts = laid.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    asked = wanted.select("_needle", "_find", F.explode(grams(F.col("_find"), gram)).alias("_gram"))
    uses = asked.groupBy("_gram").agg(F.count(F.lit(1)).alias("_asked"))
    known = attach(asked, counts.join(uses, "_gram"), ["_gram"], weight="_asked", spread_by=["_needle"])
    held = F.coalesce("_n", F.lit(0))
    rarest = known.groupBy("_needle", "_find").agg(F.min(F.struct(held.alias("_n"), "_gram")).alias("_r")).select("_needle", "_find", "_r.*")
    # a gram that many texts have is spread over them
    return attach(laid, rarest.where("_n > 0"), ["_gram"], "inner", weight="_n", spread_by=["_t"]).select("_t", "_needle", "_find")


def _short(names: DataFrame, wanted: DataFrame) -> DataFrame:
    lengths = wanted.agg(F.collect_set(F.length("_find"))).scalar()  # fewer than the length of a gram
    sized = names.withColumn("_len", F.explode(lengths))
    laid = sized.select("_t", F.explode(grams(F.col("_low"), F.col("_len"))).alias("_find"))
    counts = laid.groupBy("_find").agg(F.count(F.lit(1)).alias("_n"))
    return attach(laid, wanted.join(counts, "_find"), ["_find"], "inner", weight="_n", spread_by=["_t"]).select("_t", "_needle", "_find")
