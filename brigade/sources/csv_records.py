"""CSV records that span lines, put together from the splits of a file.

Whether a line ends inside a quoted field depends on whether it begins in one, so each line is a function of two states. Such functions
combine: of a run of lines it is enough to know what the last line that does not depend on its start leaves, and how many lines
behind it swap the states. Each split is summed up so, the sums of a file's splits are combined in order, and
with the state at its start every split finds its records alone. Only the lines of records that span lines are
shuffled.

Quotes open a field only at its start and are escaped by doubling. A quote that is never closed ends on its own line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brigade.operators.spread import settle

_INNER = r'[^"]*+(?:""[^"]*+)*+'  # the inside of a quoted field
_FIELDS = rf'(?:(?:"{_INNER}"[^,]*+|[^",][^,]*+)?+,)*+'
_OPEN = rf'{_FIELDS}"{_INNER}$'
# Does a line end inside a field, if it begins outside of one, or inside?
FROM_OUTSIDE = rf"^(?s:{_OPEN})"
FROM_INSIDE = rf'^(?s:{_INNER}(?:$|"[^,]*+,{_OPEN}))'


def lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All lines with their file, their split and a number that follows their order in the split; files are read in splits."""
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))


def with_breaks(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """The files in which some line, read from outside of a field, ends inside one; the names come to the driver, as for any scan."""
    found = lines(spark, paths).where(F.col("line").contains('"') & F.col("line").rlike(FROM_OUTSIDE)).select("path").distinct()
    return [r["path"] for r in found.toLocalIterator()]


def _states(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """For each row ``_fixed``: the state before it if some row before fixes it (else null), and ``_swaps``: if not, is it swapped?

    Rows have ``outside`` and ``inside``: the state behind them if they begin outside, or inside.
    """
    whole = Window.partitionBy(*by).orderBy(order)
    earlier = whole.rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col("outside") & ~F.col("inside")).cast("int")
    counted = df.withColumn("_upto", F.sum(swap).over(whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fixed = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").alias("state"), F.col("_upto").alias("upto")))
    known = counted.withColumn("_last", F.last(fixed, ignorenulls=True).over(earlier)).withColumn("_here", F.col("_upto") - swap)
    odd = (F.col("_here") - F.col("_last.upto")) % 2 == 1
    return known.withColumn("_fixed", F.when(F.col("_last").isNotNull(), F.col("_last.state") != odd)).withColumn(
        "_swaps", F.col("_here") % 2 == 1).drop("_upto", "_last", "_here")


def _behind(state: Column) -> Column:
    return F.when(state, F.col("inside")).otherwise(F.col("outside"))


def records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The records of files in which fields hold line breaks: path, text, and whether it is the first of its file."""
    text = F.col("line")
    quoted = text.contains('"')
    # numbers follow the layout of the scan: written once, they are the same for all that follows
    laid = settle(lines(spark, paths).select(
        "*", (quoted & text.rlike(FROM_OUTSIDE)).alias("outside"), (~quoted | text.rlike(FROM_INSIDE)).alias("inside")), "lines")
    split = ["path", "block"]
    placed = _states(laid, split, "id")  # a task holds the lines of one split
    # what a split as a whole does to either state: its last line's, with the state before that line
    ends = placed.groupBy(*split).agg(F.max_by(F.struct("outside", "inside", "_fixed", "_swaps"), "id").alias("e")).select(*split, "e.*")
    sums = ends.select(
        *split, _behind(F.coalesce("_fixed", F.col("_swaps"))).alias("outside"), _behind(F.coalesce(F.col("_fixed"), ~F.col("_swaps"))).alias("inside"))
    starts = _states(sums, ["path"], "block").select(
        *split, F.coalesce("_fixed", "_swaps").alias("_start"))  # a file begins outside; one row for each split
    known = placed.join(starts, split).withColumn("_in", F.coalesce(F.col("_fixed"), F.col("_swaps") != F.col("_start")))
    known = known.withColumn("_after", _behind(F.col("_in")))
    whole = Window.partitionBy(*split).orderBy("id")
    begun = known.withColumn("_record", F.max(F.when(~F.col("_in"), F.col("id"))).over(whole))
    # a record that began in an earlier split: the last one that begins before this split
    carried = begun.groupBy(*split).agg(F.max("_record").alias("_l"), F.max_by("_after", "id").alias("_open"), F.min("id").alias("_first")).withColumn(
        "_carried", F.last("_l", ignorenulls=True).over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    last = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = carried.withColumn("_torn", F.when(F.last("_open").over(last), F.last("_l", ignorenulls=True).over(last))).withColumn(
        "_head", F.first("_first").over(last))
    full = begun.join(carried.select(*split, "_carried", "_torn", "_head"), split).withColumn("_record", F.coalesce("_record", "_carried"))
    alone = (~F.col("_in") & ~F.col("_after")) | F.coalesce(F.col("_record") == F.col("_torn"), F.lit(False))
    marked = full.withColumn("_alone", alone)
    single = marked.where("_alone").select("path", F.col("line").alias("record"), (F.col("id") == F.col("_head")).alias("first"))
    parts = marked.where("NOT _alone").groupBy("path", "_record").agg(
        F.sort_array(F.collect_list(F.struct("block", "id", "line"))).alias("_lines"), F.min(F.col("_record") == F.col("_head")).alias("first"))
    joined = parts.select("path", F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("record"), "first")
    return single.unionByName(joined)


def read(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], options: dict[str, str]) -> DataFrame:
    """Files that share one header, all columns as text, with their ``path``."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = records(spark, paths).where("NOT first AND length(trim(record)) > 0")
    return rows.select(F.from_csv("record", schema, options).alias("r"), "path").select("r.*", "path")
