"""Joins, ranks and lists that stay balanced when one key holds a large share of the rows.

Every helper keeps the result whole: nothing is dropped, capped or sampled.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brigade.session import shared_path

# A side is broadcast only when its measured size stays within this bound.
BROADCAST_BYTES = 64 * 1024 * 1024
# The same for a stored table beside a fact; a query may join several of them.
SIDE_BYTES = 32 * 1024 * 1024
# A key counts as hot from this many rows on; at most HOT_KEYS keys can be hot.
HOT_ROWS = 1_000_000
HOT_KEYS = 10_000


_open = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside are removed at the end, also after an error; what is to last must be written elsewhere.

    For work that repeats, such as the micro-batches of a stream.
    """
    before, _open.paths = getattr(_open, "paths", None), []
    try:
        yield
    finally:
        paths, _open.paths = _open.paths, before
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write the frame to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives Catalyst real sizes. The table stays until the shared folder is
    cleared, unless it is made within ``scratch``.
    """
    return _settled(df, name)[0]


def _settled(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """The settled frame and measures over it, taken while it was written."""
    path = shared_path(df.sparkSession, name)
    if getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    schema = df.schema
    seen = {}
    if measures:
        note = Observation()
        df.observe(note, *[c.alias(n) for n, c in measures.items()]).write.parquet(path)
        seen = note.get
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path), seen


def row_bytes(df: DataFrame) -> Column:
    """Size of a row, counted high: texts and lists by their length, 16 bytes for all else."""
    size = F.lit(16)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + 16 + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            size = size + 16 + 16 * F.coalesce(F.size(f.name), F.lit(0))
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            size = size + F.coalesce(F.octet_length(F.to_json(f.name)), F.lit(0))
        else:
            size = size + 16
    return size.cast("long")


def beside(fact: DataFrame, side: DataFrame, on: Sequence[str], how: str = "inner", broadcast_bytes: int | None = None) -> DataFrame:
    """Join a stored table that grows with the data: broadcast up to a measured size, shuffled beyond it.

    Left alone, Spark goes by the size of the files, and rows that pass through the driver can be many times larger.
    """
    broadcast_bytes = SIDE_BYTES if broadcast_bytes is None else broadcast_bytes
    size = side.agg(F.sum(row_bytes(side))).first()[0] or 0
    return fact.join(F.broadcast(side) if size <= broadcast_bytes else side.hint("merge"), list(on), how)


def attach(
    fact: DataFrame,
    stats: DataFrame,
    on: Sequence[str],
    how: str = "left",
    weight: str | None = None,
    spread_by: Sequence[str] | None = None,
    broadcast_bytes: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Join per-key rows onto a large frame.

    The stats side is settled and measured. Within ``broadcast_bytes`` it is broadcast and the fact
    is not shuffled. Beyond it both sides are shuffled, and keys whose ``weight`` (fact rows per
    key, a column of stats) reaches the hot mark are fanned out: the fact row goes to one of
    ``fan`` copies of its key, picked by a hash of ``spread_by``.
    """
    broadcast_bytes = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    on = list(on)
    total = F.lit(0) if weight is None else F.sum(weight)
    stats, seen = _settled(stats, "stats", size=F.sum(row_bytes(stats)), total=total)
    if (seen["size"] or 0) <= broadcast_bytes:
        return fact.join(F.broadcast(stats), on, how)
    # hinted, or Spark would still broadcast what takes little room in files
    if weight is None:
        return fact.join(stats.hint("merge"), on, how)
    mark = max(hot_rows or HOT_ROWS, (seen["total"] or 0) // HOT_KEYS + 1)
    spread_by = list(spread_by or [c for c in fact.columns if c not in on])
    fan = F.greatest(F.lit(1), F.ceil(F.col(weight) / F.lit(mark))).cast("int")
    # at most total / mark <= HOT_KEYS distinct keys pass this filter
    hot = F.broadcast(
        stats.where(F.col(weight) >= mark).groupBy(*on).agg(F.max(fan).alias("_fan"))
    )
    # rows without a key match nothing, so they may go anywhere
    no_key = F.when(F.coalesce(*[F.when(F.col(k).isNull(), F.lit(1)) for k in on]) == 1, F.lit(HOT_KEYS))
    left = (
        fact.join(hot, on, "left")
        .withColumn("_part", F.pmod(F.xxhash64(*spread_by), F.coalesce("_fan", no_key, F.lit(1))).cast("int"))
        .drop("_fan")
    )
    right = stats.withColumn(
        "_part",
        F.explode(
            F.when(F.col(weight) >= mark, F.sequence(F.lit(0), fan - 1)).otherwise(F.array(F.lit(0)))
        ),
    )
    return left.join(right.hint("merge"), [*on, "_part"], how).drop("_part")


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    rank: str = "rank",
    totals: Mapping[str, Column] | None = None,
    size: str | None = None,
    slices: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Row number (and running totals, and group size) within each group, without one task per group.

    A range shuffle samples its input and so computes it twice: it is settled first, unless it is ``stored`` already.

    Rows are range-partitioned by (group, order) and settled with their slice number; each slice
    counts on its own and adds what the earlier slices of the same group hold. ``order`` must be
    unique within a group for the result to be fixed.
    """
    totals = dict(totals or {})
    group = list(group)
    spark = df.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    valued = (df if stored else settle(df, "ranked")).select("*", *[c.alias(f"_v_{n}") for n, c in totals.items()])
    laid = settle(
        valued.repartitionByRange(slices, *[F.col(g) for g in group], *order).withColumn(
            "_slice", F.spark_partition_id()
        ),
        "slices",
    )
    # as a struct the group equals itself even where a field is null, and window and join share one shuffle
    keyed = laid.withColumn("_g", F.struct(*group)).drop(*group)
    sizes = keyed.groupBy("_g", "_slice").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals]
    )
    # a group appears at most once per slice, so these windows hold at most `slices` rows
    whole = Window.partitionBy("_g")
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(
        "_g",
        "_slice",
        F.sum("_rows").over(whole).alias("_size"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        *[F.sum(f"_s_{n}").over(earlier).alias(f"_b_{n}") for n in totals],
    )
    here = Window.partitionBy("_g", "_slice").orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = keyed.withColumn("_here", F.row_number().over(here))
    for n in totals:
        local = local.withColumn(f"_h_{n}", F.sum(f"_v_{n}").over(upto))
    return local.join(before, ["_g", "_slice"]).select(
        *[F.col(f"_g.{c}").alias(c) if c in group else F.col(c) for c in df.columns],
        (F.col("_before") + F.col("_here")).cast("long").alias(rank),
        *([F.col("_size").cast("long").alias(size)] if size else []),
        *[(F.coalesce(f"_b_{n}", F.lit(0)) + F.col(f"_h_{n}")).alias(n) for n in totals],
    )


def top_within(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First k rows per group; Spark keeps only k rows per group in each task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def paged_list(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    name: str,
    sep: str = ", ",
    page_rows: int = 1000,
) -> DataFrame:
    """The sorted, joined values of each group, ``page_rows`` of them per row.

    A group of usual size gives one row with page 0; a huge one continues on further pages, so no
    task ever holds more than one page.
    """
    ranked = running(df, group, [F.col(value)], rank="_pos").withColumn(
        "page", F.floor((F.col("_pos") - 1) / page_rows).cast("long")
    )
    return ranked.groupBy(*group, "page").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("_pos", value))), lambda x: x[value]), sep
        ).alias(name)
    )
