"""Writes: insert-ignore, keep-latest upsert, replace, append and KPI documents.

Tables are parquet folders partitioned by location_id (and more on request). Only the partitions that
the new rows touch are read and rewritten.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brigade.operators.spread import settle

# Keys of the four tables.
KEYS = {
    "sales": ("location_id", "sale_id", "date"),
    "inventory": ("location_id", "date", "ingredient"),
    "menu": ("location_id", "menu_item", "ingredient", "date"),
    "labor": ("location_id", "employee_id", "date"),
}


def stored(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The table at a path, or None where nothing was written yet."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def first_of_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ingest_seq",)) -> DataFrame:
    """One row per key: the first by the order columns the frame has, then by its values, whatever the partitioning."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    place = F.struct(*[c for c in order if c in rest], F.to_json(F.struct(*rest)))
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), place).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def with_data_copy(df: DataFrame) -> DataFrame:
    """The row as JSON beside its columns."""
    return df.withColumn("data", F.to_json(F.struct("*")))


# Up to so many values of a partition column a scan is pruned by; beyond that many it reads all folders of that column.
PRUNE_VALUES = 1000


def _pruned(old: DataFrame, touched: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """The table without the folders of values that do not occur; a join alone would read them all."""
    for c in partition_by:
        values = [r[0] for r in touched.select(c).distinct().limit(PRUNE_VALUES + 1).collect()]
        if len(values) <= PRUNE_VALUES:
            some = F.col(c).isin([v for v in values if v is not None])
            old = old.where(some | F.col(c).isNull() if None in values else some)
    return old


def touched_only(old: DataFrame, batch: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Stored rows of the partitions a batch touches; a null partition is one like any other.

    Folders of other values are not read. Of the rest the touched combinations are found by joins, those without a null by
    an equal one.
    """
    touched = settle(batch.select(*partition_by).distinct(), "touched")
    old = _pruned(old, touched, partition_by)
    no_null = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in partition_by])
    plain = old.join(touched.where(no_null), list(partition_by), "left_semi")
    named = touched.where(~no_null).select(*[F.col(c).alias(f"_p_{c}") for c in partition_by])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in partition_by])
    return plain.unionByName(old.where(~no_null).join(named, same, "left_semi"))


def new_rows(batch: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key of the batch, without the keys that are stored.

    Null-safe, so that rows without a date do not come back on every run.
    """
    there = old.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    on = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = test if on is None else on & test
    return first_of_key(batch, keys).join(there, on, "left_anti")


def _gathered(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows of one folder brought together before the write, or every task would put a file into each folder.

    A folder with more rows than a task should hold is split again by the adaptive execution, so it gets several files.
    """
    return df.hint("rebalance", *[F.col(c) for c in partition_by])


def insert_new(df: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str] = ("location_id",)) -> None:
    """Append the rows whose key is not stored yet. A rerun of the same batch adds nothing."""
    old = stored(df.sparkSession, path, df.schema)
    if old is None:
        fresh = first_of_key(df, keys)
    else:
        if set(partition_by) <= set(keys):
            old = touched_only(old, df, partition_by)
        fresh = new_rows(df, old, keys)
    _gathered(fresh, partition_by).write.mode("append").partitionBy(*partition_by).parquet(path)


def latest(df: DataFrame, keys: Sequence[str], newest_by: Sequence[str]) -> DataFrame:
    """The newest row per key, merged map-side."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*newest_by)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert_latest(
    df: DataFrame, path: str, keys: Sequence[str], newest_by: Sequence[str],
    partition_by: Sequence[str] = ("location_id",),
) -> None:
    """Keep the newest row per key. Only touched partitions are rewritten.

    The merged rows are settled first: the rewrite never reads what it is about to replace.
    """
    old = stored(df.sparkSession, path, df.schema)
    merged = df
    if old is not None:
        merged = touched_only(old, df, partition_by).select(*df.columns).unionByName(df)
    _overwrite(settle(latest(merged, keys, newest_by), "upsert"), path, partition_by)


def _overwrite(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    (
        _gathered(df, partition_by).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str] = ("location_id",)) -> None:
    """Replace all rows of the locations in the batch; other locations stay as they are."""
    _overwrite(df, path, partition_by)


def append_tagged(df: DataFrame, path: str, filename: Column | str, partition_by: Sequence[str] = ("location_id",)) -> None:
    """Append with the file's name; nothing stored is read or rewritten."""
    name = F.lit(filename) if isinstance(filename, str) else filename
    _gathered(df.withColumn("filename", name), partition_by).write.mode("append").partitionBy(*partition_by).parquet(path)


def write_documents(results: DataFrame, path: str) -> None:
    """KPI rows as JSON lines under their location."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("location_id").json(path)


def _rows_by_text(spark: SparkSession, path: str, partition_by: Sequence[str], schema=None) -> DataFrame | None:
    """A stored table whose partition values are read as they are written; ``schema`` is the stored one, if it is known.

    Without it Spark would guess numbers and dates from folder names, and a rewrite would put ``01`` into ``1``.
    """
    if schema is None:
        found = stored(spark, path)
        if found is None:
            return None
        schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in partition_by else f for f in found.schema])
    return stored(spark, path, schema)


def _rewrite(spark: SparkSession, path: str, touched: DataFrame, left: DataFrame, partition_by: Sequence[str]) -> None:
    """Write what is left of touched partitions (settled, with their folder) and drop the folders of those left empty.

    All other files stay as they are. Both steps can be repeated: a rerun after a failure finds what is still to do.
    """
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_l_{c}")) for c in partition_by])
    there = left.select(*[F.col(c).alias(f"_l_{c}") for c in partition_by]).distinct()
    _overwrite(left, path, partition_by)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    # one short row for each emptied partition, as the file listing of the table holds anyway
    for r in touched.join(there, same, "left_anti").select("_folder").distinct().toLocalIterator():
        folder = hadoop(spark._jvm.java.net.URI(r["_folder"]))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _folder() -> Column:
    return F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("_folder")


def delete_older(
    spark: SparkSession, path: str, keep: Column, partition_by: Sequence[str] = ("location_id",), schema=None,
) -> None:
    """Delete the rows for which ``keep`` is false; rows for which it is null stay.

    Only partitions that hold such rows are read in full and rewritten; one that is left empty is dropped. Without the
    stored ``schema`` partition values are text.
    """
    rows = _rows_by_text(spark, path, partition_by, schema)
    if rows is None:
        return
    keep = F.coalesce(keep, F.lit(True))
    touched = settle(rows.where(~keep).select(*partition_by, _folder()).distinct(), "touched")
    left = settle(touched_only(rows, touched, partition_by).where(keep), "kept")
    _rewrite(spark, path, touched, left, partition_by)


def delete_keys(
    spark: SparkSession, path: str, gone: DataFrame, keys: Sequence[str], partition_by: Sequence[str] = ("location_id",), schema=None,
) -> None:
    """Delete stored rows by their key; a null in a key equals itself.

    First the keys alone are read, to find the partitions that hold one; only these are read in full and rewritten, one
    that is left empty is dropped. Without the stored ``schema`` partition values are text, those of ``gone`` as well.
    """
    rows = _rows_by_text(spark, path, partition_by, schema)
    if rows is None:
        return
    kinds = {f.name: f.dataType for f in rows.schema}
    marks = settle(gone.select(*[F.col(k).cast(kinds[k]).alias(f"_g_{k}") for k in keys]).distinct(), "gone")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
    narrow = rows.select(*dict.fromkeys([*keys, *partition_by]), _folder())
    touched = settle(narrow.join(marks, same, "left_semi").select(*partition_by, "_folder").distinct(), "touched")
    left = settle(touched_only(rows, touched, partition_by).join(marks, same, "left_anti"), "kept")
    _rewrite(spark, path, touched, left, partition_by)
