"""Alerts on each upload of sales, judged against all sales so far.

Three tables grow by one folder a batch: the new sales, their part of the group figures (see ``operators.anomaly_history``) and the
alerts. A repeated batch overwrites its folders and sees only those of earlier batches, so it gives the same rows again.
Parts of figures are merged from time to time: a merge is complete when its folder is, and only then older parts go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brigade.operators import anomaly_history
from brigade.operators.spread import scratch, settle
from brigade.sources import sinks

BY_DAY = ("location_id", "date")
MERGE_EVERY = 50


def _folders(spark: SparkSession, path: str) -> dict[int, str]:
    """Number and path of the complete folders 'name=number' under a path."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    top = hadoop(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(top):
        return {}
    found = [s.getPath() for s in files.listStatus(top) if s.isDirectory()]
    return {int(p.getName().split("=")[1]): p.toString() for p in found if "=" in p.getName() and files.exists(hadoop(p, "_SUCCESS"))}


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def parts(spark: SparkSession, history: str, kind: str, upto: int) -> DataFrame | None:
    """The stored rows of a kind up to a batch: the newest merge, and the batches behind it."""
    merges = {n: p for n, p in _folders(spark, f"{history}/{kind}/merged").items() if n <= upto}
    base = max(merges, default=-1)
    paths = [merges[base]] if merges else []
    paths += [p for n, p in _folders(spark, f"{history}/{kind}/batches").items() if base < n <= upto]
    return spark.read.parquet(*paths) if paths else None


def known(spark: SparkSession, history: str, upto: int, locations: DataFrame | None = None) -> dict[str, DataFrame] | None:
    """The merged figures up to a batch, of some locations or of all."""
    out = {}
    for kind in anomaly_history.KINDS:
        rows = parts(spark, history, kind, upto)
        if rows is None:
            return None
        if locations is not None:
            rows = rows.join(locations, anomaly_history.KEY, "left_semi")
        out[kind] = anomaly_history.merge(kind, rows)
    return out


def merge_parts(spark: SparkSession, history: str, upto: int) -> None:
    """Store the figures up to a batch as one part, then drop what it was made from."""
    for kind in anomaly_history.KINDS:
        old = [f"{history}/{kind}/merged", f"{history}/{kind}/batches"]
        rows = parts(spark, history, kind, upto)
        if rows is None:
            continue
        gone = [p for top in old for n, p in _folders(spark, top).items() if n < upto or (n == upto and top.endswith("batches"))]
        anomaly_history.merge(kind, rows).write.mode("overwrite").parquet(f"{history}/{kind}/merged/upto={upto}")
        for path in gone:
            _delete(spark, path)


def apply(batch: DataFrame, number: int, table: str, history: str, alerts: str, merge_every: int = MERGE_EVERY, **thresholds) -> None:
    """Store one batch of sales, add its figures to the history and write its alerts."""
    spark = batch.sparkSession
    with scratch(spark):
        batch = settle(batch, "upload")
        old = sinks.stored(spark, table, f"{_ddl(batch)}, upload bigint")
        fresh = sinks.first_of_key(batch, sinks.KEYS["sales"])
        if old is not None:
            earlier = sinks.touched_only(old.where(F.col("upload") < number), batch, BY_DAY)
            fresh = sinks.new_rows(batch, earlier, sinks.KEYS["sales"])
        fresh = settle(fresh, "fresh")
        if fresh.isEmpty():
            return
        tagged = fresh.withColumn("upload", F.lit(number).cast("long"))
        sinks.replace_partitions(tagged, table, (*BY_DAY, "upload"))
        for kind, part in anomaly_history.figures(fresh).items():
            part.write.mode("overwrite").parquet(f"{history}/{kind}/batches/batch={number}")
        touched = fresh.select(*anomaly_history.KEY).distinct()
        found = anomaly_history.judged(fresh, known(spark, history, number, touched), **thresholds)
        found.write.mode("overwrite").parquet(f"{alerts}/upload={number}")
        if number and number % merge_every == 0:
            # what a repeat of this batch needs stays: it reads the merge of the batches before it and its own part
            merge_parts(spark, history, number - 1)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def alert_on_upload(sales: DataFrame, table: str, history: str, alerts: str, checkpoint: str, merge_every: int = MERGE_EVERY, trigger: dict | None = None, **thresholds) -> StreamingQuery:
    """Alerts for each batch of uploaded sales; sales whose key is stored already are no new ones. ``thresholds`` as ``anomaly_history.judged`` has them."""
    return sales.writeStream.foreachBatch(
        lambda batch, number: apply(batch, number, table, history, alerts, merge_every, **thresholds)
    ).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
